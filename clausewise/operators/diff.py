"""Clause diffs along the version chains of documents, and what follows from them.

Every parsed version is compared with the one before it (same document and language, by retrieval), so a clause stands on the new
side of its own version's comparison and on the old side of the next one's; a first version is a baseline and gives
nothing.  A comparison is named by its two versions, and all its stages are windows inside it, after one exchange by document.

The stages consume: equal paths first, then the authority's own renumbering, then equal content, then greedy
fuzzy pairs; only what none of them took is removed or added.  The fuzzy stage sees distinct leftover texts only: blocks of
old and new texts of one comparison and kind meet in parallel tasks, and a pair becomes a row only if its ratio reaches the
threshold.  Bounds (length, letters, longest common subsequence) keep almost all others from being matched at all, and
none can lose a pair, since a matching never has more characters than these.  The greedy choice then runs over those rows.
"""

from __future__ import annotations

import difflib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import COUNT_DRIFT_RATIO, NON_SUBSTANTIVE_KINDS, RENUMBER_CONFIDENT_RATIO, RENUMBER_RATIO, SIMILARITY_PREFIX
from clausewise.work import written

DIFF = "doc_id long, from_version long, to_version long, old_path string, new_path string, old_ordinal int, new_ordinal int, change_kind string, similarity double, match_basis string, needs_review boolean"
#: A comparison of two versions of a document.
PAIR = ["doc_id", "to_version"]
#: Distinct texts of one side in a block of the fuzzy stage.
BLOCK_TEXTS = 256


def _chain(versions: DataFrame) -> Window:
    """A document's versions of one language, oldest first; a table without languages has one for each document."""
    return Window.partitionBy("doc_id", *(["language"] if "language" in versions.columns else [])).orderBy("retrieved_at", "version_id")


def previous_version(versions: DataFrame) -> DataFrame:
    """Each parsed version with the parsed one before it (same document and language, by retrieval, then id)."""
    return versions.where("parsed").withColumn("previous_id", F.lag("version_id").over(_chain(versions)))


def comparable_versions(versions: DataFrame) -> DataFrame:
    """Versions that have one to be compared with; a baseline has none and gives no diffs."""
    return previous_version(versions).where("previous_id IS NOT NULL")


def successor_version(versions: DataFrame) -> DataFrame:
    return versions.where("parsed").withColumn("successor_id", F.lead("version_id").over(_chain(versions)))


def count_drift(clauses: DataFrame, versions: DataFrame, ratio: float = COUNT_DRIFT_RATIO) -> DataFrame:
    """Parsed versions whose clause count is zero or moved by more than ``ratio`` of that of the parsed version before, if that has any."""
    counts = versions.where("parsed").join(clauses.groupBy("version_id").agg(F.count("*").alias("n")), "version_id", "left").fillna(0, ["n"])
    seen = counts.withColumn("before", F.lag("n").over(_chain(versions)))
    drift = F.when(F.col("n") == 0, "zero_clauses").when((F.col("before") > 0) & (F.abs(F.col("n") - F.col("before")) > ratio * F.col("before")), "clause_count_delta")
    return seen.withColumn("signal", drift).where("signal IS NOT NULL")


def _sides(clauses: DataFrame, versions: DataFrame | None) -> DataFrame:
    """Clauses with from_version, to_version and v (1 on the old side of a comparison, 2 on the new one); a clause in the
    middle of a chain comes twice, one that is compared with nothing not at all."""
    if versions is None:
        clauses = clauses if "version_id" in clauses.columns else clauses.withColumn("version_id", F.col("v").cast("long"))
        versions = clauses.select("doc_id", "version_id", F.col("v").alias("retrieved_at"), F.lit(True).alias("parsed")).distinct()
    old = F.struct(F.col("previous_id").alias("version_id"), F.col("previous_id").alias("from_version"), F.col("version_id").alias("to_version"), F.lit(1).alias("v"))
    new = F.struct("version_id", F.col("previous_id").alias("from_version"), F.col("version_id").alias("to_version"), F.lit(2).alias("v"))
    # a document's comparisons travel as one short row, so that clauses are dealt out by document and nothing else
    roles = comparable_versions(versions).groupBy("doc_id").agg(F.flatten(F.collect_list(F.array(old, new))).alias("roles"))
    own = F.filter("roles", lambda r: r["version_id"] == F.col("version_id"))
    return clauses.drop("v").join(roles, "doc_id").withColumn("role", F.explode(own)).drop("roles", "version_id").select("*", "role.from_version", "role.to_version", "role.v").drop("role")


def _partnered(rows: DataFrame, key: str, basis: str, first_only: bool = False) -> DataFrame:
    """Pair the k-th old and the k-th new row of a key among rows that no stage has taken; the new row gets the old one.

    All windows lie inside a document, so one exchange by document serves every stage.
    """
    open_ = F.col("basis").isNull() & F.col(key).isNotNull()
    rows = rows.withColumn("open", open_).withColumn("k", F.row_number().over(Window.partitionBy(*PAIR, key, "open", "v").orderBy("ordinal", "path")))
    pair = Window.partitionBy(*PAIR, key, "open", "k")
    whole = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = F.col("open") & (F.min("v").over(whole) < F.max("v").over(whole))
    if first_only:
        paired &= F.col("k") == 1
    found = rows.withColumn("paired", paired).withColumn("one", F.lag(F.struct("path", "ordinal", "content_hash", "bare_hash")).over(pair.orderBy("v")))
    return (
        found.withColumn("partner", F.when(F.col("paired") & (F.col("v") == 2), F.col("one")).otherwise(F.col("partner")))
        .withColumn("basis", F.when(F.col("paired"), basis).otherwise(F.col("basis"))).drop("open", "k", "paired", "one"))


def paired_rows(clauses: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Both sides of every comparison, each row with the stage that took it and, on the new side, its partner.

    Without ``versions`` (version_id, doc_id, retrieved_at, parsed, perhaps language) the clauses' own column v numbers each document's chain.
    """
    bare = F.trim(F.regexp_replace("text", r"^\s*제\d+조(?:의\d+)?\s*", ""))
    rows = _sides(clauses, versions).select(
        *PAIR, "from_version", "v", "path", "ordinal", "kind", "content_hash", F.substring("text", 1, SIMILARITY_PREFIX).alias("head"), F.xxhash64(bare).alias("bare_hash"), F.when(F.col("v") == 1, F.col("moved_to_ref")).otherwise(F.col("source_ref")).alias("ref"),
        F.lit(None).cast("string").alias("basis"), F.lit(None).cast("struct<path:string,ordinal:int,content_hash:string,bare_hash:long>").alias("partner"))
    rows = rows.repartition("doc_id")
    return _partnered(_partnered(_partnered(rows, "path", "path"), "ref", "authority", first_only=True), "content_hash", "content_hash")


def exact_diffs(paired: DataFrame) -> DataFrame:
    """Diffs of the exact stages.  Equal content at an equal path is none, wherever it stands now; the authority's
    renumbering counts as such if the text is equal but for its leading number."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    kind = (
        F.when((F.col("basis") == "path") & (F.col("content_hash") != F.col("partner.content_hash")), "modified")
        .when(F.col("basis") == "authority", F.when(F.col("bare_hash") == F.col("partner.bare_hash"), "renumbered").otherwise("modified"))
        .when(F.col("basis") == "content_hash", F.when(last(F.col("path")) == last(F.col("partner.path")), "moved").otherwise("renumbered")))
    return paired.where("v = 2 AND basis IS NOT NULL").withColumn("change_kind", kind).where("change_kind IS NOT NULL").select(
        "doc_id", "from_version", "to_version", F.col("partner.path").alias("old_path"), F.col("path").alias("new_path"), F.col("partner.ordinal").alias("old_ordinal"), F.col("ordinal").alias("new_ordinal"), "change_kind",
        F.when(F.col("basis") == "content_hash", 1.0).alias("similarity"), F.col("basis").alias("match_basis"), F.lit(False).alias("needs_review"))


def common_characters(a: str, masks: dict[str, int], size: int) -> int:
    """Length of the longest common subsequence of ``a`` and the text of ``size`` whose characters' places are ``masks`` (bits)."""
    whole = (1 << size) - 1
    row = whole
    for c in a:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & whole
    return size - row.bit_count()


def similar_texts(olds: list[str], news: list[str], ratio: float) -> list[tuple[int, int, float]]:
    """(place in olds, place in news, matching-block ratio) of all pairs that reach ``ratio``."""
    out = []
    size_old, size_new = (np.array([len(x) for x in side]) for side in (olds, news))

    def letters(texts: list[str]) -> np.ndarray:
        rows = np.zeros((len(texts), 64), np.int32)
        for row, t in zip(rows, texts, strict=True):
            row += np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64).astype(np.int32)
        return rows

    count_old, count_new = letters(olds), letters(news)
    match = difflib.SequenceMatcher(None, autojunk=False)
    for n, text in enumerate(news):
        needed = ratio * (size_old + size_new[n]) / 2 - 1e-9
        near = np.flatnonzero((np.minimum(size_old, size_new[n]) >= needed) & (np.minimum(count_old, count_new[n]).sum(axis=1) >= needed))
        if not near.size:
            continue
        masks: dict[str, int] = defaultdict(int)
        for k, c in enumerate(text):
            masks[c] |= 1 << k
        match.set_seq2(text)
        for o in near.tolist():
            if common_characters(olds[o], masks, len(text)) >= needed[o]:
                match.set_seq1(olds[o])
                if (r := match.ratio()) >= ratio:
                    out.append((o, n, r))
    return out


def fuzzy_candidates(rest: DataFrame) -> DataFrame:
    """doc_id, to_version, kind, old, new (hashes of texts), ratio: pairs of leftover texts of one kind that are alike enough."""
    group = [*PAIR, "kind"]
    texts = rest.groupBy(*group, "v", "text_hash").agg(F.first("head").alias("head"))
    size = F.count("*").over(Window.partitionBy(*group, "v"))
    blocks = texts.withColumn("block", F.pmod("text_hash", F.ceil(size / BLOCK_TEXTS))).groupBy(*group, "v", "block").agg(F.collect_list("text_hash").alias("hashes"), F.collect_list("head").alias("heads"))
    side = lambda v, name: blocks.where(f"v = {v}").select(*group, F.col("hashes").alias(f"{name}_hashes"), F.col("heads").alias(f"{name}_heads"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = similar_texts(r["old_heads"], r["new_heads"], RENUMBER_RATIO)
                rows += [(r["doc_id"], r["to_version"], r["kind"], r["old_hashes"][o], r["new_hashes"][n], ratio) for o, n, ratio in found]
            columns = list(zip(*rows)) or [()] * 6
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*group, "old", "new", "ratio"])

    return side(1, "old").join(side(2, "new"), group).mapInArrow(run, "doc_id long, to_version long, kind string, old long, new long, ratio double")


def greedy(rows: list[dict], candidates: list[dict]) -> list[tuple]:
    """(old row, new row, ratio), either row perhaps None: old rows in reading order take the best free new row, the first among equals."""
    likely = defaultdict(list)
    for c in candidates:
        likely[c["old"]].append((c["new"], c["ratio"]))
    free = defaultdict(list)
    place = lambda r: (r["ordinal"], r["path"])
    for r in sorted((r for r in rows if r["v"] == 2), key=place, reverse=True):
        free[r["text_hash"]].append(r)
    out = []
    for r in sorted((r for r in rows if r["v"] == 1), key=place):
        open_ = [(-ratio, *place(free[new][-1]), new) for new, ratio in likely[r["text_hash"]] if free[new]]
        if open_:
            ratio, *_, new = min(open_)
            out.append((r, free[new].pop(), -ratio))
        else:
            out.append((r, None, None))
    return out + [(None, r, None) for held in free.values() for r in held]


def leftover_diffs(rest: DataFrame) -> DataFrame:
    """What no exact stage took: greedy pairs in reading order by matching-block ratio, clauses of one kind only, at least
    the renumber ratio; then what is left, removed on the old side and added on the new one."""
    group = [*PAIR, "kind"]
    rest = rest.withColumn("head", F.coalesce("head", F.lit(""))).withColumn("text_hash", F.xxhash64("head"))
    alike = written(fuzzy_candidates(rest), "diff-candidates")
    side = lambda v, c: alike.select(*group, F.lit(v).alias("v"), F.col(c).alias("text_hash"))
    known = side(1, "old").unionByName(side(2, "new")).distinct()
    keys = [*group, "v", "text_hash"]
    narrow = rest.select(*keys, "from_version", "path", "ordinal")
    lone = narrow.join(known, keys, "left_anti")
    old = F.col("v") == 1
    single = lone.select(
        "doc_id", "from_version", "to_version", F.when(old, F.col("path")).alias("old_path"), F.when(~old, F.col("path")).alias("new_path"), F.when(old, F.col("ordinal")).alias("old_ordinal"), F.when(~old, F.col("ordinal")).alias("new_ordinal"),
        F.when(old, "removed").otherwise("added").alias("change_kind"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("string").alias("match_basis"), F.lit(False).alias("needs_review"))
    packed = narrow.join(known, keys, "left_semi").groupBy(*group, "from_version").agg(F.collect_list(F.struct("v", "ordinal", "path", "text_hash")).alias("rows"))
    pairs = alike.groupBy(*group).agg(F.collect_list(F.struct("old", "new", "ratio")).alias("pairs"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g in batch.to_pylist():
                for o, n, ratio in greedy(g["rows"], g["pairs"]):
                    kind = "renumbered" if o and n else "removed" if o else "added"
                    out.append((g["doc_id"], g["from_version"], g["to_version"], o and o["path"], n and n["path"], o and o["ordinal"], n and n["ordinal"], kind, ratio, "similarity" if ratio else None, bool(ratio) and ratio < RENUMBER_CONFIDENT_RATIO))
            columns = list(zip(*out)) or [()] * 11
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in DIFF.split(", ")])

    return packed.join(pairs, group).mapInArrow(choose, DIFF).unionByName(single)


def build_diffs(clauses: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """All diffs of all versions that have a previous one (a first version is a baseline and gives none)."""
    paired = paired_rows(clauses, versions)
    # texts are read again only by the fuzzy stage
    paired = written(paired.withColumn("head", F.when(F.col("basis").isNull(), F.col("head"))), "diff-paired")
    return exact_diffs(paired).unionByName(leftover_diffs(paired.where("basis IS NULL")))


def fan_out(diffs: DataFrame, cells: DataFrame) -> DataFrame:
    """One change event for each diff and claiming cell."""
    return diffs.join(cells, "doc_id")


def kind_counts(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("change_kind").agg(F.count("*").alias("n"), F.count_if("needs_review").alias("to_review"))


def superseded_citations(diffs: DataFrame, citations: DataFrame) -> DataFrame:
    """Citations (version_id, path), which are pinned to a version, that a diff from that version touches, additions apart."""
    touched = diffs.where("change_kind <> 'added'").select(F.col("from_version").alias("version_id"), F.col("old_path").alias("path")).distinct()
    return citations.join(touched, ["version_id", "path"], "left_semi")


def listing(diffs: DataFrame, clauses: DataFrame, cap: int = 4000) -> DataFrame:
    """Both sides' text cut at ``cap`` with a flag, in reading order (the new side's place, else the old one's)."""
    side = lambda version, p: clauses.select(F.col("version_id").alias(version), F.col("path").alias(f"{p}_path"), F.substring("text", 1, cap).alias(f"{p}_text"), (F.length("text") > cap).alias(f"{p}_cut"))
    return diffs.join(side("from_version", "old"), ["from_version", "old_path"], "left").join(side("to_version", "new"), ["to_version", "new_path"], "left").withColumn("reading", F.coalesce("new_ordinal", "old_ordinal"))


def substantive(events: DataFrame) -> DataFrame:
    return events.where(~F.col("change_kind").isin(*NON_SUBSTANTIVE_KINDS))
