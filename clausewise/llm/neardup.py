"""Near-duplicate documents by HyperMinHash sketches, exactly confirmed.

1. One pass over the texts makes each document's set of word shingles (64-bit hashes) and its sketch:
   the hashes fall into ``REGISTERS`` buckets, and a bucket stores the leading-zero count of its smallest
   value and ten bits behind the leading one.  Empty buckets borrow from the next filled one.  Documents
   with the same set (by 128 bits and its size) are one class from here on (a group of copies of any size is one row).
2. Banding: ``BANDS`` runs of ``ROWS`` compressed registers are keys.  Keys held by one class are dropped.
   Inside a key, pairs are judged by their sketches within the task: sizes that cannot reach the threshold
   and estimates (corrected for chance collisions of the stored codes) well under it fall out.  Keys of up
   to ``SMALL`` classes give all pairs that pass; larger ones are dealt in chunks, and each member gives its
   best partner only.
3. Each class's best pair is confirmed on the full sets; confirmed pairs are contracted to components.
4. What remains is exact: pairs of small keys, and of large keys whose members still lie in different
   components (chunk against chunk), are judged by their sketches; full sets are fetched for those that have a
   passing partner in another component, are confirmed too, and components found anew.

So no key's pairs are all emitted, no link between different texts is skipped for the size of its group,
and a threshold pair is missed only if no band agrees (1e-6 at 0.8, 3e-9 at 0.85) or its estimate is 5.5
deviations low.  Sets are compared as 48-bit hashes.  Keys, classes and components that many rows share are joined
without gathering these rows.

Edge cases: null, empty and blank texts have the empty set and stand alone; texts of fewer words than a
shingle have one shingle, the whole sequence; repeated rows give repeated result rows; two rows of one
doc_id and different texts are two documents with one name; ties of partners go to the larger class; a text of any
length is hashed in one piece, in linear time; no document, no row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize, small_side
from clausewise.llm.components import connected_components
from clausewise.llm.shingles import mix, shingle_sets

REGISTERS = 256
ROWS, BANDS = 6, 42
CODES = 256
SMALL = 16
CHUNK = 1024
#: Rows of keys or blocks in a task, on average.
PART_ROWS = 20_000
#: An estimate may be this many standard deviations low; small sets fill fewer buckets and deviate more.
DEVIATIONS = 5.5
#: Independent codes per shingle of a small set, since borrowed codes count some of them often: half as many as shingles.
FILLED = 0.5
#: Ids sent to every executor at most; beyond it the join shuffles.
BROADCAST_IDS = 250_000
_BLOCK = 1 << 20


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, a row for each set: (leading zeros + 1) * 1024 + ten mantissa bits; 0 where the set is empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    every = np.arange(REGISTERS)
    for i, s in enumerate(sets):
        if not s.size:
            continue
        key = np.sort(s << np.uint64(56) | s >> np.uint64(8))
        bucket = (key >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        value = (key[first] & np.uint64((1 << 56) - 1)).astype(np.float64)
        part, exponent = np.frexp(value)
        code = np.where(value > 0, (57 - exponent) * 1024 + ((part * 2 - 1) * 1024).astype(np.int64), 58 * 1024)
        near = np.searchsorted(bucket[first], every)
        near[near == first.size] = 0
        out[i] = code[near]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    key = np.zeros((len(registers), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers[:, r : ROWS * BANDS : ROWS].astype(np.uint64))
    return key


def codes(registers: np.ndarray) -> np.ndarray:
    """One byte for each register."""
    return (mix(registers[:, :CODES].astype(np.uint64)) & np.uint64(255)).astype(np.uint8)


def estimate(same: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of equal codes; one in 256 different registers has the same code."""
    return np.clip((same / CODES - 1 / 256) / (1 - 1 / 256), 0, 1)


def _texts(column: pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def _blocks(texts: list[bytes]) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two 64-bit hashes of each set."""
    one = [int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5)))) ^ int(s.sum(dtype=np.uint64)) if s.size else 0 for s in sets]
    two = [int(mix(s + np.uint64(0x5DEECE66D)).sum(dtype=np.uint64)) if s.size else 0 for s in sets]
    return [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n (set size), h1, h2 (hashes of the set), bands, codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for block in _blocks(_texts(batch.column(1))):
                sets = shingle_sets(block, words)
                regs = sketch(sets)
                n = np.array([s.size for s in sets], np.int64)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(regs).reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(block)), pa.array(n), *_set_hashes(sets), keys, pa.array([c.tobytes() for c in codes(regs)], pa.binary())],
                    names=["doc_id", "n", "h1", "h2", "bands", "codes"])
                at += len(block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n long, h1 long, h2 long, bands array<long>, codes binary")


def _passing(same: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    low, high = np.minimum(n, m), np.maximum(n, m)
    margin = DEVIATIONS * np.sqrt(threshold * (1 - threshold) / np.minimum(CODES, FILLED * low))
    return (low >= threshold * high - 1e-6) & (estimate(same) >= threshold - margin)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Whole groups (rows sorted by the columns ``names``) of a sorted stream, many at a time."""
    rest: pa.Table | None = None

    def arrays(t: pa.Table) -> dict[str, np.ndarray]:
        out = {c: t.column(c).to_numpy() for c in t.column_names if c not in ("codes", "members")}
        if "members" in t.column_names:
            out["members"] = np.array([*t.column("members").to_pylist(), None], dtype=object)[:-1]
        out["codes"] = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(-1, CODES)
        out["group"] = np.cumsum(np.r_[0, np.any([out[c][1:] != out[c][:-1] for c in names], axis=0)]) if t.num_rows else np.zeros(0, int)
        return out

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        got = [table.column(c).to_numpy() for c in names]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in got], axis=0))
        cut = int(change[-1]) + 1 if change.size else 0
        if cut:
            yield arrays(table.slice(0, cut))
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield arrays(rest)


def _near_in_keys(threshold: float):
    """Pairs of each key: all that pass in small keys, each member's best partner in a chunk of a large one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["key", "chunk"]):
            group, n, c, cls = rows["group"], rows["n"], rows["codes"], rows["cls"]
            size = np.bincount(group)[group]
            left, right, est = [], [], []
            for d in range(1, min(int(size.max()), SMALL)):
                i = np.flatnonzero((group[:-d] == group[d:]) & (size[:-d] <= SMALL))
                if not i.size:
                    continue
                same = (c[i] == c[i + d]).sum(axis=1)
                ok = _passing(same, n[i], n[i + d], threshold)
                left.append(i[ok])
                right.append(i[ok] + d)
                est.append(estimate(same[ok]))
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            for s in starts[size[starts] > SMALL]:
                a, b, e = _forest(n[s : s + size[s]], c[s : s + size[s]], threshold)
                left.append(a + s)
                right.append(b + s)
                est.append(e)
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                yield pa.RecordBatch.from_arrays([pa.array(cls[a]), pa.array(cls[b]), pa.array(np.concatenate(est))], names=["a", "b", "est"])

    return run


def _forest(n: np.ndarray, c: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strongest spanning forest of the passing pairs: (member of the tree, new member, estimate), in order of growth."""
    size = len(n)
    best, by, open_ = np.full(size, -1.0), np.zeros(size, np.int64), np.ones(size, bool)
    a, b, e = [], [], []
    for _ in range(size):
        now = int(np.argmax(np.where(open_, best, -2.0)))
        if best[now] >= 0:
            a.append(by[now])
            b.append(now)
            e.append(best[now])
        open_[now] = False
        same = (c == c[now]).sum(axis=1)
        got = np.where(_passing(same, n, n[now], threshold), estimate(same), -1.0)
        better = open_ & (got > best)
        best[better], by[better] = got[better], now
    return np.array(a, np.int64), np.array(b, np.int64), np.array(e, np.float64)


def _with_partners(threshold: float):
    """The rows of a block that have a partner of passing sketch in the other chunk and in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["cluster", "one", "two"]):
            keep = np.zeros(len(rows["group"]), bool)
            starts = np.flatnonzero(np.r_[True, rows["group"][1:] != rows["group"][:-1]])
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(keep)]):
                part = {k: v[s:e] for k, v in rows.items()}
                if (part["component"] == part["component"][0]).all():
                    continue
                mine, other = np.flatnonzero(part["chunk"] == part["one"]), np.flatnonzero(part["chunk"] == part["two"])
                for i in mine.tolist():
                    k = other[part["component"][other] != part["component"][i]]
                    k = k[_passing((part["codes"][k] == part["codes"][i]).sum(axis=1), part["n"][k], part["n"][i], threshold)]
                    if k.size:
                        keep[s + i] = True
                        keep[s + k] = True
            at = np.flatnonzero(keep)
            if at.size:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(rows[c][at]) for c in ("cluster", "one", "two", "chunk", "cls", "n", "component")), pa.array([c.tobytes() for c in rows["codes"][at]], pa.binary())],
                    names=["cluster", "one", "two", "chunk", "cls", "n", "component", "codes"])

    return run


def _across(threshold: float):
    """Of two chunks of a cluster: confirmed links that join components which nothing has joined yet.

    Sketches pick the pairs to look at, full sets decide, and a pair whose sides are joined by then is passed
    over, so a block returns fewer links than it has components.
    """
    percent = round(threshold * 100)

    def links(part: dict[str, np.ndarray]) -> tuple[list[int], list[int]]:
        label = {x: x for x in part["component"].tolist()}

        def top(x: int) -> int:
            while label[x] != x:
                label[x] = label[label[x]]
                x = label[x]
            return x

        left, right = [], []
        mine, other = np.flatnonzero(part["chunk"] == part["one"]), np.flatnonzero(part["chunk"] == part["two"])
        sets = [None] * len(part["cls"])

        def full(i: int) -> np.ndarray:
            if sets[i] is None:
                sets[i] = _unpack(part["members"][i])
            return sets[i]

        for i in mine:
            k = other[(part["component"][other] != part["component"][i]) & ((part["chunk"][other] != part["chunk"][i]) | (other > i))]
            same = (part["codes"][k] == part["codes"][i]).sum(axis=1)
            ok = _passing(same, part["n"][k], part["n"][i], threshold)
            k = k[ok][np.argsort(-same[ok], kind="stable")]
            for j in k.tolist():
                x, y = top(int(part["component"][i])), top(int(part["component"][j]))
                if x != y and _reaches(full(i), full(j), percent):
                    label[x] = y
                    left.append(int(part["cls"][i]))
                    right.append(int(part["cls"][j]))
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, ["cluster", "one", "two"]):
            starts = np.flatnonzero(np.r_[True, rows["group"][1:] != rows["group"][:-1]])
            for s, e in zip(starts, np.r_[starts[1:], len(rows["group"])]):
                a, b = links({k: v[s:e] for k, v in rows.items()})
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _reaches(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, both sets sorted."""
    if one.size > two.size:
        one, two = two, one
    at = np.searchsorted(two, one)
    both = int((two[np.minimum(at, two.size - 1)] == one).sum())
    return 100 * both >= percent * (one.size + two.size - both)


def _confirm(threshold: float):
    """Pairs whose full sets reach the threshold (whole percents are compared as integers)."""
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_reaches(_unpack(x.as_buffer()), _unpack(y.as_buffer()), percent) for x, y in zip(batch.column(2), batch.column(3))]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def _pack(s: np.ndarray) -> bytes:
    low = np.unique(s & np.uint64((1 << 48) - 1))
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    part = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    whole = np.zeros((len(part), 8), np.uint8)
    whole[:, :6] = part
    return whole.view("<u8").reshape(-1)


def _full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, members: the packed full sets of the classes in ``wanted`` (cls, doc_id, h1, h2, n)."""
    names = wanted.select("doc_id").distinct()
    if names.count() <= BROADCAST_IDS:
        names = F.broadcast(names)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).join(names, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(_texts(batch.column(0))):
                sets = shingle_sets(block, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.size for s in sets], pa.int64()), *_set_hashes(sets), pa.array([_pack(s) for s in sets], pa.binary())], names=["n", "h1", "h2", "members"])

    packed = texts.select("text").mapInArrow(run, "n long, h1 long, h2 long, members binary")
    return packed.join(wanted.select("cls", "n", "h1", "h2"), ["n", "h1", "h2"]).select("cls", "members").dropDuplicates(["cls"])


def _links(pairs: DataFrame, sets: DataFrame, threshold: float, label: str) -> DataFrame:
    one = sets.select(F.col("cls").alias("a"), F.col("members").alias("x"))
    two = sets.select(F.col("cls").alias("b"), F.col("members").alias("y"))
    joined = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return materialize(joined.mapInArrow(_confirm(threshold), "a long, b long"), label)


def _dealt(rows: DataFrame, total: int, *keys: str) -> DataFrame:
    """``rows`` partitioned by ``keys``, into as many parts as the session shuffles into or more where rows are many, sorted inside."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // PART_ROWS)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys)


def _classes(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(marked, classes) with cls, a long for each set: its first hash, or both where sets meet in the first."""
    same = ["h1", "h2", "n"]
    sets = materialize(marked.where("n > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("codes").alias("codes")), "nd-classes")
    clashes = small_side(sets.groupBy("h1").agg(F.count("*").alias("sets")).where("sets > 1"), "nd-clashes")
    if clashes.isEmpty():
        return marked.withColumn("cls", F.col("h1")), sets.withColumn("cls", F.col("h1"))
    cls = F.when(F.col("sets").isNull(), F.col("h1")).otherwise(F.xxhash64(*same)).alias("cls")
    return tuple(x.join(clashes, "h1", "left").select(*x.columns, cls) for x in (marked, sets))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    marked, classes = _classes(materialize(sketches(docs, words), "nd-sketches"))
    keyed = classes.select("cls", F.explode("bands").alias("key"))
    shared = materialize(keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumn("rows", F.col("size")), "nd-keys")
    members = materialize(
        join_facts(keyed, shared, "key", size="rows").select("key", "cls", "size", F.when(F.col("size") <= CHUNK, 0).otherwise(
            F.pmod(F.xxhash64("cls", "key"), F.ceil(F.col("size") / CHUNK))).cast("long").alias("chunk")), "nd-members")
    facts = classes.select("cls", "n", "codes")
    dealt = _dealt(members.join(facts, "cls").select("key", "chunk", "cls", "n", "codes"), members.count(), "key", "chunk")
    pairs = materialize(dealt.mapInArrow(_near_in_keys(threshold), "a long, b long, est double").dropDuplicates(["a", "b"]), "nd-pairs")
    best = pairs.groupBy(F.col("b").alias("x")).agg(F.max_by("a", F.struct("est", "a")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    # clusters: what passing pairs hold together, and all chunks of a large key
    bridges = members.where(f"size > {CHUNK}").groupBy("key", "chunk").agg(F.min("cls").alias("b"))
    bridges = bridges.join(bridges.groupBy("key").agg(F.min("b").alias("a")), "key").select("a", "b")
    clusters = materialize(connected_components(pairs.select("a", "b").unionByName(bridges)).select(F.col("node").alias("cls"), F.col("component").alias("cluster")), "nd-clusters")
    sets = materialize(_full_sets(docs, classes.join(clusters, "cls").select("cls", "doc_id", "h1", "h2", "n"), words), "nd-sets")
    sure = _links(best, sets, threshold, "nd-links")
    parts = connected_components(sure)

    # clusters of several components: chunk against chunk, on sketches and then on full sets
    placed = materialize(clusters.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").select("cls", "cluster", F.coalesce("component", "cls").alias("component")), "nd-placed")
    mixed = materialize(placed.groupBy("cluster").agg(F.count("*").alias("size"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select(
        "cluster", F.ceil(F.col("size") / CHUNK).cast("long").alias("chunks"), "size"), "nd-mixed")
    still = join_facts(placed, mixed, "cluster", size="size").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")))
    blocks = materialize(
        still.join(facts, "cls").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select("cluster", F.least("chunk", "other").alias("one"), F.greatest("chunk", "other").alias("two"), "chunk", "cls", "n", "component", "codes"), "nd-blocks")
    block = ("cluster", "one", "two")
    found = materialize(_dealt(blocks, blocks.count(), *block).mapInArrow(_with_partners(threshold), blocks.schema), "nd-partners")
    across = _dealt(found.join(sets, "cls").select(*found.columns, "members"), found.count(), *block)
    more = materialize(across.mapInArrow(_across(threshold), "a long, b long"), "nd-links")
    parts = materialize(connected_components(sure.unionByName(more)).select(F.col("node").alias("cls"), "component"), "nd-components")

    ours = marked.select("doc_id", "n", "cls")
    named = materialize(join_facts(ours, parts, "cls", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "cls")).alias("label")), "nd-named")
    first = materialize(named.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")).where("rows > 1"), "nd-first")
    out = join_facts(named, first, "label", "left", size="rows").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component; repeated rows stay repeated."""
    gone = small_side(near_duplicates(docs, words, threshold).where("NOT kept").select(F.col("doc_id").alias("__doc")).distinct(), "nd-gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left_anti").select(docs.columns)
