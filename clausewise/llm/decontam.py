"""Benchmark decontamination by template windows, in DataFrame operations only.

A text becomes tokens (lower-cased runs of letters and digits) and typed placeholders:
a number is ``<n>``, a unit behind a number ``<u>``, a capitalised word inside a sentence ``<p>`` (a name).
Adjacent names, and adjacent numbers (digit groups), are one placeholder.  A line break or colon ends a sentence.
Windows of ``WINDOW`` placeholder tokens of the benchmark (a shorter item is one window) are hashed;
windows of documents join them by hash.  A window counts if it has at least ``LITERALS`` plain words.  Each
document and item then have a list of matching windows, and slots are checked across all of them: a filler of
the item must always meet the same filler in the document, at one alignment of the two texts or at neighbouring
ones together.  So a question asked again with other numbers and names is caught, while texts that share a
phrase by chance, with fillers in conflict, are not.

A second set of windows, of lower-cased words without placeholders, all of which count, stands beside it, so a
verbatim copy depends on no capitals and no number of plain words.  Items of fewer than ``SHORTEST`` words would occur
in running text by chance; a document holds one if a line of it, or all of it, reads the same.

The benchmark's windows do not grow with the corpus; they are measured, and broadcast up to ``BROADCAST_WINDOWS``
rows and ``BROADCAST_BYTES``.  Beyond that hashes alone are shuffled, hot ones dealt out, and texts join what matched.

Edge cases: null and empty texts and items have no windows; repeated items and rows change nothing; ties do not
arise, since every item that matches is named; a text of any length is tokenised in a fixed number of linear passes;
no document, no row, and no item, no match; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize, small_side

WINDOW = 8
LITERALS = 3
SHORTEST = 5
#: Share of an item's windows that must match at one alignment (and one window at least).
SHARE = 0.3
#: Alignments this many tokens apart at most are counted together too.
NEAR = WINDOW - 1
BROADCAST_WINDOWS = 500_000
BROADCAST_BYTES = 64 << 20
SLOT, UNIT = "\x01", "\x02"

# Words that are units when they follow a number.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent pct usd eur dollars euros cents c f k w kw j kj cal kcal v a hz khz mhz ghz b kb mb gb tb meter meters metre metres "
    "kilometer kilometers gram grams kilogram kilograms liter liters litre litres inch inches foot feet mile miles"
).split()


def words(text: Column) -> Column:
    """The text's words with one blank between them; marks that end a sentence stay on their word, and a line break or colon is one."""
    spaced = F.regexp_replace(text, r" *[^\p{L}\p{N}.!?\n: ][^\p{L}\p{N}.!?\n:]*|  +", " ")
    ended = F.regexp_replace(spaced, r"[.!? ]*[\n:][.!?\n: ]*", ". ")
    return F.trim(F.regexp_replace(ended, r"(^| )[.!? ]*[.!?] ?", "$1"))


def marked(spaced: Column) -> Column:
    """``words`` with a mark before names and numbers, and without the marks that end sentences."""
    slots = F.regexp_replace(F.concat(F.lit(" "), spaced), r" (?:(?<=[\p{L}\p{N}] )(?=\p{Lu})|(?=\p{N}[\p{N}.]*(?: |$)))", f" {SLOT}")
    return F.trim(F.regexp_replace(slots, r"[.!?]+(?= |$)", ""))


def fillers(marks: Column) -> Column:
    """``marked`` with adjacent names, and adjacent numbers, as one word each, and a mark before units."""
    merged = F.regexp_replace(marks, rf"({SLOT}(?:\p{{Lu}}[^ ]*(?= {SLOT}\p{{Lu}})|\p{{N}}[^ ]*(?= {SLOT}\p{{N}}))) ", "$1_")
    return F.regexp_replace(merged, rf"({SLOT}\p{{N}}[^ ]* )(?=(?i:{'|'.join(UNITS)})(?![^ ]))", f"$1{UNIT}")


def token(word: Column) -> Column:
    """A word of ``fillers`` as it stands in a template: a placeholder, or the word in lower case."""
    slot = F.when(word.rlike(rf"^{SLOT}\p{{Lu}}"), "<p>").otherwise("<n>")
    return F.when(F.startswith(word, F.lit(SLOT)), slot).when(F.startswith(word, F.lit(UNIT)), "<u>").otherwise(F.lower(word))


def _windows(t: DataFrame, codes: list[int]) -> DataFrame:
    """Rows of ``t`` (doc_id, filled, tokens, plain, n) with at, code and hash: its windows of the codes' widths, at places 0 to n - 1 (shorter
    ones at the end match nothing).  Places are exploded, not hashes, so that windows are hashed in generated code."""
    each = t.withColumn("place", F.explode(F.sequence(F.lit(0), F.col("n") * len(codes) - 1))) if codes else t.where("false").withColumn("place", F.lit(0))
    at, nth = F.col("place") % F.col("n"), (F.col("place") / F.col("n")).cast("int")
    hashes = [F.xxhash64(F.slice("plain" if c % 2 else "tokens", at + 1, c // 2)) for c in codes] or [F.lit(0).cast("long")]
    picked = lambda values: F.coalesce(*(F.when(nth == k, v) for k, v in enumerate(values)))
    return each.select("doc_id", "filled", at.alias("at"), picked([F.lit(c) for c in codes or [0]]).alias("code"), picked(hashes).alias("hash"))


def _marked_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, filled (marked words), low (the same words in lower case, without marks)."""
    marks = rows.select(F.col(key).cast("long").alias(key), marked(words(F.col("text"))).alias("marks"))
    return marks.select(key, fillers(F.col("marks")).alias("filled"), F.lower(F.replace("marks", F.lit(SLOT), F.lit(""))).alias("low"))


def _tokens(rows: DataFrame, key: str) -> DataFrame:
    """key, filled, tokens (of its template), plain (lower-case words)."""
    return _marked_rows(rows, key).select(key, "filled", F.transform(F.split("filled", " "), token).alias("tokens"), F.split("low", " ").alias("plain"))


def _token_hashes(rows: DataFrame, key: str) -> DataFrame:
    """key, filled, tokens and plain as hashes: each token is hashed once, not once for each window it lies in."""
    return _marked_rows(rows, key).select(
        key, "filled", F.transform(F.split("filled", " "), lambda w: F.xxhash64(token(w))).alias("tokens"), F.transform(F.split("low", " "), lambda w: F.xxhash64(w)).alias("plain"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """hash, code (kind and width), item_id, item_at, plain, width, fill (raw words of the window, null where a token is literal), total."""
    t = _tokens(benchmark, "item_id").where(F.size("plain") >= SHORTEST)
    kinds = t.select("item_id", F.lit(False).alias("is_plain"), "tokens", F.split("filled", " ").alias("raw")).unionByName(
        t.select("item_id", F.lit(True).alias("is_plain"), F.col("plain").alias("tokens"), F.col("plain").alias("raw"))).withColumn("width", F.least(F.size("tokens"), F.lit(window)))
    each = kinds.select("item_id", "is_plain", "width", "raw", "tokens", F.explode(F.sequence(F.lit(1), F.size("tokens") - F.col("width") + 1)).alias("item_at"))
    part = each.select("item_id", "is_plain", "item_at", "width", F.slice("tokens", F.col("item_at"), F.col("width")).alias("t"), F.slice("raw", F.col("item_at"), F.col("width")).alias("r"))
    is_slot = lambda x: x.isin("<n>", "<u>", "<p>")
    kept = part.where(F.col("is_plain") | (F.size(F.filter("t", lambda x: ~is_slot(x))) >= F.least(F.lit(literals), F.col("width"))))
    out = kept.select(
        F.xxhash64(F.transform("t", lambda w: F.xxhash64(w))).alias("hash"), (F.col("width") * 2 + F.col("is_plain").cast("int")).alias("code"), "item_id", "item_at", "is_plain", "width",
        F.zip_with("t", "r", lambda t, r: F.when(is_slot(t), r)).alias("fill")).dropDuplicates(["item_id", "item_at", "hash", "is_plain"])
    totals = out.groupBy("item_id", "is_plain").agg(F.countDistinct("item_at").alias("total"))
    return out.join(totals, ["item_id", "is_plain"])


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """doc_id, item_id, n_windows, share, reworded (some slot has another filler): pairs that match at one alignment or at neighbouring ones."""
    known = materialize(benchmark_windows(benchmark, window, literals), "decontam-windows")
    # a row for each of at most 2 * WINDOW codes
    counts = {r["code"]: (r["n"], r["size"]) for r in known.groupBy("code").agg(F.count("*").alias("n"), F.sum(F.lit(64) + 16 * F.size("fill") + F.length(F.array_join("fill", ""))).alias("size")).collect()}
    codes = sorted(counts)
    small = sum(n for n, _ in counts.values()) <= BROADCAST_WINDOWS and sum(size for _, size in counts.values()) <= BROADCAST_BYTES
    t = _token_hashes(docs, "doc_id").withColumn("n", F.size("plain"))
    each = _windows(t, codes)
    if small:
        hits = each.join(F.broadcast(known), ["hash", "code"])
    else:
        at = materialize(each.select("doc_id", F.xxhash64("filled").alias("row"), "at", "code", "hash"), "decontam-hashes")
        wanted = materialize(known.select("hash", "code").distinct().groupBy("hash").agg(F.collect_set("code").alias("codes")), "decontam-wanted")
        met = materialize(join_facts(at, wanted, "hash").where(F.array_contains("codes", F.col("code"))).drop("codes"), "decontam-met")
        texts = t.select("doc_id", "filled", F.xxhash64("filled").alias("row")).dropDuplicates(["doc_id", "row"])
        hits = met.join(known, ["hash", "code"]).join(texts, ["doc_id", "row"])
    found = hits.select(
        "doc_id", "item_id", "is_plain", "item_at", "total", (F.col("at") + 1 - F.col("item_at")).alias("shift"),
        F.when(F.col("is_plain"), F.array().cast("array<struct<i:string,d:string>>")).otherwise(
            F.filter(F.zip_with("fill", F.slice(F.split("filled", " "), F.col("at") + 1, F.col("width")), lambda i, d: F.struct(i.alias("i"), F.when(i.isNotNull(), d).alias("d"))),
                     lambda s: s["i"].isNotNull())).alias("slots"))
    key = ["doc_id", "item_id", "is_plain"]
    aligned = found.groupBy(*key, "shift").agg(
        F.collect_set("item_at").alias("items"), F.first("total").alias("total"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    # alignments a few tokens apart belong together: a filler may have more words, or a word is put in
    order = Window.partitionBy(*key).orderBy("shift")
    far = (F.col("shift") - F.lag("shift").over(order) > NEAR).cast("int")
    near = aligned.withColumn("far", F.coalesce(far, F.lit(0))).withColumn("near", F.sum("far").over(order)).groupBy(*key, "near").agg(
        F.first("total").alias("total"), F.collect_list(F.struct("items", "slots")).alias("each"))
    union = F.struct(F.array_distinct(F.flatten("each.items")).alias("items"), F.array_distinct(F.flatten("each.slots")).alias("slots"))
    tried = near.select(*key, "total", F.explode(F.concat("each", F.array(union))).alias("a")).select(*key, "total", F.size("a.items").alias("n_windows"), F.col("a.slots").alias("slots"))
    pairs = F.array_distinct(F.transform("slots", lambda s: F.struct(F.lower(s["i"]).alias("i"), F.lower(s["d"]).alias("d"))))
    checked = tried.withColumn("pairs", pairs)
    consistent = F.size(F.array_distinct(F.col("pairs.i"))) == F.size("pairs")
    good = checked.where(consistent & (F.col("n_windows") >= F.greatest(F.lit(1), F.ceil(F.col("total") * share))))
    reworded = F.when(~F.col("is_plain") | (F.col("n_windows") == F.col("total")), F.exists("pairs", lambda p: p["i"] != p["d"]))
    out = good.groupBy("doc_id", "item_id").agg(
        F.max("n_windows").alias("n_windows"), F.max(F.round(F.col("n_windows") / F.col("total"), 4)).alias("share"),
        F.coalesce(F.min(reworded), F.lit(False)).alias("reworded"))
    short = small_side(short_items(benchmark), "decontam-short")
    return out if short.isEmpty() else out.unionByName(_whole_lines(docs, short))


def _bare(text: Column) -> Column:
    """Letters and digits in lower case, with single blanks between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def short_items(benchmark: DataFrame) -> DataFrame:
    """line, item_id: the items of one to ``SHORTEST`` - 1 words."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), _bare(F.col("text")).alias("line"))
    return items.where((F.col("line") != "") & (F.size(F.split("line", " ")) < SHORTEST)).distinct()


def _whole_lines(docs: DataFrame, short: DataFrame) -> DataFrame:
    """Matches of short items with whole lines, or the whole text, of a document."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _bare(x))
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.concat(lines, F.array(_bare(F.coalesce("text", F.lit(""))))))).alias("line"))
    return each.where("line <> ''").join(short, "line").select("doc_id", "item_id").distinct().select(
        "doc_id", "item_id", F.lit(1).alias("n_windows"), F.lit(1.0).cast("double").alias("share"), F.lit(False).alias("reworded"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (sorted, comma-joined), reworded, for every row of ``docs``."""
    by_doc = matches(docs, benchmark, **settings).groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"), F.array_join(F.sort_array(F.collect_set("item_id")), ",").alias("item_ids"), F.max("reworded").alias("reworded"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(by_doc, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("reworded", F.lit(False)).alias("reworded"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    gone = small_side(matches(docs, benchmark, **settings).select(F.col("doc_id").alias("__doc")).distinct(), "decontam-gone")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left_anti")
