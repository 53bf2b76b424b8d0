"""Hard negatives by distributed radix selection over integer scores.

Vectors become integers (``floor(256 * x)``), so a score is an integer inner product and its digits can be counted.
Anchors meet all rows in blocks (a block of anchors and a block of rows are one group, scored as a matrix product).
For every window of an anchor (all scores for its positives; the stretch below a positive's score for its negatives) a
pass counts the leading digit of the distance from the window's top; a block reports the digits down to the one where
it has k rows itself.  The summed histogram locates the digit that holds the kth row; the next pass counts inside it, until the kth
score is known.  Only then rows are gathered: those above the kth score, and of those at it the smallest ids.

No row is emitted to be sorted away, a window's state is five numbers, and a group of equal scores of any size gives k rows
for each block at most.  Neither anchors nor rows are sent whole to a task or to the driver.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part.  Exact repetitions of a
row are one row; different rows of one id are rows of their own, but no partners of each other.  A shorter vector counts as padded
with zeros; an empty one scores 0.  Integers beyond +-2**24 count as that (scores stay exact).  An anchor with fewer
partners than k gets all; a negative positive score gives an empty window.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialize

BLOCK_ROWS, BLOCK_ANCHORS = 4096, 2048
DIGIT_BITS = 10
LARGEST = 1 << 24
#: Anchors that are scored against a block of rows at a time.
_SLICE = 256
#: An open window: rows from lo to hi, of which ``need`` are wanted; ``top`` is where it began.
_WINDOW = ["wid", "top", "lo", "hi", "need"]


def integer_rows(df: DataFrame, anchor: str) -> DataFrame:
    """key, id, label, v (array of int), anchor: the rows that take part, each once."""
    whole_number = dict(df.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    code = F.col("label").cast("long") if whole_number else F.xxhash64("label")
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    whole = lambda c: F.least(F.greatest(F.floor(c.cast("double") * 256), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int")
    return (
        df.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad)
        .select(F.col("vec_id").cast("long").alias("id"), code.alias("label"), F.transform(x, whole).alias("v"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor"))
        .withColumn("key", F.xxhash64("id", "label", "v")).dropDuplicates(["key", "id", "label"]))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as float64, padded with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (size == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


def _scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point while every sum stays under 2**53, else in long integers."""
    bound = np.abs(anchors).max(initial=0) * np.abs(rows).max(initial=0) * max(1, rows.shape[1])
    if bound < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)
    return anchors.astype(np.int64) @ rows.astype(np.int64).T


def _found(anchors: pa.Table, rows: pa.Table, width: int, same: bool):
    """For slices of anchors and each window place: (first anchor, window struct columns, anchor and row indices, scores) inside the windows."""
    r, rid, rlabel = _matrix(rows["v"], width), rows["id"].to_numpy(), rows["label"].to_numpy()
    q, aid, alabel = _matrix(anchors["v"], width), anchors["id"].to_numpy(), anchors["label"].to_numpy()
    lists = anchors["windows"].combine_chunks()
    starts, flat = lists.offsets.to_numpy(), lists.flatten()
    cols = {c: flat.field(c).to_numpy(zero_copy_only=False) for c in _WINDOW}
    at = starts - starts[0]
    size = np.diff(at)
    for s in range(0, len(q), _SLICE):
        e = min(s + _SLICE, len(q))
        scores = _scores(q[s:e], r)
        fits = ((rlabel[None, :] == alabel[s:e, None]) == same) & (rid[None, :] != aid[s:e, None])
        for j in range(int(size[s:e].max(initial=0))):
            has = np.flatnonzero(size[s:e] > j)
            w = at[s + has] + j
            i, c = np.nonzero(fits[has] & (scores[has] >= cols["lo"][w, None]) & (scores[has] <= cols["hi"][w, None]))
            yield s + has[i], {k: v[w[i]] for k, v in cols.items()}, c, scores[has[i], c]


def _shift(lo: np.ndarray, hi: np.ndarray, digit_bits: int) -> np.ndarray:
    """Bits below the digit that is counted now."""
    return np.maximum(0, np.searchsorted(1 << np.arange(62), hi - lo, side="right") - digit_bits)


def _counts(width: int, same: bool, digit_bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """akey, wid, digit, n: each window's histogram in this block, down to the digit where the block alone has enough."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], []]
        if rows.num_rows and anchors.num_rows:
            akey = anchors["key"].to_numpy()
            for i, w, _, score in _found(anchors, rows, width, same):
                digit = (w["hi"] - score) >> _shift(w["lo"], w["hi"], digit_bits)
                order = np.lexsort((digit, i))
                i, digit, wid, need = i[order], digit[order], w["wid"][order], w["need"][order]
                first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (digit[1:] != digit[:-1])]) if i.size else np.zeros(0, int)
                n = np.diff(np.r_[first, i.size])
                begin = np.searchsorted(i, i[first])
                keep = first - begin < need[first]
                for held, x in zip(out, (akey[i[first]], wid[first], digit[first], n), strict=True):
                    held.append(x[keep])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(("akey", "wid", "digit", "n"), out, strict=True)})

    return run


def _gathered(width: int, same: bool, _: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """akey, wid, key, id, score: rows above the kth score, and the smallest ids at it."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        if rows.num_rows and anchors.num_rows:
            akey, rkey, rid = anchors["key"].to_numpy(), rows["key"].to_numpy(), rows["id"].to_numpy()
            for i, w, c, score in _found(anchors, rows, width, same):
                order = np.lexsort((rid[c], -score, i))
                i, c, score, wid, lo, need = i[order], c[order], score[order], w["wid"][order], w["lo"][order], w["need"][order]
                tie = score == lo
                # the place of a tie among its window's ties: they stand behind all that is above
                above = np.r_[0, np.cumsum(~tie)]
                begin = np.searchsorted(i, i)
                place = np.arange(i.size) - begin - (above[:-1] - above[begin]) if i.size else np.zeros(0, int)
                keep = ~tie | (place < need)
                for held, x in zip(out, (akey[i], wid, rkey[c], rid[c], score), strict=True):
                    held.append(x[keep])
        return pa.table({c: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for c, x in zip(("akey", "wid", "key", "id", "score"), out, strict=True)})

    return run


class _Blocks:
    """Rows and anchors as written tables, dealt in blocks."""

    def __init__(self, rows: DataFrame):
        self.rows = materialize(rows, "hn-rows")
        self.anchors = materialize(self.rows.where("anchor"), "hn-anchors")
        n, m, self.width, most = self.rows.agg(
            F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("v")), F.lit(0)),
            F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0))).first()
        #: no score is larger: a row's largest component, squared, in each place
        self.bound = int(self.width) * int(most or 0) ** 2
        self.n_rows, self.n_anchors = -(-n // BLOCK_ROWS) or 1, -(-m // BLOCK_ANCHORS) or 1

    def _part(self, n: int, seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n)).cast("int")

    def meet(self, windows: DataFrame, what: Callable, same: bool, schema: str) -> DataFrame:
        """``what`` on every block of anchors that have windows and every block of rows."""
        held = windows.groupBy("akey").agg(F.collect_list(F.struct(*_WINDOW)).alias("windows"))
        anchors = self.anchors.join(held.withColumnRenamed("akey", "key"), "key").select(
            "key", "id", "label", "v", "windows", self._part(self.n_anchors, 1).alias("a"), F.explode(F.sequence(F.lit(0), F.lit(self.n_rows - 1))).alias("r"))
        rows = self.rows.select(
            "key", "id", "label", "v", self._part(self.n_rows, 2).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(self.n_anchors - 1))).alias("a"))
        return rows.groupBy("a", "r").cogroup(anchors.groupBy("a", "r")).applyInArrow(what(self.width, same, DIGIT_BITS), schema)


def kth_scores(blocks: _Blocks, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """akey, wid, top, lo, need: the kth score (lo) of each window (akey, wid, lo, hi) and how many rows at it are wanted; the
    window's own low end where it holds fewer than k rows."""
    state = materialize(windows.select("akey", "wid", F.col("hi").alias("top"), "lo", "hi", F.lit(k).cast("long").alias("need")), "hn-windows")
    within = Window.partitionBy("akey", "wid").orderBy("digit")
    while state.where("lo < hi").limit(1).count():
        open_ = state.where("lo < hi")
        counts = blocks.meet(open_, _counts, same, "akey long, wid long, digit long, n long").groupBy("akey", "wid", "digit").agg(F.sum("n").alias("n"))
        reached = counts.withColumn("upto", F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        span = open_.join(reached, ["akey", "wid"]).where("upto >= need AND upto - n < need")
        # the digit's width, as the blocks take it: bits of the span less the digit's
        bits = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.length(F.bin(F.col("hi") - F.col("lo"))))
        step = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(bits - DIGIT_BITS, F.lit(0)).cast("int"))
        inner = span.withColumn("hi2", F.col("hi") - F.col("digit") * step).select(
            "akey", "wid", F.greatest("lo", F.col("hi2") - step + 1).alias("lo2"), "hi2", (F.col("need") - F.col("upto") + F.col("n")).alias("need2"))
        # a window with fewer rows than wanted is done: all of it qualifies
        moved = open_.join(inner, ["akey", "wid"], "left").select(
            "akey", "wid", "top", F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "lo").alias("hi"), F.coalesce("need2", "need").alias("need"))
        state = materialize(state.where("lo >= hi").unionByName(moved), "hn-windows")
    return state.where("lo <= top").select("akey", "wid", "top", "lo", "need")


def select_top(blocks: _Blocks, windows: DataFrame, k: int, same: bool) -> DataFrame:
    """akey, wid, key, id, score, rank: the k best rows inside each window, higher scores first, then smaller ids."""
    final = kth_scores(blocks, windows, k, same).withColumn("hi", F.col("top"))
    rows = blocks.meet(final, _gathered, same, "akey long, wid long, key long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("akey", "wid").orderBy(F.desc("score"), "id", "key"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(df: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``df`` has vec_id, embedding and label; ``anchor`` is a condition on vec_id.  An anchor's positives are its best rows of the same
    label; the negatives of each are the best of other labels that score from ``share`` of the positive's score up to it.
    """
    blocks = _Blocks(integer_rows(df, anchor))
    whole = blocks.anchors.select(F.col("key").alias("akey"), F.lit(0).cast("long").alias("wid"), F.lit(-blocks.bound).alias("lo"), F.lit(blocks.bound).alias("hi"))
    best = materialize(select_top(blocks, whole, positives, True).select("akey", F.col("key").alias("wid"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "hn-positives")
    low, of = share
    # the smallest score whose share is reached, in whole numbers
    least = F.expr(f"positive_score div {of} * {low} + (positive_score % {of} * {low} + {of - 1}) div {of}")
    window = best.where("positive_score >= 0").select("akey", "wid", least.alias("lo"), F.col("positive_score").alias("hi")).where("lo <= hi")
    found = select_top(blocks, window, negatives, False)
    names = blocks.anchors.select(F.col("key").alias("akey"), F.col("id").alias("anchor_id"))
    return found.join(best, ["akey", "wid"]).join(names, "akey").select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
