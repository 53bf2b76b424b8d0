"""Approximate nearest neighbours by multiprobe p-stable hashing, exactly reranked.

A table hashes a direction by ``floor((a . x + b) / w)`` for ``m`` Gaussian (2-stable) vectors a; equal values are a
bucket.  A query visits buckets in the order of the estimated chance that a neighbour lies there: a neighbour at cosine c
projects to a normal variable around c times the query's projection, so each cell of each function has a probability, and the product
over functions ranks the perturbed buckets (the best P products come out of a merge, function by function, exactly).
Candidates of all tables are scored by the exact inner product inside their bucket, a query's best of each bucket are merged.

The fit: ``SAMPLE_QUERIES`` queries are searched exhaustively (one narrow pass over all rows), and for each m the number of
probes is taken at which ``TARGET`` of their true neighbours lie in a visited bucket; of all m the one that costs
least (rows scored, by a sample of ``SAMPLE_ROWS`` rows, and buckets visited) is used.  Every row is indexed, and the probes grow with what the data need:
vectors without structure cost most of the rows, as they do by any hash.

Equal vectors are one entry with its smallest ids, as many as a result can show; equal queries are one search.  A bucket
that many rows or many queries meet is dealt out in chunks of both.  Vectors of different lengths (norms) are
hashed by direction inside bands of an octave, and a query visits all bands.

Edge cases: null, empty and zero vectors, such with a null or non-finite component, and rows without an id take no part.  Repeated rows
are one; different vectors of one id are rows, and queries, of their own.  Vectors with fewer components
are padded with zeros.  Ties go to smaller ids.  No query or no candidate, no row.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import erf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize

TABLES, WIDTH = 2, 2.0
TARGET = 0.97
SAMPLE_QUERIES, SAMPLE_ROWS = 64, 20_000
MAX_FUNCTIONS, MAX_PROBES = 24, 2_048
#: Rows and queries of a block.
CHUNK_ROWS, CHUNK_QUERIES = 4_096, 1_024
#: What a visit of a bucket costs, in scored rows.
VISIT_COST = 100
#: Cells of a function: projections of directions are standard normal, so those beyond five deviations are one cell.
REACH = 5.0
#: Candidates that a task holds to combine them.
HELD_ROWS = 500_000
_SLICE = 128
_cdf = np.vectorize(lambda x: 0.5 * (1 + erf(x / 2**0.5)), otypes=[float])


@dataclass(frozen=True)
class Index:
    """Hash functions and the number of buckets that a query visits in each table."""

    a: np.ndarray  # tables x m x d
    b: np.ndarray  # tables x m
    cosine: float
    probes: int

    @classmethod
    def drawn(cls, m: int, d: int, cosine: float, probes: int, seed: int = 7) -> Index:
        rng = np.random.default_rng([seed, m, d])
        return cls(rng.standard_normal((TABLES, m, d)), rng.uniform(0, WIDTH, (TABLES, m)), cosine, probes)

    @property
    def low(self) -> int:
        return int(np.floor(-REACH / WIDTH))

    @property
    def cells(self) -> int:
        return int(np.floor((REACH + WIDTH) / WIDTH)) - self.low + 1

    def digits(self, x: np.ndarray, table: int) -> np.ndarray:
        """Cells of directions (rows of x), from 0."""
        h = np.floor((x @ self.a[table].T + self.b[table]) / WIDTH).astype(np.int64)
        return np.clip(h - self.low, 0, self.cells - 1)

    def keys(self, digits: np.ndarray) -> np.ndarray:
        out = np.zeros(len(digits), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(digits.shape[1]):
                out = out * np.uint64(self.cells) + digits[:, j].astype(np.uint64)
                if j % 20 == 19:  # beyond 64 bits: fold, so that keys stay well mixed
                    out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return out.view(np.int64)

    def chances(self, q: np.ndarray, table: int) -> np.ndarray:
        """Log chance of each cell of each function (queries x m x cells) for a neighbour at the index's cosine."""
        a, c = self.a[table], self.cosine
        f = q @ a.T
        spread = np.sqrt(np.maximum((1 - c * c) * np.maximum((a * a).sum(1) - f * f, 1e-9) / max(1, q.shape[1] - 1), 1e-12))
        edges = (np.arange(self.cells + 1) + self.low) * WIDTH - self.b[table][:, None]
        edges[:, 0], edges[:, -1] = -np.inf, np.inf
        p = np.diff(_cdf((edges[None] - c * f[:, :, None]) / spread[:, :, None]), axis=2)
        return np.log(np.maximum(p, 1e-30))

    def visited(self, q: np.ndarray, table: int) -> np.ndarray:
        """Keys of the likeliest buckets of each query (queries x probes at most), likeliest first."""
        p = self.chances(q, table)
        n, m, cells = p.shape
        score, path = np.zeros((n, 1)), np.zeros((n, 1, 0), np.int64)
        for j in range(m):
            s = (score[:, :, None] + p[:, j][:, None, :]).reshape(n, -1)
            keep = min(self.probes, s.shape[1])
            best = np.argsort(-s, axis=1, kind="stable")[:, :keep]
            score = np.take_along_axis(s, best, 1)
            path = np.concatenate([np.take_along_axis(path, (best // cells)[:, :, None], 1), (best % cells)[:, :, None]], axis=2)
        return self.keys(path.reshape(-1, m)).reshape(n, -1)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors from their bytes, padded with zeros."""
    cells = column.to_pylist()
    out = np.zeros((len(cells), width))
    for i, x in enumerate(cells):
        v = np.frombuffer(x, np.float64)
        out[i, : v.size] = v
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (row of q): its place, and places and scores of its k best rows, ties to the smaller id.

    Matrix products only choose; the score is one sum for each pair, the same wherever the pair meets.
    """
    for s in range(0, len(q), _SLICE):
        rough = q[s : s + _SLICE] @ x.T
        bound = np.sqrt((q[s : s + _SLICE] ** 2).sum(1)) * np.sqrt((x**2).sum(1).max(initial=0)) * 1e-12
        least = np.partition(rough, -k, axis=1)[:, -k] if x.shape[0] > k else np.full(len(rough), -np.inf)
        i, j = np.nonzero(rough >= (least - bound)[:, None])
        score = (q[s + i] * x[j]).sum(axis=1)
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        starts = np.searchsorted(i, np.arange(len(rough) + 1))
        for r in range(len(rough)):
            span = slice(starts[r], min(starts[r] + k, starts[r + 1]))
            yield s + r, j[span], score[span]


def entries(df: DataFrame, query: str) -> DataFrame:
    """id, asks (is it a query), h1, h2, vec (bytes of doubles), size, band for every row that takes part, each once."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    asks = F.coalesce(F.expr(query), F.lit(False)).alias("asks")
    held = df.select(F.col("vec_id").cast("long").alias("id"), asks, x.alias("x")).where(
        F.col("id").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad) & F.exists("x", lambda c: c != 0.0))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c * c))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            rows = [flat[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary()), batch.column(3), batch.column(4)], names=["id", "asks", "vec", "size", "band"])

    # a band is an octave around a power of two; norms that underflow or overflow stand at the ends
    band = F.round(F.log2(F.greatest(F.least(norm, F.lit(1e300)), F.lit(1e-300)))).cast("int")
    rows = held.select("id", "asks", "x", F.size("x").alias("size"), band.alias("band")).mapInArrow(packed, "id long, asks boolean, vec binary, size int, band int")
    return rows.withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec")).dropDuplicates(["id", "h1", "h2"])


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Equal vectors as one row: h1, h2, rep (smallest id), ids (the k + 1 smallest), vec, size, band."""
    place = Window.partitionBy("h1", "h2").orderBy("id")
    few = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k + 1)
    return few.groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids"), F.max("vec").alias("vec"), F.max("size").alias("size"), F.max("band").alias("band"))


def fit(classes: DataFrame, queries: DataFrame, k: int, width: int, rows: int) -> Index:
    """Functions and probes for these data; see the module."""
    sample = queries.orderBy(F.xxhash64(F.lit(3), "h1"), "h1", "h2").limit(SAMPLE_QUERIES).select("vec").collect()
    few = classes.orderBy(F.xxhash64(F.lit(5), "h1"), "h1", "h2").limit(SAMPLE_ROWS).select("vec")
    if not sample:
        return Index.drawn(1, width, 0.5, 1)
    q = np.stack([np.pad(v := np.frombuffer(r.vec, np.float64), (0, width - v.size)) for r in sample])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, reps = _matrix(batch.column(0), width), batch.column(1).to_numpy()
            found = [(i, j, s) for i, j, s in _best(q, x, reps, k + 1)]
            at = np.concatenate([j for _, j, _ in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat([i for i, _, _ in found], [len(j) for _, j, _ in found]).astype(np.int32)), pa.array(np.concatenate([s for _, _, s in found])), pa.array(reps[at]), batch.column(0).take(pa.array(at))],
                names=["q", "score", "rep", "vec"])

    each = classes.select("vec", "rep").mapInArrow(nearest, "q int, score double, rep long, vec binary")
    top = each.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1).collect()
    unit = _unit(q)
    pairs = [(r.q, np.pad(v := np.frombuffer(r.vec, np.float64), (0, width - v.size))) for r in top]
    pairs = [(i, v) for i, v in pairs if not np.array_equal(v, q[i])]
    if not pairs:
        return Index.drawn(1, width, 0.5, 1)
    of, near = np.array([i for i, _ in pairs]), _unit(np.stack([v for _, v in pairs]))
    cosine = float(np.clip(np.median((unit[of] * near).sum(1)), 0.0, 0.999))
    seen = _unit(_matrix(few.toArrow().column("vec"), width))
    best: tuple[float, Index] | None = None
    for m in range(1, MAX_FUNCTIONS + 1):
        index = Index.drawn(m, width, cosine, MAX_PROBES)
        rank = np.full(len(of), MAX_PROBES)
        keys = []
        for t in range(TABLES):
            visited = index.visited(unit, t)
            hit = visited[of] == index.keys(index.digits(near, t))[:, None]
            rank = np.minimum(rank, np.where(hit.any(1), hit.argmax(1), MAX_PROBES))
            keys.append((visited, index.keys(index.digits(seen, t))))
        probes = int(np.sort(rank)[max(0, int(np.ceil(TARGET * len(rank))) - 1)]) + 1
        if probes > MAX_PROBES:
            break
        scored = 0.0
        for visited, there in keys:
            bucket, n = np.unique(there, return_counts=True)
            at = np.minimum(np.searchsorted(bucket, visited[:, :probes]), len(bucket) - 1)
            scored += float(np.where(bucket[at] == visited[:, :probes], n[at], 0).sum(1).mean()) / len(there)
        cost = scored * rows + VISIT_COST * TABLES * probes
        if best is None or cost < best[0]:
            best = cost, Index(index.a, index.b, cosine, probes)
    return best[1]


def search(df: DataFrame, query: str, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest by inner product among all rows of ``df`` (vec_id, embedding) but its own.

    ``query`` is a condition on vec_id.
    """
    rows = materialize(entries(df, query), "ann-rows")
    asking = rows.where("asks")
    classes = materialize(_classes(rows, k), "ann-classes")
    queries = materialize(asking.groupBy("h1", "h2").agg(F.max("vec").alias("vec")), "ann-queries")
    n, width, bands = classes.agg(F.count("*"), F.max("size"), F.collect_set("band")).first()
    index = fit(classes, queries, k, width or 1, n)
    width = width or 1

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _unit(_matrix(batch.column(0), width))
            for t in range(TABLES):
                keys = index.keys(index.digits(unit, t))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), t, np.int32)), *batch.columns], names=["key", "tab", *batch.schema.names])

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, _SLICE):
                part = batch.slice(s, _SLICE)
                unit = _unit(_matrix(part.column(0), width))
                for t in range(TABLES):
                    keys = index.visited(unit, t)
                    again = pa.array(np.repeat(np.arange(len(unit)), keys.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.full(keys.size, t, np.int32)), *(c.take(again) for c in part.columns)], names=["key", "tab", *part.schema.names])

    bucket = F.xxhash64("key", "tab", "band").alias("bucket")
    there = materialize(classes.select("vec", "ids", "h1", "h2", "band").mapInArrow(hashed, "key long, tab int, vec binary, ids array<long>, h1 long, h2 long, band int").select(bucket, "vec", "ids", "h1", "h2"), "ann-buckets")
    asked = queries.select("vec", F.col("h1").alias("q1"), F.col("h2").alias("q2")).mapInArrow(probing, "key long, tab int, vec binary, q1 long, q2 long").withColumn(
        "band", F.explode(F.array(*map(F.lit, sorted(bands or [0]))).cast("array<int>"))).select(bucket, "vec", "q1", "q2")
    asked = materialize(asked, "ann-probes")
    each = _combined(_met(there, asked, k, width), k)
    # a candidate found in several tables has one score and takes one place
    place = F.dense_rank().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), F.col("ids")[0], "h1", "h2"))
    top = each.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("q1", "q2", "h1", "h2").agg(F.max("score").alias("score"), F.max("ids").alias("ids"))
    same = (F.col("h1") == F.col("q1")) & (F.col("h2") == F.col("q2"))
    ids = top.select("q1", "q2", "score", same.alias("same"), F.explode("ids").alias("vec_id"))
    order = F.row_number().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id", "same"))
    found = ids.withColumn("place", order).where(F.col("place") <= k + 1).groupBy(F.col("q1").alias("h1"), F.col("q2").alias("h2")).agg(
        F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: ~(x["same"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    return asking.select(F.col("id").alias("query_id"), "h1", "h2").join(found, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _met(there: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """q1, q2, and arrays h1, h2, ids, score: the k + 1 best entries of each chunk of a bucket for each query that visits it."""

    def chunks(n: str, size: int) -> Column:
        return F.ceil(F.col(n) / size).cast("int")

    met = materialize(there.groupBy("bucket").agg(F.count("*").alias("n")).join(asked.groupBy("bucket").agg(F.count("*").alias("m")), "bucket"), "ann-met")
    facts = met.select("bucket", chunks("n", CHUNK_ROWS).alias("rc"), chunks("m", CHUNK_QUERIES).alias("qc"), "n", "m")
    left = join_facts(there, facts.drop("m"), "bucket", size="n").select(
        "bucket", "vec", "ids", "h1", "h2", F.pmod(F.xxhash64("h1"), F.col("rc")).cast("int").alias("r"), F.explode(F.sequence(F.lit(0), F.col("qc") - 1)).alias("c"))
    right = join_facts(asked, facts.drop("n"), "bucket", size="m").select(
        "bucket", "vec", "q1", "q2", F.explode(F.sequence(F.lit(0), F.col("rc") - 1)).alias("r"), F.pmod(F.xxhash64("q1"), F.col("qc")).cast("int").alias("c"))
    names = ["q1", "q2", "h1", "h2", "ids", "score"]

    def scored(one: pa.Table, two: pa.Table) -> pa.Table:
        many = pa.list_(pa.int64())
        if not (one.num_rows and two.num_rows):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), many, many, pa.list_(many), pa.list_(pa.float64()))], names=names)
        x, reps = _matrix(one["vec"], width), pc.list_element(one["ids"].combine_chunks(), 0).to_numpy()
        found = list(_best(_matrix(two["vec"], width), x, reps, k + 1))
        at, ends = pa.array(np.concatenate([j for _, j, _ in found])), pa.array(np.cumsum([0, *(len(j) for _, j, _ in found)]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, one[c].combine_chunks().take(at)) for c in ("h1", "h2", "ids")]
        own = two.take(pa.array([i for i, _, _ in found]))
        return pa.table([own["q1"], own["q2"], *lists, pa.ListArray.from_arrays(ends, pa.array(np.concatenate([s for _, _, s in found])))], names=names)

    return left.groupBy("bucket", "r", "c").cogroup(right.groupBy("bucket", "r", "c")).applyInArrow(scored, "q1 long, q2 long, h1 array<long>, h2 array<long>, ids array<array<long>>, score array<double>")


def _combined(near: DataFrame, k: int) -> DataFrame:
    """q1, q2, h1, h2, ids, score: of what a task found for a query in all its buckets the k + 1 best, before anything is shuffled."""
    names = ["q1", "q2", "h1", "h2", "ids", "score"]

    def best(table: pa.Table) -> pa.Table:
        q1, q2, h1, h2, score = (table[c].to_numpy() for c in ("q1", "q2", "h1", "h2", "score"))
        reps = pc.list_element(table["ids"].combine_chunks(), 0).to_numpy()
        order = np.lexsort((h2, h1, reps, -score, q2, q1))
        new = lambda *columns: np.r_[True, np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)]
        order = order[new(q1, q2, h1, h2)]  # a candidate of several tables stands in a row
        starts = np.flatnonzero(new(q1, q2))
        place = np.arange(order.size) - np.repeat(starts, np.diff(np.r_[starts, order.size]))
        return table.take(pa.array(order[place <= k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            of = pc.list_parent_indices(t["score"].combine_chunks())
            flat = {c: t[c].combine_chunks().flatten() for c in ("h1", "h2", "ids", "score")}
            held.append(pa.table({"q1": t["q1"].combine_chunks().take(of), "q2": t["q2"].combine_chunks().take(of), **flat}).select(names))
            n += held[-1].num_rows
            if n > HELD_ROWS:
                held = [best(pa.concat_tables(held))]
                n = held[0].num_rows
                if n > HELD_ROWS // 2:
                    yield from held.pop().to_batches(max_chunksize=10_000)
                    n = 0
        if n:
            yield from best(pa.concat_tables(held)).to_batches(max_chunksize=10_000)

    return near.mapInArrow(run, "q1 long, q2 long, h1 long, h2 long, ids array<long>, score double")
