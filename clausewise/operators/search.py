"""Retrieval arms, their fusion, and retrieval as a whole.

Arms produce ranked rows per query; a rank limit per query is a window on the query key, which Spark pushes
down as a group limit before the shuffle.  Tokens, names, cells and terms meet by equality of a key, and columns named
in ``by`` (a cell, say) must be equal too, so a query sees its own scope only.  Which side is sent to the executors is the
optimiser's business, by its own size limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import CANDIDATES, EXACT_WEIGHT, IDENTIFIER_BOOST, LEXICAL_WEIGHT, ROW_WEIGHT, RRF_K, TOP_K, VECTOR_WEIGHT
from clausewise.operators import postings
from clausewise.work import written

# How queries name clauses and annex rows, and lengths that keep words apart from endings.
IDENTIFIER = r"제\s*(\d+)\s*(조|항|호|목|장|절|편|관)\s*(의\s*\d+)?"
ANNEX = r"(별표|별지|서식)\s*(\d+(?:의\s*\d+)?)"
SECTION = r"§\s*(\d+(?:\.\d+)*)"
CAS = r"\b\d{2,7}-\d{2}-\d\b"
MIN_TERM, MIN_PREFIX, MIN_STEM = 5, 4, 3


def identifiers(query: Column) -> Column:
    squeeze = lambda xs: F.transform(xs, lambda v: F.regexp_replace(v, r"\s+", ""))
    whole = lambda p: F.regexp_extract_all(query, F.lit(p), F.lit(0))
    return F.array_distinct(F.concat(squeeze(whole(IDENTIFIER)), squeeze(whole(ANNEX)), F.transform(F.regexp_extract_all(query, F.lit(SECTION), F.lit(1)), lambda n: F.concat(F.lit("§ "), n))))



def annex_terms(query: Column) -> Column:
    """CAS numbers, then long tokens, each also without its last one or two syllables if it ends in Hangul."""
    tokens = F.filter(F.split(query, r"[^\p{L}\p{N}_.\-]+"), lambda t: (F.length(t) >= MIN_TERM) & ~t.rlike(r"^\d+$"))
    each = F.flatten(F.transform(tokens, lambda t: F.array(
        t, F.when(t.rlike("[가-힣]$"), F.substring(t, F.lit(1), F.length(t) - 1)), F.when(t.rlike("[가-힣]$") & (F.length(t) > MIN_TERM + 1), F.substring(t, F.lit(1), F.length(t) - 2)))))
    return F.filter(F.array_distinct(F.concat(F.regexp_extract_all(query, F.lit(CAS), F.lit(0)), F.array_compact(each))), lambda t: F.length(t) >= MIN_TERM)


def query_prefixes(query: Column) -> Column:
    """Lower-case tokens to be matched as prefixes, each also without a final Hangul syllable."""
    tokens = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_.\-/§]+"), lambda t: t != "")
    return F.array_distinct(F.array_compact(F.flatten(F.transform(tokens, lambda t: F.array(t, F.when(t.rlike("[가-힣]$") & (F.length(t) > MIN_STEM), F.substring(t, F.lit(1), F.length(t) - 1)))))))


def lexical_arm(clauses: DataFrame, queries: DataFrame, limit: int = CANDIDATES, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, version_id, path, score, rank: cover density of clauses (heading and text, rows of tables apart) for any prefix of a query.

    Since one match covers a query of alternatives, the density is a tenth for each position that a prefix starts.  Clauses meet queries in
    blocks that hand out their best alone, so no pair of clause and query is a row (``postings.Index`` keeps tokens between runs).
    """
    wanted = queries.select("query_id", *by, F.explode(query_prefixes(F.col("query"))).alias("prefix"))
    rows = clauses.where("kind <> 'table_row'").select("version_id", "path", "ordinal", *by, F.array_join(postings.tokens(F.lower(F.concat_ws(" ", "heading", "text"))), " ").alias("words"))
    return postings.density(rows, wanted, limit, by)


def top(scored: DataFrame, order: list[Column], limit: int) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1).where(F.col("rank") < limit)


def first_of(rows: DataFrame, key: list[str], order: list[str], limit: int) -> DataFrame:
    """The first ``limit`` different rows of each key: where rows rank alike for all queries, they are cut before queries meet them."""
    place = F.dense_rank().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place").distinct()


BLOCK_ROWS = 2048


def _blocks(rows: DataFrame, key: str, column: str, blocks: int, name: str) -> DataFrame:
    """Rows in blocks: keys and unit vectors of a block side by side."""
    return rows.select(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias(name)).groupBy(name).agg(F.collect_list(F.struct("k", "v")).alias(f"{name}_rows"))


def _unit(rows: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    flat = rows.values
    m = np.array(flat.field("v").to_pylist(), np.float64)
    return flat.field("k").to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _scored(limit: int):
    """Pairs of blocks in, each query's best vectors of the pair out; a query's own vector is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0), batch.column(1)):
                (ids, a), (asked, b) = _unit(one), _unit(two)
                near = np.round(b @ a.T, 9)
                near[asked[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, near.shape), -near), axis=1)[:, :limit]
                best = np.take_along_axis(near, order, 1)
                keep = np.isfinite(best)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked, order.shape[1])[keep.ravel()]), pa.array(ids[order][keep]), pa.array(best[keep])], names=["query_id", "vec_id", "score"])

    return run


def vector_arm(vectors: DataFrame, queries: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """query_id, vec_id, score, rank by cosine similarity, exactly: every query against every vector but its own, in blocks.

    A block of vectors meets a block of queries in one matrix product, which keeps each query's best ``limit``; what is
    ranked at last is a few rows for each query and block.
    """
    ours, theirs = (max(1, -(-rows.count() // BLOCK_ROWS)) for rows in (vectors, queries))
    left = _blocks(vectors, "vec_id", "embedding", ours, "one").withColumn("two", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(theirs - 1).cast("long"))))
    pairs = left.join(_blocks(queries, "query_id", "q", theirs, "two"), "two").select("one_rows", "two_rows")
    return top(pairs.mapInArrow(_scored(limit), "query_id long, vec_id long, score double"), [F.col("score").desc(), F.col("vec_id")], limit)


#: How rows of one score follow each other, whatever the query.
ORDER = ["ordinal", "version_id", "path"]


def identifier_arm(clauses: DataFrame, queries: DataFrame, limit: int = CANDIDATES, by: tuple[str, ...] = ()) -> DataFrame:
    """Clauses whose path, or a segment of it, is one of the query's ``names``.

    A query's first clauses are among the first of each of its names, so a name's are found once for all queries that say it.
    """
    asked = queries.select("query_id", *by, F.explode("names").alias("name"))
    said = written(asked.select("name", *by).distinct(), "names")
    keys = clauses.select("version_id", "path", "ordinal", *by, F.explode(F.array_distinct(F.concat(F.array("path"), F.split("path", "/")))).alias("name"))
    held = first_of(keys.join(said, ["name", *by], "left_semi"), ["name", *by], ORDER, limit)
    hits = held.join(asked, ["name", *by]).select("query_id", "version_id", "path", "ordinal").distinct()
    return top(hits.withColumn("score", F.lit(1.0)), [F.col(c) for c in ORDER], limit)


def row_arm(rows: DataFrame, terms: DataFrame, limit: int = CANDIDATES, by: tuple[str, ...] = ()) -> DataFrame:
    """query_id, version_id, path, score, rank of table rows (columns): 1.0 where a cell is a term, 0.6 where one starts with the other; the best cell counts.

    A cell shorter than four characters counts only as the longer side.  What a cell says decides its score, so a value's first rows stand for all
    of them, values meet distinct terms, and a term's best rows are found once for all queries that say it.
    """
    cells = rows.select(*ORDER, *by, F.explode(F.map_values("columns")).alias("value")).where("value <> ''")
    held = first_of(cells, ["value", *by], ORDER, limit)
    said = terms.select("query_id", *by, "term").distinct()
    low = lambda c, name: F.lower(c).alias(name)
    lead = lambda c: F.substring(c, 1, MIN_PREFIX).alias("lead")
    values = cells.select("value", *by).distinct().select("*", low("value", "cell")).select("*", lead("cell"))
    words = said.select("term", *by).distinct().select("*", low("term", "low")).select("*", lead("low"))
    hit = F.startswith("cell", "low") | ((F.length("cell") >= MIN_PREFIX) & F.startswith("low", "cell"))
    pairs = values.join(words, ["lead", *by]).where(hit).select("term", "value", *by, F.when(F.col("value") == F.col("term"), 1.0).otherwise(0.6).alias("score"))
    scored = pairs.join(held, ["value", *by]).groupBy("term", *by, *ORDER).agg(F.max("score").alias("score"))
    order = [F.col("score").desc(), *(F.col(c) for c in ORDER)]
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("term", *by).orderBy(*order))).where(F.col("rank") <= limit).drop("rank")
    return top(best.join(said, ["term", *by]).groupBy("query_id", *ORDER).agg(F.max("score").alias("score")), order, limit)


WEIGHTS = {"lexical": LEXICAL_WEIGHT, "vector": VECTOR_WEIGHT, "rows": ROW_WEIGHT, "exact": EXACT_WEIGHT}


def fuse(arms: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, arm, version_id, path, rank, score): exact hits and full row matches are lifted above all.

    A clause that is both is lifted twice.
    """
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[F.col("arm")]
    boost = F.when((F.col("arm") == "exact") | ((F.col("arm") == "rows") & (F.col("score") >= 1)), IDENTIFIER_BOOST).otherwise(0.0)
    fused = arms.groupBy("query_id", "version_id", "path").agg(F.round(F.sum(weight / (RRF_K + F.col("rank") + 1)) + F.sum(boost), 9).alias("score"))
    return top(fused, [F.col("score").desc(), F.col("path"), F.col("version_id")], top_k)


def arms_of(queries: DataFrame, clauses: DataFrame, index: DataFrame, by: tuple[str, ...] = ("cell_id",), limit: int = CANDIDATES) -> DataFrame:
    """Hits of the four arms for queries (query_id, query, q, by) over clauses in scope and an index (vec_id, embedding, version_id, path, by)."""
    asked = queries.select("query_id", "query", *by)
    exact = identifier_arm(clauses, asked.withColumn("names", identifiers(F.col("query"))), limit, by)
    rows = row_arm(clauses.where("kind = 'table_row'"), asked.select("query_id", *by, F.explode(annex_terms(F.col("query"))).alias("term")), limit, by)
    lexical = lexical_arm(clauses, asked, limit, by)
    # the vectors of other cells are no candidates: scored apart for each cell's own block of the index
    near = vector_hits(index, queries, limit, by)
    named = {"exact": exact, "rows": rows, "lexical": lexical, "vector": near}
    columns = ("query_id", "version_id", "path", "rank", "score")
    out = None
    for arm, hits in named.items():
        one = hits.select(*columns[:4], F.col("score").cast("double").alias("score"), F.lit(arm).alias("arm"))
        out = one if out is None else out.unionByName(one)
    return out


def vector_hits(index: DataFrame, queries: DataFrame, limit: int, by: tuple[str, ...]) -> DataFrame:
    """The vector arm in each query's own scope: vectors and queries in blocks of one scope, and the clauses of the best."""
    scope = F.concat_ws("\x01", *by)
    ours, theirs = (max(1, -(-rows.count() // BLOCK_ROWS)) for rows in (index, queries))
    pack = lambda rows, key, column, n, name: rows.select(scope.alias("scope"), F.pmod(F.xxhash64(key), F.lit(n)).alias(name), F.struct(F.col(key).cast("long").alias("k"), F.col(column).cast("array<double>").alias("v")).alias("r")).groupBy("scope", name).agg(F.collect_list("r").alias(f"{name}_rows"))
    pairs = pack(index, "vec_id", "embedding", ours, "one").join(pack(queries, "query_id", "q", theirs, "two"), "scope").select("one_rows", "two_rows")
    best = top(pairs.mapInArrow(_scored(limit), "query_id long, vec_id long, score double"), [F.col("score").desc(), F.col("vec_id")], limit)
    return best.join(index.select(F.col("vec_id").cast("long").alias("vec_id"), "version_id", "path").distinct(), "vec_id")


def retrieved(queries: DataFrame, clauses: DataFrame, index: DataFrame, by: tuple[str, ...] = ("cell_id",), top_k: int = TOP_K) -> DataFrame:
    """query_id, rank, version_id, path, score, kind, effective_date: the fused hits, with what they are."""
    facts = clauses.select("version_id", "path", "kind", "effective_date")
    return fuse(arms_of(queries, clauses, index, by), top_k).join(facts, ["version_id", "path"]).dropDuplicates(["query_id", "version_id", "path"])


def date_scope(hits: DataFrame, today: Column) -> DataFrame:
    """query_id, scope (the latest date in force among the hits, else the next to come), straddles (both kinds occur)."""
    arrived = F.max(F.when(F.col("effective_date") <= today, F.col("effective_date")))
    coming = F.min(F.when(F.col("effective_date") > today, F.col("effective_date")))
    return hits.groupBy("query_id").agg(F.coalesce(arrived, coming).alias("scope"), (arrived.isNotNull() & coming.isNotNull()).alias("straddles"))


def citable(hits: DataFrame, clauses: DataFrame) -> DataFrame:
    """query_id, version_id, path: every hit, and what its passage covers (clauses with their root)."""
    own = hits.select("query_id", "version_id", "path")
    covered = own.withColumnRenamed("path", "root").join(clauses.where("root IS NOT NULL").select("version_id", "root", "path"), ["version_id", "root"]).select("query_id", "version_id", "path")
    return own.unionByName(covered).distinct()


def resolved_clauses(wanted: DataFrame, clauses: DataFrame, versions: DataFrame) -> DataFrame:
    """Cited (version_id, path) with the clause's text and its date, else its version's; what is not found is not returned."""
    dates = versions.select("version_id", F.col("effective_date").alias("version_date"))
    found = wanted.select("version_id", "path").distinct().join(clauses, ["version_id", "path"]).join(dates, "version_id")
    return found.withColumn("effective_date", F.coalesce("effective_date", "version_date")).drop("version_date")
