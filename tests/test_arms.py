"""Arms of retrieval where many queries ask for what many rows have: same results, and no row for each pair."""

import pytest
from pyspark.sql import functions as F

from clausewise.operators import search

QUERIES, CLAUSES, LIMIT = 300, 2000, 40


def most_rows(df):
    """The most rows that a node of the executed plan gave out."""
    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        metric = node.metrics().get("numOutputRows")
        own = metric.get().value() if metric.isDefined() else 0
        below = node.children()
        return max([own, *(walk(below.apply(k)) for k in range(below.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def ranked(rows):
    return sorted((r.query_id, r["rank"], r.version_id, r.path) for r in rows)


@pytest.fixture(scope="module")
def clauses(spark):
    k = F.col("id")
    return spark.range(CLAUSES).select(
        k.alias("version_id"), F.concat(F.lit("A1/I"), (k % 3).cast("string")).alias("path"), (k * 7 % 50).cast("int").alias("ordinal"), F.lit("prose").alias("kind"), F.lit("").alias("heading"),
        F.concat(F.lit("the same "), F.when(k % 5 == 0, "same ").otherwise(""), k.cast("string")).alias("text"), F.create_map(F.lit("a"), F.concat(F.lit("steel "), (k % 2).cast("string")), F.lit("b"), F.lit("STEEL 1")).alias("columns")).cache()


def wanted(clauses, score):
    """The first rows of every query, which all ask the same: by score, then in order."""
    rows = sorted((-score(r), r.ordinal, r.version_id, r.path) for r in clauses.collect() if score(r))[:LIMIT]
    return sorted((q, n, v, p) for q in range(QUERIES) for n, (_, _, v, p) in enumerate(rows))


def test_names_that_many_queries_share_are_found_once(spark, clauses):
    queries = spark.range(QUERIES).select(F.col("id").alias("query_id"), F.array(F.lit("A1"), F.lit("A1/I2")).alias("names"))
    df = search.identifier_arm(clauses, queries, LIMIT)
    assert ranked(df.collect()) == wanted(clauses, lambda r: 1) and most_rows(df) < 50_000


def test_terms_that_many_queries_share_are_found_once(spark, clauses):
    terms = spark.range(QUERIES).select(F.col("id").alias("query_id"), F.explode(F.array(F.lit("steel 1"), F.lit("STEE"))).alias("term"))
    df = search.row_arm(clauses, terms, LIMIT)
    assert ranked(df.collect()) == wanted(clauses, lambda r: 1.0 if r.columns["a"] == "steel 1" else 0.6) and most_rows(df) < 50_000


def test_words_that_many_queries_share_give_no_row_for_a_pair(spark, clauses):
    queries = spark.range(QUERIES).select(F.col("id").alias("query_id"), F.lit("sam the 5").alias("query"))
    df = search.lexical_arm(clauses, queries, LIMIT)
    assert ranked(df.collect()) == wanted(clauses, lambda r: sum(t.startswith(("sam", "the", "5")) for t in r.text.split())) and most_rows(df) < 50_000
