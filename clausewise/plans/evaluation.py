"""Queries of evaluation: scores, gates, agreement, retention and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.adapt import ref_date, sql
from clausewise.constants import AXES, GATES
from clausewise.operators import evaluation as e
from clausewise.plans.texts import _FILING, _filing

#: Golden items: documents by axis; observed answers by place.
_GOLD = f"gold AS (SELECT doc_id AS item_id, {list(AXES)}[doc_id % 6 + 1] AS axis, doc_id % 6 <> 5 AS should_answer, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'needs_review' WHEN 2 THEN 'needs_verification' ELSE 'answered' END AS status, doc_id % 3 AS n_cites, doc_id % 3 - CASE WHEN doc_id % 9 = 2 THEN 1 ELSE 0 END AS n_resolving FROM docs)"
_WEEKS = "weeks AS (SELECT user_id, CAST(date_trunc('week', ts) AS DATE) AS w FROM events GROUP BY 1, 2)"


def _gold(t):
    d, s = F.col("doc_id"), F.col("doc_id") % 7
    return t.documents().select(
        d.alias("item_id"), F.element_at(F.array(*map(F.lit, AXES)), (d % 6 + 1).cast("int")).alias("axis"), (d % 6 != 5).alias("should_answer"),
        F.when(s == 0, None).when(s == 1, "needs_review").when(s == 2, "needs_verification").otherwise("answered").alias("status"), (d % 3).alias("n_cites"), (d % 3 - F.when(d % 9 == 2, 1).otherwise(0)).alias("n_resolving"))


def _marks(t):
    return t.raw("labels").select("doc_id", "quality", "toxic")


def _counts(t, k):
    return t.lines().groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", (F.col("n") + F.when(F.col("doc_id") % k == 0, 1).otherwise(0)).alias("n"))


_COUNTS = "ca AS (SELECT doc_id, count(*) + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS n FROM lines GROUP BY 1), cb AS (SELECT doc_id, count(*) + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS n FROM lines GROUP BY 1)"


_MEASURES = (("detection_coverage", 20, 0.9), ("detection_latency_hours", 30, 10.0), ("citation_accuracy", 25, 0.85), ("hallucination_rate", 7, 0.0))


def _gates(t):
    """Gates of every cell, by the number of its documents: some pass, some fail, some are unmeasured; two are of the pilot as a whole."""
    by = t.document_cells().groupBy("cell_id").agg(F.count("*").alias("n"))
    n = F.col("n")
    values = {
        "detection_coverage": F.when(n % 5 > 0, 0.9 + n % 10 / 100), "detection_latency_hours": F.when(n % 7 > 0, (n % 50).cast("double")), "citation_accuracy": F.when(n % 3 > 0, 0.85 + n % 8 / 100), "hallucination_rate": n % 6 / 100}
    scoped = by.select("cell_id", F.explode(F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("double"))))).alias("gate", "value"))
    whole = t.spark.createDataFrame([(e.UNSCOPED, "time_saving", 0.1), (e.UNSCOPED, "pilot_retention", 0.7)], "cell_id string, gate string, value double")
    return e.assembled_gates(scoped, whole)


_GATES = """byc AS (SELECT cell_id, count(*) AS n FROM doc_cells GROUP BY 1), gates AS (
  SELECT cell_id, 'detection_coverage' AS gate, CASE WHEN n % 5 > 0 THEN 0.9::DOUBLE + n % 10 / 100.0::DOUBLE END AS value, 0.95 AS bound, true AS least FROM byc UNION ALL SELECT cell_id, 'detection_latency_hours', CASE WHEN n % 7 > 0 THEN n % 50 END, 24, false FROM byc
  UNION ALL SELECT cell_id, 'citation_accuracy', CASE WHEN n % 3 > 0 THEN 0.85::DOUBLE + n % 8 / 100.0::DOUBLE END, 0.9, true FROM byc UNION ALL SELECT cell_id, 'hallucination_rate', n % 6 / 100.0::DOUBLE, 0.02, false FROM byc
  UNION ALL VALUES ('-', 'time_saving', 0.1, 0.3, true), ('-', 'pilot_retention', 0.7, 0.6, true)),
judged AS (SELECT *, CASE WHEN value IS NULL THEN 'unmeasured' WHEN CASE WHEN least THEN value >= bound::DOUBLE ELSE value <= bound::DOUBLE END THEN 'pass' ELSE 'fail' END AS verdict FROM gates)"""


def _golden(t):
    """Golden items, one for each document, with faults by their numbers: repeated ids, axes and outcomes at odds, empty and overlapping paths."""
    k = F.col("item_id")
    paths = lambda *when: F.when(when[0], F.array().cast("array<string>")).otherwise(F.array(F.lit("A1"), F.lit("A2")))
    return _gold(t).select(
        F.when(k % 40 == 7, k - 1).otherwise(k).alias("item_id"), "axis", F.when(F.col("axis").isin(*e.REFUSAL_AXES) != (k % 13 == 0), "needs_verification").otherwise("answered").alias("expected_outcome"),
        paths(k % 4 == 0).alias("expected"), F.when(k % 9 == 0, F.array(F.lit("A2"))).when(k % 3 == 0, F.array(F.lit("B1"))).otherwise(F.array().cast("array<string>")).alias("forbidden"), (k % 5 == 0).alias("cross_cell"))


_GOLDEN = f"""{_GOLD}, golden AS (SELECT CASE WHEN item_id % 40 = 7 THEN item_id - 1 ELSE item_id END AS item_id, axis, axis IN ('mis_citation', 'cross_domain', 'unanswerable') AS refuses, (axis IN ('mis_citation', 'cross_domain', 'unanswerable')) <> (item_id % 13 = 0) AS asks, item_id % 4 = 0 AS bare, item_id % 9 = 0 AS lapping, item_id % 9 = 0 OR item_id % 3 = 0 AS forbids, item_id % 5 = 0 AS crosses FROM gold)"""


def _articles(t):
    return e.articles(t.tree())


def _answered(t):
    """Answers of a run: two claims each, the second cited twice, once by an address that only some documents have."""
    c = lambda k, p: F.struct(F.lit(k).alias("claim_index"), F.lit(p).alias("path"))
    return _gold(t).select("item_id", "status", F.array(F.concat(F.lit("one "), F.col("item_id").cast("string")), F.lit("two")).alias("claims"), F.array(c(0, "제1조"), c(1, "제1장/제1조"), c(1, "제9999조")).alias("citations"))


def _judged(t):
    """A worksheet read back: judged, but for some blanks."""
    k = F.col("item_id")
    return e.worksheet(_answered(t), _gold(t).select("item_id", F.lit("q").alias("question")), t.tree(), "7").withColumn("supports", F.when(k % 10 == 3, " ").otherwise((k % 3 > 0).cast("string"))).withColumn("contradicts", F.when(k % 10 == 7, F.lit(None).cast("string")).otherwise("false"))


def _judgements(t):
    """Judged citations of answers in cells; the Spanish cells have none."""
    k = F.col("doc_id")
    return t.document_cells().where("cell_id NOT LIKE 'es%' AND doc_id % 2 = 0").select("cell_id", k.alias("item_id"), (k % 7 > 1).alias("supports"), (k % 11 == 0).alias("contradicts"))


def _cell_answers(t):
    return t.document_cells().select("cell_id", F.col("doc_id").alias("item_id"), (F.col("doc_id") % 19 == 0).alias("fabricated"), F.when(F.col("doc_id") % 3 == 0, "needs_verification").otherwise("answered").alias("status"))


def _irs_of(t):
    """Citations of obligations: each clause's own, and one that resolves nowhere for each fifth."""
    own = t.clauses().where("v = 1 AND ordinal % 2 = 0").select("version_id", "path", F.concat_ws(":", "version_id", (F.col("ordinal") % 6).cast("string")).alias("ir_id"))
    return own.unionByName(t.clauses().where("v = 1 AND ordinal % 5 = 0").select("version_id", F.lit("Z").alias("path"), F.concat_ws(":", "version_id", "ordinal").alias("ir_id")))


def _runs(t):
    k = F.col("event_id")
    return t.raw("events").select(F.col("user_id").alias("subject"), k.alias("run_id"), F.when(F.col("event_type") != "error", F.unix_timestamp(F.col("ts").cast("timestamp"))).alias("finished_at"), (k % 3).alias("regime"))


def _polls(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(k.alias("source_id"), (k % 5).alias("polls"), F.lit(4).alias("expected"))


def _latencies(t):
    """Latency by cell, of which every ninth publishes nothing."""
    from clausewise.operators import monitoring as m

    k = F.col("o_orderkey")
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    cell = F.col("o_custkey") % 50
    return m.latency(t.raw("orders").select(cell.cast("string").alias("cell_id"), (at + k % 29 * 3600).alias("alerted_at"), F.when((k % 5 > 0) & (cell % 9 > 0), at).alias("published_at")), ["cell_id"], 24)


def _grounded(t):
    """Items pinned to a document, but for every eighth; some expect what does not exist, some forbid what does."""
    k = F.col("doc_id")
    return t.documents().select(
        k.alias("item_id"), F.lit("en-samd").alias("cell_id"), F.when(k % 8 > 0, k).alias("doc_id"), F.when(k % 3 == 0, F.array(F.lit("제9999조"))).otherwise(F.array(F.lit("제1조"))).alias("expected"), F.array(F.lit("제5조의2"), F.lit("제8888조")).alias("forbidden"), F.when(k % 2 == 1, "seen").alias("notes"))


def _marked_filings(t):
    """Filing clauses as a person marked them in every second document: some found, some not, some that are none."""
    heads = _filing(t)[0].where("root % 3 <> 1").select("doc_id", "root")
    more = t.lines().where("ordinal % 29 = 5").select("doc_id", F.col("ordinal").cast("long").alias("root"))
    return heads.unionByName(more).where("doc_id % 2 = 0").select(F.col("doc_id").alias("version_id"), F.col("root").cast("string").alias("path"))


def _markup(t):
    """First versions, two thirds of whose clauses were marked: counts of a person, and those of the obligations on record."""
    first = t.clauses().where("v = 1").select("version_id", "path", "ordinal", "doc_id")
    own = _irs_of(t)
    ours = own.where("path <> 'Z'").groupBy("version_id", "path").agg(F.count("*").alias("n"))
    runs = first.select("version_id", "doc_id").distinct().where("doc_id % 3 <> 1").withColumn("run_id", F.explode(F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("version_id", "run_id", F.when(F.col("run_id") == 2, "new").otherwise("old").alias("regime"))
    return e.extraction_against_markup(first.where("ordinal % 3 <> 2"), first.where("ordinal % 4 = 0").select("version_id", "path", (F.col("ordinal") % 3).cast("long").alias("n")), ours, own.withColumn("resolves", F.col("path") != "Z"), runs)


QUERIES = {
    "E1_article_reduction": (
        lambda t: t.clauses().select("version_id", "path", e.article_of(F.concat(F.lit("부칙/"), F.when(F.col("ordinal") % 2 == 0, "제3조의2/").otherwise(""), F.col("path"))).alias("article")),
        sql("SELECT version_id, path, CASE WHEN ordinal % 2 = 0 THEN '제3조의2' ELSE string_split(path, '/')[-1] END AS article FROM clauses")),
    "E2_golden_validation": (
        lambda t: e.composition_errors(_golden(t), 20).groupBy("item_id", "error").agg(F.count("*").alias("n")),
        sql("""SELECT item_id, error, count(*) AS n FROM (SELECT CAST(item_id AS VARCHAR) AS item_id, unnest(list_filter([CASE WHEN refuses AND NOT asks THEN 'axis_refuses_but_answer_expected' END, CASE WHEN NOT refuses AND asks THEN 'axis_answers_but_refusal_expected' END, CASE WHEN NOT asks AND bare THEN 'nothing_to_score' END,
            CASE WHEN axis = 'mis_citation' AND NOT forbids THEN 'trap_without_forbidden_paths' END, CASE WHEN axis = 'cross_domain' AND crosses THEN 'cross_cell_defeats_item' END, CASE WHEN lapping AND NOT bare THEN 'expected_and_forbidden' END], lambda x: x IS NOT NULL)) AS error FROM golden
          UNION ALL SELECT CAST(item_id AS VARCHAR), 'duplicate_id' FROM golden GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT a, 'below_floor' FROM (SELECT unnest(['identifier', 'conceptual', 'effective_date', 'mis_citation', 'cross_domain', 'unanswerable']) AS a) x WHERE (SELECT count(*) FROM golden WHERE axis = a) < 20) GROUP BY 1, 2""", _GOLDEN)),
    "E3_axis_scores": (
        lambda t: e.axis_scores(_gold(t)),
        sql("SELECT coalesce(axis, 'overall') AS axis, count(*) AS items, count(*) FILTER (WHERE (status = 'answered') = should_answer) AS as_expected, count(*) FILTER (WHERE status IS NULL) AS unobserved, CAST(coalesce(sum(n_cites) FILTER (WHERE status = 'answered'), 0) AS BIGINT) AS citations, CAST(coalesce(sum(n_resolving) FILTER (WHERE status = 'answered'), 0) AS BIGINT) AS resolving FROM gold GROUP BY ROLLUP(axis)", _GOLD)),
    "E4_rates": (
        lambda t: _gold(t).groupBy("axis").agg(e.rate(F.sum(F.when(F.col("axis") != "conceptual", F.col("n_resolving"))), F.sum(F.when(F.col("axis") != "conceptual", F.col("n_cites")))).alias("rate")),
        sql("SELECT axis, CASE WHEN axis <> 'conceptual' THEN round(sum(n_resolving) / nullif(sum(n_cites), 0), 6) END AS rate FROM gold GROUP BY 1", _GOLD)),
    "E5_blind_assessment": (
        lambda t: e.assessment(_judgements(t), ["cell_id"]),
        sql("SELECT cell_id, count(*) AS citations, round(avg(CASE WHEN doc_id % 7 > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, count(DISTINCT doc_id) AS answers, count(DISTINCT CASE WHEN doc_id % 11 = 0 THEN doc_id END) AS contradicting FROM doc_cells WHERE cell_id NOT LIKE 'es%' AND doc_id % 2 = 0 GROUP BY 1")),
    "E6_hallucination_gate": (
        lambda t: _gold(t).groupBy("axis").agg(F.round(e.hallucination(F.count_if(F.expr("n_cites > n_resolving")), F.count_if(F.expr("status = 'needs_verification'")), F.count_if(F.expr("status = 'answered'"))), 6).alias("rate")),
        sql("SELECT axis, round(least(greatest(a, b), n) / nullif(n, 0), 6) AS rate FROM (SELECT axis, count(*) FILTER (WHERE n_cites > n_resolving) AS a, count(*) FILTER (WHERE status = 'needs_verification') AS b, count(*) FILTER (WHERE status = 'answered') AS n FROM gold GROUP BY 1)", _GOLD)),
    "E7_extraction_scores": (
        lambda t: e.count_scores(_counts(t, 4), _counts(t, 6)),
        sql("SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared, round(sum(least(a.n, b.n)) / sum(b.n), 6) AS precision, round(sum(least(a.n, b.n)) / sum(a.n), 6) AS recall FROM ca a JOIN cb b USING (doc_id)", _COUNTS)),
    "E8_determinism_drift": (
        lambda t: e.drift(_counts(t, 4).where("doc_id % 5 > 0"), _counts(t, 6)).select("doc_id", "a", "b"),
        sql("SELECT doc_id, a.n AS a, b.n AS b FROM (SELECT * FROM ca WHERE doc_id % 5 > 0) a FULL JOIN cb b USING (doc_id) WHERE a.n IS DISTINCT FROM b.n", _COUNTS)),
    "E9_expected_polls": (
        lambda t: t.raw("supplier").select("s_suppkey", e.expected_polls(F.lit(30 * 86400), F.col("s_suppkey") % 40 * 86400, F.lit(86400)).alias("expected")),
        "SELECT s_suppkey, greatest(least(30, s_suppkey % 40), 0) AS expected FROM supplier"),
    "E10_ledger_coverage": (
        lambda t: e.ledger_coverage(e.amendment_labels(t.versions(), t.documents()).unionByName(t.documents().where("doc_id % 9 = 0").select(F.concat("title", F.lit(" @ never")).alias("label"))), e.amendment_labels(t.versions().where("doc_id % 4 > 0"), t.documents())),
        sql("SELECT DISTINCT title || ' @ ' || CAST(effective_date AS VARCHAR) AS label, doc_id % 4 > 0 AS found FROM versions JOIN docs USING (doc_id) WHERE v > 1 AND effective_date IS NOT NULL UNION ALL SELECT title || ' @ never', false FROM docs WHERE doc_id % 9 = 0")),
    "E11_detection_scores": (
        lambda t: e.binary_scores(_marks(t).select("doc_id", (F.col("quality") == 0).alias("marked")), t.raw("documents").select("doc_id", F.col("text").contains("!!").alias("detected"))),
        "SELECT count(*) FILTER (WHERE quality = 0 AND d) AS tp, count(*) FILTER (WHERE quality = 1 AND d) AS fp, count(*) FILTER (WHERE quality = 0 AND NOT d) AS fn FROM labels JOIN (SELECT doc_id, contains(text, '!!') AS d FROM documents) USING (doc_id)"),
    "E12_retention": (
        lambda t: e.retained(t.raw("events").select("user_id", F.col("ts").cast("date").alias("day")), 4),
        f"WITH {_WEEKS}, recent AS (SELECT DISTINCT w FROM weeks ORDER BY w DESC LIMIT 4) SELECT user_id, count(*) AS weeks, count(*) = 4 AS retained FROM weeks WHERE w IN (SELECT w FROM recent) GROUP BY 1"),
    "E13_time_saving": (
        lambda t: t.raw("part").select("p_partkey", e.time_saving((F.col("p_size") - 5) * 50, F.col("p_retailprice")).alias("saving")),
        "SELECT p_partkey, CASE WHEN p_size > 5 THEN round(1 - p_retailprice / ((p_size - 5) * 50), 6) END AS saving FROM part"),
    "E14_gate_verdicts": (lambda t: e.verdicts(_gates(t)).select("cell_id", "gate", "verdict"), sql("SELECT cell_id, gate, verdict FROM judged", _GATES)),
    "E15_suffix_resolution": (
        lambda t: e.suffix_matches(t.documents().select(F.concat(F.lit("제"), (F.col("doc_id") % 30).cast("string"), F.lit("조")).alias("suffix")).union(t.documents().select(F.lit("제1조/제1항")).distinct()), t.tree()).select("doc_id", "path", "suffix"),
        sql("SELECT t.doc_id, t.path, w.suffix FROM tree t JOIN (SELECT DISTINCT '제' || doc_id % 30 || '조' AS suffix FROM docs UNION ALL SELECT '제1조/제1항') w ON t.path = w.suffix OR ends_with(t.path, '/' || w.suffix)")),
    "E16_in_force_versions": (
        lambda t: e.in_force(t.versions(), t.documents().withColumn("title", F.substring("title", 1, 8)), ref_date()),
        sql("SELECT substr(title, 1, 8) AS title, arg_max(version_id, (effective_date, version_id)) AS version_id FROM versions JOIN docs USING (doc_id) WHERE effective_date <= DATE '2024-12-01' GROUP BY 1")),
    "E17_article_index": (
        lambda t: _articles(t).select("version_id", "path", "article", F.col("place").cast("long").alias("place")),
        sql("SELECT version_id, path, string_split(path, '/')[-1] AS article, row_number() OVER (PARTITION BY version_id ORDER BY ordinal) - 1 AS place FROM tree WHERE regexp_matches(path, '(^|/)제\\d+조(의\\d+)?$')")),
    "E18_counts_per_clause": (
        lambda t: e.counts_per_clause(t.clauses(), _irs_of(t)),
        sql("SELECT version_id, path, count(DISTINCT ir) AS irs, count(*) AS citations, count(*) FILTER (WHERE path <> 'Z') AS resolving FROM (SELECT version_id, path, ordinal % 6 AS ir FROM clauses WHERE v = 1 AND ordinal % 2 = 0 UNION ALL SELECT version_id, 'Z', ordinal FROM clauses WHERE v = 1 AND ordinal % 5 = 0) GROUP BY 1, 2")),
    "E19_amendment_labels": (
        lambda t: e.amendment_labels(t.versions(), t.documents()),
        sql("SELECT DISTINCT title || ' @ ' || CAST(effective_date AS VARCHAR) AS label FROM versions JOIN docs USING (doc_id) WHERE v > 1 AND effective_date IS NOT NULL")),
    "E20_schedule_counts": (
        lambda t: e.polls_in_window(t.raw("customer").select(F.col("c_custkey").alias("source_id")), t.raw("orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").alias("fetched_at")), F.lit("1997-01-01").cast("timestamp_ntz")),
        "SELECT c_custkey AS source_id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1997-01-01') AS polls FROM customer"),
    "E21_events_by_cell": (
        lambda t: e.events_by_cell(t.versions().where("v = 2").join(t.document_cells(), "doc_id").withColumnRenamed("retrieved_at", "detected_at"), F.lit(1709900000)),
        sql("SELECT cell_id, count(*) AS n FROM versions JOIN doc_cells USING (doc_id) WHERE v = 2 AND retrieved_at > 1709900000 GROUP BY 1")),
    "E22_shortest_match": (
        lambda t: e.shortest_texts(t.documents().select(F.concat(F.lit("제"), (F.col("doc_id") % 30).cast("string"), F.lit("조")).alias("suffix")), t.tree(), 100).select("suffix", F.sha2("text", 256).alias("digest")),
        sql("SELECT suffix, sha256(CASE WHEN length(x) > 100 THEN substr(x, 1, 100) || ' …' ELSE x END) AS digest FROM (SELECT w.suffix, arg_min(t.text, (length(t.path), t.path, t.doc_id)) AS x FROM tree t JOIN (SELECT DISTINCT '제' || doc_id % 30 || '조' AS suffix FROM docs) w ON t.path = w.suffix OR ends_with(t.path, '/' || w.suffix) GROUP BY 1)")),
    "E23_round_robin_seed": (
        lambda t: e.spread(_articles(t), "doc_id", ["place"], 60).select("doc_id", "path"),
        sql("SELECT doc_id, path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal) AS rn FROM tree WHERE regexp_matches(path, '(^|/)제\\d+조(의\\d+)?$')) ORDER BY rn, doc_id LIMIT 60")),
    "E23_missing_traps": (
        lambda t: e.missing_article_traps(_articles(t)),
        sql("SELECT doc_id, '제' || (top + n) || '조' AS article FROM (SELECT doc_id, max(CAST(regexp_extract(string_split(path, '/')[-1], '제(\\d+)조', 1) AS INTEGER)) AS top FROM tree WHERE regexp_matches(path, '(^|/)제\\d+조(의\\d+)?$') GROUP BY 1), (VALUES (11), (27)) AS v(n) WHERE top >= 5")),
    "E23_repealed_traps": (
        lambda t: e.repealed_traps(_articles(t), t.tree().withColumn("text", F.when(F.col("ordinal") % 24 == 13, "삭제 <2013.7.30>").otherwise(F.col("text")))).select("version_id", "path", F.array_join("forbidden", ",").alias("forbidden")),
        sql("SELECT version_id, path, concat_ws(',', before, behind) AS forbidden FROM (SELECT *, lag(path) OVER w AS before, lead(path) OVER w AS behind FROM tree WHERE regexp_matches(path, '(^|/)제\\d+조(의\\d+)?$') WINDOW w AS (PARTITION BY version_id ORDER BY ordinal)) WHERE ordinal % 24 = 13 OR contains(text, '삭제')")),
    "E23_cross_domain": (
        lambda t: e.cross_domain_items(_articles(t), t.documents().select("doc_id", "domain"), {"samd": "cosmetic", "cosmetic": "samd"}),
        sql("SELECT doc_id, string_split(path, '/')[-1] AS article, CASE domain WHEN 'samd' THEN 'cosmetic' ELSE 'samd' END AS asked_in FROM tree JOIN docs USING (doc_id) WHERE regexp_matches(path, '(^|/)제\\d+조(의\\d+)?$')")),
    "E24_blind_worksheet": (
        lambda t: e.worksheet(_answered(t), _gold(t).select("item_id", F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("question")), t.tree(), "7").select("row_id", "item_id", "claim_index", "path", "question", "claim", F.col("clause").isNotNull().alias("found")),
        sql("SELECT sha256(item_id || '|' || k || '|' || p || '|7') AS row_id, item_id, k AS claim_index, p AS path, 'q' || item_id AS question, CASE k WHEN 0 THEN 'one ' || item_id ELSE 'two' END AS claim, p <> '제9999조' AS found FROM gold, (VALUES (0, '제1조'), (1, '제1장/제1조'), (1, '제9999조')) AS v(k, p) WHERE status = 'answered'", _GOLD)),
    "E25_worksheet_blanks": (
        lambda t: e.unjudged(_judged(t)).select("item_id").distinct(), sql("SELECT item_id FROM gold WHERE status = 'answered' AND item_id % 10 IN (3, 7)", _GOLD)),
    "E26_rater_agreement": (
        lambda t: e.agreement(_counts(t, 4).where("doc_id % 5 > 0"), _counts(t, 6), t.documents().select("doc_id")),
        sql("SELECT count(*) AS n, round(count(*) FILTER (WHERE a.n = b.n) / count(*), 6) AS exact_share, round(avg(abs(coalesce(a.n, 0) - coalesce(b.n, 0))), 6) AS mean_delta, count(*) FILTER (WHERE a.n = b.n) / count(*) >= 0.8 AS agreed FROM docs LEFT JOIN (SELECT * FROM ca WHERE doc_id % 5 > 0) a USING (doc_id) LEFT JOIN cb b USING (doc_id)", _COUNTS)),
    "E27_remaining_items": (
        lambda t: e.remaining(_gold(t).select("item_id"), _gold(t).where("status IS NOT NULL").select("item_id", F.when(F.col("item_id") % 7 == 1, "timeout").alias("error"))), sql("SELECT item_id FROM gold WHERE item_id % 7 IN (0, 1)", _GOLD)),
    "E27_unresolved_citations": (
        lambda t: e.unresolved_citations(_irs_of(t), t.clauses()).select("version_id", "path", "ir_id"), sql("SELECT version_id, 'Z' AS path, version_id || ':' || ordinal AS ir_id FROM clauses WHERE v = 1 AND ordinal % 5 = 0")),
    "E28_latency_gate": (
        lambda t: e.verdicts(e.latency_gate(_latencies(t))).select("cell_id", "value", "verdict"),
        """SELECT cell_id, value, CASE WHEN value IS NULL THEN 'unmeasured' WHEN value <= 24 THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS cell_id, CAST(max(CASE WHEN o_custkey % 50 % 9 > 0 AND o_orderkey % 5 > 0 THEN o_orderkey % 29 END) AS DOUBLE) AS value FROM orders GROUP BY 1)"""),
    "E28_submission_detection": (
        lambda t: e.detection_by_version(_marked_filings(t), _filing(t)[0].select(F.col("doc_id").alias("version_id"), F.col("root").cast("string").alias("path"))).withColumns({c: F.array_join(c, ",") for c in ("missed", "extra")}),
        sql("""SELECT version_id, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 6) END AS recall, array_to_string(missed[1:5], ',') AS missed, array_to_string(extra[1:5], ',') AS extra
          FROM (SELECT version_id, count(*) FILTER (WHERE m AND d) AS tp, count(*) FILTER (WHERE NOT m) AS fp, count(*) FILTER (WHERE NOT d) AS fn, coalesce(list(path ORDER BY path) FILTER (WHERE NOT d), []) AS missed, coalesce(list(path ORDER BY path) FILTER (WHERE NOT m), []) AS extra
          FROM (SELECT doc_id AS version_id, CAST(root AS VARCHAR) AS path, bool_or(d) AS d, bool_or(m) AS m FROM (SELECT doc_id, root, true AS d, false AS m FROM fheads UNION ALL SELECT doc_id, root, false, true FROM fmarked) WHERE doc_id IN (SELECT doc_id FROM fmarked) GROUP BY 1, 2) GROUP BY 1)""",
          f"{_FILING}, fmarked AS (SELECT doc_id, root FROM fheads WHERE root % 3 <> 1 AND doc_id % 2 = 0 UNION SELECT doc_id, ordinal FROM lines WHERE ordinal % 29 = 5 AND doc_id % 2 = 0)")),
    "E28_extraction_markup": (
        lambda t: _markup(t),
        sql("""SELECT version_id, CAST(sum(a) AS BIGINT) AS marked, CAST(sum(b) AS BIGINT) AS extracted, CAST(sum(least(a, b)) AS BIGINT) AS shared, CASE WHEN sum(b) > 0 THEN round(sum(least(a, b)) / sum(b), 6) END AS precision, CASE WHEN sum(a) > 0 THEN round(sum(least(a, b)) / sum(a), 6) END AS recall,
          count(*) FILTER (WHERE b < a) AS missed, count(*) FILTER (WHERE b > a) AS invented, any_value(r) AS resolving, CASE WHEN version_id // 10 % 3 = 1 THEN NULL WHEN version_id // 10 % 3 = 0 THEN 'new' ELSE 'old' END AS regime
          FROM (SELECT version_id, CASE WHEN ordinal % 4 = 0 THEN ordinal % 3 ELSE 0 END AS a, CASE WHEN ordinal % 2 = 0 THEN 1 ELSE 0 END AS b FROM clauses WHERE v = 1 AND ordinal % 3 <> 2) LEFT JOIN (SELECT version_id, round(count(*) FILTER (WHERE ordinal % 2 = 0) / (count(*) FILTER (WHERE ordinal % 2 = 0) + count(*) FILTER (WHERE ordinal % 5 = 0)), 6) AS r FROM clauses WHERE v = 1 GROUP BY 1) USING (version_id) GROUP BY version_id""")),
    "E29_golden_grounding": (
        lambda t: e.grounding_errors(_grounded(t), t.document_cells(), _articles(t)).groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("error")), ",").alias("errors")),
        sql("""SELECT item_id, string_agg(DISTINCT error, ',' ORDER BY error) AS errors FROM (SELECT doc_id AS item_id, 'document_outside_cell' AS error FROM docs WHERE doc_id % 8 > 0 AND (doc_id, 'en-samd') NOT IN (SELECT (doc_id, cell_id) FROM doc_cells)
          UNION ALL SELECT doc_id, 'expected_article_missing' FROM docs d WHERE CASE WHEN doc_id % 8 = 0 THEN doc_id % 3 = 0 ELSE doc_id % 3 = 0 OR NOT EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = d.doc_id AND t.ordinal % 12 = 1 AND t.ordinal = 1) END
          UNION ALL SELECT doc_id, 'forbidden_article_needs_note' FROM docs d WHERE doc_id % 2 = 0 AND CASE WHEN doc_id % 8 = 0 THEN true ELSE EXISTS (SELECT 1 FROM tree t WHERE t.doc_id = d.doc_id AND t.ordinal = 5) END) GROUP BY 1""")),
    "E30_bounded_run": (
        lambda t: e.bounded(_gold(t), 5, 17).select("axis", "item_id"),
        sql("SELECT axis, item_id FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY item_id) AS k FROM gold) WHERE k <= 5 ORDER BY item_id LIMIT 17", _GOLD)),
    "E31_blind_sample": (
        lambda t: e.blind_sample(t.clauses().where("v = 1"), "11", 40).select("version_id", "path"),
        sql("SELECT version_id, path FROM clauses WHERE v = 1 ORDER BY sha256(version_id || '|' || path || '|11') LIMIT 40")),
    "E32_newest_runs": (
        lambda t: e.compared_runs(_runs(t)),
        "SELECT subject, l[1] AS newest, l[2] AS before, l[1] % 3 = l[2] % 3 AS comparable FROM (SELECT user_id AS subject, list(event_id ORDER BY floor(epoch(ts)) DESC, event_id DESC) AS l FROM events WHERE event_type <> 'error' GROUP BY 1) WHERE len(l) >= 2"),
    "E33_answer_gates": (
        lambda t: e.verdicts(e.answer_gates(_cell_answers(t), _judgements(t))).select("cell_id", "gate", "value", "verdict"),
        sql("""SELECT cell_id, gate, value, CASE WHEN value IS NULL THEN 'unmeasured' WHEN gate = 'citation_accuracy' AND value >= 0.9::DOUBLE OR gate = 'hallucination_rate' AND value <= 0.02::DOUBLE THEN 'pass' ELSE 'fail' END AS verdict FROM (
          SELECT cell_id, g AS gate, CASE WHEN judged = 0 THEN NULL WHEN g = 'citation_accuracy' THEN round(supporting / judged, 6) ELSE round(least(greatest(fabricated, contradicting), n) / n, 6) END AS value FROM (SELECT cell_id, count(*) AS n, count(*) FILTER (WHERE doc_id % 19 = 0) AS fabricated, count(*) FILTER (WHERE doc_id % 2 = 0 AND cell_id NOT LIKE 'es%') AS judged,
            count(*) FILTER (WHERE doc_id % 2 = 0 AND doc_id % 7 > 1) AS supporting, count(DISTINCT CASE WHEN doc_id % 2 = 0 AND doc_id % 11 = 0 THEN doc_id END) AS contradicting FROM doc_cells GROUP BY 1), (VALUES ('citation_accuracy'), ('hallucination_rate')) AS v(g))""")),
    "E34_recommendation": (
        lambda t: e.recommendation(e.verdicts(_gates(t))),
        sql("""SELECT cell_id, failed, unmeasured, CASE WHEN unmeasured > 0 THEN 'INCOMPLETE' WHEN failed >= 4 THEN 'NO-GO' ELSE 'GO' END AS recommendation FROM (SELECT cell_id, count(*) FILTER (WHERE verdict = 'fail') + (SELECT count(*) FROM judged WHERE cell_id = '-' AND verdict = 'fail') AS failed,
          count(*) FILTER (WHERE verdict = 'unmeasured') + (SELECT count(*) FROM judged WHERE cell_id = '-' AND verdict = 'unmeasured') AS unmeasured FROM judged WHERE cell_id <> '-' GROUP BY 1)""", _GATES)),
    "E34_guards": (
        lambda t: e.guards(_cell_answers(t), t.raw("orders"), _polls(t)),
        sql("SELECT 'needs_verification_rate' AS guard, round(avg(CASE WHEN doc_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS value FROM doc_cells UNION ALL SELECT 'alert_volume', CAST(count(*) AS DOUBLE) FROM orders UNION ALL SELECT 'poll_completion', round(sum(s_suppkey % 5) / sum(4), 6) FROM supplier")),
    "E36_rendered_gates": (
        lambda t: e.rendered_gates(e.verdicts(_gates(t).where("value IS NULL OR gate IN ('time_saving', 'pilot_retention', 'detection_latency_hours')"))),
        sql("""SELECT cell_id, gate, concat_ws(' | ', gate, CASE WHEN value IS NULL THEN '—' WHEN gate = 'detection_latency_hours' THEN printf('%.1f', value::DOUBLE) || 'h' ELSE printf('%.1f', value::DOUBLE * 100) || '%' END, CASE WHEN least THEN '≥' ELSE '≤' END || ' ' || CASE WHEN gate = 'detection_latency_hours' THEN '24h' ELSE printf('%.0f', bound::DOUBLE * 100) || '%' END, upper(verdict)) AS line
          FROM judged WHERE value IS NULL OR gate IN ('time_saving', 'pilot_retention', 'detection_latency_hours')""", _GATES)),
    "E36_reseed_guard": (
        lambda t: e.may_reseed(t.document_cells().select("cell_id").distinct().withColumn("ra_signed_off", F.when(F.col("cell_id").startswith("en"), True).when(F.col("cell_id").startswith("de"), False))),
        sql("SELECT DISTINCT cell_id, NOT starts_with(cell_id, 'en') AS allowed FROM doc_cells")),
    "E35_section_lines": (
        lambda t: e.section_lines(t.lines().withColumn("text", F.when(F.col("ordinal") % 6 == 0, F.concat(F.lit("## "), F.when(F.col("ordinal") % 12 == 0, "Deviations").otherwise("Other"))).when(F.col("ordinal") % 2 == 1, F.concat(F.lit("- "), F.col("text"))).otherwise(F.col("text"))), "Deviations"),
        sql("SELECT doc_id, ordinal, substr('- ' || text, 1, 200) AS line FROM lines WHERE ordinal % 2 = 1 AND ordinal // 6 % 2 = 0")),
}
assert len(GATES) == 6
