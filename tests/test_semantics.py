"""Rules that are easily got wrong, on small hand-made rows."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from clausewise.operators import answers, catalog, diff, evaluation, monitoring, search, texts
from clausewise.functions import text as phrases

CLAUSE = "doc_id long, v int, path string, ordinal int, text string, source_ref string, moved_to_ref string"


def clauses(spark, rows):
    df = spark.createDataFrame([(1, *r, None, None) if len(r) == 4 else (1, *r) for r in rows], CLAUSE)
    return df.withColumn("content_hash", F.sha2("text", 256)).withColumn("kind", F.lit("prose"))


def kinds(df):
    return sorted((r.change_kind, r.old_path, r.new_path) for r in df.collect())


def test_index_shift_is_no_change(spark):
    c = clauses(spark, [(1, "A1", 0, "one"), (1, "A2", 1, "two"), (2, "A2", 0, "two"), (2, "A1", 5, "one")])
    assert kinds(diff.build_diffs(c)) == []


def test_renumber_is_not_delete_and_add(spark):
    c = clauses(spark, [(1, "A1", 0, "the same words"), (2, "A9", 0, "the same words")])
    assert kinds(diff.build_diffs(c)) == [("renumbered", "A1", "A9")]


def test_move_keeps_its_last_segment(spark):
    c = clauses(spark, [(1, "A1/I1", 0, "words"), (2, "A2/I1", 0, "words")])
    assert kinds(diff.build_diffs(c)) == [("moved", "A1/I1", "A2/I1")]


def test_duplicate_content_is_paired_in_order(spark):
    c = clauses(spark, [(1, "A1", 0, "x"), (1, "A2", 1, "x"), (2, "B1", 0, "x"), (2, "B2", 1, "x"), (2, "B3", 2, "x")])
    assert kinds(diff.build_diffs(c)) == [("added", None, "B3"), ("renumbered", "A1", "B1"), ("renumbered", "A2", "B2")]


def test_authority_renumbering_precedes_content(spark):
    c = clauses(spark, [(1, "A1", 0, "제1조 text", None, "m"), (2, "A2", 0, "제2조 text", "m", None)])
    assert kinds(diff.build_diffs(c)) == [("renumbered", "A1", "A2")]


def test_fuzzy_pairs_need_review_below_the_confident_ratio(spark):
    c = clauses(spark, [(1, "A1", 0, "a label states the amount in grams"), (2, "A7", 0, "a label states the amount in litres now")])
    got = diff.build_diffs(c).collect()
    assert [(r.change_kind, r.match_basis, r.needs_review) for r in got] == [("renumbered", "similarity", True)]


def test_first_version_is_a_baseline(spark):
    assert kinds(diff.build_diffs(clauses(spark, [(1, "A1", 0, "x")]))) == []


def test_in_force_beats_newest(spark):
    rows = [(11, 1, date(2024, 1, 1), 5, True), (12, 1, date(2025, 1, 1), 9, True), (21, 2, date(2026, 1, 1), 1, True), (22, 2, date(2025, 6, 1), 2, True), (31, 3, None, 1, True), (32, 3, None, 2, True)]
    v = spark.createDataFrame(rows, "version_id long, doc_id long, effective_date date, retrieved_at long, parsed boolean")
    got = {r.doc_id: r.version_id for r in catalog.version_scope(v, F.lit("2024-12-01").cast("date")).collect()}
    assert got == {1: 11, 2: 22, 3: 32}


def test_definition_with_a_modal_is_excluded(spark):
    df = spark.createDataFrame([("제2조(정의) 용어의 뜻을 정하여야 한다",), ("제3조(기준) 표시를 하여야 한다 그리고",), ("짧다",)], "t string")
    got = [r.x.reason for r in df.select(texts.triage(F.lit("prose"), F.array(F.lit("a")), F.lit(None).cast("string"), F.col("t")).alias("x")).collect()]
    assert got == ["definition", None, "empty"]


def test_unknown_language_is_an_error():
    with pytest.raises(ValueError):
        texts.found_modals(F.lit("x"), "zh")


def test_alert_without_deliveries_is_delivered(spark):
    alerts = spark.createDataFrame([(1,), (2,), (3,), (4,)], "alert_id long")
    tries = spark.createDataFrame([(2, 1, 1, "failed"), (3, 1, 5, "failed"), (4, 1, 5, "failed"), (4, 2, 1, "sent")], "alert_id long, subscription_id long, attempt int, status string")
    got = {r.alert_id: r.status for r in monitoring.alert_status(alerts, monitoring.delivery_state(tries)).collect()}
    assert got == {1: "delivered", 2: "pending", 3: "failed", 4: "delivered"}


def test_exact_row_outranks_and_prefix_does_not(spark):
    rows = [(1, "vector", 7, "p", 0, 1.0), (1, "rows", 8, "p", 0, 1.0), (1, "rows", 9, "p", 1, 0.6)]
    arms = spark.createDataFrame(rows, "query_id long, arm string, version_id long, path string, rank int, score double")
    assert [r.version_id for r in search.fuse(arms).orderBy("rank").collect()] == [8, 9, 7]


def test_fabricated_citation_rejects_the_answer(spark):
    claims = spark.createDataFrame([(1, 0, "a", ["A1"]), (1, 1, "b", ["A9"]), (2, 0, "c", [])], "answer_id long, claim_index int, text string, cites array<string>")
    got = {r.answer_id: r.reason for r in answers.validated_claims(claims, spark.createDataFrame([(1, "A1")], "answer_id long, path string")).collect()}
    assert got == {1: "fabricated_citation", 2: "no_citation"}


def test_retention_needs_every_week(spark):
    days = [(u, d) for u, ds in ((1, (1, 8, 15, 22)), (2, (1, 8, 22)), (3, (22,))) for d in ds]
    df = spark.createDataFrame([(u, date(2024, 1, d)) for u, d in days], "user_id long, day date")
    assert {r.user_id for r in evaluation.retained(df, 4).where("retained").collect()} == {1}


def column(spark, rule, texts):
    return [r.x for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", rule("text").alias("x")).orderBy("k").collect()]


def test_recipient_of_a_filing(spark):
    cases = {
        "자료를 첨부하여 식품의약품안전처장 또는 기술문서심사기관의 장에게 제출하여야 한다": "식품의약품안전처장 또는 기술문서심사기관의 장", "없다": None, "자료를 첨부하여 기관은에게 제출": None, None: None, "": None,
        "하나 둘 셋 넷 다섯 여섯 일곱에게  신청한다": "둘 셋 넷 다섯 여섯 일곱", "다음을 또는 심사기관의 장에게 통보": "심사기관의 장", "또는에게 보고": None, "장에게 알린다": None,
        "청장에게 보고하고 처장에게 제출": "청장", "서류를\n 지방청의\t장에게제출": "지방청의 장", "에게 제출": None}
    assert column(spark, phrases.recipient, cases) == list(cases.values())


def test_condition_is_a_sentence(spark):
    cases = {
        "1. 서류. 다만, 없는 경우 제외한다. 끝.": "다만, 없는 경우 제외한다.", "1. 없는 경우": None, "1. 서류": None, None: None, "": None, "앞. 제2호에도 불구하고 낸다": "제2호에도 불구하고 낸다",
        "2의3. 한정한 것. 나머지": "한정한 것.", "다만 하나. 다만 둘.": "다만 하나.", "서류.다만 붙임": None, " 3. 경우 ": None}
    assert column(spark, phrases.condition, cases) == list(cases.values())


def test_width_counts_wide_characters_twice(spark):
    texts = ["abc", "가나다", "ａ１", "日本語 text", "ｱｲｳ", "①·–", "한\u0301", "", "😀x", "\u3000"]
    assert column(spark, phrases.display_width, texts) == [phrases.width_of(t) for t in texts]
