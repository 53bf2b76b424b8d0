"""Queries of canonical form, parsing rules, obligations and filing clauses."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise.adapt import sql
from clausewise.constants import DISCOVERY_EXCLUSIONS, DISCOVERY_KEYWORDS, STANDARD_STATUSES
from clausewise.functions import nfc
from clausewise.operators import ingest
from clausewise.operators import texts as x

_STYLE = """CASE WHEN regexp_matches(s, '^제\\d+(편|장|절|관)') THEN 'chapter' WHEN regexp_matches(s, '^제\\d+조') THEN 'article'
  WHEN regexp_matches(s, '^([IVX]{1,4})\\.\\s*\\S') THEN 'roman_dot' WHEN regexp_matches(s, '^[①②③]') THEN 'circled' WHEN regexp_matches(s, '^\\d+(\\.\\d+)+\\.?\\s+\\S') THEN 'dotted'
  WHEN regexp_matches(s, '^\\d+(의\\d+)?\\.\\s*\\S') THEN 'digit_dot' WHEN regexp_matches(s, '^\\d+(의\\d+)?\\)\\s*\\S') THEN 'digit_paren'
  WHEN regexp_matches(s, '^[가나다라마바사아자차카타파하]\\.\\s*\\S') THEN 'hangul_dot' WHEN regexp_matches(s, '^[가나다라마바사아자차카타파하]\\)\\s*\\S') THEN 'hangul_paren'
  WHEN regexp_matches(s, '^[-–—·ㆍ*○●□■]\\s+\\S') THEN 'bullet' END"""
MARKED = f"marked AS (SELECT *, {_STYLE} AS style FROM (SELECT *, trim(line) AS s FROM legal))"
TRIAGE = """CASE WHEN length(trim(line)) < 10 THEN 'empty' WHEN regexp_matches(line, '^제\\d+조\\(정의\\)') THEN 'definition'
  WHEN regexp_matches(line, '하여야\\s*(한다|하며|하고|하는|할|함)') THEN NULL WHEN regexp_matches(line, '총리령(으)?로\\s*정(한다|하는)') THEN 'delegation'
  WHEN regexp_matches(line, '수\\s*있다') THEN 'permissive' ELSE 'no_obligation' END"""


# Phrases of the front matter of a standard.
BODY_TEXT_MARKERS = (
    "all rights reserved. unless otherwise specified", "no part of this publication may be reproduced", "iso copyright office", "iec central office", "permission can be requested from either iso",
)


def _decomposed(column):
    """The text with an accent put behind each e, as decomposed input has it."""
    return F.replace(column, F.lit("e"), F.lit("e\u0301"))


def _part_rows(t):
    return t.raw("part").select("p_partkey", F.create_map(F.lit("type"), F.col("p_type"), F.lit("조회수"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("name"), F.col("p_name")).alias("row"))


def _versions_with_docs(t):
    return t.versions().join(t.documents(), "doc_id")


def _filing(t):
    """Procedures: an article line dressed as a filing clause, its items the lines below it."""
    lines = t.lines().withColumn("root", F.floor(F.col("ordinal") / 5))
    heads = lines.where("ordinal % 5 = 0").select(
        "doc_id", "root", F.when(F.col("ordinal") % 10 == 0, F.concat("text", F.lit(" 다음 각 호의 서류를 첨부하여 제출하여야 한다"))).otherwise(F.concat("text", F.lit(" 다음 각 호의 사항을 첨부하여 서류"))).alias("text"))
    items = lines.where("ordinal % 5 > 0").select("doc_id", "root", "ordinal", F.concat("text", F.when(F.col("ordinal") % 7 == 0, " 인 경우").when(F.col("ordinal") % 11 == 0, " 다음 각 목 별지 제 3 호서식").otherwise("")).alias("text"))
    return heads.where(x.is_filing(F.col("text"), F.lit("prose"))), items


_FILING = """fheads AS (SELECT doc_id, ordinal // 5 AS root, text FROM lines WHERE ordinal % 10 = 0),
fitems AS (SELECT doc_id, ordinal // 5 AS root, ordinal, text || CASE WHEN ordinal % 7 = 0 THEN ' 인 경우' WHEN ordinal % 11 = 0 THEN ' 다음 각 목 별지 제 3 호서식' ELSE '' END AS text FROM lines WHERE ordinal % 5 > 0)"""


def _caveats(t):
    heads, items = _filing(t)
    grouped = items.groupBy("doc_id", "root").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("items"))
    joined = heads.join(grouped, ["doc_id", "root"], "left").withColumn("items", F.coalesce(F.col("items.text"), F.array().cast("array<string>")))
    found = x.caveats(F.col("text"), F.col("items"))
    return joined.select("doc_id", F.col("root").cast("long").alias("root"), F.array_join(found, ",").alias("caveats"), (F.size(found) == 0).alias("definitive"))


def _dressed(t):
    """Lines as clauses of all kinds: their place in a tree, statute markers and duties, headings of some, and transitional parts in every tenth document."""
    o, k = F.col("ordinal"), F.col("doc_id")
    place = t.tree().select("doc_id", "ordinal", "kind", F.concat(F.when(k % 10 == 3, "부칙/").otherwise(""), "path").alias("path"))
    heading = F.when(o % 24 == 1, F.when(k % 4 == 0, " Definitions of terms ").when(k % 4 == 1, "적용 범위").otherwise("Duties")).when(o % 36 == 2, "Purpose").when(o % 12 == 3, "")
    return t.legal_lines().join(place, ["doc_id", "ordinal"]).withColumn("heading", heading)


QUERIES = {
    "C1_normalize_text": (
        lambda t: t.raw("documents").select("doc_id", x.normalize_text(nfc(_decomposed("text"))).alias("text")).select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest")),
        """SELECT doc_id, length(n) AS n, sha256(n) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\\x0B\\f]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS n FROM (SELECT doc_id, nfc_normalize(replace(text, 'e', 'e' || chr(769))) AS text FROM documents))"""),
    "C2_canonical_records": (
        lambda t: _part_rows(t).select("p_partkey", x.canonical_record(F.col("row")).alias("canonical")),
        "SELECT p_partkey, 'brand' || chr(9) || p_brand || chr(10) || 'name' || chr(9) || p_name || chr(10) || 'type' || chr(9) || p_type AS canonical FROM part"),
    "C4_content_hash": (lambda t: t.clauses().select("version_id", "path", "content_hash"), sql("SELECT version_id, path, content_hash FROM clauses")),
    "C13_authority_date": (
        lambda t: t.raw("orders").select("o_orderkey", x.authority_date(F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy.M.d"))
                                                                   .otherwise(F.lit("2024-13-40"))).cast("string").alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 3 = 1 AND month(o_orderdate) > 9 AND day(o_orderdate) > 9 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS day FROM orders"),
    "C15_status_coercion": (
        lambda t: t.raw("events").select("event_id", x.coerced(F.when(F.col("event_type") == "error", " Withdrawn ").otherwise(F.col("event_type")), STANDARD_STATUSES, "unknown").alias("status")),
        "SELECT event_id, CASE WHEN event_type = 'error' THEN 'withdrawn' ELSE 'unknown' END AS status FROM events"),
    "S12_redact_url": (
        lambda t: t.raw("pages").select("page_id", x.redacted(F.concat("url", F.when(F.col("url").contains("?"), "&").otherwise("?"), F.lit("key=s3cr3t"))).alias("url")),
        "SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'key={OC}' AS url FROM pages WHERE NOT contains(url, '#') UNION ALL SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'key={OC}' FROM pages WHERE contains(url, '#')"),
    "S15_annex_identity": (
        lambda t: t.raw("part").select("p_partkey", x.annex_label(F.lit("별표"), F.format_string("%04d", F.col("p_size")), F.when(F.col("p_partkey") % 3 == 0, F.format_string("%02d", (F.col("p_partkey") % 5).cast("int")))).alias("label")),
        "SELECT p_partkey, '별표' || p_size || CASE WHEN p_partkey % 3 = 0 AND p_partkey % 5 > 0 THEN '의' || p_partkey % 5 ELSE '' END AS label FROM part"),
    "P3_line_markers": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", x.marker_style(F.col("line")).alias("style")),
        sql("SELECT doc_id, ordinal, style FROM marked", MARKED)),
    "P4_segments": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", x.marker_segment(F.col("line")).alias("segment")),
        sql("""SELECT doc_id, ordinal, CASE ordinal % 12 WHEN 0 THEN '제' || (ordinal + 1) || '장' WHEN 1 THEN '제' || (ordinal + 1) || '조' WHEN 2 THEN '제1항' WHEN 3 THEN '제1호' WHEN 4 THEN '가목'
          WHEN 5 THEN '4.1.' || (ordinal + 1) WHEN 6 THEN '2의3)' WHEN 7 THEN 'IV' WHEN 8 THEN '' WHEN 9 THEN '제3조의2' WHEN 10 THEN '가)' END AS segment FROM legal""")),
    "P5_logical_lines": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", F.posexplode(x.logical_lines(F.concat("line", F.when(F.col("ordinal") % 3 > 0, F.concat(F.lit("  ② 둘째 항 "), "ordinal")).otherwise("둘②째"), F.when(F.col("ordinal") % 3 == 1, "\n\n ③ 셋째 항").otherwise("")))).alias("k", "piece")),
        sql("""SELECT doc_id, ordinal, CAST(k - 1 AS INTEGER) AS k, pieces[k] AS piece FROM (SELECT doc_id, ordinal, CASE ordinal % 3 WHEN 0 THEN [line || '둘②째'] WHEN 1 THEN [line, '② 둘째 항 ' || ordinal, '③ 셋째 항'] ELSE [line, '② 둘째 항 ' || ordinal] END AS pieces FROM legal), range(1, 4) AS r(k) WHERE k <= len(pieces)""")),
    "P10_filler_and_flags": (
        lambda t: t.lines().select("doc_id", "ordinal", x.filler_to_null(F.format_string("%06d", (F.col("ordinal") % 3).cast("int"))).alias("ref"), x.yes_no(F.when(F.col("ordinal") % 4 == 0, "Y").when(F.col("ordinal") % 4 == 1, "n").otherwise("?")).alias("flag")),
        sql("SELECT doc_id, ordinal, CASE WHEN ordinal % 3 > 0 THEN printf('%06d', ordinal % 3) END AS ref, CASE ordinal % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag FROM lines")),
    "P15_row_mapping": (
        lambda t: t.raw("part").select("p_partkey", F.array_join(F.transform(F.map_entries(x.zipped_row(F.array(F.lit("name"), F.lit("brand")), F.split(F.when(F.col("p_partkey") % 2 == 0, F.concat_ws("|", "p_name", "p_brand", "p_type")).otherwise(F.col("p_name")), r"\|"))),
                                         lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("row")),
        "SELECT p_partkey, 'name=' || p_name || ';brand=' || CASE WHEN p_partkey % 2 = 0 THEN p_brand || ';col3=' || p_type ELSE '' END AS row FROM part"),
    "P16_row_rendering": (
        lambda t: t.raw("part").select("p_partkey", x.rendered_row(F.create_map(F.lit("name"), F.col("p_name"), F.lit("none"), F.lit(" "), F.lit("type"), F.col("p_type"))).alias("text")),
        "SELECT p_partkey, 'name: ' || p_name || chr(10) || 'type: ' || p_type AS text FROM part"),
    "P17_label_normalisation": (
        lambda t: t.raw("part").select("p_partkey", x.normalized_label(F.concat(F.lit("원 료  명 "), F.col("p_brand"), F.lit("  x"))).alias("label")),
        "SELECT p_partkey, '원료명 ' || p_brand || ' x' AS label FROM part"),
    "P22_clause_date": (
        lambda t: ingest.own_dates(t.clauses().join(t.versions().select("version_id", F.col("effective_date").alias("d")), "version_id").withColumn("effective_date", F.when(F.col("ordinal") % 2 == 0, F.col("d")).otherwise(F.date_add("d", 30))), t.versions())
        .select("version_id", "path", F.col("effective_date").cast("string").alias("clause_date")),
        sql("SELECT version_id, path, CAST(CASE WHEN ordinal % 2 = 1 THEN effective_date + 30 END AS VARCHAR) AS clause_date FROM clauses JOIN versions USING (version_id, doc_id, v)")),
    "P23_path_and_level": (
        lambda t: t.clauses().select("version_id", "path", F.size(F.split("path", "/")).cast("long").alias("level"), F.element_at(F.split("path", "/"), -1).alias("tail")),
        sql("SELECT version_id, path, len(string_split(path, '/')) AS level, string_split(path, '/')[-1] AS tail FROM clauses")),
    "P24_parents": (
        lambda t: ingest.with_parents(t.clauses()).select("version_id", "path", "clause_id", "parent_id"),
        sql("SELECT c.version_id, c.path, c.version_id || ':' || c.ordinal AS clause_id, p.version_id || ':' || p.ordinal AS parent_id FROM clauses c LEFT JOIN clauses p ON p.version_id = c.version_id AND contains(c.path, '/') AND p.path = string_split(c.path, '/')[1]")),
    "X1_triage": (
        lambda t: _dressed(t).select("doc_id", "ordinal", x.triage(F.col("kind"), F.split("path", "/"), F.col("heading"), F.col("line")).alias("t")).select("doc_id", "ordinal", "t.kind", "t.reason"),
        sql(f"""SELECT doc_id, ordinal, CASE WHEN reason IS NULL THEN 'obligation_bearing' ELSE 'excluded' END AS kind, reason FROM (SELECT doc_id, ordinal, CASE WHEN kind IN ('heading', 'form') THEN kind WHEN kind = 'table' THEN 'table_container' WHEN length(trim(line)) < 10 THEN 'empty' WHEN doc_id % 10 = 3 THEN 'procedural'
          WHEN ordinal % 24 = 1 THEN CASE WHEN doc_id % 4 = 0 THEN 'definition' WHEN doc_id % 4 = 1 THEN 'scope' ELSE 'no_obligation' END WHEN ordinal % 36 = 2 THEN 'scope' ELSE {TRIAGE} END AS reason FROM legal JOIN tree USING (doc_id, ordinal))""")),
    "X2_modals": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", F.array_join(x.found_modals(F.concat("line", F.when(F.col("ordinal") % 3 == 0, " 금지된다").otherwise(""))), ",").alias("modals")),
        sql("SELECT doc_id, ordinal, concat_ws(',', CASE WHEN ordinal % 12 = 2 THEN '하여야 한다' END, CASE WHEN ordinal % 3 = 0 THEN '금지한다' END) AS modals FROM legal")),
    "X3_permissive": (
        lambda t: t.raw("conversations").select("conv_id", "turn", x.has_permissive(F.concat("text", F.when(F.col("turn") % 3 == 0, " may not").when(F.col("turn") % 3 == 1, " may do").otherwise("")), "en").alias("permissive")),
        "SELECT conv_id, turn, regexp_matches(replace(s, ' may not', ''), '\\bmay\\b|\\bcan\\b|\\bis\\s+permitted\\s+to\\b') AS permissive FROM (SELECT *, text || CASE turn % 3 WHEN 0 THEN ' may not' WHEN 1 THEN ' may do' ELSE '' END AS s FROM conversations)"),
    "X4_title": (
        lambda t: _dressed(t).select("doc_id", "ordinal", x.title_of(F.col("heading"), F.col("line")).alias("title")),
        sql("SELECT doc_id, ordinal, CASE WHEN ordinal % 24 = 1 THEN CASE doc_id % 4 WHEN 0 THEN 'Definitions of terms' WHEN 1 THEN '적용 범위' ELSE 'Duties' END WHEN ordinal % 36 = 2 THEN 'Purpose' WHEN ordinal % 12 = 1 THEN '정의' ELSE '' END AS title FROM legal")),
    "X5_canonical_codes": (
        lambda t: t.raw("events").select("event_id", x.canonical_taxonomy(F.when(F.col("event_type") == "click", " Design-Control").otherwise("Risk Mgmt"), "samd").alias("code"), x.canonical_modal(F.when(F.col("event_type") == "view", "하여야 하며").otherwise(F.col("event_type"))).alias("modal")),
        "SELECT event_id, CASE WHEN event_type = 'click' THEN 'design_control' END AS code, CASE WHEN event_type = 'view' THEN '하여야 한다' END AS modal FROM events"),
    "U1_filing_clauses": (lambda t: _filing(t)[0].select("doc_id", F.col("root").cast("long").alias("root")), sql("SELECT doc_id, root FROM fheads", _FILING)),
    "U2_filing_items": (
        lambda t: x.filing_items(t.tree().where("kind = 'prose'")).select("version_id", "path", F.array_join("items", ",").alias("items"), F.array_join("sub_items", ",").alias("sub_items")),
        sql("SELECT q.version_id, q.path, string_agg(c.path, ',' ORDER BY c.ordinal) AS items, coalesce((SELECT string_agg(g.path, ',' ORDER BY g.ordinal) FROM tree g JOIN tree c2 ON c2.doc_id = g.doc_id AND c2.ordinal = g.parent_ordinal WHERE g.doc_id = q.doc_id AND c2.parent_ordinal = q.ordinal AND g.kind = 'prose' AND c2.kind = 'prose'), '') AS sub_items FROM tree q JOIN tree c ON c.doc_id = q.doc_id AND c.parent_ordinal = q.ordinal WHERE q.kind = 'prose' AND c.kind = 'prose' GROUP BY q.version_id, q.doc_id, q.ordinal, q.path")),
    "U3_item_flags": (
        lambda t: _filing(t)[1].withColumn("text", F.concat("text", F.when(F.col("ordinal") % 5 == 2, " 총리령으로 정하는 서류").otherwise(""))).select("doc_id", "ordinal", x.item_flags(F.col("text"), F.when(F.col("ordinal") % 13 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))).alias("f")).select("doc_id", "ordinal", "f.*"),
        sql("SELECT doc_id, ordinal, ordinal % 7 = 0 AS conditional, ordinal % 5 = 2 AS delegates, ordinal % 13 = 0 OR ordinal % 7 <> 0 AND ordinal % 11 = 0 AS has_sub_items FROM fitems", _FILING)),
    "U6_caveats": (
        _caveats,
        sql("""SELECT doc_id, root, caveats, caveats = '' AS definitive FROM (SELECT h.doc_id, h.root, concat_ws(',', CASE WHEN coalesce(bool_or(i.ordinal % 7 = 0), false) THEN 'conditional_items' END,
          CASE WHEN coalesce(bool_or(i.ordinal % 7 <> 0 AND i.ordinal % 11 = 0), false) THEN 'nested_items' END, CASE WHEN count(i.ordinal) = 0 THEN 'no_items_parsed' END) AS caveats FROM fheads h LEFT JOIN fitems i USING (doc_id, root) GROUP BY 1, 2)""", _FILING)),
    "U7_form_reference": (
        lambda t: _filing(t)[1].select("doc_id", "ordinal", x.form_reference(F.col("text")).alias("form")),
        sql("SELECT doc_id, ordinal, CASE WHEN ordinal % 7 <> 0 AND ordinal % 11 = 0 THEN '별지 제 3 호서식' END AS form FROM fitems", _FILING)),
    "H4_folded_titles": (
        lambda t: t.documents().select("doc_id", x.folded(nfc(F.concat("title", F.lit(" ·화장품 cafe\u0301")))).alias("folded")),
        sql("SELECT doc_id, replace(lower(title), ' ', '') || '화장품café' AS folded FROM docs")),
    "H5_keyword_cells": (
        lambda t: t.documents().withColumn("n", F.concat("title", F.when(F.col("doc_id") % 3 == 0, " 화장품 고시").when(F.col("doc_id") % 3 == 1, " 인체 적용제품").otherwise(" 체외진단 의료기기")))
        .select("doc_id", F.array_join(x.keyword_cells(F.col("n"), DISCOVERY_KEYWORDS, DISCOVERY_EXCLUSIONS), ",").alias("cells"), x.first_exclusion(F.col("n"), DISCOVERY_EXCLUSIONS).alias("exclusion")),
        sql("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'mfds_cosmetic' WHEN 1 THEN 'mfds_samd,mfds_cosmetic' ELSE '' END AS cells, CASE WHEN doc_id % 3 = 2 THEN '체외진단' END AS exclusion FROM docs")),
    "H8_text_scan": (
        lambda t: ingest.marker_phrases(t.raw("documents").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 7 == 0, " No part of this publication may be Reproduced").when(F.col("doc_id") % 7 == 1, " IEC Central Office, ISO Copyright Office").otherwise(""))), BODY_TEXT_MARKERS),
        "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'no part of this publication may be reproduced' ELSE 'iso copyright office' END AS phrase FROM documents WHERE doc_id % 7 < 2"),
}
