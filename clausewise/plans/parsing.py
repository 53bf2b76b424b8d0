"""Queries of parsers and connectors, over whole driver tables dressed as their inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.adapt import sql
from clausewise.functions import condition, display_width, recipient, wide_class
from clausewise.operators import annex, outline
from clausewise.operators import texts as x
from clausewise.plans.texts import MARKED
from clausewise.sources import markup


def nested_sql(source: str, levels: list[int], order: str = "ordinal") -> str:
    """SQL of the rows of ``source`` (doc_id, order, level, segment) with ``above``, the list of open segments."""
    w = f"OVER (PARTITION BY doc_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    last = ", ".join(f"max(CASE WHEN level = {n} THEN {order} END) {w} AS a{n}, last_value(CASE WHEN level = {n} THEN coalesce(segment, '') END IGNORE NULLS) {w} AS s{n}" for n in levels)
    part = lambda k, n: f"CASE WHEN {n} < level AND a{n} > coalesce(greatest({', '.join([*(f'a{m}' for m in levels[:k]), 'NULL', 'NULL'])}), -1) THEN s{n} END"
    return f"SELECT *, list_filter([{', '.join(part(k, n) for k, n in enumerate(levels))}], lambda s: s <> '') AS above FROM (SELECT *, {last} FROM {source})"


# ---------------------------------------------------------------- outlines

_SEGMENT = """CASE style WHEN 'chapter' THEN regexp_extract(s, '^(제\\d+(편|장|절|관))', 1) WHEN 'article' THEN regexp_extract(s, '^(제\\d+조(의\\d+)?)', 1) WHEN 'roman_dot' THEN regexp_extract(s, '^([IVX]+)', 1)
  WHEN 'circled' THEN '제' || list_position(['①', '②', '③'], s[1]) || '항' WHEN 'dotted' THEN regexp_extract(s, '^(\\d+(\\.\\d+)+)', 1) WHEN 'digit_dot' THEN '제' || regexp_extract(s, '^(\\d+)', 1) || '호' || regexp_extract(s, '^\\d+(의\\d+)', 1)
  WHEN 'digit_paren' THEN regexp_extract(s, '^(\\d+(의\\d+)?\\))', 1) WHEN 'hangul_dot' THEN s[1] || '목' WHEN 'hangul_paren' THEN s[1] || ')' WHEN 'bullet' THEN '-' END"""
_LEVEL = """CASE style WHEN 'chapter' THEN 10 + list_position(['편', '장', '절', '관'], regexp_extract(s, '^제\\d+(편|장|절|관)', 1)) WHEN 'article' THEN 20 WHEN 'roman_dot' THEN 20 WHEN 'circled' THEN 30
  WHEN 'digit_dot' THEN 41 WHEN 'dotted' THEN 41 + len(regexp_replace(regexp_extract(s, '^(\\d+(\\.\\d+)+)', 1), '[^.]', '', 'g')) WHEN 'hangul_dot' THEN 60 WHEN 'digit_paren' THEN 70 WHEN 'hangul_paren' THEN 80 WHEN 'bullet' THEN 90 END"""
_OUTLINE = f"""{MARKED}, styled AS (SELECT doc_id, ordinal, style, {_LEVEL} AS level, {_SEGMENT} AS segment FROM marked WHERE style IS NOT NULL),
nest AS ({nested_sql('styled', outline.LEVELS)}),
branches AS (SELECT doc_id, ordinal, style, array_to_string(above, '/') AS parent, len(above) + 1 AS level, CASE WHEN style = 'bullet' THEN '-' || row_number() OVER (PARTITION BY doc_id, array_to_string(above, '/') ORDER BY ordinal) ELSE segment END AS segment FROM nest),
paths AS (SELECT doc_id, ordinal, style, level, CASE WHEN parent = '' THEN segment ELSE parent || '/' || segment END AS path FROM branches)"""


def _legal(t):
    return outline.legal(t.legal_lines()).select("doc_id", F.col("place.ordinal").alias("ordinal"), "place", "path", "level", "kind", "heading", "parent", "text")


def _digest(column: str):
    return F.sha2(column, 256).alias("digest")


# ---------------------------------------------------------------- XML

_SAFE = "[<>&\\p{Cntrl}]"
_TEXT = "trim(regexp_replace(text, '[<>&[:cntrl:]]', ' ', 'g'))"
#: Kind, level and segment of a document's lines as statute elements, by ordinal modulo 12.
_UNITS = f"""units AS (SELECT doc_id, ordinal, {_TEXT} AS text, [2, 10, 20, 30, 40, 30, 20, 30, 40, 3, 10, 20][ordinal % 12 + 1] AS level, CASE ordinal % 12 WHEN 0 THEN '제' || (ordinal // 12 + 1) || '장' WHEN 1 THEN '제' || ordinal || '조'
  WHEN 2 THEN '제1항' WHEN 3 THEN '제1호' WHEN 4 THEN '가목' WHEN 5 THEN '제2호의2' WHEN 7 THEN '제1호' WHEN 8 THEN '나목' WHEN 9 THEN '제' || (ordinal // 12 + 1) || '절' WHEN 10 THEN '제' || ordinal || '조의2' WHEN 11 THEN '제2항' END AS segment FROM lines),
nest AS ({nested_sql('units', outline.STATUTE_LEVELS)})"""


def _xml(t):
    """Statute XML of every document: all its lines as chapters, articles, paragraphs (each second one unnumbered), items and sub-items; annexes and addenda behind."""
    def piece(text, i):
        n, o, c = F.lit(12), i.cast("string"), (F.floor(i / 12) + 1).cast("string")
        tag = lambda name, *parts: F.concat(F.lit(f"<{name}>"), *parts, F.lit(f"</{name}>"))
        unit = lambda attr, *parts: F.concat(F.lit(f"<조문단위 조문키='{attr}"), o, F.lit("'>"), *parts)
        item = lambda mark, body=text: F.concat(F.lit(f"<호><호번호>{mark}</호번호>"), tag("호내용", body), F.lit("</호>"))
        sub = lambda mark: F.concat(F.lit(f"<목><목번호>{mark}</목번호>"), tag("목내용", text), F.lit("</목>"))
        close = F.when(i > 0, "</항></조문단위>").otherwise("")
        kinds = [
            F.concat(close, unit("c", F.lit("<조문여부>전문</조문여부>"), tag("조문내용", F.lit("제"), c, F.lit("장 "), text), F.lit("</조문단위>"))),
            unit("a", tag("조문번호", o), F.lit("<조문이동이후>000000</조문이동이후><조문변경여부>Y</조문변경여부><조문시행일자>20240105</조문시행일자>"), tag("조문제목", text), tag("조문내용", text)),
            F.concat(F.lit("<항><항번호>①</항번호>"), tag("항내용", text)), item("1."), sub("가."), item("2의2."),
            F.concat(F.lit("</항><항>"), tag("항내용", text)), item("1."), sub("나."),
            F.concat(F.lit("</항></조문단위>"), unit("c", F.lit("<조문여부>전문</조문여부>"), tag("조문내용", F.lit("제"), c, F.lit("절 "), text), F.lit("</조문단위>"))),
            unit("b", tag("조문번호", o), F.lit("<조문가지번호>02</조문가지번호><조문이동이후>0042</조문이동이후><조문변경여부>N</조문변경여부>"), tag("조문내용", text)),
            F.concat(F.lit("<항><항번호>②</항번호>"), tag("항내용", text)),
        ]
        return F.element_at(F.array(*kinds), (i % n + 1).cast("int"))

    last = (F.size("l") - 1) % 12
    end = F.when(last.isin(0, 9), "").when(last.isin(1, 10), "</조문단위>").otherwise("</항></조문단위>")
    body = F.concat(F.array_join(F.transform("l", lambda s, i: piece(F.trim(F.regexp_replace(s, _SAFE, " ")), i)), ""), end)
    first = F.trim(F.regexp_replace(F.element_at("l", 1), _SAFE, " "))
    n = F.col("doc_id").cast("string")
    annexes = F.concat(
        F.lit("<별표><별표단위><별표번호>0001</별표번호><별표구분>별표</별표구분><별표내용>"), first, F.lit("</별표내용></별표단위><별표단위><별표번호>0002</별표번호><별표가지번호>00</별표가지번호><별표내용> </별표내용></별표단위>"
              "<별표단위><별표구분>서식</별표구분><별표번호>"), F.when(F.col("doc_id") % 5 == 0, "0003").otherwise("0001"), F.lit("</별표번호><별표가지번호>02</별표가지번호><별표내용>x</별표내용></별표단위>"
              "<별표단위><별표구분>서식</별표구분><별표번호>0003</별표번호><별표가지번호>02</별표가지번호><별표내용>y</별표내용></별표단위></별표>"))
    addenda = F.concat(F.lit("<부칙><부칙단위><부칙내용>이 법은 공포한 날부터 시행한다.</부칙내용></부칙단위><부칙단위><부칙내용>"), F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("제1조(시행일) "), n, F.lit("일부터 시행한다.\n제2조(경과) 없음"))).otherwise(F.concat(F.lit("머리\n이 고시는 "), n, F.lit("일 날 시행한다.\n끝"))), F.lit("</부칙내용></부칙단위></부칙>"))
    info = F.concat(F.lit("<기본정보><법령ID>L"), n, F.lit("</법령ID><시행일자>미정</시행일자><시행일자>2024"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"), F.lit("05</시행일자><별표시행일자문자열>20240101:별표1,서식3의2, 20250202:별표1,"),
                    F.concat(F.lit("별표"), n), F.lit("</별표시행일자문자열></기본정보>"))
    whole = F.concat(F.lit("<법령>"), info, F.lit("<조문>"), body, F.lit("</조문>"), annexes, addenda, F.lit("</법령>"))
    return t.line_arrays().where("size(l) > 0").select("doc_id", F.when(F.col("doc_id") % 17 == 3, "<법령>").otherwise(whole).alias("xml"))


def _elements(t):
    return markup.xml_elements(_xml(t))


_DOCS = "xdocs AS (SELECT doc_id, l FROM line_lists WHERE len(l) > 0)"


def _boxes(t):
    """Box-drawing tables of three parts each, whose names are wrapped."""
    p = t.raw("part").withColumn("g", F.floor(F.col("p_partkey") / 3))
    row = F.concat(F.lit("│"), F.col("p_partkey").cast("string"), F.lit("│"), F.rpad("p_brand", 12, " "), F.lit("│\n│ │"), F.rpad(F.lit("한"), 10, " "), F.lit("│"))
    rows = p.groupBy("g").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("r")))), lambda s: s["r"]), "\n├──┼──┤\n").alias("rows"))
    return rows.select(F.col("g").alias("doc_id"), F.concat(F.lit("머리말\n1. 하나\n┌──┬──┐\n│번 호│상  표│\n├──┼──┤\n"), "rows", F.lit("\n└──┴──┘\n꼬리말")).alias("content"))


_BOXES = "boxes AS (SELECT p_partkey // 3 AS doc_id, p_partkey, p_brand, row_number() OVER (PARTITION BY p_partkey // 3 ORDER BY p_partkey) AS row FROM part)"


def _annexes(t):
    kind = F.when(F.col("doc_id") % 7 == 0, "서식").otherwise("별표")
    return _boxes(t).select("doc_id", F.concat(kind, F.lit("1")).alias("segment"), kind.alias("kind"), F.lit("제목").alias("title"), F.when(F.col("doc_id") % 7 == 1, "서문\n1. 하나\n1. 둘").otherwise(F.col("content")).alias("content"))


_ANNEX_ROWS = _BOXES + """, docs1 AS (SELECT DISTINCT doc_id FROM boxes), pieces AS (
  SELECT doc_id, '서식1' AS path, 'form' AS kind FROM docs1 WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, p, 'prose' FROM docs1, (VALUES ('별표1/서문'), ('별표1/제1호'), ('별표1/제1호~2')) AS v(p) WHERE doc_id % 7 = 1
  UNION ALL SELECT doc_id, p, 'prose' FROM docs1, (VALUES ('별표1/문단1'), ('별표1/문단1/제1호'), ('별표1/문단2')) AS v(p) WHERE doc_id % 7 > 1
  UNION ALL SELECT doc_id, '별표1/표1', 'table' FROM docs1 WHERE doc_id % 7 > 1
  UNION ALL SELECT doc_id, '별표1/표1/행' || row, 'table_row' FROM boxes WHERE doc_id % 7 > 1)"""


def _feeds(t):
    """A feed of three items for each page: dates by page, the second item without one."""
    k = F.col("page_id")
    day = F.lpad((k % 28 + 1).cast("string"), 2, "0")
    item = lambda n, *date: F.concat(F.lit(f"<item><title> t{n}-"), k.cast("string"), F.lit("</title><guid>g</guid>"), *date, F.lit("</item>"))
    dated = lambda head, tail: F.concat(F.lit(f"<pubDate>{head}"), day, F.lit(tail), F.lit("</pubDate>"))
    zone = F.when(k % 2 == 0, " Feb 2024 10:00:00 +0900").otherwise(" Feb 2024 01:00:00 GMT")
    third = F.concat(F.lit("<pubDate>"), day, zone, F.lit("</pubDate>"))
    return t.raw("pages").select(k.alias("doc_id"), F.concat(F.lit("<rss><channel><title>all</title>"), item(1, dated("Mon, ", " Jan 2024 10:00:00 +0900")), item(2), item(3, third), F.lit("</channel></rss>")).alias("xml"))


_FEEDS = "feeds AS (SELECT page_id AS doc_id, i AS item, 't' || (i + 1) || '-' || page_id AS title, CASE i WHEN 0 THEN '2024-01-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' 01:00:00' WHEN 2 THEN '2024-02-' || lpad(CAST(page_id % 28 + 1 AS VARCHAR), 2, '0') || ' 01:00:00' END AS published FROM pages, range(3) AS r(i))"


def _listings(t):
    """A listing of two rows for each part; views are counted, and every third page has no header."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    head = F.when(k % 3 == 0, "").otherwise("<tr><th>번호</th><th>제목</th><th>조회 수</th></tr>")
    row = lambda n, name: F.concat(F.lit(f"<tr><td>{n}</td><td> "), F.translate(name, "<>&", "   "), F.lit(" <b>x</b></td><td>"), size, F.lit("</td></tr>"))
    return t.raw("part").select(k.alias("doc_id"), F.concat(F.lit("<table>"), head, row(1, "p_name"), row(2, "p_brand"), F.lit("</table>")).alias("html"))


_LISTINGS = "listed AS (SELECT p_partkey AS doc_id, r AS row, CAST(r + 1 AS VARCHAR) AS a, regexp_replace(trim(CASE r WHEN 0 THEN p_name ELSE p_brand END), ' +', ' ', 'g') || ' x' AS b, CAST(p_size AS VARCHAR) AS c, p_partkey % 3 > 0 AS headed FROM part, range(2) AS v(r))"


def _pending(t):
    """Lists of versions: one for each customer, a row for each order."""
    row = F.concat(F.lit("<law><법령명한글>"), F.when(F.col("o_orderkey") % 5 == 0, "화장품법 시행령").otherwise("화장품법"), F.lit("</법령명한글><현행연혁코드>"), F.when(F.col("o_orderstatus") == "O", "시행예정").otherwise("현행"),
                   F.lit("</현행연혁코드><법령일련번호>"), (F.col("o_orderkey") % 3).cast("string"), F.lit("</법령일련번호><시행일자>"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("</시행일자></law>"))
    return t.raw("orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "").alias("x")).select("doc_id", F.concat(F.lit("<LawSearch>"), "x", F.lit("</LawSearch>")).alias("xml"))


def _item(text):
    """Lines as items of a list, by ordinal modulo 6: a condition of its own, first, last, as all there is, none, and in front of another."""
    o, p = F.col("ordinal") % 6, lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return F.when(o == 0, p("1. 서류. ", F.trim(text), " 경우. 끝")).when(o == 1, p("다만 ", F.trim(text), ". 서류")).when(o == 2, p("2의3. 서류. 제1호에도 불구하고 ", F.trim(text))).when(
        o == 3, p(" 3. ", F.trim(text), " 제외한 것 ")).when(o == 4, p("4. ", F.trim(text), ". 끝")).otherwise(p("앞. 만 해당 ", F.trim(text), ". 경우. 뒤"))


_CONDITION = """CASE ordinal % 6 WHEN 0 THEN b || ' 경우.' WHEN 1 THEN '다만 ' || b || '.' WHEN 2 THEN '제1호에도 불구하고 ' || b WHEN 5 THEN '만 해당 ' || b || '.' END"""


def _filed(name):
    """Sentences that file with ``name``, by ordinal modulo 7: with an alternative, alone, as a closed phrase, far back, first of two, not at all, and in a longer title behind a connector."""
    o, p = F.col("ordinal") % 7, lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    head = F.lit("자료를 첨부하여 ")
    return F.when(o == 0, p(head, name, " 또는 기관의 장에게 제출하여야 한다")).when(o == 1, p(head, name, "에게 신청한다")).when(o == 2, p(head, name, " 장은에게 제출")).when(o == 3, p(head, name, " a b c d e에게  보고")).when(
        o == 4, p(head, name, "에게 통보하고 처장에게 제출")).when(o == 5, p(head, name, "에게 알린다")).otherwise(p(head, "및 기관의 ", name, "에게제출"))


QUERIES = {
    "P2_disambiguated_paths": (
        lambda t: outline.disambiguated(_legal(t)).select("doc_id", "ordinal", "path"),
        sql("SELECT doc_id, ordinal, CASE WHEN k > 1 THEN path || '~' || k ELSE path END AS path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, path ORDER BY ordinal) AS k FROM paths)", _OUTLINE)),
    "P6_legal_outline": (
        lambda t: _legal(t).select("doc_id", "ordinal", "path", F.col("level").cast("long").alias("level"), "kind"),
        sql("SELECT doc_id, ordinal, path, level, CASE WHEN style = 'chapter' THEN 'heading' ELSE 'prose' END AS kind FROM paths", _OUTLINE)),
    "P7_discovered_outline": (lambda t: outline.discovered(t.legal_lines()).select("doc_id", F.col("place.ordinal").alias("ordinal"), "path", "level", "kind", _digest("text")), None),
    "P8_bullets": (lambda t: _legal(t).where(F.element_at(F.split("path", "/"), -1).rlike("^-")).select("doc_id", "ordinal", "path"), sql("SELECT doc_id, ordinal, path FROM paths WHERE style = 'bullet'", _OUTLINE)),
    "P9_statute_tree": (
        lambda t: outline.statute(_elements(t)).select("doc_id", "path", "kind", F.coalesce("moved_to_ref", F.lit("")).alias("moved_to_ref"), "changed", F.col("clause_date").cast("string").alias("clause_date"), _digest("text")),
        sql("""SELECT doc_id, array_to_string(list_append(above, segment), '/') AS path, CASE WHEN level < 10 THEN 'heading' ELSE 'prose' END AS kind, CASE WHEN ordinal % 12 = 10 THEN '0042' ELSE '' END AS moved_to_ref,
          CASE ordinal % 12 WHEN 1 THEN true WHEN 10 THEN false END AS changed, CASE WHEN ordinal % 12 = 1 THEN '2024-01-05' END AS clause_date, sha256(CASE WHEN level < 10 THEN trim(segment || ' ' || text) ELSE text END) AS digest FROM nest WHERE segment IS NOT NULL AND doc_id % 17 <> 3""", _UNITS)),
    "P11_rule_bodies": (
        lambda t: outline.rule_lines(_elements(t)).groupBy("doc_id").agg(F.count("*").alias("lines"), F.min_by("line", "ordinal").alias("first")),
        sql("SELECT doc_id, count(*) FILTER (WHERE ordinal % 12 IN (0, 1, 9, 10) AND (ordinal % 12 IN (0, 9) OR text <> '')) AS lines, '제1장 ' || arg_min(text, ordinal) AS first FROM units WHERE doc_id % 17 <> 3 GROUP BY 1", _UNITS)),
    "P1_profiles": (
        lambda t: t.documents().select("doc_id", outline.profile(F.col("doc_type")).alias("profile")),
        sql("SELECT doc_id, CASE WHEN doc_type IN ('law', 'decree', 'enforcement_rule') THEN 'law_structured' WHEN doc_type = 'notice' THEN 'admrul_text' WHEN doc_type = 'annex' THEN 'annex' END AS profile FROM docs")),
    "P12_annex_clauses": (
        lambda t: annex.annex_clauses(_annexes(t)).select("doc_id", "path", "kind"), f"WITH {_ANNEX_ROWS} SELECT doc_id, path, kind FROM pieces"),
    "P13_box_tables": (
        lambda t: annex.tables(t_lines(_boxes(t))).where("row > 0").select("doc_id", "table", "row", F.array_join("header", "|").alias("header"), F.element_at("columns", "번호").alias("number"), F.element_at("columns", "상표").alias("brand")),
        f"WITH {_BOXES} SELECT doc_id, 1 AS table, row, '번호|상표' AS header, CAST(p_partkey AS VARCHAR) AS number, rtrim(p_brand) || ' 한' AS brand FROM boxes"),
    "P14_cell_splits": (
        lambda t: t.raw("part").select("p_partkey", F.array_join(annex.split_cells(F.concat(F.lit("│ "), F.col("p_brand"), F.lit(" │"), F.when(F.col("p_partkey") % 2 == 0, "사용금지 ├────┼──┤").otherwise(" │b  │  │"))), "/", "rule").alias("cells")),
        "SELECT p_partkey, ' ' || p_brand || ' /' || CASE WHEN p_partkey % 2 = 0 THEN '사용금지 /rule/rule' ELSE ' /b  /  ' END AS cells FROM part"),
    "P18_display_width": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", display_width("line").alias("width")),
        sql(f"SELECT doc_id, ordinal, CAST(length(line) + length(regexp_replace(line, '{wide_class().replace('[', '[^', 1)}', '', 'g')) AS INTEGER) AS width FROM legal")),
    "P19_envelope_date": (
        lambda t: markup.envelope_date(_elements(t)).select("doc_id", F.col("day").cast("string").alias("day")), sql("SELECT doc_id, '2024-' || lpad(CAST(doc_id % 12 + 1 AS VARCHAR), 2, '0') || '-05' AS day FROM xdocs WHERE doc_id % 17 <> 3", _DOCS)),
    "P20_annex_dates": (
        lambda t: markup.annex_dates(_elements(t)).select("doc_id", "label", F.col("day").cast("string").alias("day")),
        sql("SELECT DISTINCT doc_id, label, CASE WHEN label = '서식3의2' THEN '2024-01-01' ELSE '2025-02-02' END AS day FROM (SELECT doc_id, unnest(['별표1', '서식3의2', '별표' || doc_id]) AS label FROM xdocs WHERE doc_id % 17 <> 3)", _DOCS)),
    "P21_enforcement_phrase": (
        lambda t: markup.enforcement_phrase(_elements(t)),
        sql("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id || '일부터 시행한다.' ELSE '이 고시는 ' || doc_id || '일 날 시행한다.' END AS phrase FROM xdocs WHERE doc_id % 17 <> 3", _DOCS)),
    "S4_statute_artifacts": (
        lambda t: markup.statute_artifacts(_elements(t)).select("doc_id", "kind", "label"),
        sql("""SELECT doc_id, 'drift' AS kind, CASE WHEN doc_id % 17 = 3 THEN 'missing_root' ELSE 'record_count_delta' END AS label FROM xdocs WHERE doc_id % 17 = 3 OR doc_id % 5 = 0
          UNION ALL SELECT doc_id, k, CASE k WHEN 'body' THEN 'L' || doc_id ELSE name END FROM xdocs, (VALUES ('body', ''), ('annex', '별표1'), ('empty_annex', '별표2'), ('annex', '서식1의2'), ('annex', '서식3의2')) AS v(k, name) WHERE doc_id % 17 <> 3 AND doc_id % 5 <> 0""", _DOCS)),
    "S5_rule_artifacts": (
        lambda t: markup.rule_artifacts(markup.xml_elements(t.raw("part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("<AdmRulService><행정규칙ID>"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise("R1"), F.lit("</행정규칙ID><행정규칙일련번호>77</행정규칙일련번호><조문내용>"), F.when(F.col("p_size") > 10, F.lit("제1조 글")).otherwise(""), F.lit("</조문내용></AdmRulService>")).alias("xml")))).select("doc_id", "kind", "label"),
        "SELECT p_partkey AS doc_id, CASE WHEN p_size > 10 THEN 'body' ELSE 'drift' END AS kind, CASE WHEN p_size <= 10 THEN 'zero_records' WHEN p_partkey % 2 = 0 THEN '77' ELSE 'R1' END AS label FROM part"),
    "S6_pending_versions": (
        lambda t: markup.pending_versions(markup.xml_elements(_pending(t)), "화장품법").select("doc_id", "number", "day", "rank"),
        "SELECT doc_id, number, day, row_number() OVER (PARTITION BY doc_id ORDER BY day, number) AS rank FROM (SELECT o_custkey AS doc_id, CAST(o_orderkey % 3 AS VARCHAR) AS number, strftime(min(o_orderdate), '%Y%m%d') AS day FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderstatus = 'O' GROUP BY 1, 2)"),
    "S7_rss_items": (
        lambda t: markup.rss_items(markup.xml_elements(_feeds(t))).select("doc_id", "item", "title", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published")), f"WITH {_FEEDS} SELECT * FROM feeds"),
    "S7_latest_dates": (
        lambda t: markup.latest_item(markup.rss_items(markup.xml_elements(_feeds(t)))).select("doc_id", "items", F.date_format("published", "yyyy-MM-dd HH:mm:ss").alias("published")), f"WITH {_FEEDS} SELECT doc_id, count(*) AS items, max(published) AS published FROM feeds GROUP BY 1"),
    "S8_html_tables": (
        lambda t: markup.html_rows(_listings(t)).select("doc_id", "row", F.array_join(F.transform(F.map_entries("cells"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("cells")),
        f"WITH {_LISTINGS} SELECT doc_id, row, CASE WHEN headed THEN '번호=' || a || ';제목=' || b || ';조회 수=' || c ELSE 'col0=' || a || ';col1=' || b || ';col2=' || c END AS cells FROM listed"),
    "S9_listing_hash": (
        lambda t: markup.listing_record(_listings(t)),
        f"WITH {_LISTINGS} SELECT doc_id, count(*) AS rows, sha256(string_agg(CASE WHEN headed THEN '번호' || chr(9) || a || chr(10) || '제목' || chr(9) || b ELSE 'col0' || chr(9) || a || chr(10) || 'col1' || chr(9) || b || chr(10) || 'col2' || chr(9) || c END, chr(10) || chr(10) ORDER BY row)) AS content_hash FROM listed GROUP BY 1"),
    "S10_recognition_list": (
        lambda t: markup.recognitions(t.raw("part").select(F.col("p_partkey").alias("doc_id"), F.create_map(
            F.when(F.col("p_partkey") % 2 == 0, "표준번호").otherwise("Standard Number"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(" "), F.lit("판"), F.col("p_size").cast("string"), F.lit(" Title "), F.col("p_brand"),
            F.lit("상태"), F.when(F.col("p_partkey") % 2 == 0, "인정").when(F.col("p_partkey") % 3 == 0, "Withdrawn").otherwise("-")).alias("cells"))).select("doc_id", "number", "edition", "title", "issuing_body", "status"),
        "SELECT p_partkey AS doc_id, p_name AS number, CAST(p_size AS VARCHAR) AS edition, p_brand AS title, CAST(NULL AS VARCHAR) AS issuing_body, CASE WHEN p_partkey % 2 = 0 THEN 'recognized' WHEN p_partkey % 3 = 0 THEN 'withdrawn' ELSE 'unknown' END AS status FROM part WHERE p_partkey % 5 > 0"),
    "S13_error_bodies": (
        lambda t: t.raw("pages").select("page_id", markup.error_body(F.concat("html", F.when(F.col("page_id") % 3 == 0, "<result>사용자 정보 검증에 실패하였습니다</result>").when(F.col("page_id") % 3 == 1, "미신청된 목록").otherwise(""))).alias("is_error")),
        "SELECT page_id, page_id % 3 < 2 AS is_error FROM pages"),
    "S14_first_texts": (
        lambda t: markup.first_text(_elements(t), "법령명_한글", "시행일자"), sql("SELECT doc_id, '미정' AS text FROM xdocs WHERE doc_id % 17 <> 3", _DOCS)),
    "S16_annex_fan_out": (
        lambda t: markup.annex_units(_elements(t)).groupBy("doc_id").agg(F.count("*").alias("annexes"), F.count_if(F.col("content") == "").alias("empty"), F.countDistinct("label").alias("labels")),
        sql("SELECT doc_id, 4 AS annexes, 1 AS empty, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 4 END AS labels FROM xdocs WHERE doc_id % 17 <> 3", _DOCS)),
    "C3_canonical_xml": (
        lambda t: markup.canonical_xml(markup.xml_elements(_listings(t).select("doc_id", F.replace("html", F.lit("<b>x</b>"), F.lit("")).alias("xml"))), ("th",)),
        f"WITH {_LISTINGS} SELECT doc_id, string_agg('/table/tr/td' || chr(9) || a || chr(10) || '/table/tr/td' || chr(9) || left(b, len(b) - 2) || chr(10) || '/table/tr/td' || chr(9) || c, chr(10) ORDER BY row) AS canonical FROM listed GROUP BY 1"),
    "C14_rss_dates": (
        lambda t: t.raw("orders").select("o_orderkey", F.date_format(markup.rss_date(F.when(F.col("o_orderkey") % 4 == 3, F.lit("never")).otherwise(F.concat(
            F.when(F.col("o_orderkey") % 4 == 0, "Mon, ").otherwise(""), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.when(F.col("o_orderkey") % 4 == 1, " +0900").otherwise(" GMT")))), "yyyy-MM-dd HH:mm").alias("day")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN strftime(o_orderdate - CASE WHEN o_orderkey % 4 = 1 THEN INTERVAL 9 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%d %H:%M') END AS day FROM orders"),
    "U4_conditions": (
        lambda t: t.lines().select("doc_id", "ordinal", condition(_item(F.translate("text", ".", " "))).alias("condition")),
        sql(f"SELECT doc_id, ordinal, {_CONDITION} AS condition FROM (SELECT doc_id, ordinal, trim(translate(text, '.', ' ')) AS b FROM lines)")),
    "U5_recipients": (
        lambda t: t.lines().select("doc_id", "ordinal", recipient(_filed(F.concat(F.lit("R"), F.col("ordinal").cast("string")))).alias("recipient")),
        sql("SELECT doc_id, ordinal, CASE ordinal % 7 WHEN 0 THEN r || ' 또는 기관의 장' WHEN 1 THEN r WHEN 3 THEN r || ' a b c d e' WHEN 4 THEN r WHEN 6 THEN '기관의 ' || r END AS recipient FROM (SELECT *, 'R' || ordinal AS r FROM lines)")),
}


def t_lines(texts):
    """Lines (doc_id, ordinal, line) of contents as they stand."""
    return texts.select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("ordinal", "line"))


assert x.RANKS["dotted"] == 4
