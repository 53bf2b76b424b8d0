"""Driver parquet -> domain tables.

Every rule is a pure function of a row (or of a document's lines), so the tables need no shuffle and the same
rules are stated once more in SQL (``CTES``) for the oracle queries.  A line table is exploded from an array
that is trimmed and filtered first, so line numbers come from the position and not from a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TODAY = "2024-12-01"
#: Unicode's space separators, which SQL's trim takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


class Tables:
    """Lazy domain tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        """doc_id, title, doc_type, parent_id, authority, domain."""
        k = F.col("doc_id") % 6
        kinds = F.element_at(F.array(*map(F.lit, ("law", "decree", "enforcement_rule", "notice", "annex", "feed"))), (k + 1).cast("int"))
        parent = F.when(k == 4, F.when(F.col("doc_id") % 12 == 4, F.col("doc_id") - 1).otherwise(F.col("doc_id") - 4))
        return self.raw("documents").select(
            "doc_id", F.concat_ws(" ", "lang", "source", "doc_id").alias("title"), kinds.alias("doc_type"), parent.alias("parent_id"),
            F.col("lang").alias("authority"), F.when(F.col("doc_id") % 2 == 0, "cosmetic").otherwise("samd").alias("domain"))

    def document_cells(self) -> DataFrame:
        """doc_id, cell_id: the document's own cell, and the other domain's for each seventh document."""
        own = F.when(F.col("doc_id") % 2 == 0, "cosmetic").otherwise("samd")
        other = F.when(F.col("doc_id") % 2 == 0, "samd").otherwise("cosmetic")
        domains = F.when(F.col("doc_id") % 7 == 0, F.array(own, other)).otherwise(F.array(own))
        return self.raw("documents").select("doc_id", "lang", F.explode(domains).alias("domain")).select("doc_id", F.concat_ws("-", "lang", "domain").alias("cell_id"))

    def versions(self) -> DataFrame:
        """version_id, doc_id, v, language, effective_date, retrieved_at, published_at (epoch seconds), parsed.

        A third of the documents each have one, two and three versions; some middle ones were never parsed, and some third ones are translations.
        """
        k, v = F.col("doc_id"), F.col("v")
        each = self.raw("documents").select("doc_id", F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))).alias("v"))
        retrieved = F.lit(1_704_067_200) + k % 500 * 3600 + v * 30 * 86_400
        return each.select(
            (k * 10 + v).alias("version_id"), "doc_id", "v", F.when((k % 15 == 8) & (v == 3), "translation").otherwise("original").alias("language"),
            F.when(k % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), ((k * 37 + v * 200) % 900).cast("int"))).alias("effective_date"),
            retrieved.alias("retrieved_at"), F.when(k % 5 != 0, retrieved - k % 72 * 3600).alias("published_at"),
            ((k % 13 != 0) & ~((k % 7 == 2) & (v == 2))).alias("parsed"))

    def line_arrays(self) -> DataFrame:
        """doc_id, l: the non-blank trimmed lines of each document."""
        # the characters are named: as a function of two arguments, trim would get a line's index for them and take off its digits
        return self.raw("documents").select("doc_id", F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "").alias("l"))

    def lines(self) -> DataFrame:
        """doc_id, ordinal, text: non-blank trimmed lines."""
        return self.line_arrays().select("doc_id", F.posexplode("l").alias("ordinal", "text"))

    def clauses(self) -> DataFrame:
        """All versions' clauses: doc_id, v, version_id, ordinal, path, kind, heading, text, content_hash, source_ref, moved_to_ref.

        Each version drops, amends, renumbers (with the authority's marks) and moves some clauses of the one before and adds one; some second
        versions are empty, and some third ones keep a third.
        """
        o, k, none = F.col("ordinal"), F.col("doc_id"), F.lit(None).cast("string")
        even = lambda letter: F.when(o % 2 == 0, F.concat(F.lit(letter), o.cast("string")))
        root = F.concat(F.lit("A"), (F.floor(o / 5) + 1).cast("string"))
        path = F.when(o % 5 == 0, root).otherwise(F.concat(root, F.lit("/I"), (o % 5).cast("string")))
        one = self.lines().withColumn("path", path)
        renumbered, fuzzy, amended = o % 13 == 7, o % 29 == 4, o % 11 == 3
        again, moved, revised = o % 23 == 9, o % 31 == 8, o % 10 == 1
        first = one.select("doc_id", F.lit(1).alias("v"), "ordinal", "path", "text", none.alias("source_ref"), F.when((o % 17 != 5) & renumbered, even("M")).alias("moved_to_ref"))
        added = lambda v, n, at, word: self.raw("documents").where(f"doc_id % 3 >= {v - 1}").select(
            "doc_id", F.lit(v).alias("v"), F.lit(n).alias("ordinal"), F.lit(at).alias("path"), F.concat(F.lit(f"{word} "), k.cast("string")).alias("text"), none.alias("source_ref"), none.alias("moved_to_ref"))
        second = one.where((o % 17 != 5) & (k % 3 > 0)).select(
            "doc_id", F.lit(2).alias("v"), "ordinal", F.when(renumbered, F.concat("path", F.lit("R"))).when(fuzzy, F.concat("path", F.lit("F"))).otherwise(F.col("path")).alias("path"),
            F.when(~renumbered & (fuzzy | amended), F.concat("text", F.lit(" AMENDED"))).otherwise(F.col("text")).alias("text"),
            F.when(renumbered, even("M")).alias("source_ref"), F.when((k % 3 == 2) & again, even("N")).alias("moved_to_ref")).unionByName(added(2, 100_000, "A0/NEW", "Inserted"))
        third = second.where((k % 3 == 2) & (o % 19 != 6) & ((k % 17 != 2) | (o % 3 == 0))).select(
            "doc_id", F.lit(3).alias("v"), "ordinal", F.when(again, F.concat("path", F.lit("Q"))).when(moved, F.concat("path", F.lit("G"))).otherwise(F.col("path")).alias("path"),
            F.when(~again & (moved | revised), F.concat("text", F.lit(" REVISED"))).otherwise(F.col("text")).alias("text"), F.when(again, even("N")).alias("source_ref"), none.alias("moved_to_ref"))
        every = first.unionByName(second.where("doc_id % 20 <> 1")).unionByName(third).unionByName(added(3, 100_001, "A0/NEXT", "Appended"))
        return every.select(
            "doc_id", "v", (k * 10 + F.col("v")).alias("version_id"), "ordinal", "path",
            F.when(F.col("path").contains("/"), "item").otherwise("article").alias("kind"),
            F.when(~F.col("path").contains("/"), F.substring("text", 1, 40)).alias("heading"), "text",
            F.sha2("text", 256).alias("content_hash"), "source_ref", "moved_to_ref")

    def tree(self, lines: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
        """First versions as clause trees of all kinds: doc_id, version_id, ordinal, path, parent_ordinal, level, kind, heading, text, labels, columns, effective_date.

        Of twelve lines each, a chapter heads an article with two paragraphs and an item, and a second article; then come a table with two
        rows, a form, and a block of annex prose with an item.
        """
        o = F.col("ordinal")
        c, n, first = (F.floor(o / 12) + 1).cast("string"), o.cast("string"), F.split("text", " ")[0]
        at = lambda *values: F.element_at(F.array(*values), (o % 12 + 1).cast("int"))
        p = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
        chapter, article = p("제", c, "장"), p("제", c, "장/제", (F.floor(o / 12) * 12 + 1).cast("string"), "조")
        path = at(chapter, article, p(article, "/제1항"), p(article, "/제1항/제1호"), p(article, "/제2항"), p(chapter, "/제", n, "조의2"), p("별표", c, "/표1"), p("별표", c, "/표1/행1"), p("별표", c, "/표1/행2"), p("서식", c), p("별표", c, "/문단1"), p("별표", c, "/문단1/제1호"))
        up = at(*(F.lit(x).cast("int") for x in (None, 1, 1, 1, 3, 5, None, 1, 2, None, None, 1)))
        level = at(*map(F.lit, (1, 2, 3, 4, 3, 2, 1, 2, 2, 1, 1, 2)))
        kind = at(*map(F.lit, ("heading", "prose", "prose", "prose", "prose", "prose", "table", "table_row", "table_row", "form", "prose", "prose")))
        heading = F.when((o % 12).isin(0, 1, 6, 9), F.substring("text", 1, 40))
        return (lines or self.lines()).select(
            "doc_id", *more, (F.col("doc_id") * 10 + 1).alias("version_id"), "ordinal", path.alias("path"), (o - up).alias("parent_ordinal"), level.alias("level"), kind.alias("kind"), heading.alias("heading"), "text",
            F.when(kind == "table", F.array(F.lit("연번"), F.lit("원료명"))).alias("labels"), F.when(kind == "table_row", F.create_map(F.lit("연번"), n, F.lit("원료명"), first)).alias("columns"),
            F.when(o % 24 == 1, F.lit("2025-06-01").cast("date")).alias("effective_date"))

    def trees(self) -> DataFrame:
        """The clause trees of all versions: later ones say their number behind each text."""
        k = F.col("doc_id")
        each = self.tree().drop("version_id").withColumn("v", F.explode(F.sequence(F.lit(1), (k % 3 + 1).cast("int"))))
        return self._numbered(each)

    def trees_of(self, scope: DataFrame) -> DataFrame:
        """The clause trees of the versions in ``scope`` (doc_id, version_id and more), with what it says of them: a document's lines become rows for those alone."""
        own = scope.withColumn("v", (F.col("version_id") - F.col("doc_id") * 10).cast("int")).drop("version_id")
        lines = self.line_arrays().join(own, "doc_id").select(*own.columns, F.posexplode("l").alias("ordinal", "text"))
        return self._numbered(self.tree(lines, tuple(c for c in own.columns if c != "doc_id")))

    def _numbered(self, trees: DataFrame) -> DataFrame:
        v = F.col("v")
        return trees.withColumn("version_id", F.col("doc_id") * 10 + v).withColumn("text", F.when(v > 1, F.concat("text", F.lit(" v"), v.cast("string"))).otherwise(F.col("text"))).drop("v")

    def legal_lines(self) -> DataFrame:
        """doc_id, ordinal, line: the lines dressed with statute markers and duties, by ordinal modulo 12."""
        n, t = (F.col("ordinal") + 1).cast("string"), F.col("text")
        dressed = [
            F.concat(F.lit("제"), n, F.lit("장 "), t), F.concat(F.lit("제"), n, F.lit("조(정의) "), t), F.concat(F.lit("① "), t, F.lit(" 하여야 한다")),
            F.concat(F.lit("1. "), t), F.concat(F.lit("가. "), t, F.lit(" 할 수 있다")), F.concat(F.lit("4.1."), n, F.lit(" "), t),
            F.concat(F.lit("2의3) "), t), F.concat(F.lit("IV. "), t), F.concat(F.lit("- "), t),
            F.concat(F.lit("제3조의2 "), t, F.lit(" 총리령으로 정한다")), F.concat(F.lit("가) "), t), t,
        ]
        return self.lines().select("doc_id", "ordinal", F.element_at(F.array(*dressed), (F.col("ordinal") % 12 + 1).cast("int")).alias("line"))


def ref_date() -> Column:
    return F.lit(TODAY).cast("date")


#: The same tables for DuckDB, as common table expressions.
CTES = """
docs AS (SELECT doc_id, lang || ' ' || source || ' ' || doc_id AS title,
  ['law','decree','enforcement_rule','notice','annex','feed'][doc_id % 6 + 1] AS doc_type,
  CASE WHEN doc_id % 6 = 4 THEN CASE WHEN doc_id % 12 = 4 THEN doc_id - 1 ELSE doc_id - 4 END END AS parent_id,
  lang AS authority, CASE WHEN doc_id % 2 = 0 THEN 'cosmetic' ELSE 'samd' END AS domain FROM documents),
doc_cells AS (SELECT doc_id, authority || '-' || domain AS cell_id FROM docs
  UNION ALL SELECT doc_id, authority || '-' || CASE WHEN domain = 'samd' THEN 'cosmetic' ELSE 'samd' END FROM docs WHERE doc_id % 7 = 0),
versions AS (SELECT doc_id * 10 + v AS version_id, doc_id, v, CASE WHEN doc_id % 15 = 8 AND v = 3 THEN 'translation' ELSE 'original' END AS language,
  CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + CAST((doc_id * 37 + v * 200) % 900 AS INTEGER) END AS effective_date,
  1704067200 + doc_id % 500 * 3600 + v * 30 * 86400 AS retrieved_at,
  CASE WHEN doc_id % 5 <> 0 THEN 1704067200 + doc_id % 500 * 3600 + v * 30 * 86400 - doc_id % 72 * 3600 END AS published_at, doc_id % 13 <> 0 AND NOT (doc_id % 7 = 2 AND v = 2) AS parsed
  FROM documents, (VALUES (1), (2), (3)) AS t(v) WHERE v <= doc_id % 3 + 1),
line_lists AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
lines AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS ordinal FROM line_lists),
one AS (SELECT *, 'A' || (ordinal // 5 + 1) || CASE WHEN ordinal % 5 = 0 THEN '' ELSE '/I' || (ordinal % 5) END AS path,
  CASE WHEN ordinal % 2 = 0 THEN 'M' || ordinal END AS mark FROM lines),
second AS (
  SELECT doc_id, ordinal, path || CASE WHEN ordinal % 13 = 7 THEN 'R' WHEN ordinal % 29 = 4 THEN 'F' ELSE '' END AS path,
    CASE WHEN ordinal % 13 <> 7 AND (ordinal % 29 = 4 OR ordinal % 11 = 3) THEN text || ' AMENDED' ELSE text END AS text,
    CASE WHEN ordinal % 13 = 7 THEN mark END AS source_ref, CASE WHEN doc_id % 3 = 2 AND ordinal % 23 = 9 AND ordinal % 2 = 0 THEN 'N' || ordinal END AS moved_to_ref FROM one WHERE ordinal % 17 <> 5 AND doc_id % 3 > 0
  UNION ALL SELECT doc_id, 100000, 'A0/NEW', 'Inserted ' || doc_id, NULL, NULL FROM documents WHERE doc_id % 3 > 0),
bare AS (
  SELECT doc_id, 1 AS v, ordinal, path, text, NULL AS source_ref, CASE WHEN ordinal % 17 <> 5 AND ordinal % 13 = 7 THEN mark END AS moved_to_ref FROM one
  UNION ALL SELECT doc_id, 2, ordinal, path, text, source_ref, moved_to_ref FROM second WHERE doc_id % 20 <> 1
  UNION ALL SELECT doc_id, 3, ordinal, path || CASE WHEN ordinal % 23 = 9 THEN 'Q' WHEN ordinal % 31 = 8 THEN 'G' ELSE '' END,
    CASE WHEN ordinal % 23 <> 9 AND (ordinal % 31 = 8 OR ordinal % 10 = 1) THEN text || ' REVISED' ELSE text END,
    CASE WHEN ordinal % 23 = 9 AND ordinal % 2 = 0 THEN 'N' || ordinal END, NULL FROM second WHERE doc_id % 3 = 2 AND ordinal % 19 <> 6 AND (doc_id % 17 <> 2 OR ordinal % 3 = 0)
  UNION ALL SELECT doc_id, 3, 100001, 'A0/NEXT', 'Appended ' || doc_id, NULL, NULL FROM documents WHERE doc_id % 3 = 2),
clauses AS (SELECT doc_id, v, doc_id * 10 + v AS version_id, ordinal, path, CASE WHEN contains(path, '/') THEN 'item' ELSE 'article' END AS kind,
  CASE WHEN NOT contains(path, '/') THEN substr(text, 1, 40) END AS heading, text, sha256(text) AS content_hash, source_ref, moved_to_ref FROM bare),
tree AS (SELECT doc_id, doc_id * 10 + 1 AS version_id, ordinal, CASE ordinal % 12 WHEN 0 THEN ch WHEN 1 THEN ar WHEN 2 THEN ar || '/제1항' WHEN 3 THEN ar || '/제1항/제1호' WHEN 4 THEN ar || '/제2항' WHEN 5 THEN ch || '/제' || ordinal || '조의2' WHEN 6 THEN '별표' || c || '/표1' WHEN 7 THEN '별표' || c || '/표1/행1'
    WHEN 8 THEN '별표' || c || '/표1/행2' WHEN 9 THEN '서식' || c WHEN 10 THEN '별표' || c || '/문단1' ELSE '별표' || c || '/문단1/제1호' END AS path,
  ordinal - [NULL, 1, 1, 1, 3, 5, NULL, 1, 2, NULL, NULL, 1][ordinal % 12 + 1] AS parent_ordinal, ['heading', 'prose', 'prose', 'prose', 'prose', 'prose', 'table', 'table_row', 'table_row', 'form', 'prose', 'prose'][ordinal % 12 + 1] AS kind,
  CASE WHEN ordinal % 12 IN (0, 1, 6, 9) THEN substr(text, 1, 40) END AS heading, text, string_split(text, ' ')[1] AS first, CASE WHEN ordinal % 24 = 1 THEN DATE '2025-06-01' END AS effective_date
  FROM (SELECT *, ordinal // 12 + 1 AS c, '제' || (ordinal // 12 + 1) || '장' AS ch, '제' || (ordinal // 12 + 1) || '장/제' || (ordinal // 12 * 12 + 1) || '조' AS ar FROM lines)),
trees AS (SELECT doc_id, doc_id * 10 + v AS version_id, ordinal, path, parent_ordinal, kind, heading, CASE WHEN v > 1 THEN text || ' v' || v ELSE text END AS text, first, effective_date FROM tree, (VALUES (1), (2), (3)) AS n(v) WHERE v <= doc_id % 3 + 1),
legal AS (SELECT doc_id, ordinal, CASE ordinal % 12 WHEN 0 THEN '제' || (ordinal + 1) || '장 ' || text WHEN 1 THEN '제' || (ordinal + 1) || '조(정의) ' || text
  WHEN 2 THEN '① ' || text || ' 하여야 한다' WHEN 3 THEN '1. ' || text WHEN 4 THEN '가. ' || text || ' 할 수 있다' WHEN 5 THEN '4.1.' || (ordinal + 1) || ' ' || text
  WHEN 6 THEN '2의3) ' || text WHEN 7 THEN 'IV. ' || text WHEN 8 THEN '- ' || text WHEN 9 THEN '제3조의2 ' || text || ' 총리령으로 정한다'
  WHEN 10 THEN '가) ' || text ELSE text END AS line FROM lines)
"""


def sql(body: str, more: str = "") -> str:
    """An oracle query: the domain tables, further tables of its own, and its body."""
    return f"WITH {CTES.strip()}{(',' + more) if more else ''}\n{body.strip()}"
