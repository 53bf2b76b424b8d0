"""Annexes: box-drawing tables and the prose around them, as clauses.

Lines take their role from their own characters; tables and their rows are running counts of roles, cells are grouped by
(table, row, column), and only a cell's own slices meet in a function.  Prose between tables is read by the
discovered ladder, one text for each block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.functions import joined_cell, nfc
from clausewise.operators import outline
from clausewise.operators import texts as x

# Characters that draw rules, and those that separate cells (partial rules inside a row do both).
RULE = "┌┬┐├┼┤└┴┘─━┏┳┓┣╋┫┗┻┛"
VERTICAL = "│┃|├┼┤┣╋┫"
#: Kinds of annexes that are blank forms: their boxes are layout.
FORM_KINDS = ("서식", "별지")


def line_role(line: Column) -> Column:
    """top, mid or bottom of a table, another rule, cells, prose, or blank."""
    s = F.trim(line)
    rule = s.rlike(rf"^[{RULE} 　]+$") & s.contains("─")
    first = F.substring(s, 1, 1)
    return (
        F.when(s == "", "blank").when(rule, F.when(first.isin("┌", "┏"), "top").when(first.isin("├", "┣"), "mid").when(first.isin("└", "┗"), "bottom").otherwise("rule"))
        .when(s.rlike(rf"[{VERTICAL}]"), "cells").otherwise("prose"))


def split_cells(line: Column) -> Column:
    """Slices of a line between separators, padding and all; a slice that draws a rule is null; the frame's edges go."""
    parts = F.split(line, rf"[{VERTICAL}]", -1)
    head = F.when((F.size(parts) > 0) & (F.trim(parts[0]) == ""), 2).otherwise(1)
    size = F.size(parts) - head + 1
    tail = F.when((size > 0) & (F.trim(F.try_element_at(parts, F.lit(-1))) == ""), size - 1).otherwise(size)
    return F.transform(F.slice(parts, head, F.greatest(tail, F.lit(0))), lambda c: F.when(~F.trim(c).rlike(rf"^[{RULE}]+$"), c))


def scanned(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines (key, ordinal, line) with role, table (0 before the first), inside (from a top to its bottom), row (boundaries before)."""
    w = Window.partitionBy(key).orderBy("ordinal")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    roled = lines.select(key, "ordinal", "line", line_role(F.col("line")).alias("role")).withColumn("table", F.count_if(F.col("role") == "top").over(upto))
    inner = Window.partitionBy(key, "table").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key, "table")
    boundary = F.col("role").isin("mid", "bottom", "rule", "prose")
    closed = roled.withColumn("closed", F.coalesce(F.count_if(F.col("role") == "bottom").over(inner), F.lit(0)) > 0).withColumn("inside", (F.col("table") > 0) & ~F.col("closed"))
    return closed.withColumn("row", F.coalesce(F.count_if(boundary & F.col("inside")).over(inner), F.lit(0))).withColumn("rows", F.count_if(boundary & F.col("inside")).over(whole)).drop("closed")


def table_rows(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start (line of the table's top), row (0 is the header), cells: the logical rows of each table, blank ones left out.

    Lines that no boundary follows inside their table belong to no row.
    """
    seen = scanned(lines, key)
    start = F.min("ordinal").over(Window.partitionBy(key, "table"))
    cells = seen.withColumn("start", start).where((F.col("role") == "cells") & F.col("inside") & (F.col("row") < F.col("rows"))).select(key, "start", "row", "ordinal", F.posexplode(split_cells(F.col("line"))).alias("at", "cell"))
    fragments = cells.groupBy(key, "start", "row", "at").agg(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "cell"))), lambda c: c["cell"]).alias("fragments"))
    values = fragments.select(key, "start", "row", "at", joined_cell("fragments").alias("value"))
    by_row = values.groupBy(key, "start", "row").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("m"), F.max("at").alias("last"))
    dense = by_row.select(key, "start", "row", F.transform(F.sequence(F.lit(0), F.col("last")), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(""))).alias("cells")).where(F.exists("cells", lambda c: F.trim(c) != ""))
    return dense.withColumn("row", F.row_number().over(Window.partitionBy(key, "start").orderBy("row")) - 1)


def tables(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, table (from 1), row (from 1), header, columns (map of label to value) of each table's rows; row 0 has the header alone."""
    rows = table_rows(lines, key)
    label = x.normalized_label(F.col("cell"))
    heads = rows.where("row = 0").select(key, "start", F.posexplode("cells").alias("at", "cell")).select(key, "start", "at", nfc(label).alias("label")).groupBy(key, "start").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("header"))
    numbered = heads.withColumn("table", F.row_number().over(Window.partitionBy(key).orderBy("start")))
    return rows.join(numbered, [key, "start"]).select(key, "start", "table", "row", "header", F.when(F.col("row") > 0, x.zipped_row(F.col("header"), F.col("cells"))).alias("columns"))


CLAUSE = ("place", "path", "kind", "heading", "text", "labels", "columns")


def annex_clauses(annexes: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ordinal, path, kind, heading, text, labels (of a table), columns (of a row) of annexes (key, segment, kind, title, content).

    A form is one clause.  Without tables the prose stands below the annex; with them its blocks are ``문단k``, tables
    ``표k`` and their rows ``행k``.  Text before the first marker is the preamble.
    """
    body = annexes.withColumn("content", x.normalize_text(F.coalesce("content", F.lit("")))).where("content <> ''")
    none = {"labels": F.lit(None).cast("array<string>"), "columns": F.lit(None).cast("map<string,string>")}
    place = lambda ordinal, piece: F.struct(F.col(ordinal).alias("ordinal"), piece.alias("piece"))
    is_form = F.col("kind").isin(*FORM_KINDS)
    forms = body.where(is_form).select(key, F.struct(F.lit(0).alias("ordinal"), F.lit(0).alias("piece")).alias("place"), F.col("segment").alias("path"), F.lit("form").alias("kind"), F.nullif(F.col("title"), F.lit("")).alias("heading"), F.col("content").alias("text"), *(v.alias(k) for k, v in none.items()))
    rest = body.where(~is_form)
    lines = rest.select(key, F.posexplode(F.split("content", "\n", -1)).alias("ordinal", "line"))
    found = tables(lines, key)
    named = found.join(rest.select(key, "segment"), key)
    labels = F.array_join("header", " | ")
    table_path = F.concat(F.col("segment"), F.lit("/표"), F.col("table").cast("string"))
    heads = named.where("row = 0").select(key, place("start", F.lit(0)).alias("place"), table_path.alias("path"), F.lit("table").alias("kind"), F.nullif(labels, F.lit("")).alias("heading"), labels.alias("text"), F.col("header").alias("labels"), none["columns"].alias("columns"))
    rows = named.where("row > 0").select(key, place("start", F.col("row")).alias("place"), F.concat(table_path, F.lit("/행"), F.col("row").cast("string")).alias("path"), F.lit("table_row").alias("kind"), F.lit(None).cast("string").alias("heading"), x.rendered_row(F.col("columns")).alias("text"), none["labels"].alias("labels"), "columns")
    # prose: what lies outside the tables that have a header, in blocks numbered by the tables before
    starts = found.where("row = 0").select(key, "start", F.col("table").alias("number"))
    seen = scanned(lines, key).withColumn("start", F.min("ordinal").over(Window.partitionBy(key, "table")))
    marked = seen.join(starts, [key, "start"], "left").withColumn("before", F.coalesce(F.max("number").over(Window.partitionBy(key).orderBy("ordinal")), F.lit(0)))
    prose = marked.where(F.col("number").isNull() | ~F.col("inside"))
    tabled = starts.groupBy(key).agg(F.lit(True).alias("tabled"))
    block = prose.join(tabled, key, "left").withColumn("block", F.struct(key, F.when(F.col("tabled"), F.col("before") + 1).otherwise(0).alias("n"))).select("block", "ordinal", "line")
    in_block = Window.partitionBy("block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    led = block.withColumn("led", F.count_if(x.marker_style(F.col("line")).isNotNull()).over(in_block))
    preamble = led.where("led = 0").groupBy("block").agg(F.min("ordinal").alias("ordinal"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "line"))), lambda s: s["line"]), "\n").alias("text"))
    outlined = led.groupBy("block").agg((F.max("led") > 0).alias("outlined"))
    segments = rest.select(F.col(key), "segment")
    prefix = F.when(F.col("block.n") > 0, F.concat(F.col("segment"), F.lit("/문단"), F.col("block.n").cast("string"))).otherwise(F.col("segment"))
    prose_only = {"kind": F.lit("prose"), "heading": F.lit(None).cast("string")}
    pre = preamble.join(outlined, "block").withColumn(key, F.col(f"block.{key}")).join(segments, key).where("trim(text) <> ''").select(
        key, place("ordinal", F.lit(-1)).alias("place"), F.when(F.col("outlined") & (F.col("block.n") == 0), F.concat(prefix, F.lit("/서문"))).otherwise(prefix).alias("path"), *(v.alias(k) for k, v in prose_only.items()), x.normalize_text(F.col("text")).alias("text"), *(v.alias(k) for k, v in none.items()))
    tree = outline.discovered(led.where("led > 0").select("block", "ordinal", "line"), "block").withColumn(key, F.col(f"block.{key}")).join(segments, key).select(
        key, "place", F.concat(prefix, F.lit("/"), F.col("path")).alias("path"), "kind", "heading", "text", *(v.alias(k) for k, v in none.items()))
    every = [f.select(key, *CLAUSE) for f in (forms, heads, rows, pre, tree)]
    union = every[0]
    for f in every[1:]:
        union = union.unionByName(f)
    out = outline.disambiguated(union, key)
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("place")) - 1).drop("place")
