"""Clause trees of legal text, as windows over marked rows of a document.

A document's rows carry a level; a row belongs below the last row before it with a smaller level that no other such
row has closed.  The rows still open are found by running maxima, one for each level, in one sort by document; no row is
gathered with others, and the same rule reads outlines of text (``legal``) and the elements of statutes (``statute``).
Outlines that invent their own ladder (``discovered``) depend on every marker before, so their markers, and nothing
else of a document, are walked in one small task for each document.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators import texts as x

#: Parts of a dotted number that nest.
DOTTED_PARTS = 16
LEVELS = [10 + d for d in x.CHAPTER_DEPTH.values()] + [20, 30, *(40 + d for d in range(1, DOTTED_PARTS + 1)), 60, 70, 80, 90]


def legal_level(style: Column, depth: Column) -> Column:
    """Rank, then depth inside chapters and dotted numbers, as one number."""
    rank = F.create_map(*(v for k, r in x.RANKS.items() for v in (F.lit(k), F.lit(r))))[style]
    return (
        F.when(style == "chapter", 10 + depth).when(style.isin("article", "roman_dot"), 20).when(style == "circled", 30)
        .when(rank == x.RANKS["dotted"], 40 + F.least(depth, F.lit(DOTTED_PARTS))).when(style == "hangul_dot", 60).when(style == "digit_paren", 70).when(style == "hangul_paren", 80).when(style == "bullet", 90))


def nested(rows: DataFrame, levels: list[int], key: str = "doc_id", order: str = "place") -> DataFrame:
    """``rows`` with ``above``: (place, segment) of the rows that are open when a row's level comes, outermost first.

    Rows without a level see all that is open and close nothing.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == n, F.struct(F.col(order).alias("place"), F.col("segment").alias("segment")))).over(w).alias(f"__{n}") for n in levels]
    seen = rows.select("*", *last)
    open_, newest = [], F.lit(None).cast(rows.schema[order].dataType)
    for n in levels:
        at = F.col(f"__{n}.place")
        inside = F.col("level").isNull() | (F.lit(n) < F.col("level"))
        open_.append(F.when(inside & at.isNotNull() & (newest.isNull() | (at > newest)), F.col(f"__{n}")))
        newest = F.greatest(newest, at)
    return seen.withColumn("above", F.array_compact(F.array(*open_))).drop(*(f"__{n}" for n in levels))


def marked_lines(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, place, line, style, depth, segment, heading: physical lines (key, ordinal, line), broken before paragraph marks."""
    pieces = F.split(F.regexp_replace("line", rf"(?<=\S)\s+(?=[{x.CIRCLED}])", "\n"), "\n", -1)
    each = lines.select(key, "ordinal", F.posexplode(pieces).alias("piece", "line")).where((F.col("piece") == 0) | (F.trim("line") != ""))
    line = F.col("line")
    return each.select(
        key, F.struct("ordinal", "piece").alias("place"), "line", x.marker_style(line).alias("style"), x.marker_depth(line).alias("depth"), x.marker_segment(line).alias("segment"), x.marker_heading(line).alias("heading"))


def lines_of(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    return texts.select(key, F.posexplode(F.split(x.normalize_text(F.col("text")), "\n", -1)).alias("ordinal", "line"))


def disambiguated(clauses: DataFrame, key: str = "doc_id", order: str = "place") -> DataFrame:
    """The N-th repeat of a path inside a document is called ``path~N``."""
    k = F.row_number().over(Window.partitionBy(key, "path").orderBy(order))
    return clauses.withColumn("__k", k).withColumn("path", F.when(F.col("__k") > 1, F.concat("path", F.lit("~"), F.col("__k").cast("string"))).otherwise(F.col("path"))).drop("__k")


def numbered_bullets(rows: DataFrame, key: str = "doc_id", order: str = "place") -> DataFrame:
    """Rows (with ``above``) whose empty segments are replaced by ``-k``: the k-th row below its parent's path."""
    parent = F.array_join(F.filter("above.segment", lambda s: s.isNotNull()), "/")
    k = F.row_number().over(Window.partitionBy(key, "__parent").orderBy(order))
    return rows.withColumn("__parent", parent).withColumn("segment", F.when(F.col("segment") == "", F.concat(F.lit("-"), k.cast("string"))).otherwise(F.col("segment"))).drop("__parent")


def _with_text(clauses: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    """Each clause's own line and the unmarked ones behind it, as they stand."""
    owner = F.max(F.when(F.col("style").isNotNull(), F.col("place"))).over(Window.partitionBy(key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    owned = lines.withColumn("owner", owner).where("owner IS NOT NULL")
    # the line that opens a clause stands without its indent
    kept = F.when(F.col("style").isNotNull(), F.trim("line")).otherwise(F.col("line"))
    text = owned.groupBy(key, F.col("owner").alias("place")).agg(F.sort_array(F.collect_list(F.struct(F.col("place").alias("at"), kept.alias("line")))).alias("l"))
    return clauses.join(text.select(key, "place", x.normalize_text(F.array_join("l.line", "\n")).alias("text")), [key, "place"])


CLAUSE = ("place", "path", "level", "kind", "heading", "parent", "text")


def _clauses(rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    kind = F.when(F.col("style") == "chapter", "heading").otherwise("prose")
    out = rows.select(key, "place", F.array_join(F.concat(F.col("above.segment"), F.array("segment")), "/").alias("path"), (F.size("above") + 1).alias("level"), kind.alias("kind"), "heading", F.try_element_at("above.place", F.lit(-1)).alias("parent"))
    return _with_text(out, lines, key).select(key, *CLAUSE)


def legal(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clauses of each document's lines (key, ordinal, line) on the fixed ladder from chapters to bullets."""
    marked = marked_lines(lines, key)
    rows = marked.where("style IS NOT NULL").withColumn("level", legal_level(F.col("style"), F.col("depth")))
    return _clauses(numbered_bullets(nested(rows, LEVELS, key), key), marked, key)


def discovered(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Clauses on the ladder that a document's styles make by first appearance: a style that is open is a sibling, and
    closes from its shallowest entry on; dotted numbers close what has as many parts or more."""
    marked = marked_lines(lines, key)
    rows = marked.where("style IS NOT NULL").select(key, "place", "style", "depth", "segment", "heading")
    kind = rows.schema[key].dataType.simpleString()

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ordinal", "piece"])
        open_: list[tuple[str, int, int]] = []  # style, depth, row
        above, segments, below = [], [], {}
        for row, (style, depth, segment) in enumerate(zip(frame["style"], frame["depth"], frame["segment"])):
            closes = (k for k, (s, d, _) in enumerate(open_) if s == style and (style != "dotted" or d >= depth))
            del open_[next(closes, len(open_)) :]
            path = tuple(segments[r] for _, _, r in open_)
            below[path] = below.get(path, 0) + 1
            above.append([r for _, _, r in open_])
            segments.append(segment or f"-{below[path]}")
            open_.append((style, depth, row))
        ordinal, piece = frame["ordinal"].tolist(), frame["piece"].tolist()
        stacks = [[{"place": {"ordinal": ordinal[r], "piece": piece[r]}, "segment": segments[r]} for r in rs] for rs in above]
        return frame.assign(segment=segments, above=stacks)[[key, "ordinal", "piece", "segment", "above"]]

    walked = rows.select(key, "place.ordinal", "place.piece", "style", "depth", "segment").groupBy(key).applyInPandas(
        walk, f"{key} {kind}, ordinal int, piece int, segment string, above array<struct<place:struct<ordinal:int,piece:int>,segment:string>>")
    placed = walked.select(key, F.struct("ordinal", "piece").alias("place"), "segment", "above").join(rows.select(key, "place", "style", "heading"), [key, "place"])
    return _clauses(placed, marked, key)


# ---------------------------------------------------------------- statutes

#: Levels of a statute's elements: chapters by depth, then article, paragraph, item and sub-item.
STATUTE_LEVELS = [*x.CHAPTER_DEPTH.values(), 10, 20, 30, 40]


def statute(elements: DataFrame) -> DataFrame:
    """doc_id, place, path, level, kind, heading, source_ref, moved_to_ref, changed, clause_date, text of the units of statutes.

    ``elements`` are rows of ``sources.markup.xml_elements``.  An unnumbered paragraph adds no segment, a sub-item
    belongs to the item before it, and branches stand behind the unit they branch from.
    """
    fields = ("조문여부", "조문번호", "조문가지번호", "조문제목", "조문내용", "조문시행일자", "조문이동이전", "조문이동이후", "조문변경여부", "항번호", "항내용", "호번호", "호내용", "목번호", "목내용")
    values = elements.where(F.col("tag").isin(*fields)).groupBy("doc_id", F.col("parent").alias("place")).agg(
        *(F.max(F.when(F.col("tag") == f, x.normalize_text(F.col("text")))).alias(f) for f in fields))
    units = elements.where(F.col("tag").isin("조문단위", "항", "호", "목")).select("doc_id", "place", "tag", F.col("key").alias("source_ref")).join(values, ["doc_id", "place"], "left")
    value = lambda name: F.coalesce(F.col(name), F.lit(""))
    is_chapter = (F.col("tag") == "조문단위") & (value("조문여부") == "전문")
    content = value("조문내용")
    kept = units.where((~is_chapter | (x.marker_style(content) == "chapter")) & ((F.col("tag") != "조문단위") | is_chapter | (value("조문번호") != "")))
    rows = kept.withColumn("level", F.when(is_chapter, x.marker_depth(content)).when(F.col("tag") == "조문단위", 10).when(F.col("tag") == "항", 20).when(F.col("tag") == "호", 30).otherwise(40)).withColumn(
        "segment", F.when(is_chapter, x.marker_segment(content)).when(F.col("tag") == "조문단위", x.article_segment(value("조문번호"), value("조문가지번호")))
        .when(F.col("tag") == "항", x.paragraph_segment(value("항번호"))).when(F.col("tag") == "호", x.item_segment(value("호번호"))).otherwise(x.subitem_segment(value("목번호"))))
    placed = nested(rows, STATUTE_LEVELS).where("segment IS NOT NULL")
    path = F.concat(F.filter("above.segment", lambda s: s.isNotNull()), F.array("segment"))
    text = F.when(F.col("tag") == "조문단위", content).when(F.col("tag") == "항", value("항내용")).when(F.col("tag") == "호", value("호내용")).otherwise(value("목내용"))
    heading = F.when(is_chapter, F.coalesce(x.marker_heading(content), content)).otherwise(F.nullif(value("조문제목"), F.lit("")))
    return placed.select(
        "doc_id", "place", F.array_join(path, "/").alias("path"), F.size(path).alias("level"), F.when(is_chapter, "heading").otherwise("prose").alias("kind"), heading.alias("heading"), "source_ref",
        x.filler_to_null(F.col("조문이동이후")).alias("moved_to_ref"), x.yes_no(F.col("조문변경여부")).alias("changed"), x.authority_date(F.col("조문시행일자")).alias("clause_date"), text.alias("text"))


def rule_lines(elements: DataFrame) -> DataFrame:
    """doc_id, ordinal, line: the body of administrative rules, which is every content element outside annexes, in order."""
    blobs = elements.where((F.col("tag") == "조문내용") & ~F.array_contains("path", "별표단위")).select("doc_id", "place", x.normalize_text(F.coalesce("text", F.lit(""))).alias("blob")).where("blob <> ''")
    text = blobs.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("place", "blob")))["blob"], "\n").alias("text"))
    return lines_of(text)


# The parser profile of each kind of document; a feed has none, since it holds no clauses.
PROFILES = {"law": "law_structured", "decree": "law_structured", "enforcement_rule": "law_structured", "notice": "admrul_text", "annex": "annex"}


def profile(doc_type: Column) -> Column:
    """The profile a document is parsed by; null where it is not parseable."""
    return F.try_element_at(F.create_map(*(v for k, p in PROFILES.items() for v in (F.lit(k), F.lit(p)))), doc_type)
