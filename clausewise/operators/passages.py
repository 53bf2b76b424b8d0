"""Passages: what of a clause tree is embedded as one text, how long texts are cut, and how an index follows them.

Clauses are rows (doc_id, version_id, ordinal, level, path, kind, heading, text, labels) in reading order; ancestors are
found by the windows of ``operators.outline``, once for roots, headers and blocks alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.constants import MAX_PASSAGE_CHARS
from clausewise.operators.outline import nested

#: Levels of a tree that are looked at.
DEPTH = 32
LABEL_CHARS = 120


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def lines_joined(*parts: Column) -> Column:
    """The parts that are not blank, stripped, a line each."""
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda p: strip(F.coalesce(p, F.lit("")))), lambda p: p != ""), "\n")


def is_root(kind: Column, parent_kind: Column) -> Column:
    """Rows and headings never start a passage, tables and forms always do, prose does unless it hangs off prose."""
    return F.when(kind.isin("table_row", "heading"), False).when(kind.isin("table", "form"), True).otherwise(parent_kind.isNull() | (parent_kind != "prose"))


def rooted(clauses: DataFrame) -> DataFrame:
    """Clauses with root and root_ordinal (the nearest at or above; null for rows and headings), block (the root's child it lies in) and trail."""
    label = F.split(strip(F.coalesce(F.nullif(F.col("heading"), F.lit("")), "text", F.lit(""))), "\n")[0]
    rows = clauses.withColumn("segment", F.struct("kind", "path", F.substring(label, 1, LABEL_CHARS).alias("label"))).withColumnRenamed("ordinal", "place")
    placed = nested(rows, list(range(1, DEPTH + 1)), "version_id")
    kinds = F.col("above.segment.kind")
    parent = F.try_element_at(kinds, F.lit(-1))
    # indices of the ancestors that are roots themselves
    marks = F.filter(F.transform(kinds, lambda k, i: F.when(is_root(k, F.get(kinds, i - 1)), i)), lambda i: i.isNotNull())
    out = placed.withColumn("self", is_root(F.col("kind"), parent)).withColumn("at", F.try_element_at(marks, F.lit(-1)))
    below = F.slice("above", F.col("at") + 1, F.size("above"))
    sound = (F.col("kind") != "table_row") & F.col("at").isNotNull() & ~F.exists(below["segment"]["kind"], lambda k: k == "table_row")
    nearest = F.get("above", F.col("at"))
    root = F.when(F.col("self"), F.col("path")).when(sound, nearest["segment"]["path"])
    root_place = F.when(F.col("self"), F.col("place")).when(sound, nearest["place"])
    block = F.when(~F.col("self") & sound, F.coalesce(F.get("above", F.col("at") + 1)["place"], F.col("place")))
    trail = F.filter(F.col("above.segment.label"), lambda s: s != "")
    return out.select(*[F.col("place").alias(c) if c == "ordinal" else F.col(c) for c in clauses.columns], root.alias("root"), root_place.alias("root_ordinal"), block.alias("block"), trail.alias("trail"))


def rendered(is_own: Column) -> Column:
    """A clause as a line: heading and text, behind its own address unless it is the root."""
    body = lines_joined(F.col("heading"), F.col("text"))
    return F.when(is_own | (body == ""), body).otherwise(F.concat(F.element_at(F.split("path", "/"), -1), F.lit(" "), body))


def assembled(clauses: DataFrame, titles: DataFrame) -> DataFrame:
    """version_id, root, scope, header, own (header and the root's text), blocks (text and paths of the root's children), one row for each root."""
    rows = rooted(clauses).where("root IS NOT NULL").join(titles.select("doc_id", "title"), "doc_id")
    own = F.col("ordinal") == F.col("root_ordinal")
    header = F.concat_ws("\n", F.nullif(F.array_join(F.concat(F.array_compact(F.array(F.nullif("title", F.lit("")))), "trail"), " > "), F.lit("")), "path")
    line = F.struct("ordinal", rendered(own).alias("text"), "path")
    by_block = rows.groupBy("doc_id", "version_id", "root_ordinal", "block").agg(
        F.sort_array(F.collect_list(line)).alias("l"), F.max(F.when(own, F.struct("root", "kind", header.alias("header"), lines_joined(F.col("heading"), F.col("text"), F.array_join(F.filter("labels", lambda s: strip(s) != ""), " | ")).alias("table_text")))).alias("own"))
    text = F.array_join(F.filter("l.text", lambda s: s != ""), "\n")
    block = F.when(F.col("block").isNotNull() & (text != ""), F.struct("block", text.alias("text"), F.col("l.path").alias("paths")))
    by_root = by_block.groupBy("doc_id", "version_id", "root_ordinal").agg(F.max("own").alias("own"), F.max(F.when(F.col("block").isNull(), text)).alias("text"), F.sort_array(F.collect_list(block)).alias("blocks"))
    is_table = F.col("own.kind") == "table"
    scope = F.when(is_table, "table_header").when(F.col("own.kind") == "form", "form").otherwise("article")
    return by_root.select(
        "doc_id", "version_id", F.col("own.root").alias("root"), scope.alias("scope"), F.col("own.header").alias("header"), lines_joined(F.col("own.header"), F.when(is_table, F.col("own.table_text")).otherwise(F.col("text"))).alias("own"),
        F.when(is_table, F.array().cast("array<struct<text:string,paths:array<string>>>")).otherwise(F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["paths"].alias("paths")))).alias("blocks"))


def packed(own: str, blocks: list[tuple[str, list[str]]], cap: int) -> list[list[tuple[str, list[str]]]]:
    """Blocks in their order, so many to a piece that the piece and the root's own text keep to the cap; a longer block stands alone."""
    pieces: list[list[tuple[str, list[str]]]] = []
    size = 0
    for block in blocks:
        if not pieces or size + len(block[0]) > cap:
            pieces.append([])
            size = len(own)
        pieces[-1].append(block)
        size += len(block[0]) + 1
    return pieces


def cut(text: str, header: str, cap: int) -> list[str]:
    """A text over the cap in pieces that each repeat its header: at lines where it can be, else at characters."""
    if len(text) <= cap:
        return [text]
    room = max(cap - len(header) - 1, cap // 4)
    body = text[len(header) :].lstrip("\n") if text.startswith(header) else text
    pieces, held = [], ""
    for line in body.split("\n"):
        full = len(line) // room * room if len(line) > room else 0
        if full == len(line) and full:
            full -= room  # the last part of a long line may be joined by what follows
        if full and held:
            pieces.append(held)
            held = ""
        pieces += [line[k : k + room] for k in range(0, full, room)]
        rest = line[full:]
        if held and len(held) + 1 + len(rest) > room:
            pieces.append(held)
            held = rest
        else:
            held = f"{held}\n{rest}" if held else rest
    return [f"{header}\n{p.strip()}" for p in [*pieces, held] if p.strip()]


FRAGMENT = "version_id long, root string, scope string, fragment_index int, text string, paths array<string>"


def fragments(passages: DataFrame, cap: int = MAX_PASSAGE_CHARS) -> DataFrame:
    """The texts to embed: a passage as a whole, or cut at its child blocks, and never longer than the cap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                blocks = [(b["text"], list(b["paths"])) for b in r.blocks]
                whole = "\n".join([r.own, *(text for text, _ in blocks)])
                split = len(whole) > cap and blocks
                pieces = packed(r.own, blocks, cap) if split else [blocks]
                texts = [("\n".join([r.own, *(text for text, _ in piece)]), [r.root, *(p for _, paths in piece for p in paths)]) for piece in pieces]
                short = [(bit, paths) for text, paths in texts for bit in cut(text, r.header, cap)]
                out += [(r.version_id, r.root, "article_fragment" if split else r.scope, k, text, paths) for k, (text, paths) in enumerate(short)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in FRAGMENT.split(", ")])

    return passages.select("version_id", "root", "scope", "header", "own", "blocks").mapInPandas(run, FRAGMENT)


# ---------------------------------------------------------------- the index

KEY = ["version_id", "root", "fragment_index"]


def index_actions(now: DataFrame, index: DataFrame, model: str, passage_version: int) -> DataFrame:
    """Fragments (KEY, content_hash) with action: reuse what the index holds of the same hash, model and passage rules, else embed."""
    held = index.select(*KEY, F.col("content_hash").alias("__hash"), ((F.col("model") == model) & (F.col("passage_version") == passage_version)).alias("__current"))
    same = F.col("__current") & (F.col("__hash") == F.col("content_hash"))
    return now.join(held, KEY, "left").withColumn("action", F.when(same, "reuse").otherwise("embed")).drop("__hash", "__current")


def pruned(index: DataFrame, now: DataFrame) -> DataFrame:
    """Index rows of the versions in ``now`` whose fragment is no longer produced."""
    return index.join(now.select("version_id").distinct(), "version_id", "left_semi").join(now.select(*KEY), KEY, "left_anti")


def stale_versions(versions: DataFrame, documents: DataFrame, index: DataFrame, model: str, passage_version: int, limit: int = 1000) -> DataFrame:
    """Parsed versions, feeds apart, without any index row or with one of another model or other rules; newest first."""
    other = index.groupBy("version_id").agg(F.bool_or((F.col("model") != model) | (F.col("passage_version") != passage_version)).alias("other"))
    parsed = versions.where("parsed").join(documents.where("doc_type <> 'feed'").select("doc_id"), "doc_id", "left_semi")
    return parsed.join(other, "version_id", "left").where(F.col("other").isNull() | F.col("other")).orderBy(F.desc("retrieved_at"), "version_id").limit(limit)


def index_coverage(versions: DataFrame, cells: DataFrame, index: DataFrame) -> DataFrame:
    """cell_id, versions (parsed), indexed (with an index row)."""
    held = index.select("version_id").distinct().withColumn("held", F.lit(True))
    return versions.where("parsed").join(cells, "doc_id").join(held, "version_id", "left").groupBy("cell_id").agg(
        F.countDistinct("version_id").alias("versions"), F.countDistinct(F.when(F.col("held"), F.col("version_id"))).alias("indexed"))
