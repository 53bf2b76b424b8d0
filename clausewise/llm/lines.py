"""Line dedup by a fixed-depth tree of log templates.

Every line that is not blank goes down the tree by its number of tokens and its two leading tokens, tokens with
digits standing as one placeholder.  Tokens are separated by blanks; in scripts that write without blanks each
character is one.  At the leaf it belongs to templates:
the line as it reads with placeholders, and, for lines of at least ``WIDE_TOKENS`` tokens, four generalised
ones, in each of which one quarter of the tokens is a free field (the leading tokens never are).  So lines that
differ in numbers, or inside one quarter, meet in a template, and a template is a 64-bit key.
A line with fewer than ``LITERALS`` plain tokens (all of them, where it has fewer tokens) has little to tell it by, so it
stands as it reads: rows of numbers recur only where their numbers do.  So does a generalised template without its field.

A template that occurs in at least ``MIN_DOCS`` documents recurs, one of a line under ``MIN_TOKENS`` tokens in at
least ``SHORT_MIN_DOCS``, since two documents share a short line by chance; its lines are dropped from every document
but the first (the smallest doc_id), so no content disappears altogether.  Template counts are partial sums of
fixed-size rows, a line of a third of all documents is one row per task, and lines join the recurring keys only.

Edge cases: null texts stay null; empty texts and blank lines are left alone; a line
repeated inside one document only is left alone; a document of which nothing but blank lines remains is
dropped; rows of one doc_id count as one document; no row, no result; other columns stay as they are, whatever
their names; a text of any length is split line by line, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize, small_side

MIN_TOKENS = 6
WIDE_TOKENS = 12
MIN_DOCS = 2
SHORT_MIN_DOCS = 3
FIELDS = 4
#: Plain tokens, with a letter, that a template has at least.
LITERALS = 2
_DIGIT = re.compile(r"\d")
_LETTER = re.compile(r"[^\W\d_]")
FIELD = "<*>"
# Thai to Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_DENSE = re.compile(f"[{_UNSPACED}]")
_PIECE = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def tokens_of(line: str) -> list[str]:
    """The line's tokens as they read."""
    return _PIECE.findall(line) if _DENSE.search(line) else line.split()


def template_keys(line: str, min_tokens: int = MIN_TOKENS, wide: int = WIDE_TOKENS) -> list[int]:
    """Keys of the templates a line belongs to, the exact one first; none for blank lines."""
    return _placed(line, min_tokens, wide)[1]


def _placed(line: str, min_tokens: int, wide: int) -> tuple[bool, list[int]]:
    """Whether the line is short, and keys of the templates it belongs to, the exact one first; none for blank lines."""
    read = tokens_of(line)
    n = len(read)
    if not n:
        return True, []
    tokens = [FIELD if _DIGIT.search(t) else t for t in read] if _DIGIT.search(line) else read
    literal = [t is not FIELD and bool(_LETTER.search(t)) for t in tokens]
    if sum(literal) < min(LITERALS, n):
        tokens = read
    leaf = f"{n} {' '.join(tokens[:2])}\n"
    digest = xxhash.xxh3_64_intdigest
    out = [digest(leaf + " ".join(tokens))]
    if n >= max(wide, min_tokens):
        # the tokens behind the lead, in four fields; each template leaves one out
        cuts = [2 + (n - 2) * k // FIELDS for k in range(FIELDS + 1)]
        parts = [" ".join(tokens[cuts[k] : cuts[k + 1]]) for k in range(FIELDS)]
        for k in range(FIELDS):
            if sum(literal[:2] + [x for j in range(FIELDS) if j != k for x in literal[cuts[j] : cuts[j + 1]]]) < LITERALS:
                continue
            kept = parts[:k] + [FIELD] + parts[k + 1 :]
            out.append(digest(f"{leaf}{k}\n" + "\n".join(kept)))
    return n < min_tokens, out


def parse(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, line (position), short, keys: the parsed lines of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, place, brief, sizes, keys = [], [], [], [0], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for k, line in enumerate((text.as_py() or "").split("\n")):
                    short, found = _placed(line, min_tokens, WIDE_TOKENS)
                    if found:
                        owner.append(doc)
                        place.append(k)
                        brief.append(short)
                        keys += found
                        sizes.append(len(keys))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(place, pa.int32()), pa.array(brief, pa.bool_()), lists], names=["doc_id", "line", "short", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, line int, short boolean, keys array<long>")


def templates(parsed: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key, first, lines: the templates that recur, the first of their documents and their lines; short lines need more documents."""
    each = parsed.select("doc_id", "short", F.explode("keys").alias("key"))

    def counted(rows: DataFrame, least: int) -> DataFrame:
        if least <= 2:
            # at least two documents: the smallest and the largest id differ
            spread = rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("lines"))
            return spread.where("first < last").select("key", "first", "lines")
        by_doc = rows.groupBy("doc_id", "key").agg(F.count("*").alias("n"))
        return by_doc.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.sum("n").alias("lines")).where(F.col("docs") >= least).select("key", "first", "lines")

    return counted(each.where("NOT short"), min_docs).unionByName(counted(each.where("short"), max(min_docs, SHORT_MIN_DOCS)))


def dropped_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lines: positions of the lines to drop, for documents that lose any."""
    parsed = materialize(parse(docs, min_tokens), "lines-parsed")
    recurring = materialize(templates(parsed, min_docs), "lines-recurring")
    each = parsed.select("doc_id", "line", F.explode("keys").alias("key"))
    hit = join_facts(each, recurring, "key", size="lines").where("doc_id > first").select("doc_id", "line")
    return hit.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def drop_recurring_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of ``docs``, with all their columns, without recurring lines; rows left without text are dropped."""
    gone = small_side(dropped_lines(docs, min_tokens, min_docs).select(F.col("doc_id").alias("__doc"), F.col("lines").alias("__lines")), "lines-dropped", 24 + 4 * F.size("__lines"))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("__doc"), "left")
    # the array of one array lets the lines be split once; positions are a set, so a text costs its length
    kept = F.transform(F.array(F.split("text", "\n", -1)), lambda all_lines: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__lines")), lambda i: all_lines[i]), "\n"))[0]
    whole = F.col("__lines").isNull()
    # only documents that lose lines are split at all
    cleaned = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(kept)).where(whole | F.col("text").isNull() | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(*docs.columns)


def report(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped for every document (rows of one doc_id together)."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNull(), 0).otherwise(
        F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines")).groupBy("doc_id").agg(F.max("n_lines").alias("n_lines"))
    gone = dropped_lines(docs, min_tokens, min_docs)
    return lines.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_dropped"))
