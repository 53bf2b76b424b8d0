"""Spelling variants by letter-parity masks: words that differ by one inserted, deleted or replaced code point.

A word's mask has a bit for each letter, set if the letter occurs an odd number of times, in three bands (a letter belongs to
one).  One insertion or deletion flips one bit, a replacement two at most, so at least one band of three is
equal for any two near words.  Words meet in equal bands, with the length filter in the key: replacements among words of a
length, insertions between a word and the next shorter length.  Frequent bands are divided further by the half of the word that the
edit leaves alone (an edit lies in one half; the other is equal), so that a bucket holds words alike and not all
words without a rare letter.  A pair is verified (edit distance 1, code points) inside the join, by the first key
that it shares, so candidates are never rows, and no pair comes twice.

Forms (the near word of largest count, if that is ten times the word's) point from rare to frequent, so chains end; roots
are found by pointer doubling.

Edge cases: null and empty texts have no words; a null doc_id reads as an empty one; repeated rows count again; a run of
any length is one word; equal counts go to the word first in code-point order; no document, no row; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize

#: fixed value: what a run of letters is
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT = 7, 2
FORM_FACTOR = 10
#: One run in so many loses a letter (a planted slip); None leaves all as they are.
SLIP = 31
BANDS, BAND_BITS = 3, 21
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Characters of texts after which a batch's counts are handed on.
_FLUSH = 8 << 20


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int | None = SLIP) -> DataFrame:
    """word, n over all whole texts; ``slip`` deletes a code point of the runs whose hash with the doc_id it divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(f"[{LETTERS}]{{{min_length},}}").findall
        words: Counter = Counter()
        read = 0

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])
            words.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                mark = f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode()
                start = zlib.crc32(mark)
                for word, n in Counter(find(text.translate(_LOWER))).items():
                    if slip:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < min_length:
                                continue
                    words[word] += n
                read += len(text)
                if read > _FLUSH:
                    read = 0
                    yield handed()
        yield handed()

    each = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def masks(word: Column) -> Column:
    """The letters' parities as one long: three bands of 21 bits."""
    # a letter's band and bit follow from its code point, so that neighbours in the alphabet lie in different bands
    bit = lambda c: (F.ascii(c) % BANDS) * BAND_BITS + (F.ascii(c) / BANDS).cast("int") % BAND_BITS
    return F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit(c))))


def band(mask: Column, b: int) -> Column:
    return F.shiftrightunsigned(mask, b * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: both directions of all pairs of ``words`` (word, n; each word once) that are one edit apart."""
    held = materialize(words.select("word", "n", masks(F.col("word")).alias("mask")), "sp-words")

    def keyed(shorter: Column) -> DataFrame:
        """A row for each band and half (``spot``), by the length ``shorter`` whose halves count; no more columns than the join needs."""
        ends = held.withColumn("shorter", shorter).withColumn("half", (F.col("shorter") / 2).cast("int")).select(
            "*", F.xxhash64(F.expr("substring(word, 1, half)")).alias("start"), F.xxhash64(F.expr("right(word, shorter - half)")).alias("end"))
        spots = F.array(*(
            F.struct(F.lit(2 * b + h).cast("tinyint").alias("spot"), F.xxhash64("shorter", F.lit(b), band(F.col("mask"), b), end).alias("key"))
            for b in range(BANDS) for h, end in enumerate(("start", "end"))))
        return ends.select("word", "n", "mask", "start", F.explode(spots).alias("x")).select("x.key", "x.spot", "word", "n", "mask", "start")

    def joined(left: DataFrame, right: DataFrame, flips: int) -> DataFrame:
        """Pairs of equal keys that differ in so many bits at most, by the first key they share (no earlier band, no first half), verified."""
        right = right.select("key", "spot", *(F.col(c).alias(f"{c}_r") for c in ("word", "n", "mask", "start")))
        flipped = F.col("mask").bitwiseXOR(F.col("mask_r"))
        earlier = reduce(lambda x, y: x | y, [(F.col("spot") >= 2 * b + 2) & (band(flipped, b) == 0) for b in range(BANDS - 1)])
        twice = earlier | ((F.col("spot") % 2 == 1) & (F.col("start") == F.col("start_r")))
        # both sides read all columns, so equal exchanges are written once
        return left.join(right, ["key", "spot"]).where((F.bit_count(flipped) <= flips) & ~twice & (F.levenshtein("word", "word_r", 1) == 1))

    same, longer = keyed(F.length("word")), keyed(F.length("word") - 1)
    replaced = joined(same, same, 2).where(F.col("word") < F.col("word_r"))
    names = ["word", "n", "word_r", "n_r"]
    one = materialize(replaced.select(*names).unionByName(joined(same, longer, 1).select(*names)), "sp-pairs")
    there = one.toDF("a", "na", "b", "nb")
    return there.unionByName(one.select(F.col("word_r").alias("a"), F.col("n_r").alias("na"), F.col("word").alias("b"), F.col("n").alias("nb")))


def variants(words: DataFrame, factor: int = FORM_FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word."""
    pairs = near_pairs(words)
    # the largest count first, then the first in code-point order
    best = pairs.groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("m"), "b")).alias("best"), F.first("na").alias("na"))
    ok = -F.col("best.m") >= factor * F.col("na")
    forms = materialize(best.select(F.col("a").alias("word"), "n_near", F.when(ok, F.col("best.b")).alias("form"), F.when(ok, -F.col("best.m")).alias("form_n")), "sp-forms")
    now = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # a root that has a form itself moves on to where that leads
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        next_ = materialize(join_facts(now, onward, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "sp-roots")
        now = next_.select("word", "root")
        if not next_.where("moved").limit(1).count():
            break
    return words.join(forms, "word", "left").join(now, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The words of ``docs`` with their forms and roots."""
    return variants(materialize(word_counts(docs), "sp-counts"))
