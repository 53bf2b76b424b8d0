"""Chat formatting: quoted passages are linked to the messages they come from, and conversations read in reply order.

A message's lines carry a quote level (the number of leading ``>`` marks, blanks between them allowed).  Runs of
lines of one level are passages, and so are the paragraphs and the lines of a run; each is normalised (lower case,
single blanks) and hashed.  Quoted passages join the unquoted passages of other messages by hash, inside their
conversation first and anywhere else otherwise; the earliest message with the passage is its origin.  Across conversations
a quote must be recognised as a whole: the passages that one message holds (the run, or its paragraphs, or its lines, taken
together) cover half the quoted characters at least, and only those count that tell messages apart (``TELLING`` characters, or two
words of ``SHORTEST`` characters that a single conversation holds), so greetings and signatures link nothing.  Unquoted passages
are reduced to one row per hash and conversation, and to one per hash, before they meet any quote, and a passage
that a third of all messages hold or quote is dealt out, so no task gathers it.

A quoted run comes from the origin of its longest linked passage, so a quote of some lines or paragraphs of a message
is linked as well.  A message replies to the latest origin among its shallowest quotes.

The result has a row for each message: its text without quotes, the message it replies to, its thread's first
message, its depth, and its position in the thread read in reply order: each message, then its replies one after the
other, earliest first, each with all its own.  Rows come sorted by (thread_conv, thread_turn, position), so a
conversation is a run of rows.  Depths, sizes of sub-threads and positions are found by pointer doubling, in rounds over
written tables whose number is the logarithm of the deepest thread; a conversation of any length is never in one task.

Edge cases: null texts are empty; messages without quotes start their own thread at position 0; quotes without
origin, or of later messages, are dropped from the text and link nothing; rows that repeat a (conv_id, turn) are one
message: each is returned, with the same place, and the quotes of all count; null ids are kept and link nothing; ties of
origins go to the smaller (conv_id, turn); a message of any length is read in linear time; no message, no
row; columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import join_facts, materialize

MAX_DOUBLINGS = 40
#: Characters of a passage that count for a link across conversations: anywhere, and where one conversation alone holds it.
TELLING, SHORTEST = 40, 8
#: The share of a quote's characters that its origin in another conversation must hold.
COVERED = 0.5
_MARKS = re.compile(r"[ \t]*(?:>[ \t]?)+")
_BLANK_LINE = re.compile(r"\n\s*\n")


def runs(text: str) -> list[tuple[int, str]]:
    """(level, text) of each run of lines of one quote level."""
    out: list[tuple[int, list[str]]] = []
    for line in text.split("\n"):
        marks = _MARKS.match(line)
        depth, rest = (marks[0].count(">"), line[marks.end() :]) if marks else (0, line)
        if not out or out[-1][0] != depth:
            out.append((depth, []))
        out[-1][1].append(rest)
    return [(depth, "\n".join(lines)) for depth, lines in out]


WHOLE, PARAGRAPH, LINE = 1, 2, 4


def pieces(run: str) -> dict[str, int]:
    """The normalised run, its paragraphs and its lines, without blank ones, and as which of these each stands (bits)."""
    out: dict[str, int] = {}
    for kind, texts in ((WHOLE, [run]), (PARAGRAPH, _BLANK_LINE.split(run)), (LINE, run.split("\n"))):
        for p in (" ".join(x.lower().split()) for x in texts):
            if p:
                out[p] = out.get(p, 0) | kind
    return out


def without_quotes(text: str) -> str:
    if ">" not in text:
        return text
    own = "\n".join(line for line in text.split("\n") if not _MARKS.match(line))
    return re.sub(r"\n{3,}", "\n\n", own).strip()


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, level, place (of the run), whole (its size), hash, size, words (two or more), kinds: the non-blank passages of every message, in one narrow pass."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32())
        names = ["conv_id", "turn", "level", "place", "whole", "hash", "size", "words", "kinds"]
        for batch in batches:
            rows: list[tuple] = []
            for conv, turn, text in zip(*(c.to_pylist() for c in batch.columns)):
                for place, (depth, run) in enumerate(runs(text or "")):
                    found = pieces(run)
                    whole = max(map(len, found), default=0)
                    rows += [(conv, turn, depth, place, whole, xxhash.xxh3_64_intdigest(p) - (1 << 63), len(p), " " in p, kinds) for p, kinds in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 9, types)], names=names)

    return messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").where(
        "conv_id IS NOT NULL AND turn IS NOT NULL").mapInArrow(read, "conv_id long, turn long, level int, place int, whole int, hash long, size int, words boolean, kinds int")


def reply_links(messages: DataFrame) -> DataFrame:
    """conv_id, turn, to_conv, to_turn: at most one link for each quoting message."""
    found = materialize(passages(messages), "chat-passages")
    quotes = found.where("level > 0").withColumn("spot", F.struct("hash", "conv_id"))
    # aggregate first: one row for each passage and conversation, whoever holds or quotes it
    inside = found.groupBy("hash", "conv_id").agg(F.min(F.when(F.col("level") == 0, F.col("turn"))).alias("in_turn"), F.max("level").alias("deepest"))
    by_conv = materialize(inside, "chat-origins")
    first = by_conv.groupBy("hash").agg(
        F.min(F.when(F.col("in_turn").isNotNull(), F.struct("conv_id", F.col("in_turn").alias("turn")))).alias("first"), F.count("in_turn").alias("holders"), F.max("deepest").alias("deepest"))
    anywhere = materialize(first.where("deepest > 0 AND first IS NOT NULL").select("hash", "first", "holders"), "chat-first")
    local = by_conv.where("deepest > 0 AND in_turn IS NOT NULL").select(F.struct("hash", "conv_id").alias("spot"), "in_turn")
    names = ["conv_id", "turn", "level", "place", "whole", "size", "words", "kinds"]
    asked = materialize(join_facts(quotes, local, "spot", "left").select(*names, "hash", "in_turn"), "chat-asked")
    inside_ = F.col("in_turn") < F.col("turn")
    joined = join_facts(asked, anywhere, "hash", "left").select(
        *names, "holders", F.when(inside_, F.struct("conv_id", F.col("in_turn").alias("turn"))).when(F.col("first.conv_id") != F.col("conv_id"), F.col("first")).alias("to"))
    telling = (F.col("size") >= TELLING) | ((F.col("holders") == 1) & F.col("words") & (F.col("size") >= SHORTEST))
    held = lambda kind: F.coalesce(F.sum(F.when(telling & (F.col("kinds").bitwiseAND(kind) > 0), F.col("size"))), F.lit(0))
    origins = joined.where("to IS NOT NULL").groupBy("conv_id", "turn", "level", "place", "to").agg(
        F.max("size").alias("size"), F.max("whole").alias("whole"), F.greatest(*map(held, (WHOLE, PARAGRAPH, LINE))).alias("held"))
    same = F.col("to.conv_id") == F.col("conv_id")
    rank = [same.alias("same"), F.col("to.turn").alias("turn"), F.col("to.conv_id").alias("conv_id")]
    longest = origins.where(same | ((F.col("held") > 0) & (F.col("held") >= COVERED * F.col("whole")))).groupBy("conv_id", "turn", "level", "place").agg(
        F.max(F.struct("size", F.struct(*rank).alias("to"))).alias("longest"))
    best = longest.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("level"), "longest.to.same", "longest.to.turn", "longest.to.conv_id")).alias("m"))
    return best.select("conv_id", "turn", F.col("m.conv_id").alias("to_conv"), F.col("m.turn").alias("to_turn"))


def _name(conv: str, turn: str) -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"))


def running_total(rows: DataFrame, group: str, order: list[str], value: str, label: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of its group that come earlier in ``order``.

    Rows are dealt out by range, so a group of any size lies in many parts; parts are summed up, and added to.
    """
    dealt = materialize(rows.repartitionByRange(group, *order).withColumn("part", F.spark_partition_id()), label)
    totals = dealt.groupBy(group, "part").agg(F.sum(value).alias("__sum"))
    earlier = F.coalesce(F.sum("__sum").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn("__within", within).join(totals.select(group, "part", earlier.alias("__earlier")), [group, "part"]).withColumn(
        "before", (F.col("__within") + F.col("__earlier")).cast("long")).drop("__within", "__earlier", "part")


def _doubled(now: DataFrame, add: list[str], label: str) -> DataFrame:
    """Follow ``up`` (a name or null) of each ``node`` to its end: ``root``, and the columns ``add`` summed along the way, ends left out."""
    now = materialize(now, label)
    for _ in range(MAX_DOUBLINGS):
        above = now.select(F.col("node").alias("up"), F.col("up").alias("__up"), *(F.col(c).alias(f"__{c}") for c in add))
        step = join_facts(now, above, "up", "left")
        if now.join(above.select(F.col("up").alias("node2")), F.col("up") == F.col("node2"), "left_semi").isEmpty():
            return now.withColumnRenamed("up", "root")
        now = materialize(step.select("node", F.coalesce("__up", "up").alias("up"), *((F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0))).alias(c) for c in add)), label)
    raise RuntimeError("threads did not settle")


def _sub_threads(links: DataFrame) -> DataFrame:
    """node, size: the number of messages in the sub-thread of each linked message, itself included.

    In round k each message knows the one 2**k links above it and the number of messages less than 2**k links
    below it; the counts of those that point to it are what it lacks.
    """
    now = materialize(links.select("node", "up", F.lit(1).cast("long").alias("size")), "chat-sizes")
    while True:
        here = now.select(F.col("node").alias("up"), F.col("up").alias("__up"))
        below = now.groupBy(F.col("up").alias("node")).agg(F.sum("size").alias("__below"))
        known = now.join(below, "node", "left")
        # a pointer that leads out of the linked messages (to a thread's first one, or beyond it) is at its end
        moved = materialize(join_facts(known.select("node", "up", (F.col("size") + F.coalesce("__below", F.lit(0))).alias("size")), here, "up", "left", counted=now).select("node", F.col("__up").alias("up"), "size"), "chat-sizes")
        if moved.where("up IS NOT NULL").isEmpty():
            return moved.select("node", "size")
        now = moved


def threads(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_conv, root_turn, depth, position for every message with a link.

    A link across conversations that would close a circle is cut: pointers only lead to smaller conv_ids
    or inside their conversation to earlier turns, and others are dropped here.
    """
    forward = links.where("to_conv < conv_id OR (to_conv = conv_id AND to_turn < turn)")
    up = materialize(forward.select(_name("conv_id", "turn").alias("node"), _name("to_conv", "to_turn").alias("up")), "chat-up")
    sized = up.join(_sub_threads(up), "node")
    # a message comes behind the one it replies to and the sub-threads of its earlier siblings
    placed = running_total(sized.select("node", "up", "size", F.col("node.conv").alias("c"), F.col("node.turn").alias("t")), "up", ["c", "t"], "size", "chat-siblings")
    along = _doubled(placed.select("node", "up", F.lit(1).cast("long").alias("depth"), (F.col("before") + 1).alias("position")), ["depth", "position"], "chat-threads")
    return along.select(F.col("node.conv").alias("conv_id"), F.col("node.turn").alias("turn"), F.col("root.conv").alias("root_conv"), F.col("root.turn").alias("root_turn"), "depth", "position")


def conversations(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, reply_conv, reply_turn, thread_conv, thread_turn, depth, position for every message, in reply order."""
    links = materialize(reply_links(messages), "chat-links")
    # without any link every message is a thread of its own
    placed = links.withColumns({c: F.lit(None).cast("long") for c in ("root_conv", "root_turn", "depth", "position")}) if links.isEmpty() else links.join(threads(links), ["conv_id", "turn"], "left")
    facts = materialize(placed.withColumn("at", _name("conv_id", "turn")).drop("conv_id", "turn"), "chat-facts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pa.array([without_quotes(t or "") for t in batch.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], text], names=["conv_id", "turn", "role", "text"])

    own = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text").mapInArrow(
        clean, "conv_id long, turn long, role string, text string")
    at = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.struct(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn")))
    rows = join_facts(own.withColumn("at", at), facts, "at", "left", counted=messages.select(at.alias("at")))
    zero = F.lit(0).cast("long")
    out = rows.select(
        "conv_id", "turn", "role", "text", F.col("to_conv").alias("reply_conv"), F.col("to_turn").alias("reply_turn"),
        F.coalesce("root_conv", "conv_id").alias("thread_conv"), F.coalesce("root_turn", "turn").alias("thread_turn"), F.coalesce("depth", zero).alias("depth"), F.coalesce("position", zero).alias("position"))
    return out.orderBy("thread_conv", "thread_turn", "position", "conv_id", "turn", "role", "text")
