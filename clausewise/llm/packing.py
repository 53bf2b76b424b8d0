"""Sequence packing by non-negative least squares.

Texts are tokenised once, on the executors, and cut into full windows and one rest each; a full window
is a sequence of its own.  The rests' histogram (one count per length below the window, so its size is
fixed) goes to the driver.  There all combinations of up to three lengths that fill the window exactly
are enumerated, repeat counts are solved against the histogram by accelerated projected gradients,
rounded so that no length is used more often than it occurs, and what is left is packed greedily, longest
first with the longest that still fits.

Pieces find their place without a sort of the whole: within a length they are ranked inside hash salts,
salt totals are summed up, and a rank maps to a sequence and offset by the plan's table of runs.

Edge cases: null and empty texts hold the end token alone; added tokens of the vocabulary that a text spells out
are one id, as the tokenizer has it; repeated rows are packed as often as they occur, ties by id, start and checksum; a
text of any length is cut into windows as it is read, one document in memory at a time; no document, no piece;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.llm.common import materialize

WINDOW = 2048
END = 1
DEPTH = 3
#: Pieces a salt holds on average.
SALT_ROWS = 20_000

#: Characters that every version of Unicode splits alike; texts with others are left to the tokenizer itself.
_OTHER = re.compile("[^\x00-\u024f\u2010-\u2027\u2030-\u205e\u20a0-\u20b5]")
# Fixed value: the split of byte-level vocabularies of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

Encoder = Callable[[str], bytes]
_loaded: dict[str, Encoder] = {}


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


def encoder(path: str) -> Encoder:
    """Text -> ids as little-endian 32-bit values.

    The file's added tokens (``<|endoftext|>``) are read as the tokenizer reads them, as one id each.  Where the
    file's merges come in the order of their ids (checked on loading), merging by rank gives the tokenizer's own ids
    several times faster, and its table is built from the same file.
    """
    if path in _loaded:
        return _loaded[path]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    own: Encoder = lambda text: array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    _loaded[path] = own
    try:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, whole = file["model"], [t["content"] for t in file.get("added_tokens") or []]
        vocab, alphabet = model["vocab"], _byte_alphabet()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if [vocab.get(a + b) for a, b in merges] == list(range(256, 256 + len(merges))):
            ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}
            fast = tiktoken.Encoding("packing", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            _loaded[path] = lambda text: own(text) if _OTHER.search(text) or any(t in text for t in whole) else array("I", fast(text)).tobytes()
    except (ImportError, KeyError):
        pass
    return _loaded[path]


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: full windows and the rest of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                for at in range(0, n, window):
                    part = ids[4 * at : 4 * (at + window)]
                    for column, value in zip(rows, (doc.as_py(), at, len(part) // 4, zlib.crc32(part), n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# ---------------------------------------------------------------- the plan


def combinations(window: int, depth: int = DEPTH) -> np.ndarray:
    """All sorted combinations of up to ``depth`` (2 or 3) lengths that fill the window; 0 marks no length."""
    low = np.arange(1, window // 2 + 1)
    out = [np.stack([low, window - low, np.zeros_like(low)], axis=1)]
    if depth > 2:
        a, b = np.meshgrid(np.arange(1, window // 3 + 1), low, indexing="ij")
        c = window - a - b
        ok = (a <= b) & (b <= c)
        out.append(np.stack([a[ok], b[ok], c[ok]], axis=1))
    return np.concatenate(out)


def nonnegative_least_squares(combos: np.ndarray, counts: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|, A counting the lengths of each combination."""
    window = counts.size - 1
    flat = combos.reshape(-1)
    real = (combos > 0).astype(np.float64)
    goal = counts.astype(np.float64)
    # the step's bound: the largest eigenvalue of A'A, by power iteration
    v = np.ones(len(combos))
    for _ in range(12):
        u = np.bincount(flat, np.repeat(v, combos.shape[1]), window + 1)
        u[0] = 0
        v = (u[combos] * real).sum(axis=1)
        norm = np.linalg.norm(v)
        v /= norm
    step = 1 / (1.1 * norm)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        r = np.bincount(flat, np.repeat(y, combos.shape[1]), window + 1) - goal
        r[0] = 0
        new = np.maximum(0, y - step * (r[combos] * real).sum(axis=1))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / s * (new - x)
        x, t = new, s
    return x


def plan(counts: np.ndarray, window: int = WINDOW, depth: int = DEPTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences as (repeats, [(length, times), ...]); every counted piece is in exactly one of them."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[int, list[tuple[int, int]]]] = []
    if left[window]:
        out.append((int(left[window]), [(window, 1)]))
        left[window] = 0
    if left.sum() > 1:
        combos = combinations(window, depth)
        combos = combos[(left[combos] > 0).sum(axis=1) == (combos > 0).sum(axis=1)]
        if len(combos):
            solved = nonnegative_least_squares(combos, left)
            # rounded to nearest from the largest on, and held to what is there
            for k in np.argsort(-solved, kind="stable"):
                if solved[k] < 0.5:
                    break
                lengths, times = np.unique(combos[k][combos[k] > 0], return_counts=True)
                repeats = int(min(round(float(solved[k])), *(left[lengths] // times)))
                if repeats > 0:
                    left[lengths] -= repeats * times
                    out.append((repeats, [(int(a), int(b)) for a, b in zip(lengths, times)]))
    return out + _greedy(left, window)


def _greedy(left: np.ndarray, window: int) -> list[tuple[int, list[tuple[int, int]]]]:
    out = []
    while left.any():
        room, used = window, {}
        while room:
            fits = np.flatnonzero(left[: room + 1] > 0)
            fits = fits[::-1]
            n = next((int(n) for n in fits if left[n] > used.get(int(n), 0)), 0)
            if not n:
                break
            times = min(room // n, int(left[n]) - used.get(n, 0))
            used[n] = used.get(n, 0) + times
            room -= n * times
        # the same sequence again while the pieces last
        repeats = min(int(left[n]) // times for n, times in used.items())
        for n, times in used.items():
            left[n] -= repeats * times
        out.append((repeats, sorted(used.items(), reverse=True)))
    return out


def runs(sequences: list[tuple[int, list[tuple[int, int]]]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """For each length, by first rank: the run of sequences that its pieces go to."""
    rows, base, taken = [], 0, [0] * (window + 1)
    for repeats, parts in sequences:
        offset = 0
        for length, times in parts:
            rows.append((length, taken[length], base, offset, times))
            taken[length] += repeats * times
            offset += length * times
        base += repeats
    rows.sort()
    names = ("length", "first", "base", "offset", "times")
    return {k: np.array(v, np.int64) for k, v in zip(names, zip(*rows))} if rows else {k: np.zeros(0, np.int64) for k in names}


def place(table: dict[str, np.ndarray], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the pieces of these lengths and ranks within their length."""
    wide = np.int64(1) << np.int64(50)
    at = np.searchsorted(table["length"] * wide + table["first"], length * wide + rank, "right") - 1
    k, times = rank - table["first"][at], table["times"][at]
    return table["base"][at] + k // times, table["offset"][at] + k % times * length


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(cut(docs, tokenizer, window), "packing-pieces")
    counts = np.zeros(window + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most one row for each length up to the window
        counts[r["length"]] = r["count"]
    shared = spark.sparkContext.broadcast(runs(plan(counts, window, depth), window))  # bounded by the number of combinations
    salts = max(8, int(counts.sum() // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    totals = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = totals.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = salted.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "salt"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("k")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            sequence, offset = place(table, batch.column(2).to_numpy(), batch.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                                             names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
