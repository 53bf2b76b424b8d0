"""Language-model scores by stupid backoff, over count tables partitioned by hash.

The corpus is dealt into blocks by a hash of its rows.  Each block explodes its texts into n-grams of one to
``ORDER`` words, counts equal ones, and deals the distinct (hash, count) pairs by hash into the parts of the count
table.  A part sums the blocks' counts and answers every block with the totals of its n-grams, in the order
asked.  The blocks then join totals to their n-grams and sum the scores of each document.  A frequent word or
n-gram is one pair per block, so no key is hot, and what moves is a few bytes for each distinct n-gram of a block.

The score of a word is the share of its history's followers at the longest order whose n-gram occurs in another
document too (a document's own n-grams don't count: leave one out), with a factor ``BACKOFF`` for each order
skipped; an unseen word scores ``BACKOFF ** (ORDER - 1)`` over the number of words plus one.  Sums are natural logs.

Edge cases: null and empty texts have no words, log score 0 and a null mean; repeated rows count as often as they
occur; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.shingles import _A, mix, word_hashes

ORDER = 3
BACKOFF = 0.4
#: Characters of a block and distinct n-grams of a part, on average.
BLOCK_CHARS = 12_000_000
PART_CHARS = 24_000_000
#: Hashes are cut to the bits that number the corpus's characters and these: one n-gram in a million meets another.
SPARE_BITS = 20
_SUB = 1 << 20


def ngrams(texts: list[bytes], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order, the hash of the n-gram that ends at each word (0 where the document has too few words before it); words per text."""
    words, counts = [], []
    held, size = [], 0
    for t in [*texts, None]:
        if t is None or size > _SUB:
            w, c = word_hashes(held)
            words.append(w)
            counts.append(c)
            held, size = [], 0
        if t is not None:
            held.append(t)
            size += len(t)
    w, n = np.concatenate(words), np.concatenate(counts)
    place = np.arange(w.size) - np.repeat(np.cumsum(n) - n, n)
    out = [w]
    for k in range(2, order + 1):
        h = np.zeros(w.size, np.uint64)
        if w.size >= k:
            h[1:] = mix(out[-1][:-1] * _A + w[1:] + np.uint64(k))
        h[place < k - 1] = 0
        out.append(h)
    return out, n


def _distinct(grams: list[np.ndarray], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of all orders, cut to ``bits`` and without the zeros, and their counts."""
    every = np.concatenate(grams)
    return np.unique(every[every != 0] >> np.uint64(64 - bits), return_counts=True)


def _bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [b"" if x is None else x for x in column.to_pylist()]


def _pack(sorted_values: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between sorted hashes and their counts, byte plane by byte plane, compressed."""
    step = np.diff(sorted_values, prepend=np.uint64(0))
    return tuple(_squeeze(x.astype("<u8")) for x in (step, counts))


def _squeeze(x: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _expand(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _ask(parts: int, order: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        hashes, n = _distinct(ngrams(_bytes(table.column("text")), order)[0], bits)
        cuts = np.searchsorted(hashes, np.array([(k << bits) // parts for k in range(1, parts)], np.uint64))
        block = table.column("block")[0].as_py()
        rows = [(block, p, *_pack(h, c)) for p, (h, c) in enumerate(zip(np.split(hashes, cuts), np.split(n, cuts))) if h.size]
        kinds = (("block", pa.int64()), ("part", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()))
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds)})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Totals of a part's n-grams for each block that asked."""
    asked = [np.cumsum(_expand(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    counts = [_expand(x) for x in table.column("counts").to_pylist()]
    known, at = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(at, np.concatenate(counts), known.size).astype("<u8")
    answers, first = [], 0
    for h in asked:
        answers.append(_squeeze(totals[at[first : first + h.size]]))
        first += h.size
    return pa.table({"block": table.column("block"), "part": table.column("part"), "totals": pa.array(answers, pa.binary())})


def _score(order: int, backoff: float, words: int, bits: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        grams, n = ngrams(_bytes(table.column("text")), order)
        replies = replies.sort_by("part")
        totals = np.concatenate([np.zeros(0, np.int64), *(_expand(x).astype(np.int64) for x in replies.column("totals").to_pylist())])
        doc = np.repeat(np.arange(n.size), n)
        place = np.arange(doc.size) - np.repeat(np.cumsum(n) - n, n)
        # one sort finds the place of each n-gram among the block's distinct ones, which the replies follow
        every = np.concatenate(grams)
        real = every != 0
        at = np.zeros(every.size, np.int64)
        at[real] = np.unique(every[real] >> np.uint64(64 - bits), return_inverse=True)[1]
        others = []
        for k, part in enumerate(np.split(at, order)):
            seen = np.zeros(doc.size, np.int64)
            whole = np.flatnonzero(place >= k)
            seen[whole] = totals[part[whole]] - _own_counts(doc[whole], part[whole])
            others.append(seen)
        score = np.full(doc.size, backoff ** (order - 1) / (words + 1))
        done = np.zeros(doc.size, bool)
        for k in range(order, 0, -1):
            hit = np.flatnonzero((place >= k - 1) & ~done & (others[k - 1] > 0))
            seen = others[k - 1][hit]
            base = np.maximum(words - n[doc[hit]], 1) if k == 1 else np.maximum(others[k - 2][hit - 1], seen)
            score[hit] = backoff ** (order - k) * seen / base
            done[hit] = True
        sums = np.bincount(doc, np.log(score), n.size).astype(np.float64)
        return pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(n.astype(np.int64)), "log_score": pa.array(sums)})

    return run


def _own_counts(owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each n-gram occurs in its own document."""
    key = owner.astype(np.int64) << np.int64(34) | at.astype(np.int64)
    _, back, many = np.unique(key, return_inverse=True, return_counts=True)
    return many[back]


def stupid_backoff(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """doc_id, n_words, log_score, mean_log_score for each row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    chars, words = docs.agg(F.sum(F.length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    chars, words = chars or 0, words or 0
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // PART_CHARS))
    bits = min(64, max(40, chars.bit_length() + SPARE_BITS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    replies = dealt.groupBy("block").applyInArrow(_ask(parts, order, bits), "block long, part long, hashes binary, counts binary").groupBy("part").applyInArrow(
        _answer, "block long, part long, totals binary")
    scored = dealt.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_score(order, backoff, words, bits), "doc_id long, n_words long, log_score double")
    return scored.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round(F.try_divide("log_score", "n_words"), 6).alias("mean_log_score"))
