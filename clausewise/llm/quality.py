"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words, word pairs and character n-grams; a softmax
over two classes reads the average.  Training is plain numpy stochastic gradient descent on a bounded
sample of labelled rows (``max_train_docs`` documents of at most ``max_train_chars`` characters; both
are parameters, the sample is the rows with the smallest hash of their id).  Scoring reads every whole
text: since the output layer is linear in the average, each bucket's two logits collapse to one number
and a document costs one gather per feature, in one pass and with no shuffle.

Edge cases: null and empty texts have no features and get the score of the bias alone; documents with
a null id are scored (``held_out`` is null); labels that are null, repeated or of documents that do not
exist teach nothing twice (the largest label of an id counts); with no usable label, or labels of one
class only, every score is the share of label 1 among the labels (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 4)
MAX_TRAIN_DOCS = 2500
MAX_TRAIN_CHARS = 20_000
THRESHOLD = 0.3

_M = np.uint32(2654435761)
_ROLL = np.uint32(0x01000193)
_CHUNK = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    h = h * np.uint32(0x2C1B3C6D)
    return (h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)


def features(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, position of its document) arrays: every word, pair of words, and n-gram inside a word and its blanks.

    The texts are laid out in one array of code points with a blank between them, and all windows
    are hashed at once.
    """
    joined = " " + " ".join(t.translate(_FLAT) if "\x00" in t else t for t in texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[:-1]
    # words: sums of code * odd power of the place in the word, so each is hashed without a loop
    edge = np.flatnonzero(blank)
    begin, end = edge[:-1] + 1, edge[1:]
    keep = end > begin
    begin, end = begin[keep], end[keep]
    if begin.size:
        place = np.arange(code.size, dtype=np.int64) - np.repeat(np.r_[0, begin], np.diff(np.r_[0, begin, code.size]))
        weight = _POWERS[place & 255]
        value = np.where(blank, np.uint32(0), code + np.uint32(17)) * weight
        word = np.add.reduceat(value, begin, dtype=np.uint32)
        owner = np.searchsorted(starts, begin, "right") - 1
        yield _mix(word * _M + np.uint32(1)), owner
        # pairs of words that follow each other in a text; equal words share one bucket, so echoes are seen as such
        same = owner[1:] == owner[:-1]
        yield _mix((word[1:] ^ word[:-1])[same] * _M + np.uint32(2)), owner[1:][same]
    for n in NGRAMS:
        if code.size < n:
            continue
        h = np.zeros(code.size - n + 1, dtype=np.uint32)
        inside = np.ones(h.size, dtype=bool)
        for k in range(n):
            part = code[k : k + h.size]
            h = (h ^ part) * _ROLL + np.uint32(n)
            if 0 < k < n - 1:
                inside &= ~blank[k : k + h.size]
        at = np.flatnonzero(inside)
        # a window that begins in the blank before a text belongs to that text
        yield _mix(h[at] * _M), np.minimum(np.searchsorted(starts, at + 1, "right") - 1, len(texts) - 1)


_FLAT = {0: 1}
_POWERS = np.cumprod(np.full(256, 2246822519, dtype=np.uint32), dtype=np.uint32)


def _train(texts: list[str], labels: np.ndarray, seed: int = 7, epochs: int = 6, rate: float = 3.0) -> tuple[np.ndarray, float]:
    """The logit each bucket adds to a document of one feature, and the bias."""
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0.0 < share < 1.0:
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS, dtype=np.float32), float(np.log(share / (1 - share)))
    docs = []
    for t in texts:
        got = [b for b, _ in features([t])]
        ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, dtype=np.uint32), return_counts=True)
        docs.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, 2), dtype=np.float32)
    out[:, 1] = rng.uniform(-1, 1, DIM)
    out[:, 0] = -out[:, 1]
    bias = np.log(np.array([1 - share, share], dtype=np.float32))
    weight = np.array([0.5 / (1 - share), 0.5 / share])  # rare classes pull as hard as common ones
    total, seen = epochs * len(docs), 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            ids, part = docs[k]
            lr = rate * (1 - seen / total)
            seen += 1
            hidden = part @ vectors[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            p *= weight[labels[k]]
            back = out @ p
            out -= 0.1 * lr * np.outer(hidden, p).astype(np.float32)
            bias -= (0.02 * lr * p).astype(np.float32)
            vectors[ids] -= (lr * np.sqrt(len(ids)) * part[:, None]) * back.astype(np.float32)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, max_train_chars: int = MAX_TRAIN_CHARS) -> tuple[np.ndarray, float]:
    """Train on labelled rows outside the held-out fold (crc32 of the id as text, modulo 5, is 0)."""
    held = F.crc32(F.col("doc_id").cast("string")) % 5
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"))
        .where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (held != 0))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
    )
    # as many of each class as half the sample holds; texts that are missing or too long leave the sample smaller
    half = known.where("quality = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs // 2).unionByName(
        known.where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_docs - max_train_docs // 2))
    sample = (
        docs.select("doc_id", "text").where(F.length("text") <= max_train_chars)
        .join(F.broadcast(half), "doc_id")  # at most max_train_docs ids
        .groupBy("doc_id", "quality").agg(F.max("text").alias("text"))
        .orderBy("doc_id").limit(max_train_docs)
    )

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"quality": [], "text": []}), *batches])
        logit, bias = _train(rows["text"].tolist(), rows["quality"].to_numpy(np.int64))
        yield pd.DataFrame({"logit": [logit.tobytes()], "bias": [bias]})

    # the bounded sample is one partition of one task; the driver gets the model alone
    model = sample.select("quality", "text").mapInPandas(train, "logit binary, bias double").first()
    return (np.frombuffer(bytes(model["logit"]), np.float32), float(model["bias"])) if model else _train([], np.zeros(0, np.int64))


def _sums(texts: list[str], logit: np.ndarray) -> np.ndarray:
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, doc in features(texts):
        total += np.bincount(doc, weights=logit[bucket], minlength=len(texts))
        count += np.bincount(doc, minlength=len(texts))
    return total / np.maximum(count, 1)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = THRESHOLD) -> DataFrame:
    """Columns score and predicted beside doc_id; one row for each row of ``docs``."""
    logit, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((logit, bias))  # BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit, bias = shared.value
        for batch in batches:
            texts, out, held, size = batch.column(1).to_pylist(), [], [], 0
            for t in texts:
                held.append(t or "")
                size += len(held[-1])
                if size > _CHUNK:
                    out.append(_sums(held, logit))
                    held, size = [], 0
            if held:
                out.append(_sums(held, logit))
            z = (np.concatenate(out) if out else np.zeros(0)) + bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    scored = score(docs, fit(docs, labels, **bounds))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    logit, bias = fit(docs, labels, **bounds)
    shared = docs.sparkSession.sparkContext.broadcast((logit, bias))

    @F.pandas_udf("double")
    def quality(text: pd.Series) -> pd.Series:
        logit, bias = shared.value
        values, out, held, size = text.tolist(), [], [], 0
        for t in values:
            held.append(t or "")
            size += len(held[-1])
            if size > _CHUNK:
                out.append(_sums(held, logit))
                held, size = [], 0
        if held:
            out.append(_sums(held, logit))
        z = (np.concatenate(out) if out else np.zeros(0)) + bias
        return pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return docs.where(quality("text") >= THRESHOLD)
