"""Hard negatives, spelling variants and nearest neighbours against brute force, with ties, skew and hostile rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.llm import ann, negatives, spelling

VEC = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")
HOSTILE = [
    (None, [1.0, 0.0, 0.0], 1), (900, None, 1), (901, [1.0, None, 0.0], 1), (902, [1.0, NAN, 0.0], 1), (903, [1.0, INF, 0.0], 1),
    (904, [1.0, -INF, 0.0], 2), (905, [0.5, 0.5, 0.5], None)]


def taking_part(rows):
    fine = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    return sorted({(i, tuple(np.float32(v).tolist()), y) for i, v, y in rows if i is not None and fine(v) and y is not None}, key=str)


# ---------------------------------------------------------------- hard negatives


def mined(rows, k=5):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in taking_part(rows)]
    score = lambda a, b: sum(x * y for x, y in zip(a[1], b[1], strict=False))
    out = []
    for a in (r for r in rows if r[0] % 100 == 0):
        order = lambda b: (-score(a, b), b[0])
        for p in sorted((b for b in rows if b[0] != a[0] and b[2] == a[2]), key=order)[:k]:
            s = score(a, p)
            near = sorted((b for b in rows if b[0] != a[0] and b[2] != a[2] and 80 * s <= 100 * score(a, b) <= 100 * s), key=order)[:k]
            out += [(a[0], p[0], n, b[0], s, score(a, b)) for n, b in enumerate(near, 1)]
    return sorted(out)


def vectors(n, d=6, seed=1, step=10, grain=None):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    x = np.round(x * grain) / grain if grain else x / np.linalg.norm(x, axis=1, keepdims=True)
    return [(i * step, [float(v) for v in r], int(rng.integers(3))) for i, r in enumerate(x)]


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize("rows", [
    vectors(240) + HOSTILE, vectors(300, grain=1, d=3), [(i * 5, [1.0, 0.0], i % 2) for i in range(120)], vectors(1), [],
    vectors(60) + vectors(60)[:30] + [(0, [9e9, 1.0], 1), (100, [], 1), (200, [-3.0], 2)]], ids=["plain", "ties", "one score", "alone", "empty", "repeated"])
def test_hard_negatives_match_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 50)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", 4)
    monkeypatch.setattr(negatives, "DIGIT_BITS", 8)
    df = spark.createDataFrame(rows, VEC).withColumn("key", F.lit("x")).withColumn("id", F.lit(7)).withColumn("windows", F.lit(0))
    capped = [(i, v and [max(min(x, 65536.0), -65536.0) if x is not None and math.isfinite(x) else x for x in v], y) for i, v, y in rows]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in negatives.mine(df, "vec_id % 100 = 0").collect()) == mined(capped)


def test_radix_passes_end_at_the_kth_score(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(negatives, "DIGIT_BITS", 4)
    rows = vectors(240)
    blocks = negatives._Blocks(negatives.integer_rows(spark.createDataFrame(rows, VEC), "vec_id % 100 = 0"))
    windows = blocks.anchors.select(F.col("key").alias("akey"), F.lit(0).cast("long").alias("wid"), F.lit(-blocks.bound).alias("lo"), F.lit(blocks.bound).alias("hi"))
    got = {r.id: (r.lo, r.need) for r in negatives.kth_scores(blocks, windows, 5, False).join(blocks.anchors.withColumnRenamed("key", "akey"), "akey").collect()}
    whole = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in taking_part(rows)]
    for i, v, y in whole:
        if i % 100 == 0:
            scores = sorted((sum(a * b for a, b in zip(v, w, strict=True)) for _, w, z in whole if z != y), reverse=True)
            assert got[i] == (scores[4], 5 - sum(s > scores[4] for s in scores))


def test_scores_beyond_doubles_stay_whole():
    a, b = np.array([[2.0**24, 1.0, 3.0]]), np.array([[2.0**24, 1.0, -5.0], [2.0**24, 0.0, 1.0]])
    wide = lambda x: np.repeat(x, 40, axis=1)
    assert negatives._scores(wide(a), wide(b)).tolist() == [[40 * (2**48 + 1 - 15), 40 * (2**48 + 3)]]


# ---------------------------------------------------------------- spelling variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def varied(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [o for o in count if o != w and one_edit(w, o)] for w in count}
    best = {w: min(o, key=lambda x: (-count[x], x)) for w, o in near.items() if o}
    form = {w: b for w, b in best.items() if count[b] >= 10 * count[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), count[w], len(near[w]), count[form[w]] if w in form else -1) for w in count)


def edited(word, rng):
    at, letters = rng.randrange(len(word)), "abcéz"
    return [word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]][rng.randrange(3)]


def spelled(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 12))) for _ in range(30)]
    words += [edited(rng.choice(words), rng) for _ in range(150)]
    return [(i, " ".join(rng.choices(words, k=60)) + rng.choice([" ", "!", "1"]) + " ".join([words[0].upper()] * 40)) for i in range(40)]


@pytest.mark.parametrize("rows", [
    spelled(1), spelled(2), [(1, None), (2, ""), (None, "abcdefgh abcdefgh abcdefg"), (3, " \n\t")], [],
    [(1, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + " " + "x" * 4999)] * 2,
    [(i, "aaaaaaa aaaaaaab aaaaaabb " * (1 + 30 * (i > 3))) for i in range(6)] * 2 + [(9, "aaaaaaab " * 500 + "aaaaaabb " * 9000)]], ids=["one", "two", "nulls", "empty", "long", "chain"])
def test_spelling_variants_match_brute_force(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("size", F.lit(1))
    got = [(r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.spelling_variants(df).collect()]
    assert sorted(got) == varied(rows)


def test_one_edit_flips_two_bits_at_most(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéñÀÿ") for _ in range(rng.randrange(7, 14))) for _ in range(200)]
    pairs = [(w, edited(w, rng)) for w in words]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", spelling.masks(F.col("a")).alias("x"), spelling.masks(F.col("b")).alias("y")).collect():
        flipped = [((r.x ^ r.y) >> 21 * b & 0x1FFFFF).bit_count() for b in range(3)]
        assert sum(flipped) <= (1 if len(r.a) != len(r.b) else 2) and 0 in flipped


# ---------------------------------------------------------------- nearest neighbours


def nearest(rows, query, k):
    rows = [(i, np.array(v)) for i, v, _ in taking_part([(i, v, 0) for i, v, _ in rows]) if np.any(v)]
    out = {}
    for n, (i, q) in enumerate(rows):
        if query(i):
            ranked = sorted((-float((q[: len(v)] * v[: len(q)]).sum()), j) for m, (j, v) in enumerate(rows) if m != n)[:k]
            out.setdefault(i, []).append([(j, -s) for s, j in ranked])
    return out


def searched(spark, rows, k=20, query="vec_id % 20 = 0"):
    df = spark.createDataFrame(rows, VEC).withColumn("key", F.lit("x")).withColumn("h1", F.lit(1)).withColumn("vec", F.lit(1)).withColumn("id", F.lit(3))
    got = {}
    for r in sorted(ann.search(df, query, k).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return got


def test_neighbours_reach_recall_on_unstructured_vectors(spark):
    rows = vectors(3000, d=32, step=1)
    want, got = nearest(rows, lambda i: i % 20 == 0, 20), searched(spark, rows)
    assert got.keys() == want.keys()
    hits = sum(len({j for j, _ in want[i][0]} & {j for _, j, _ in got[i]}) for i in want)
    assert hits >= 0.93 * 20 * len(want)
    by_id = {i: np.array(np.float32(v), float) for i, v, _ in rows}
    for i, found in got.items():
        assert [n for n, _, _ in found] == list(range(1, 21)) and i not in {j for _, j, _ in found}
        assert all(abs(s - by_id[i] @ by_id[j]) < 1e-12 for _, j, s in found)
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)


def test_neighbours_with_copies_ties_and_hostile_rows(spark, monkeypatch):
    """Few distinct vectors, most rows copies: every bucket is visited, so the result is exact, ties by id included."""
    monkeypatch.setattr(ann, "CHUNK_ROWS", 16)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 2)
    monkeypatch.setattr(ann, "MAX_FUNCTIONS", 1)
    monkeypatch.setattr(ann, "TARGET", 1.0)
    rows = [(i, [1.0, 0.5, -1.0], 0) for i in range(0, 300, 2)] + vectors(40, d=3, step=7, grain=1) + HOSTILE + [(910, [0.0, 0.0, 0.0], 1), (920, [], 1), (2, [1.0, 0.5, -1.0], 0), (940, [4.0], 1), (960, [100.0, 1.0, 1.0, 1.0], 0)]
    rows = [(i, v, 0 if y is None else y) for i, v, y in rows]
    want, got = nearest(rows, lambda i: i % 20 == 0, 5), searched(spark, rows, 5)
    assert got.keys() == want.keys()
    for i, found in got.items():
        every = sorted((j, round(s, 9)) for one in want[i] for j, s in one)
        assert sorted((j, round(s, 9)) for _, j, s in found) == every


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0], 1)], [(1, [1.0, 0.0], 1), (2, [0.5, 0.5], 1)], [(0, [1.0, 0.0], 1), (3, [0.0, 1.0], 1)]], ids=["empty", "alone", "no query", "pair"])
def test_neighbours_of_few_rows(spark, rows):
    got = searched(spark, rows)
    assert {i: [j for _, j, _ in x] for i, x in got.items()} == ({0: [3]} if len(rows) == 2 and rows[0][0] == 0 else {})


def test_probes_are_the_likeliest_products():
    """The merge finds the same best buckets as ranking all products of the cells' chances."""
    rng = np.random.default_rng(2)
    q = rng.standard_normal((3, 8))
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    index = ann.Index.drawn(3, 8, 0.4, 25)
    p = index.chances(q, 1)
    grid = np.stack(np.meshgrid(*[np.arange(index.cells)] * 3, indexing="ij"), -1).reshape(-1, 3)
    for i in range(3):
        total = p[i, 0, grid[:, 0]] + p[i, 1, grid[:, 1]] + p[i, 2, grid[:, 2]]
        best = grid[np.argsort(-total, kind="stable")[:25]]
        assert set(index.visited(q, 1)[i]) == set(index.keys(best))
