"""The training-data operators against brute force, exact round trips and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausewise.llm import chat, components, decontam, lines, lm, media, neardup, packing, quality, secrets, urls, webp

DOC = "doc_id long, text string"
BASE = "the quick brown fox jumps over the lazy dog while seven wise owls read long books about rivers and old stone bridges near town"


def docs(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in rows], DOC)


EDGES = [(0, None), (1, ""), (2, " \n\t "), (3, "a"), (4, "word " * 30_000), (5, BASE), (5, BASE), (6, BASE), (7, "é日本語 ſß \x00 ퟿")]


@pytest.fixture(scope="module")
def edges(spark):
    return docs(spark, EDGES).withColumn("score", F.lit(1)).withColumn("key", F.lit("x")).withColumn("n", F.lit(2))


# ---------------------------------------------------------------- 1


def labelled(spark, n=160):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    good = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(n)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=40)) for _ in range(n)]
    texts = docs(spark, list(enumerate(good + bad)))
    return texts, spark.createDataFrame([(i, int(i < n), 0) for i in range(2 * n)], "doc_id long, quality int, toxic int")


def test_quality_holds_out_and_learns(spark):
    texts, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.classify(texts, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r.predicted, int(i < 160)) for i, r in got.items() if r.held_out]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    # labels of the held-out fold teach nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r.doc_id: r.score for r in quality.classify(texts, flipped).collect()} == {i: r.score for i, r in got.items()}


def test_quality_edges(spark, edges):
    _, labels = labelled(spark, 3)
    got = quality.classify(edges, labels).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(edges.limit(0), labels).count() == 0
    assert [r.score for r in quality.classify(edges, labels.limit(0)).collect()] == [0.5] * len(EDGES)
    assert quality.keep_good(edges, labels.limit(0)).columns == edges.columns


# ---------------------------------------------------------------- 2


@pytest.fixture(scope="module")
def tokenizer():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_tokens_equal_the_tokenizers_own(tokenizer):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    rng, letters = random.Random(1), "ab Z9'sdlmt!?.\n\t\x0b\x85\xa0\x1cé²½ª×ÿ “€日ſ<|endoftext|>"
    for _ in range(2000):
        s = "".join(rng.choice(letters) for _ in range(rng.randrange(14)))
        assert np.frombuffer(packing.encoder(tokenizer)(s), "<u4").tolist() == own.encode(s, add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("lengths", [[], [1], [2048], list(range(1, 400)), [1500] * 50 + [548] * 30 + [3], [1] * 5000])
def test_plan_uses_each_piece_once(lengths):
    counts = np.bincount(lengths, minlength=2049)
    used = Counter()
    for repeats, parts in packing.plan(counts):
        assert repeats > 0 and sum(n * k for n, k in parts) <= 2048
        for n, k in parts:
            used[n] += repeats * k
    assert used == Counter(lengths)


def test_packing_is_gapless_and_whole(spark, edges, tokenizer):
    rows = packing.pack(edges, tokenizer).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length, r.doc_tokens, r.ids_crc32))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    encode = packing.encoder(tokenizer)
    copies = Counter(i for i, _ in EDGES)
    for i, text in EDGES:
        ids = encode(text or "") + np.array([1], "<u4").tobytes()
        assert sum(n for _, n, _, _ in by_doc[i]) == copies[i] * (len(ids) // 4)
        assert all(c == zlib.crc32(ids[4 * s : 4 * (s + n)]) and t == len(ids) // 4 for s, n, t, c in by_doc[i])
    assert packing.pack(edges.limit(0), tokenizer).count() == 0


# ---------------------------------------------------------------- 3


def test_backoff_matches_brute_force(spark, edges, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_CHARS", 40)
    monkeypatch.setattr(lm, "PART_CHARS", 60)
    rows = [(0, "a b c a b d"), (1, "a b c x"), (2, ""), (3, "z a b c a"), (4, "q"), (5, "a b"), (6, None)]
    got = {r.doc_id: r for r in lm.stupid_backoff(docs(spark, rows)).collect()}
    words = {i: (t or "").split() for i, t in rows}
    total, count, own = sum(map(len, words.values())), Counter(), defaultdict(Counter)
    for i, w in words.items():
        for k in (1, 2, 3):
            for j in range(len(w) - k + 1):
                count[tuple(w[j : j + k])] += 1
                own[i][tuple(w[j : j + k])] += 1
    for i, w in words.items():
        others, want = (lambda g: count[g] - own[i][g]), 0.0
        for j in range(len(w)):
            p = 0.4**2 / (total + 1)
            for k in (3, 2, 1):
                g = tuple(w[j - k + 1 : j + 1])
                if j >= k - 1 and others(g) > 0:
                    p = 0.4 ** (3 - k) * others(g) / (max(total - len(w), 1) if k == 1 else max(others(g[:-1]), others(g)))
                    break
            want += math.log(p)
        assert got[i].log_score == pytest.approx(want, abs=1e-5) and got[i].n_words == len(w)
    assert lm.stupid_backoff(edges).count() == len(EDGES)
    assert lm.stupid_backoff(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- 4

ITEM = "A train leaves the station at 9 and travels 120 km before Anna meets it near the river bank with her brother"


def test_decontamination(spark, edges):
    benchmark = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    rows = [
        (10, "Intro words first. " + ITEM.upper().lower() + " and more words follow here."), (11, ITEM.replace("9", "7").replace("120", "300").replace("Anna", "Bert")),
        (12, ITEM.replace("120 km", "120 kg")), (13, BASE), (14, "prefix " + ITEM + "\n" + ITEM), (15, None), (16, ""),
    ]
    got = {r.doc_id: r for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {10, 11, 12, 14}
    assert got[11].reworded and not got[14].reworded and got[14].item_ids == "1"
    assert {r.doc_id for r in decontam.drop_contaminated(docs(spark, rows), benchmark).collect()} == {13, 15, 16}
    assert not any(r.contaminated for r in decontam.contaminated(edges, benchmark).collect())
    assert decontam.drop_contaminated(edges, benchmark.limit(0)).count() == len(EDGES)


def test_conflicting_slots_are_no_match(spark):
    benchmark = spark.createDataFrame([(1, "we add 5 apples then 5 pears then 5 plums and count all of them")], "item_id long, text string")
    rows = [(1, "we add 5 apples then 6 pears then 7 plums and count all of them"), (2, "we add 8 apples then 8 pears then 8 plums and count all of them")]
    got = {r.doc_id: r.contaminated for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {1: False, 2: True}


def test_new_fillers_may_coincide_and_have_other_lengths(spark):
    long = [f"{a}{b}" for a in "abc" for b in "bcdfghjklmn"]
    items = ["we bought 12 apples and 15 pears at the market and ate them all", "we met Ann and paid 500 coins so that old Bob could leave the town", " ".join(long)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, items[0].replace("12", "20").replace("15", "20")), (2, items[1].replace("Ann", "Mary Ann Smith").replace("500", "1,000").replace("Bob", "Tim Lee")),
            (3, " ".join([*long[:11], "zz", *long[11:22], "yy", *long[22:]])), (4, " ".join(long[:11] + ["zz"] * 20 + long[22:]))]
    got = {r.doc_id: (r.item_ids, r.reworded) for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {1: ("0", True), 2: ("1", True), 3: ("2", False), 4: ("", False)}


def test_verbatim_copies_depend_on_no_capitals(spark):
    items = ["How many legs does a spider have", "Then Ann Bob Carl met Dora", "Then 5 6 7 8 and 9 10 11 12 make 13", ITEM]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(1, "Question: How many legs does a spider have?"), (2, "no mark\nHow many legs does a spider have"), (3, "HOW MANY LEGS DOES A SPIDER HAVE"), (4, "as told. " + items[1] + "."), (5, items[2]), (6, ITEM.title()), (7, ITEM.upper()), (8, "How many legs does a table have")]
    got = {r.doc_id: (r.item_ids, r.reworded) for r in decontam.contaminated(docs(spark, rows), benchmark).collect()}
    assert got == {1: ("0", False), 2: ("0", False), 3: ("0", False), 4: ("1", False), 5: ("2", False), 6: ("3", False), 7: ("3", False), 8: ("", False)}


@pytest.mark.parametrize("bound", [500_000, 0])
def test_decontamination_broadcast_and_shuffled(spark, edges, monkeypatch, bound):
    """Few plain words, short items as whole lines, columns of clashing names, and both ways of the join."""
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", bound)
    sums = "Ann has 12 apples and 7 pears while Bob has 30 plums and 4 figs in total"
    benchmark = spark.createDataFrame([(1, sums), (2, "Two words"), (3, ITEM)], "item_id long, text string").withColumn("doc_id", F.lit(9)).withColumn("hash", F.lit("x"))
    rows = [(1, sums.replace("12", "9").replace("7", "9").replace("Bob", "Al Ray").replace("30", "1,000")), (2, "one line\n- Two words!\nmore"), (3, "only two words in a longer line"), (4, "two WORDS"), (5, ITEM), (5, ITEM), (6, None)]
    texts = docs(spark, rows).withColumn("item_id", F.lit(1)).withColumn("place", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((r.doc_id, r.item_ids, r.reworded) for r in decontam.contaminated(texts, benchmark).collect())
    assert got == [(1, "1", True), (2, "2", False), (3, "", False), (4, "2", False), (5, "3", False), (5, "3", False), (6, "", False)]
    assert decontam.drop_contaminated(texts, benchmark).columns == texts.columns
    assert not any(r.contaminated for r in decontam.contaminated(edges, benchmark).collect())


# ---------------------------------------------------------------- 5


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (17, 9), (24, 33)])
def test_webp_round_trips_every_feature(shape):
    rng = np.random.default_rng(1)
    smooth = (np.add.outer(np.arange(shape[0]) * 3, np.arange(shape[1]) * 2) % 200).astype(np.uint32) * np.uint32(0x01010101)
    noise = rng.integers(0, 2**32, shape, dtype=np.uint64).astype(np.uint32)
    few = rng.integers(0, 2**32, 7, dtype=np.uint64).astype(np.uint32)[rng.integers(0, 7, shape)]
    for image in (smooth, noise, few):
        features = [{}, *({"predictor": m} for m in range(14)), {"cross": (5, -9, 77)}, {"green": True}, {"cache_bits": 4}, {"runs": True},
                    {"runs": True, "cache_bits": 6, "group_block": 2, "predictor": 11, "cross": (-100, 3, 40), "green": True}]
        if np.unique(image).size <= 256:
            features += [{"palette": True}, {"palette": True, "runs": True, "predictor": 4}]
        for feature in features:
            (got,) = webp.decode(webp.encode_argb(image, **feature))
            assert (got == image).all(), feature


def test_media_column(spark, edges):
    stored = media.encode(edges)
    for r, (_, text) in zip(sorted(media.read_back(stored).collect(), key=lambda r: r.doc_id), sorted(EDGES, key=lambda e: e[0])):
        raw = (text or "").encode()
        whole = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert len({(r.media_sha256, r.feature) for r in media.read_back(stored.where("doc_id IN (5, 6)")).collect()}) == 1
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert all(r.pixels is None and r.error for r in media.decode(broken).collect())
    assert media.decode(stored).where("error IS NULL").count() == len(EDGES)


# ---------------------------------------------------------------- 6


def test_line_templates(spark, edges):
    passage = "this very long passage " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(1, f"first own line of text here\n{passage}"), (2, f"{passage}\nsecond own line of text here too"), (3, passage), (4, "job 17 of 40 took 3 seconds to run on node a"), (5, "job 18 of 99 took 5 seconds to run on node a\nkept"), (6, "short line"), (7, "short line"), (8, None), (9, "")]
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs(spark, rows)).collect()}
    assert got == {1: rows[0][1], 2: "second own line of text here too", 4: rows[3][1], 5: "kept", 6: "short line", 7: "short line", 8: None, 9: ""}
    free = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
    other = free.replace("zeta eta", "user seventeen")
    assert set(lines.template_keys(free)) & set(lines.template_keys(other))
    assert lines.report(edges).count() == len({i for i, _ in EDGES})
    assert lines.drop_recurring_lines(edges).columns == edges.columns


def test_short_and_unspaced_lines_recur(spark):
    license, notice = "Released under the MIT License.", "版权所有未经许可不得转载"
    rows = [(i, f"own{i}\n{license}\nPage {i} of 9\n{i}{i}") for i in range(1, 5)] + [(5, f"甲\n{notice}"), (6, f"乙\n  {notice}"), (7, "Twice only"), (8, "Twice only")]
    got = {r.doc_id: r.text for r in lines.drop_recurring_lines(docs(spark, rows)).collect()}
    # numbers alone stand as they read; two documents may share a short line by chance
    assert got == {1: rows[0][1], 2: "own2\n22", 3: "own3\n33", 4: "own4\n44", 5: rows[4][1], 6: "乙", 7: "Twice only", 8: "Twice only"}
    assert {r.doc_id: r.n_dropped for r in lines.report(docs(spark, rows)).collect()} == {1: 0, 2: 2, 3: 2, 4: 2, 5: 0, 6: 1, 7: 0, 8: 0}


# ---------------------------------------------------------------- 7


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("words,threshold", [(3, 0.85), (5, 0.8)])
def test_near_duplicates_match_brute_force(spark, words, threshold, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 4)
    monkeypatch.setattr(neardup, "CHUNK", 16)
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows, n = [(0, None), (1, ""), (2, "one"), (3, "one"), (4, "ONE"), (5, "two words")], 6
    for size, edits in ((120, 3), (60, 2), (300, 12), (30, 1)):
        base = rng.choices(vocabulary, k=size)
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randrange(edits + 1)):
                copy[rng.randrange(size)] = rng.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), words, threshold).collect()}
    assert got == brute(rows, words, round(threshold * 100))


@pytest.mark.parametrize("common,union", [(34, 40), (68, 80)])
def test_sketches_let_threshold_pairs_of_small_sets_pass(common, union):
    rng, more = np.random.default_rng(7), (union - common) // 2
    drawn = rng.integers(0, 2**64, (20_000, union), np.uint64)
    codes = [neardup.codes(neardup.sketch(list(x))) for x in (drawn[:, : common + more], drawn[:, more:])]
    # the rows share the middle, common values
    n = np.full(len(drawn), common + more)
    assert neardup._passing((codes[0] == codes[1]).sum(axis=1), n, n, common / union).all()


def test_near_duplicates_edges(spark, edges):
    got = neardup.near_duplicates(edges, 3, 0.85).collect()
    assert len(got) == len(EDGES) and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert neardup.near_duplicates(edges.limit(0)).count() == 0
    assert neardup.keep_first(edges).columns == edges.columns


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 60)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(150)] + [(5, 5), (9, 1)]
    parent = {x: x for p in pairs for x in p}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    edges = spark.createDataFrame(pairs + [(None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {x: top(x) for x in {y for p in pairs if p[0] != p[1] for y in p}}
    assert components.connected_components(edges.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def test_base_secrets():
    spans = secrets.base_spans('x PassWord = "abcdefghijkl" token: secret: abcdefghijklmnop AKIA12345678901234 AKIA1 0123456789abcdef0')
    assert [(k, b - a) for a, k, b in sorted(spans)] == [(0, 24), (1, 18), (2, 17)]


def test_weak_parts_need_each_other(spark, edges):
    pair = "login: deploybot key Zx9Kd82LmQ0pRt7VwYb3 at https://vault.example.org/x"
    alone = "see Zx9Kd82LmQ0pRt7VwYb3 or https://vault.example.org/x"
    far = "login: deploybot\n\n" + alone
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan(docs(spark, [(1, pair), (2, alone), (3, far), (4, None)]))).collect()}
    assert [s.split(":")[0] for s in got[1].split(",")] == ["link_id", "link_secret", "link_endpoint"]
    assert got[2] == got[3] == got[4] == ""
    rows = secrets.digest(secrets.scan(edges)).collect()
    assert len(rows) == len(EDGES) and all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows)


# ---------------------------------------------------------------- 9


def test_quotes_become_threads(spark):
    rows = [
        (1, 0, "u", "Hello there.\n\nHow does the pump work?"), (1, 1, "a", "> how does the  pump work?\nIt turns."), (1, 2, "u", "> It turns.\n>> How does the pump work?\n\nThanks"),
        (1, 3, "a", "no quote"), (2, 0, "u", "> It turns.\nfrom elsewhere"), (2, 1, "a", "> nobody said this\nok"), (3, 0, "u", None), (3, 0, "u", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in chat.conversations(df).collect()}
    assert chat.conversations(df).count() == len(rows)
    assert (got[1, 1].reply_turn, got[1, 2].reply_turn, got[1, 3].reply_turn) == (0, 1, None)
    assert (got[1, 2].thread_turn, got[1, 2].depth, got[1, 2].text) == (0, 2, "Thanks")
    assert (got[2, 0].reply_conv, got[2, 0].reply_turn, got[2, 0].depth) == (1, 1, 2)
    assert got[2, 1].reply_conv is None and got[2, 1].text == "ok"
    assert chat.conversations(df.limit(0)).count() == 0


def test_quotes_of_parts_find_their_message(spark):
    whole = "a one\na two\n\nb three\n\nc four\nc five\nc six"
    rows = [
        (1, 0, whole), (1, 1, "> a one\n> a two\nparagraph"), (1, 2, "> b three\n>\n> c four\n> c five\n> c six\n\ntwo paragraphs"), (1, 3, "> c four\n> c five\nlines"), (1, 4, "> c six\n> not said\npart"),
        (2, 0, "yes"), (2, 1, "yes\na longer line\nend"), (2, 2, "> yes\n> a longer line\nthe longest counts"), (2, 3, "> never said\n> nor this\nnone"),
    ]
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn int, role string, text string")
    got = {(r.conv_id, r.turn): r.reply_turn for r in chat.conversations(df).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (1, 3): 0, (1, 4): 0, (2, 0): None, (2, 1): None, (2, 2): 1, (2, 3): None}


# ---------------------------------------------------------------- 10

RULES = urls.parse_rules("allow com/\nblock example.com/en/\nallow www.example.com/en/\nblock net/es/")


def test_url_rules_and_aliases(spark):
    rows = [
        (1, "http://A.Example.COM/en/1", None), (2, "https://www.example.com/en/1?x#y", None), (3, "http://x.org/a", '<link rel="canonical" href="https://q.net/es/7">'),
        (4, "https://q.net/es/7/", None), (5, "http://x.org/a#frag", ""), (6, None, None), (7, "no scheme", None), (8, "http://b.com", None),
        (9, "http://y.org/r", '<meta http-equiv="refresh" content="0; url=http://b.com/t">'), (10, "http://y.org/r/", None), (11, "http://b.com/t", None), (12, "http://Notcom/", None), (1, "http://A.Example.COM/en/1", None),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, RULES).collect()}
    assert got[1] == ("a.example.com", "/en/1", "example.com/en/", "block") and got[2][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[3][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8] == ("b.com", "", None, "allow")
    assert got[9][2:] == got[10][2:] == (None, "allow") and got[12][2] is None
    assert urls.judge(pages, RULES).count() == len(rows) and urls.judge(pages.limit(0), RULES).count() == 0


# ---------------------------------------------------------------- all

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")
def test_pipeline_runs_and_keeps_clean_documents(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = source
    for name, stage in pipeline.STAGES[:-1]:
        kept = stage(spark, kept, FOLDER)
        assert kept.columns == source.columns, name
    out = pipeline.run(spark, FOLDER)
    assert out.select("doc_id").distinct().count() > 0.5 * source.count()
