"""Version chains and the fuzzy stage against brute force."""

import difflib
import random

from pyspark.sql import functions as F

from clausewise.operators import catalog, diff, ingest

CLAUSE = "doc_id long, version_id long, path string, ordinal int, text string, kind string"
VERSION = "doc_id long, version_id long, language string, retrieved_at long, parsed boolean"


def frames(spark, clauses, versions):
    none = F.lit(None).cast("string")
    c = spark.createDataFrame(clauses, CLAUSE).withColumn("content_hash", F.sha2("text", 256)).withColumn("source_ref", none).withColumn("moved_to_ref", none)
    return c, spark.createDataFrame(versions, VERSION)


def found(df):
    return sorted((r.from_version, r.to_version, r.change_kind, r.old_path or "", r.new_path or "") for r in df.collect())


def test_every_version_is_compared_with_the_one_before(spark):
    text = {1: "one", 2: "two", 3: "three", 4: "four"}
    clauses = [(1, v, "A1", 0, text[v], "prose") for v in text] + [(2, 21, "A1", 0, "alone", "prose")]
    versions = [(1, v, "ko", v * 10, True) for v in text] + [(2, 21, "ko", 5, True)]
    assert found(diff.build_diffs(*frames(spark, clauses, versions))) == [(1, 2, "modified", "A1", "A1"), (2, 3, "modified", "A1", "A1"), (3, 4, "modified", "A1", "A1")]


def test_unparsed_versions_and_other_languages_are_passed_over(spark):
    clauses = [(1, v, "A1", 0, f"text {v}", "prose") for v in (1, 2, 3, 4, 5)]
    versions = [(1, 1, "ko", 10, True), (1, 2, "ko", 20, False), (1, 3, "en", 30, True), (1, 4, "ko", 40, True), (1, 5, "en", 50, True)]
    got = found(diff.build_diffs(*frames(spark, clauses, versions)))
    assert got == [(1, 4, "modified", "A1", "A1"), (3, 5, "modified", "A1", "A1")]
    assert {r.version_id: r.previous_id for r in diff.comparable_versions(frames(spark, clauses, versions)[1]).collect()} == {4: 1, 5: 3}


def test_a_citation_is_superseded_by_the_diff_of_its_own_version(spark):
    clauses = [(1, 1, "A1", 0, "same", "prose"), (1, 2, "A1", 0, "same", "prose"), (1, 3, "A1", 0, "other", "prose")]
    c, v = frames(spark, clauses, [(1, k, "ko", k, True) for k in (1, 2, 3)])
    cited = spark.createDataFrame([(1, "A1"), (2, "A1"), (3, "A1")], "version_id long, path string")
    assert [r.version_id for r in diff.superseded_citations(diff.build_diffs(c, v), cited).collect()] == [2]
    (row,) = diff.listing(diff.build_diffs(c, v), c).collect()
    assert (row.old_text, row.new_text, row.from_version, row.to_version) == ("same", "other", 2, 3)


def test_drift_counts_against_the_last_parsed_version(spark):
    clauses = [(1, 1, f"A{k}", k, "x", "prose") for k in range(10)] + [(1, 2, "A1", 0, "x", "prose")] + [(1, 3, f"A{k}", k, "x", "prose") for k in range(5)]
    c, v = frames(spark, clauses, [(1, 1, "ko", 1, True), (1, 2, "ko", 2, False), (1, 3, "ko", 3, True), (1, 4, "ko", 4, True), (1, 5, "ko", 5, True)])
    signals = diff.count_drift(c, v)
    # half of the clauses gone is not beyond the threshold; none at all always is, and after it there is nothing to compare with
    assert {r.version_id: r.signal for r in signals.collect()} == {4: "zero_clauses", 5: "zero_clauses"}
    assert {r.version_id: r.signal for r in diff.count_drift(c, v, 0.4).collect()} == {3: "clause_count_delta", 4: "zero_clauses", 5: "zero_clauses"}
    kept, rest, alerts = ingest.quarantined(v, c, diff.count_drift(c, v, 0.4).select("version_id", "signal"))
    assert sorted(r.version_id for r in kept.collect()) == [1, 2] and {r.version_id for r in rest.collect()} == {1, 2} and alerts.count() == 3


def greedy_by_brute_force(old, new):
    """Pairs of (path, text) in reading order: every old text against every free new one."""
    out, free = [], list(new)
    for path, text in old:
        best, score = None, 0.0
        for n in free:
            r = difflib.SequenceMatcher(None, text[:2048], n[1][:2048], autojunk=False).ratio()
            if r > score:
                best, score = n, r
        if best is not None and score >= 0.6:
            free.remove(best)
            out.append((path, best[0], round(score, 9)))
        else:
            out.append((path, "", 0.0))
    return sorted(out + [("", n[0], 0.0) for n in free])


def test_fuzzy_pairs_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(diff, "BLOCK_TEXTS", 4)
    rng = random.Random(3)
    words = "the label states amount of each part in grams or litres and who made it when under which licence number 가 나 다".split()
    clauses, want = [], {}
    for d in range(12):
        old = [" ".join(rng.choices(words, k=rng.randrange(0, 14))) for _ in range(rng.randrange(1, 14))]
        old += rng.choices(old, k=3)
        new = []
        for t in old:
            letters = list(t)
            for _ in range(rng.randrange(1, 9)):
                at = rng.randrange(len(letters) + 1)
                letters[at : at + rng.randrange(2)] = rng.choice(["", "x", "zq", " w"])
            new.append("".join(letters))
        new = [t for t in new if t not in old] + ["Q" * 3000 + "tail"] * (d % 2)
        rng.shuffle(new)
        sides = [[(f"{s}{k}", t) for k, t in enumerate(side)] for s, side in (("o", old), ("n", new))]
        clauses += [(d, d * 10 + v, p, k, t, "prose") for v, side in enumerate(sides, 1) for k, (p, t) in enumerate(side)]
        want[d * 10 + 2] = greedy_by_brute_force(*sides)
    versions = [(d, d * 10 + v, "ko", v, True) for d in range(12) for v in (1, 2)]
    got = {v: [] for v in want}
    for r in diff.build_diffs(*frames(spark, clauses, versions)).collect():
        got[r.to_version].append((r.old_path or "", r.new_path or "", round(r.similarity or 0.0, 9)))
    assert {v: sorted(x) for v, x in got.items()} == want


def test_common_characters_bound_the_matching():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("abcd 가", k=rng.randrange(30))) for _ in range(2))
        rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
        masks = {}
        for k, c in enumerate(b):
            masks[c] = masks.get(c, 0) | 1 << k
        common = diff.common_characters(a, masks, len(b))
        assert common == rows[-1][-1]
        assert sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()) <= common


def test_repeated_texts_meet_once(spark):
    """A thousand equal old texts and as many equal new ones are one candidate row, and pair in reading order."""
    clauses = [(1, 11, f"o{k:04}", k, "the same line again", "prose") for k in range(1000)] + [(1, 12, f"n{k:04}", k, "the same line again and more", "prose") for k in range(900)]
    c, v = frames(spark, clauses, [(1, 11, "ko", 1, True), (1, 12, "ko", 2, True)])
    rest = diff.paired_rows(c, v).where("basis IS NULL").withColumn("text_hash", F.xxhash64("head"))
    assert diff.fuzzy_candidates(rest).count() == 1
    got = {r.old_path: r.new_path for r in diff.build_diffs(c, v).collect()}
    assert got == {f"o{k:04}": f"n{k:04}" if k < 900 else None for k in range(1000)}


def test_an_open_alert_is_refreshed_in_place(spark):
    rows = [(7, "zero", "k", 1, 10, "old text", None), (7, "zero", "k", 2, 20, "new text", None), (7, "zero", "k", 3, 30, "closed", 5), (8, "zero", "k", 4, 40, None, None)]
    alerts = spark.createDataFrame(rows, "source_id long, signal string, expected string, alert_id long, raised_at long, actual string, resolved_at long")
    got = {r.source_id: (r.alert_id, r.raised_at, r.actual, r.refreshed_at) for r in catalog.one_open_alert(alerts).collect()}
    assert got == {7: (1, 10, "new text", 20), 8: (4, 40, None, 40)}
