"""Written things: page folders, the write-once archive, postings, stored tables and chains, each over more than one run."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewise.operators import catalog, postings, search, stored, vectors
from clausewise.sources import payloads


def index_pages(folder, sizes, broken=()):
    Path(folder).mkdir(parents=True, exist_ok=True)
    n = 0
    for page, size in enumerate(sizes, 1):
        items = []
        for _ in range(size):
            n += 1
            items.append(f"<admrul><행정규칙ID>{n}</행정규칙ID><행정규칙명>rule {n}</행정규칙명></admrul>")
        Path(folder, f"page-{page:05d}").write_text("<broken" if page in broken else f"<x>{''.join(items)}<admrul><행정규칙ID>9</행정규칙ID></admrul></x>")


def test_a_walk_ends_at_the_first_short_page_or_says_that_it_was_cut(spark, tmp_path):
    payloads.register(spark)
    for name, sizes, cap, want in (("short", [3, 3, 2, 3], 9, (8, False)), ("cut", [3, 3, 3], 2, (6, True)), ("full", [3, 3, 3], 4, (9, False)), ("exact", [3, 3], 2, (6, True)), ("none", [], 2, (0, False))):
        folder = str(tmp_path / name)
        index_pages(folder, sizes)
        pages = spark.read.format("admrul_index").option("path", folder).option("page_size", 3).load()
        entries, truncated = payloads.index_walk(pages, cap)
        got = [r.truncated for r in truncated.collect()]
        assert (entries.count(), bool(got[0])) == want, name


def test_pages_are_partitions_and_filters_leave_them_out(spark, tmp_path):
    payloads.register(spark)
    index_pages(tmp_path / "in", [2] * 6, broken=(4,))
    pages = spark.read.format("admrul_index").option("path", str(tmp_path / "in")).load()
    assert pages.rdd.getNumPartitions() == 6
    chosen = pages.where("page > 2 AND page <= 4 AND title IS NOT NULL")
    assert sorted({r.page for r in chosen.collect()}) == [3] and pages.where("page = 5").rdd.getNumPartitions() == 1
    (bad,) = pages.where("error IS NOT NULL").collect()
    assert bad.page == 4 and bad.title is None and not bad.full
    with pytest.raises(Exception, match="no_such_connector"):
        spark.read.format("no_such_connector").option("path", "x").load()


def test_a_stream_reads_each_page_once(spark, tmp_path):
    payloads.register(spark)
    source, target, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for sizes in ([2, 2], [2, 2, 2, 1]):
        index_pages(source, sizes)
        spark.readStream.format("admrul_index").option("path", source).load().writeStream.format("parquet").option("path", target).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(int(r.admrul_id) for r in spark.read.parquet(target).collect()) == [1, 2, 3, 4, 5, 6, 7]


def test_the_archive_writes_once(spark, tmp_path):
    folder = str(tmp_path / "archive")
    bodies = ["one", "two", "two", "see http://x?key=abc", "the token SECRET1 is here", None, ""]
    rows = spark.createDataFrame([(b,) for b in bodies], "body string")
    payloads.archive(rows, folder, ("SECRET1",))
    first = {f: f.stat().st_mtime_ns for f in Path(folder, "sha256").rglob("*") if f.is_file() and not f.name.startswith(".")}
    payloads.archive(rows.union(spark.createDataFrame([("three",)], "body string")), folder, ("SECRET1",))
    assert {f: f.stat().st_mtime_ns for f in first} == first
    objects = payloads.archived_objects(spark, folder).collect()
    assert sorted(bytes(o.body) for o in objects) == [b"one", b"three", b"two"] and all(o.sound for o in objects)
    assert sorted(len(f.read_bytes()) for f in first) == [0, 3, 3]
    assert sorted((c.written, c.kept, c.refused) for c in payloads.commits(spark, folder).collect()) == [(1, 3, 2), (3, 0, 2)]
    assert not list(Path(folder, "_pending").glob("*"))
    with pytest.raises(Exception, match="only appended"):
        rows.select(F.col("body").cast("binary").alias("body")).write.format("write_once").option("path", folder).mode("overwrite").save()


# ---------------------------------------------------------------- postings

CLAUSE = "version_id long, path string, ordinal int, kind string, heading string, text string"


def lexical(df):
    return sorted((r.query_id, r.version_id, r.path, r.score, r["rank"]) for r in df.collect())


def test_postings_answer_as_texts_do(spark, tmp_path):
    rows = [(v, f"A{k}", k, "table_row" if k == 3 else "prose", ("Label " * (k % 2)).strip() or None, f"화장품의 성분 label LABELS lab-{k} a {'x' * k} {v}") for v in range(1, 7) for k in range(6)]
    rows += [(7, "A0", 0, "prose", None, None), (7, "A1", 1, "prose", "", " . , ")]
    clauses = spark.createDataFrame(rows, CLAUSE)
    queries = spark.createDataFrame([(1, "lab 화장품은 x"), (2, "LABEL a"), (3, "화장 6"), (4, " , "), (5, None)], "query_id long, query string")
    want = {}
    for v, path, o, kind, heading, text in rows:
        words = [w for w in __import__("re").split(r"[^\w.\-/§]+", f"{heading or ''} {text or ''}".lower()) if w]
        for q, prefixes in ((1, ("lab", "화장품은", "화장품", "x")), (2, ("label", "a")), (3, ("화장", "6"))):
            if kind != "table_row" and (n := sum(any(w.startswith(p) for p in prefixes) for w in words)):
                want.setdefault(q, []).append((-round(n * 0.1, 6), o, v, path))
    want = sorted((q, v, path, -s, k) for q, hits in want.items() for k, (s, o, v, path) in enumerate(sorted(hits)[:10]))
    assert lexical(search.lexical_arm(clauses, queries, 10)) == want
    index = postings.Index(spark, str(tmp_path / "index"))
    index.refresh(clauses)
    wanted = queries.select("query_id", F.explode(search.query_prefixes(F.col("query"))).alias("prefix"))
    assert lexical(index.search(wanted, 10)) == want
    # a second set of queries reads postings only, and of those only the buckets of its leads
    plan = index.search(wanted.where("prefix = 'label'"), 10)
    assert "text" not in plan._jdf.queryExecution().executedPlan().toString().replace("_text", "") and plan.count() > 0


def test_only_changed_versions_are_tokenised_again(spark, tmp_path):
    rows = [(v, f"A{k}", k, "prose", None, f"word{v} common") for v in range(1, 6) for k in range(3)]
    clauses = spark.createDataFrame(rows, CLAUSE)
    index = postings.Index(spark, str(tmp_path / "index"))
    actions = lambda df: {r.version_id: r.action for r in df.collect()}
    assert set(actions(index.refresh(clauses)).values()) == {"indexed"}
    assert set(actions(index.refresh(clauses)).values()) == {"kept"} and index._numbers() == [1]
    later = clauses.where("version_id <> 2").withColumn("text", F.when(F.col("version_id") == 3, "other common").otherwise(F.col("text"))).union(spark.createDataFrame([(9, "A0", 0, "prose", None, "new common")], CLAUSE))
    assert actions(index.refresh(later)) == {1: "kept", 2: "pruned", 3: "indexed", 4: "kept", 5: "kept", 9: "indexed"}
    held = {(r.version_id, r.token) for r in index.postings().collect()}
    assert held == {(r.version_id, r.token) for r in postings.postings(later).collect()}
    segment = spark.read.parquet(str(tmp_path / "index/postings")).where("segment = 2")
    assert {r.version_id for r in segment.collect()} == {3, 9}
    # a refresh that fails before its manifest changes nothing
    segment.limit(0).drop("segment", "bucket").write.parquet(str(tmp_path / "index/postings/segment=3/bucket=0"))
    assert {(r.version_id, r.token) for r in index.postings().collect()} == held
    index.compacted()
    assert {(r.version_id, r.token) for r in index.postings().collect()} == held
    assert {r.token: r.df for r in index.dictionary().collect()}["common"] == 3 * 4 + 1


# ---------------------------------------------------------------- merges and chains


def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    folder = str(tmp_path / "table")
    table = stored.Table(spark, folder, "k long, v string", ["k"])
    rule = lambda held, new: catalog.merged(held, new, ["k"], ["v"])
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k long, v string")
    read = lambda: sorted(((r.k, r.v) for r in table.rows().collect()), key=str)
    assert table.merge("a", rows(*((k, "a") for k in range(100)), (None, "a")), rule)
    files = {f: f.read_bytes() for f in Path(folder, "data").rglob("*.parquet")}
    assert table.merge("b", rows((5, "b"), (500, "b"), (None, "b")), rule) and not table.merge("b", rows((5, "again")), rule)
    assert read() == sorted([*((k, "b" if k == 5 else "a") for k in range(100)), (500, "b"), (None, "b")], key=str)
    assert {f: f.read_bytes() for f in files} == files and table.newest()[0] == 2
    touched = {f.parent.name for f in Path(folder, "data").rglob("*.parquet") if f not in files}
    assert 1 <= len(touched) <= 3
    assert table.merge("nothing", rows().limit(0), rule) and read()[0] == (0, "a")


def test_the_second_of_two_writers_fails_and_changes_nothing(spark, tmp_path):
    one, two = (stored.Table(spark, str(tmp_path / "table"), "k long, v string", ["k"]) for _ in range(2))
    union = lambda held, new: held.unionByName(new)
    one.merge("a", spark.createDataFrame([(1, "a")], "k long, v string"), union)

    def late(held, new):
        one.merge("b", spark.createDataFrame([(2, "b")], "k long, v string"), union)
        return held.unionByName(new)

    with pytest.raises(stored.Conflict):
        two.merge("c", spark.createDataFrame([(3, "c")], "k long, v string"), late)
    assert sorted(r.k for r in two.rows().collect()) == [1, 2]
    two.merge("c", spark.createDataFrame([(3, "c")], "k long, v string"), union)
    assert sorted(r.k for r in one.rows().collect()) == [1, 2, 3]
    # a commit file that was begun and not ended is none
    Path(tmp_path, "table/commits/9").write_text("{")
    assert one.newest()[0] == 3


def test_appends_equal_one_fold(spark, tmp_path):
    rows = spark.range(300).select((F.col("id") % 7).alias("chain"), F.col("id").alias("place"), F.when(F.col("id") % 50 > 0, F.concat(F.lit("b"), F.col("id").cast("string"))).otherwise("").alias("body"))
    log = stored.Chains(spark, str(tmp_path / "log"), "g")
    for name, part in (("a", "place < 100"), ("b", "place >= 100 AND chain <> 3"), ("c", "place >= 100 AND chain = 3"), ("a", "true")):
        log.append(name, rows.where(part))
    got = {(r.chain, r.seq): (r.body, r.prev_hash, r.entry_hash) for r in log.entries().collect()}
    numbered = rows.selectExpr("chain", "row_number() OVER (PARTITION BY chain ORDER BY place) - 1 AS seq", "body")
    want = {(r.chain, r.seq): (r.body, r.prev_hash, r.entry_hash) for r in catalog.audit_chain(numbered, "g").collect()}
    assert got == want and {r.first_bad for r in catalog.verify_chain(log.entries(), "g").collect()} == {None}
    other = stored.Chains(spark, str(tmp_path / "log"), "g")
    number, note = other.newest()
    log.append("d", rows.where("place < 7"))
    with pytest.raises(stored.Conflict):
        other.commit(number + 1, note)


def test_a_long_chain_is_a_stream(spark, tmp_path):
    log = stored.Chains(spark, str(tmp_path / "log"), "g")
    log.append("all", spark.range(1_000_000).select(F.lit(1).cast("long").alias("chain"), F.col("id").alias("place"), F.col("id").cast("string").alias("body")))
    assert catalog.verify_chain(log.entries(), "g").first() == (1, 1_000_000, None)


# ---------------------------------------------------------------- vectors


def test_lists_reach_the_recall_that_was_fitted(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = centres[rng.integers(0, 12, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000, [0.0] * 16), (9001, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 50 = 0 AND vec_id < 1500").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.build(df)
    as_rows = lambda got: sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got.collect())
    exact = as_rows(index.search(queries, None, 10))
    assert exact == as_rows(search.vector_arm(df.where("vec_id < 1500"), queries, 10))
    probes = index.fitted(queries, 0.95, 10)
    near = {(q, v) for q, _, v, _ in as_rows(index.search(queries, probes, 10))}
    assert probes < len(index.centroids()) / 2 and len(near & {(q, v) for q, _, v, _ in exact}) >= 0.9 * len(exact)
    # one vector of all in a list of its own is found all the same
    held = spark.read.parquet(str(tmp_path / "index/lists"))
    assert held.count() == 1500 and held.select("vec_id").distinct().count() == 1500


def test_an_index_of_nothing_answers_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.build(none)
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>"), None).count() == 0
