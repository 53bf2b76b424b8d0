"""Queries of passages, index maintenance and retrieval."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from clausewise.adapt import ref_date, sql
from clausewise.operators import catalog as c
from clausewise.operators import passages as p
from clausewise.operators import postings
from clausewise.operators import search as s
from clausewise.operators import vectors
from clausewise.plans.catalog import SCOPE
from clausewise.work import shared_dir, written

MODEL, RULES = "m2", 3

# ---------------------------------------------------------------- passages

_ROOTED = """kinds AS (SELECT t.*, q.kind AS parent_kind, q.ordinal AS q1, q.parent_ordinal AS q2 FROM tree t LEFT JOIN tree q ON q.doc_id = t.doc_id AND q.ordinal = t.parent_ordinal),
rooted AS (SELECT k.*, CASE WHEN kind IN ('table_row', 'heading') THEN NULL WHEN kind IN ('table', 'form') OR parent_kind IS NULL OR parent_kind <> 'prose' THEN ordinal WHEN ordinal % 12 = 3 THEN ordinal - 2 ELSE parent_ordinal END AS root_ordinal FROM kinds k),
heads AS (SELECT r.doc_id, r.version_id, r.ordinal, r.path AS root, r.kind, d.title || CASE WHEN q.ordinal IS NULL THEN '' ELSE ' > ' || substr(trim(q.heading), 1, 120) END || chr(10) || r.path AS header, trim(coalesce(r.heading, '')) AS heading, r.text
  FROM rooted r JOIN docs d USING (doc_id) LEFT JOIN tree q ON q.doc_id = r.doc_id AND q.ordinal = r.parent_ordinal WHERE r.root_ordinal = r.ordinal),
owns AS (SELECT *, header || CASE WHEN heading = '' THEN '' ELSE chr(10) || heading END || chr(10) || text || CASE kind WHEN 'table' THEN chr(10) || '연번 | 원료명' ELSE '' END AS own FROM heads),
parts AS (SELECT doc_id, root_ordinal, CASE WHEN ordinal % 12 = 3 THEN ordinal - 1 ELSE ordinal END AS block, string_agg(string_split(path, '/')[-1] || ' ' || text, chr(10) ORDER BY ordinal) AS text FROM rooted WHERE root_ordinal < ordinal GROUP BY 1, 2, 3)"""


def _clauses(t):
    return t.tree()


def _assembled(t):
    return p.assembled(_clauses(t), t.documents().select("doc_id", "title"))


def _heads(t):
    """Passages by the hash of their headers, as what an index would hold."""
    return _assembled(t).select("version_id", "root", F.lit(0).alias("fragment_index"), F.sha2("header", 256).alias("content_hash"))


def _index(t):
    """An older index: some hashes, models and rules differ, some passages are missing and one more a version is not produced any more."""
    v = F.col("version_id")
    rows = _heads(t).where(v % 9 != 1).select(*p.KEY, F.when(F.col("root").contains("제1장"), "old").otherwise(F.col("content_hash")).alias("content_hash"), F.when(v % 4 == 1, "m1").otherwise(MODEL).alias("model"), F.when(v % 5 == 1, RULES - 1).otherwise(RULES).alias("passage_version"))
    gone = t.versions().where("v = 1").select(v.alias("version_id"), F.lit("gone").alias("root"), F.lit(0).alias("fragment_index"), F.lit("x").alias("content_hash"), F.lit(MODEL).alias("model"), F.lit(RULES).alias("passage_version")).where(v % 9 == 2)
    return rows.unionByName(gone)


_INDEX = f"""now AS (SELECT version_id, root, sha256(header) AS content_hash FROM heads),
held AS (SELECT version_id, root, CASE WHEN contains(root, '제1장') THEN 'old' ELSE content_hash END AS content_hash, CASE WHEN version_id % 4 = 1 THEN 'm1' ELSE '{MODEL}' END AS model, CASE WHEN version_id % 5 = 1 THEN {RULES - 1} ELSE {RULES} END AS rules FROM now WHERE version_id % 9 <> 1
  UNION ALL SELECT version_id, 'gone', 'x', '{MODEL}', {RULES} FROM versions WHERE v = 1 AND version_id % 9 = 2)"""

# ---------------------------------------------------------------- retrieval


def _queries(t):
    """The stated query set: user turns of every hundredth conversation, which name articles, an annex row, a cell and the words of a row; their vectors are those of their conversations' numbers."""
    k = F.col("conv_id") % 40
    cell = F.when(k % 2 == 0, "en-samd").otherwise("en-cosmetic")
    named = t.tree().where("ordinal = 7").select(F.col("doc_id").alias("n"), F.element_at("columns", "원료명").alias("named"))
    turns = t.raw("conversations").where("conv_id % 100 = 0 AND role = 'user'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat("text", F.lit(" 제 "), (F.col("turn") % 3 * 12 + 1).cast("string"), F.lit(" 조 "), (F.col("turn") + 1000).cast("string"), F.lit("x 50-00-0 갈라민트리에는 ")).alias("query"), cell.alias("cell_id"), F.col("conv_id").alias("n"))
    vectors = t.raw("embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("q"))
    return turns.join(vectors, "n").join(named, "n", "left").withColumn("query", F.concat("query", F.coalesce("named", F.lit("")))).drop("n", "named")


_QUERIES = """qs AS (SELECT conv_id * 1000 + turn AS query_id, text || ' 제 ' || (turn % 3 * 12 + 1) || ' 조 ' || (turn + 1000) || 'x 50-00-0 갈라민트리에는 ' || coalesce(named, '') AS query, CASE WHEN conv_id % 2 = 0 THEN 'en-samd' ELSE 'en-cosmetic' END AS cell_id, '제' || (turn % 3 * 12 + 1) || '조' AS article, embedding AS q FROM conversations JOIN embeddings ON vec_id = conv_id
  LEFT JOIN (SELECT doc_id, first AS named FROM tree WHERE ordinal = 7) m ON m.doc_id = conv_id WHERE conv_id % 100 = 0 AND role = 'user'),
prefixes AS (SELECT DISTINCT query_id, cell_id, p FROM (SELECT query_id, cell_id, unnest(regexp_split_to_array(lower(query), '[^\\p{L}\\p{N}_.\\-/§]+')) AS p FROM qs UNION ALL SELECT query_id, cell_id, '갈라민트리에' FROM qs) WHERE p <> ''),
terms AS (SELECT DISTINCT query_id, cell_id, term FROM (SELECT query_id, cell_id, unnest(regexp_split_to_array(query, '[^\\p{L}\\p{N}_.\\-]+')) AS term FROM qs UNION ALL SELECT query_id, cell_id, unnest(['갈라민트리에', '갈라민트리']) FROM qs) WHERE length(term) >= 5 AND NOT regexp_matches(term, '^\\d+$'))"""


def _scoped(t):
    """Clauses of the versions in scope, once for each cell that claims their document."""
    scope = c.version_scope(t.versions(), ref_date()).select("doc_id", "version_id")
    return t.trees().join(scope, ["doc_id", "version_id"], "left_semi").join(t.document_cells(), "doc_id")


def _vector_index(t):
    """One vector for the first article of each document in scope."""
    first = _scoped(t).where("ordinal = 1").select("doc_id", "version_id", "path", "cell_id")
    return t.raw("embeddings").select(F.col("vec_id").alias("doc_id"), "vec_id", "embedding").join(first, "doc_id").select("vec_id", "embedding", "version_id", "path", "cell_id")


_COSINE = "round(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(q.q AS DOUBLE[])) / sqrt(list_inner_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) * list_inner_product(CAST(q.q AS DOUBLE[]), CAST(q.q AS DOUBLE[]))), 9)"
_RANKED = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ordinal, version_id, path) - 1 AS rank"
_ARMS = f"""{SCOPE}, {_QUERIES}, scoped AS (SELECT t.*, dc.cell_id FROM trees t JOIN scope s ON s.doc_id = t.doc_id AND s.version_id = t.version_id JOIN doc_cells dc ON dc.doc_id = t.doc_id),
lex AS (SELECT *, {_RANKED} FROM (SELECT query_id, version_id, path, ordinal, round(count(DISTINCT pos) * 0.1, 6) AS score FROM (SELECT version_id, path, ordinal, cell_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos FROM (
  SELECT version_id, path, ordinal, cell_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', heading, text)), '[^\\p{{L}}\\p{{N}}_.\\-/§]+'), lambda x: x <> '') AS w FROM scoped WHERE kind <> 'table_row')) k JOIN prefixes x ON x.cell_id = k.cell_id AND starts_with(k.token, x.p) GROUP BY ALL)),
ids AS (SELECT *, {_RANKED} FROM (SELECT DISTINCT query_id, version_id, path, ordinal, 1.0 AS score FROM scoped JOIN qs USING (cell_id) WHERE list_contains(string_split(path, '/'), article))),
cells AS (SELECT version_id, path, ordinal, cell_id, unnest([CAST(ordinal AS VARCHAR), first]) AS value FROM scoped WHERE kind = 'table_row'),
named AS (SELECT *, {_RANKED} FROM (SELECT query_id, version_id, path, ordinal, max(CASE WHEN value = term THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS score FROM cells JOIN terms USING (cell_id) WHERE value <> '' AND left(lower(value), 4) = left(lower(term), 4) AND (starts_with(lower(value), lower(term)) OR (length(value) >= 4 AND starts_with(lower(term), lower(value)))) GROUP BY 1, 2, 3, 4)),
vectors AS (SELECT vec_id, embedding, version_id, path, cell_id FROM embeddings JOIN (SELECT * FROM scoped WHERE ordinal = 1) f ON f.doc_id = vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT q.query_id, e.vec_id, e.version_id, e.path, {_COSINE} AS score FROM vectors e JOIN qs q USING (cell_id) WHERE e.vec_id <> q.query_id)),
arms AS (SELECT query_id, version_id, path, rank, 1.2 AS w, 0.0 AS boost FROM lex WHERE rank < 40 UNION ALL SELECT query_id, version_id, path, rank, 1.2, 100.0 FROM ids WHERE rank < 40 UNION ALL SELECT query_id, version_id, path, rank, 1.0, 0.0 FROM near WHERE rank < 40
  UNION ALL SELECT query_id, version_id, path, rank, 1.2, CASE WHEN score >= 1 THEN 100.0 ELSE 0.0 END FROM named WHERE rank < 40),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, version_id) - 1 AS rank FROM (SELECT query_id, version_id, path, round(sum(w / (60 + rank + 1)) + sum(boost), 9) AS score FROM arms GROUP BY 1, 2, 3)),
hits AS (SELECT f.*, t.kind, t.effective_date FROM fused f JOIN trees t ON t.version_id = f.version_id AND t.path = f.path WHERE f.rank < 8)"""


def _retrieved(t):
    return s.retrieved(_queries(t), _scoped(t), _vector_index(t))


def _vectors(t):
    e = t.raw("embeddings")
    return s.vector_arm(e.select("vec_id", "embedding"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))


def _near(t, recall):
    """The vector arm from a written index, with as many lists as reach ``recall``, or with all."""
    e = t.raw("embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    index = vectors.VectorIndex(t.spark, f"{shared_dir(t.spark)}/vectors-{uuid.uuid4().hex}")
    index.build(e)
    return index.search(queries, index.fitted(queries, recall) if recall else None)


def _rows(t):
    return t.raw("part").select(F.col("p_partkey").alias("version_id"), F.lit("row").alias("path"), F.lit(0).alias("ordinal"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")).alias("columns"))


def _terms(t):
    k = t.raw("part").where("p_partkey % 100 = 0")
    return k.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("term")).unionByName(k.select(F.col("p_partkey").alias("query_id"), F.upper(F.substring("p_type", 1, 6)).alias("term")))


def _asked(t):
    """Questions that name an article by their line's number, with and without branch, an annex and a section."""
    k = F.col("ordinal")
    return t.lines().select("doc_id", "ordinal", F.concat(F.lit("제 "), k.cast("string"), F.lit(" 조"), F.when(k % 3 == 0, "의 2").otherwise(""), F.lit(" 및 별표 "), (k % 7).cast("string"), F.when(k % 2 == 0, " § 892.2050").otherwise(""), F.lit(" 제"), k.cast("string"), F.lit("조")).alias("query"))


def _refreshed(t):
    """An index of an older state of the corpus (some documents unknown, some with other texts), brought to the present one (some gone)."""
    now, k = t.trees(), F.col("doc_id")
    index = postings.Index(t.spark, f"{shared_dir(t.spark)}/postings-{uuid.uuid4().hex}")
    index.refresh(now.where(k % 5 != 2).withColumn("text", F.when(k % 9 == 1, "an older text").otherwise(F.col("text"))))
    return index, index.refresh(now.where(k % 7 != 3))


def _searched(t):
    """The lexical arm from written postings, kept up over two states: the second has all documents again."""
    index, _ = _refreshed(t)
    index.refresh(t.trees())
    index.compacted()
    wanted = _queries(t).select("query_id", "cell_id", F.explode(s.query_prefixes(F.col("query"))).alias("prefix"))
    scope = c.version_scope(t.versions(), ref_date()).select("doc_id", "version_id").join(t.document_cells(), "doc_id")
    return index.search(wanted, s.CANDIDATES, scope, ("cell_id",))


def _cited(t):
    """What may be cited of what was retrieved: only the trees of versions that were hit are rooted."""
    hits = written(_retrieved(t), "hits")
    return s.citable(hits, p.rooted(t.trees_of(hits.select((F.floor(F.col("version_id") / 10)).alias("doc_id"), "version_id").distinct())))


def _dated(t):
    """The date scope of what was retrieved."""
    hits = written(_retrieved(t), "hits")
    return s.date_scope(s.resolved_clauses(hits, t.trees(), t.versions()).join(hits.select("query_id", "version_id", "path"), ["version_id", "path"]), ref_date())


QUERIES = {
    "R3_identifiers": (
        lambda t: _asked(t).select("doc_id", "ordinal", F.array_join(s.identifiers(F.col("query")), ",").alias("names")),
        sql("SELECT doc_id, ordinal, '제' || ordinal || '조' || CASE WHEN ordinal % 3 = 0 THEN '의2,제' || ordinal || '조' ELSE '' END || ',별표' || ordinal % 7 || CASE WHEN ordinal % 2 = 0 THEN ',§ 892.2050' ELSE '' END AS names FROM lines")),
    "R4_annex_terms": (
        lambda t: t.raw("part").select("p_partkey", F.array_join(s.annex_terms(F.concat(F.col("p_partkey").cast("string"), F.lit("-00-0 갈라민트"), F.when(F.col("p_partkey") % 2 == 0, "리에는 ").otherwise(" "), F.translate("p_brand", "#", "x"))), ",").alias("terms")),
        """SELECT p_partkey, concat_ws(',', CASE WHEN length(CAST(p_partkey AS VARCHAR)) BETWEEN 2 AND 7 THEN p_partkey || '-00-0' END, CASE WHEN length(CAST(p_partkey AS VARCHAR)) = 1 THEN p_partkey || '-00-0' END,
          CASE WHEN p_partkey % 2 = 0 THEN '갈라민트리에는,갈라민트리에,갈라민트리' END, CASE WHEN length(b) >= 5 THEN b END) AS terms FROM (SELECT p_partkey, replace(p_brand, '#', 'x') AS b FROM part)"""),
    "R5_query_prefixes": (
        lambda t: t.raw("part").select("p_partkey", F.array_join(s.query_prefixes(F.concat(F.lit("화장품의 & | "), F.when(F.col("p_partkey") % 2 == 0, "고시는 ").otherwise("화장품의 "), F.translate("p_brand", "#", "x"), F.lit(" 가나다"))), " | ").alias("q")),
        "SELECT p_partkey, '화장품의 | 화장품 | ' || CASE WHEN p_partkey % 2 = 0 THEN '고시는 | ' ELSE '' END || lower(replace(p_brand, '#', 'x')) || ' | 가나다' AS q FROM part"),
    "R6_lexical_arm": (
        lambda t: s.lexical_arm(_scoped(t), _queries(t).select("query_id", "query", "cell_id"), by=("cell_id",)).select("query_id", "version_id", "path", "score", "rank"),
        sql("SELECT query_id, version_id, path, score, rank FROM lex WHERE rank < 40", _ARMS)),
    "R6_written_postings": (
        lambda t: _searched(t).select("query_id", "version_id", "path", "score", "rank"),
        sql("SELECT query_id, version_id, path, score, rank FROM lex WHERE rank < 40", _ARMS)),
    "G8_postings_refresh": (
        lambda t: _refreshed(t)[1],
        sql("SELECT version_id, CASE WHEN NOT a THEN 'pruned' WHEN NOT b THEN 'indexed' WHEN doc_id % 9 = 1 THEN 'indexed' ELSE 'kept' END AS action FROM (SELECT DISTINCT doc_id, version_id, doc_id % 7 <> 3 AS a, doc_id % 5 <> 2 AS b FROM trees) WHERE a OR b")),
    "R7_vector_arm": (
        lambda t: _vectors(t).select("query_id", "vec_id", F.round("score", 6).alias("score")),
        f"SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.replace('q.q', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.replace('q.q', 'q.embedding')} DESC, e.vec_id) - 1 AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE rank < 40"),
    "R7_index_exact": (
        lambda t: _near(t, None).select("query_id", "vec_id", F.round("score", 6).alias("score")),
        f"SELECT query_id, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, e.vec_id, {_COSINE.replace('q.q', 'q.embedding')} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSINE.replace('q.q', 'q.embedding')} DESC, e.vec_id) - 1 AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE rank < 40"),
    "R7_index_fitted": (lambda t: _near(t, 0.95).select("query_id", "vec_id", F.round("score", 6).alias("score")), None),
    "R8_identifier_arm": (
        lambda t: s.identifier_arm(t.clauses(), t.documents().where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array(F.concat(F.lit("A"), (F.col("doc_id") / 100 % 7 + 2).cast("int").cast("string")), F.concat(F.lit("A3/I"), (F.col("doc_id") / 100 % 4 + 1).cast("int").cast("string"))).alias("names"))).select("query_id", "version_id", "path"),
        sql("SELECT query_id, version_id, path FROM (SELECT query_id, c.*, row_number() OVER (PARTITION BY query_id ORDER BY ordinal, version_id, path) AS rn FROM (SELECT doc_id AS query_id, 'A' || (doc_id // 100 % 7 + 2) AS article, 'A3/I' || (doc_id // 100 % 4 + 1) AS item FROM docs WHERE doc_id % 100 = 0) d JOIN clauses c ON string_split(c.path, '/')[1] = article OR c.path = item) WHERE rn <= 40")),
    "R9_row_arm": (
        lambda t: s.row_arm(_rows(t), _terms(t)).select("query_id", F.col("version_id").alias("row_id"), "score"),
        """WITH cells AS (SELECT p_partkey AS row_id, unnest([p_name, p_brand, p_type]) AS cell FROM part), terms AS (SELECT p_partkey AS query_id, unnest([p_name, upper(substr(p_type, 1, 6))]) AS term FROM part WHERE p_partkey % 100 = 0)
        SELECT query_id, row_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rn FROM (SELECT query_id, row_id, max(CASE WHEN cell = term THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END) AS score FROM cells
          JOIN terms ON starts_with(lower(cell), lower(term)) OR (length(cell) >= 4 AND starts_with(lower(term), lower(cell))) GROUP BY 1, 2)) WHERE rn <= 40"""),
    "R10_rank_fusion": (
        lambda t: s.fuse(s.arms_of(_queries(t), _scoped(t), _vector_index(t))).select("query_id", "version_id", "path", "rank", F.round("score", 6).alias("score")),
        sql("SELECT query_id, version_id, path, rank, round(score, 6) AS score FROM fused WHERE rank < 8", _ARMS)),
    "R11_date_scope": (
        lambda t: _dated(t).select("query_id", F.col("scope").cast("string").alias("scope"), "straddles"),
        sql("""SELECT query_id, CAST(coalesce(max(d) FILTER (WHERE d <= DATE '2024-12-01'), min(d) FILTER (WHERE d > DATE '2024-12-01')) AS VARCHAR) AS scope, coalesce(bool_or(d <= DATE '2024-12-01'), false) AND coalesce(bool_or(d > DATE '2024-12-01'), false) AS straddles
          FROM (SELECT query_id, coalesce(h.effective_date, v.effective_date) AS d FROM hits h JOIN versions v USING (version_id)) GROUP BY 1""", _ARMS)),
    "R12_citable_paths": (
        lambda t: _cited(t),
        sql("SELECT query_id, version_id, path FROM hits UNION SELECT query_id, h.version_id, r.path FROM hits h JOIN heads ON heads.doc_id = h.version_id // 10 JOIN rooted r ON r.doc_id = heads.doc_id AND r.root_ordinal = heads.ordinal WHERE heads.root = h.path", f"{_ROOTED}, {_ARMS}")),
    "R13_clause_resolution": (
        lambda t: s.resolved_clauses(t.versions().where("v = 1").select("version_id", F.explode(F.array(F.lit("제1장"), F.lit("별표1/표1/행2"), F.lit("제9장"))).alias("path")), _clauses(t), t.versions()).select("version_id", "path", F.sha2("text", 256).alias("digest")),
        sql("SELECT version_id, path, sha256(text) AS digest FROM tree WHERE path IN ('제1장', '별표1/표1/행2', '제9장')")),
    "R14_effective_dates": (
        lambda t: s.resolved_clauses(_clauses(t).select("version_id", "path"), _clauses(t), t.versions()).select("version_id", "path", F.col("effective_date").cast("string").alias("day")),
        sql("SELECT version_id, path, CAST(coalesce(t.effective_date, v.effective_date) AS VARCHAR) AS day FROM tree t JOIN versions v USING (version_id)")),
    "R15_retrieve": (
        lambda t: _retrieved(t).select("query_id", "rank", "version_id", "path", "kind", F.round("score", 6).alias("score")),
        sql("SELECT query_id, rank, version_id, path, kind, round(score, 6) AS score FROM hits", _ARMS)),
    "G1_passage_roots": (
        lambda t: p.rooted(_clauses(t)).where("ordinal = root_ordinal").select("version_id", "path"), sql("SELECT version_id, root AS path FROM heads", _ROOTED)),
    "G2_tree_partition": (
        lambda t: p.rooted(_clauses(t)).select("version_id", "path", F.col("root_ordinal").cast("long").alias("root_ordinal")), sql("SELECT version_id, path, root_ordinal FROM rooted", _ROOTED)),
    "G3_headers": (lambda t: _assembled(t).select("version_id", "root", "header"), sql("SELECT version_id, root, header FROM heads", _ROOTED)),
    "G4_rendered_blocks": (
        lambda t: _assembled(t).select("version_id", "root", F.explode("blocks").alias("b")).select("version_id", "root", F.sha2("b.text", 256).alias("digest")),
        sql("SELECT h.version_id, h.root, sha256(parts.text) AS digest FROM parts JOIN heads h ON h.doc_id = parts.doc_id AND h.ordinal = parts.root_ordinal", _ROOTED)),
    "G5_table_passages": (
        lambda t: _assembled(t).where("scope = 'table_header'").select("version_id", "root", F.sha2("own", 256).alias("digest")),
        sql("SELECT version_id, root, sha256(own) AS digest FROM owns WHERE kind = 'table'", _ROOTED)),
    "G6_fragments": (lambda t: p.fragments(_assembled(t)).select("version_id", "root", "scope", "fragment_index", F.size("paths").alias("n_paths"), F.sha2("text", 256).alias("digest")), None),
    "G7_capped_texts": (
        lambda t: p.fragments(_assembled(t)).groupBy("version_id").agg(F.max(F.length("text") - F.length("root")).alias("longest"), F.count("*").alias("n")).select("version_id", (F.col("longest") <= 1200).alias("capped")),
        sql("SELECT DISTINCT version_id, true AS capped FROM heads", _ROOTED)),
    "G8_incremental_index": (
        lambda t: p.index_actions(_heads(t), _index(t), MODEL, RULES).select("version_id", "root", "action"),
        sql(f"SELECT n.version_id, n.root, CASE WHEN h.content_hash = n.content_hash AND model = '{MODEL}' AND rules = {RULES} THEN 'reuse' ELSE 'embed' END AS action FROM now n LEFT JOIN held h USING (version_id, root)", f"{_ROOTED}, {_INDEX}")),
    "G9_prune_fragments": (lambda t: p.pruned(_index(t), _heads(t)).select("version_id", "root"), sql("SELECT version_id, root FROM held WHERE root = 'gone' AND version_id IN (SELECT version_id FROM now)", f"{_ROOTED}, {_INDEX}")),
    "G10_stale_versions": (
        lambda t: p.stale_versions(t.versions(), t.documents(), _index(t), MODEL, RULES, 50).select("version_id"),
        sql(f"SELECT version_id FROM versions LEFT JOIN (SELECT version_id, bool_or(model <> '{MODEL}' OR rules <> {RULES}) AS other FROM held GROUP BY 1) USING (version_id) JOIN docs USING (doc_id) WHERE parsed AND doc_type <> 'feed' AND coalesce(other, true) ORDER BY retrieved_at DESC, version_id LIMIT 50", f"{_ROOTED}, {_INDEX}")),
    "G11_scope_histogram": (
        lambda t: _assembled(t).groupBy("scope").agg(F.count("*").alias("n")),
        sql("SELECT CASE kind WHEN 'table' THEN 'table_header' WHEN 'form' THEN 'form' ELSE 'article' END AS scope, count(*) AS n FROM heads GROUP BY 1", _ROOTED)),
    "G12_index_coverage": (
        lambda t: p.index_coverage(t.versions(), t.document_cells(), _index(t)),
        sql("SELECT cell_id, count(DISTINCT version_id) AS versions, count(DISTINCT CASE WHEN version_id IN (SELECT version_id FROM held) THEN version_id END) AS indexed FROM versions JOIN doc_cells USING (doc_id) WHERE parsed GROUP BY 1", f"{_ROOTED}, {_INDEX}")),
}
