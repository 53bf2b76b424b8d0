"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewise.llm import ann, chat, decontam, lines, lm, media, neardup, negatives, packing, quality, secrets, spelling, urls
from clausewise.llm.common import documents, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The vocabulary of op2 and of the pipeline's packing, as the installed library names its place."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.stupid_backoff(documents(spark, sf_dir))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op5_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.encode(documents(spark, sf_dir)))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(documents(spark, sf_dir))


def op7_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), words=3, threshold=0.85)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversations(table(spark, sf_dir, "conversations"))


#: The rules of op10.
URL_RULES = """
allow com/
block example.com/en/
allow www.example.com/en/
block net/es/
block net/fr/
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.parse_rules(URL_RULES))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", shifted), "vec_id % 100 = 0")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_packing": op2_packing,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_decontamination": op4_decontamination,
        "op5_media_webp": op5_media_webp,
        "op6_line_dedup": op6_line_dedup,
        "op7_minhash_near_dup": op7_minhash_near_dup,
        "op8_secret_scan": op8_secret_scan,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_url_filter": op10_url_filter,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_nearest_neighbours": op13_nearest_neighbours,
    }


#: op6: tokens, placeholders and the one exact and four general templates of each line, as strings.
_LINES = """
WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
read AS (SELECT doc_id, k, regexp_extract_all(line, '[\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}]|[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{3FFFF}]+') AS read FROM lines),
marked AS (SELECT doc_id, k, read, len(read) AS n, list_transform(read, lambda x: CASE WHEN regexp_matches(x, '\\p{Nd}') THEN '<*>' ELSE x END) AS tokens, list_transform(read, lambda x: CASE WHEN NOT regexp_matches(x, '\\p{Nd}') AND regexp_matches(x, '\\p{L}') THEN 1 ELSE 0 END) AS literal FROM read WHERE len(read) > 0),
chosen AS (SELECT doc_id, k, n, literal, CASE WHEN list_sum(literal) < least(2, n) THEN read ELSE tokens END AS t FROM marked),
cut AS (SELECT *, list_transform(range(5), lambda q: 2 + (n - 2) * q // 4) AS c FROM chosen),
keys AS (SELECT doc_id, k, n < 6 AS short, 'whole ' || array_to_string(t, ' ') AS key FROM cut
  UNION ALL SELECT doc_id, k, false, q || ' ' || n || ' ' || array_to_string(t[:c[q]], ' ') || ' <*> | ' || array_to_string(t[c[q + 1] + 1:], ' ') FROM cut, (VALUES (1), (2), (3), (4)) AS v(q) WHERE n >= 12 AND list_sum(literal) - coalesce(list_sum(literal[c[q] + 1:c[q + 1]]), 0) >= 2),
recurring AS (SELECT short, key, min(doc_id) AS first FROM keys GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= CASE WHEN short THEN 3 ELSE 2 END),
gone AS (SELECT doc_id, count(DISTINCT k) AS n FROM keys JOIN recurring USING (short, key) WHERE doc_id > first GROUP BY 1)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines, coalesce(n, 0) AS n_dropped FROM documents d LEFT JOIN gone USING (doc_id)"""

#: op7: all pairs that share a shingle, and what is reachable over links.
_NEAR = """
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
pairs AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS to FROM sets UNION SELECT r.doc_id, e.b FROM reach r JOIN pairs e ON e.a = r.to)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.to) AS component_id, s.doc_id = min(r.to) AS kept FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s"""


#: op11: every anchor's scores with all rows, ranked.
_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op6_line_dedup": _LINES, "op7_minhash_near_dup": _NEAR, "op11_hard_negatives": _NEGATIVES}
