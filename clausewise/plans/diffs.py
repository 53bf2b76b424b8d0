"""Queries of parsing persistence, diffs and change events."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.adapt import Tables, sql
from clausewise.constants import COUNT_DRIFT_RATIO, RENUMBER_RATIO
from clausewise.operators import diff, ingest

#: Diffs staged in SQL, one comparison for each version with a parsed one before it.  The fuzzy stage pairs what the tables amend on purpose: a
#: text and the same with words behind it, the fewest first, then in order among equal ones.
DIFF_CTES = """
pairs AS (SELECT * FROM (SELECT doc_id, version_id AS to_version, lag(version_id) OVER (PARTITION BY doc_id, language ORDER BY retrieved_at, version_id) AS from_version FROM versions WHERE parsed) WHERE from_version IS NOT NULL),
olds AS (SELECT c.*, from_version, to_version FROM clauses c JOIN pairs p ON c.version_id = p.from_version), news AS (SELECT c.*, from_version, to_version FROM clauses c JOIN pairs p ON c.version_id = p.to_version),
d2 AS (SELECT o.doc_id, o.from_version, o.to_version, o.path AS old_path, n.path AS new_path, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal, 'modified' AS change_kind, CAST(NULL AS DOUBLE) AS similarity, 'path' AS match_basis
  FROM olds o JOIN news n ON o.to_version = n.to_version AND o.path = n.path WHERE o.content_hash <> n.content_hash),
o1 AS (SELECT * FROM olds o WHERE NOT EXISTS (SELECT 1 FROM news n WHERE n.to_version = o.to_version AND n.path = o.path)),
n1 AS (SELECT * FROM news n WHERE NOT EXISTS (SELECT 1 FROM olds o WHERE n.to_version = o.to_version AND n.path = o.path)),
d3 AS (SELECT o.doc_id, o.from_version, o.to_version, o.path AS old_path, n.path AS new_path, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal,
  CASE WHEN regexp_replace(o.text, '^\\s*제\\d+조(?:의\\d+)?\\s*', '') = regexp_replace(n.text, '^\\s*제\\d+조(?:의\\d+)?\\s*', '') THEN 'renumbered' ELSE 'modified' END AS change_kind,
  CAST(NULL AS DOUBLE) AS similarity, 'authority' AS match_basis FROM o1 o JOIN n1 n ON o.to_version = n.to_version AND o.moved_to_ref = n.source_ref),
o2 AS (SELECT * FROM o1 WHERE (to_version, path) NOT IN (SELECT (to_version, old_path) FROM d3)), n2 AS (SELECT * FROM n1 WHERE (to_version, path) NOT IN (SELECT (to_version, new_path) FROM d3)),
o2k AS (SELECT *, row_number() OVER (PARTITION BY to_version, content_hash ORDER BY ordinal, path) AS k FROM o2),
n2k AS (SELECT *, row_number() OVER (PARTITION BY to_version, content_hash ORDER BY ordinal, path) AS k FROM n2),
d4 AS (SELECT o.doc_id, o.from_version, o.to_version, o.path AS old_path, n.path AS new_path, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal,
  CASE WHEN string_split(o.path, '/')[-1] = string_split(n.path, '/')[-1] THEN 'moved' ELSE 'renumbered' END AS change_kind, CAST(1 AS DOUBLE) AS similarity, 'content_hash' AS match_basis
  FROM o2k o JOIN n2k n USING (to_version, content_hash, k)),
o3 AS (SELECT * FROM o2 WHERE (to_version, path) NOT IN (SELECT (to_version, old_path) FROM d4)), n3 AS (SELECT * FROM n2 WHERE (to_version, path) NOT IN (SELECT (to_version, new_path) FROM d4)),
o5 AS (SELECT *, row_number() OVER (PARTITION BY to_version, kind, text ORDER BY ordinal, path) AS k FROM o3),
n5 AS (SELECT *, row_number() OVER (PARTITION BY to_version, kind, base ORDER BY length(text), ordinal, path) AS k FROM (SELECT *, unnest(CASE WHEN text LIKE '% AMENDED REVISED' THEN [left(text, -8), left(text, -16)] WHEN text LIKE '% AMENDED' OR text LIKE '% REVISED' THEN [left(text, -8)] ELSE [] END) AS base FROM n3)
  WHERE (to_version, kind, base) IN (SELECT (to_version, kind, text) FROM o3)),
d5 AS (SELECT * FROM (SELECT o.doc_id, o.from_version, o.to_version, o.path AS old_path, n.path AS new_path, o.ordinal AS old_ordinal, n.ordinal AS new_ordinal, 'renumbered' AS change_kind,
  2 * least(length(o.text), 2048)::DOUBLE / (least(length(o.text), 2048) + least(length(n.text), 2048)) AS similarity, 'similarity' AS match_basis FROM o5 o JOIN n5 n ON o.to_version = n.to_version AND o.kind = n.kind AND n.base = o.text AND o.k = n.k) WHERE similarity >= RATIO),
o6 AS (SELECT * FROM o3 WHERE (to_version, path) NOT IN (SELECT (to_version, old_path) FROM d5)), n6 AS (SELECT * FROM n3 WHERE (to_version, path) NOT IN (SELECT (to_version, new_path) FROM d5)),
d6 AS (SELECT doc_id, from_version, to_version, path AS old_path, NULL AS new_path, ordinal AS old_ordinal, NULL AS new_ordinal, 'removed' AS change_kind, CAST(NULL AS DOUBLE) AS similarity, NULL AS match_basis FROM o6
  UNION ALL SELECT doc_id, from_version, to_version, NULL, path, NULL, ordinal, 'added', NULL, NULL FROM n6),
diffs AS (SELECT * FROM d2 UNION ALL SELECT * FROM d3 UNION ALL SELECT * FROM d4 UNION ALL SELECT * FROM d5 UNION ALL SELECT * FROM d6)
""".replace("RATIO", str(RENUMBER_RATIO))

#: Clause counts of parsed versions against the parsed version before.
DRIFT_CTES = f"""drift AS (SELECT *, CASE WHEN n = 0 THEN 'zero_clauses' WHEN before > 0 AND abs(n - before) > {COUNT_DRIFT_RATIO} * before THEN 'clause_count_delta' END AS signal
  FROM (SELECT *, lag(n) OVER (PARTITION BY doc_id, language ORDER BY retrieved_at, version_id) AS before FROM (SELECT v.*, coalesce(c.n, 0) AS n FROM versions v LEFT JOIN (SELECT version_id, count(*) AS n FROM clauses GROUP BY 1) c USING (version_id) WHERE parsed)))"""
_COLUMNS = "doc_id, from_version, to_version, old_path, new_path, change_kind"


def _stage(t: Tables, basis: str):
    return diff.exact_diffs(diff.paired_rows(t.clauses(), t.versions())).where(F.col("match_basis") == basis)


QUERIES = {
    "D1_previous_version": (
        lambda t: diff.previous_version(t.versions()).select("version_id", "previous_id"),
        sql("SELECT version_id, lag(version_id) OVER (PARTITION BY doc_id, language ORDER BY retrieved_at, version_id) AS previous_id FROM versions WHERE parsed")),
    "D2_path_modified": (lambda t: _stage(t, "path").select("doc_id", "from_version", "to_version", "old_path", "new_path", "change_kind"), sql(f"SELECT {_COLUMNS} FROM d2", DIFF_CTES)),
    "D3_authority_renumber": (lambda t: _stage(t, "authority").select("doc_id", "from_version", "to_version", "old_path", "new_path", "change_kind"), sql(f"SELECT {_COLUMNS} FROM d3", DIFF_CTES)),
    "D4_content_relocation": (lambda t: _stage(t, "content_hash").select("doc_id", "from_version", "to_version", "old_path", "new_path", "change_kind", "similarity"), sql(f"SELECT {_COLUMNS}, similarity FROM d4", DIFF_CTES)),
    "D5_fuzzy_pairing": (
        lambda t: diff.build_diffs(t.clauses(), t.versions()).where("match_basis = 'similarity'").select("doc_id", "to_version", "old_path", "new_path", F.round("similarity", 6).alias("similarity"), "needs_review"),
        sql("SELECT doc_id, to_version, old_path, new_path, round(similarity, 6) AS similarity, similarity < 0.9 AS needs_review FROM d5", DIFF_CTES)),
    "D6_removed_added": (
        lambda t: diff.build_diffs(t.clauses(), t.versions()).where("change_kind IN ('removed', 'added')").select("doc_id", "from_version", "to_version", "old_path", "new_path", "change_kind"),
        sql(f"SELECT {_COLUMNS} FROM d6", DIFF_CTES)),
    "D7_baseline_suppression": (
        lambda t: diff.comparable_versions(t.versions()).select("version_id", "previous_id"),
        sql("SELECT * FROM (SELECT version_id, lag(version_id) OVER (PARTITION BY doc_id, language ORDER BY retrieved_at, version_id) AS previous_id FROM versions WHERE parsed) WHERE previous_id IS NOT NULL")),
    "D8_event_fan_out": (
        lambda t: diff.fan_out(diff.build_diffs(t.clauses(), t.versions()), t.document_cells()).groupBy("to_version", "cell_id", "change_kind").agg(F.count("*").alias("events")),
        sql("SELECT to_version, cell_id, change_kind, count(*) AS events FROM diffs JOIN doc_cells USING (doc_id) GROUP BY ALL", DIFF_CTES)),
    "D9_supersede_citations": (
        lambda t: diff.superseded_citations(diff.build_diffs(t.clauses(), t.versions()), t.clauses().where("ordinal % 3 = 0").select("version_id", "path")),
        sql("SELECT version_id, path FROM olds WHERE ordinal % 3 = 0 AND (from_version, path) IN (SELECT (from_version, old_path) FROM diffs WHERE change_kind <> 'added')", DIFF_CTES)),
    "D10_kind_counts": (
        lambda t: diff.kind_counts(diff.build_diffs(t.clauses(), t.versions())),
        sql("SELECT change_kind, count(*) AS n, count(*) FILTER (WHERE similarity < 0.9) AS to_review FROM diffs GROUP BY 1", DIFF_CTES)),
    "D11_diff_listing": (
        lambda t: diff.listing(diff.build_diffs(t.clauses(), t.versions()), t.clauses()).select("to_version", "change_kind", "reading", "old_text", "old_cut", "new_text", "new_cut"),
        sql("""SELECT d.to_version, d.change_kind, coalesce(d.new_ordinal, d.old_ordinal) AS reading, substr(o.text, 1, 4000) AS old_text, length(o.text) > 4000 AS old_cut,
          substr(n.text, 1, 4000) AS new_text, length(n.text) > 4000 AS new_cut
          FROM diffs d LEFT JOIN olds o ON o.to_version = d.to_version AND o.path = d.old_path LEFT JOIN news n ON n.to_version = d.to_version AND n.path = d.new_path""", DIFF_CTES)),
    "P25_count_drift": (
        lambda t: diff.count_drift(t.clauses(), t.versions()).select("version_id", "n", "before", "signal"),
        sql("SELECT version_id, n, before, signal FROM drift WHERE signal IS NOT NULL", DRIFT_CTES)),
    "P28_successor_version": (
        lambda t: diff.successor_version(t.versions()).select("version_id", "successor_id"),
        sql("SELECT version_id, lead(version_id) OVER (PARTITION BY doc_id, language ORDER BY retrieved_at, version_id) AS successor_id FROM versions WHERE parsed")),
    "P27_invalidate_diffs": (
        lambda t: ingest.still_valid(diff.build_diffs(t.clauses(), t.versions()), t.versions().where("version_id % 7 = 0").select("version_id")).select("doc_id", "from_version", "to_version", "old_path", "new_path", "change_kind"),
        sql(f"SELECT {_COLUMNS} FROM diffs WHERE from_version % 7 <> 0 AND to_version % 7 <> 0", DIFF_CTES)),
}
