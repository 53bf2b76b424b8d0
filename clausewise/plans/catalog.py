"""Queries of ingestion, browsing, scheduling, discovery and audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.adapt import TODAY, ref_date, sql
from clausewise.constants import AUDIT_GENESIS, DISCOVERY_EXCLUSIONS, DISCOVERY_KEYWORDS, DOC_CATEGORIES
from clausewise.operators import catalog as c
from clausewise.operators import ingest as g
from clausewise.operators import diff
from clausewise.plans.diffs import DRIFT_CTES
from clausewise.sources import archive

_T = f"DATE '{TODAY}'"
_STATUS = f"status AS (SELECT *, CASE WHEN effective_date IS NULL THEN 'unknown' WHEN effective_date > {_T} THEN 'pending' WHEN effective_date = in_force THEN 'in_force' ELSE 'superseded' END AS st FROM (SELECT *, max(CASE WHEN effective_date <= {_T} THEN effective_date END) OVER (PARTITION BY doc_id) AS in_force FROM versions))"
_CATEGORY = "cats AS (SELECT d.*, CASE WHEN d.doc_type IN ('law','decree','enforcement_rule') THEN 'statute' WHEN d.doc_type = 'notice' THEN 'admin_rule' WHEN d.doc_type = 'annex' THEN CASE WHEN p.doc_type = 'notice' THEN 'admin_rule_annex' ELSE 'statute_annex' END WHEN d.doc_type = 'feed' THEN 'feed' ELSE 'other' END AS category FROM docs d LEFT JOIN docs p ON p.doc_id = d.parent_id)"
SCOPE = f"scope AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(effective_date <= {_T}, false) DESC, CASE WHEN effective_date <= {_T} THEN effective_date END DESC NULLS LAST, effective_date ASC NULLS LAST, retrieved_at DESC, version_id) AS rn FROM versions WHERE parsed) WHERE rn = 1)"


def _observations(t):
    e = t.raw("events")
    return e.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("source_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("fetched_at"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "view", "unchanged").otherwise("changed").alias("outcome"), "value", "props")


_OBS = "obs AS (SELECT event_id AS observation_id, user_id AS source_id, CAST(floor(epoch(ts)) AS BIGINT) AS fetched_at, CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'unchanged' ELSE 'changed' END AS outcome, value, props FROM events)"


def _sources(t):
    blocks = F.element_at(F.array(*map(F.lit, ("primary_laws", "gmp", "guidance", "safety"))), (F.col("s_suppkey") % 4 + 1).cast("int"))
    tiers = F.element_at(F.array(*map(F.lit, "abcd")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return t.raw("supplier").select(F.col("s_suppkey").alias("source_id"), "s_name", blocks.alias("block"), tiers.alias("tier"), F.when(F.col("s_suppkey") % 5 == 0, F.lit(3600)).alias("override"), (F.col("s_suppkey") % 7 != 0).alias("enabled"), (F.col("s_suppkey") * 97 % 1000).alias("next_due_at"))


_SRC = "src AS (SELECT s_suppkey AS source_id, s_name, ['primary_laws','gmp','guidance','safety'][s_suppkey % 4 + 1] AS block, ['a','b','c','d'][s_suppkey % 4 + 1] AS tier, CASE WHEN s_suppkey % 5 = 0 THEN 3600 END AS override, s_suppkey % 7 <> 0 AS enabled, s_suppkey * 97 % 1000 AS next_due_at, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN 3600 END, greatest([86400,604800,604800,86400][s_suppkey % 4 + 1], [0,0,86400,2592000][s_suppkey % 4 + 1])) AS every FROM supplier)"


def _audit(t):
    return t.raw("conversations").select(F.col("conv_id").cast("long").alias("chain"), F.col("turn").cast("long").alias("seq"), F.concat_ws("|", "role", "text").alias("body"))


def _role():
    return F.element_at(F.array(*map(F.lit, ("viewer", "analyst", "approver", "admin", "auditor", "nobody"))), ((F.col("conv_id") + F.col("turn")) % 6 + 1).cast("int"))


def _catalogue(t):
    """Sources with flags: tier d is metadata only, every sixth is not to be fetched."""
    return _sources(t).withColumn("ingestible", F.col("source_id") % 6 != 1)


def _incoming(t):
    """Documents as a run brings them: annexes name their parents, some of which nobody knows; some titles changed."""
    d, k = t.documents(), F.col("doc_id")
    rows = d.select(F.concat(F.lit("k"), k.cast("string")).alias("canonical_key"), F.concat(F.lit("k"), F.col("parent_id").cast("string"), F.when(k % 24 == 4, "x").otherwise("")).alias("parent_key"), F.when(k % 5 == 0, F.concat("title", F.lit(" new"))).otherwise(F.col("title")).alias("title"), k.alias("n"))
    known = d.where("doc_id % 4 <> 1").select(F.concat(F.lit("k"), k.cast("string")).alias("canonical_key"), "title")
    return known, rows.drop("n")


def _grouped(t):
    """Versions, the second of which have a group already for every fourth document."""
    return t.versions().withColumn("group_id", F.when((F.col("doc_id") % 4 == 0) & (F.col("v") == 2), F.lit(7).cast("long")))


def _attempts(t):
    e = t.raw("events")
    return e.select(F.col("user_id").alias("source_id"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "view", 304).otherwise(200).alias("status"), (F.col("event_id") % 3).alias("created"), F.when(F.col("event_type") == "error", "timeout").alias("error"))


def _drift_alerts(t):
    return _observations(t).where("outcome = 'error'").select(F.col("observation_id").alias("alert_id"), "source_id", F.when(F.col("observation_id") % 5 == 0, F.lit(1)).alias("resolved_at"))


def _resolutions(t):
    k = F.col("alert_id")
    rows = _drift_alerts(t).where("alert_id % 2 = 0")
    return rows.select("alert_id", F.lit(9).alias("resolved_at")).unionByName(rows.where("alert_id % 4 = 0").select("alert_id", (k % 3 + 5).cast("int").alias("resolved_at")))


def _titles(t):
    """An index of rules: titles of documents with words of the cells, of exclusions, or of neither."""
    k = F.col("doc_id")
    return t.documents().select("doc_id", F.concat("title", F.when(k % 4 == 0, " 화장품 고시").when(k % 4 == 1, " 체외진단 의료기기").when(k % 4 == 2, " 의약외품").otherwise("")).alias("title"))


def _known_titles(t):
    return _titles(t).where("doc_id % 3 = 0").select(F.upper(F.replace("title", F.lit(" "), F.lit(" · "))).alias("title")).union(_sources(t).select("s_name"))


_SIGNALS = f"{DRIFT_CTES}, signals AS (SELECT version_id, signal FROM drift WHERE signal IS NOT NULL)"


def _quarantine(t):
    return g.quarantined(t.versions(), t.clauses(), diff.count_drift(t.clauses(), t.versions()).select("version_id", "signal"))


def _entries(t):
    """Events as audit entries, without nulls in their bodies."""
    e = t.raw("events")
    return e.select("event_id", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("actor_id"), F.lit("event").alias("entity_type"), F.col("event_id").cast("string").alias("entity_id"), F.col("ts").cast("timestamp").alias("at"), F.create_map(F.lit("v"), F.lit("가"), F.lit("k"), F.col("event_type")).alias("payload"))


QUERIES = {
    "C5_version_upsert": (
        lambda t: c.new_versions(t.clauses().where("v = 2").select("doc_id", "content_hash"), t.clauses().where("v = 1")),
        sql("SELECT DISTINCT doc_id, content_hash FROM clauses WHERE v = 2 AND (doc_id, content_hash) NOT IN (SELECT (doc_id, content_hash) FROM clauses WHERE v = 1)")),
    "C6_document_upsert": (
        lambda t: g.documents_upsert(*_incoming(t)).select("canonical_key", "action"),
        sql("SELECT 'k' || doc_id AS canonical_key, CASE WHEN parent_id IS NOT NULL AND (doc_id % 24 = 4 OR parent_id NOT IN (SELECT doc_id FROM docs WHERE doc_id % 4 <> 1 OR parent_id IS NULL)) THEN 'annex_without_parent' WHEN doc_id % 4 = 1 THEN 'insert' WHEN doc_id % 5 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM docs")),
    "C7_cell_claims": (
        lambda t: g.claims_upsert(t.document_cells().where("doc_id % 2 = 0"), t.document_cells().where("doc_id % 3 = 0").unionByName(t.document_cells().where("doc_id % 6 = 3"))), sql("SELECT doc_id, cell_id FROM doc_cells WHERE doc_id % 2 = 0 OR doc_id % 3 = 0")),
    "C8_version_group": (
        lambda t: g.version_groups(_grouped(t)), sql("SELECT version_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 3 <> 0 THEN 7 ELSE doc_id * 10 + 1 END AS group_id FROM versions")),
    "C9_fetch_outcomes": (
        lambda t: t.raw("events").select("event_id", c.fetch_outcome(F.when(F.col("event_id") % 11 == 0, "d").otherwise("a"), F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "view", 304).otherwise(200), F.col("event_id") % 2).alias("outcome")),
        "SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'skipped' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'not_modified' WHEN event_id % 2 > 0 THEN 'changed' ELSE 'unchanged' END AS outcome FROM events"),
    "C10_observations": (
        lambda t: g.observed(_attempts(t)),
        "SELECT user_id AS source_id, event_id AS attempt, CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'not_modified' WHEN event_id % 3 > 0 THEN 'changed' ELSE 'unchanged' END AS outcome, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 3 END AS n_created, CASE WHEN event_type = 'error' THEN 'timeout' END AS error FROM events"),
    "C10_outcome_counts": (
        lambda t: g.outcome_counts(_observations(t)),
        f"WITH {_OBS} SELECT source_id, outcome, count(*) AS n, max(fetched_at) AS last_at FROM obs GROUP BY ALL"),
    "C11_standards_upsert": (
        lambda t: c.merged(
            t.raw("part").where("p_partkey % 2 = 0").select("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("edition"), F.col("p_partkey").alias("num"), F.lit(1).alias("seen")),
            t.raw("part").where("p_partkey % 3 = 0").select("p_name", F.when(F.col("p_partkey") % 3 > 0, F.col("p_brand")).alias("edition"), F.col("p_partkey").alias("num"), F.lit(2).alias("seen")), ["num", "edition"], ["seen"]).select("num", "edition", "seen"),
        "SELECT p_partkey AS num, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS edition, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS seen FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"),
    "C12_one_open_alert": (
        lambda t: c.one_open_alert(_observations(t).where("outcome = 'error'").select("source_id", F.lit("zero_records").alias("signal"), (F.col("observation_id") % 2).alias("expected"), F.col("fetched_at").alias("raised_at"), F.col("observation_id").alias("alert_id"), F.concat(F.lit("seen "), F.col("observation_id").cast("string")).alias("actual"), F.when(F.col("observation_id") % 5 == 0, 1).alias("resolved_at"))).select("source_id", "expected", "alert_id", "actual", "refreshed_at"),
        f"WITH {_OBS} SELECT source_id, expected, alert_id, actual, refreshed_at FROM (SELECT source_id, observation_id % 2 AS expected, observation_id AS alert_id, 'seen ' || last_value(observation_id) OVER w AS actual, last_value(fetched_at) OVER w AS refreshed_at, row_number() OVER w AS k FROM obs WHERE outcome = 'error' AND observation_id % 5 <> 0 WINDOW w AS (PARTITION BY source_id, observation_id % 2 ORDER BY fetched_at, observation_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE k = 1"),
    "S3_ingestible_guard": (
        lambda t: g.guarded(_catalogue(t)).select("source_id", "action", "reason"),
        f"WITH {_SRC} SELECT source_id, CASE WHEN tier = 'd' OR source_id % 6 = 1 THEN 'skip' ELSE 'fetch' END AS action, CASE WHEN tier = 'd' THEN 'metadata_only' WHEN source_id % 6 = 1 THEN 'not_ingestible' END AS reason FROM src"),
    "S3_skipped_observations": (
        lambda t: g.skipped_observations(_catalogue(t), F.lit(600)),
        f"WITH {_SRC} SELECT source_id, 600 AS fetched_at, 'skipped' AS outcome, CASE WHEN tier = 'd' THEN 'metadata_only' ELSE 'not_ingestible' END AS error FROM src WHERE tier = 'd' OR source_id % 6 = 1"),
    "S18_seed_upsert": (
        lambda t: g.seeded(_sources(t).where("source_id % 4 > 0").select("source_id", "enabled", "tier"), _sources(t).where("source_id % 3 > 0").select("source_id", F.lit("z").alias("tier"))),
        f"WITH {_SRC} SELECT source_id, CASE WHEN source_id % 3 = 0 THEN false WHEN source_id % 4 = 0 THEN true ELSE enabled END AS enabled, CASE WHEN source_id % 3 > 0 THEN 'z' ELSE tier END AS tier FROM src WHERE source_id % 4 > 0 OR source_id % 3 > 0"),
    "S20_ordered_scan": (lambda t: t.tree().select("version_id", "ordinal", "path", "kind").orderBy("version_id", "ordinal"), sql("SELECT version_id, ordinal, path, kind FROM tree ORDER BY 1, 2")),
    "B1_doc_category": (lambda t: c.with_category(t.documents()).select("doc_id", "category"), sql("SELECT doc_id, category FROM cats", _CATEGORY)),
    "B2_cell_categories": (
        lambda t: g.cell_categories(c.with_category(t.documents()), t.document_cells(), DOC_CATEGORIES),
        sql("SELECT cell_id, " + ", ".join(f"count(*) FILTER (WHERE category = '{k}') AS {k}" for k in DOC_CATEGORIES) + " FROM cats JOIN doc_cells USING (doc_id) GROUP BY 1", _CATEGORY)),
    "B3_document_page": (
        lambda t: c.page(c.with_category(t.documents()).where("lower(title) LIKE '%src1%'"), [F.col("category_rank"), F.col("title"), F.col("doc_id")], 2, 10).select("doc_id", "title", "category"),
        sql("SELECT doc_id, title, category FROM cats WHERE title ILIKE '%src1%' ORDER BY list_position(['statute','admin_rule','statute_annex','admin_rule_annex','feed','other'], category), title, doc_id LIMIT 10 OFFSET 10", _CATEGORY)),
    "B4_side_counts": (
        lambda t: g.side_counts(t.documents(), t.versions(), ref_date()),
        sql(f"SELECT doc_id, coalesce(annexes, 0) AS annexes, versions, pending FROM docs LEFT JOIN (SELECT parent_id AS doc_id, count(*) AS annexes FROM docs WHERE parent_id IS NOT NULL GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS versions, count(*) FILTER (WHERE effective_date > {_T}) AS pending FROM versions GROUP BY 1) USING (doc_id)")),
    "B5_version_status": (
        lambda t: c.version_status(t.versions(), ref_date()).select("version_id", F.col("in_force").cast("string").alias("in_force"), "status"),
        sql("SELECT version_id, CAST(in_force AS VARCHAR) AS in_force, st AS status FROM status", _STATUS)),
    "B6_clause_page": (lambda t: c.paths_page(t.clauses(), 10).select("version_id", "path", F.col("page").cast("long").alias("page")), sql("SELECT version_id, path, (row_number() OVER (PARTITION BY version_id ORDER BY ordinal, path) - 1) // 10 + 1 AS page FROM clauses")),
    "B7_source_list": (
        lambda t: g.source_list(_sources(t), _observations(t), 3).select("source_id", "s_name", "n", F.array_join(F.transform("newest", lambda v: v.cast("string")), ",").alias("newest")),
        f"WITH {_OBS}, {_SRC} SELECT source_id, s_name, coalesce(n, 0) AS n, newest FROM src LEFT JOIN (SELECT source_id, count(*) AS n, string_agg(CAST(fetched_at AS VARCHAR), ',' ORDER BY fetched_at DESC) FILTER (WHERE k <= 3) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY fetched_at DESC, observation_id DESC) AS k FROM obs) GROUP BY 1) USING (source_id)"),
    "B8_open_drift_alerts": (
        lambda t: g.open_alerts(g.resolved_alerts(_drift_alerts(t), _resolutions(t))).select("alert_id", "source_id"),
        f"WITH {_OBS} SELECT observation_id AS alert_id, source_id FROM obs WHERE outcome = 'error' AND observation_id % 5 <> 0 AND observation_id % 2 = 1"),
    "B8_resolved_once": (
        lambda t: g.resolved_alerts(_drift_alerts(t), _resolutions(t)).select("alert_id", "resolved_at"),
        f"WITH {_OBS} SELECT observation_id AS alert_id, CASE WHEN observation_id % 5 = 0 THEN 1 WHEN observation_id % 4 = 0 THEN CAST(observation_id % 3 + 5 AS INTEGER) WHEN observation_id % 2 = 0 THEN 9 END AS resolved_at FROM obs WHERE outcome = 'error'"),
    "B9_raw_artifacts": (
        lambda t: g.raw_artifacts(t.raw("pages").select(F.col("page_id").alias("version_id"), F.when(F.col("page_id") % 4 == 0, "gone").otherwise(F.sha2(F.col("html").cast("binary"), 256)).alias("object_key")), archive.archived(t.raw("pages").select(F.col("html").alias("body")), t.raw("pages").where("false").select(F.col("html").alias("object_key")))),
        "SELECT page_id AS version_id, sha256(html) AS object_key, octet_length(encode(html)) AS raw_bytes FROM pages WHERE page_id % 4 <> 0 AND NOT regexp_matches(html, '[?&](OC|oc|key|apikey|api_key)=[^&\\s{]')"),
    "P26_quarantine": (
        lambda t: _quarantine(t)[0].select("version_id"), sql("SELECT version_id FROM versions WHERE version_id NOT IN (SELECT version_id FROM signals)", _SIGNALS)),
    "P26_quarantined_clauses": (
        lambda t: _quarantine(t)[1].select("version_id", "path"), sql("SELECT version_id, path FROM clauses WHERE version_id NOT IN (SELECT version_id FROM signals)", _SIGNALS)),
    "P26_quarantine_alerts": (
        lambda t: _quarantine(t)[2].select("version_id", "signal", "severity"), sql("SELECT version_id, signal, 'high' AS severity FROM signals", _SIGNALS)),
    "A1_canonical_entry": (
        lambda t: _entries(t).select("event_id", c.entry_hash(c.canonical_entry(F.col("action"), F.col("actor_id"), F.col("entity_type"), F.col("entity_id"), F.col("at"), F.col("payload")), F.lit(AUDIT_GENESIS)).alias("entry_hash")),
        f"""SELECT event_id, sha256('{{"action":"' || event_type || '","actor_id":"' || user_id || '","at":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') || '","entity_id":"' || event_id || '","entity_type":"event","payload":{{"k":"' || event_type || '","v":"가"}}}}' || '{AUDIT_GENESIS}') AS entry_hash FROM events"""),
    "H1_poll_intervals": (lambda t: _sources(t).select("source_id", c.poll_interval(F.col("override"), F.col("block"), F.col("tier")).alias("seconds")), f"WITH {_SRC} SELECT source_id, every AS seconds FROM src"),
    "H2_due_claims": (
        lambda t: c.due(_sources(t).withColumn("interval_seconds", c.poll_interval(F.col("override"), F.col("block"), F.col("tier"))), F.lit(600)).select("source_id", "next_due_at"),
        f"WITH {_SRC} SELECT source_id, 600 + every AS next_due_at FROM src WHERE enabled AND src.next_due_at <= 600 ORDER BY src.next_due_at, source_id LIMIT 50"),
    "H3_failure_streak": (
        lambda t: c.failure_streak(_observations(t)).select("observation_id", "failures"),
        f"WITH {_OBS}, runs AS (SELECT *, sum(CASE WHEN outcome <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY fetched_at, observation_id) AS run FROM obs) SELECT observation_id, CAST(sum(CASE WHEN outcome = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, run ORDER BY fetched_at, observation_id) AS BIGINT) AS failures FROM runs"),
    "H6_reconcile_index": (
        lambda t: g.unmatched(_titles(t), _known_titles(t)).select("doc_id"), sql("SELECT doc_id FROM docs WHERE doc_id % 3 <> 0")),
    "H7_triage_buckets": (
        lambda t: g.bucketed(_titles(t), _known_titles(t), DISCOVERY_KEYWORDS, DISCOVERY_EXCLUSIONS).select("doc_id", "bucket", "matched"),
        sql("SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'excluded' WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN 'covered' ELSE 'candidate' END ELSE 'near_miss' END AS bucket, CASE doc_id % 4 WHEN 1 THEN '체외진단' WHEN 2 THEN '의약외품' ELSE '' END AS matched FROM docs WHERE doc_id % 4 < 3")),
    "R1_version_scope": (lambda t: c.version_scope(t.versions(), ref_date()).select("doc_id", "version_id"), sql("SELECT doc_id, version_id FROM scope", SCOPE)),
    "R2_cell_scope": (
        lambda t: c.version_scope(t.versions(), ref_date()).join(t.document_cells().where("cell_id = 'en-samd'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "version_id"),
        sql("SELECT doc_id, version_id FROM scope WHERE doc_id IN (SELECT doc_id FROM doc_cells WHERE cell_id = 'en-samd')", SCOPE)),
    "A2_audit_chain": (lambda t: c.audit_chain(_audit(t), AUDIT_GENESIS).select("chain", "seq", "entry_hash"), None),
    "A3_audit_verify": (
        lambda t: c.verify_chain(c.audit_chain(_audit(t), AUDIT_GENESIS).withColumn("body", F.when((F.col("chain") % 5 == 0) & (F.col("seq") == 1), "tampered").otherwise(F.col("body"))), AUDIT_GENESIS),
        "SELECT conv_id AS chain, count(*) AS n, min(CASE WHEN conv_id % 5 = 0 AND turn = 1 THEN turn END) AS first_bad FROM conversations GROUP BY 1"),
    "A4_role_order": (
        lambda t: t.raw("conversations").select("conv_id", "turn", g.may(_role(), "approver", ("auditor",)).alias("may_lock")),
        "SELECT conv_id, turn, (conv_id + turn) % 6 IN (2, 3, 4) AS may_lock FROM conversations"),
}
