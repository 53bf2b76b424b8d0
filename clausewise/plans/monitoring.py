"""Queries of alert routing, grading, delivery, briefing and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from clausewise.adapt import sql
from clausewise.operators import diff
from clausewise.operators import monitoring as m
from clausewise.plans.answers import _IRS, _ir_citations, _irs
from clausewise.plans.diffs import DIFF_CTES

_ALERTS = DIFF_CTES + """, events AS (SELECT * FROM diffs JOIN doc_cells USING (doc_id)),
alerts AS (SELECT cell_id, doc_id, to_version, count(*) AS clause_count, count(*) FILTER (WHERE change_kind = 'removed') AS removed, count(*) FILTER (WHERE change_kind = 'modified') AS modified,
  count(*) FILTER (WHERE change_kind = 'added') AS added, list(coalesce(new_path, old_path) ORDER BY coalesce(new_path, old_path)) AS paths FROM events WHERE change_kind NOT IN ('renumbered', 'moved') GROUP BY 1, 2, 3),
graded AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 'high' WHEN removed > 0 THEN 'medium' WHEN clause_count >= 20 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN doc_id % 10 = 1 THEN 'locked_ir' WHEN removed > 0 THEN 'clause_removed' WHEN clause_count >= 20 THEN 'bulk_change' ELSE 'routine' END AS basis, doc_id % 10 = 1 AS locked FROM alerts)"""
_ORDERS = """al AS (SELECT o_orderkey AS alert_id, o_custkey % 50 AS cell_id, CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 3 END AS tenant, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' WHEN o_orderpriority = '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS published FROM orders),
subs AS (SELECT s_suppkey AS subscription_id, s_suppkey % 50 AS cell_id, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 3 END AS tenant, ['low', 'medium', 'high'][s_suppkey % 3 + 1] AS floor, s_suppkey % 7 > 0 AS enabled FROM supplier),
att AS (SELECT l_orderkey AS alert_id, l_suppkey % 4 AS subscription_id, l_linenumber AS attempt, CASE l_returnflag WHEN 'A' THEN 'sent' ELSE 'failed' END AS status FROM lineitem),
states AS (SELECT alert_id, subscription_id, n, CASE WHEN sent THEN 'done' WHEN n >= 5 THEN 'exhausted' ELSE 'retry' END AS state, CASE WHEN NOT sent AND n < 5 THEN CAST(least(60 * power(2, n - 1), 21600) AS BIGINT) END AS wait FROM (SELECT alert_id, subscription_id, max(attempt) AS n, bool_or(status = 'sent') AS sent FROM att GROUP BY 1, 2))"""


def _events(t):
    return diff.fan_out(diff.build_diffs(t.clauses(), t.versions()), t.document_cells())


def graded(t):
    """One graded alert per amendment and cell."""
    locked = F.when(F.col("doc_id") % 10 == 1, 1).otherwise(0)
    args = (locked, F.col("removed"), F.col("clause_count"))
    return m.composed(_events(t)).withColumn("severity", m.grade(*args)).withColumn("basis", m.grade_basis(*args))


def _alerts(t):
    """Order volume as alerts: a star-schema scale test."""
    p = F.col("o_orderpriority")
    return t.raw("orders").select(
        F.col("o_orderkey").alias("alert_id"), (F.col("o_custkey") % 50).alias("cell_id"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 3).alias("tenant"),
        F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "3-MEDIUM", "medium").otherwise("low").alias("severity"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("published"))


def _subs(t):
    k = F.col("s_suppkey")
    return t.raw("supplier").select(k.alias("subscription_id"), (k % 50).alias("cell_id"), F.when(k % 3 > 0, k % 3).alias("tenant"), F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), (k % 3 + 1).cast("int")).alias("floor"), (k % 7 > 0).alias("enabled"))


def _states(t):
    return m.delivery_state(t.raw("lineitem").select(F.col("l_orderkey").alias("alert_id"), (F.col("l_suppkey") % 4).alias("subscription_id"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_returnflag") == "A", "sent").otherwise("failed").alias("status")))


def _recorded(t):
    """Order volume as alerts on record and of a run: some are only old, some only new; owners and deliveries are the old ones'."""
    rows = _alerts(t).select("tenant", "cell_id", F.col("alert_id").alias("version_id"), "severity")
    old = rows.where("version_id % 3 < 2").withColumn("severity", F.lit("low")).withColumn("owner", F.when(F.col("version_id") % 2 == 0, "kim")).withColumn("delivery", F.lit("sent"))
    return old, rows.where("version_id % 3 > 0")


def _noted(t):
    """Alerts with owners and times of detection."""
    k = F.col("alert_id")
    return _alerts(t).select("alert_id", "cell_id", "tenant", "severity", (F.col("published") + k % 7 * 3600).alias("detected_at"), F.when(k % 2 == 0, "kim").alias("owner"))


def _numbered(t):
    """Events with a number of their own."""
    return _events(t).withColumn("event_id", F.concat_ws("|", "cell_id", "to_version", "old_path", "new_path"))


def _timed(t):
    return _alerts(t).select("cell_id", (F.col("published") + F.col("alert_id") % 50 * 3600).alias("alerted_at"), F.when(F.col("alert_id") % 5 > 0, F.col("published")).alias("published_at"))


def _requests(t):
    """Two requests for each third alert; the later one counts."""
    k = F.col("alert_id")
    rows = _alerts(t).where("alert_id % 3 = 0")
    return rows.select("alert_id", F.lit("choi").alias("owner"), F.lit(1).alias("at")).unionByName(rows.select("alert_id", F.when(k % 4 == 0, "park").otherwise("lee").alias("owner"), F.lit(2).alias("at")))


def _channels(t):
    k = F.col("subscription_id")
    return _subs(t).select("subscription_id", "tenant", "cell_id", "floor", F.element_at(F.array(*map(F.lit, ("in_app", "webhook", "email", "fax"))), (k % 4 + 1).cast("int")).alias("channel"), F.when((k % 8 == 1) | (k % 4 == 2), "https://hook").when(k % 8 == 5, " ").alias("destination"))


QUERIES = {
    "M1_amendment_lookup": (lambda t: m.amendments(t.versions(), t.documents()).select("version_id", "title", "doc_type"), sql("SELECT version_id, title, doc_type FROM versions JOIN docs USING (doc_id)")),
    "M2_version_events": (lambda t: m.version_events(_events(t)).select("to_version", "cell_id", "path", "change_kind"), sql("SELECT to_version, cell_id, coalesce(new_path, old_path) AS path, change_kind FROM events", _ALERTS)),
    "M3_locked_impact": (
        lambda t: m.locked_impact(_events(t), _ir_citations(t), _irs(t)),
        sql("SELECT e.cell_id, e.to_version, count(DISTINCT i.ir_id) AS irs FROM (SELECT DISTINCT cell_id, from_version, to_version, old_path FROM events WHERE change_kind <> 'added') e JOIN ir_cites c ON c.version_id = e.from_version AND c.path = e.old_path JOIN irs i ON i.ir_id = c.ir_id WHERE i.ordinal % 3 = 0 GROUP BY 1, 2", f"{_ALERTS}, {_IRS}")),
    "M4_substantive_events": (
        lambda t: m.suppression(_events(t)),
        sql("SELECT to_version, cell_id, count(*) FILTER (WHERE change_kind IN ('renumbered', 'moved')) AS suppressed, count(*) FILTER (WHERE change_kind NOT IN ('renumbered', 'moved')) AS kept, count(*) FILTER (WHERE change_kind NOT IN ('renumbered', 'moved')) = 0 AS silent FROM events GROUP BY 1, 2", _ALERTS)),
    "M5_tenant_fan_out": (
        lambda t: m.fanned_to_tenants(_alerts(t).select("alert_id", "cell_id"), _subs(t)).groupBy("alert_id").agg(F.count("*").alias("tenants")),
        f"WITH {_ORDERS} SELECT alert_id, count(*) AS tenants FROM al JOIN (SELECT DISTINCT cell_id, tenant FROM subs WHERE enabled) USING (cell_id) GROUP BY 1"),
    "M6_alert_composition": (
        lambda t: m.composed(_events(t)).select("cell_id", "to_version", "clause_count", "removed", "modified", "added", F.array_join("paths", ",").alias("paths")),
        sql("SELECT cell_id, to_version, clause_count, removed, modified, added, array_to_string(paths, ',') AS paths FROM alerts", _ALERTS)),
    "M7_alert_upsert": (
        lambda t: m.upserted(*_recorded(t)),
        f"WITH {_ORDERS} SELECT tenant, cell_id, alert_id AS version_id, CASE WHEN alert_id % 3 > 0 THEN severity ELSE 'low' END AS severity, CASE WHEN alert_id % 3 < 2 AND alert_id % 2 = 0 THEN 'kim' END AS owner, CASE WHEN alert_id % 3 < 2 THEN 'sent' ELSE 'pending' END AS delivery FROM al"),
    "M8_graded_alerts": (lambda t: graded(t).select("cell_id", "to_version", "clause_count", "severity", "basis"), sql("SELECT cell_id, to_version, clause_count, severity, basis FROM graded", _ALERTS)),
    "M9_summaries": (
        lambda t: graded(t).select("cell_id", "to_version", m.summary(F.lit("t"), F.create_map(F.lit("added"), F.col("added"), F.lit("modified"), F.col("modified"), F.lit("removed"), F.col("removed")), F.col("paths")).alias("summary")),
        sql("""SELECT cell_id, to_version, 't' || chr(10) || (SELECT string_agg(k || ' ' || n, ', ' ORDER BY n DESC, k) FROM (SELECT 'added' AS k, added AS n UNION ALL SELECT 'modified', modified UNION ALL SELECT 'removed', removed) WHERE n > 0)
          || chr(10) || array_to_string(paths[1:5], ', ') || CASE WHEN len(paths) > 5 THEN ' +' || (len(paths) - 5) ELSE '' END AS summary FROM graded""", _ALERTS)),
    "M10_eligible_subscriptions": (
        lambda t: m.eligible(_alerts(t), _subs(t)).groupBy("subscription_id").agg(F.count("*").alias("n")),
        f"WITH {_ORDERS} SELECT subscription_id, count(*) AS n FROM al JOIN subs s ON al.cell_id = s.cell_id AND al.tenant IS NOT DISTINCT FROM s.tenant AND list_position(['low','medium','high'], s.floor) <= list_position(['low','medium','high'], al.severity) WHERE enabled GROUP BY 1"),
    "M11_delivery_states": (lambda t: _states(t).select("alert_id", "subscription_id", "n", "state"), f"WITH {_ORDERS} SELECT alert_id, subscription_id, n, state FROM states"),
    "M12_backoff": (lambda t: _states(t).select("alert_id", "subscription_id", "wait"), f"WITH {_ORDERS} SELECT alert_id, subscription_id, wait FROM states"),
    "M13_alert_status": (
        lambda t: m.alert_status(_alerts(t), _states(t)),
        f"WITH {_ORDERS} SELECT al.alert_id, CASE WHEN retry THEN 'pending' WHEN sent OR retry IS NULL THEN 'delivered' ELSE 'failed' END AS status FROM al LEFT JOIN (SELECT alert_id, bool_or(state = 'retry') AS retry, bool_or(state = 'done') AS sent FROM states GROUP BY 1) s USING (alert_id)"),
    "M15_briefing": (
        lambda t: m.briefing(_noted(t), _subs(t), 1, F.lit(886000000), 24 * 30).select("alert_id", "severity", "owner"),
        f"WITH {_ORDERS} SELECT alert_id, severity, CASE WHEN alert_id % 2 = 0 THEN 'kim' END AS owner FROM al WHERE published + alert_id % 7 * 3600 BETWEEN 886000000 - 720 * 3600 AND 886000000 AND cell_id IN (SELECT cell_id FROM subs WHERE enabled AND tenant = 1)"),
    "M15_briefing_counts": (
        lambda t: m.briefing_counts(m.briefing(_noted(t), _subs(t), None, F.lit(886000000), 24 * 30)),
        f"WITH {_ORDERS} SELECT severity, count(*) AS n, count(*) FILTER (WHERE alert_id % 2 = 1) AS unassigned FROM al WHERE published + alert_id % 7 * 3600 BETWEEN 886000000 - 720 * 3600 AND 886000000 AND cell_id IN (SELECT cell_id FROM subs WHERE enabled AND tenant IS NULL) GROUP BY 1"),
    "M15_all_briefings": (
        lambda t: m.briefings(_noted(t), _subs(t).withColumn("at", 886_000_000 + F.col("subscription_id") % 9 * 1_000_003), 24 * 30),
        f"""WITH {_ORDERS}, s AS (SELECT *, 886000000 + subscription_id % 9 * 1000003 AS moment FROM subs WHERE enabled), n AS (SELECT *, published + alert_id % 7 * 3600 AS detected_at, list_position(['low', 'medium', 'high'], severity) AS rank FROM al)
        SELECT subscription_id, alert_id, severity, CAST(row_number() OVER (PARTITION BY subscription_id ORDER BY rank DESC, detected_at DESC, alert_id) AS INTEGER) AS place
        FROM s JOIN n ON s.cell_id = n.cell_id AND s.tenant IS NOT DISTINCT FROM n.tenant AND detected_at BETWEEN moment - 720 * 3600 AND moment"""),
    "M16_local_time": (
        lambda t: _alerts(t).select("alert_id", F.date_format(m.local_time(F.timestamp_seconds("published"), F.element_at(F.array(*map(F.lit, ("mfds", "fda", "eu", "nmpa", "other"))), (F.col("alert_id") % 5 + 1).cast("int"))), "yyyy-MM-dd HH:mm:ss").alias("local")),
        f"WITH {_ORDERS} SELECT alert_id, strftime(timezone(['Asia/Seoul', 'America/New_York', 'Europe/Brussels', 'Asia/Shanghai', 'UTC'][alert_id % 5 + 1], to_timestamp(published)), '%Y-%m-%d %H:%M:%S') AS local FROM al"),
    "M17_detection_coverage": (
        lambda t: (lambda events: m.detection_coverage(events, diff.substantive(events)))(_numbered(t)),
        sql("SELECT cell_id, count(*) AS emitted, count(*) FILTER (WHERE change_kind NOT IN ('renumbered','moved')) AS alerted, round(count(*) FILTER (WHERE change_kind NOT IN ('renumbered','moved')) / count(*), 4) AS coverage FROM events GROUP BY 1", _ALERTS)),
    "M18_latency": (
        lambda t: m.latency(_timed(t), ["cell_id"], 24),
        f"WITH {_ORDERS} SELECT cell_id, count(*) FILTER (WHERE alert_id % 5 > 0) AS measured, count(*) FILTER (WHERE alert_id % 5 = 0) AS unmeasurable, CAST(max(CASE WHEN alert_id % 5 > 0 THEN alert_id % 50 END) AS DOUBLE) AS worst_hours, count(*) FILTER (WHERE alert_id % 5 > 0 AND alert_id % 50 <= 24) AS within_target FROM al GROUP BY 1"),
    "M18_backfill": (
        lambda t: m.latency(_timed(t).withColumn("retrieved_at", F.col("alerted_at") - 7200), ["cell_id"], 24, _timed(t).groupBy("cell_id").agg((F.min("published_at") + F.col("cell_id") % 5 * 86_400 * 400).alias("since"))),
        f"""WITH {_ORDERS}, timed AS (SELECT cell_id, published + alert_id % 50 * 3600 AS alerted_at, CASE WHEN alert_id % 5 > 0 THEN published END AS published_at FROM al), w AS (SELECT cell_id, min(published_at) + cell_id % 5 * 86400 * 400 AS since FROM timed GROUP BY 1),
        e AS (SELECT *, coalesce(published_at < since, false) AS early, round((alerted_at - published_at) / 3600, 3) AS h FROM timed JOIN w USING (cell_id))
        SELECT cell_id, count(h) FILTER (WHERE NOT early) AS measured, count(*) FILTER (WHERE published_at IS NULL) AS unmeasurable, CAST(max(h) FILTER (WHERE NOT early) AS DOUBLE) AS worst_hours, count(*) FILTER (WHERE NOT early AND h <= 24) AS within_target,
        count(*) FILTER (WHERE early) AS backfill, count(*) AS retrieved, CAST(2 AS DOUBLE) AS worst_retrieved FROM e GROUP BY 1"""),
    "M19_watch_start": (
        lambda t: m.watch_start(t.versions().select("doc_id", F.col("retrieved_at").alias("fetched_at")), t.document_cells()), sql("SELECT cell_id, min(retrieved_at) AS since FROM versions JOIN doc_cells USING (doc_id) GROUP BY 1")),
    "M20_alert_page": (
        lambda t: m.alert_page(_noted(t), _states(t), ("high", "medium"), 2, 20).select("alert_id", "deliveries"),
        f"WITH {_ORDERS} SELECT alert_id, coalesce(deliveries, 0) AS deliveries FROM (SELECT alert_id FROM al WHERE severity <> 'low' ORDER BY published + alert_id % 7 * 3600 DESC, alert_id LIMIT 20 OFFSET 20) LEFT JOIN (SELECT alert_id, count(*) AS deliveries FROM states GROUP BY 1) USING (alert_id)"),
    "M21_owner_assignment": (
        lambda t: m.assigned(_noted(t), _requests(t))[1],
        f"WITH {_ORDERS} SELECT alert_id, CASE WHEN alert_id % 2 = 0 THEN 'kim' END AS previous, CASE WHEN alert_id % 4 = 0 THEN 'park' ELSE 'lee' END AS owner, 2 AS at FROM al WHERE alert_id % 3 = 0"),
    "M21_owners": (
        lambda t: m.assigned(_noted(t), _requests(t))[0].select("alert_id", "owner"),
        f"WITH {_ORDERS} SELECT alert_id, CASE WHEN alert_id % 3 = 0 THEN CASE WHEN alert_id % 4 = 0 THEN 'park' ELSE 'lee' END WHEN alert_id % 2 = 0 THEN 'kim' END AS owner FROM al"),
    "M22_subscription_checks": (
        lambda t: m.subscription_errors(_channels(t)).select("subscription_id", "error"),
        f"WITH {_ORDERS} SELECT subscription_id, CASE subscription_id % 4 WHEN 3 THEN 'unknown_channel' WHEN 1 THEN CASE WHEN subscription_id % 8 = 1 THEN NULL ELSE 'no_destination' END END AS error FROM subs"),
    "M22_subscription_upsert": (
        lambda t: m.subscription_upsert(_channels(t).where("subscription_id % 3 > 0").withColumn("floor", F.lit("old")), _channels(t).where("subscription_id % 3 < 2")).groupBy("channel", "floor").agg(F.count("*").alias("n")),
        f"WITH {_ORDERS}, ch AS (SELECT *, ['in_app', 'webhook', 'email', 'fax'][subscription_id % 4 + 1] AS channel, subscription_id % 4 IN (0, 2) OR subscription_id % 8 = 1 AS sound FROM subs), fresh AS (SELECT * FROM ch WHERE subscription_id % 3 < 2 AND sound) SELECT channel, floor, count(*) AS n FROM (SELECT channel, 'old' AS floor FROM ch WHERE subscription_id % 3 > 0 AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.tenant IS NOT DISTINCT FROM ch.tenant AND f.cell_id = ch.cell_id AND f.channel = ch.channel) UNION ALL SELECT channel, floor FROM fresh) GROUP BY 1, 2"),
}
