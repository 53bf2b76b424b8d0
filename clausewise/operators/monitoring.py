"""Alerts: routing, grading, delivery, briefings and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import BACKOFF_BASE, BACKOFF_CAP, BULK_CLAUSES, DELIVERY_ATTEMPTS, NON_SUBSTANTIVE_KINDS, SEVERITIES, TIMEZONES


def composed(events: DataFrame) -> DataFrame:
    """One alert per amendment (to_version) and cell: counts by kind, clause paths; suppressed cells give none."""
    kept = events.where(~F.col("change_kind").isin(*NON_SUBSTANTIVE_KINDS))
    return kept.groupBy("cell_id", "doc_id", "to_version").agg(
        F.count("*").alias("clause_count"), F.count_if(F.col("change_kind") == "removed").alias("removed"), F.count_if(F.col("change_kind") == "modified").alias("modified"),
        F.count_if(F.col("change_kind") == "added").alias("added"), F.sort_array(F.collect_list(F.coalesce("new_path", "old_path"))).alias("paths"))


def grade(locked: Column, removed: Column, clauses: Column) -> Column:
    return F.when(locked > 0, "high").when(removed > 0, "medium").when(clauses >= BULK_CLAUSES, "medium").otherwise("low")


def grade_basis(locked: Column, removed: Column, clauses: Column) -> Column:
    return F.when(locked > 0, "locked_ir").when(removed > 0, "clause_removed").when(clauses >= BULK_CLAUSES, "bulk_change").otherwise("routine")


def severity_rank(severity: Column) -> Column:
    return F.create_map(*(x for k, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(k))))[severity]


def summary(title: Column, counts: Column, paths: Column) -> Column:
    """Title, kinds by falling count then name, the first five paths and how many more there are."""
    kinds = F.array_sort(F.transform(F.filter(F.map_entries(counts), lambda e: e["value"] > 0), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    more = F.size(paths) - 5
    return F.concat_ws("\n", title, F.array_join(F.transform(kinds, lambda e: F.concat(e["k"], F.lit(" "), (-e["n"]).cast("string"))), ", "),
                       F.concat(F.array_join(F.slice(paths, 1, 5), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise("")))


def fanned_to_tenants(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts for each distinct tenant with an enabled subscription of the cell; the null tenant is one of them."""
    return alerts.join(subscriptions.where("enabled").select("cell_id", "tenant").distinct(), "cell_id")


def eligible(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Subscriptions an alert goes to: same cell, same tenant (null-safe), severity at or above the floor."""
    a, s = alerts.alias("a"), subscriptions.where("enabled").alias("s")
    on = (F.col("a.cell_id") == F.col("s.cell_id")) & F.col("a.tenant").eqNullSafe(F.col("s.tenant")) & (severity_rank(F.col("s.floor")) <= severity_rank(F.col("a.severity")))
    return a.join(s, on).select("a.alert_id", "s.subscription_id")


def backoff(attempt: Column) -> Column:
    return F.least(BACKOFF_BASE * F.pow(F.lit(2.0), F.greatest(attempt - 1, F.lit(0))), F.lit(float(BACKOFF_CAP))).cast("long")


def delivery_state(attempts: DataFrame) -> DataFrame:
    """alert_id, subscription_id, n, next: done once sent, exhausted after the last attempt, else the wait to the next."""
    by = attempts.groupBy("alert_id", "subscription_id").agg(F.max("attempt").alias("n"), F.bool_or(F.col("status") == "sent").alias("sent"))
    return by.withColumn("state", F.when(F.col("sent"), "done").when(F.col("n") >= DELIVERY_ATTEMPTS, "exhausted").otherwise("retry")).withColumn("wait", F.when(F.col("state") == "retry", backoff(F.col("n"))))


def alert_status(alerts: DataFrame, states: DataFrame) -> DataFrame:
    """pending while anything can be retried, else delivered if anything was sent or nobody was to get it, else failed."""
    by = states.groupBy("alert_id").agg(F.bool_or(F.col("state") == "retry").alias("retry"), F.bool_or(F.col("state") == "done").alias("sent"))
    return alerts.join(by, "alert_id", "left").select("alert_id", F.when(F.col("retry"), "pending").when(F.col("sent") | F.col("retry").isNull(), "delivered").otherwise("failed").alias("status"))


def latency(alerts: DataFrame, by: list[str], target_hours: int, watching: DataFrame | None = None) -> DataFrame:
    """Hours from publication to alert, three places; alerts without a publication time are unmeasurable, not zero.

    With ``watching`` (by, since) what was published before its cell came under watch is backfill: it is counted apart and measures nothing of
    the authority's clock.  Where alerts say when their text was read (retrieved_at), the hours from then are told too, backfill included.
    """
    if watching is not None:
        alerts = alerts.join(watching, by, "left")
        early = F.coalesce(F.col("published_at") < F.col("since"), F.lit(False))
    else:
        early = F.lit(False)
    since = lambda c: F.round((F.col("alerted_at") - F.col(c)) / 3600, 3)
    hours = F.when(~early, since("published_at"))
    own = [F.count("retrieved_at").alias("retrieved"), F.max(since("retrieved_at")).alias("worst_retrieved")] if "retrieved_at" in alerts.columns else []
    return alerts.groupBy(*by).agg(
        F.count(hours).alias("measured"), F.count_if(F.col("published_at").isNull()).alias("unmeasurable"), F.max(hours).alias("worst_hours"), F.count_if(hours <= target_hours).alias("within_target"),
        *([F.count_if(early).alias("backfill")] if watching is not None else []), *own)


def local_time(ts: Column, authority: Column) -> Column:
    zones = F.create_map(*(x for k, v in TIMEZONES.items() for x in (F.lit(k), F.lit(v))))
    return F.from_utc_timestamp(ts, F.coalesce(zones[authority], F.lit("UTC")))


# ---------------------------------------------------------------- events and impact


def amendments(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """version_id, doc_id, title, doc_type of amended versions."""
    return versions.join(documents, "doc_id").select("version_id", "doc_id", "title", "doc_type")


def version_events(events: DataFrame) -> DataFrame:
    """Events with the path they are read at, ordered by cell and path."""
    return events.withColumn("path", F.coalesce("new_path", "old_path")).orderBy("cell_id", "path")


def locked_impact(events: DataFrame, citations: DataFrame, irs: DataFrame) -> DataFrame:
    """cell_id, to_version, irs: obligations ever locked (their status may be stale by now) whose citation an event touches, each counted once."""
    touched = events.where("change_kind <> 'added'").select("cell_id", "to_version", F.col("from_version").alias("version_id"), F.col("old_path").alias("path")).distinct()
    return touched.join(citations, ["version_id", "path"]).join(irs.where("locked_at IS NOT NULL").select("ir_id"), "ir_id", "left_semi").groupBy("cell_id", "to_version").agg(F.countDistinct("ir_id").alias("irs"))


def suppression(events: DataFrame) -> DataFrame:
    """cell_id, to_version, kept, suppressed, silent (nothing but renumbering and moves happened)."""
    moved = F.col("change_kind").isin(*NON_SUBSTANTIVE_KINDS)
    return events.groupBy("cell_id", "to_version").agg(F.count_if(~moved).alias("kept"), F.count_if(moved).alias("suppressed")).withColumn("silent", F.col("kept") == 0)


# ---------------------------------------------------------------- alerts on record


def upserted(alerts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Alerts after a run: one for each (tenant, cell_id, version_id), tenants compared null-safely; owner and delivery stay with what is on record, severity and counts are the new ones."""
    key = ("tenant", "cell_id", "version_id")
    on = None
    for k in key:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    both = alerts.withColumn("__old", F.lit(True)).alias("a").join(fresh.withColumn("__new", F.lit(True)).alias("b"), on, "full_outer")
    old = F.col("a.__old").isNotNull()
    pick = lambda c: F.when(old, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    return both.select(*(pick(k) for k in key), F.when(F.col("b.__new"), F.col("b.severity")).otherwise(F.col("a.severity")).alias("severity"), F.col("a.owner").alias("owner"), F.coalesce("a.delivery", F.lit("pending")).alias("delivery"))


def assigned(alerts: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their new owners, audit rows): the last request of an alert counts, and a change names the owner before."""
    w = Window.partitionBy("alert_id").orderBy(F.desc("at"))
    last = requests.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("alert_id", F.col("owner").alias("__owner"), "at")
    both = alerts.join(last, "alert_id", "left")
    now = F.coalesce("__owner", "owner")
    audit = both.where(F.col("__owner").isNotNull() & ~F.col("__owner").eqNullSafe(F.col("owner"))).select("alert_id", F.col("owner").alias("previous"), F.col("__owner").alias("owner"), "at")
    return both.withColumn("owner", now).drop("__owner", "at"), audit


def alert_page(alerts: DataFrame, attempts: DataFrame, severities: tuple[str, ...], page: int, size: int) -> DataFrame:
    """A page of alerts (alert_id, severity, detected_at) of these severities, newest first, with the number of their deliveries."""
    chosen = alerts.where(F.col("severity").isin(*severities)).orderBy(F.desc("detected_at"), "alert_id").offset((page - 1) * size).limit(size)
    return chosen.join(attempts.groupBy("alert_id").agg(F.count("*").alias("deliveries")), "alert_id", "left").fillna(0, ["deliveries"])


# Fixed value: channels that reach beyond the application.
REMOTE = ("webhook", "email")


def subscription_errors(subscriptions: DataFrame) -> DataFrame:
    """Subscriptions with error: a remote channel needs a destination, an unknown channel is none."""
    known = F.col("channel").isin("in_app", *REMOTE)
    bare = F.trim(F.coalesce("destination", F.lit(""))) == ""
    return subscriptions.withColumn("error", F.when(~known, "unknown_channel").when(F.col("channel").isin(*REMOTE) & bare, "no_destination"))


def subscription_upsert(subscriptions: DataFrame, incoming: DataFrame) -> DataFrame:
    """Subscriptions by (tenant, cell_id, channel), tenants null-safely: incoming sound rows replace, others leave what is there."""
    sound = subscription_errors(incoming).where("error IS NULL").drop("error")
    on = F.col("a.tenant").eqNullSafe(F.col("b.tenant")) & (F.col("a.cell_id") == F.col("b.cell_id")) & (F.col("a.channel") == F.col("b.channel"))
    kept = subscriptions.alias("a").join(sound.alias("b"), on, "left_anti")
    return kept.unionByName(sound.select(*subscriptions.columns))


def briefing(alerts: DataFrame, subscriptions: DataFrame, tenant: int | None, now: Column, hours: int) -> DataFrame:
    """Alerts of a tenant's enabled cells in the last ``hours``, both ends included, the gravest first, then the newest."""
    cells = subscriptions.where(F.col("enabled") & F.col("tenant").eqNullSafe(F.lit(tenant))).select("cell_id").distinct()
    rows = alerts.where(F.col("detected_at").between(now - hours * 3600, now)).join(cells, "cell_id", "left_semi")
    return rows.withColumn("rank", severity_rank(F.col("severity"))).orderBy(F.desc("rank"), F.desc("detected_at"), "alert_id").drop("rank")


def briefings(alerts: DataFrame, subscriptions: DataFrame, hours: int) -> DataFrame:
    """subscription_id, alert_id, place: for each enabled subscription (cell_id, tenant, at) the alerts of its cell and tenant in its own last
    ``hours``, both ends included, the gravest first, then the newest.

    Times fall into buckets as long as the window, so a window meets two of them, and alerts meet subscriptions by equality.
    """
    span = hours * 3600
    slot = lambda c: F.floor(F.col(c) / span)
    asked = subscriptions.where("enabled").select("subscription_id", "cell_id", F.col("tenant").alias("own"), "at", F.explode(F.array(slot("at") - 1, slot("at"))).alias("slot"))
    near = alerts.select("alert_id", "cell_id", "tenant", "severity", "detected_at", slot("detected_at").alias("slot")).join(asked, ["cell_id", "slot"])
    hit = near.where(F.col("tenant").eqNullSafe(F.col("own")) & F.col("detected_at").between(F.col("at") - span, F.col("at")))
    w = Window.partitionBy("subscription_id").orderBy(severity_rank(F.col("severity")).desc(), F.desc("detected_at"), "alert_id")
    return hit.select("subscription_id", "alert_id", "severity", F.row_number().over(w).alias("place"))


def briefing_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.count_if(F.col("owner").isNull()).alias("unassigned"))


def detection_coverage(events: DataFrame, alerted: DataFrame) -> DataFrame:
    """cell_id, emitted, alerted, coverage: distinct events (event_id) that some alert names, by all that were emitted; null where none was."""
    seen = alerted.select("event_id").distinct().withColumn("__seen", F.lit(True))
    by = events.select("cell_id", "event_id").distinct().join(seen, "event_id", "left").groupBy("cell_id").agg(F.count("*").alias("emitted"), F.count("__seen").alias("alerted"))
    return by.withColumn("coverage", F.round(F.try_divide("alerted", "emitted"), 4))


def watch_start(observations: DataFrame, cells: DataFrame) -> DataFrame:
    """cell_id, since: when anything of the cell was first fetched."""
    return observations.join(cells, "doc_id").groupBy("cell_id").agg(F.min("fetched_at").alias("since"))
