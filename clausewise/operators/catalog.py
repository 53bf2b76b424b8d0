"""Ingestion upserts, version status, browsing, scheduling and discovery: joins, anti-joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import DOC_CATEGORIES, POLL_SECONDS, STATUTE_TYPES, TIER_FLOOR_SECONDS


def new_versions(artifacts: DataFrame, versions: DataFrame, key: tuple[str, ...] = ("doc_id", "content_hash")) -> DataFrame:
    """Artifacts whose content is not on record yet, once each; the rest are only observed."""
    return artifacts.join(versions.select(*key).distinct(), list(key), "left_anti").dropDuplicates(list(key))


def merged(current: DataFrame, incoming: DataFrame, key: list[str], refreshed: list[str]) -> DataFrame:
    """Upsert on a null-safe key: columns ``refreshed`` come from the incoming row where there is one."""
    on = None
    for k in key:
        same = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = same if on is None else on & same
    have = F.col("b.__in").isNotNull()
    pick = lambda c: F.when(have & (F.lit(c in refreshed) | F.col("a.__cur").isNull()), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    a, b = current.withColumn("__cur", F.lit(1)).alias("a"), incoming.withColumn("__in", F.lit(1)).alias("b")
    out = a.join(b, on, "full_outer")
    return out.select(*(pick(c) for c in current.columns))


def doc_category(doc_type: Column, parent_type: Column) -> Column:
    return (
        F.when(doc_type.isin(*STATUTE_TYPES), "statute").when(doc_type == "notice", "admin_rule")
        .when(doc_type == "annex", F.when(parent_type == "notice", "admin_rule_annex").otherwise("statute_annex")).when(doc_type == "feed", "feed").otherwise("other"))


def with_category(documents: DataFrame) -> DataFrame:
    parent = documents.select(F.col("doc_id").alias("parent_id"), F.col("doc_type").alias("parent_type"))
    rank = F.create_map(*(x for k, c in enumerate(DOC_CATEGORIES) for x in (F.lit(c), F.lit(k))))
    return documents.join(parent, "parent_id", "left").withColumn("category", doc_category(F.col("doc_type"), F.col("parent_type"))).withColumn("category_rank", rank[F.col("category")])


def version_status(versions: DataFrame, today: Column) -> DataFrame:
    """in_force (date of the document's version in force) and status of each version."""
    arrived = F.max(F.when(F.col("effective_date") <= today, F.col("effective_date"))).over(Window.partitionBy("doc_id"))
    d = F.col("effective_date")
    return versions.withColumn("in_force", arrived).withColumn(
        "status", F.when(d.isNull(), "unknown").when(d > today, "pending").when(d == F.col("in_force"), "in_force").otherwise("superseded"))


def version_scope(versions: DataFrame, today: Column) -> DataFrame:
    """One parsed version per document: in force first, the latest of those, else the nearest to come, else the newest read."""
    d, arrived = F.col("effective_date"), F.coalesce(F.col("effective_date") <= today, F.lit(False))
    w = Window.partitionBy("doc_id").orderBy(arrived.desc(), F.when(arrived, d).desc_nulls_last(), d.asc_nulls_last(), F.col("retrieved_at").desc(), F.col("version_id"))
    return versions.where("parsed").withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """A 1-based page: top-k with an offset, never a numbering of all rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def poll_interval(override: Column, block: Column, tier: Column) -> Column:
    as_map = lambda d: F.create_map(*(x for k, v in d.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(override, F.greatest(as_map(POLL_SECONDS)[block], as_map(TIER_FLOOR_SECONDS)[tier]))


def due(schedules: DataFrame, now: Column, limit: int = 50) -> DataFrame:
    """The oldest due schedules, advanced from now (not from when they were due)."""
    return schedules.where(F.col("enabled") & (F.col("next_due_at") <= now)).orderBy("next_due_at", "source_id").limit(limit).withColumn("next_due_at", now + F.col("interval_seconds"))


def failure_streak(observations: DataFrame) -> DataFrame:
    """Errors in a row at each observation: rows since the source's last success."""
    w = Window.partitionBy("source_id").orderBy("fetched_at", "observation_id")
    bad = (F.col("outcome") == "error").cast("int")
    run = F.sum(1 - bad).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return observations.withColumn("run", run).withColumn("failures", F.sum(bad).over(Window.partitionBy("source_id", "run").orderBy("fetched_at", "observation_id").rowsBetween(Window.unboundedPreceding, 0)))


def fetch_outcome(tier: Column, status: Column, created: Column) -> Column:
    """One attempt's outcome: a source not to be fetched is skipped, transport and authority errors are errors, 304 is not modified."""
    return F.when(tier == "d", "skipped").when((status >= 400) | status.isNull(), "error").when(status == 304, "not_modified").when(created > 0, "changed").otherwise("unchanged")


def one_open_alert(alerts: DataFrame) -> DataFrame:
    """The first open alert of each (source, signal, expected): its number and time stay, what was seen (``actual``) and
    ``refreshed_at`` are those of the newest.  An aggregate, so a source that fails for ever is combined before it is shuffled."""
    order = F.struct("raised_at", "alert_id")
    kept = [c for c in alerts.columns if c not in ("source_id", "signal", "expected", "actual")]
    return alerts.where("resolved_at IS NULL").groupBy("source_id", "signal", "expected").agg(
        F.min_by(F.struct(*kept), order).alias("first"), F.max_by(F.struct("actual", F.col("raised_at").alias("refreshed_at")), order).alias("newest")).select(
        "source_id", "signal", "expected", "first.*", "newest.*")


def paths_page(clauses: DataFrame, size: int) -> DataFrame:
    """The page on which each clause stands, in reading order."""
    w = Window.partitionBy("version_id").orderBy("ordinal", "path")
    return clauses.withColumn("page", F.floor((F.row_number().over(w) - 1) / size) + 1)


CHAIN_BLOCK = 1000


def canonical_entry(action: Column, actor: Column, entity_type: Column, entity_id: Column, at: Column, payload: Column) -> Column:
    """An audit entry as compact JSON with sorted keys and its time in UTC; payloads are maps, whose keys are sorted too."""
    utc = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    body = F.map_from_entries(F.array_sort(F.map_entries(payload)))
    return F.to_json(F.struct(action.alias("action"), actor.alias("actor_id"), utc.alias("at"), entity_id.alias("entity_id"), entity_type.alias("entity_type"), body.alias("payload")), {"ignoreNullFields": "false"})


def entry_hash(body: Column, previous: Column) -> Column:
    return F.sha2(F.concat(body, previous), 256)


def audit_chain(entries: DataFrame, genesis: str) -> DataFrame:
    """Entry hashes of a log (chain, seq, body): each entry's canonical form with its predecessor's hash.

    A hash needs the one before it, so a chain is a fold over its sorted entries, chains are independent of each other, and
    the fold carries digests of bodies, not bodies, from one entry to the next.
    """
    log = F.sort_array(F.collect_list(F.struct("seq", F.struct("body").alias("e")))).alias("log")
    # blocks of hashes, each led by the last one before it, so appending copies a block and not the chain
    block = lambda acc, at: F.aggregate(F.slice("log", at, CHAIN_BLOCK), F.array(F.element_at(F.element_at(acc, -1), -1)), lambda done, e: F.concat(done, F.array(entry_hash(e["e"]["body"], F.element_at(done, -1)))))
    blocks = F.aggregate(F.sequence(F.lit(1), F.size("log"), F.lit(CHAIN_BLOCK)), F.array(F.array(F.lit(genesis), F.lit(genesis))), lambda acc, at: F.concat(acc, F.array(block(acc, at))))
    folded = F.flatten(F.transform(blocks, lambda b: F.slice(b, 2, F.size(b))))
    chains = entries.groupBy("chain").agg(log).withColumn("hashes", folded)
    each = chains.select("chain", "hashes", F.posexplode("log").alias("k", "entry"))
    return each.select("chain", "entry.seq", F.col("entry.e.body").alias("body"), F.get("hashes", F.col("k")).alias("prev_hash"), F.get("hashes", F.col("k") + 1).alias("entry_hash"))


def verify_chain(entries: DataFrame, genesis: str) -> DataFrame:
    """chain, n, first_bad: the first entry whose link or hash does not hold (null: the chain is sound)."""
    before = F.coalesce(F.lag("entry_hash").over(Window.partitionBy("chain").orderBy("seq")), F.lit(genesis))
    good = (F.col("prev_hash") == before) & (F.col("entry_hash") == F.sha2(F.concat("body", "prev_hash"), 256))
    return entries.withColumn("good", good).groupBy("chain").agg(F.count("*").alias("n"), F.min(F.when(~F.col("good"), F.col("seq"))).alias("first_bad"))
