"""Catalogue, fetch and document upserts: guards, outcomes and links between what was fetched and what is on record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import ROLES
from clausewise.operators.texts import first_exclusion, folded, keyword_cells


def guarded(sources: DataFrame) -> DataFrame:
    """Sources with action (fetch or skip) and reason: metadata-only tiers and sources marked as such are never fetched."""
    reason = F.when(F.col("tier") == "d", "metadata_only").when(~F.coalesce(F.col("ingestible"), F.lit(False)), "not_ingestible")
    return sources.withColumn("reason", reason).withColumn("action", F.when(F.col("reason").isNull(), "fetch").otherwise("skip"))


def skipped_observations(sources: DataFrame, now: Column) -> DataFrame:
    """One observation, outcome skipped, for each source that the guard holds back."""
    return guarded(sources).where("action = 'skip'").select("source_id", now.alias("fetched_at"), F.lit("skipped").alias("outcome"), F.col("reason").alias("error"))


def seeded(catalogue: DataFrame, seed: DataFrame) -> DataFrame:
    """The catalogue after a seed run: new rows enter enabled, known ones keep their switch and take the seed's columns, the rest is retired."""
    columns = [c for c in seed.columns if c != "source_id"]
    old = catalogue.select("source_id", F.col("enabled").alias("__enabled"), *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__old"))
    both = old.join(seed.withColumn("__new", F.lit(True)), "source_id", "full_outer")
    new = F.col("__new").isNotNull()
    return both.select("source_id", F.when(new, F.coalesce("__enabled", F.lit(True))).otherwise(False).alias("enabled"), *(F.when(new, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in columns))


def documents_upsert(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """canonical_key, action (insert, update, unchanged or annex_without_parent), title: what becomes of incoming documents.

    An annex needs its parent on record or in the same batch.
    """
    keys = known.select(F.col("canonical_key").alias("parent_key")).union(incoming.where("parent_key IS NULL").select("canonical_key")).distinct().withColumn("__parent", F.lit(True))
    have = known.select("canonical_key", F.col("title").alias("__title"), F.lit(True).alias("__known"))
    joined = incoming.join(keys, "parent_key", "left").join(have, "canonical_key", "left")
    action = F.when(F.col("parent_key").isNotNull() & F.col("__parent").isNull(), "annex_without_parent").when(F.col("__known").isNull(), "insert").when(
        F.col("__title").eqNullSafe(F.col("title")), "unchanged").otherwise("update")
    return joined.select("canonical_key", action.alias("action"), "title")


def claims_upsert(claims: DataFrame, incoming: DataFrame) -> DataFrame:
    """Claims (doc_id, cell_id) after a run: what is missing is added, what is there stays."""
    fresh = incoming.select("doc_id", "cell_id").distinct().join(claims, ["doc_id", "cell_id"], "left_anti")
    return claims.select("doc_id", "cell_id").unionByName(fresh)


def version_groups(versions: DataFrame) -> DataFrame:
    """version_id, group_id: the group of the document's earliest version that has one, else of its earliest version's own number."""
    w = Window.partitionBy("doc_id").orderBy(F.col("group_id").isNull(), "retrieved_at", "version_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return versions.select("version_id", F.coalesce(F.first("group_id").over(w), F.first("version_id").over(w)).alias("group_id"))


def observed(attempts: DataFrame) -> DataFrame:
    """One observation for each attempt: source_id, attempt, outcome, n_created, error."""
    return attempts.select(
        "source_id", "attempt", F.when(F.col("error").isNotNull(), "error").when(F.col("status") == 304, "not_modified").when(F.col("created") > 0, "changed").otherwise("unchanged").alias("outcome"),
        F.when(F.col("error").isNull(), F.col("created")).otherwise(0).alias("n_created"), "error")


def outcome_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("source_id", "outcome").agg(F.count("*").alias("n"), F.max("fetched_at").alias("last_at"))


# ---------------------------------------------------------------- parsed versions


def with_parents(clauses: DataFrame, key: str = "version_id") -> DataFrame:
    """Clauses with clause_id (version and ordinal) and parent_id, from the path above their own in the same version."""
    ids = clauses.withColumn("clause_id", F.concat_ws(":", key, "ordinal"))
    above = ids.select(key, F.col("path").alias("__above"), F.col("clause_id").alias("parent_id"))
    return ids.withColumn("__above", F.regexp_extract("path", "^(.*)/[^/]*$", 1)).join(above, [key, "__above"], "left").drop("__above")


def own_dates(clauses: DataFrame, versions: DataFrame) -> DataFrame:
    """Clauses whose date is null where it says no more than the version's."""
    dates = versions.select("version_id", F.col("effective_date").alias("__version"))
    return clauses.join(dates, "version_id").withColumn("effective_date", F.expr("nullif(effective_date, __version)")).drop("__version")


def quarantined(versions: DataFrame, clauses: DataFrame, signals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(versions that stay, their clauses, alerts): a version with a signal of drift goes with its clauses, and an alert says why.

    What stays is citable: it has clauses, and what is read later diffs against it.
    """
    out = signals.select("version_id").distinct()
    alerts = versions.join(signals, "version_id").select("version_id", "doc_id", "signal", F.lit("high").alias("severity"))
    return versions.join(out, "version_id", "left_anti"), clauses.join(out, "version_id", "left_anti"), alerts


def still_valid(diffs: DataFrame, reparsed: DataFrame) -> DataFrame:
    """Diffs that touch no re-parsed version on either side."""
    gone = reparsed.select("version_id").distinct()
    return diffs.join(gone.withColumnRenamed("version_id", "from_version"), "from_version", "left_anti").join(gone.withColumnRenamed("version_id", "to_version"), "to_version", "left_anti")


# ---------------------------------------------------------------- browsing


def cell_categories(documents: DataFrame, cells: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    return documents.join(cells, "doc_id").groupBy("cell_id").pivot("category", list(categories)).count().fillna(0)


def side_counts(documents: DataFrame, versions: DataFrame, today: Column) -> DataFrame:
    """doc_id, annexes, versions, pending of every document."""
    annexes = documents.where("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("doc_id")).agg(F.count("*").alias("annexes"))
    by = versions.groupBy("doc_id").agg(F.count("*").alias("versions"), F.count_if(F.col("effective_date") > today).alias("pending"))
    return documents.select("doc_id").join(annexes, "doc_id", "left").join(by, "doc_id", "left").fillna(0)


def source_list(sources: DataFrame, observations: DataFrame, newest: int) -> DataFrame:
    """Sources with n and the times of their newest observations, newest first."""
    w = Window.partitionBy("source_id").orderBy(F.desc("fetched_at"), F.desc("observation_id"))
    last = observations.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= newest).groupBy("source_id").agg(F.sort_array(F.collect_list("fetched_at"), False).alias("newest"))
    counts = observations.groupBy("source_id").agg(F.count("*").alias("n"))
    return sources.join(counts, "source_id", "left").join(last, "source_id", "left").fillna(0, ["n"])


def resolved_alerts(alerts: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Alerts after resolutions (alert_id, resolved_at): an alert is resolved once, by the first; later ones change nothing."""
    first = resolutions.groupBy("alert_id").agg(F.min("resolved_at").alias("__at"))
    return alerts.join(first, "alert_id", "left").withColumn("resolved_at", F.coalesce("resolved_at", "__at")).drop("__at")


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where("resolved_at IS NULL")


def raw_artifacts(versions: DataFrame, archive: DataFrame) -> DataFrame:
    """version_id, object_key, raw_bytes of the archived payload a version was read from; versions without one are left out."""
    return versions.select("version_id", "object_key").join(archive.select("object_key", F.length(F.col("body").cast("binary")).cast("long").alias("raw_bytes")), "object_key")


# ---------------------------------------------------------------- discovery


def unmatched(index: DataFrame, known: DataFrame) -> DataFrame:
    """Index rows (title) that no known title matches once case, blanks and middle dots are folded."""
    seen = known.select(folded(F.col("title")).alias("__folded")).distinct()
    return index.withColumn("__folded", folded(F.col("title"))).join(seen, "__folded", "left_anti").drop("__folded")


# Words of a wider net, for titles that the cells' keywords cannot see.
NEAR_MISS_TERMS = ("색소", "타르", "원료", "의약외품", "위해평가", "인체적용제품", "안전성 정보", "표시·광고", "표시광고")


def bucketed(index: DataFrame, known: DataFrame, keywords: dict[str, tuple[str, ...]], exclusions: tuple[str, ...]) -> DataFrame:
    """Index rows with bucket and matched: excluded (in scope but for a term), covered by a known title, candidate, or near miss; others are left out.

    A title counts as ruled out only if it would have been in scope without the exclusion.
    """
    seen = known.select(folded(F.col("title")).alias("__folded")).distinct().withColumn("__known", F.lit(True))
    rows = index.withColumn("__folded", folded(F.col("title"))).join(seen, "__folded", "left")
    named, out = F.size(keyword_cells(F.col("title"), keywords, ())) > 0, first_exclusion(F.col("title"), exclusions)
    near = F.coalesce(*(F.when(F.contains("title", F.lit(w)), F.lit(w)) for w in NEAR_MISS_TERMS))
    bucket = F.when(out.isNotNull() & named, "excluded").when(out.isNull() & named, F.when(F.col("__known"), "covered").otherwise("candidate")).when(near.isNotNull(), "near_miss")
    return rows.withColumn("bucket", bucket).where("bucket IS NOT NULL").withColumn(
        "matched", F.when(F.col("bucket") == "excluded", out).when(F.col("bucket") == "near_miss", near).otherwise("")).drop("__folded", "__known")


def marker_phrases(documents: DataFrame, phrases: tuple[str, ...]) -> DataFrame:
    """doc_id, phrase: the first phrase, in their order, that a text holds in any case."""
    low = F.lower(F.coalesce("text", F.lit("")))
    return documents.select("doc_id", F.coalesce(*(F.when(low.contains(p.lower()), F.lit(p)) for p in phrases), F.lit(None)).alias("phrase")).where("phrase IS NOT NULL")


def may(role: Column, least: str, allowed: tuple[str, ...] = ()) -> Column:
    """Whether a role reaches the least one needed, or is on a list of its own; an unknown role may nothing."""
    rank = F.create_map(*(v for k, r in enumerate(ROLES) for v in (F.lit(r), F.lit(k))))
    return F.coalesce((F.try_element_at(rank, role) >= ROLES.index(least)) | role.isin(*allowed), F.lit(False))
