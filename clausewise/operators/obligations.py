"""Obligations and their life: drafted from cited proposals, locked, made stale by amendments, re-derived and succeeded.

Obligations are rows (ir_id, doc_id, version_id, status, run_id, created_at, locked_at, supersedes); citations are rows
(ir_id, doc_id, version_id, path), pinned to the version that they were read in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewise.operators import texts as x


def accepted(proposals: DataFrame, clauses: DataFrame) -> DataFrame:
    """proposal_id, verdict, paths of proposals (proposal_id, version_id, statement, modal, cites) checked against their version's clauses.

    A proposal without a statement, without a modal of the inventory or without a citation that resolves is rejected; those that
    do not resolve are left out of the rest.
    """
    cites = proposals.select("proposal_id", "version_id", F.explode("cites").alias("path")).distinct().join(clauses.select("version_id", "path").distinct(), ["version_id", "path"], "left_semi")
    found = cites.groupBy("proposal_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    joined = proposals.join(found, "proposal_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))
    blank = F.trim(F.coalesce("statement", F.lit(""))) == ""
    verdict = F.when(blank, "no_statement").when(x.canonical_modal(F.col("modal")).isNull(), "no_modal").when(F.size("cites") == 0, "uncited").when(F.size("paths") == 0, "unresolved").otherwise("accepted")
    return joined.select("proposal_id", verdict.alias("verdict"), "paths")


def without_previous_drafts(irs: DataFrame, run_id: int) -> DataFrame:
    """What stays when a run begins: drafts of other runs of the same versions go, whatever was locked or went further stays."""
    scope = irs.where(F.col("run_id") == run_id).select("version_id").distinct()
    old = irs.where((F.col("status") == "draft") & (F.col("run_id") != run_id)).join(scope, "version_id", "left_semi").select("ir_id")
    return irs.join(old, "ir_id", "left_anti")


def touching(diffs: DataFrame) -> DataFrame:
    """version_id, path (of the previous version), to_version, new_path, change_kind of all diffs but additions."""
    return diffs.where("change_kind <> 'added'").select(F.col("from_version").alias("version_id"), F.col("old_path").alias("path"), "to_version", "new_path", "change_kind")


def marked_stale(irs: DataFrame, citations: DataFrame, diffs: DataFrame) -> DataFrame:
    """Drafts and locked obligations one of whose citations a diff touches are stale; superseded ones are evidence and stay."""
    hit = citations.join(touching(diffs).select("version_id", "path").distinct(), ["version_id", "path"], "left_semi").select("ir_id").distinct().withColumn("__hit", F.lit(True))
    return irs.join(hit, "ir_id", "left").withColumn("status", F.when(F.col("__hit") & F.col("status").isin("draft", "locked"), "stale").otherwise(F.col("status"))).drop("__hit")


def stale_targets(irs: DataFrame, citations: DataFrame, diffs: DataFrame) -> DataFrame:
    """ir_id, doc_id, version_id, path, to_version, new_path, change_kind: one diff for each stale obligation, in the order in which they were written.

    The first by path is enough, since re-extraction reads the whole new clause.
    """
    hits = irs.where("status = 'stale'").select("ir_id", "doc_id", "created_at").join(citations, ["ir_id", "doc_id"]).join(touching(diffs), ["version_id", "path"])
    w = Window.partitionBy("ir_id").orderBy("path", "new_path")
    return hits.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("ir_id", "created_at", "doc_id", "version_id", "path", "to_version", "new_path", "change_kind").orderBy("created_at", "ir_id")


def followed(targets: DataFrame, clauses: DataFrame) -> DataFrame:
    """Targets with now_path, where the amended clause stands: the diff's new side, else the same path if the new version has it; null if removed."""
    known = clauses.select(F.col("version_id").alias("to_version"), F.col("path").alias("__now")).distinct().withColumn("__held", F.lit(True))
    wanted = targets.withColumn("__now", F.when(F.col("change_kind") != "removed", F.coalesce("new_path", "path")))
    return wanted.join(known, ["to_version", "__now"], "left").withColumn("now_path", F.when(F.col("__held"), F.col("__now"))).drop("__now", "__held")


def rederived(targets: DataFrame, proposals: DataFrame) -> DataFrame:
    """ir_id, link, successors: each target's new clause meets the proposals of the new run that cite it; all of them succeed it.

    A target without a clause, or whose clause states nothing any more, is unresolved and stays work for a person.
    """
    cited = proposals.select(F.col("version_id").alias("to_version"), "proposal_id", F.explode("paths").alias("now_path"))
    joined = targets.join(cited, ["to_version", "now_path"], "left").groupBy("ir_id").agg(F.countDistinct("proposal_id").alias("successors"), F.sort_array(F.collect_set("proposal_id")).alias("by"))
    return joined.withColumn("link", F.when(F.col("successors") > 0, "successor").otherwise("unresolved"))


def listed(irs: DataFrame, citations: DataFrame, page: int, size: int, statuses: tuple[str, ...] = ("locked",)) -> DataFrame:
    """A page of obligations of these statuses, newest first, each once with all its paths."""
    paths = citations.groupBy("ir_id").agg(F.sort_array(F.collect_set("path")).alias("paths"))
    chosen = irs.where(F.col("status").isin(*statuses)).orderBy(F.desc("created_at"), "ir_id").offset((page - 1) * size).limit(size)
    return chosen.join(paths, "ir_id", "left")


def locked(irs: DataFrame, citations: DataFrame, wanted: DataFrame) -> DataFrame:
    """ir_id, status, refused for requests to lock: only drafts that cite something change."""
    cited = citations.select("ir_id").distinct().withColumn("__cited", F.lit(True))
    rows = wanted.select("ir_id").distinct().join(irs.select("ir_id", "status"), "ir_id", "left").join(cited, "ir_id", "left")
    refused = F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "draft", "not_a_draft").when(F.col("__cited").isNull(), "uncited")
    return rows.select("ir_id", F.when(refused.isNull(), "locked").otherwise(F.col("status")).alias("status"), refused.alias("refused"))


def ledger(clauses: DataFrame, overrides: DataFrame, derived: DataFrame) -> DataFrame:
    """doc_id, path, kind, reason, by_person: a clause's class; a person's word wins, and a bearing clause that gave no obligation is unparseable.

    ``clauses`` carry triage (kind, reason), ``overrides`` a person's (kind, reason), ``derived`` the clauses that gave one.
    """
    said = overrides.select("doc_id", "path", F.col("kind").alias("__kind"), F.col("reason").alias("__reason"), F.lit(True).alias("__person"))
    gave = derived.select("doc_id", "path").distinct().withColumn("__gave", F.lit(True))
    rows = clauses.join(said, ["doc_id", "path"], "left").join(gave, ["doc_id", "path"], "left")
    empty = (F.col("triage.kind") == "obligation_bearing") & F.col("__gave").isNull()
    person = F.col("__person").isNotNull()
    return rows.select(
        "doc_id", "path", F.when(person, F.col("__kind")).when(empty, "excluded").otherwise(F.col("triage.kind")).alias("kind"),
        F.when(person, F.col("__reason")).when(empty, "unparseable").otherwise(F.col("triage.reason")).alias("reason"), person.alias("by_person"))


def coverage(clauses: DataFrame, ledger_rows: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, clauses, classified, unclassified, bearing, complete: how much of each domain's clauses has a class."""
    rows = clauses.select("doc_id", "path").join(ledger_rows.select("doc_id", "path", "kind"), ["doc_id", "path"], "left").join(domains, "doc_id")
    return rows.groupBy("domain").agg(F.count("*").alias("clauses"), F.count("kind").alias("classified"), F.count_if(F.col("kind").isNull()).alias("unclassified"), F.count_if(F.col("kind") == "obligation_bearing").alias("bearing")).withColumn(
        "complete", F.col("unclassified") == 0)


def claiming_domains(cells: DataFrame) -> DataFrame:
    """doc_id, domain of the cells that claim a document, each once."""
    return cells.select("doc_id", F.element_at(F.split("cell_id", "-"), -1).alias("domain")).distinct()
