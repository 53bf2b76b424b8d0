"""Answers: completions are data; their parsing, validation, scoring and routing are plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import CONFIDENCE_THRESHOLD, MAX_CITABLE, MAX_CLAIMS, MAX_PASSAGE_CHARS, RETRIEVAL_WEIGHT, VERDICT_WEIGHTS, VERIFICATION_WEIGHT

ANSWER = "struct<claims:array<struct<text:string,cites:array<struct<passage:int,clause_path:string>>>>>"
PROPOSALS = "array<struct<bearer:string,modal:string,statement:string,condition_text:string,taxonomy_code:string,cites:array<string>>>"


def outermost_json(text: Column, schema: str) -> Column:
    """The completion as JSON, else the outermost object in it; null where neither parses."""
    whole = F.from_json(F.trim(text), schema)
    inner = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)
    has = lambda c: c["claims"].isNotNull()
    return F.when(has(whole), whole).when(has(inner), inner)


def proposals(text: Column) -> Column:
    """A completion as a list of at most 20 proposals: a list, or a single object."""
    listed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), PROPOSALS)
    single = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), PROPOSALS.removeprefix("array<").removesuffix(">"))
    return F.slice(F.coalesce(listed, F.when(single.isNotNull(), F.array(single)), F.from_json(F.lit("[]"), PROPOSALS)), 1, 20)


def prompt_block(number: Column, header: Column, body: Column, paths: Column) -> Column:
    cut = F.when(F.length(body) > MAX_PASSAGE_CHARS, F.concat(F.substring(body, 1, MAX_PASSAGE_CHARS), F.lit(" …"))).otherwise(body)
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), header, F.lit("\n"), cut, F.lit("\ncitable: "), F.array_join(F.slice(paths, 1, MAX_CITABLE), ", "))


def validated_claims(claims: DataFrame, citable: DataFrame) -> DataFrame:
    """answer_id, n_claims, n_cites, n_fabricated, reason.  Any fabricated citation rejects the answer; so does none at all."""
    kept = claims.withColumn("k", F.row_number().over(Window.partitionBy("answer_id").orderBy("claim_index"))).where((F.col("k") <= MAX_CLAIMS) & (F.trim("text") != ""))
    cites = kept.select("answer_id", "claim_index", F.explode_outer("cites").alias("path"))
    checked = cites.join(citable.select("answer_id", "path").distinct().withColumn("known", F.lit(True)), ["answer_id", "path"], "left")
    counts = checked.groupBy("answer_id").agg(F.countDistinct("claim_index").alias("n_claims"), F.count("path").alias("n_cites"), F.count_if(F.col("path").isNotNull() & F.col("known").isNull()).alias("n_fabricated"))
    return counts.withColumn("reason", F.when(F.col("n_fabricated") > 0, "fabricated_citation").when(F.col("n_cites") == 0, "no_citation"))


def verification(verdicts: DataFrame) -> DataFrame:
    """answer_id, v_score, rejected.  A verdict that is none of the three is unsupported."""
    known = F.when(F.col("verdict").isin(*VERDICT_WEIGHTS), F.col("verdict")).otherwise("unsupported")
    weight = F.create_map(*(x for k, v in VERDICT_WEIGHTS.items() for x in (F.lit(k), F.lit(v))))[known]
    return verdicts.groupBy("answer_id").agg(F.coalesce(F.avg(weight), F.lit(0.0)).alias("v_score"), F.bool_or(known == "unsupported").alias("rejected"))


def confidence(v: Column, r: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), VERIFICATION_WEIGHT * v + RETRIEVAL_WEIGHT * r))


def routed(rejected: Column, conf: Column) -> Column:
    return F.when(rejected, "needs_verification").when(conf < CONFIDENCE_THRESHOLD, "needs_review").otherwise("answered")


def rendered(answer: Column, *notices: Column) -> Column:
    return F.array_join(F.filter(F.array(answer, *notices), lambda x: x.isNotNull() & (F.trim(x) != "")), "\n\n")


def status_metrics(answers: DataFrame, by: list[str]) -> DataFrame:
    """Counts and rates (four places; null without answers) of each final status."""
    n = F.count("*")
    rate = lambda s: F.round(F.count_if(F.col("status") == s) / F.nullif(n, F.lit(0)), 4)
    return answers.groupBy(*by).agg(n.alias("n"), *(rate(s).alias(f"{s}_rate") for s in ("answered", "needs_review", "needs_verification")))


def parsed_verdict(raw: Column) -> Column:
    """A verdict as it is scored: what is none of the three is unsupported."""
    said = F.lower(F.trim(raw))
    return F.when(said.isin(*VERDICT_WEIGHTS), said).otherwise("unsupported")


def retrieval_score(claims: DataFrame, hits: DataFrame) -> DataFrame:
    """answer_id, r_score: the mean over claims of one minus the best rank among what they cite, by the number of hits; none is 0.

    ``claims`` are (answer_id, claim_index, cites), ``hits`` (answer_id, path, rank from 0).
    """
    n = hits.groupBy("answer_id").agg(F.count("*").alias("n_hits"))
    best = claims.select("answer_id", "claim_index", F.explode_outer("cites").alias("path")).join(hits.select("answer_id", "path", "rank"), ["answer_id", "path"], "left").groupBy("answer_id", "claim_index").agg(F.min("rank").alias("rank"))
    each = best.join(n, "answer_id", "left")
    return each.groupBy("answer_id").agg(F.avg(F.coalesce(1 - F.col("rank") / F.col("n_hits"), F.lit(0.0))).alias("r_score"))


# Why there is no answer, in the order they are found out.
REFUSALS = ("no_versions", "no_retrieval", "model_unavailable", "unparseable", "fabricated_citation", "no_citation", "unsupported_claim")


def refusal(versions: Column, hits: Column, failed: Column, parsed: Column, invalid: Column, rejected: Column) -> Column:
    """The first reason not to answer: nothing in scope, nothing found, no completion, none that reads, invalid citations, an unsupported claim."""
    return (
        F.when(versions == 0, REFUSALS[0]).when(hits == 0, REFUSALS[1]).when(failed, REFUSALS[2]).when(~parsed, REFUSALS[3])
        .when(invalid.isin(REFUSALS[4], REFUSALS[5]), invalid).when(rejected, REFUSALS[6]))


def answer_citations(cites: DataFrame, versions: DataFrame, clauses: DataFrame) -> DataFrame:
    """answer_id, version_id, path, doc_id, effective_date: the document of the version, and the clause's own date before the version's."""
    own = clauses.select("version_id", "path", F.col("effective_date").alias("__own")).dropDuplicates(["version_id", "path"])
    return cites.join(versions.select("version_id", "doc_id", "effective_date"), "version_id").join(own, ["version_id", "path"], "left").select(
        "answer_id", "version_id", "path", "doc_id", F.coalesce("__own", "effective_date").alias("effective_date"))


def superseded_answers(cites: DataFrame, diffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations, answers) that a diff other than an addition touches: exactly its previous version and path."""
    touched = diffs.where("change_kind <> 'added'").select(F.col("from_version").alias("version_id"), F.coalesce("old_path", "new_path").alias("path")).distinct()
    hit = cites.join(touched, ["version_id", "path"], "left_semi")
    return hit, hit.select("answer_id").distinct()


def answer_page(answers: DataFrame, cells: DataFrame | None, statuses: tuple[str, ...], superseded: bool | None, page: int, size: int) -> DataFrame:
    """A page of answers (answer_id, doc_id, status, superseded, asked_at), newest first, of these statuses, cells' documents and superseded or not."""
    rows = answers.where(F.col("status").isin(*statuses))
    if superseded is not None:
        rows = rows.where(F.col("superseded") == superseded)
    if cells is not None:
        rows = rows.join(cells.select("doc_id").distinct(), "doc_id", "left_semi")
    return rows.orderBy(F.desc("asked_at"), F.desc("answer_id")).offset((page - 1) * size).limit(size)


def citation_counts(cites: DataFrame) -> DataFrame:
    """answer_id, citations, superseded of citations (answer_id, superseded)."""
    return cites.groupBy("answer_id").agg(F.count("*").alias("citations"), F.count_if("superseded").alias("superseded"))


def latest_answers(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """query_id, answer_id, verdicts (claim_index, verdict in order) of each query's newest answer."""
    w = Window.partitionBy("query_id").orderBy(F.desc("asked_at"), F.desc("answer_id"))
    newest = answers.withColumn("__k", F.row_number().over(w)).where("__k = 1").select("query_id", "answer_id")
    said = verdicts.groupBy("answer_id").agg(F.sort_array(F.collect_list(F.struct("claim_index", "verdict"))).alias("verdicts"))
    return newest.join(said, "answer_id", "left")


PROMPT = """Clause {path}
Heading: {heading}
Modals found: {modals}
Modals to use: {inventory}
Taxonomy: {taxonomy}
Return a JSON array of bearer, modal, statement, condition_text, taxonomy_code and cites (always with {path}); [] if there is no obligation.
{text}"""


def extraction_prompt(path: Column, heading: Column, text: Column, found: Column, modals: tuple[str, ...], taxonomy: tuple[str, ...]) -> Column:
    """What a model is asked about one clause: what was found in it, and the closed lists its reply must keep to."""
    out = F.lit(PROMPT.replace("{inventory}", ", ".join(modals)).replace("{taxonomy}", ", ".join(taxonomy)))
    said = F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise("(none)")
    for name, value in (("path", path), ("heading", F.coalesce(heading, F.lit(""))), ("modals", said), ("text", text)):
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
