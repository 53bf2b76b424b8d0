"""Queries of obligations from completions, answers and their metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from clausewise.adapt import sql
from clausewise.constants import MODALS, TAXONOMY
from clausewise.operators import answers as a
from clausewise.operators import obligations as o
from clausewise.operators import texts as x
from clausewise.plans.texts import TRIAGE

#: Conversations as answers: lines of assistant turns are claims; cites by place.
_CLAIMS = """turns AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE role = 'assistant'),
claims AS (SELECT answer_id, conv_id, turn, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS claim_index FROM turns),
cites AS (SELECT answer_id, claim_index, text, 'A' || (1 + (answer_id + claim_index) % 9) AS path FROM claims WHERE (answer_id + claim_index) % 4 > 0),
kept AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY answer_id ORDER BY claim_index) AS k FROM claims c) WHERE k <= 12 AND trim(text) <> ''),
valid AS (SELECT k.answer_id, count(DISTINCT k.claim_index) AS n_claims, count(c.path) AS n_cites, count(*) FILTER (WHERE c.path IN ('A9', 'A8') AND k.answer_id % 3 = 0) AS n_fabricated FROM kept k LEFT JOIN cites c ON c.answer_id = k.answer_id AND c.claim_index = k.claim_index GROUP BY 1),
verdicts AS (SELECT answer_id, claim_index, CASE (answer_id + claim_index) % 7 WHEN 0 THEN 'partial' WHEN 1 THEN 'nonsense' ELSE 'supported' END AS verdict FROM kept),
ver AS (SELECT answer_id, avg(CASE verdict WHEN 'supported' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS v_score, bool_or(verdict = 'nonsense') AS rejected FROM verdicts GROUP BY 1),
ret AS (SELECT k.answer_id, avg(CASE WHEN (k.answer_id + k.claim_index) % 4 > 0 AND k.claim_index % 9 < 5 THEN 1 - (k.claim_index % 9) / 5.0::DOUBLE ELSE 0.0::DOUBLE END) AS r_score FROM kept k GROUP BY 1),
final AS (SELECT answer_id, v_score, r_score, rejected, least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.7::DOUBLE * v_score + 0.3::DOUBLE * r_score)) AS conf FROM ver JOIN ret USING (answer_id)),
routed AS (SELECT *, CASE WHEN rejected THEN 'needs_verification' WHEN round(conf, 9) < 0.7 THEN 'needs_review' ELSE 'answered' END AS status FROM final)"""


def _claims(t):
    turns = t.raw("conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", F.posexplode(F.split("text", "\n", -1)).alias("claim_index", "text"))
    at = F.col("answer_id") + F.col("claim_index")
    return turns.withColumn("cites", F.when(at % 4 > 0, F.array(F.concat(F.lit("A"), (1 + at % 9).cast("string")))).otherwise(F.array().cast("array<string>")))


def _citable(t):
    answers = _claims(t).select("answer_id").distinct()
    return answers.select("answer_id", F.explode(F.array(*(F.lit(f"A{k}") for k in range(1, 10)))).alias("path")).where("NOT (answer_id % 3 = 0 AND path IN ('A8', 'A9'))")


def _kept(t):
    w = Window.partitionBy("answer_id").orderBy("claim_index")
    return _claims(t).withColumn("k", F.row_number().over(w)).where("k <= 12 AND trim(text) <> ''")


def _verdicts(t):
    m = (F.col("answer_id") + F.col("claim_index")) % 7
    return _kept(t).select("answer_id", "claim_index", F.when(m == 0, "partial").when(m == 1, "nonsense").otherwise("supported").alias("verdict"))


def _hits(t):
    """Five hits for each answer: the articles from its number on, round the nine there are."""
    k = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return _claims(t).select("answer_id").distinct().select("answer_id", k.alias("rank")).select("answer_id", "rank", F.concat(F.lit("A"), (1 + (F.col("answer_id") + F.col("rank")) % 9).cast("string")).alias("path"))


def _retrieval(t):
    return a.retrieval_score(_kept(t), _hits(t))


def _routed(t):
    joined = a.verification(_verdicts(t)).join(_retrieval(t), "answer_id").withColumn("conf", F.round(a.confidence(F.col("v_score"), F.col("r_score")), 9))
    return joined.withColumn("status", a.routed(F.col("rejected"), F.col("conf")))


def _completions(t):
    """Completions in JSON: a fence around every third, broken text every seventh."""
    one = F.to_json(F.struct(F.array(F.struct(F.col("text").alias("text"), F.array(F.struct(F.lit(1).alias("passage"), F.lit("A1").alias("clause_path"))).alias("cites"))).alias("claims")))
    return t.raw("conversations").select("conv_id", "turn", F.when(F.col("turn") % 7 == 6, "no json").when(F.col("turn") % 3 == 0, F.concat(F.lit("Sure: ```"), one, F.lit("```"))).otherwise(one).alias("completion"), "text")


def _irs(t):
    """Obligations: every second clause of first versions; drafted, locked or superseded, by two runs, some never cited."""
    o = F.col("ordinal")
    return t.clauses().where("v = 1 AND ordinal % 2 = 0").select(
        F.concat_ws(":", "doc_id", "ordinal").alias("ir_id"), "doc_id", "version_id", "path", "ordinal", F.when(o % 3 == 0, "locked").when(o % 5 == 0, "superseded").otherwise("draft").alias("status"),
        (F.col("doc_id") % 2 + o % 4 / 2).cast("int").alias("run_id"), (F.col("doc_id") * 1000 - o).alias("created_at"), F.when(o % 3 == 0, o).alias("locked_at"))


def _ir_citations(t):
    """Each obligation but every seventh cites its own clause, and every fourth the first article too."""
    rows = _irs(t).where("ordinal % 14 <> 0")
    first = rows.where("ordinal % 4 = 0").select("ir_id", "doc_id", "version_id", F.lit("A1").alias("path"))
    return rows.select("ir_id", "doc_id", "version_id", "path").unionByName(first).distinct()


_IRS = """irs AS (SELECT doc_id || ':' || ordinal AS ir_id, doc_id, version_id, path, ordinal, CASE WHEN ordinal % 3 = 0 THEN 'locked' WHEN ordinal % 5 = 0 THEN 'superseded' ELSE 'draft' END AS status, doc_id % 2 + (ordinal % 4) // 2 AS run_id, doc_id * 1000 - ordinal AS created_at FROM clauses WHERE v = 1 AND ordinal % 2 = 0),
ir_cites AS (SELECT DISTINCT ir_id, doc_id, version_id, unnest(CASE WHEN ordinal % 4 = 0 THEN [path, 'A1'] ELSE [path] END) AS path FROM irs WHERE ordinal % 14 <> 0)"""
_STALE = """touched AS (SELECT from_version AS version_id, to_version, old_path AS path, new_path, change_kind FROM diffs WHERE change_kind <> 'added'),
stale AS (SELECT irs.*, CASE WHEN status IN ('draft', 'locked') AND ir_id IN (SELECT ir_id FROM ir_cites JOIN touched USING (version_id, path)) THEN 'stale' ELSE status END AS now FROM irs),
targets AS (SELECT * FROM (SELECT ir_id, s.doc_id, to_version, t.path AS path, new_path, change_kind, row_number() OVER (PARTITION BY ir_id ORDER BY t.path, new_path) AS k FROM stale s JOIN ir_cites c USING (ir_id) JOIN touched t ON c.version_id = t.version_id AND c.path = t.path WHERE now = 'stale') WHERE k = 1)"""


def _stale(t, diffs=None):
    return o.marked_stale(_irs(t), _ir_citations(t), _diffs(t) if diffs is None else diffs)


def _targets(t):
    diffs = _diffs(t)
    return o.followed(o.stale_targets(_stale(t, diffs), _ir_citations(t), diffs), t.clauses())


def _proposals(t):
    """Proposals of a model about lines of first versions: some without statement, with an unknown modal, without citation, or with one that resolves nowhere."""
    k = F.col("ordinal") % 7
    return t.clauses().where("v = 1 AND ordinal % 3 = 0").select(
        F.concat_ws(":", "doc_id", "ordinal").alias("proposal_id"), "version_id", F.when(k == 1, " ").otherwise(F.col("text")).alias("statement"), F.when(k == 2, "should").otherwise("하여야 하며").alias("modal"),
        F.when(k == 3, F.array().cast("array<string>")).when(k == 4, F.array(F.lit("Z9"))).when(k == 5, F.array(F.col("path"), F.lit("Z9"))).otherwise(F.array("path", "path")).alias("cites"))


def _diffs(t):
    from clausewise.operators import diff

    return diff.build_diffs(t.clauses(), t.versions())


def _with_diffs(more: str) -> str:
    from clausewise.plans.diffs import DIFF_CTES

    return f"{DIFF_CTES}, {more}"


def _triaged(t):
    return t.legal_lines().select("doc_id", "ordinal", F.col("ordinal").cast("string").alias("path"), x.triage(F.lit("prose"), F.array(F.lit("x")), F.lit(None).cast("string"), F.col("line")).alias("triage"))


def _overrides(t):
    return t.legal_lines().where("ordinal % 9 = 0").select("doc_id", F.col("ordinal").cast("string").alias("path"), F.lit("excluded").alias("kind"), F.lit("definition").alias("reason"))


def _answers(t):
    """Routed answers about documents; every fifth was superseded."""
    k = F.col("answer_id")
    return _routed(t).select("answer_id", "status", F.floor(k / 1000).cast("long").alias("doc_id"), (F.floor(k / 1000) % 30).cast("long").alias("query_id"), (k % 5 == 0).alias("superseded"), (k % 997).alias("asked_at"))


_ANSWERS = "answers AS (SELECT answer_id, status, answer_id // 1000 AS doc_id, answer_id // 1000 % 30 AS query_id, answer_id % 5 = 0 AS superseded, answer_id % 997 AS asked_at FROM routed)"


def _cited(t):
    return _claims(t).select((F.col("conv_id") * 10 + 1).alias("version_id"), "answer_id", "claim_index", F.explode("cites").alias("path"))


def _parsed_completions(t):
    """Completions about their turns' texts, in many shapes: a list in prose, a list that is too long, one object, nothing, a list, broken text."""
    k = F.col("conv_id") % 6
    item = lambda n: F.to_json(F.struct(F.concat(n.cast("string"), F.lit(" "), "text").alias("statement"), F.lit("shall").alias("modal"), F.array(F.lit("A1")).alias("cites")))
    many = lambda n: F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), n), item), ","), F.lit("]"))
    turn = F.col("turn").cast("int") + 1
    return t.raw("conversations").select("conv_id", "turn", F.when(k == 0, F.concat(F.lit("Here: "), many(turn))).when(k == 1, many(F.lit(25))).when(k == 2, item(turn)).when(k == 3, "[]").when(k == 4, many(turn)).otherwise("none").alias("completion"))


QUERIES = {
    "X6_completion_parsing": (
        lambda t: _parsed_completions(t).select("conv_id", "turn", a.proposals(F.col("completion")).alias("p")).select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.get("p", F.lit(0))["statement"].alias("first")),
        "SELECT conv_id, turn, CAST(CASE conv_id % 6 WHEN 0 THEN turn + 1 WHEN 1 THEN 20 WHEN 2 THEN 1 WHEN 4 THEN turn + 1 ELSE 0 END AS BIGINT) AS n, CASE conv_id % 6 WHEN 0 THEN '1 ' || text WHEN 1 THEN '1 ' || text WHEN 2 THEN (turn + 1) || ' ' || text WHEN 4 THEN '1 ' || text END AS first FROM conversations"),
    "X7_cited_obligations": (
        lambda t: o.accepted(_proposals(t), t.clauses()).select("proposal_id", "verdict", F.array_join("paths", ",").alias("paths")),
        sql("SELECT doc_id || ':' || ordinal AS proposal_id, CASE ordinal % 7 WHEN 1 THEN 'no_statement' WHEN 2 THEN 'no_modal' WHEN 3 THEN 'uncited' WHEN 4 THEN 'unresolved' ELSE 'accepted' END AS verdict, CASE WHEN ordinal % 7 IN (3, 4) THEN '' ELSE path END AS paths FROM clauses WHERE v = 1 AND ordinal % 3 = 0")),
    "X8_classification_ledger": (
        lambda t: o.ledger(_triaged(t), _overrides(t), _triaged(t).where("ordinal % 24 <> 2").select("doc_id", "path")),
        sql(f"""SELECT doc_id, CAST(ordinal AS VARCHAR) AS path, CASE WHEN ordinal % 9 = 0 OR ordinal % 24 = 2 AND reason IS NULL OR reason IS NOT NULL THEN 'excluded' ELSE 'obligation_bearing' END AS kind,
          CASE WHEN ordinal % 9 = 0 THEN 'definition' WHEN reason IS NULL AND ordinal % 24 = 2 THEN 'unparseable' ELSE reason END AS reason, ordinal % 9 = 0 AS by_person FROM (SELECT *, {TRIAGE} AS reason FROM legal)""")),
    "X9_claiming_domains": (lambda t: o.claiming_domains(t.document_cells()), sql("SELECT DISTINCT doc_id, string_split(cell_id, '-')[2] AS domain FROM doc_cells")),
    "X10_clear_drafts": (
        lambda t: o.without_previous_drafts(_irs(t), 1).select("ir_id", "status", "run_id"),
        sql("SELECT ir_id, status, run_id FROM irs WHERE NOT (status = 'draft' AND run_id <> 1 AND version_id IN (SELECT version_id FROM irs WHERE run_id = 1))", _IRS)),
    "X11_mark_stale": (lambda t: _stale(t).select("ir_id", "status"), sql("SELECT ir_id, now AS status FROM stale", _with_diffs(f"{_IRS}, {_STALE}"))),
    "X12_stale_targets": (lambda t: _targets(t).select("ir_id", "path", "change_kind"), sql("SELECT ir_id, path, change_kind FROM targets", _with_diffs(f"{_IRS}, {_STALE}"))),
    "X13_followed_clauses": (
        lambda t: _targets(t).select("ir_id", "now_path"),
        sql("SELECT ir_id, CASE WHEN change_kind <> 'removed' AND (to_version, coalesce(new_path, path)) IN (SELECT (to_version, path) FROM news) THEN coalesce(new_path, path) END AS now_path FROM targets", _with_diffs(f"{_IRS}, {_STALE}"))),
    "X14_rederivation": (
        lambda t: o.rederived(_targets(t), t.clauses().where("v > 1 AND ordinal % 3 <> 1").select("version_id", F.concat_ws(":", "version_id", "path").alias("proposal_id"), F.array("path").alias("paths"))).select("ir_id", "link", "successors"),
        sql("SELECT ir_id, CASE WHEN count(n.path) > 0 THEN 'successor' ELSE 'unresolved' END AS link, count(DISTINCT n.path) AS successors FROM targets t LEFT JOIN (SELECT * FROM news WHERE ordinal % 3 <> 1) n ON n.to_version = t.to_version AND n.path = CASE WHEN t.change_kind <> 'removed' THEN coalesce(t.new_path, t.path) END GROUP BY 1", _with_diffs(f"{_IRS}, {_STALE}"))),
    "X15_extraction_coverage": (
        lambda t: o.coverage(_triaged(t), o.ledger(_triaged(t), _overrides(t), _triaged(t)).where("CAST(path AS INT) % 25 <> 0"), t.documents().select("doc_id", "domain")),
        sql(f"SELECT domain, count(*) AS clauses, count(*) FILTER (WHERE ordinal % 25 <> 0) AS classified, count(*) FILTER (WHERE ordinal % 25 = 0) AS unclassified, count(*) FILTER (WHERE ordinal % 25 <> 0 AND ordinal % 9 <> 0 AND reason IS NULL) AS bearing, count(*) FILTER (WHERE ordinal % 25 = 0) = 0 AS complete FROM (SELECT *, {TRIAGE} AS reason FROM legal) JOIN docs USING (doc_id) GROUP BY 1")),
    "X16_locked_listing": (
        lambda t: o.listed(_irs(t), _ir_citations(t), 2, 15).select("ir_id", F.array_join("paths", ",").alias("paths")),
        sql("SELECT ir_id, paths FROM (SELECT * FROM irs WHERE status = 'locked' ORDER BY created_at DESC, ir_id LIMIT 15 OFFSET 15) LEFT JOIN (SELECT ir_id, string_agg(DISTINCT path, ',' ORDER BY path) AS paths FROM ir_cites GROUP BY 1) USING (ir_id)", _IRS)),
    "X17_lock_transition": (
        lambda t: o.locked(_irs(t), _ir_citations(t), _irs(t).where("ordinal % 4 = 0").select("ir_id").union(t.documents().where("doc_id % 10 = 0").select(F.concat(F.lit("x"), F.col("doc_id").cast("string"))))),
        sql("""SELECT ir_id, CASE WHEN status = 'draft' AND ordinal % 14 <> 0 THEN 'locked' ELSE status END AS status, CASE WHEN status <> 'draft' THEN 'not_a_draft' WHEN ordinal % 14 = 0 THEN 'uncited' END AS refused FROM irs WHERE ordinal % 4 = 0
          UNION ALL SELECT 'x' || doc_id, NULL, 'unknown' FROM docs WHERE doc_id % 10 = 0""", _IRS)),
    "X18_prompt_assembly": (
        lambda t: t.legal_lines().select("doc_id", "ordinal", F.sha2(a.extraction_prompt(F.concat(F.lit("A"), F.col("ordinal").cast("string")), F.lit(None).cast("string"), F.col("line"), x.found_modals(F.col("line")), tuple(MODALS["ko"]), TAXONOMY["samd"]), 256).alias("digest")),
        sql("SELECT doc_id, ordinal, sha256('Clause A' || ordinal || chr(10) || 'Heading: ' || chr(10) || 'Modals found: ' || CASE WHEN ordinal % 12 = 2 THEN '하여야 한다' ELSE '(none)' END || chr(10) || 'Modals to use: 하여야 한다, 해야 한다, 도록 한다, 금지한다, 아니 된다' || chr(10) || 'Taxonomy: design_control, risk, vnv, postmarket' || chr(10) || 'Return a JSON array of bearer, modal, statement, condition_text, taxonomy_code and cites (always with A' || ordinal || '); [] if there is no obligation.' || chr(10) || line) AS digest FROM legal")),
    "Q1_prompt_blocks": (
        lambda t: t.raw("conversations").select("conv_id", "turn", F.sha2(a.prompt_block(F.col("turn") + 1, F.lit("A"), F.col("text"), F.array(*(F.lit(f"A{k}") for k in range(30)))), 256).alias("digest")),
        "SELECT conv_id, turn, sha256('[' || (turn + 1) || '] A' || chr(10) || CASE WHEN length(text) > 1200 THEN substr(text, 1, 1200) || ' …' ELSE text END || chr(10) || 'citable: ' || (SELECT string_agg('A' || i, ', ' ORDER BY i) FROM range(24) AS r(i))) AS digest FROM conversations"),
    "Q2_answer_json": (
        lambda t: _completions(t).select("conv_id", "turn", a.outermost_json(F.col("completion"), a.ANSWER).alias("j")).select("conv_id", "turn", F.col("j.claims")[0]["text"].alias("claim")),
        "SELECT conv_id, turn, CASE WHEN turn % 7 <> 6 THEN text END AS claim FROM conversations"),
    "Q3_claim_validation": (lambda t: a.validated_claims(_claims(t), _citable(t)).select("answer_id", "n_claims", "n_cites", "n_fabricated"), sql("SELECT * FROM valid", _CLAIMS)),
    "Q4_answer_rejection": (
        lambda t: a.validated_claims(_claims(t), _citable(t)).select("answer_id", "reason"),
        sql("SELECT answer_id, CASE WHEN n_fabricated > 0 THEN 'fabricated_citation' WHEN n_cites = 0 THEN 'no_citation' END AS reason FROM valid", _CLAIMS)),
    "Q5_verdicts": (
        lambda t: _verdicts(t).select("answer_id", "claim_index", a.parsed_verdict(F.when(F.col("claim_index") % 3 == 0, F.upper(F.concat(F.lit(" "), "verdict"))).otherwise(F.col("verdict"))).alias("verdict")),
        sql("SELECT answer_id, claim_index, CASE verdict WHEN 'nonsense' THEN 'unsupported' ELSE verdict END AS verdict FROM verdicts", _CLAIMS)),
    "Q6_verification_score": (lambda t: a.verification(_verdicts(t)).select("answer_id", F.round("v_score", 6).alias("v_score"), "rejected"), sql("SELECT answer_id, round(v_score, 6) AS v_score, rejected FROM ver", _CLAIMS)),
    "Q7_retrieval_score": (lambda t: _retrieval(t).select("answer_id", F.round("r_score", 6).alias("r_score")), sql("SELECT answer_id, round(r_score, 6) AS r_score FROM ret", _CLAIMS)),
    "Q8_confidence": (lambda t: _routed(t).select("answer_id", F.round("conf", 6).alias("conf")), sql("SELECT answer_id, round(conf, 6) AS conf FROM routed", _CLAIMS)),
    "Q9_routing": (lambda t: _routed(t).select("answer_id", "status"), sql("SELECT answer_id, status FROM routed", _CLAIMS)),
    "Q10_refusals": (
        lambda t: _completions(t).select("conv_id", "turn", a.refusal(F.col("conv_id") % 11, F.col("turn") % 5, F.col("turn") % 9 == 8, a.outermost_json(F.col("completion"), a.ANSWER).isNotNull(), F.when(F.col("conv_id") % 3 == 1, "fabricated_citation").when(F.col("conv_id") % 3 == 2, "other"), F.col("conv_id") % 2 == 0).alias("reason")),
        "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'no_versions' WHEN turn % 5 = 0 THEN 'no_retrieval' WHEN turn % 9 = 8 THEN 'model_unavailable' WHEN turn % 7 = 6 THEN 'unparseable' WHEN conv_id % 3 = 1 THEN 'fabricated_citation' WHEN conv_id % 2 = 0 THEN 'unsupported_claim' END AS reason FROM conversations"),
    "Q11_rendering": (
        lambda t: t.raw("conversations").select("conv_id", "turn", F.sha2(a.rendered(F.col("text"), F.when(F.col("turn") % 2 == 0, "straddles"), F.lit("as of 2024-12-01")), 256).alias("digest")),
        "SELECT conv_id, turn, sha256(concat_ws(chr(10) || chr(10), nullif(text, ''), CASE WHEN turn % 2 = 0 THEN 'straddles' END, 'as of 2024-12-01')) AS digest FROM conversations"),
    "Q12_persisted_citations": (
        lambda t: a.answer_citations(_cited(t), t.versions(), t.clauses().withColumn("effective_date", F.when(F.col("ordinal") == 5, F.lit("2025-06-01").cast("date")))).select("answer_id", "path", "doc_id", F.col("effective_date").cast("string").alias("day")),
        sql("SELECT c.answer_id, path, v.doc_id, CAST(CASE WHEN path = 'A2' AND (v.doc_id, 5) IN (SELECT (doc_id, ordinal) FROM lines) THEN DATE '2025-06-01' ELSE effective_date END AS VARCHAR) AS day FROM cites c JOIN turns USING (answer_id) JOIN versions v ON v.version_id = conv_id * 10 + 1", _CLAIMS)),
    "Q13_superseded_answers": (
        lambda t: a.superseded_answers(_cited(t), _diffs(t))[1],
        sql("SELECT DISTINCT answer_id FROM cites JOIN turns USING (answer_id) WHERE (conv_id * 10 + 1, path) IN (SELECT (from_version, old_path) FROM diffs WHERE change_kind <> 'added')", _with_diffs(_CLAIMS))),
    "Q14_answer_metrics": (
        lambda t: a.status_metrics(_routed(t).withColumn("domain", F.when(F.col("answer_id") % 2 == 0, "samd").otherwise("cosmetic")), ["domain"]),
        sql("SELECT CASE WHEN answer_id % 2 = 0 THEN 'samd' ELSE 'cosmetic' END AS domain, count(*) AS n, round(count(*) FILTER (WHERE status = 'answered') / count(*), 4) AS answered_rate, round(count(*) FILTER (WHERE status = 'needs_review') / count(*), 4) AS needs_review_rate, round(count(*) FILTER (WHERE status = 'needs_verification') / count(*), 4) AS needs_verification_rate FROM routed GROUP BY 1", _CLAIMS)),
    "Q15_answer_page": (
        lambda t: a.answer_page(_answers(t), t.document_cells().where("cell_id LIKE '%-samd'"), ("answered", "needs_review", "needs_verification"), False, 1, 10).select("answer_id"),
        sql("SELECT answer_id FROM answers WHERE NOT superseded AND doc_id IN (SELECT doc_id FROM doc_cells WHERE cell_id LIKE '%-samd') ORDER BY asked_at DESC, answer_id DESC LIMIT 10", f"{_CLAIMS}, {_ANSWERS}")),
    "Q16_citation_counts": (
        lambda t: a.citation_counts(_cited(t).withColumn("superseded", F.col("path") == "A1")),
        sql("SELECT answer_id, count(*) AS citations, count(*) FILTER (WHERE path = 'A1') AS superseded FROM cites GROUP BY 1", _CLAIMS)),
    "Q17_latest_answers": (
        lambda t: a.latest_answers(_answers(t), _verdicts(t)).select("query_id", "answer_id", F.array_join("verdicts.verdict", ",").alias("verdicts")),
        sql("SELECT query_id, answer_id, string_agg(verdict, ',' ORDER BY claim_index) AS verdicts FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY asked_at DESC, answer_id DESC) AS k FROM answers) WHERE k = 1) JOIN verdicts USING (answer_id) GROUP BY 1, 2", f"{_CLAIMS}, {_ANSWERS}")),
}
