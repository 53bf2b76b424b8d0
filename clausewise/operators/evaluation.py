"""Evaluation arithmetic: every rate is null on an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewise.constants import AGREEMENT_FLOOR, AXES, GATES, NO_GO_FAILURES


def article_of(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.coalesce(F.get(F.filter(parts, lambda p: p.rlike("조$") | p.contains("조의")), F.lit(0)), F.element_at(parts, -1))


REFUSAL_AXES = ("mis_citation", "cross_domain", "unanswerable")


def composition_errors(items: DataFrame, floor: int) -> DataFrame:
    """item_id (an axis for floors), error: what makes a golden set no evidence.

    ``items`` are (item_id, axis, expected_outcome, expected, forbidden, cross_cell).
    """
    refuses, asks = F.col("axis").isin(*REFUSAL_AXES), F.col("expected_outcome") != "answered"
    checks = {
        "axis_refuses_but_answer_expected": refuses & ~asks, "axis_answers_but_refusal_expected": ~refuses & asks, "nothing_to_score": ~asks & (F.size("expected") == 0),
        "trap_without_forbidden_paths": (F.col("axis") == "mis_citation") & (F.size("forbidden") == 0), "cross_cell_defeats_item": (F.col("axis") == "cross_domain") & F.col("cross_cell"), "expected_and_forbidden": F.arrays_overlap("expected", "forbidden")}
    name = F.explode(F.array_compact(F.array(*(F.when(test, F.lit(error)) for error, test in checks.items()))))
    wrong = items.select(F.col("item_id").cast("string").alias("item_id"), name.alias("error"))
    twice = items.groupBy(F.col("item_id").cast("string").alias("item_id")).agg(F.count("*").alias("n")).where("n > 1").select("item_id", F.lit("duplicate_id").alias("error"))
    axes = items.sparkSession.createDataFrame([(a,) for a in AXES], "axis string")
    counts = axes.join(items.groupBy("axis").agg(F.count("*").alias("n")), "axis", "left")
    below = counts.where(F.coalesce("n", F.lit(0)) < floor).select(F.col("axis").alias("item_id"), F.lit("below_floor").alias("error"))
    return wrong.unionByName(twice).unionByName(below)


def axis_scores(items: DataFrame) -> DataFrame:
    """Per axis and overall; a review counts as a refusal, an item without an observation as neither."""
    answered = F.col("status") == "answered"
    return items.rollup("axis").agg(
        F.count("*").alias("items"), F.count_if(answered == F.col("should_answer")).alias("as_expected"), F.count_if(F.col("status").isNull()).alias("unobserved"),
        F.coalesce(F.sum(F.when(answered, F.col("n_cites"))), F.lit(0)).alias("citations"), F.coalesce(F.sum(F.when(answered, F.col("n_resolving"))), F.lit(0)).alias("resolving"),
    ).withColumn("axis", F.coalesce("axis", F.lit("overall")))


def hallucination(fabricated: Column, contradicted: Column, answers: Column) -> Column:
    """A lower bound: the larger of two overlapping counts, held to the answers."""
    return F.try_divide(F.least(F.greatest(fabricated, contradicted), answers), answers)


def count_scores(marked: DataFrame, extracted: DataFrame) -> DataFrame:
    both = marked.select("doc_id", F.col("n").alias("a")).join(extracted.select("doc_id", F.col("n").alias("b")), "doc_id")
    shared = F.sum(F.least("a", "b"))
    return both.agg(shared.alias("shared"), F.round(F.try_divide(shared, F.sum("b")), 6).alias("precision"), F.round(F.try_divide(shared, F.sum("a")), 6).alias("recall"))


def drift(one: DataFrame, two: DataFrame) -> DataFrame:
    both = one.select("doc_id", F.col("n").alias("a")).join(two.select("doc_id", F.col("n").alias("b")), "doc_id", "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


def expected_polls(window: Column, age: Column, interval: Column) -> Column:
    return F.floor(F.greatest(F.least(window, age), F.lit(0)) / interval)


def binary_scores(marked: DataFrame, detected: DataFrame) -> DataFrame:
    both = marked.join(detected, "doc_id")
    return both.agg(F.count_if(F.expr("marked AND detected")).alias("tp"), F.count_if(F.expr("NOT marked AND detected")).alias("fp"), F.count_if(F.expr("marked AND NOT detected")).alias("fn"))


def detection_by_version(marked: DataFrame, detected: DataFrame, examples: int = 5) -> DataFrame:
    """version_id, tp, fp, fn, precision, recall, missed, extra: clauses (version_id, path) marked by a person against those detected.

    Never pooled over versions; only versions that someone marked are scored, and a rate without a denominator is null.
    """
    one, two = (rows.select("version_id", "path").distinct().withColumn(name, F.lit(True)) for rows, name in ((marked, "m"), (detected, "d")))
    both = one.join(two.join(one.select("version_id").distinct(), "version_id", "left_semi"), ["version_id", "path"], "full_outer")
    hit, extra, missed = F.expr("m AND d"), F.expr("m IS NULL"), F.expr("d IS NULL")
    first = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.col("path")))), 1, examples)
    by = both.groupBy("version_id").agg(F.count_if(hit).alias("tp"), F.count_if(extra).alias("fp"), F.count_if(missed).alias("fn"), first(missed).alias("missed"), first(extra).alias("extra"))
    rate = lambda other: F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col(other)), 6)
    return by.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))


def extraction_against_markup(sample: DataFrame, marked: DataFrame, extracted: DataFrame, citations: DataFrame, runs: DataFrame) -> DataFrame:
    """version_id, marked, extracted, shared, precision, recall, missed, invented, resolving, regime of each version with a sample.

    ``sample`` (version_id, path) is what was marked blindly; counts (version_id, path, n) outside it say nothing, and a sampled clause
    without a count has none.  Citations (version_id, path, resolves) are all of the version's, and the regime is that of its newest run
    (version_id, run_id, regime), since a markup is blind to one extractor only.
    """
    n = lambda rows, name: rows.groupBy("version_id", "path").agg(F.sum("n").alias(name))
    both = sample.select("version_id", "path").distinct().join(n(marked, "a"), ["version_id", "path"], "left").join(n(extracted, "b"), ["version_id", "path"], "left").fillna(0, ["a", "b"])
    shared = F.sum(F.least("a", "b"))
    by = both.groupBy("version_id").agg(
        F.sum("a").alias("marked"), F.sum("b").alias("extracted"), shared.alias("shared"), F.round(F.try_divide(shared, F.sum("b")), 6).alias("precision"), F.round(F.try_divide(shared, F.sum("a")), 6).alias("recall"),
        F.count_if(F.col("b") < F.col("a")).alias("missed"), F.count_if(F.col("b") > F.col("a")).alias("invented"))
    cited = citations.groupBy("version_id").agg(F.round(F.try_divide(F.count_if("resolves"), F.count("*")), 6).alias("resolving"))
    newest = runs.groupBy("version_id").agg(F.max_by("regime", "run_id").alias("regime"))
    return by.join(cited, "version_id", "left").join(newest, "version_id", "left")


def retained(activity: DataFrame, weeks: int) -> DataFrame:
    """Active in every one of the last ``weeks`` weeks that anyone was active in."""
    active = activity.select("user_id", F.date_trunc("week", "day").alias("week")).distinct()
    last = active.select("week").distinct().orderBy(F.desc("week")).limit(weeks)
    return active.join(last, "week", "left_semi").groupBy("user_id").agg(F.count("*").alias("weeks"), (F.count("*") == weeks).alias("retained"))


def verdicts(gates: DataFrame) -> DataFrame:
    limit = F.create_map(*(x for k, (_, v) in GATES.items() for x in (F.lit(k), F.lit(v))))[F.col("gate")]
    least = F.create_map(*(x for k, (side, _) in GATES.items() for x in (F.lit(k), F.lit(side == "min"))))[F.col("gate")]
    passed = F.when(least, F.col("value") >= limit).otherwise(F.col("value") <= limit)
    return gates.withColumn("verdict", F.when(F.col("value").isNull(), "unmeasured").when(passed, "pass").otherwise("fail"))


def recommendation(judged: DataFrame) -> DataFrame:
    """cell_id, failed, unmeasured, recommendation: gates without a cell (``UNSCOPED``) count against every cell, and anything unmeasured leaves it open."""
    by = judged.where(F.col("cell_id") != UNSCOPED).groupBy("cell_id").agg(F.count_if(F.col("verdict") == "fail").alias("f"), F.count_if(F.col("verdict") == "unmeasured").alias("u"))
    whole = judged.where(F.col("cell_id") == UNSCOPED).agg(F.count_if(F.col("verdict") == "fail").alias("wf"), F.count_if(F.col("verdict") == "unmeasured").alias("wu"))
    # one row, the two counts of the pilot as a whole
    rows = by.withColumn("one", F.lit(1)).join(whole.withColumn("one", F.lit(1)), "one").select("cell_id", (F.col("f") + F.col("wf")).alias("failed"), (F.col("u") + F.col("wu")).alias("unmeasured"))
    return rows.withColumn("recommendation", F.when(F.col("unmeasured") > 0, "INCOMPLETE").when(F.col("failed") >= NO_GO_FAILURES, "NO-GO").otherwise("GO"))


def seeded_order(key: Column, seed: str) -> Column:
    """What a seeded order sorts by."""
    return F.sha2(F.concat_ws("|", key, F.lit(seed)), 256)


def worksheet(answers: DataFrame, items: DataFrame, clauses: DataFrame, seed: str, clip: int = 1200) -> DataFrame:
    """row_id, item_id, claim_index, path, question, claim, clause: a row for each citation of each answered item, to be judged blind.

    Rows are known by the hash that orders them, so the order needs no numbering of all rows; sort by row_id to print.
    """
    cited = answers.where("status = 'answered'").select("item_id", "claims", F.explode("citations").alias("c")).select("item_id", F.col("c.claim_index").alias("claim_index"), F.col("c.path").alias("path"), F.get("claims", F.col("c.claim_index")).alias("claim"))
    row_id = seeded_order(F.concat_ws("|", "item_id", "claim_index", "path"), seed)
    text = shortest_texts(cited.select(F.col("path").alias("suffix")).distinct(), clauses, clip).select(F.col("suffix").alias("path"), F.col("text").alias("clause"))
    return cited.join(items.select("item_id", "question"), "item_id").join(text, "path", "left").select(row_id.alias("row_id"), "item_id", "claim_index", "path", "question", "claim", "clause")


def unjudged(rows: DataFrame) -> DataFrame:
    """Rows of a worksheet read back that are not judged: a blank is an error, not a no."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return rows.where(blank("supports") | blank("contradicts")).select("row_id", "item_id")


def assessment(rows: DataFrame, by: list[str]) -> DataFrame:
    """Of judged citations: how many and which share supports the claim; of answers, counted once: how many contradict."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("citations"), F.round(F.try_divide(F.count_if("supports"), F.count("*")), 6).alias("accuracy"),
        F.countDistinct("item_id").alias("answers"), F.countDistinct(F.when(F.col("contradicts"), F.col("item_id"))).alias("contradicting"))


def rate(part: Column, whole: Column) -> Column:
    """A share to six places; null where there is nothing to share."""
    return F.round(F.try_divide(part, whole), 6)


def time_saving(baseline: Column, measured: Column) -> Column:
    """The share of time saved; negative where more was spent, null without a baseline."""
    return F.round(F.when(baseline > 0, 1 - measured / baseline), 6)


# ---------------------------------------------------------------- reading the corpus


def suffix_matches(wanted: DataFrame, clauses: DataFrame) -> DataFrame:
    """suffix, doc_id, path of the clauses that a cited path names: the same, or one that ends in it behind a slash (an equality join on all tails)."""
    tails = clauses.select("doc_id", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda k: F.array_join(F.slice(F.split("path", "/"), k, F.size(F.split("path", "/"))), "/"))).alias("suffix"))
    return tails.join(wanted.select("suffix").distinct(), "suffix")


def shortest_texts(wanted: DataFrame, clauses: DataFrame, clip: int = 1200) -> DataFrame:
    """suffix, text: of the clauses a path names the one with the shortest path, clipped with a mark."""
    found = suffix_matches(wanted, clauses).join(clauses.select("doc_id", "path", "text"), ["doc_id", "path"]).groupBy("suffix").agg(F.min_by("text", F.struct(F.length("path"), "path", "doc_id")).alias("text"))
    return found.withColumn("text", F.when(F.length("text") > clip, F.concat(F.substring("text", 1, clip), F.lit(" …"))).otherwise(F.col("text")))


def in_force(versions: DataFrame, documents: DataFrame, today: Column) -> DataFrame:
    """title, version_id: the version with the greatest date that has arrived, for each title."""
    arrived = versions.where(F.col("effective_date") <= today).join(documents.select("doc_id", "title"), "doc_id")
    return arrived.groupBy("title").agg(F.max_by("version_id", F.struct("effective_date", "version_id")).alias("version_id"))


ARTICLE_PATH = r"(^|/)제\d+조(의\d+)?$"


def articles(clauses: DataFrame, pattern: str = ARTICLE_PATH) -> DataFrame:
    """Articles of each version in order: version_id, path, article, place."""
    rows = clauses.where(F.col("path").rlike(pattern)).select("doc_id", "version_id", "path", article_of(F.col("path")).alias("article"), "ordinal")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("version_id").orderBy("ordinal")) - 1)


def counts_per_clause(clauses: DataFrame, citations: DataFrame) -> DataFrame:
    """version_id, path, irs (distinct), citations, resolving for every clause that something cites."""
    known = clauses.select("version_id", "path").distinct().withColumn("__held", F.lit(True))
    return citations.join(known, ["version_id", "path"], "left").groupBy("version_id", "path").agg(F.countDistinct("ir_id").alias("irs"), F.count("*").alias("citations"), F.count("__held").alias("resolving"))


def amendment_labels(versions: DataFrame, documents: DataFrame) -> DataFrame:
    """label: ``title @ date`` of amended versions with a date, each once."""
    return versions.where("v > 1 AND effective_date IS NOT NULL").join(documents, "doc_id").select(F.concat("title", F.lit(" @ "), F.col("effective_date").cast("string")).alias("label")).distinct()


def ledger_coverage(ledger: DataFrame, detected: DataFrame) -> DataFrame:
    """label, found of an outside ledger's amendments: whether the system has them; what it has beyond them says nothing."""
    return ledger.select("label").distinct().join(detected.select("label").distinct().withColumn("__found", F.lit(True)), "label", "left").select("label", F.coalesce("__found", F.lit(False)).alias("found"))


def polls_in_window(schedules: DataFrame, observations: DataFrame, since: Column) -> DataFrame:
    """source_id, polls since a time; sources without any are kept with none."""
    n = observations.where(F.col("fetched_at") >= since).groupBy("source_id").agg(F.count("*").alias("polls"))
    return schedules.select("source_id").join(n, "source_id", "left").fillna(0)


def events_by_cell(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("detected_at") > since).groupBy("cell_id").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- golden sets and runs


def spread(rows: DataFrame, by: str, order: list[str], count: int) -> DataFrame:
    """``count`` rows taken in turn from each group: all firsts, then all seconds."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("turn", F.row_number().over(w)).orderBy("turn", by).limit(count)


# How far past the last article a number is that no instrument has, and what a repealed one reads.
MISSING_OFFSETS = (11, 27)
REPEALED = "삭제"


def missing_article_traps(rows: DataFrame) -> DataFrame:
    """doc_id, article: two numbers past the last article of each document with five at least."""
    top = rows.groupBy("doc_id").agg(F.max(F.regexp_extract("article", r"제(\d+)조", 1).cast("int")).alias("top")).where("top >= 5")
    return top.select("doc_id", F.explode(F.array(*(F.concat(F.lit("제"), (F.col("top") + n).cast("string"), F.lit("조")) for n in MISSING_OFFSETS))).alias("article"))


def repealed_traps(rows: DataFrame, clauses: DataFrame) -> DataFrame:
    """version_id, path, forbidden: repealed articles, whose neighbours must not be cited in their place."""
    w = Window.partitionBy("version_id").orderBy("place")
    placed = rows.withColumn("forbidden", F.array_compact(F.array(F.lag("path").over(w), F.lead("path").over(w))))
    gone = clauses.where(F.col("text").contains(REPEALED)).select("version_id", "path")
    return placed.join(gone, ["version_id", "path"], "left_semi").select("version_id", "path", "forbidden")


def cross_domain_items(rows: DataFrame, domains: DataFrame, other: dict[str, str]) -> DataFrame:
    """doc_id, article, asked_in: articles to be asked for in the other domain's cell, where a refusal is right."""
    swap = F.create_map(*(v for pair in other.items() for v in map(F.lit, pair)))
    return rows.join(domains, "doc_id").select("doc_id", "article", swap[F.col("domain")].alias("asked_in"))


def grounding_errors(items: DataFrame, cells: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id, error of items (item_id, cell_id, doc_id, expected, forbidden, notes): documents outside their cell, expected articles that do not exist, and forbidden ones that do, without a note.

    Without a document any document's article will do.
    """
    held = cells.select("cell_id", "doc_id").distinct().withColumn("__in", F.lit(True))
    outside = items.where("doc_id IS NOT NULL").join(held, ["cell_id", "doc_id"], "left").where("__in IS NULL").select("item_id", F.lit("document_outside_cell").alias("error"))
    index = rows.select("doc_id", "article").distinct()
    every = index.unionByName(index.select(F.lit(None).cast(index.schema["doc_id"].dataType).alias("doc_id"), "article").distinct()).withColumn("__held", F.lit(True))

    def named(column: str) -> DataFrame:
        each = items.select("item_id", "doc_id", "notes", F.explode(column).alias("article")).alias("i")
        return each.join(every.alias("k"), F.col("i.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("i.article") == F.col("k.article")), "left").select("item_id", "notes", "__held")

    absent = named("expected").where("__held IS NULL").select("item_id", F.lit("expected_article_missing").alias("error"))
    present = named("forbidden").where("__held AND trim(coalesce(notes, '')) = ''").select("item_id", F.lit("forbidden_article_needs_note").alias("error"))
    return outside.unionByName(absent).unionByName(present).distinct()


def bounded(items: DataFrame, per_axis: int, limit: int | None = None) -> DataFrame:
    """The first items of each axis in the order of their ids, then of all."""
    rows = items.withColumn("__k", F.row_number().over(Window.partitionBy("axis").orderBy("item_id"))).where(F.col("__k") <= per_axis).drop("__k")
    return rows.orderBy("item_id").limit(limit) if limit else rows


def remaining(items: DataFrame, observed: DataFrame) -> DataFrame:
    """Items still to be asked: what a run has an observation without error for is not asked again."""
    return items.join(observed.where("error IS NULL").select("item_id").distinct(), "item_id", "left_anti")


def unresolved_citations(citations: DataFrame, clauses: DataFrame) -> DataFrame:
    """Citations of a run that no clause answers to: the run must not be scored with any."""
    return citations.join(clauses.select("version_id", "path"), ["version_id", "path"], "left_anti")


def blind_sample(clauses: DataFrame, seed: str, n: int) -> DataFrame:
    """A seeded draw without replacement, read in order."""
    return clauses.orderBy(seeded_order(F.concat_ws("|", "version_id", "path"), seed)).limit(n)


def compared_runs(runs: DataFrame) -> DataFrame:
    """subject, newest, before, comparable: the two newest completed runs of each subject; runs of different regimes are not compared."""
    w = Window.partitionBy("subject").orderBy(F.desc("finished_at"), F.desc("run_id"))
    last = runs.where("finished_at IS NOT NULL").withColumn("__k", F.row_number().over(w)).where("__k <= 2")
    pick = lambda c, k: F.max(F.when(F.col("__k") == k, F.col(c)))
    both = last.groupBy("subject").agg(pick("run_id", 1).alias("newest"), pick("run_id", 2).alias("before"), pick("regime", 1).alias("__a"), pick("regime", 2).alias("__b")).where("before IS NOT NULL")
    return both.select("subject", "newest", "before", F.col("__a").eqNullSafe(F.col("__b")).alias("comparable"))


# ---------------------------------------------------------------- gates

UNSCOPED = "-"


def answer_gates(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """cell_id, gate, value: citation accuracy and hallucination of each cell; unmeasured (null) where nothing was judged.

    ``answers`` are (cell_id, item_id, fabricated), ``judged`` rows (cell_id, item_id, supports, contradicts).
    """
    by = answers.groupBy("cell_id").agg(F.count("*").alias("answers"), F.count_if("fabricated").alias("fabricated"))
    seen = assessment(judged, ["cell_id"]).select("cell_id", "accuracy", "contradicting")
    rows = by.join(seen, "cell_id", "left")
    hallucinated = F.when(F.col("contradicting").isNotNull(), F.round(hallucination(F.col("fabricated"), F.col("contradicting"), F.col("answers")), 6))
    return rows.select("cell_id", F.explode(F.create_map(F.lit("citation_accuracy"), F.col("accuracy"), F.lit("hallucination_rate"), hallucinated)).alias("gate", "value"))


def latency_gate(worst: DataFrame) -> DataFrame:
    """cell_id, gate, value from the worst hours of each cell; a cell where nothing could be measured has no value."""
    return worst.select("cell_id", F.lit("detection_latency_hours").alias("gate"), F.when(F.col("measured") > 0, F.col("worst_hours")).alias("value"))


def assembled_gates(*parts: DataFrame) -> DataFrame:
    """All gate rows (cell_id, gate, value) of a report."""
    out = parts[0].select("cell_id", "gate", F.col("value").cast("double").alias("value"))
    for part in parts[1:]:
        out = out.unionByName(part.select("cell_id", "gate", F.col("value").cast("double").alias("value")))
    return out


def guards(answers: DataFrame, alerts: DataFrame, polls: DataFrame) -> DataFrame:
    """guard, value: numbers shown beside the gates that decide nothing: share of answers to be verified, alerts, share of polls made."""
    one = answers.agg(rate(F.count_if(F.col("status") == "needs_verification"), F.count("*")).alias("value")).select(F.lit("needs_verification_rate").alias("guard"), "value")
    two = alerts.agg(F.count("*").cast("double").alias("value")).select(F.lit("alert_volume").alias("guard"), "value")
    three = polls.agg(rate(F.sum(F.least("polls", "expected")), F.sum("expected")).alias("value")).select(F.lit("poll_completion").alias("guard"), "value")
    return one.unionByName(two).unionByName(three)


def rendered_gates(judged: DataFrame) -> DataFrame:
    """cell_id, line: a gate's name, value, threshold and verdict as a report shows them; what is unmeasured is a dash."""
    limit = F.create_map(*(v for k, (_, t) in GATES.items() for v in (F.lit(k), F.lit(t))))[F.col("gate")]
    sign = F.create_map(*(v for k, (side, _) in GATES.items() for v in (F.lit(k), F.lit("≥" if side == "min" else "≤"))))[F.col("gate")]
    hours = F.col("gate").endswith("_hours")
    value = F.when(F.col("value").isNull(), "—").when(hours, F.concat(F.format_string("%.1f", "value"), F.lit("h"))).otherwise(F.concat(F.format_string("%.1f", F.col("value") * 100), F.lit("%")))
    bound = F.concat(sign, F.lit(" "), F.when(hours, F.concat(F.format_string("%.0f", limit), F.lit("h"))).otherwise(F.concat(F.format_string("%.0f", limit * 100), F.lit("%"))))
    return judged.select("cell_id", "gate", F.concat_ws(" | ", "gate", value, bound, F.upper("verdict")).alias("line"))


def may_reseed(golden: DataFrame) -> DataFrame:
    """cell_id, allowed: a signed-off set is never written over."""
    return golden.select("cell_id", (~F.coalesce(F.col("ra_signed_off"), F.lit(False))).alias("allowed"))


def agreement(one: DataFrame, two: DataFrame, sample: DataFrame) -> DataFrame:
    """Over the sample: exact share (a missing mark disagrees), mean absolute difference (it counts as none), and whether the floor is met."""
    a, b = one.select("doc_id", F.col("n").alias("a")), two.select("doc_id", F.col("n").alias("b"))
    both = sample.join(a, "doc_id", "left").join(b, "doc_id", "left")
    none = F.lit(0)
    out = both.agg(F.count("*").alias("n"), rate(F.count_if(F.expr("a = b")), F.count("*")).alias("exact_share"), F.round(F.avg(F.abs(F.coalesce("a", none) - F.coalesce("b", none))), 6).alias("mean_delta"))
    return out.withColumn("agreed", F.col("exact_share") >= AGREEMENT_FLOOR)


def section_lines(lines: DataFrame, title: str) -> DataFrame:
    """Bullets below the last heading, where that is ``title``."""
    head = F.last(F.when(F.col("text").startswith("## "), F.col("text")), ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("ordinal"))
    return lines.withColumn("head", head).where((F.col("head") == f"## {title}") & F.col("text").startswith("- ")).select("doc_id", "ordinal", F.substring("text", 1, 200).alias("line"))
