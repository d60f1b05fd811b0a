"""Evaluation: retrieval and answer metrics, summaries, gates and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import cosine, near_metric
from ..functions.text import is_refusal, numbers_in

# Metrics that must be perfect, and those held against a baseline.
PERFECT = ("chart_numeric", "refusal")
GATED = ("faithfulness", "multimodal_faithfulness", "response_relevancy", "context_precision", "context_recall", "factual_correctness", "tool_call_accuracy", "figure_hit", "citation_accuracy")


def retrieval_scores(ranks: DataFrame) -> DataFrame:
    """(collection, questions, hit5, hit10, mrr10) of ranks (question_id, collection, rank), null for not found; collection null is overall."""
    r = F.when(F.col("rank") <= 10, 1.0 / F.col("rank").cast("double")).otherwise(0.0)
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")), 4)
    g = ranks.withColumn("r", F.coalesce(r, F.lit(0.0))).groupingSets([["collection"], []], "collection")
    return g.agg(F.count("*").alias("questions"), hit(5).alias("hit5"), hit(10).alias("hit10"), F.round(F.avg("r"), 4).alias("mrr10"))


def average_precision(flags: DataFrame) -> DataFrame:
    """(query_id, ap): mean of the precision at each useful place of a ranking (query_id, rank, useful); 0 where none is."""
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    p = flags.withColumn("p", F.sum(F.col("useful").cast("int")).over(run) / F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return p.groupBy("query_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("useful"), F.col("p"))), F.lit(0.0)), 9).alias("ap"))


def chart_numeric(charts: Column, expected: Column, percent: bool = True) -> Column:
    """Share of charts (array of arrays) all of whose values are expected ones, or their hundredths where percentages are; null where nothing is expected."""
    targets = F.concat(expected, F.transform(expected, lambda e: e / 100)) if percent else expected
    right = F.filter(charts, lambda c: F.forall(c, lambda v: F.exists(targets, lambda e: near_metric(v, e))))
    return F.when(F.size(expected) == 0, None).when(F.size(charts) == 0, 0.0).otherwise(F.size(right) / F.size(charts))


def share_found(actual: Column, expected: Column) -> Column:
    """Share of the expected items among the actual ones; null where nothing is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(F.array_distinct(expected), actual)) / F.size(F.array_distinct(expected)))


def citation_accuracy(cited: Column, reference: Column) -> Column:
    """Share of citations (array of id arrays) that touch the reference; null without citations."""
    return F.when(F.size(cited) > 0, F.size(F.filter(cited, lambda c: F.arrays_overlap(c, reference))) / F.size(cited))


def refusal(answerable: Column, not_found: Column, text: Column) -> Column:
    return F.when(answerable, None).otherwise((not_found | is_refusal(text)).cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp + fn > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(0.0)


def judged(verdicts: DataFrame) -> DataFrame:
    """(question_id, faithfulness, recall, precision, f1) from verdict rows (question_id, kind, ok): claim, reference or answer statements."""
    c = lambda kind, ok: F.count_if((F.col("kind") == kind) & (F.col("ok") == ok))
    share = lambda kind: F.when(c(kind, True) + c(kind, False) > 0, F.round(c(kind, True) / (c(kind, True) + c(kind, False)), 4))
    return verdicts.groupBy("question_id").agg(share("claim").alias("faithfulness"), share("reference").alias("recall"), share("answer").alias("precision"), F.round(f1(c("answer", True), c("answer", False), c("reference", False)), 4).alias("f1"))


def context_order(rankings: DataFrame, evidence: DataFrame, most: int = 20) -> DataFrame:
    """(question_id, place, id): evidence (question_id, id, seq) that a search ranked (question_id, search_no, rank, id) first, in its order, then the rest."""
    ranked = rankings.groupBy("question_id", "id").agg(F.min(F.struct("search_no", "rank")).alias("r"))
    j = evidence.where(~F.col("id").startswith("compute:")).join(ranked, ["question_id", "id"], "left")
    order = Window.partitionBy("question_id").orderBy(F.col("r").isNull(), "r", "seq", "id")
    return j.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("question_id", "place", "id")


def metric_means(scores: DataFrame) -> DataFrame:
    """(qtype, metric, mean, n) of scores (question_id, qtype, metric, score), by type and overall (qtype null), nulls left out."""
    s = scores.where("score IS NOT NULL")
    return s.groupingSets([["qtype", "metric"], ["metric"]], "qtype", "metric").agg(F.round(F.avg("score"), 4).alias("mean"), F.count("*").alias("n"))


def order_statistics(values: DataFrame, by: list[str], value: str, place: Column, cells: int = 4096) -> DataFrame:
    """(by, n, pos, a, b): of each group's non-null values the number n, the position pos (`place`, of column n), and the values
    at ranks floor(pos) and the next, held within 1 and n.

    Counts on a grid between a group's ends find the cells that hold the two ranks; only their distinct values are put in order,
    so a group that holds most rows never meets in one task.
    """
    v = values.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    ends = v.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    pos = place
    first = F.greatest(F.lit(1).cast("long"), F.least(F.greatest(F.col("n") - 1, F.lit(1)), F.floor(pos).cast("long")))
    ends = ends.withColumn("pos", pos).withColumn("j", first)
    cell = F.when(F.col("high") > F.col("low"), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * (cells - 1))).otherwise(0).cast("int")

    def meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """An equi-join in which nulls are equal; the columns of the keys are the left's."""
        named = right.withColumnsRenamed({c: f"_{c}" for c in keys})
        cond = F.lit(True)
        for c in keys:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return left.join(named, cond).drop(*[f"_{c}" for c in keys])

    placed = meet(v, ends, by).select(*by, "v", "n", "pos", "j", cell.alias("cell"))
    w = Window.partitionBy(*by).orderBy("cell")
    grid = placed.groupBy(*by, "n", "pos", "j", "cell").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(w))
    wanted = grid.where((F.col("upto") >= F.col("j")) & (F.col("upto") - F.col("c") < F.col("j") + 1)).select(*by, "cell", (F.col("upto") - F.col("c")).alias("before"))
    inner = meet(placed, wanted, [*by, "cell"]).groupBy(*by, "n", "pos", "j", "cell", "before", "v").agg(F.count("*").alias("c"))
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(*by, "cell").orderBy("v"))
    ranked = inner.withColumn("upto", upto)
    at = lambda k: F.min(F.when(F.col("upto") >= k, F.col("v")))
    return ranked.groupBy(*by, "n", "pos", "j").agg(at(F.col("j")).alias("a"), F.coalesce(at(F.least(F.col("j") + 1, F.col("n"))), F.max("v")).alias("b"))


def _between(at: DataFrame) -> Column:
    return F.when(F.col("n") == 1, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("j")))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row: questions, median and exclusive p90 of latency_s, median and total of cost_usd."""
    sums = runs.agg(F.count("*").alias("questions"), F.round(F.sum("cost_usd"), 6).alias("total_cost_usd"))
    n = F.col("n")
    for name, column, place in (("median_latency_s", "latency_s", (n + 1) / 2), ("p90_latency_s", "latency_s", (n + 1) * F.lit(0.9)), ("median_cost_usd", "cost_usd", (n + 1) / 2)):
        one = order_statistics(runs, [], column, place)
        # one row, or none where no value is known
        sums = sums.join(one.select(F.round(_between(one), 6).alias(name)), F.lit(True), "left")
    return sums.select("questions", "median_latency_s", "p90_latency_s", "median_cost_usd", "total_cost_usd")


def p90(values: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, p90) by the exclusive method."""
    at = order_statistics(values, [by], value, (F.col("n") + 1) * F.lit(0.9))
    return at.select(by, "n", F.round(_between(at), 6).alias("p90"))


def gate(now: DataFrame, baseline: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(metric, mean, before, failure) of metrics (metric, mean) that fail: errors, those that must be perfect, drops from the baseline."""
    j = now.select("metric", "mean").join(baseline.select("metric", F.col("mean").alias("before")), "metric", "left")
    why = (
        F.when(F.col("metric") == "run_error", "some questions failed to run")
        .when(F.col("metric").isin(*PERFECT) & (F.col("mean") < 1.0), "must be 1.0")
        .when(F.col("metric").isin(*GATED) & (F.col("mean") < F.col("before") - tolerance), "below the baseline")
    )
    return j.withColumn("failure", why).where("failure IS NOT NULL")


def last_baseline(runs: DataFrame) -> DataFrame:
    """The newest passed run (run_id, started_at, passed, metric, mean)."""
    last = runs.where("passed").agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return runs.join(last, "run_id", "left_semi")


def worst(scores: DataFrame, n: int = 5) -> DataFrame:
    """(question_id, worst): the n questions with the least of three metrics; one that failed to run counts as -1."""
    kinds = ("faithfulness", "factual_correctness", "response_relevancy")
    v = F.when(F.col("metric") == "run_error", -1.0).when(F.col("metric").isin(*kinds), F.col("score"))
    g = scores.groupBy("question_id").agg(F.min(v).alias("worst")).where("worst IS NOT NULL")
    return g.orderBy("worst", "question_id").limit(n)


def spend_cap(costs: DataFrame, cap: float) -> DataFrame:
    """costs (run_id, seq, cost) with spent so far, up to and with the first that reaches the cap."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    s = costs.withColumn("spent", F.round(F.sum("cost").over(w), 6))
    return s.where(F.coalesce(F.col("spent") - F.col("cost"), F.lit(0.0)) < cap - 5e-7)


def stratified(items: DataFrame, n: int, seed: int = 7) -> DataFrame:
    """n items (stratum, id) taken in turn from each stratum, in a seeded order within it."""
    order = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id")
    # no stratum gives more than n: Spark stops numbering there, before rows are sorted
    return items.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= n).orderBy("turn", "stratum", "id").limit(n)


def model_comparison(runs: DataFrame) -> DataFrame:
    """(model, questions, median_cost, median_latency, first_try) of runs (model, cost_usd, latency_ms, result)."""
    return runs.groupBy("model").agg(F.count("*").alias("questions"), F.round(F.median("cost_usd"), 6).alias("median_cost"), F.round(F.median("latency_ms"), 6).alias("median_latency"), F.round(F.avg((F.col("result") == "ok").cast("int")), 4).alias("first_try"))


def paired_bootstrap(pairs: DataFrame, rounds: int = 1000, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: mean difference of pairs (id, a, b), its bootstrap interval and the sign-flip p value.

    Each round weighs every pair by a Poisson(1) count and flips its sign by a seeded hash: one pass of sums by round, no resampled copies.
    """
    d = pairs.select("id", (F.col("b") - F.col("a")).cast("double").alias("d")).where("d IS NOT NULL")
    u = lambda k: (F.shiftrightunsigned(F.xxhash64("id", "round", F.lit(seed + k)), 11).cast("double") + 0.5) / float(1 << 53)
    steps, total = [], 0.36787944117144233
    p = total
    for k in range(1, 12):
        steps.append(total)
        p /= k
        total += p
    weight = sum(((u(0) > c).cast("int") for c in steps[1:]), (u(0) > steps[0]).cast("int"))
    flip = F.when(u(1) < 0.5, -1.0).otherwise(1.0)
    each = d.select("id", "d", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"))
    sums = each.groupBy("round").agg((F.sum(F.col("d") * weight) / F.greatest(F.sum(weight), F.lit(1))).alias("m"), F.avg(F.col("d") * flip).alias("f"))
    whole = d.agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    lo = (1 - level) / 2
    return sums.crossJoin(F.broadcast(whole)).groupBy("mean", "n").agg(F.percentile("m", F.lit(lo)).alias("low"), F.percentile("m", F.lit(1 - lo)).alias("high"), F.avg((F.abs("f") >= F.abs("mean") - 1e-12).cast("int")).alias("p"))


def discordant(pairs: DataFrame) -> DataFrame:
    """One row: pairs (a, b: booleans) right in only one of two runs."""
    return pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))


def error_rates(texts: DataFrame) -> DataFrame:
    """(stage, errors_per_100, error_free) of texts (stage, sentences, errors), and overall (stage null)."""
    return texts.groupingSets([["stage"], []], "stage").agg(F.round(100 * F.sum("errors") / F.sum("sentences"), 4).alias("errors_per_100"), F.round(F.avg((F.col("errors") == 0).cast("int")), 4).alias("error_free"))


def failed_reasons(runs: DataFrame, most: int = 8) -> DataFrame:
    """(question_id, reasons): unsupported claims (claims array<struct<text,ok>>), up to three useless passages, then errors."""
    bad = F.transform(F.filter("claims", lambda c: ~c["ok"]), lambda c: c["text"])
    useless = F.slice(F.transform(F.filter("passages", lambda p: ~p["ok"]), lambda p: p["text"]), 1, 3)
    return runs.select("question_id", F.slice(F.concat(bad, useless, F.coalesce("errors", F.array().cast("array<string>"))), 1, most).alias("reasons"))


def grouping_report(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """Sums and counts of a value over all, and over each of dims, in one pass."""
    return rows.groupingSets([[], *[[d] for d in dims]], *dims).agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))


def draft_pool(elements: DataFrame) -> DataFrame:
    """Elements (element_id, kind, text, cells) rich enough to ask about: text of 80 words, figures of 30 that are not decorative, tables of four numbers."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != ""))
    plain = ~F.lower(F.substring("text", 1, 200)).contains("decorative")
    rich = ((F.col("kind") == "text") & (words >= 80)) | ((F.col("kind") == "figure") & (words >= 30) & plain) | ((F.col("kind") == "table") & (F.size(numbers_in(F.col("cells"))) >= 4))
    return elements.where(F.coalesce(rich, F.lit(False)))


def draft_coverage(items: DataFrame, goals: DataFrame) -> DataFrame:
    """(book, qtype, have, goal) of drafted questions against goals (book, qtype, goal)."""
    have = items.groupBy("book", "qtype").agg(F.count("*").alias("have"))
    return goals.join(have, ["book", "qtype"], "full_outer").select("book", "qtype", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("goal", F.lit(0)).alias("goal"))


def indexed_only(items: DataFrame, indexed: DataFrame) -> DataFrame:
    """Questions (question_id, documents) all of whose documents are indexed (doc_id)."""
    missing = items.select("question_id", F.explode("documents").alias("doc_id")).join(indexed, "doc_id", "left_anti").select("question_id").distinct()
    return items.join(missing, "question_id", "left_anti")


def open_cases(cases: DataFrame, writers: DataFrame, done: DataFrame, most: int = 10_000) -> DataFrame:
    """(case_id, writer) still to judge: every case with every writer, less those that have a judgement.

    Writers (models under test) are counted; one list of them goes with each case, and what is judged is taken off it before it
    becomes rows. More than `most` are refused: the answer would be that many rows a case.
    """
    n = writers.count()
    if n > most:
        raise ValueError(f"{n} writers; at most {most} are compared")
    judged = done.where("judgement IS NOT NULL").groupBy("case_id").agg(F.collect_set("writer").alias("judged"))
    every = F.broadcast(writers.agg(F.collect_list("writer").alias("every")))  # one row
    left = cases.select("case_id").join(judged, "case_id", "left").join(every)
    return left.select("case_id", F.explode(F.filter("every", lambda w: ~F.coalesce(F.array_contains("judged", w), F.lit(False)))).alias("writer"))


def judge_summary(judgements: DataFrame) -> DataFrame:
    """(writer, cases, mean, major_per_case, seconds) of judgements (writer, scores map, errors array<struct<severity>>, seconds)."""
    mean = F.aggregate(F.map_values("scores"), F.lit(0.0), lambda a, v: a + v) / F.size("scores")
    major = F.size(F.filter("errors", lambda e: e["severity"] == "major"))
    return judgements.groupBy("writer").agg(F.count("*").alias("cases"), F.round(F.avg(mean), 4).alias("mean"), F.round(F.avg(major), 4).alias("major_per_case"), F.round(F.median("seconds"), 4).alias("seconds"))


def benchmark_report(rows: DataFrame) -> DataFrame:
    """(grouping, name, answers, error_free, per_answer, per_100) of rows (task, stage, flags, errors, sentences): all, by task, stage and flag, in one pass."""
    tags = F.concat(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("name")), F.struct(F.lit("task").alias("grouping"), F.col("task").alias("name")), F.struct(F.lit("stage").alias("grouping"), F.col("stage").alias("name"))), F.transform("flags", lambda f: F.struct(F.lit("flag").alias("grouping"), f.alias("name"))))
    each = rows.select("errors", "sentences", F.explode(tags).alias("t")).select("errors", "sentences", "t.*")
    return each.groupBy("grouping", "name").agg(F.count("*").alias("answers"), F.round(F.avg((F.col("errors") == 0).cast("int")), 4).alias("error_free"), F.round(F.avg("errors"), 4).alias("per_answer"), F.round(100 * F.sum("errors") / F.sum("sentences"), 4).alias("per_100"))


def error_categories(problems: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(category, n) of problems (problem): the first pattern that matches names it, else other."""
    kind = F.lit("other")
    for name, pattern in reversed(patterns):
        kind = F.when(F.col("problem").rlike(pattern), name).otherwise(kind)
    return problems.groupBy(kind.alias("category")).agg(F.count("*").alias("n"))


def relevancy(questions: DataFrame) -> DataFrame:
    """(question_id, relevancy) of (question_id, vector, generated: array of vectors, noncommittal): mean cosine to the generated
    questions; 0 for an evasive answer, null without generated ones."""
    mean = F.aggregate(F.transform("generated", lambda g: cosine(F.col("vector"), g)), F.lit(0.0), lambda a, v: a + v) / F.size("generated")
    return questions.select("question_id", F.when(F.col("noncommittal"), 0.0).when(F.size("generated") > 0, F.round(mean, 9)).alias("relevancy"))


def reference_sets(items: DataFrame, locations: DataFrame) -> DataFrame:
    """(question_id, reference): each reference id (question_id, reference_ids) itself, the elements it stands for, and their pages as
    'file#pN'; locations (id, element_id, source_file, page)."""
    ids = items.select("question_id", F.explode("reference_ids").alias("id"))
    at = ids.join(locations, "id").select("question_id", F.explode(F.array("element_id", F.concat("source_file", F.lit("#p"), F.col("page").cast("string")))).alias("id"))
    return ids.union(at).where("id IS NOT NULL").groupBy("question_id").agg(F.array_sort(F.collect_set("id")).alias("reference"))


def report_deltas(now: DataFrame, before: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """(metric, mean, before, delta, mark) of metrics (metric, mean) against a baseline's: worse beyond the tolerance, better or even, only for gated metrics."""
    j = now.select("metric", "mean").join(before.select("metric", F.col("mean").alias("before")), "metric", "left")
    gated = F.col("metric").isin(*GATED)
    delta = F.when(gated, F.round(F.col("mean") - F.col("before"), 4))
    return j.select("metric", "mean", F.when(gated, F.col("before")).alias("before"), delta.alias("delta"), F.when(delta < -tolerance, "worse").when(delta >= 0, "better or even").when(delta.isNotNull(), "within tolerance").alias("mark"))


def retry_steps(failures: DataFrame, transient: list[str], attempts: int = 3) -> DataFrame:
    """failures (kind, message, attempt from 1) with step: stop where credit is exhausted, retry after 10 s, then 30 s, where the
    kind passes, else fail."""
    spent = F.coalesce(F.col("message"), F.lit("")).rlike("insufficient_quota|credit_balance_exhausted")
    passing = F.col("kind").isin(transient) & (F.col("attempt") < attempts)
    return failures.withColumn("step", F.when(spent, "stop").when(passing & (F.col("attempt") == 1), "retry after 10 s").when(passing, "retry after 30 s").otherwise("fail"))


def promotable(drafts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(question_id, ok) of drafts (question_id, reference_ids, expected: array of numbers): every expected number is printed in the
    text of one of its references (id, text), to a billionth."""
    printed = drafts.select("question_id", F.explode("reference_ids").alias("id")).join(evidence, "id").groupBy("question_id").agg(F.flatten(F.collect_list(numbers_in(F.col("text")))).alias("printed"))
    j = drafts.join(printed, "question_id", "left").withColumn("printed", F.coalesce("printed", F.array().cast("array<double>")))
    return j.select("question_id", F.forall("expected", lambda e: F.exists("printed", lambda p: F.abs(p - e) <= 1e-9)).alias("ok"))


def parse_report(elements: DataFrame, skips: DataFrame) -> DataFrame:
    """(doc_id, what, n): elements by type and status, and skips by kind, of each document and of all (doc_id null): the rows of a parse report."""
    rows = elements.select("doc_id", F.concat_ws(":", "type", "status").alias("what")).union(skips.select("doc_id", F.concat_ws(":", F.lit("skip"), "kind")))
    return rows.groupingSets([["doc_id", "what"], ["what"]], "doc_id", "what").agg(F.count("*").alias("n"))
