"""Verification: the evidence of a question, numbers and charts checked against it, answers checked block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import closest, format_value, found_in
from ..functions.text import numbers_in, strip_ids
from ..session import many


def ledger(results: DataFrame) -> DataFrame:
    """(question_id, id, kind, text, numbers, estimated): results of tools in order of seq; a repeated id keeps its first record,
    but a full record (where results have full) replaces what a search only touched on, the last one staying."""
    full = F.coalesce("full", F.lit(False)) if "full" in results.columns else F.lit(False)
    order = F.struct((~full).cast("int").alias("a"), F.when(full, -F.col("seq")).otherwise(F.col("seq")).alias("b"))
    first = results.groupBy("id", "question_id").agg(F.min_by(F.struct("kind", "text", "estimated"), order).alias("r"))
    return first.select("question_id", "id", "r.kind", "r.text", numbers_in(F.col("r.text")).alias("numbers"), F.coalesce("r.estimated", F.array().cast("array<double>")).alias("estimated"))


def find_numbers(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (claim_id, question_id, value, refs) with id and only_estimated of the first evidence that holds the value; refs null looks everywhere."""
    pair = claims.join(evidence.select("question_id", "id", "numbers", "estimated"), "question_id", "left")
    allowed = F.col("refs").isNull() | F.expr("array_contains(refs, id)")
    exact, rough = found_in(F.col("value"), F.col("numbers")), found_in(F.col("value"), F.col("estimated"))
    hit = pair.where(allowed & (exact | rough)).groupBy("claim_id").agg(F.min_by(F.struct("id", (~exact).alias("only_estimated")), "id").alias("e"))
    return claims.join(hit, "claim_id", "left").select(*[claims[c] for c in claims.columns], F.col("e.id").alias("id"), F.col("e.only_estimated").alias("only_estimated"))


def chart_points(charts: DataFrame) -> DataFrame:
    """(chart_id, question_id, series, unit, label, value, ref) of charts (labels, series array<struct<name,values,unit>>, value_refs map)."""
    s = charts.select("chart_id", "question_id", "labels", "value_refs", F.explode("series").alias("s"))
    p = s.select("chart_id", "question_id", "value_refs", F.col("s.name").alias("series"), F.col("s.unit").alias("unit"), F.explode(F.arrays_zip("labels", F.col("s.values").alias("values"))).alias("z"))
    return p.select("chart_id", "question_id", "series", "unit", F.col("z.labels").alias("label"), F.col("z.values").alias("value"), F.try_element_at("value_refs", F.concat("series", F.lit(":"), F.col("z.labels"))).alias("ref"))


def validate_charts(charts: DataFrame, evidence: DataFrame, most_slices: int = 8) -> DataFrame:
    """(chart_id, ok, chart_type, approximate, errors, n_errors): every value must be found in the evidence that its reference names.

    A chart_id names one chart of its question. A chart is dealt as one row for each id it names, with the points that name it; what the
    evidence lacks is found in that row, and only counts and messages return to the chart. What names no id meets no evidence and is dealt
    by its chart.
    """
    none, n = F.array().cast("array<string>"), F.size("labels")
    shape = F.filter(F.transform("series", lambda s: F.when(F.size(s["values"]) != n, F.concat(F.lit("series "), s["name"], F.lit(" has "), F.size(s["values"]).cast("string"), F.lit(" values for "), n.cast("string"), F.lit(" labels")))), lambda e: e.isNotNull())
    units = F.array_distinct(F.transform("series", lambda s: F.coalesce(s["unit"], F.lit("none"))))
    mixed = F.when(F.size(units) > 1, F.array(F.concat(F.lit("different units on one axis ("), F.array_join(F.array_sort(units), ", "), F.lit(")")))).otherwise(none)
    one = F.get("series", F.lit(0))
    whole = (F.size("series") == 1) & (n <= most_slices) & F.forall(one["values"], lambda v: v >= 0) & (one["unit"] == "%") & (F.abs(F.aggregate(one["values"], F.lit(0.0), lambda a, v: a + v) - 100) <= 1)
    filled = charts.select("question_id", "chart_id", "chart_type", "value_refs", *[F.coalesce(c, F.array().cast(charts.schema[c].dataType)).alias(c) for c in ("labels", "series", "citations")])
    base = filled.withColumn("shape_errors", F.concat(shape, mixed)).withColumn("whole", F.coalesce(whole, F.lit(False)))
    # points in order, none where the shape is wrong: else each series has a value a label, or no values at all
    fits, no_values = F.size("shape_errors") == 0, F.array().cast("array<double>")
    keys = F.flatten(F.transform("series", lambda s: F.when(s["values"].isNull(), none).otherwise(F.transform("labels", lambda x: F.concat_ws(":", s["name"], x)))))
    values = F.flatten(F.transform("series", lambda s: F.coalesce(s["values"], no_values)))
    made = base.withColumn("keys", F.when(fits, keys).otherwise(none)).withColumn("values", F.when(fits, values).otherwise(no_values))
    # references in the order of the points are taken as they are; others are looked up, which reads the map once a point
    looked_up = F.transform("keys", lambda k: F.try_element_at("value_refs", k))
    made = made.withColumn("refs", F.when(F.map_keys("value_refs") == F.col("keys"), F.map_values("value_refs")).otherwise(looked_up))
    dealt = made.select("*", F.posexplode_outer(F.array_distinct(F.concat("refs", "citations"))).alias("pos", "ref"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    own = lambda c: F.filter(c, lambda x, i: F.get("refs", i).eqNullSafe(F.col("ref")))
    # keys, which only messages show, are a column of their own: they are not dealt where none asks for messages
    part = dealt.select(
        "question_id", "chart_id", *[F.when(first, F.col(c)).alias(c) for c in ("chart_type", "shape_errors", "whole")], own("keys").alias("keys"), own("values").alias("values"),
        F.size(F.filter("citations", lambda c: c == F.col("ref"))).alias("cited"), F.col("ref").isNotNull().alias("sourced"), F.coalesce("ref", F.col("chart_id").cast("string")).alias("place"),
    )
    ev = many(evidence.select(F.col("question_id").alias("asked"), "id", "numbers", "estimated"))
    p = part.join(ev, (F.col("question_id") == F.col("asked")) & (F.col("place") == F.col("id")) & F.col("sourced"), "left")
    exact, rough = lambda v: found_in(v, F.col("numbers")), lambda v: found_in(v, F.col("estimated"))
    lacking = lambda v: F.col("numbers").isNull() | ~(exact(v) | rough(v))

    def message(key: Column, value: Column) -> Column:
        hint = closest(value, F.concat("numbers", "estimated"))
        return (
            F.when(~F.col("sourced"), F.concat(F.lit("no source given for "), key))
            .when(F.col("numbers").isNull(), F.concat(key, F.lit(": source "), F.col("place"), F.lit(" was not returned")))
            .when(lacking(value), F.concat(key, F.lit(": value "), format_value(value), F.lit(" not found in "), F.col("place"), F.coalesce(F.concat(F.lit("; closest value there is "), format_value(hint)), F.lit(""))))
        )

    wrong = F.filter(F.zip_with("keys", "values", message), lambda e: e.isNotNull())
    uncited = F.when(F.col("id").isNull(), F.col("cited")).otherwise(0)
    text = lambda c: F.array_sort(F.flatten(F.collect_list(c)))
    g = p.groupBy("chart_id", "question_id").agg(
        F.sum(F.coalesce(F.size("shape_errors"), F.lit(0)) + F.size(F.filter("values", lacking)) + uncited).cast("int").alias("n_errors"), F.max("chart_type").alias("given"), F.bool_or("whole").alias("whole"),
        F.coalesce(F.bool_or(F.exists("values", lambda v: ~exact(v) & rough(v))), F.lit(False)).alias("approximate"), F.flatten(F.collect_list("shape_errors")).alias("shape_errors"), text(wrong).alias("value_errors"),
        text(F.array_repeat(F.concat(F.lit("citation "), "place", F.lit(" was not returned")), uncited)).alias("cite_errors"),
    )
    kind = F.when((F.col("given") == "pie") & (F.col("n_errors") == 0) & ~F.col("whole"), "bar").otherwise(F.col("given"))
    return g.select("chart_id", (F.col("n_errors") == 0).alias("ok"), kind.alias("chart_type"), "approximate", F.concat("shape_errors", "value_errors", "cite_errors").alias("errors"), "n_errors")


def block_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, question_id, n, type, cited) of answers' blocks: array<struct<type, markdown, citations, element_id, chart_id>>."""
    b = answers.select("answer_id", "question_id", "not_found", F.posexplode("blocks").alias("n", "b"))
    return b.select("answer_id", "question_id", "not_found", "n", "b.*")


def validate_answers(answers: DataFrame, evidence: DataFrame, known: DataFrame, elements: DataFrame, charts: DataFrame) -> DataFrame:
    """(answer_id, n, failure): each rule a block breaks. known (id): ids of the corpus; elements (element_id, type); charts (chart_id, question_id, citations)."""
    blocks = block_citations(answers)
    has = blocks.select("answer_id", "question_id", "n", F.explode(F.coalesce("citations", F.array().cast("array<string>"))).alias("cid"))
    of_charts = blocks.where("type = 'chart'").join(charts.select("chart_id", "question_id", F.col("citations").alias("c")), ["chart_id", "question_id"]).select("answer_id", "question_id", "n", F.explode("c").alias("cid")).where(~F.col("cid").startswith("compute:"))
    ids = has.union(of_charts)
    in_ledger = evidence.select("question_id", F.col("id").alias("cid"), F.lit(True).alias("returned"))
    in_corpus = known.select(F.col("id").alias("cid"), F.lit(True).alias("known")).distinct()
    j = ids.join(in_ledger, ["question_id", "cid"], "left").join(in_corpus, "cid", "left")
    why = (
        F.when(F.col("cid").startswith("memory:"), "cites a memory")
        .when(F.col("cid").startswith("compute:"), "cites a computation")
        .when(F.col("returned").isNull(), "cites what no tool returned")
        .when(F.col("known").isNull(), "cites an unknown id")
    )
    bad_ids = j.select("answer_id", "n", F.concat(why, F.lit(": "), F.col("cid")).alias("failure"))
    t = blocks.join(elements.select("element_id", F.col("type").alias("kind")), "element_id", "left").join(charts.select("chart_id", "question_id", F.lit(True).alias("made")), ["chart_id", "question_id"], "left")
    shape = F.array_compact(F.array(
        F.when((F.col("type") == "text") & (F.size(F.coalesce("citations", F.array().cast("array<string>"))) == 0) & ~F.col("not_found"), "text without a citation"),
        F.when((F.col("type") != "text") & F.col("not_found"), "a not-found answer holds only text"),
        F.when((F.col("type") == "image") & ~F.coalesce(F.col("kind").isin("vector_figure", "image", "scanned_page"), F.lit(False)), "not an original figure"),
        F.when((F.col("type") == "table") & ~F.coalesce(F.col("kind") == "table", F.lit(False)), "not a table of the documents"),
        F.when((F.col("type") == "chart") & F.col("made").isNull(), "chart was not made in this question"),
    ))
    bad = t.select("answer_id", "n", F.explode(shape).alias("failure"))
    return bad_ids.where("failure IS NOT NULL").union(bad).distinct()


def drop_failing(answers: DataFrame, failures: DataFrame) -> DataFrame:
    """answers without the blocks that fail, with a notice; one left empty says that nothing could be verified."""
    g = failures.groupBy("answer_id").agg(F.collect_set("n").alias("bad"))
    j = answers.join(g, "answer_id", "left").withColumn("bad", F.coalesce("bad", F.array().cast("array<int>")))
    kept = F.filter("blocks", lambda b, i: ~F.array_contains("bad", i))
    out = j.withColumn("kept", kept).withColumn("notice", F.when(F.size("bad") > 0, F.concat(F.size("bad").cast("string"), F.lit(" part(s) of the answer were removed because their sources could not be verified."))))
    empty = (F.size("kept") == 0) & (F.size("bad") > 0)
    return out.withColumn("not_found", F.col("not_found") | empty).withColumn("blocks", F.col("kept")).drop("kept", "bad")


def sources_in_order(cited: DataFrame) -> DataFrame:
    """(answer_id, source_file, page, passages, place): pages of citations (answer_id, n, pos, source_file, page) in order of first citation."""
    g = cited.groupBy("answer_id", "source_file", "page").agg(F.count("*").alias("passages"), F.min(F.struct("n", "pos")).alias("first"))
    return g.withColumn("place", F.row_number().over(Window.partitionBy("answer_id").orderBy("first", "source_file", "page"))).drop("first")


def hydrate(answers: DataFrame) -> DataFrame:
    """(answer_id, n, text) of text blocks without ids in their prose."""
    return block_citations(answers).where("type = 'text'").select("answer_id", "n", strip_ids(F.col("markdown")).alias("text"))


def window_messages(messages: DataFrame) -> DataFrame:
    """messages (thread_id, turn, role, text, calls): earlier turns keep plain user and assistant text, the last keeps all."""
    last = F.max("turn").over(Window.partitionBy("thread_id"))
    plain = F.col("role").isin("user", "assistant") & (F.coalesce(F.size("calls"), F.lit(0)) <= 0)
    return messages.withColumn("last", last).where((F.col("turn") == F.col("last")) | plain).drop("last")


def close_calls(calls: DataFrame, results: DataFrame) -> DataFrame:
    """results (thread_id, call_id, result) and an error for every call (thread_id, call_id) without one."""
    open_ = calls.select("thread_id", "call_id").join(results, ["thread_id", "call_id"], "left_anti")
    return results.select("thread_id", "call_id", "result").union(open_.select("thread_id", "call_id", F.lit('{"error": "no result"}')))


def resolve_ids(ids: DataFrame, elements: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, source_file, page, element_id, pos) of ids: elements, chunks (their elements in order), and pages as 'page:file:n'."""
    w = ids.select("id").distinct()
    direct = w.join(elements.select(F.col("element_id").alias("id"), "source_file", "page"), "id").select("id", "source_file", "page", F.col("id").alias("element_id"), F.lit(0).alias("pos"))
    each = w.join(chunks.select(F.col("chunk_id").alias("id"), F.posexplode("element_ids").alias("pos", "element_id")), "id")
    via = each.join(elements.select("element_id", "source_file", "page"), "element_id").select("id", "source_file", "page", "element_id", "pos")
    at = w.where(F.col("id").rlike(r"^page:.+:\d+$"))
    pages = at.select("id", F.regexp_extract("id", r"^page:(.+):\d+$", 1).alias("source_file"), F.regexp_extract("id", r":(\d+)$", 1).try_cast("int").alias("page")).join(elements.select("source_file", "page").distinct(), ["source_file", "page"])
    return direct.union(via).union(pages.select("id", "source_file", "page", F.lit(None).cast("string"), F.lit(0)))


def result_ids(result: Column) -> Column:
    """Ids of a search result's hits in their order, from its JSON."""
    return F.coalesce(F.transform(F.from_json(result, "hits array<struct<id:string>>")["hits"], lambda h: h["id"]), F.array().cast("array<string>"))


def next_step(state: DataFrame, most_rounds: int = 4) -> DataFrame:
    """(question_id, step) of states (question_id, rounds, calls, wants_chart, nudged, failures, repaired): tools, nudge, repair, give_up or finish."""
    step = (
        F.when((F.col("calls") > 0) & (F.col("rounds") < most_rounds), "tools").when(F.col("wants_chart") & ~F.col("nudged") & (F.col("rounds") < most_rounds), "nudge")
        .when((F.col("failures") > 0) & ~F.col("repaired"), "repair").when(F.col("failures") > 0, "give_up").otherwise("finish")
    )
    return state.select("question_id", step.alias("step"))


def figure_values(series: Column, percent: Column) -> Column:
    """(exact, estimated): a figure's chart values by flag, of series array<struct<points array<struct<value, flag>>>>; where its unit is
    a percentage each value counts as its fraction too."""
    points = F.flatten(F.transform(F.coalesce(series, F.array().cast("array<struct<points:array<struct<value:double,flag:string>>>>")), lambda s: s["points"]))
    both = lambda v: F.when(percent, F.array(v, F.round(v / 100, 10))).otherwise(F.array(v))
    of = lambda exact: F.flatten(F.transform(F.filter(points, lambda p: (p["flag"] == "exact") == exact), lambda p: both(p["value"])))
    return F.struct(of(True).alias("exact"), of(False).alias("estimated"))
