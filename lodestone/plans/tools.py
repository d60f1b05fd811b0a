"""The tool surface: names, argument bounds and dispatch. A tool is a function of (tables, arguments) to a DataFrame."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arithmetic
from ..operators import placements, retrieval
from ..operators.verify import chart_points, figure_values, validate_charts


class BadArguments(ValueError):
    """Arguments out of a tool's bounds."""


@dataclass
class Corpus:
    """The tables that tools read. embed gives the vector of a question."""

    chunks: DataFrame
    elements: DataFrame
    tables: DataFrame
    captions: DataFrame
    placements: DataFrame
    embed: Callable[[str], list[float]]
    ledger: dict[str, dict] = field(default_factory=dict)


def _k(k: int) -> int:
    if not 1 <= k <= 20:
        raise BadArguments("k must be 1 to 20")
    return k


def _search(kind: str):
    def run(c: Corpus, query: str, k: int = 8) -> DataFrame:
        spark = c.chunks.sparkSession
        q = spark.createDataFrame([(1, query, [float(x) for x in c.embed(query)])], "query_id int, question string, vector array<double>")
        hits = retrieval.hybrid_search(c.chunks, q, _k(k), collection=kind)
        where = retrieval.locations(hits.select("chunk_id", "element_ids"), c.elements)
        return retrieval.shape_hits(hits.join(where, "chunk_id"), kind).orderBy("rank")

    return run


def find_charts(c: Corpus, conditions: list[dict], kind: str = "any", k: int = 8) -> DataFrame:
    if not 1 <= len(conditions) <= 5:
        raise BadArguments("one to five conditions")
    if any(not 1 <= h <= 12 for x in conditions for h in x.get("houses") or ()):
        raise BadArguments("houses are 1 to 12")
    return placements.find_charts(c.placements, conditions, kind, _k(k))


def get_figure(c: Corpus, element_id: str) -> DataFrame:
    """A figure's record; where captions have series and unit, its values by flag. A chunk's id stands for the elements it holds."""
    own = c.elements.where(F.col("element_id") == element_id)
    via = c.elements.join(c.chunks.where(F.col("chunk_id") == element_id).select(F.explode("element_ids").alias("element_id")), "element_id").select(c.elements.columns)
    found = own.union(via).distinct().join(c.captions, "element_id", "left")
    if {"series", "unit"} <= set(c.captions.columns):
        found = found.withColumn("v", figure_values(F.col("series"), F.col("unit") == "%")).select(*found.columns, "v.exact", "v.estimated")
    return found


def make_chart(c: Corpus, chart_type: str, title: str, labels: list[str], series: list[dict], value_refs: dict[str, str], citations: list[str]) -> DataFrame:
    """A chart's data (series, label, value) with its type, whether it is approximate and a footnote of its sources; refused with the
    reasons where a value is not found in the evidence that its reference names. Drawing is for the reader's side."""
    spark = c.chunks.sparkSession
    kind = "chart_id int, question_id int, chart_type string, labels array<string>, series array<struct<name:string,values:array<double>,unit:string>>, value_refs map<string,string>, citations array<string>"
    chart = spark.createDataFrame([(1, 1, chart_type, labels, [(s["name"], [float(v) for v in s["values"]], s.get("unit")) for s in series], value_refs, citations)], kind)
    known = [(1, k, [float(x) for x in e.get("numbers", [])], [float(x) for x in e.get("estimated", [])]) for k, e in c.ledger.items()]
    checked = validate_charts(chart, spark.createDataFrame(known, "question_id int, id string, numbers array<double>, estimated array<double>")).first()
    if not checked["ok"]:
        raise BadArguments("; ".join(checked["errors"]))
    cited = spark.createDataFrame([(x,) for x in citations if not x.startswith(("compute:", "page:"))] or [("",)], "id string")
    notes = [r["note"].removeprefix("Source: ") for r in retrieval.source_note(c.elements, c.chunks, cited).orderBy("source_file").collect()]
    note = "Source: " + "; ".join(notes) if notes else ""
    return chart_points(chart).select("series", "label", "value", F.lit(title).alias("title"), F.lit(checked["chart_type"]).alias("chart_type"), F.lit(checked["approximate"]).alias("approximate"), F.lit(note).alias("footnote"))


def get_table(c: Corpus, element_id: str) -> DataFrame:
    return c.tables.where(F.col("element_id") == element_id)


def view_page(c: Corpus, source_file: str, page: int) -> DataFrame:
    return c.elements.where((F.col("source_file") == source_file) & (F.col("page") == page)).select("element_id", "type", F.substring("text", 1, 3000).alias("text"))


def compute(c: Corpus, expression: str, inputs: dict[str, dict]) -> DataFrame:
    """inputs: name -> {value, source}; each value must be among the numbers of its source in the ledger."""
    for name, ref in inputs.items():
        known = c.ledger.get(ref["source"], {}).get("numbers", [])
        if not any(abs(ref["value"] - n) <= 1e-6 * max(1.0, abs(n)) for n in known):
            raise BadArguments(f"{name}: {ref['value']:g} is not in {ref['source']}")
    value = arithmetic.evaluate(expression, {k: v["value"] for k, v in inputs.items()})
    return c.chunks.sparkSession.createDataFrame([(expression, value)], "expression string, value double")


TOOLS: dict[str, Callable[..., DataFrame]] = {
    "search_text": _search("text"), "search_figures": _search("figure"), "search_tables": _search("table"), "find_charts": find_charts,
    "get_figure": get_figure, "get_table": get_table, "view_page": view_page, "compute": compute, "make_chart": make_chart,
}


def _answer(corpus: Corpus, name: str, arguments: dict, rows: int) -> dict:
    if name not in TOOLS:
        return {"error": f"unknown tool {name}"}
    try:
        found = [r.asDict(True) for r in TOOLS[name](corpus, **arguments).take(rows + 1)]
        return {"rows": found[:rows], **({"more": True} if len(found) > rows else {})}
    except Exception as e:  # a failure is the caller's to read
        return {"error": str(e) if isinstance(e, (BadArguments, arithmetic.ArithmeticError_, TypeError, KeyError)) else f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"}


def dispatch(corpus: Corpus, calls: list[tuple[str, dict]], threads: int = 6, seconds: float = 30.0, rows: int = 1000) -> list[dict]:
    """Runs calls (name, arguments) side by side; an error is a result, in the order of the calls.

    Each call has `seconds` from when it starts; its Spark jobs bear a tag of its own and are cancelled at its bound, so that neither
    the caller nor the cluster goes on with it. A result shows at most `rows` rows and says whether there are more.
    """
    spark = corpus.chunks.sparkSession
    tags = [f"tool-{uuid.uuid4().hex}" for _ in calls]
    began: dict[int, float] = {}
    over: set[int] = set()

    def one(i: int) -> dict:
        began[i] = time.monotonic()
        spark.sparkContext.addJobTag(tags[i])
        try:
            return _answer(corpus, *calls[i], rows)
        finally:
            spark.sparkContext.removeJobTag(tags[i])
            if i in over:  # what it began after it was cancelled
                spark.sparkContext.cancelJobsWithTag(tags[i])

    out: list[dict | None] = [None] * len(calls)
    late = {"error": f"no result in {seconds:g} seconds"}
    pool = ThreadPoolExecutor(max_workers=max(1, min(threads, len(calls))))
    try:
        jobs = {pool.submit(inheritable_thread_target(spark)(one), i): i for i in range(len(calls))}
        last = time.monotonic() + seconds * -(-len(calls) // max(1, threads))  # also for calls that never start behind stuck ones
        while jobs:
            now = time.monotonic()
            ends = [began[i] + seconds for i in jobs.values() if i in began]
            done, _ = wait(jobs, timeout=max(0.0, min([last, *ends]) - now), return_when=FIRST_COMPLETED)
            for j in done:
                out[jobs.pop(j)] = j.result()
            now = time.monotonic()
            for j, i in list(jobs.items()):
                if now >= last or now >= began.get(i, now) + seconds:
                    over.add(i)
                    j.cancel()
                    spark.sparkContext.cancelJobsWithTag(tags[i])
                    out[i] = late
                    del jobs[j]
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out
