"""Further registered queries: filters, layout, links, checks, text and number functions, state changes, chart facts. Their SQL is written from the rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arithmetic, dates, numeric
from ..functions import text as tx
from ..operators import astro, captions, claims, enrich, evaluation, filters, ingest, memory, ops, reading, render, retrieval, verify
from ..session import new_folder, written
from ..sources import files
from ..sources.versions import Store
from .registry import AS_OF, AUTH, CHUNKS, KEYWORD, ASKED, LOG, MOMENT, SKY, Tables, nearest_second, query

KINDS = ["text", "image", "table", "scanned_page"]
#: Documents as elements of pages.
ELEMENTS = f"""e AS (SELECT doc_id AS element_id, {KINDS!r}[doc_id % 4 + 1] AS type, CASE WHEN doc_id % 5 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 = 0 THEN ' ' ELSE text END AS text,
  source AS source_file, lang AS doc, (doc_id % 7)::INTEGER AS page, md5(text) AS content_hash, (doc_id * 37 % 500)::DOUBLE AS x0, (doc_id * 53 % 700)::DOUBLE AS y0, n_chars FROM documents)"""


def pick(values: list, by) -> F.Column:
    """The value of a fixed list that a number selects."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def elements(t: Tables) -> DataFrame:
    d, c = t.documents, F.col("doc_id")
    x0, y0 = (c * 37 % 500).cast("double"), (c * 53 % 700).cast("double")
    return d.select(
        c.alias("element_id"), pick(KINDS, c).alias("type"), F.when(c % 5 == 0, "skipped").otherwise("ok").alias("status"), F.when(c % 11 == 0, " ").otherwise(F.col("text")).alias("text"), F.col("source").alias("source_file"),
        F.col("lang").alias("doc_id"), (c % 7).cast("int").alias("page"), F.md5("text").alias("content_hash"), F.array(x0, y0, x0 + 100, y0 + 60).alias("bbox"), "n_chars",
    )


@query(
    """SELECT element_id, CASE WHEN status = 'ok' AND trim(text) <> '' AND (type = 'text' OR type = 'scanned_page' AND element_id % 3 = 0) THEN 'text'
  WHEN status = 'ok' AND type IN ('image', 'scanned_page') AND element_id % 3 <> 0 THEN 'figure' WHEN type = 'table' AND element_id % 2 = 0 AND element_id % 10 < 5 THEN 'table' END AS collection FROM e WHERE collection IS NOT NULL""",
    ELEMENTS,
)
def searchable_elements(t: Tables) -> DataFrame:
    e = elements(t)
    return filters.searchable(e, e.where("element_id % 10 < 5"), e.where("element_id % 3 = 0"))


@query("SELECT term, (SELECT count(*) FROM documents WHERE text ILIKE '%' || term || '%') AS n FROM (VALUES ('THE'), ('license'), ('ung'), ('no such term')) v(term)")
def containment_counts(t: Tables) -> DataFrame:
    return filters.containment_counts(t.documents, ["THE", "license", "ung", "no such term"])


@query(
    """SELECT element_id, type FROM e WHERE (type IN ('image', 'scanned_page') AND status = 'ok' OR type = 'table' AND element_id % 3 = 0 AND element_id % 2 = 0 AND element_id % 8 <> 6)
  AND content_hash NOT IN (SELECT content_hash FROM e WHERE element_id % 13 = 0)""",
    ELEMENTS,
)
def bundle_jobs(t: Tables) -> DataFrame:
    e = elements(t)
    jobs = e.withColumn("low_confidence", F.col("element_id") % 3 == 0).withColumn("asset_path", F.when(F.col("element_id") % 8 != 6, "a.png"))
    return filters.bundle_jobs(jobs, e.where("element_id % 13 = 0").select("content_hash").distinct()).select("element_id", "type")


@query("SELECT element_id, CASE WHEN source_file IN ('src0', 'src2') AND type IN ('image', 'scanned_page') THEN 'skipped' ELSE status END AS status, CASE WHEN source_file IN ('src0', 'src2') AND type IN ('image', 'scanned_page') THEN 'owner_excluded_figures' END AS skip_reason FROM e", ELEMENTS)
def owner_exclusion(t: Tables) -> DataFrame:
    e = elements(t).withColumn("skip_reason", F.lit(None).cast("string"))
    return enrich.exclude_figures(e, ["src0", "src2"]).select("element_id", "status", "skip_reason")


@query(
    """SELECT element_id, 'new' AS version, CASE WHEN element_id % 3 = 0 THEN 'needs_review' ELSE 'ok' END AS status FROM e WHERE element_id % 2 = 0 AND element_id % 6 <> 4
UNION ALL SELECT element_id, 'old', 'ok' FROM e WHERE element_id % 5 = 0 AND NOT (element_id % 2 = 0 AND element_id % 6 <> 4)""",
    ELEMENTS,
)
def caption_import(t: Tables) -> DataFrame:
    e = elements(t)
    record = lambda d, v: d.select("element_id", F.when(F.col("element_id") % 6 == 4, "stale").otherwise(F.col("content_hash")).alias("image_hash"), F.lit("ok").alias("status"), F.when(F.col("element_id") % 3 == 0, "low").otherwise("high").alias("confidence"), F.lit(v).alias("version"))
    return captions.import_captions(record(e.where("element_id % 5 = 0"), "old"), record(e.where("element_id % 2 = 0"), "new"), e).select("element_id", "version", "status")


GOLDEN = "g AS (SELECT doc_id AS seq, 'q' || (doc_id % 90) AS question_id, CASE WHEN doc_id % 4 = 0 THEN 'q' || (doc_id * 7 % 97) END AS follows FROM labels)"


def golden(t: Tables) -> DataFrame:
    c = F.col("doc_id")
    name = lambda x: F.concat(F.lit("q"), x.cast("string"))
    return t.labels.select(c.alias("seq"), name(c % 90).alias("question_id"), F.when(c % 4 == 0, name(c * 7 % 97)).alias("follows"))


@query(
    """SELECT question_id, 'repeated id' AS problem FROM g GROUP BY question_id HAVING count(*) > 1 UNION ALL
SELECT question_id, 'follows a later or unknown question' FROM (SELECT a.question_id, min(p.seq) AS p, min(a.seq) AS s FROM g a LEFT JOIN g p ON p.question_id = a.follows WHERE a.follows IS NOT NULL GROUP BY a.question_id) WHERE p IS NULL OR p >= s""",
    GOLDEN,
)
def golden_problems(t: Tables) -> DataFrame:
    return files.golden_problems(golden(t))


@query("SELECT seq, question_id FROM g WHERE question_id IN ('q3', 'q8', 'q16') OR question_id IN (SELECT follows FROM g WHERE question_id IN ('q3', 'q8', 'q16'))", GOLDEN)
def golden_subset(t: Tables) -> DataFrame:
    return files.golden_subset(golden(t), ["q3", "q8", "q16"]).select("seq", "question_id")


@query("SELECT l_orderkey AS question_id FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_partkey % 10 <> 0)")
def indexed_questions(t: Tables) -> DataFrame:
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_list("l_partkey").alias("documents"))
    return evaluation.indexed_only(items, t.part.where("p_partkey % 10 <> 0").select(F.col("p_partkey").alias("doc_id"))).select("question_id")


@query(
    """SELECT source_file, 'Source: ' || source_file || ', p. ' || string_agg(page, ', ' ORDER BY page) AS note FROM (
  SELECT DISTINCT source_file, page FROM e WHERE element_id % 9 = 0 OR element_id IN (SELECT unnest([o_custkey % 200, o_orderkey % 300]) FROM orders WHERE o_orderkey % 50 = 0)) GROUP BY source_file""",
    ELEMENTS,
)
def source_notes(t: Tables) -> DataFrame:
    chunks = t.orders.select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.array(F.col("o_custkey") % 200, F.col("o_orderkey") % 300).alias("element_ids"))
    wanted = elements(t).where("element_id % 9 = 0").select(F.col("element_id").cast("string").alias("id")).union(t.orders.where("o_orderkey % 50 = 0").select(F.concat(F.lit("c"), "o_orderkey")))
    e = elements(t).select(F.col("element_id").cast("string").alias("element_id"), "source_file", "page")
    return retrieval.source_note(e, chunks.withColumn("element_ids", F.col("element_ids").cast("array<string>")), wanted)


@query(
    """SELECT chunk_id, other_id, score FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id, other_id ORDER BY score DESC, element_id) AS k FROM (
  SELECT h.chunk_id, l.other_id, l.score, l.element_id FROM (SELECT o_orderkey AS chunk_id, o_orderkey AS a, o_orderkey + 1 AS b FROM orders) h JOIN (SELECT DISTINCT l_orderkey AS element_id, l_partkey AS other_id, l_discount AS score FROM lineitem) l
    ON l.element_id IN (h.a, h.b) WHERE l.other_id NOT IN (h.a, h.b))) WHERE k = 1"""
)
def attached_items(t: Tables) -> DataFrame:
    hits = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.array("o_orderkey", F.col("o_orderkey") + 1).alias("element_ids"))
    related = t.lineitem.select(F.col("l_orderkey").alias("element_id"), F.col("l_partkey").alias("other_id"), F.lit("t").alias("title"), F.col("l_discount").alias("score")).distinct()
    return retrieval.attach_related(hits, related).select("chunk_id", "other_id", "score")


@query(
    """SELECT query_id, chunk_id, rank FROM (SELECT k.query_id, k.chunk_id, row_number() OVER (PARTITION BY k.query_id ORDER BY length(c.text) DESC, k.rank)::INTEGER AS rank FROM kw_any k JOIN chunks c USING (chunk_id)) WHERE rank <= 5""",
    f"{CHUNKS}, {ASKED}, {KEYWORD}",
)
def reranked(t: Tables) -> DataFrame:
    """Keyword hits in the order of an injected scorer, here the length of the text."""
    hits = retrieval.keyword_topn(t.chunks(), t.questions(), mode="any").join(t.chunks().select("chunk_id", "text"), "chunk_id").withColumn("question", F.lit("q"))

    def longer(question: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype("float64")

    return retrieval.rerank(hits, longer, 5).select("query_id", "chunk_id", "rank")


@query(
    """SELECT query_id, (SELECT count(*) FROM kw_any a WHERE a.query_id = q.query_id)::BIGINT AS n_any, (SELECT count(*) FROM kw_all a WHERE a.query_id = q.query_id)::BIGINT AS n_all FROM q
WHERE (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM kw_any a WHERE a.query_id = q.query_id) IS DISTINCT FROM (SELECT string_agg(chunk_id, ',' ORDER BY rank) FROM kw_all a WHERE a.query_id = q.query_id)""",
    f"{CHUNKS}, {ASKED}, {KEYWORD}",
)
def compared_searches(t: Tables) -> DataFrame:
    a, b = (retrieval.keyword_topn(t.chunks(), t.questions(), mode=m) for m in ("any", "all"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return retrieval.compare_searches(a, b).select("query_id", n("left").alias("n_any"), n("right").alias("n_all"))


@query(
    """SELECT q.query_id, min(k.rank) FILTER (k.chunk_id % 5 = q.query_id % 5) AS rank, coalesce(min(k.rank) FILTER (k.chunk_id % 5 = q.query_id % 5) <= 5, false) AS found FROM q LEFT JOIN kw_any k USING (query_id) GROUP BY q.query_id""",
    f"{CHUNKS}, {ASKED}, {KEYWORD}",
)
def found_ranks(t: Tables) -> DataFrame:
    hits = retrieval.keyword_topn(t.chunks(), t.questions(), mode="any").select("query_id", "rank", F.array(F.col("chunk_id") % 5).alias("element_ids"))
    return retrieval.found_rank(hits, t.questions().select("query_id", F.array(F.col("query_id").cast("long") % 5).alias("expect"))).select("query_id", "rank", "found")


@query(
    """SELECT k.query_id, k.rank, k.chunk_id, left(c.text, 700) AS excerpt, CASE WHEN k.chunk_id % 7 = (k.chunk_id + 1) % 7 THEN '' ELSE least(k.chunk_id % 7, (k.chunk_id + 1) % 7) || ',' || greatest(k.chunk_id % 7, (k.chunk_id + 1) % 7) END AS pages
FROM kw_any k JOIN chunks c USING (chunk_id)""",
    f"{CHUNKS}, {ASKED}, {KEYWORD}",
)
def shaped_hits(t: Tables) -> DataFrame:
    places = F.array(*[F.struct(F.pmod(F.col("chunk_id") + i, F.lit(7)).alias("page")) for i in (1, 0, 1)])
    hits = retrieval.keyword_topn(t.chunks(), t.questions(), mode="any").join(t.chunks().select("chunk_id", "text"), "chunk_id").withColumn("locations", places)
    return retrieval.shape_hits(hits, "figure").withColumn("pages", F.array_join(F.col("pages").cast("array<string>"), ","))


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'Sun in ' || role END AS line FROM conversations")
def placements_line(t: Tables) -> DataFrame:
    head = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\nPlacements: Sun in "), "role", F.lit("\nmore"))).otherwise("\nNo Placements: none")
    return t.conversations.select("conv_id", "turn", tx.first_line_after(F.concat(F.lit("figure"), head), "Placements").alias("line"))


@query("SELECT c_custkey AS case_id, r_name AS writer FROM customer, region WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 5 = r_regionkey AND o_orderstatus = 'F')")
def open_cases(t: Tables) -> DataFrame:
    done = t.orders.join(t.region, F.col("o_orderkey") % 5 == F.col("r_regionkey")).select(F.col("o_custkey").alias("case_id"), F.col("r_name").alias("writer"), F.when(F.col("o_orderstatus") == "F", "good").alias("judgement"))
    return evaluation.open_cases(t.customer.select(F.col("c_custkey").alias("case_id")), t.region.select(F.col("r_name").alias("writer")), done)


@query("SELECT o_orderkey % 40 AS run_id, o_orderpriority AS metric, round(avg(o_totalprice), 4) AS mean FROM orders WHERE o_orderkey % 40 = (SELECT max(o_orderkey % 40) FROM orders WHERE o_orderkey % 40 % 3 = 0) GROUP BY ALL")
def previous_baseline(t: Tables) -> DataFrame:
    run = F.col("o_orderkey") % 40
    runs = t.orders.groupBy(run.alias("run_id"), F.col("o_orderpriority").alias("metric")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean")).withColumn("started_at", F.col("run_id")).withColumn("passed", F.col("run_id") % 3 == 0)
    return evaluation.last_baseline(runs).select("run_id", "metric", "mean")


LINES = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_quantity) AS l_quantity, min(l_tax) AS l_tax, min(l_discount) AS l_discount FROM lineitem GROUP BY ALL)"
BOXES = LINES + ", b AS (SELECT l_orderkey AS page, l_linenumber AS no, (l_partkey % 400)::DOUBLE AS x0, (l_suppkey * 29 % 300)::DOUBLE AS y0, l_quantity AS side, l_linenumber % 2 AS kind, l_tax, l_discount FROM li)"


def lines(t: Tables) -> DataFrame:
    """Lines of orders, one a number: those that repeat one are taken together."""
    # hardly any repeats: rows are dealt as they are, a bounded number a task, for no task gathers the groups of a whole split
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // 250_000))
    return t.lineitem.repartition(tasks, "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_tax", "l_discount")])


def boxes(t: Tables) -> DataFrame:
    x, y, s = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") * 29 % 300).cast("double"), F.col("l_quantity")
    return lines(t).select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("no"), F.array(x, y, x + s, y + s).alias("bbox"), "l_tax", "l_discount")


@query(
    """SELECT a.page, a.no AS a, c.no AS b FROM b a JOIN b c ON a.page = c.page AND a.kind = 0 AND c.kind = 1
WHERE greatest(0, c.x0 - a.x0 - a.side, a.x0 - c.x0 - c.side, c.y0 - a.y0 - a.side, a.y0 - c.y0 - c.side) <= 40""",
    BOXES,
)
def touching_boxes(t: Tables) -> DataFrame:
    b = boxes(t).withColumn("element_id", F.col("no"))
    return ingest.touching(b.where("no % 2 = 0"), b.where("no % 2 = 1"), 40.0).select("page", "a", "b")


@query(
    """SELECT page, no, min(r)::INTEGER AS cluster FROM reach GROUP BY page, no""",
    "RECURSIVE " + BOXES + """, near AS (SELECT a.page, a.no AS u, c.no AS v FROM b a JOIN b c ON a.page = c.page WHERE greatest(0, c.x0 - a.x0 - a.side, a.x0 - c.x0 - c.side, c.y0 - a.y0 - a.side, a.y0 - c.y0 - c.side) <= 12),
reach AS (SELECT page, no, no AS r FROM b UNION SELECT reach.page, reach.no, near.v FROM reach JOIN near ON near.page = reach.page AND near.u = reach.r)""",
)
def drawing_clusters(t: Tables) -> DataFrame:
    return ingest.drawing_clusters(boxes(t).select("doc_id", "page", "no", "bbox")).select("page", "no", "cluster")


@query(
    """SELECT page, cluster, CASE WHEN shapes = 1 AND items <= 30 THEN 'isolated_shape' WHEN shapes < 3 AND items <= 30 THEN 'too_few_shapes' WHEN chars_in > 0 AND plain_in >= 0.5 * chars_in THEN 'text_callout'
  WHEN covered / greatest((x1 - x0) * (y1 - y0), 1) >= 0.3 AND ((chars_at > 0 AND plain_at >= 0.5 * chars_at) OR chars_at >= 100) THEN 'text_callout' ELSE 'keep' END AS kind FROM (
  SELECT g.page, g.cluster, any_value(shapes) AS shapes, any_value(items) AS items, any_value(g.x0) AS x0, any_value(g.y0) AS y0, any_value(g.x1) AS x1, any_value(g.y1) AS y1,
    coalesce(sum(t.chars) FILTER (inside), 0) AS chars_in, coalesce(sum(t.chars) FILTER (inside AND plain), 0) AS plain_in, coalesce(sum(t.chars) FILTER (area > 0), 0) AS chars_at,
    coalesce(sum(t.chars) FILTER (area > 0 AND plain), 0) AS plain_at, coalesce(sum(area), 0) AS covered FROM g LEFT JOIN
    (SELECT g.page, g.cluster, q.chars, q.size >= 9 OR q.mono AS plain, q.cx BETWEEN g.x0 AND g.x1 AND q.cy BETWEEN g.y0 AND g.y1 AS inside,
       greatest(least(g.x1, q.x1) - greatest(g.x0, q.x0), 0) * greatest(least(g.y1, q.y1) - greatest(g.y0, q.y0), 0) AS area FROM g JOIN q ON g.page = q.page) t ON t.page = g.page AND t.cluster = g.cluster GROUP BY g.page, g.cluster)""",
    BOXES + """, g AS (SELECT page, kind AS cluster, count(*) AS shapes, sum((l_tax * 200)::INTEGER) AS items, min(x0) AS x0, min(y0) AS y0, max(x0 + side) AS x1, max(y0 + side) AS y1 FROM b GROUP BY ALL),
q AS (SELECT page, x0 - 20 AS x0, y0 - 5 AS y0, x0 + 60 AS x1, y0 + 30 AS y1, x0 + 20 AS cx, y0 + 12.5 AS cy, (l_discount * 1000)::INTEGER AS chars, 6 + no AS size, no = 5 AS mono FROM b)""",
)
def cluster_kinds(t: Tables) -> DataFrame:
    b = boxes(t)
    clusters = b.select("doc_id", "page", (F.col("no") % 2).alias("cluster"), "bbox", F.round(F.col("l_tax") * 200).cast("int").alias("items"))
    x, y = F.col("bbox")[0], F.col("bbox")[1]
    blocks = b.select("doc_id", "page", F.array(x - 20, y - 5, x + 60, y + 30).alias("bbox"), F.round(F.col("l_discount") * 1000).cast("int").alias("chars"), (6 + F.col("no")).cast("double").alias("size"), (F.col("no") == 5).alias("mono"))
    body = t.spark.createDataFrame([(1, 10.0)], "doc_id int, body_size double")
    return ingest.cluster_kind(clusters, blocks, body).select("page", "cluster", "kind")


@query(
    """SELECT page, no, CASE WHEN side * h >= 0.5 * 60 * 80 THEN 'background' WHEN h <= 2 AND side >= 30 THEN 'rule' WHEN (y0 + h <= 8 OR y0 >= 72) AND greatest(side, h) / greatest(least(side, h), 0.01) > 40 THEN 'margin_line' END AS role
FROM (SELECT page, no, side, CASE WHEN no % 3 = 0 THEN 0.5 ELSE side END AS h, y0 % 80 AS y0 FROM b)""",
    BOXES,
)
def drawing_furniture(t: Tables) -> DataFrame:
    b = boxes(t)
    s, y = F.col("bbox")[2] - F.col("bbox")[0], F.pmod(F.col("bbox")[1], F.lit(80.0))
    d = b.withColumn("bbox", F.array(F.lit(0.0), y, s, y + F.when(F.col("no") % 3 == 0, F.lit(0.5)).otherwise(s)))
    pages = b.select("doc_id", "page", F.lit(60.0).alias("width"), F.lit(80.0).alias("height")).distinct()
    return ingest.drawing_furniture(d, pages).select("page", "no", "role")


@query(
    """SELECT element_id, place FROM (SELECT element_id, row_number() OVER (PARTITION BY doc ORDER BY page, y0, x0, element_id)::INTEGER AS place FROM e)""",
    ELEMENTS,
)
def reading_order(t: Tables) -> DataFrame:
    return ingest.reading_order(elements(t)).select("element_id", "place")


@query(
    """SELECT element_id FROM e a WHERE type = 'text' AND NOT EXISTS (SELECT 1 FROM e r WHERE r.doc = a.doc AND r.page = a.page AND r.type <> 'text' AND a.x0 + 50 BETWEEN r.x0 AND r.x0 + 100 AND a.y0 + 30 BETWEEN r.y0 AND r.y0 + 60)""",
    ELEMENTS,
)
def text_outside_regions(t: Tables) -> DataFrame:
    e = elements(t)
    return ingest.outside(e.where("type = 'text'"), e.where("type <> 'text'")).select("element_id")


PAGE_LINES = LINES + """, f AS (SELECT l_orderkey AS page, l_linenumber AS element_id, (l_partkey % 300)::DOUBLE AS x0, (l_suppkey * 31 % 400)::DOUBLE AS y0 FROM li WHERE l_linenumber <= 2),
n AS (SELECT l_orderkey AS page, l_linenumber AS no, (l_partkey % 300)::DOUBLE AS x0, (l_partkey * 7 % 400)::DOUBLE AS y0, l_linenumber % 3 = 0 AS italic, l_linenumber % 4 = 0 AS bold,
  CASE l_partkey % 4 WHEN 0 THEN 'Figure ' || l_linenumber || ': a part' WHEN 1 THEN 'fig. ' || l_linenumber || '  x' WHEN 2 THEN 'a slanted line of some length' ELSE 'Table ' || l_linenumber END AS said FROM li WHERE l_linenumber > 2)"""


def page_lines(t: Tables) -> tuple[DataFrame, DataFrame]:
    li, n = lines(t), F.col("l_linenumber")
    x, y, z = (F.col("l_partkey") % 300).cast("double"), (F.col("l_suppkey") * 31 % 400).cast("double"), (F.col("l_partkey") * 7 % 400).cast("double")
    number = n.cast("string")
    said = pick(["0", "1", "2", "3"], F.col("l_partkey"))
    said = F.when(said == "0", F.concat(F.lit("Figure "), number, F.lit(": a part"))).when(said == "1", F.concat(F.lit("fig. "), number, F.lit("  x"))).when(said == "2", F.lit("a slanted line of some length")).otherwise(F.concat(F.lit("Table "), number))
    f = li.where("l_linenumber <= 2").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("element_id"), F.array(x, y, x + 120, y + 80).alias("bbox"))
    b = li.where("l_linenumber > 2").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("page"), F.array(x, z, x + 90, z + 10).alias("bbox"), said.alias("text"), (n % 3 == 0).alias("italic"), (n % 4 == 0).alias("bold"))
    return f, b


@query(
    r"""SELECT page || ':' || element_id AS element_id, coalesce(below, above) AS caption FROM (SELECT f.page, f.element_id, min((n.y0, said)) FILTER ((named OR slanted) AND n.y0 - f.y0 - 80 BETWEEN -2 AND 40).said AS below,
  min((-n.y0 - 10, said)) FILTER (named AND f.y0 - n.y0 - 10 BETWEEN -2 AND 40).said AS above FROM f JOIN (SELECT *, regexp_replace(said, '\s+', ' ', 'g') AS s2, regexp_matches(said, '(?i)^(figure|fig\.)\s*[0-9]') AS named, italic AND length(said) >= 20 AS slanted FROM n) n
  ON f.page = n.page AND n.x0 < f.x0 + 120 AND n.x0 + 90 > f.x0 GROUP BY f.page, f.element_id) WHERE caption IS NOT NULL""".replace("min((n.y0, said))", "min({'y': n.y0, 'said': s2})").replace("min((-n.y0 - 10, said))", "min({'y': -n.y0 - 10, 'said': s2})"),
    PAGE_LINES,
)
def figure_captions(t: Tables) -> DataFrame:
    return ingest.nearest_caption(*page_lines(t))


@query(
    r"""SELECT f.page || ':' || f.element_id AS element_id, max({'y': n.y0, 'said': regexp_replace(said, '\s+', ' ', 'g')}).said AS title FROM f JOIN n ON f.page = n.page
WHERE (n.bold OR regexp_matches(said, '(?i)^table\s*[0-9]')) AND f.y0 - n.y0 - 10 BETWEEN 0 AND 40 GROUP BY f.page, f.element_id""",
    PAGE_LINES,
)
def table_titles(t: Tables) -> DataFrame:
    return ingest.table_titles(*page_lines(t))


@query(
    """SELECT doc_id, seq, coalesce(string_agg(title, ' > ' ORDER BY hseq) FILTER (open), '') AS path FROM (
  SELECT r.doc_id, r.seq, h.seq AS hseq, h.title, h.seq IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h k WHERE k.doc_id = r.doc_id AND k.seq > h.seq AND k.seq <= r.seq AND k.level >= h.level) AS open
  FROM r LEFT JOIN h ON h.doc_id = r.doc_id AND h.seq <= r.seq) GROUP BY doc_id, seq""",
    """r AS (SELECT conv_id AS doc_id, turn AS seq, text, CASE WHEN turn % 5 = 1 THEN turn - 1 ELSE turn END AS own, turn % 5 IN (0, 1) AS heading, (turn // 5 * 7) % 3 AS kind FROM conversations),
h AS (SELECT a.doc_id, a.seq, 14 + 2 * a.kind AS level, array_to_string(list_filter(regexp_split_to_array(trim(a.text), '\\s+'), lambda x: x <> ''), ' ') || coalesce(' ' || array_to_string(list_filter(regexp_split_to_array(trim(b.text), '\\s+'), lambda x: x <> ''), ' '), '') AS title
  FROM r a LEFT JOIN r b ON b.doc_id = a.doc_id AND b.seq = a.seq + 1 WHERE a.seq % 5 = 0)""",
)
def section_paths(t: Tables) -> DataFrame:
    """Every fifth turn of a conversation as a heading that wraps onto the next turn."""
    n = F.col("turn")
    size = (14 + 2 * ((F.floor(n / 5) * 7) % 3)).cast("double")
    top = (n * 20).cast("double")
    box = F.array(F.lit(0.0), F.when(n % 5 == 1, top - 10).otherwise(top), F.lit(100.0), F.when(n % 5 == 1, top).otherwise(top + 2))
    b = t.conversations.select(F.col("conv_id").alias("doc_id"), n.alias("seq"), F.lit(1).alias("page"), box.alias("bbox"), "text", size.alias("size"), (n % 5).isin(0, 1).alias("heading"))
    return ingest.section_paths(b).select("doc_id", "seq", F.array_join("section_path", " > ").alias("path"))


@query(
    """SELECT doc_id, page, margin, CASE WHEN margin AND n > 0.5 * pages AND pages >= 3 AND key <> '' THEN 'header_footer' END AS skip_reason, count(*) AS lines FROM (
  SELECT *, count(DISTINCT CASE WHEN margin THEN page END) OVER (PARTITION BY doc_id, key) AS n, count(DISTINCT page) OVER (PARTITION BY doc_id) AS pages FROM (
    SELECT doc_id, page, margin, regexp_replace(lower(trim(regexp_replace(word, '\\s+', ' ', 'g'))), '\\d+', '#', 'g') AS key FROM (
      SELECT conv_id % 20 AS doc_id, turn AS page, turn % 3 <> 0 AS margin, unnest(string_split(text, ' ')) AS word FROM conversations))) GROUP BY ALL"""
)
def dropped_furniture(t: Tables) -> DataFrame:
    """Each word of a turn as a line of its page."""
    lines = t.conversations.select((F.col("conv_id") % 20).alias("doc_id"), F.col("turn").alias("page"), (F.col("turn") % 3 != 0).alias("margin"), F.explode(F.split("text", " ")).alias("text"))
    return ingest.drop_furniture(lines).groupBy("doc_id", "page", "margin", "skip_reason").agg(F.count("*").alias("lines"))


@query("SELECT conv_id, turn, n, (12.0 + turn % 3 >= 13.5 OR role = 'system') AND length(trim(said)) BETWEEN 2 AND 120 AS heading FROM (SELECT *, unnest(string_split(text, '. ')) AS said, unnest(range(len(string_split(text, '. '))))::INTEGER AS n FROM conversations)")
def headings(t: Tables) -> DataFrame:
    """Each sentence of a turn as a line."""
    c = t.conversations.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"\. ")).alias("n", "said"))
    return c.select("conv_id", "turn", "n", ingest.is_heading(12.0 + F.col("turn") % 3, F.lit(12.0), F.col("role") == "system", F.col("said")).alias("heading"))


@query("SELECT page, element_id FROM (SELECT conv_id AS page, turn AS element_id, length(regexp_replace(text, '\\s', '', 'g')) AS n FROM conversations) WHERE n < 50")
def textless_pages(t: Tables) -> DataFrame:
    return ingest.textless_pages(t.conversations.select(F.col("conv_id").alias("page"), F.col("turn").alias("element_id"), "text")).select("page", "element_id")


@query("SELECT page_id AS page, length(html) AS chars, length(html) < 50 AS textless, page_id % 150 > 100 AS vector_heavy FROM pages")
def page_profile(t: Tables) -> DataFrame:
    p = t.pages.select(F.lit(1).alias("doc_id"), F.col("page_id").alias("page"), F.length("html").alias("chars"), F.lit(0).alias("images"), (F.col("page_id") % 150).alias("drawings"), F.lit(0).alias("tables"))
    return ingest.page_profile(p).select("page", "chars", "textless", "vector_heavy")


@query(
    """SELECT element_id, low_confidence FROM (SELECT *, blank OR empty > 0.3 AS low_confidence FROM (SELECT o_custkey AS element_id, count(*) AS n, (SELECT 1) AS one, o_custkey % 4 = 0 OR o_custkey % 6 = 0 AS blank,
  count(*) FILTER (o_orderstatus = 'P') / (2.0 * count(*)) AS empty, bool_or(o_orderstatus <> 'P') OR o_custkey % 4 <> 0 AS two FROM orders GROUP BY o_custkey)) WHERE two AND NOT (low_confidence AND n = 1)"""
)
def table_quality(t: Tables) -> DataFrame:
    """Orders of a customer as a table of two columns: the second has no title, or the first's, for some customers."""
    rows = t.orders.groupBy(F.col("o_custkey").alias("element_id")).agg(F.collect_list(F.array(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.col("o_orderstatus")))).alias("rows"))
    c = F.col("element_id")
    return ingest.table_quality(rows.withColumn("columns", F.array(F.lit("key"), F.when(c % 4 == 0, "").when(c % 6 == 0, "key").otherwise("status")))).select("element_id", "low_confidence")


@query(
    """SELECT 'table' AS kind, page, no FROM b WHERE kind = 0 AND NOT (no = 2 AND EXISTS (SELECT 1 FROM o WHERE o.page = b.page AND o.t = b.no)) UNION ALL
SELECT CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.page = b.page AND o.f = b.no AND o.t <> 2 AND o.area >= 0.5 * b.side * b.side) THEN 'rejected' ELSE 'figure' END, page, no FROM b WHERE kind = 1""",
    BOXES + """, o AS (SELECT a.page, a.no AS t, c.no AS f, greatest(least(a.x0 + a.side, c.x0 + c.side) - greatest(a.x0, c.x0), 0) * greatest(least(a.y0 + a.side, c.y0 + c.side) - greatest(a.y0, c.y0), 0) AS area
  FROM b a JOIN b c ON a.page = c.page AND a.kind = 0 AND c.kind = 1 WHERE area > 0)""",
)
def arbitration(t: Tables) -> DataFrame:
    b = boxes(t).withColumn("element_id", F.concat_ws(":", "page", "no"))
    kept, figures = ingest.arbitrate(b.where("no % 2 = 0").withColumn("low_confidence", F.col("no") == 2), b.where("no % 2 = 1"))
    return kept.select(F.lit("table").alias("kind"), "page", "no").union(figures.select(F.when(F.col("reject_reason").isNotNull(), "rejected").otherwise("figure"), "page", "no"))


@query("SELECT conv_id, turn, string_agg(said, ' ' ORDER BY i) AS text, max(length(said)) AS longest FROM (SELECT conv_id, turn, i, trim(s) AS said FROM (SELECT conv_id, turn, unnest(range(0, len(string_split(text, '. ')))) AS i, unnest(string_split(text, '. ')) AS s FROM conversations)) WHERE said <> '' GROUP BY ALL")
def block_texts(t: Tables) -> DataFrame:
    """Sentences of a turn as lines of one span each; the size is the span's length."""
    lines = F.transform(F.split("text", r"\. "), lambda s: F.array(F.struct(s.alias("text"), F.length(F.trim(s)).cast("double").alias("size"), F.lit(False).alias("bold"))))
    b = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.lit(0).alias("no"), lines.alias("lines"))
    found = ingest.block_text(b).select(F.col("doc_id").alias("conv_id"), F.col("page").alias("turn"), "text")
    longest = t.conversations.select("conv_id", "turn", F.array_max(F.transform(F.split("text", r"\. "), lambda s: F.length(F.trim(s)))).cast("long").alias("longest"))
    return found.join(longest, ["conv_id", "turn"])


@query("SELECT user_id AS element_id, arg_max(event_type, event_id) AS reading FROM events GROUP BY user_id")
def latest_readings(t: Tables) -> DataFrame:
    return ingest.latest(t.events.select(F.col("user_id").alias("element_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("reading"))).select("element_id", "reading")


@query(
    """SELECT conv_id AS doc_id, turn AS page, 'new' AS version, trim(CASE WHEN turn % 4 = 0 THEN ' ' ELSE text END) = '' AS blank FROM conversations WHERE turn % 2 = 0 AND conv_id % 3 <> 0
UNION ALL SELECT conv_id, turn, 'old', trim(text) = '' FROM conversations WHERE NOT (turn % 2 = 0 AND conv_id % 3 <> 0)"""
)
def transcript_import(t: Tables) -> DataFrame:
    c = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    new = c.where("page % 2 = 0").withColumn("text", F.when(F.col("page") % 4 == 0, " ").otherwise(F.col("text"))).withColumn("version", F.lit("new"))
    kept, _ = captions.import_transcripts(c.withColumn("version", F.lit("old")), new, c.where("doc_id % 3 <> 0").select("doc_id").distinct())
    return kept.select("doc_id", "page", "version", "blank")


@query(
    r"""SELECT p_partkey, count(DISTINCT v)::BIGINT AS n, max(v) AS largest FROM (SELECT p_partkey, unnest(list_concat([p_size::DOUBLE], CASE WHEN p_partkey % 3 = 0 THEN [p_size / 2.0, round(p_size / 200.0, 10)] ELSE [] END,
  CASE WHEN p_partkey % 5 = 0 THEN [1.4::DOUBLE, 3] ELSE [] END)) AS v FROM part) GROUP BY p_partkey"""
)
def printed_values(t: Tables) -> DataFrame:
    """Labels of a part: a bare size; for some a percentage, or a title with a number that is none of its values and two with units."""
    size = F.col("p_size").cast("string")
    labels = F.array(F.concat(F.lit("~ "), size, F.lit(" KB")), F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") / 2).cast("string"), F.lit("%"))).otherwise("Chapter 12 of"), F.when(F.col("p_partkey") % 5 == 0, "Temperature 7 fell 1.4 GB of 3x\nnote").otherwise("none"))
    v = t.part.select("p_partkey", captions.printed_values(labels).alias("v"))
    return v.select("p_partkey", F.size("v").cast("long").alias("n"), F.array_max("v").alias("largest"))


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IN (SELECT p.l_quantity FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_returnflag = 'N') THEN 'exact' ELSE 'estimated' END AS flag FROM lineitem l
WHERE EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_returnflag = 'N')"""
)
def checked_values(t: Tables) -> DataFrame:
    li = t.lineitem
    points = li.select(F.col("l_orderkey").alias("element_id"), F.lit("s").alias("series"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("value"), F.when(F.col("l_linenumber") % 2 == 0, "exact").otherwise("estimated").alias("flag"))
    printed = li.groupBy(F.col("l_orderkey").alias("element_id")).agg(F.collect_list(F.when(F.col("l_returnflag") == "N", F.col("l_quantity"))).alias("printed"))
    return captions.check_values(points, printed).select(F.col("element_id").alias("l_orderkey"), F.col("label").alias("l_linenumber"), "flag")


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE user_id END AS user_id FROM events")
def repaired_json(t: Tables) -> DataFrame:
    """Replies with fences, curly quotes and trailing commas, and some that no repair saves."""
    user = F.col("user_id").cast("string")
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("Here:\n```json\n{\"u\": "), user, F.lit(",}\n```"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit("{“u”: "), user, F.lit(", “a”: [1, 2,]}"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("{\"u\": "), user, F.lit("}"))).otherwise("{\"u\": oops")
    return t.events.select("event_id", F.get_json_object(captions.repaired_json(reply), "$.u").cast("long").alias("user_id"))


@query("SELECT count(*) AS jobs, round(avg((event_type <> 'error')::INTEGER), 4) AS validity_rate, round(avg(value), 4) AS seconds_per_job FROM events")
def job_report(t: Tables) -> DataFrame:
    return captions.job_report(t.events.select((F.col("event_type") != "error").alias("valid"), F.col("value").alias("seconds")))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'D-' || (p_size % 30 + 1) WHEN 1 THEN 'D-9' WHEN 2 THEN 'D-10' ELSE 'Rasi' END AS kind FROM part")
def chart_kinds(t: Tables) -> DataFrame:
    title = F.concat(F.lit("chart "), F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("d "), (F.col("p_size") % 30 + 1).cast("string"))).otherwise(pick(["", "of Navamsa", "DASAMSA", "of birth"], F.col("p_partkey"))))
    return t.part.select("p_partkey", captions.chart_kind(title).alias("kind"))


# --- links and search documents

@query(
    """SELECT DISTINCT page, text_id, target_id FROM (SELECT p.page, p.no AS text_id, t.no AS target_id, row_number() OVER (PARTITION BY p.page, p.no ORDER BY CASE WHEN p.below THEN t.y0 ELSE -t.y0 - t.side END, CASE WHEN p.below THEN t.no ELSE -t.no END) AS k
  FROM (SELECT *, no % 4 < 2 AS below FROM b WHERE no > 2) p JOIN b t ON t.page = p.page AND t.no <= 2 AND CASE WHEN p.below THEN t.y0 >= p.y0 + p.side - 1 ELSE t.y0 + t.side <= p.y0 + 1 END) WHERE k = 1""",
    BOXES,
)
def deictic_links(t: Tables) -> DataFrame:
    b = boxes(t)
    p = b.where("no > 2").select("doc_id", "page", F.concat_ws(":", "page", "no").alias("element_id"), "bbox", F.when(F.col("no") % 4 < 2, "see the diagram below for it").otherwise("as the previous table says").alias("text"))
    found = enrich.deictic_links(b.where("no <= 2").select("doc_id", "page", F.col("no").alias("target_id"), "bbox"), p)
    part = lambda i: F.split("text_element_id", ":")[i].cast("long")
    return found.select(part(0).alias("page"), part(1).cast("int").alias("text_id"), "target_id").distinct()


@query(
    """SELECT target_id, text_id, score FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY score DESC, seq) AS k FROM (
  SELECT c.target_id, p.element_id AS text_id, p.seq, round(list_dot_product(c.v, p.v) / sqrt(list_dot_product(c.v, c.v) * list_dot_product(p.v, p.v)) + 0.2 * CASE WHEN contains(lower(p.text), 'the') THEN 0.5 ELSE 0 END, 3) AS score
  FROM (SELECT DISTINCT t.*, p.element_id AS near_id FROM t JOIN p ON p.doc_id = t.doc_id AND (p.page = t.page AND least(abs(p.y0 - t.y0 - 60), abs(t.y0 - p.y0 - 60)) <= 150
      OR p.seq = (SELECT max(seq) FROM p x WHERE x.doc_id = t.doc_id AND x.seq < t.seq) OR p.seq = (SELECT min(seq) FROM p x WHERE x.doc_id = t.doc_id AND x.seq > t.seq) OR p.section = t.section AND abs(p.page - t.page) <= 1)) c
  JOIN p ON p.element_id = c.near_id)) WHERE k = 1 AND score >= 0.1""",
    """d AS (SELECT doc_id AS element_id, source AS doc_id, (doc_id // 40)::INTEGER AS page, doc_id AS seq, (doc_id * 53 % 700)::DOUBLE AS y0, doc_id % 4 AS section, text, embedding::DOUBLE[] AS v FROM documents JOIN embeddings ON vec_id = doc_id),
t AS (SELECT *, element_id AS target_id FROM d WHERE element_id % 6 = 0), p AS (SELECT * FROM d WHERE element_id % 6 <> 0 AND len(regexp_split_to_array(trim(text), '\\s+')) >= 8)""",
)
def related_links(t: Tables) -> DataFrame:
    d = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id"))
    y = (F.col("doc_id") * 53 % 700).cast("double")
    rows = d.select(
        F.col("source").alias("doc_id"), F.floor(F.col("doc_id") / 40).cast("int").alias("page"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("element_id"), F.array(F.lit(0.0), y, F.lit(100.0), y + 60).alias("bbox"),
        F.array((F.col("doc_id") % 4).cast("string")).alias("section"), "text", F.col("embedding").alias("vector"),
    )
    targets = rows.where("element_id % 6 = 0").withColumnRenamed("element_id", "target_id").withColumn("labels", F.array(F.lit("THE"), F.lit("no such label")))
    found = enrich.related_links(targets.drop("text"), rows.where("element_id % 6 <> 0"), least=0.1)
    return found.select("target_id", F.col("text_element_id").alias("text_id"), "score")


@query("SELECT p_partkey AS target_id, CASE WHEN p_partkey % 2 = 0 THEN 'explicit' WHEN p_partkey % 3 = 0 THEN 'deictic' WHEN p_partkey % 5 = 0 THEN 'related' ELSE 'none' END AS method FROM part")
def rule_precedence(t: Tables) -> DataFrame:
    made = lambda n, m: t.part.where(F.col("p_partkey") % n == 0).select(F.col("p_partkey").alias("target_id"), F.lit(m).alias("method"))
    links = enrich.first_rule(made(2, "explicit"), made(3, "deictic"), made(5, "related"))
    rest = enrich.unlinked(t.part.select(F.col("p_partkey").alias("target_id")), links)
    return links.union(rest.select("target_id", F.lit("none").alias("method")))


@query(
    """SELECT p_partkey AS element_id, CASE WHEN p_partkey % 3 = 0 THEN coalesce(replace(p_type, chr(10), ' '), '') WHEN p_partkey % 3 = 1 THEN p_name || chr(10) || p_brand ELSE p_name || chr(10) || 'Figure ' || p_size END AS text,
  CASE WHEN p_partkey % 3 = 0 THEN array_to_string(list_filter(list_distinct([p_type]), lambda x: length(x) >= 4), '|') ELSE p_brand || '|axis' END AS labels FROM part
UNION ALL SELECT s_suppkey + 1000000, s_name || chr(10) || 'amount | id', 'amount' FROM supplier"""
)
def target_texts(t: Tables) -> DataFrame:
    p, k, none = t.part, F.col("p_partkey") % 3, F.lit(None).cast("string")
    figures = p.select(
        F.col("p_partkey").alias("element_id"), F.when(k != 0, F.col("p_name")).alias("short_caption"), F.when(k == 1, F.col("p_brand")).alias("description"),
        F.when(k != 0, F.array(F.concat(F.lit(" "), "p_brand"), F.lit("axis"), F.lit("x1"), F.lit("axis "), F.lit("----"))).alias("visible_text"), F.when(k == 2, F.concat(F.lit("Figure "), F.col("p_size").cast("string"))).alias("caption"), F.when(k == 0, F.col("p_type")).alias("text"),
    )
    tables = t.supplier.select((F.col("s_suppkey") + 1000000).alias("element_id"), F.col("s_name").alias("title"), none.alias("summary"), F.array(F.lit("amount"), F.lit("id")).alias("columns"))
    return enrich.target_texts(figures, tables).withColumn("labels", F.array_join("labels", "|"))


@query(
    """SELECT sha256('m' || chr(10) || '{"title":"' || n_name || '","columns":["a","b"],"rows":[["' || n_nationkey || '","' || n_regionkey || '"],["x","y"]]}') AS key, n_name AS title, 'a | b' AS columns, n_nationkey || ' | ' || n_regionkey || chr(10) || 'x | y' AS rows FROM nation WHERE n_nationkey % 4 <> 0"""
)
def summary_requests(t: Tables) -> DataFrame:
    """Nations as tables of two rows; every fourth has its summary already."""
    tables = t.nation.select(F.col("n_name").alias("title"), F.array(F.lit("a"), F.lit("b")).alias("columns"), F.array(F.array(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")), F.array(F.lit("x"), F.lit("y"))).alias("rows"), "n_nationkey")
    none = t.spark.createDataFrame([], "key string")
    cache = enrich.summary_requests(tables.where("n_nationkey % 4 = 0").drop("n_nationkey"), none, "m").select("key")
    return enrich.summary_requests(tables.drop("n_nationkey").unionAll(tables.drop("n_nationkey")), cache, "m")


@query("SELECT DISTINCT text AS key, length(text)::DOUBLE AS size FROM benchmark WHERE text NOT IN (SELECT text FROM benchmark WHERE item_id % 3 = 0)")
def embedded_misses(t: Tables) -> DataFrame:
    """An injected model, here the length of the text, over the distinct texts that the cache lacks."""
    b = t.benchmark.select(F.col("text").alias("key"), "text", "item_id")
    cache = b.where("item_id % 3 = 0").select("key").distinct()
    return enrich.embed_missing(b.drop("item_id"), cache, lambda texts: [[float(len(x))] for x in texts]).select("key", F.col("vector")[0].alias("size"))


@query(
    """SELECT conv_id, turn, share, CASE WHEN share < 0.5 AND turn % 2 = 0 THEN 'needs_review' WHEN turn % 2 = 0 THEN 'ok' ELSE 'skipped' END AS status FROM (
  SELECT conv_id, turn, round(len(list_filter(seen, lambda x: list_contains(own, x))) / len(seen), 3) AS share FROM (
    SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS own, list_distinct(regexp_extract_all(lower(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '') || ' alpha x2 gamma'), '[a-z0-9]+')) AS seen, text FROM conversations) WHERE text <> '')"""
)
def label_shares(t: Tables) -> DataFrame:
    """What a model reads: the text of the next turn, and three words of which one has a subscript that folds to a plain digit."""
    seen = F.array(F.coalesce(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")), F.lit("ALPHA x₂ gamma"))
    f = t.conversations.select(F.struct("conv_id", "turn").alias("element_id"), "text", seen.alias("visible_text"), F.when(F.col("turn") % 2 == 0, "ok").otherwise("skipped").alias("status"))
    return enrich.label_shares(f).select("element_id.conv_id", "element_id.turn", "share", "status")


# --- text, number and time functions

@query("SELECT event_id, v AS value FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN value WHEN 1 THEN user_id / 100.0::DOUBLE WHEN 2 THEN 0.5 WHEN 3 THEN 16777200.0 END AS v FROM events)")
def chart_cells(t: Tables) -> DataFrame:
    e = F.col("event_id") % 5
    cell = F.when(e == 0, F.concat(F.lit("about "), F.col("value").cast("string"))).when(e == 1, F.concat(F.col("user_id").cast("string"), F.lit(" %"))).when(e == 2, F.lit("x .5 y")).when(e == 3, F.lit("1.67772e+07")).otherwise("none")
    return t.events.select("event_id", tx.chart_cell(cell).alias("value"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') AS slug, left(p_name, 5) AS excerpt, p_size || CASE WHEN p_size % 100 BETWEEN 10 AND 20 THEN 'th' WHEN p_size % 10 = 1 THEN 'st' WHEN p_size % 10 = 2 THEN 'nd' WHEN p_size % 10 = 3 THEN 'rd' ELSE 'th' END AS nth,
  (p_partkey % 360) || '°' || lpad((p_size % 60)::VARCHAR, 2, '0') || chr(39) AS dms FROM part"""
)
def short_forms(t: Tables) -> DataFrame:
    degrees = (F.col("p_partkey") % 360) + (F.col("p_size") % 60) / 60.0
    return t.part.select("p_partkey", tx.slug(F.concat("p_name", F.lit(" -- "), "p_brand")).alias("slug"), tx.excerpt(F.col("p_name"), 5).alias("excerpt"), tx.ordinal(F.col("p_size")).alias("nth"), tx.dms(degrees).alias("dms"))


@query(r"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> ''))::BIGINT AS sentences FROM conversations")
def sentence_counts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.size(tx.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'As [' || (turn % 9 + 1) || '] and passage [2] say.' ELSE 'As and say.' END AS text, CASE WHEN turn % 2 = 0 THEN CASE WHEN turn % 9 = 1 THEN 1 ELSE 2 END ELSE 0 END AS cited FROM conversations"""
)
def resolved_citations(t: Tables) -> DataFrame:
    mark = (F.col("turn") % 9 + 1).cast("string")
    said = F.concat(F.lit("As [P "), mark, F.lit("] and P2 say ."))
    known = F.when(F.col("turn") % 2 == 0, F.array((F.col("turn") % 9 + 1).cast("int"), F.lit(2))).otherwise(F.array().cast("array<int>"))
    r = t.conversations.select("conv_id", "turn", reading.resolve_citations(said, known).alias("r"))
    return r.select("conv_id", "turn", F.regexp_replace("r.text", " +", " ").alias("text"), F.size("r.cited").alias("cited"))


@query(
    r"""SELECT text_id, string_agg(line, chr(10) ORDER BY n) AS text FROM (SELECT *, row_number() OVER (PARTITION BY text_id, key ORDER BY n) AS k FROM (
  SELECT text_id, n, line, lower(regexp_replace(line, '\d+(?:st|nd|rd|th)?', '#', 'g')) AS key FROM (
    SELECT text_id, unnest(range(0, len(lines))) AS n, unnest(lines) AS line FROM (SELECT conv_id AS text_id, list(role || ' ' || turn || 'th' ORDER BY turn) AS lines FROM conversations GROUP BY conv_id)))) WHERE k <= 2 OR trim(line) = '' GROUP BY text_id"""
)
def collapsed_loops(t: Tables) -> DataFrame:
    line = F.struct("turn", F.concat("role", F.lit(" "), F.col("turn").cast("string"), F.lit("th")).alias("x"))
    return reading.collapse_loops(t.conversations.groupBy(F.col("conv_id").alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["x"]), "\n").alias("text")))


@query(
    """SELECT text_id, coalesce(string_agg(line, chr(10) ORDER BY n), '') AS text FROM (SELECT conv_id AS text_id, unnest([turn * 2, turn * 2 + 1]) AS n, unnest(['## ' || role, role || turn]) AS line, unnest([role, role]) AS under FROM conversations) WHERE under <> 'user' GROUP BY text_id
UNION ALL SELECT conv_id, '' FROM conversations GROUP BY conv_id HAVING bool_and(role = 'user')"""
)
def stripped_sections(t: Tables) -> DataFrame:
    line = F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "role", F.col("turn").cast("string")).alias("x"))
    return reading.strip_sections(t.conversations.groupBy(F.col("conv_id").alias("text_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda e: e["x"]), "\n").alias("text")), ["User"])


@query(
    """SELECT user_id, text FROM (SELECT user_id, text, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS k FROM (SELECT user_id, event_id, trim('likes ' || event_type || ' ' || event_id % 3) AS text FROM events WHERE event_id % 7 <> 0) GROUP BY user_id, text) WHERE k <= 5"""
)
def new_statements(t: Tables) -> DataFrame:
    text = F.concat(F.lit("  likes \n"), "event_type", F.lit("  "), (F.col("event_id") % 3).cast("string"), F.when(F.col("event_id") % 7 == 0, " (doc:text:1)").otherwise(""))
    return memory.new_statements(t.events.select("user_id", F.col("event_id").alias("seq"), text.alias("text"))).select("user_id", "text")


@query("SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE round((value + user_id) / 4 - abs(value - 3) * 2, 6) END AS value, CASE WHEN event_id % 6 = 5 THEN 'unknown name c' END AS error FROM events")
def computed(t: Tables) -> DataFrame:
    text = F.when(F.col("event_id") % 6 == 5, "a + c").otherwise("(a + b) / 4 - abs(a - 3) * 2")
    r = t.events.select("event_id", arithmetic.compute(text, F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("user_id").cast("double"))).alias("r"))
    return r.select("event_id", "r.value", "r.error")


@query("SELECT o_orderkey, round((o_custkey * 3::DOUBLE + o_orderkey * 10) / 1e6, 6) AS cost FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 0")
def answer_costs(t: Tables) -> DataFrame:
    priced = F.col("o_orderkey") % 3 != 0
    return t.orders.select("o_orderkey", numeric.cost(F.col("o_custkey"), F.col("o_orderkey"), F.when(priced, 3.0), F.when(priced, 10.0)).alias("cost"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey || CASE WHEN o_custkey % 4 = 0 THEN '' ELSE ['', '.25', '.5', '.75'][o_custkey % 4 + 1] END ELSE '-0.125' END AS shown FROM orders")
def shown_values(t: Tables) -> DataFrame:
    v = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") + (F.col("o_custkey") % 4) / 4).otherwise(F.lit(-0.125))
    return t.orders.select("o_orderkey", numeric.format_value(v).alias("shown"))


@query(
    """SELECT a.page, a.no AS a, c.no AS b, round(greatest(0, c.x0 - a.x0 - a.side, a.x0 - c.x0 - c.side, c.y0 - a.y0 - a.side, a.y0 - c.y0 - c.side), 6) AS gap,
  round(greatest(least(a.x0 + a.side, c.x0 + c.side) - greatest(a.x0, c.x0), 0) * greatest(least(a.y0 + a.side, c.y0 + c.side) - greatest(a.y0, c.y0), 0), 6) AS shared,
  a.x0 + a.side / 2 BETWEEN c.x0 AND c.x0 + c.side AND a.y0 + a.side / 2 BETWEEN c.y0 AND c.y0 + c.side AS inside, round(a.x0 * 2, 6) AS pixel_x FROM b a JOIN b c ON a.page = c.page AND c.no = a.no + 1""",
    BOXES,
)
def box_relations(t: Tables) -> DataFrame:
    b = boxes(t)
    j = b.select("page", F.col("no").alias("a"), F.col("bbox").alias("x")).join(b.select("page", (F.col("no") - 1).alias("a"), F.col("no").alias("b"), F.col("bbox").alias("y")), ["page", "a"])
    x, y = F.col("x"), F.col("y")
    return j.select("page", "a", "b", F.round(numeric.box_gap(x, y), 6).alias("gap"), F.round(numeric.box_overlap(x, y), 6).alias("shared"), numeric.center_in(x, y).alias("inside"), F.round(numeric.to_pixels(x, 144.0)[0], 6).alias("pixel_x"))


@query(
    """SELECT event_id, date_trunc('day', ts + INTERVAL 330 MINUTE) - INTERVAL 330 MINUTE AS midnight, date_trunc('day', ts + INTERVAL 330 MINUTE) + INTERVAL 1110 MINUTE AS reset, ts - INTERVAL 90 MINUTE AS utc,
  (2024 - (1960 + event_id % 60) - CASE WHEN month(ts) * 100 + day(ts) < ((event_id % 12) + 1) * 100 + 15 THEN 1 ELSE 0 END)::INTEGER AS age FROM events"""
)
def local_times(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    birth = F.make_date((1960 + F.col("event_id") % 60).cast("int"), (F.col("event_id") % 12 + 1).cast("int"), F.lit(15))
    naive = lambda c: c.cast("timestamp_ntz")
    return t.events.select("event_id", naive(dates.local_midnight(ts, "+05:30")).alias("midnight"), naive(dates.next_reset(ts, "+05:30")).alias("reset"), naive(dates.utc_of(ts, F.lit("UTC+01:30"))).alias("utc"), dates.age_years(birth, F.col("ts")).alias("age"))


@query("SELECT c_custkey, CASE WHEN age < 14 THEN 'child' WHEN age < 25 THEN 'young person' WHEN age < 60 THEN 'adult' ELSE 'elder' END AS stage FROM (SELECT c_custkey, c_custkey % 90 AS age FROM customer)")
def life_stages(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", dates.life_stage(F.col("c_custkey") % 90).alias("stage"))


SESSIONS = "s AS (SELECT event_id, ts AS last_seen_at, ts + to_days((event_id % 9)::INTEGER) AS expires_at, CASE WHEN event_id % 5 = 0 THEN ts + INTERVAL 1 HOUR END AS revoked_at FROM events)"


def sessions(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.select("event_id", F.col("ts").alias("last_seen_at"), (F.col("ts") + F.make_dt_interval(days=(e % 9).cast("int"))).alias("expires_at"), F.when(e % 5 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("revoked_at"))


@query(f"SELECT event_id FROM s WHERE revoked_at IS NULL AND expires_at > {MOMENT} AND last_seen_at > {MOMENT} - INTERVAL 5 DAY", SESSIONS)
def live_sessions(t: Tables) -> DataFrame:
    return ops.live_sessions(sessions(t), AS_OF, idle_minutes=5 * 24 * 60).select("event_id")


@query(f"SELECT event_id FROM s WHERE NOT coalesce(least(expires_at, coalesce(revoked_at, expires_at)) < {MOMENT} - INTERVAL 10 DAY, false)", SESSIONS)
def kept_sessions(t: Tables) -> DataFrame:
    return ops.retention({"sessions": sessions(t)}, AS_OF, {"sessions": 10})["sessions"].select("event_id")


@query("SELECT c_custkey || '@' || c_mktsegment AS email, CASE WHEN length(pw) < 12 THEN 'too short' WHEN pw IN ('Password12345', 'letmeinplease') THEN 'too common' WHEN contains(lower(pw), c_custkey::VARCHAR) THEN 'contains the email name' END AS problem FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN 'Password12345' WHEN 1 THEN 'short' WHEN 2 THEN 'x-very-long-' || c_custkey ELSE 'x-very-long-secret' END AS pw FROM customer)")
def password_problems(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pw = F.when(k % 4 == 0, "Password12345").when(k % 4 == 1, "short").when(k % 4 == 2, F.concat(F.lit("x-very-long-"), k.cast("string"))).otherwise("x-very-long-secret")
    common = t.spark.createDataFrame([("PASSWORD12345",), ("letmeinplease",)], "password string")
    return ops.password_problems(t.customer.select(F.concat(k.cast("string"), F.lit("@"), "c_mktsegment").alias("email"), pw.alias("password")), common)


@query("SELECT event_id, created_at, event_type, coalesce(c_name, 'tried' || event_id) AS email, ip FROM auth LEFT JOIN customer ON c_custkey = user_id AND user_id % 2 = 0 ORDER BY created_at DESC, event_id DESC LIMIT 50", AUTH)
def recent_events(t: Tables) -> DataFrame:
    auth = t.auth().withColumn("email_attempted", F.concat(F.lit("tried"), F.col("event_id").cast("string")))
    return ops.recent_events(auth, t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("email")))


@query(f"SELECT c_name AS email, c_mktsegment AS status, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-31' + to_days((c_custkey % 5 - 2)::INTEGER) > {MOMENT} END AS locked FROM customer")
def listed_users(t: Tables) -> DataFrame:
    until = F.when(F.col("c_custkey") % 3 != 0, F.lit("2024-01-31").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 5 - 2).cast("int")))
    users = t.customer.select(F.col("c_name").alias("email"), F.col("c_mktsegment").alias("status"), until.alias("locked_until"), F.lit(1).alias("created_at"))
    return ops.list_users(users, AS_OF).drop("created_at")


# --- memory and documents

NOTES = "n AS (SELECT user_id, event_type AS kind, (event_id % 4)::VARCHAR AS subject, 't' || event_id AS text, ts AS moment FROM events)"


def notes(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_type").alias("kind"), (F.col("event_id") % 4).cast("string").alias("subject"), F.concat(F.lit("t"), F.col("event_id").cast("string")).alias("text"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), "event_id")


@query("SELECT user_id, kind, subject, arg_max(text, (moment, text)) AS text, min(moment) AS created_at, max(moment) AS updated_at FROM n GROUP BY user_id, kind, subject", NOTES)
def remembered(t: Tables) -> DataFrame:
    n = notes(t)
    return memory.remember(n.where("event_id % 3 = 0").drop("event_id"), n.where("event_id % 3 <> 0").drop("event_id"))


@query(f"SELECT user_id, text FROM n WHERE moment >= {MOMENT} - INTERVAL 9 DAY AND user_id <> 2 AND NOT (user_id = 1 AND kind = 'click' AND subject = '2')", NOTES)
def forgotten(t: Tables) -> DataFrame:
    """All of one user's memories go, one subject of another's, and what is older than nine days."""
    n = memory.forget(notes(t), AS_OF, 9)
    keys = t.spark.createDataFrame([("click", "2")], "kind string, subject string")
    return memory.delete(memory.delete(n, 2), 1, keys).select("user_id", "text")


@query("SELECT kind, subject, text FROM n WHERE user_id = 1", NOTES)
def listed_memories(t: Tables) -> DataFrame:
    return memory.listed(notes(t), 1).select("kind", "subject", "text")


@query("SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def cascade_delete(t: Tables) -> DataFrame:
    left = files.remove_documents({"documents": t.documents, "labels": t.labels}, t.documents.where("doc_id % 3 = 0").select("doc_id"))
    count = lambda k: left[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n")
    return count("documents").union(count("labels"))


# --- verification

RESULTS = "r AS (SELECT l_orderkey AS question_id, 'p' || (l_partkey % 5) AS id, 'table' AS kind, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey % 10000 AS place, l_linenumber, l_quantity FROM lineitem), led AS (SELECT question_id, id, arg_min(l_quantity, place) AS q, arg_min(l_linenumber, place) AS seq FROM r GROUP BY ALL)"


def results(t: Tables) -> DataFrame:
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" units and "), F.col("l_linenumber").cast("string"), F.lit("%"))
    return t.lineitem.select(F.col("l_orderkey").alias("question_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("id"), F.lit("table").alias("kind"), text.alias("text"), F.lit(None).cast("array<double>").alias("estimated"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey") * 10000 + F.col("l_suppkey") % 10000).alias("seq"))


@query("SELECT question_id, id, q::INTEGER || ' units and ' || seq || '%' AS text, greatest(q, seq) AS largest FROM led", RESULTS)
def evidence_ledger(t: Tables) -> DataFrame:
    return verify.ledger(results(t)).select("question_id", "id", "text", F.array_max("numbers").alias("largest"))


@query("SELECT c.question_id, c.claim, (SELECT min(id) FROM led WHERE led.question_id = c.question_id AND (abs(c.value - q) <= 1e-6 * greatest(1, abs(q)) OR abs(c.value - seq) <= 1e-6 * greatest(1, seq) OR abs(c.value - seq / 100.0) <= 1e-6)) AS id FROM (SELECT DISTINCT l_orderkey AS question_id, l_linenumber AS claim, l_quantity AS value FROM lineitem) c", RESULTS)
def found_numbers(t: Tables) -> DataFrame:
    claims = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_quantity").alias("claim_id"), F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").alias("claim"), F.col("l_quantity").alias("value"), F.lit(None).cast("array<string>").alias("refs")).distinct()
    return verify.find_numbers(claims, verify.ledger(results(t))).select("question_id", "claim", "id")


@query("SELECT l_orderkey, arg_min(l_quantity, (abs(l_quantity - total), l_quantity))::DOUBLE AS closest FROM lineitem JOIN (SELECT l_orderkey, sum(l_quantity) / 4 AS total FROM lineitem GROUP BY ALL) USING (l_orderkey) GROUP BY l_orderkey")
def closest_values(t: Tables) -> DataFrame:
    own = t.lineitem.groupBy("l_orderkey").agg((F.sum("l_quantity") / 4).alias("total"), F.collect_set(F.col("l_quantity").cast("double")).alias("numbers"))  # the numbers of one order
    return own.select("l_orderkey", numeric.closest(F.col("total"), F.col("numbers")).alias("closest"))


TURNS = """a AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, role, 'c:' || conv_id || ':' || (turn + 1) AS cid FROM conversations), known AS (SELECT 'c:' || conv_id || ':' || turn AS id FROM conversations),
bad AS (SELECT answer_id, 'cites what no tool returned: ' || cid AS failure FROM a WHERE cid NOT IN (SELECT id FROM known) OR cid IN (SELECT id FROM known WHERE id LIKE '%0')
  UNION ALL SELECT answer_id, 'a not-found answer holds only text' FROM a WHERE role = 'system' UNION ALL SELECT answer_id, 'not a table of the documents' FROM a WHERE role <> 'assistant')"""


def answers(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(answers, failures): each turn as an answer that cites the next turn of its conversation; ids that end in 0 were not returned."""
    c = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), "conv_id", "turn", "text", "role")
    cite = F.array(F.concat(F.lit("c:"), F.col("conv_id").cast("string"), F.lit(":"), (F.col("turn") + 1).cast("string")))
    block = F.struct(F.when(F.col("role") == "assistant", "text").otherwise("table").alias("type"), F.col("text").alias("markdown"), cite.alias("citations"), F.lit(None).cast("string").alias("element_id"), F.lit(None).cast("string").alias("chart_id"))
    made = c.select("answer_id", F.lit(1).alias("question_id"), (F.col("role") == "system").alias("not_found"), F.array(block).alias("blocks"))
    ids = c.select(F.concat(F.lit("c:"), F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("id"))
    evidence = ids.where("id NOT LIKE '%0'").select(F.lit(1).alias("question_id"), "id")
    charts = t.spark.createDataFrame([], "chart_id string, question_id int, citations array<string>")
    return made, verify.validate_answers(made, evidence, ids, t.spark.createDataFrame([], "element_id string, type string"), charts)


@query("SELECT DISTINCT answer_id, failure FROM bad", TURNS)
def answer_failures(t: Tables) -> DataFrame:
    return answers(t)[1].select("answer_id", "failure")


@query("SELECT answer_id, CASE WHEN answer_id IN (SELECT answer_id FROM bad) THEN 0 ELSE 1 END AS blocks, role = 'system' OR answer_id IN (SELECT answer_id FROM bad) AS not_found FROM a", TURNS)
def repaired_answers(t: Tables) -> DataFrame:
    return verify.drop_failing(*answers(t)).select("answer_id", F.size("blocks").alias("blocks"), "not_found")


@query("SELECT conv_id * 1000 + turn AS answer_id, 0 AS n, regexp_replace(text, ' +([.,;:])', '\\1', 'g') AS text FROM conversations WHERE role = 'assistant'")
def hydrated_texts(t: Tables) -> DataFrame:
    made, _ = answers(t)
    noted = made.withColumn("blocks", F.transform("blocks", lambda b: F.struct(b["type"].alias("type"), F.concat(b["markdown"], F.lit(" (ids: d:text:1; e:f:2)")).alias("markdown"), b["citations"].alias("citations"), b["element_id"].alias("element_id"), b["chart_id"].alias("chart_id"))))
    return verify.hydrate(noted).select("answer_id", "n", "text")


@query("SELECT answer_id, source_file, page, passages, row_number() OVER (PARTITION BY answer_id ORDER BY n, source_file, page)::INTEGER AS place FROM (SELECT l_orderkey AS answer_id, 'f' || l_suppkey % 3 AS source_file, l_partkey % 4 AS page, count(*) AS passages, min(l_linenumber) AS n FROM lineitem GROUP BY ALL)")
def cited_sources(t: Tables) -> DataFrame:
    return verify.sources_in_order(t.lineitem.select(F.col("l_orderkey").alias("answer_id"), F.col("l_linenumber").alias("n"), F.lit(0).alias("pos"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("source_file"), (F.col("l_partkey") % 4).alias("page")))


@query(
    """SELECT DISTINCT id, source_file, page, element_id, pos FROM (SELECT e.element_id::VARCHAR AS id, source_file, page, e.element_id::VARCHAR AS element_id, 0 AS pos FROM e WHERE element_id % 4 = 0
UNION ALL SELECT 'c' || o_orderkey, source_file, page, e.element_id::VARCHAR, i FROM (SELECT o_orderkey, unnest([0, 1]) AS i, unnest([o_custkey % 200, o_orderkey % 300]) AS x FROM orders WHERE o_orderkey % 7 = 0) JOIN e ON e.element_id = x
UNION ALL SELECT DISTINCT 'page:' || source_file || ':3', source_file, page, NULL, 0 FROM e WHERE page = 3)""",
    ELEMENTS,
)
def resolved_ids(t: Tables) -> DataFrame:
    e = elements(t).select(F.col("element_id").cast("string").alias("element_id"), "source_file", "page")
    chunks = t.orders.select(F.concat(F.lit("c"), "o_orderkey").alias("chunk_id"), F.array(F.col("o_custkey") % 200, F.col("o_orderkey") % 300).cast("array<string>").alias("element_ids"))
    ids = e.where("CAST(element_id AS INT) % 4 = 0").select(F.col("element_id").alias("id")).union(t.orders.where("o_orderkey % 7 = 0").select(F.concat(F.lit("c"), "o_orderkey"))).union(e.select(F.concat(F.lit("page:"), "source_file", F.lit(":3")))).union(t.region.select(F.lit("unknown")))
    return verify.resolve_ids(ids, e, chunks).distinct()


@query("SELECT conv_id AS thread_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations) WHERE turn = last OR (role IN ('user', 'assistant') AND turn % 3 <> 0)")
def message_windows(t: Tables) -> DataFrame:
    m = t.conversations.select(F.col("conv_id").alias("thread_id"), "turn", "role", "text", F.when(F.col("turn") % 3 == 0, F.array(F.lit("call"))).alias("calls"))
    return verify.window_messages(m).select("thread_id", "turn", "role")


@query("SELECT conv_id AS thread_id, turn AS call_id, CASE WHEN role = 'system' THEN '{\"error\": \"no result\"}' ELSE 'r' || turn END AS result FROM conversations")
def closed_calls(t: Tables) -> DataFrame:
    c = t.conversations.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("call_id"), "role")
    return verify.close_calls(c, c.where("role <> 'system'").select("thread_id", "call_id", F.concat(F.lit("r"), F.col("call_id").cast("string")).alias("result")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'd:' || o_custkey || ' d:' || o_orderkey END AS ids FROM orders")
def search_result_ids(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 4 == 0, "{\"error\": 1}").otherwise(F.format_string('{"hits": [{"id": "d:%d", "x": 1}, {"id": "d:%d"}]}', "o_custkey", "o_orderkey"))
    return t.orders.select("o_orderkey", F.array_join(verify.result_ids(text), " ").alias("ids"))


@query("SELECT o_orderkey AS question_id, CASE WHEN calls > 0 AND rounds < 4 THEN 'tools' WHEN wants AND NOT nudged AND rounds < 4 THEN 'nudge' WHEN failures > 0 AND NOT repaired THEN 'repair' WHEN failures > 0 THEN 'give_up' ELSE 'finish' END AS step FROM (SELECT o_orderkey, o_orderkey % 6 AS rounds, o_custkey % 3 AS calls, o_orderkey % 5 = 0 AS wants, o_custkey % 2 = 0 AS nudged, o_custkey % 4 AS failures, o_orderkey % 7 < 3 AS repaired FROM orders)")
def next_steps(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return verify.next_step(t.orders.select(k.alias("question_id"), (k % 6).alias("rounds"), (c % 3).alias("calls"), (k % 5 == 0).alias("wants_chart"), (c % 2 == 0).alias("nudged"), (c % 4).alias("failures"), (k % 7 < 3).alias("repaired")))


# --- evaluation

@query("SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN NULL ELSE round(count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R' AND l_suppkey % 2 = 0) / count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R')::DOUBLE, 6) END AS share FROM lineitem GROUP BY l_orderkey")
def shares_found(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey"))).alias("actual"), F.collect_list(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("expected"))
    return g.select("l_orderkey", F.round(evaluation.share_found(F.col("actual"), F.col("expected")), 6).alias("share"))


@query("SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS only_a, count(*) FILTER (quality = 0 AND toxic = 1) AS only_b FROM labels")
def discordant_pairs(t: Tables) -> DataFrame:
    return evaluation.discordant(t.labels.select((F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b")))


@query("SELECT event_type AS stage, round(100.0 * sum(event_id % 3) / sum(user_id), 4) AS errors_per_100, round(avg((event_id % 3 = 0)::INTEGER), 4) AS error_free FROM events GROUP BY GROUPING SETS ((event_type), ())")
def error_rates(t: Tables) -> DataFrame:
    return evaluation.error_rates(t.events.select(F.col("event_type").alias("stage"), F.col("user_id").alias("sentences"), (F.col("event_id") % 3).alias("errors")))


@query(
    """SELECT o_custkey AS question_id, CASE WHEN ct + cf > 0 THEN round(ct / (ct + cf), 4) END AS faithfulness, CASE WHEN rt + rf > 0 THEN round(rt / (rt + rf), 4) END AS recall, CASE WHEN ac + af > 0 THEN round(ac / (ac + af), 4) END AS precision,
  CASE WHEN ac + af + rf > 0 THEN round(2.0 * ac / (2.0 * ac + af + rf), 4) ELSE 0 END AS f1 FROM (SELECT o_custkey, count(*) FILTER (k = 0 AND ok)::DOUBLE AS ct, count(*) FILTER (k = 0 AND NOT ok)::DOUBLE AS cf, count(*) FILTER (k = 1 AND ok)::DOUBLE AS rt, count(*) FILTER (k = 1 AND NOT ok)::DOUBLE AS rf,
    count(*) FILTER (k = 2 AND ok)::DOUBLE AS ac, count(*) FILTER (k = 2 AND NOT ok)::DOUBLE AS af FROM (SELECT o_custkey, o_orderkey % 3 AS k, o_orderstatus <> 'F' AS ok FROM orders) GROUP BY o_custkey)"""
)
def judged_metrics(t: Tables) -> DataFrame:
    v = t.orders.select(F.col("o_custkey").alias("question_id"), pick(["claim", "reference", "answer"], F.col("o_orderkey")).alias("kind"), (F.col("o_orderstatus") != "F").alias("ok"))
    return evaluation.judged(v)


@query("SELECT event_type AS writer, count(*) AS cases, round(avg((user_id % 5 + event_id % 7) / 2.0), 4) AS mean, round(avg((event_id % 4 = 0)::INTEGER + (event_id % 6 = 0)::INTEGER), 4) AS major_per_case, round(median(value), 4) AS seconds FROM events GROUP BY event_type")
def judge_summary(t: Tables) -> DataFrame:
    e = F.col("event_id")
    scores = F.create_map(F.lit("a"), (F.col("user_id") % 5).cast("double"), F.lit("b"), (e % 7).cast("double"))
    errors = F.array(*[F.struct(F.when(e % n == 0, "major").otherwise("minor").alias("severity")) for n in (4, 6)])
    return evaluation.judge_summary(t.events.select(F.col("event_type").alias("writer"), scores.alias("scores"), errors.alias("errors"), F.col("value").alias("seconds")))


@query(
    """SELECT l_orderkey AS question_id, array_to_string((coalesce(list(l_linenumber::VARCHAR ORDER BY l_linenumber) FILTER (l_returnflag = 'R'), []) || (coalesce(list('p' || l_linenumber ORDER BY l_linenumber) FILTER (l_linestatus = 'F'), []))[1:3] || ['late'])[1:8], ' ') AS reasons FROM lineitem GROUP BY l_orderkey"""
)
def failed_reasons(t: Tables) -> DataFrame:
    entry = lambda text, ok: F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), text.alias("text"), ok.alias("ok"))))
    number = F.col("l_linenumber").cast("string")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(entry(number, F.col("l_returnflag") != "R").alias("claims"), entry(F.concat(F.lit("p"), number), F.col("l_linestatus") != "F").alias("passages"))
    return evaluation.failed_reasons(g.withColumn("errors", F.array(F.lit("late")))).withColumn("reasons", F.array_join("reasons", " "))


@query(
    """SELECT 'flag' AS grouping, flag AS name, count(*) AS answers, round(avg((errors = 0)::INTEGER), 4) AS error_free, round(avg(errors), 4) AS per_answer, round(100.0 * sum(errors) / sum(sentences), 4) AS per_100 FROM (SELECT *, unnest(flags) AS flag FROM x) GROUP BY flag
UNION ALL SELECT CASE WHEN GROUPING(task) = 0 THEN 'task' WHEN GROUPING(stage) = 0 THEN 'stage' ELSE 'all' END, coalesce(task, stage, 'all'), count(*), round(avg((errors = 0)::INTEGER), 4), round(avg(errors), 4), round(100.0 * sum(errors) / sum(sentences), 4) FROM x GROUP BY GROUPING SETS ((task), (stage), ())""",
    "x AS (SELECT event_type AS task, 's' || user_id % 3 AS stage, CASE WHEN event_id % 2 = 0 THEN ['even', 'f' || event_id % 5] ELSE []::VARCHAR[] END AS flags, event_id % 3 AS errors, user_id + 4 AS sentences FROM events)",
)
def benchmark_report(t: Tables) -> DataFrame:
    e = F.col("event_id")
    flags = F.when(e % 2 == 0, F.array(F.lit("even"), F.concat(F.lit("f"), (e % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    return evaluation.benchmark_report(t.events.select(F.col("event_type").alias("task"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("stage"), flags.alias("flags"), (e % 3).alias("errors"), (F.col("user_id") + 4).alias("sentences")))


@query("SELECT CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence' WHEN regexp_matches(text, '[0-9]') THEN 'number' ELSE 'other' END AS category, count(*) AS n FROM documents GROUP BY ALL")
def error_categories(t: Tables) -> DataFrame:
    return evaluation.error_categories(t.documents.select(F.col("text").alias("problem")), [("licence", "(?i)license"), ("number", "[0-9]")])


@query(
    """SELECT book, qtype, coalesce(have, 0) AS have, coalesce(goal, 0) AS goal FROM (SELECT source AS book, lang AS qtype, count(*) AS have FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL) FULL JOIN (SELECT DISTINCT source AS book, lang AS qtype, 5 AS goal FROM documents WHERE lang <> 'fr') USING (book, qtype)"""
)
def draft_coverage(t: Tables) -> DataFrame:
    d = t.documents.select(F.col("source").alias("book"), F.col("lang").alias("qtype"), "doc_id")
    return evaluation.draft_coverage(d.where("doc_id % 3 = 0"), d.where("qtype <> 'fr'").select("book", "qtype", F.lit(5).alias("goal")).distinct())


@query(
    r"""SELECT element_id, kind FROM (SELECT doc_id AS element_id, ['text', 'figure', 'table'][doc_id % 3 + 1] AS kind, text, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words FROM documents)
WHERE (kind = 'text' AND words >= 80) OR (kind = 'figure' AND words >= 30 AND NOT contains(lower(left(text, 200)), 'the ')) OR (kind = 'table' AND element_id % 2 = 0)"""
)
def draft_pool(t: Tables) -> DataFrame:
    """Documents as elements; a table's cells hold four numbers or three, and a figure that begins with "the " counts as decorative here."""
    text = F.regexp_replace("text", "(?i)the ", "decorative ")
    d = t.documents.select(F.col("doc_id").alias("element_id"), pick(["text", "figure", "table"], F.col("doc_id")).alias("kind"), "text", F.when(F.col("doc_id") % 2 == 0, "1 2 3 4").otherwise("1 2 3").alias("cells"))
    early = F.contains(F.lower(F.substring("text", 1, 200)), F.lit("the "))
    shown = d.withColumn("text", F.when((F.col("kind") == "figure") & early, F.concat(F.lit("decorative "), text)).otherwise(F.col("text")))
    return evaluation.draft_pool(shown).select("element_id", "kind")


# --- chart facts

@query("SELECT a.body AS reference, b.body, ((b.sign_no - a.sign_no + 12) % 12 + 1)::INTEGER AS house, count(*) AS charts FROM s a JOIN s b USING (chart_id) WHERE a.body <> b.body GROUP BY ALL", SKY)
def counted_houses(t: Tables) -> DataFrame:
    return reading.counted_from(astro.placements(t.charts())).groupBy("reference", "body", "house").agg(F.count("*").alias("charts"))


@query("SELECT chart_id, house, ['Mars', 'Venus', 'Mercury', 'Moon', 'Sun', 'Mercury', 'Venus', 'Mars', 'Jupiter', 'Saturn', 'Saturn', 'Jupiter'][(sign_no + house - 1) % 12 + 1] AS lord FROM s, range(1, 13) r(house) WHERE body = 'Lagna'", SKY)
def house_lords(t: Tables) -> DataFrame:
    return astro.lordships(astro.placements(t.skies()))


@query(
    """SELECT chart_id, kind, count(*) AS n, count(DISTINCT answer) AS answers FROM (SELECT chart_id, unnest(['house', 'sign', 'combust']) AS kind, unnest([house::VARCHAR, sign_no::VARCHAR, CASE WHEN combust THEN 'yes' ELSE 'no' END]) AS answer FROM (
  SELECT *, coalesce(abs((lon - sun + 540) - 360 * floor((lon - sun + 540) / 360) - 180) <= CASE body WHEN 'Moon' THEN 12 WHEN 'Mars' THEN 17 WHEN 'Mercury' THEN 14 WHEN 'Jupiter' THEN 11 WHEN 'Venus' THEN 10 WHEN 'Saturn' THEN 15 END, false) AS combust FROM h)) GROUP BY ALL""",
    SKY,
)
def lookup_answers(t: Tables) -> DataFrame:
    kinds = ["house", "sign", "combust"]
    return reading.answers_by_kind(reading.lookups(t.skies(), kinds), kinds)


@query(
    """SELECT l_orderkey, l_linenumber, 23.250182778 - 0.004658035 + (5029.0966 * t + 1.11113 * t * t - 0.000006 * t * t * t - (5029.0966 * z + 1.11113 * z * z - 0.000006 * z * z * z)) / 3600 AS exact, n - 360 * floor(n / 360) AS node
FROM (SELECT *, 125.0445479 - 1934.1362891 * t + 0.0020754 * t * t + t * t * t / 467441 - t * t * t * t / 60616000 AS n, (2435553.5 - 2451545.0) / 36525 AS z FROM (SELECT l_orderkey, l_linenumber, (2451545.0::DOUBLE + l_partkey - 2451545.0) / 36525 AS t FROM lineitem))""".replace("AS exact", "AS value").replace("SELECT l_orderkey, l_linenumber, 23", "SELECT l_orderkey, l_linenumber, round(v, 6) AS ayanamsa, round(node, 6) AS node FROM (SELECT l_orderkey, l_linenumber, 23").replace("AS value", "AS v") + ")"
)
def sky_constants(t: Tables) -> DataFrame:
    jd = F.lit(2451545.0) + F.col("l_partkey")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(astro.ayanamsa(jd), 6).alias("ayanamsa"), F.round(astro.mean_node(jd), 6).alias("node"))


@query(
    """SELECT chart_id, text FROM (SELECT chart_id, body, house, body || ' in the ' || house || CASE WHEN house IN (1) THEN 'st' WHEN house = 2 THEN 'nd' WHEN house = 3 THEN 'rd' ELSE 'th' END || ' house' AS text FROM h WHERE body IN ('Sun', 'Mars')) WHERE body = 'Sun'""",
    SKY,
)
def fact_lines(t: Tables) -> DataFrame:
    facts = reading.chart_facts(astro.placements(t.skies())).select("chart_id", F.explode(F.split("facts", "\n")).alias("line")).where("line LIKE 'Sun in %'")
    house = F.regexp_extract("line", r", (\d+\w\w) house", 1)
    return facts.select("chart_id", F.concat(F.lit("Sun in the "), house, F.lit(" house")).alias("text"))


@query("SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN turn % 2 = 0 THEN 'personal' END, CASE WHEN turn % 3 = 0 THEN 'career' END, CASE WHEN turn % 5 = 0 THEN 'death' END], lambda x: x IS NOT NULL), ',') AS kinds FROM conversations")
def question_kinds(t: Tables) -> DataFrame:
    n = F.col("turn")
    said = F.concat(F.lit("Tell"), F.when(n % 2 == 0, " me my way").otherwise(" them"), F.when(n % 3 == 0, " about a job").otherwise(""), F.when(n % 5 == 0, " and longevity.").otherwise("."))
    return t.conversations.select("conv_id", "turn", F.array_join(reading.question_kinds(said), ",").alias("kinds"))


@query(
    """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INTEGER AS rank FROM (
  SELECT q.query_id, c.chunk_id, round(0.1::DOUBLE * len(list_filter(range(1, len(w)), lambda i: w[i] = a AND w[i + 1] = b)), 9) AS score FROM (
    SELECT query_id, w[1] AS a, w[2] AS b, w[3] AS x FROM (SELECT query_id, regexp_extract_all(lower(question), '[a-z0-9]+') AS w FROM q) WHERE len(w) >= 3) q
  JOIN (SELECT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks) c
  ON list_contains(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), a || ' ' || b) AND NOT list_contains(w, x) AND x NOT IN (a, b)) QUALIFY rank <= 20""",
    f"{CHUNKS}, {ASKED}",
)
def websearch_phrases(t: Tables) -> DataFrame:
    """The first two words of each item as a phrase, without texts that hold the third; plain words only, as stems have no form in SQL."""
    w = F.regexp_extract_all(F.lower("question"), F.lit("[a-z0-9]+"), F.lit(0))
    q = t.questions().withColumn("w", w).where((F.size("w") >= 3) & ~F.expr("w[2] IN (w[0], w[1])"))
    asked = q.select("query_id", F.concat(F.lit('"'), F.col("w")[0], F.lit(" "), F.col("w")[1], F.lit('" -'), F.col("w")[2]).alias("question"))
    return retrieval.websearch_topn(t.chunks(), asked, stems=False)


#: Between the numbers of two searches of one item; items are numbered below it.
SEARCHES = 1 << 32


def asked_by_threes(questions: DataFrame) -> DataFrame:
    """(query_id, item_id, word, question, vector): every three words of questions (query_id, question, vector) as a search, the first of them OR the phrase of the others.

    word: where the three begin. The search that begins a question keeps its number. A question without words is one search, by its vector alone.
    """
    words = F.coalesce(F.split("question", r"\s+"), F.array(F.lit("")))
    threes = F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(3)), lambda i: F.slice("words", i + 1, 3))
    each = questions.withColumn("words", words).select(F.col("query_id").alias("item_id"), "vector", F.posexplode(threes).alias("k", "three"))
    said = F.when(F.size("three") == 1, F.col("three")[0]).otherwise(F.concat(F.col("three")[0], F.lit(" OR \""), F.array_join(F.slice("three", 2, 2), " "), F.lit("\"")))
    return each.select((F.col("item_id") + F.col("k") * SEARCHES).alias("query_id"), "item_id", (F.col("k") * 3).alias("word"), said.alias("question"), "vector")


@query()
def hybrid_websearch(t: Tables) -> DataFrame:
    """Hybrid search with all words of each item, three a search, in web-search syntax, by stems or plain words; held against brute force in the tests."""
    found = retrieval.hybrid_search(t.chunks(), asked_by_threes(t.questions()), mode="websearch")
    item, word = F.pmod("query_id", F.lit(SEARCHES)), (F.shiftright("query_id", 32) * 3).cast("int")
    return found.select("query_id", "chunk_id", "score", "rank", "semantic_rank", "keyword_rank", item.alias("item_id"), word.alias("word"))


# --- reports, log, restore, sign-ins

@query(
    """SELECT doc, what, count(*) AS n FROM (SELECT doc, type || ':' || status AS what FROM e UNION ALL SELECT doc, 'skip:k' || element_id % 3 FROM e WHERE status = 'skipped') GROUP BY GROUPING SETS ((doc, what), (what))""",
    ELEMENTS,
)
def parse_report(t: Tables) -> DataFrame:
    e = elements(t)
    skips = e.where("status = 'skipped'").select("doc_id", F.concat(F.lit("k"), (F.col("element_id") % 3).cast("string")).alias("kind"))
    return evaluation.parse_report(e, skips).withColumnRenamed("doc_id", "doc")


@query(
    """SELECT trace_id, model, cost_usd FROM (SELECT event_id AS trace_id, event_type AS model, 1.0::DOUBLE AS cost_usd FROM events WHERE event_id % 2 = 0
UNION ALL SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN NULL ELSE round((event_id * 3.0::DOUBLE + user_id * 10) / 1e6, 6) END FROM events WHERE event_id % 2 = 1)"""
)
def appended_log(t: Tables) -> DataFrame:
    new = t.events.select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("model"), F.col("event_id").alias("tokens_in"), F.col("user_id").alias("tokens_out"))
    prices = t.events.where("event_type <> 'view'").select(F.col("event_type").alias("model")).distinct().select("model", F.lit(3.0).alias("price_in"), F.lit(10.0).alias("price_out"))
    log = new.where("trace_id % 2 = 0").select("trace_id", "model", F.lit(1.0).alias("cost_usd"))
    return files.append_log(log, new.unionAll(new), prices)


@query("SELECT 'labels' AS name, count(*) AS rows, count(*) AS restored, true AS same FROM labels UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), false UNION ALL SELECT 'region', (SELECT count(*) FROM region), 0, false")
def restore_report(t: Tables) -> DataFrame:
    """One table restored as it was, one with a changed name, one lost."""
    changed = t.nation.withColumn("n_name", F.when(F.col("n_nationkey") == 3, "changed").otherwise(F.col("n_name")))
    return files.restore_report({"labels": t.labels, "nation": t.nation, "region": t.region}, {"labels": t.labels.orderBy("quality"), "nation": changed})


@query("SELECT r_regionkey AS key, upper(r_name) AS name, 'x' AS kind FROM region")
def migrated(t: Tables) -> DataFrame:
    steps = [("0001", lambda d: d), ("0002", lambda d: {**d, "r": d["r"].withColumn("name", F.upper("name"))}), ("0003", lambda d: {**d, "r": d["r"].withColumn("kind", F.lit("x"))})]
    return files.migrate({"r": t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))}, ["0001"], steps)[0]["r"]


@query("SELECT s_suppkey AS doc_id FROM supplier WHERE s_nationkey < 10 OR s_suppkey % 7 = 0")
def replaced_documents(t: Tables) -> DataFrame:
    """Suppliers as documents: some come with a new build, some files under a new id."""
    docs = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("source_file"), F.lit("old").alias("build_hash"))
    built = docs.join(t.supplier.where("s_nationkey < 10").select(F.col("s_suppkey").alias("doc_id")), "doc_id").withColumn("build_hash", F.lit("new"))
    moved = docs.where("doc_id % 7 = 0").withColumn("doc_id", F.col("doc_id") + 1000000).select(docs.columns)
    return files.replaced_documents(docs, built.select(docs.columns).union(moved).union(docs.where("doc_id % 11 = 1"))).select("doc_id")


SIGN_INS = AUTH + """, att AS (SELECT event_id, user_id % 40 AS email, ip, created_at, epoch(created_at)::BIGINT AS sec, event_id % 4 <> 0 AS good FROM auth),
fails AS (SELECT a.event_id, count(b.event_id) >= 3 AS throttled FROM att a LEFT JOIN auth b ON b.ip = a.ip AND b.event_type = 'login_failure' AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL 15 MINUTE GROUP BY a.event_id),
early AS (SELECT att.*, CASE WHEN throttled THEN 'throttled' WHEN email % 8 = 0 THEN 'unknown' WHEN email % 8 = 1 THEN 'disabled' END AS early FROM att JOIN fails USING (event_id)),
due AS (SELECT *, row_number() OVER (PARTITION BY email ORDER BY sec, event_id) AS k FROM early WHERE early IS NULL),
run AS (SELECT event_id, email, k, CASE WHEN good THEN 'ok' ELSE 'failed' END AS outcome, CASE WHEN good THEN 0 ELSE 1 END AS failed, -1::BIGINT AS until FROM due WHERE k = 1
  UNION ALL SELECT d.event_id, d.email, d.k, CASE WHEN d.sec < r.until THEN 'locked' WHEN d.good THEN 'ok' ELSE 'failed' END,
    CASE WHEN d.sec < r.until THEN r.failed WHEN d.good THEN 0 WHEN r.failed + 1 >= 3 THEN 0 ELSE r.failed + 1 END, CASE WHEN d.sec >= r.until AND NOT d.good AND r.failed + 1 >= 3 THEN d.sec + 900000 ELSE r.until END
  FROM run r JOIN due d ON d.email = r.email AND d.k = r.k + 1)"""


@query("SELECT event_id, coalesce(early, run.outcome) AS outcome FROM early LEFT JOIN run USING (event_id)", "RECURSIVE " + SIGN_INS)
def sign_in_outcomes(t: Tables) -> DataFrame:
    a = t.auth()
    attempts = a.select("event_id", (F.col("user_id") % 40).alias("email"), "ip", "created_at", (F.col("event_id") % 4 != 0).alias("good"))
    users = attempts.where("email % 8 <> 0").select("email", F.when(F.col("email") % 8 == 1, "disabled").otherwise("active").alias("status")).distinct()
    # a lock of 15000 minutes and three failures, so that few events a user show every outcome; addresses are held to 15 minutes
    early = ops.sign_in_outcomes(attempts, users, a, most=3, minutes=15, ip_most=3).where("outcome IN ('throttled', 'unknown', 'disabled')")
    due = attempts.join(early.select("event_id"), "event_id", "left_anti").select("event_id", F.col("email").alias("user_id"), nearest_second(F.col("created_at")).alias("ts_seconds"), "good")
    return early.select("event_id", "outcome").union(ops.sign_in_replay(due, most=3, minutes=15000).select("event_id", "outcome"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(revoked_at, {MOMENT}) ELSE revoked_at END AS revoked_at FROM s", SESSIONS)
def ended_sessions(t: Tables) -> DataFrame:
    s = sessions(t).withColumn("user_id", F.col("event_id") % 3)
    return ops.end_sessions(s, t.spark.createDataFrame([(0,), (0,)], "user_id long"), AS_OF).select("event_id", "revoked_at")


@query("SELECT c_name AS email, CASE WHEN c_custkey % 5 = 0 THEN 'not signed in' WHEN c_custkey % 5 = 1 THEN 'the current password is not correct' WHEN c_custkey % 5 = 2 THEN 'the new password must differ' WHEN c_custkey % 5 = 3 THEN 'too short' ELSE 'changed' END AS result FROM customer")
def password_changes(t: Tables) -> DataFrame:
    k = F.col("c_custkey") % 5
    requests = t.customer.select(F.col("c_name").alias("email"), F.when(k != 0, k != 1).alias("verified"), F.when(k == 2, "a-long-new-secret").otherwise("old").alias("current"), F.when(k == 3, "short").otherwise("a-long-new-secret").alias("password"))
    return ops.password_changes(requests, t.spark.createDataFrame([("password12345",)], "password string"))


# --- evaluation records

@query(
    """SELECT vec_id AS question_id, CASE WHEN label = 3 THEN 0.0 WHEN label <> 4 THEN round((1.0 + list_dot_product(x, list_transform(x, lambda v, i: CASE WHEN i = 1 THEN -v ELSE v END)) / list_dot_product(x, x)) / 2, 9) END AS relevancy FROM (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings)"""
)
def relevancies(t: Tables) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    flipped = F.transform(x, lambda v, i: F.when(i == 0, -v).otherwise(v))
    made = F.when(F.col("label") == 4, F.array().cast("array<array<double>>")).otherwise(F.array(x, flipped))
    return evaluation.relevancy(t.embeddings.select(F.col("vec_id").alias("question_id"), x.alias("vector"), made.alias("generated"), (F.col("label") == 3).alias("noncommittal")))


@query(
    """SELECT question_id, string_agg(DISTINCT id, ' ' ORDER BY id) AS reference FROM (SELECT l_orderkey AS question_id, unnest(['p' || l_partkey, 'f' || l_partkey % 9 || '#p' || l_partkey % 4, 'e' || l_partkey % 50]) AS id, l_partkey FROM lineitem) WHERE id LIKE 'p%' OR l_partkey % 3 = 0 GROUP BY question_id"""
)
def reference_sets(t: Tables) -> DataFrame:
    key = F.col("l_partkey").cast("string")
    items = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_set(F.concat(F.lit("p"), key)).alias("reference_ids"))
    n = F.col("l_partkey")
    at = t.lineitem.where("l_partkey % 3 = 0").select(F.concat(F.lit("p"), key).alias("id"), F.concat(F.lit("e"), (n % 50).cast("string")).alias("element_id"), F.concat(F.lit("f"), (n % 9).cast("string")).alias("source_file"), (n % 4).alias("page")).distinct()
    return evaluation.reference_sets(items, at).withColumn("reference", F.array_join("reference", " "))


@query(
    """SELECT metric, mean, CASE WHEN metric <> 'latency' THEN before END AS before, CASE WHEN metric <> 'latency' THEN round(mean - before, 4) END AS delta,
  CASE WHEN metric = 'latency' OR before IS NULL THEN NULL WHEN round(mean - before, 4) < -0.03 THEN 'worse' WHEN round(mean - before, 4) >= 0 THEN 'better or even' ELSE 'within tolerance' END AS mark
FROM (SELECT CASE event_type WHEN 'view' THEN 'faithfulness' WHEN 'click' THEN 'figure_hit' WHEN 'error' THEN 'context_recall' ELSE 'latency' END AS metric, round(avg(CASE WHEN event_id % 2 = 0 THEN value END), 4) AS mean, round(avg(CASE WHEN event_id % 2 = 1 AND event_type <> 'click' THEN value END), 4) AS before FROM events GROUP BY 1)"""
)
def report_deltas(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "faithfulness").when(F.col("event_type") == "click", "figure_hit").when(F.col("event_type") == "error", "context_recall").otherwise("latency")
    means = lambda r: t.events.where(F.col("event_id") % 2 == r).groupBy(kind.alias("metric")).agg(F.round(F.avg("value"), 4).alias("mean"))
    return evaluation.report_deltas(means(0), means(1).where("metric <> 'figure_hit'"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'stop' WHEN event_type IN ('error', 'view') AND n < 3 THEN CASE n WHEN 1 THEN 'retry after 10 s' ELSE 'retry after 30 s' END ELSE 'fail' END AS step FROM (SELECT *, event_id % 3 + 1 AS n FROM events)")
def retry_steps(t: Tables) -> DataFrame:
    e = F.col("event_id")
    f = t.events.select("event_id", F.col("event_type").alias("kind"), F.when(e % 7 == 0, "429: insufficient_quota").alias("message"), (e % 3 + 1).alias("attempt"))
    return evaluation.retry_steps(f, ["error", "view"]).select("event_id", "step")


@query("SELECT l_orderkey AS question_id, bool_and(l_returnflag = 'R' OR list_contains(known, l_quantity)) AS ok FROM (SELECT *, coalesce(list(l_quantity) FILTER (l_linestatus = 'O') OVER (PARTITION BY l_orderkey), []) AS known FROM lineitem) GROUP BY l_orderkey")
def promotable(t: Tables) -> DataFrame:
    id_ = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    drafts = t.lineitem.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.collect_set(id_).alias("reference_ids"), F.collect_list(F.when(F.col("l_returnflag") != "R", F.col("l_quantity"))).alias("expected"))
    printed = t.lineitem.where("l_linestatus = 'O'").select(id_.alias("id"), F.concat(F.lit("it is "), F.col("l_quantity").cast("string")).alias("text"))
    return evaluation.promotable(drafts, printed)


# --- figures and boxes

@query("SELECT page, min(x0) AS x0, min(y0) AS y0, max(x0 + side) AS x1, max(y0 + side) AS y1 FROM b GROUP BY page", BOXES)
def box_unions(t: Tables) -> DataFrame:
    u = ingest.box_union(boxes(t), ["page"])
    return u.select("page", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query("SELECT page, no, round((300 - y0 - side) * 2, 6) AS x0, round(x0 * 2, 6) AS y0, round((300 - y0) * 2, 6) AS x1, round((x0 + side) * 2, 6) AS y1 FROM b", BOXES)
def turned_boxes(t: Tables) -> DataFrame:
    """Boxes of pages turned by a quarter, as pixels."""
    m = F.array(*[F.lit(float(v)) for v in (0, 1, -1, 0, 300, 0)])
    p = boxes(t).select("page", "no", numeric.to_pixels(F.col("bbox"), 144.0, m).alias("p"))
    return p.select("page", "no", *[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    """SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') * CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_exact, count(*) FILTER (l_returnflag <> 'R') * CASE WHEN l_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n_estimated, max(l_quantity) FILTER (l_returnflag = 'R') AS largest FROM lineitem GROUP BY l_orderkey"""
)
def figure_values(t: Tables) -> DataFrame:
    point = F.struct(F.col("l_quantity").cast("double").alias("value"), F.when(F.col("l_returnflag") == "R", "exact").otherwise("estimated").alias("flag"))
    g = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(point).alias("points"))
    v = g.select("l_orderkey", verify.figure_values(F.array(F.struct("points")), F.col("l_orderkey") % 2 == 0).alias("v"))
    return v.select("l_orderkey", F.size("v.exact").cast("long").alias("n_exact"), F.size("v.estimated").cast("long").alias("n_estimated"), F.array_max("v.exact").alias("largest"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size || ' 2.1' ELSE p_size::VARCHAR END AS figures FROM part")
def figure_references(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    said = F.concat(F.lit("See figure "), n, F.when(F.col("p_partkey") % 2 == 0, ", Fig. 2.1").otherwise(", table 7"), F.lit(" and Figure "), n, F.lit("; figures vary."))
    return t.part.select("p_partkey", F.array_join(captions.figure_references(said), " ").alias("figures"))


@query("SELECT element_id, '{\"element_id\":\"' || element_id || '\",\"image_hash\":\"' || content_hash || '\",\"image\":\"' || element_id || '.png\",\"context\":\"c\"}' AS value FROM e WHERE type = 'image'", ELEMENTS)
def bundle_lines(t: Tables) -> DataFrame:
    jobs = elements(t).where("type = 'image'").select(F.col("element_id").cast("string").alias("element_id"), "content_hash", F.lit("a/b.png").alias("asset_path"), F.lit("c").alias("context"))
    lines, _ = captions.bundle(jobs, "describe", "m", "1")
    return lines.select(F.get_json_object("value", "$.element_id").cast("long").alias("element_id"), "value")


# --- questions and readings

@query(
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'death' WHEN 1 THEN 'chart' WHEN 2 THEN 'chart' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'followup' ELSE 'books' END WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'followup' ELSE 'books' END ELSE 'books' END AS way FROM events"""
)
def routed_questions(t: Tables) -> DataFrame:
    asked = pick(["Tell me about my death", "I was born on a Monday", "On 04-01-1983, what of me?", "In which field should I work?", "What about marriage?", "What does the book say of Saturn?"], F.col("event_id"))
    return reading.route(t.events.select("event_id", asked.alias("question"), (F.col("user_id") % 2 == 0).alias("after_reading"))).select("event_id", "way")


@query(
    """SELECT conv_id * 1000 + turn AS text_id, CASE WHEN turn % 2 = 0 THEN 'So it is [2].' ELSE 'So it is.' END AS text, CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END AS cited, CASE WHEN turn % 2 = 1 THEN 'This answer cites none of the passages found.' END AS notice FROM conversations"""
)
def plain_answers(t: Tables) -> DataFrame:
    key = (F.col("conv_id") * 1000 + F.col("turn")).alias("text_id")
    texts = t.conversations.select(key, F.when(F.col("turn") % 2 == 0, "So it is [P2] .").otherwise("So it is [P7] .").alias("text"))
    passages = t.conversations.select(key, F.explode(F.sequence(F.lit(1), F.lit(8))).alias("n"))
    return reading.plain_answers(texts, passages).withColumn("cited", F.size("cited"))


@query("SELECT conv_id AS text_id, string_agg('[P' || turn || '] ' || role || ', p. ' || turn || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY conv_id")
def passage_prompts(t: Tables) -> DataFrame:
    return reading.passage_prompt(t.conversations.select(F.col("conv_id").alias("text_id"), F.col("turn").alias("n"), F.col("role").alias("source"), F.col("turn").alias("page"), "text"))


LORDS = """['Mars', 'Venus', 'Mercury', 'Moon', 'Sun', 'Mercury', 'Venus', 'Mars', 'Jupiter', 'Saturn', 'Saturn', 'Jupiter']"""


@query(
    """SELECT chart_id, kind, count(*) AS n, count(DISTINCT answer) AS answers FROM (
  SELECT chart_id, 'house_kind' AS kind, CASE WHEN house IN (4, 7, 10) THEN 'k' WHEN house = 1 THEN 'kt' WHEN house IN (5, 9) THEN 't' WHEN house IN (6, 8, 12) THEN 'd' ELSE 'none' END AS answer FROM (SELECT DISTINCT chart_id, unnest(range(1, 13)) AS house FROM h)
  UNION ALL SELECT chart_id, 'from_moon', ((sign_no - moon + 12) % 12)::VARCHAR FROM (SELECT *, max(CASE WHEN body = 'Moon' THEN sign_no END) OVER (PARTITION BY chart_id) AS moon FROM h) WHERE body <> 'Lagna'
  UNION ALL SELECT chart_id, 'occupants', coalesce(string_agg(body, ', ' ORDER BY body), 'none') FROM (SELECT DISTINCT chart_id, unnest(range(1, 13)) AS house FROM h) LEFT JOIN (SELECT chart_id, house, body FROM h WHERE body <> 'Lagna') USING (chart_id, house) GROUP BY chart_id, house) GROUP BY ALL""",
    SKY,
)
def house_lookups(t: Tables) -> DataFrame:
    q = reading.house_questions(astro.placements(t.skies())).where(F.col("kind").isin("house_kind", "from_moon", "occupants"))
    return q.groupBy("chart_id", "kind").agg(F.count("*").alias("n"), F.count_distinct("answer").alias("answers"))


SIGNS = astro.SIGNS


@query(
    f"""SELECT l.chart_id, {SIGNS!r}[l.tenth + 1] AS sign, {LORDS}[l.tenth + 1] AS lord, s.house AS lord_house, coalesce(b.bodies, '') AS bodies FROM (SELECT chart_id, (sign_no + 9) % 12 AS tenth FROM h WHERE body = 'Lagna') l
JOIN h s ON s.chart_id = l.chart_id AND s.body = {LORDS}[l.tenth + 1] LEFT JOIN (SELECT chart_id, string_agg(body, ', ' ORDER BY body) AS bodies FROM h WHERE house = 10 AND body <> 'Lagna' GROUP BY chart_id) b ON b.chart_id = l.chart_id""",
    SKY,
)
def career_factors(t: Tables) -> DataFrame:
    return reading.career_factors(astro.placements(t.charts())).drop("aspects")


@query(
    f"""SELECT l.chart_id, 'The Lagna is ' || {SIGNS!r}[l.sign_no + 1] || '; the Sun in ' || {SIGNS!r}[s.sign_no + 1] || '.' AS text FROM s l JOIN s ON s.chart_id = l.chart_id AND s.body = 'Sun' WHERE l.body = 'Lagna'""",
    SKY,
)
def overviews(t: Tables) -> DataFrame:
    o = reading.overview(astro.placements(t.charts()))
    return o.select("chart_id", F.regexp_replace("text", r"the Moon is in .* and the Sun", "the Sun").alias("text"))


CLAIMED = """cl AS (SELECT chart_id, (chart_id % 12)::INTEGER AS sign, (chart_id % 11 + 1)::INTEGER AS nth FROM (SELECT DISTINCT chart_id FROM s)),
m AS (SELECT h.*, max(CASE WHEN body = 'Moon' THEN sign_no END) OVER (PARTITION BY chart_id) AS moon FROM h)"""


@query(
    f"""SELECT chart_id AS text_id, 'lagna' AS kind, '' AS body, {SIGNS!r}[sign + 1] AS value FROM cl WHERE sign <> (SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Lagna')
UNION ALL SELECT chart_id, 'from moon', 'Mars', nth::VARCHAR FROM cl WHERE nth <> (SELECT (sign_no - moon + 12) % 12 + 1 FROM m WHERE m.chart_id = cl.chart_id AND body = 'Mars')
UNION ALL SELECT chart_id, 'conjunct', 'Sun', 'Venus' FROM cl WHERE (SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Sun') <> (SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Venus')
UNION ALL SELECT chart_id, 'lord', 'Saturn', nth::VARCHAR FROM cl WHERE {LORDS}[((SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Lagna') + nth - 1) % 12 + 1] <> 'Saturn'
UNION ALL SELECT chart_id, 'lord in', nth::VARCHAR, '4' FROM cl WHERE (SELECT house FROM h WHERE h.chart_id = cl.chart_id AND body = {LORDS}[((SELECT sign_no FROM h g WHERE g.chart_id = cl.chart_id AND g.body = 'Lagna') + nth - 1) % 12 + 1]) <> 4
UNION ALL SELECT chart_id, 'yoga', '', 'Gajakesari' FROM cl WHERE ((SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Jupiter') - (SELECT sign_no FROM h WHERE h.chart_id = cl.chart_id AND body = 'Moon') + 12) % 3 <> 0""",
    f"{SKY}, {CLAIMED}",
)
def unfounded_claims(t: Tables) -> DataFrame:
    charts = t.skies().select("chart_id", "bodies").dropDuplicates(["chart_id"])
    n, nth = F.col("chart_id"), tx.ordinal((F.col("chart_id") % 11 + 1).cast("int"))
    text = F.concat(F.lit("The Lagna is "), pick(SIGNS, n), F.lit(". Mars is in the "), nth, F.lit(" from the Moon. Sun is conjunct Venus. Saturn rules the "), nth, F.lit(". The lord of the "), nth, F.lit(" is in the 4th. A Gajakesari yoga."))
    return astro.unfounded_claims(charts.select(n.alias("text_id"), "chart_id", text.alias("text")), charts)


@query("SELECT chart_id AS text_id, 'Sun' AS body, 'sign' AS kind, 'Leo' AS value, " + f"{SIGNS!r}[sign_no + 1] AS actual FROM s WHERE body = 'Sun' AND sign_no <> 4 UNION ALL SELECT chart_id, 'Mars', 'house', '7', house::VARCHAR FROM h WHERE body = 'Mars' AND house <> 7", SKY)
def claim_mismatches(t: Tables) -> DataFrame:
    p = astro.placements(t.charts())
    texts = p.select("chart_id").distinct().select(F.col("chart_id").alias("text_id"), "chart_id", F.lit("Sun is in Leo. Mars sits in the 7th house.").alias("text"))
    return astro.claim_mismatches(texts, p)


@query("SELECT conv_id * 1000 + turn AS text_id, CASE WHEN turn % 2 = 0 THEN 'Good. He said \"bad luck\".' ELSE 'Good. Fine.' END AS text FROM conversations")
def unflagged_texts(t: Tables) -> DataFrame:
    texts = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("text_id"), F.when(F.col("turn") % 2 == 0, "Good. A bad luck. He said \"bad luck\".").otherwise("Good. Fine.").alias("text"))
    return astro.without_flagged(texts, texts.select("text_id", F.lit("bad luck").alias("phrase")))


@query("SELECT DISTINCT chart_id FROM h a WHERE body = 'Jupiter' AND (sign_no - (SELECT sign_no FROM h b WHERE b.chart_id = a.chart_id AND b.body = 'Moon') + 12) % 3 = 0", SKY)
def gajakesari_charts(t: Tables) -> DataFrame:
    return astro.yogas(astro.placements(t.charts())).where("name = 'Gajakesari'").select("chart_id")


@query("SELECT page, min(no) AS no, min(x0) AS x0, max(y0 + side) AS y1, count(*) AS shapes FROM b GROUP BY page, CASE WHEN no % 3 = 0 THEN -no ELSE no % 2 END", BOXES)
def captioned_regions(t: Tables) -> DataFrame:
    caption = F.when(F.col("no") % 3 != 0, (F.col("no") % 2).cast("string"))
    m = ingest.merge_captioned(boxes(t).withColumn("caption", caption).withColumn("shapes", F.lit(1)))
    return m.select("page", "no", F.col("bbox")[0].alias("x0"), F.col("bbox")[3].alias("y1"), "shapes")


@query(
    """SELECT page, no, min(x0) AS x0, min(y0) AS y0, max(x0 + side) AS x1, max(y0 + side) AS y1 FROM (SELECT page, no, x0, y0, side FROM b WHERE no <= 2
UNION ALL SELECT p.page, min(f.no), p.x0, p.y0, p.side FROM b p JOIN b f ON f.page = p.page AND f.no <= 2 AND p.no > 3 AND p.no % 5 <> 0 AND (p.no % 4 = f.no OR greatest(0, f.x0 - p.x0 - p.side, p.x0 - f.x0 - f.side, f.y0 - p.y0 - p.side, p.y0 - f.y0 - f.side) <= 32)
  GROUP BY p.page, p.no, p.x0, p.y0, p.side) GROUP BY page, no""",
    BOXES,
)
def absorbed_parts(t: Tables) -> DataFrame:
    b, n = boxes(t), F.col("no")
    figures = b.where("no <= 2").withColumn("caption", n.cast("string"))
    parts = b.where("no > 2").select("doc_id", "page", n.alias("part"), "bbox", (n % 4).cast("string").alias("caption"), F.when(n == 3, "isolated_shape").otherwise("too_few_shapes").alias("reason"), (n % 5 == 0).alias("callout"))
    grown, _ = ingest.absorb_parts(figures, parts)
    return grown.select("page", "no", *[F.col("bbox")[i].alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))])


DASHAS = SKY + """, d AS (SELECT chart_id, lord, CASE WHEN seq = 0 THEN birth ELSE birth + floor((upto - years) * 365.25::DOUBLE)::INTEGER END AS start, birth + floor(upto * 365.25::DOUBLE)::INTEGER AS stop FROM (
  SELECT *, sum(years) OVER w - el * first(years) OVER w AS upto FROM (
    SELECT chart_id, birth, seq, el, ['Ketu', 'Venus', 'Sun', 'Moon', 'Mars', 'Rahu', 'Jupiter', 'Saturn', 'Mercury'][(f + seq) % 9 + 1] AS lord, [7, 20, 6, 10, 7, 18, 16, 19, 17][(f + seq) % 9 + 1]::DOUBLE AS years FROM (
      SELECT chart_id, birth, unnest(range(0, 9))::INTEGER AS seq, (floor(lon / (360.0::DOUBLE / 27)) % 9)::INTEGER AS f, lon / (360.0::DOUBLE / 27) - floor(lon / (360.0::DOUBLE / 27)) AS el FROM x WHERE body = 'Moon'))
  WINDOW w AS (PARTITION BY chart_id ORDER BY seq ROWS UNBOUNDED PRECEDING)))"""


@query("SELECT chart_id, lord, start, stop AS \"end\", start <= DATE '2010-01-01' AS now FROM d WHERE stop > DATE '2010-01-01' AND start <= DATE '2020-01-01'", DASHAS)
def coming_periods(t: Tables) -> DataFrame:
    return reading.coming_periods(astro.dashas(t.charts().where("body = 'Moon'")), "2010-01-01", 10)


# --- statements that tables decide

def _facts(kind: str, table: dict) -> str:
    return ", ".join(f"('{kind}', '{b}', '{t}')" for t, bs in table.items() for b in bs)


TOPICS, OF_HOUSES, OF_KIND = list(claims.KARAKAS), list(claims.HOUSE_TOPICS), list(claims.HOUSE_KINDS)
SEVEN = ["Sun", "Moon", "Mars", "Mercury", "Jupiter", "Venus", "Saturn"]


@query(
    f"""SELECT text_id, kind, body, value FROM said ANTI JOIN facts USING (kind, body, value)""",
    f"""facts(kind, body, value) AS (VALUES {_facts("karaka", claims.KARAKAS)}, {_facts("house of", claims.HOUSE_TOPICS)}, {_facts("house kind", claims.HOUSE_KINDS)}, {", ".join(f"('sign ruler', '{r}', '{s}')" for r, s in zip(astro.RULERS, SIGNS))}),
n AS (SELECT o_orderkey AS text_id, o_orderkey % 7 AS a, (o_orderkey // 7) % {len(TOPICS)} AS b, o_custkey % 12 + 1 AS h, o_custkey % {len(OF_HOUSES)} AS c, o_orderkey % {len(OF_KIND)} AS d, o_custkey % 12 AS s FROM orders),
said AS (SELECT text_id, unnest(['karaka', 'house of', 'house kind', 'sign ruler']) AS kind, unnest([{SEVEN!r}[a + 1], h::VARCHAR, h::VARCHAR, {SEVEN!r}[a + 1]]) AS body,
  unnest([{TOPICS!r}[b + 1], {OF_HOUSES!r}[c + 1], {OF_KIND!r}[d + 1], {SIGNS!r}[s + 1]]) AS value FROM n)""",
)
def textbook_mistakes(t: Tables) -> DataFrame:
    """What orders' numbers make up about bodies, houses and signs, against the tables."""
    o, n, m = t.orders, F.col("o_orderkey"), F.col("o_custkey")
    nth = tx.ordinal((m % 12 + 1).cast("int"))
    text = F.concat(
        pick(SEVEN, n), F.lit(" is the natural karaka of the "), pick(TOPICS, F.floor(n / 7)), F.lit(". The "), nth, F.lit(" house is the house of "), pick(OF_HOUSES, m),
        F.lit(". The "), nth, F.lit(" is a "), pick(OF_KIND, n), F.lit(". "), pick(SIGNS, m), F.lit(" is ruled by the "), pick(SEVEN, n), F.lit("."),
    )
    return claims.textbook_mistakes(o.select(n.alias("text_id"), text.alias("text")))


@query(
    f"""SELECT chart_id AS text_id, 'from' AS kind, 'Mars' AS body, nth || ' from Jupiter' AS value FROM c2 WHERE nth <> (SELECT (a.sign_no - b.sign_no + 12) % 12 + 1 FROM s a JOIN s b USING (chart_id) WHERE a.body = 'Mars' AND b.body = 'Jupiter' AND chart_id = c2.chart_id)
UNION ALL SELECT chart_id, 'maha start', 'Venus', (1990 + chart_id % 40)::VARCHAR FROM c2 WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.chart_id = c2.chart_id AND lord = 'Venus' AND year(start) = 1990 + c2.chart_id % 40)
UNION ALL SELECT chart_id, 'maha dates', lord, (start + (chart_id % 4)::INTEGER)::VARCHAR || ' to ' || stop FROM d WHERE seq = 1 AND chart_id % 4 >= 2
UNION ALL SELECT chart_id, 'maha years', lord, year(start) || ' to ' || (year(stop) + chart_id % 2) FROM d WHERE seq = 1 AND chart_id % 2 = 1""".replace("nth || ' from", "nth || CASE WHEN nth IN (11, 12) THEN 'th' WHEN nth = 1 THEN 'st' WHEN nth = 2 THEN 'nd' WHEN nth = 3 THEN 'rd' ELSE 'th' END || ' from"),
    DASHAS.replace("SELECT chart_id, lord, CASE WHEN seq", "SELECT chart_id, seq, lord, CASE WHEN seq") + ", c2 AS (SELECT DISTINCT chart_id, chart_id % 12 + 1 AS nth FROM s)",
)
def period_mistakes(t: Tables) -> DataFrame:
    """Positions from Jupiter, and dates of the second period moved by none to three days, stated of every chart."""
    moon = F.array_max(F.transform(F.filter("bodies", lambda b: b["body"] == "Moon"), lambda b: b["longitude"]))
    charts = t.skies().withColumn("moon", moon).withColumn("periods", astro.periods_from(F.col("moon"), F.col("birth")))
    second = charts.select("chart_id", F.get("periods", F.lit(1)).alias("p")).select("chart_id", "p.*")
    n = F.col("chart_id")
    dated = F.concat("lord", F.lit(" mahadasha from "), F.date_add("start", (n % 4).cast("int")).cast("string"), F.lit(" to "), F.col("end").cast("string"), F.lit(". "), "lord", F.lit(" mahadasha from "), F.year("start"), F.lit(" to "), F.year("end") + (n % 2).cast("int"), F.lit("."))
    head = F.concat(F.lit("Mars is in the "), tx.ordinal((n % 12 + 1).cast("int")), F.lit(" from Jupiter. Venus mahadasha begins in "), (1990 + n % 40).cast("string"), F.lit(". "))
    return claims.period_mistakes(second.select(n.alias("text_id"), "chart_id", F.concat(head, dated).alias("text")), charts.select("chart_id", "bodies"), charts.select("chart_id", "periods"))


@query("SELECT chart_id AS text_id, 'Sun' AS body, 'sign' AS kind, 'Leo' AS value, " + f"{SIGNS!r}[sign_no + 1] AS actual FROM s WHERE body = 'Sun' AND sign_no <> 4 UNION ALL SELECT chart_id, 'Mars', 'house', '7', house::VARCHAR FROM h WHERE body = 'Mars' AND house <> 7", SKY)
def lateral_claims(t: Tables) -> DataFrame:
    """The claims of claim_mismatches through the table function, in SQL."""
    claims.register(t.spark)
    p = astro.placements(t.charts())
    texts = p.select("chart_id").distinct().select(F.col("chart_id").alias("text_id"), "chart_id", F.lit("Sun is in Leo. Mars sits in the 7th house.").alias("text"))
    return t.spark.sql(
        """SELECT c.text_id, c.body, c.kind, c.value, CASE c.kind WHEN 'house' THEN CAST(p.house AS STRING) ELSE p.sign END AS actual
FROM (SELECT t.text_id, t.chart_id, s.* FROM {texts} t, LATERAL stated_claims(t.text) s WHERE s.kind IN ('house', 'sign')) c JOIN {placed} p ON p.chart_id = c.chart_id AND p.body = c.body
WHERE c.value <> CASE c.kind WHEN 'house' THEN CAST(p.house AS STRING) ELSE p.sign END""",
        texts=texts, placed=p,
    )


@query("SELECT conv_id, turn, b || ' rules here. ' || b || ' sits in the 4th house. ' || text AS text FROM (SELECT *, ['Sun', 'Moon', 'Mars', 'Mercury', 'Jupiter', 'Venus', 'Saturn'][turn % 7 + 1] AS b FROM conversations)")
def resolved_pronouns(t: Tables) -> DataFrame:
    """A sentence that opens with It, in front of every turn's text."""
    said = F.concat(pick(SEVEN, F.col("turn")), F.lit(" rules here. It sits in the 4th house. "), "text")
    return t.conversations.select("conv_id", "turn", reading.resolve_pronouns(said).alias("text"))


@query()
def grown_regions(t: Tables) -> DataFrame:
    """Two boxes a page as regions, the others as labels; the fixpoint is held against a plain loop in the tests."""
    b = boxes(t)
    grown = ingest.grow_regions(b.where("no <= 2"), b.where("no > 2"))
    return grown.select("page", *[F.col("bbox")[i].alias(x) for i, x in enumerate(("x0", "y0", "x1", "y1"))])


@query(
    """SELECT lang, '<table><caption>Documents in ' || lang || '</caption><thead><tr><th>source</th><th>n</th><th>first_words</th></tr></thead><tbody>' || string_agg('<tr><td>' || source || '</td><td>' || n || '</td><td>' ||
  replace(replace(replace(replace(words, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td></tr>', '' ORDER BY source) || '</tbody></table>' AS html
FROM (SELECT lang, source, count(*) AS n, min(text) AS words FROM documents GROUP BY ALL) GROUP BY lang"""
)
def html_reports(t: Tables) -> DataFrame:
    rows = t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("text").alias("first_words"))
    return render.html_tables(rows, "lang", ["source", "n", "first_words"], ["source"], F.concat(F.lit("Documents in "), "lang"))


@query(
    f"""SELECT chart_id, '<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 600 300">' || string_agg('<rect x="' || round((i - 1) * step + step * 0.1::DOUBLE, 1) || '" y="' || round((top - greatest(v, 0)) / span * 300, 1) || '" width="' || round(step * 0.8::DOUBLE, 1)
  || '" height="' || round(abs(v) / span * 300, 1) || '" fill="' || {render.COLOURS!r}[(list_position(names, series) - 1) % 6 + 1] || '"><title>' || label || ': ' || v || '</title></rect>', '' ORDER BY i) || '</svg>' AS svg FROM (
  SELECT *, row_number() OVER (PARTITION BY chart_id ORDER BY place, series) AS i, 600.0::DOUBLE / count(*) OVER w AS step, greatest(max(v) OVER w, 0) AS top, greatest(max(v) OVER w, 0) - least(min(v) OVER w, 0) AS span,
    list_sort(list_distinct(list(series) OVER w)) AS names FROM (
    SELECT l_orderkey AS chart_id, l_returnflag AS series, l_linenumber AS place, 'line ' || l_linenumber AS label, (l_quantity - 20)::DOUBLE AS v FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag))
  WINDOW w AS (PARTITION BY chart_id)) GROUP BY chart_id HAVING max(abs(v)) > 0"""
)
def svg_charts(t: Tables) -> DataFrame:
    """Quantities of an order's lines, less 20, as bars above and below zero."""
    first = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("r"))
    points = first.select(F.col("l_orderkey").alias("chart_id"), F.col("r.l_returnflag").alias("series"), F.col("l_linenumber").alias("place"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("label"), (F.col("r.l_quantity") - 20).cast("double").alias("value"))
    drawn = points.groupBy("chart_id").agg(F.max(F.abs("value")).alias("most")).where("most > 0").select("chart_id")
    return render.svg_bars(points.join(drawn, "chart_id", "left_semi"))


# --- files and stored versions

@query(
    """SELECT line, CASE WHEN turn % 7 <> 3 THEN conv_id END AS conv_id, CASE WHEN turn % 7 <> 3 THEN turn END AS turn, turn % 7 <> 3 AS good, part FROM (
  SELECT *, conv_id // 20 AS part, row_number() OVER (PARTITION BY conv_id // 20 ORDER BY conv_id, turn) AS line FROM conversations)"""
)
def numbered_jsonl(t: Tables) -> DataFrame:
    """Conversations written as JSON lines, a file of 20 each, some lines cut short, and read again with their numbers."""
    whole = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    lines = t.conversations.select("conv_id", "turn", F.floor(F.col("conv_id") / 20).alias("part"), F.when(F.col("turn") % 7 == 3, F.expr("left(to_json(struct(conv_id, turn, text)), 15)")).otherwise(whole).alias("value"))
    path = new_folder(t.spark)
    lines.repartition("part").sortWithinPartitions("part", "conv_id", "turn").select("part", "value").write.partitionBy("part").text(path)
    good, bad = files.read_jsonl_numbered(t.spark, path, T.StructType.fromDDL("conv_id long, turn long, role string, text string"))
    part = F.regexp_extract("file", r"part=(\d+)", 1).cast("long").alias("part")
    none = F.lit(None).cast("long")
    return good.select("line", "conv_id", "turn", F.lit(True).alias("good"), part).union(bad.select("line", none, none, F.lit(False), part))


@query(
    """SELECT s_suppkey AS doc_id, CASE WHEN s_nationkey < 10 THEN 2 ELSE 1 END AS version, CASE WHEN s_nationkey < 10 THEN 'new' ELSE 'old' END AS build_hash, coalesce(n, 0)::BIGINT AS pieces
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) FILTER (s_nationkey >= 10 OR l_linenumber = 1) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey) ON l_suppkey = s_suppkey"""
)
def stored_replacement(t: Tables) -> DataFrame:
    """Suppliers as documents with their lines as pieces in a store; some suppliers are replaced, with fewer pieces; the store's last version."""
    docs = t.supplier.select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("source_file"), "s_nationkey")
    pieces = t.lineitem.select(F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber")
    store = Store(t.spark, new_folder(t.spark), buckets=16)
    store.replace_documents(docs.select("doc_id", "source_file", F.lit("old").alias("build_hash")), {"pieces": pieces})
    newer = F.when(F.col("s_nationkey") < 10, "new").otherwise("old").alias("build_hash")
    store.replace_documents(docs.select("doc_id", "source_file", newer), {"pieces": pieces.where("l_linenumber = 1")})
    kept = store.read()
    n = kept["pieces"].groupBy("doc_id").agg(F.count("*").alias("pieces"))
    return kept["documents"].join(n, "doc_id", "left").select("doc_id", "version", "build_hash", F.coalesce("pieces", F.lit(0)).alias("pieces"))
