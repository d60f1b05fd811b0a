"""Retrieval: semantic and keyword lists, their fusion, provenance and related items.

Chunks are rows (chunk_id, collection, text, embedding). Queries may come as one row or many: every ranking is within
query_id, so a batch of queries is one plan. Cuts are by row_number with ties to the smaller id.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..session import written
from . import fulltext
from .vectors import nearest


#: Chunks whose scores one task of bm25_topn() sums, and words of queries up to which they are broadcast.
TASK_CHUNKS, MOST_TERMS = 2000, 1_000_000


def _top(scored: DataFrame, n: int, score: str = "score", key: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def semantic_topn(chunks: DataFrame, queries: DataFrame, n: int = 20) -> DataFrame:
    """(query_id, chunk_id, score, rank): the n chunks nearest to each query (query_id, vector) by cosine; see vectors.nearest()."""
    return _top(nearest(chunks, queries, n, "chunk_id"), n)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, n_terms) of queries (query_id, question); a query without words has no rows and matches nothing."""
    words = queries.select("query_id", F.array_distinct(tokens(F.col("question"))).alias("words"))
    return words.select("query_id", F.size("words").alias("n_terms"), F.explode("words").alias("term"))


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(chunk_id, length, term, tf), of the given terms (term) only where there are any, so that other words are not shuffled.

    A row with the empty term stands for the chunk itself: its length is known also if it holds none of the terms. Words are counted in
    their chunk's row, sorted, so that none is shuffled.
    """
    words = chunks.select("chunk_id", F.sort_array(tokens(F.col("text"))).alias("words"))
    first = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("term"), i.alias("i"))), lambda e: (e["i"] == 0) | (e["term"] != F.coalesce(F.get("words", e["i"] - 1), F.lit(""))))
    counted = words.select("chunk_id", F.size("words").alias("length"), first.alias("first"))
    ends = F.transform("first", lambda e, k: F.struct(e["term"].alias("term"), (F.coalesce(F.get("first", k + 1)["i"], F.col("length")) - e["i"]).cast("long").alias("tf")))
    own = F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("long").alias("tf")))
    each = counted.select("chunk_id", "length", F.explode(F.concat(own, ends)).alias("p")).select("chunk_id", "length", "p.term", "p.tf")
    if terms is not None:
        wanted = terms.select("term").union(terms.sparkSession.createDataFrame([("",)], "term string")).distinct()
        each = each.join(wanted, "term", "left_semi")
    return each.select("chunk_id", "length", "term", "tf")


def keyword_topn(chunks: DataFrame, queries: DataFrame, n: int = 20, mode: str = "all", stems: bool = False) -> DataFrame:
    """(query_id, chunk_id, score, rank) by cover density. mode all: every word of the question occurs; any: at least one."""
    return fulltext.search(chunks, queries, n, mode, stems)


def bm25_topn(chunks: DataFrame, queries: DataFrame, n: int = 20, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, chunk_id, score, rank) by BM25 over chunks that hold any term. One pass over the texts gives postings, lengths and counts."""
    terms = query_terms(queries)
    posts = written(postings(chunks, terms))
    stats = posts.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    df = posts.where("term <> ''").groupBy("term").agg(F.count("*").alias("df"))
    # a chunk scores most queries: those scores are summed where its postings are, a bounded number of chunks a task, and not shuffled
    tasks = max(chunks.sparkSession.sparkContext.defaultParallelism, -(-posts.where("term = ''").count() // TASK_CHUNKS))
    held = posts.where("term <> ''").repartition(tasks, "chunk_id")
    row = held.join(F.broadcast(df.join(terms, "term")), "term") if terms.count() <= MOST_TERMS else held.join(df, "term").join(terms, "term")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = row.crossJoin(F.broadcast(stats)).groupBy("chunk_id", "query_id").agg(F.round(F.sum(weight), 9).alias("score"))  # stats: one row
    return _top(scored.select("query_id", "chunk_id", "score"), n)


def fuse(semantic: DataFrame, keyword: DataFrame, k: int = 8, rrf_k: int = 60) -> DataFrame:
    """(query_id, chunk_id, score, rank, semantic_rank, keyword_rank) by reciprocal ranks of two lists."""
    a = semantic.select("query_id", "chunk_id", F.col("rank").alias("semantic_rank"))
    b = keyword.select("query_id", "chunk_id", F.col("rank").alias("keyword_rank"))

    def part(c: str) -> Column:
        return F.coalesce(1.0 / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))

    both = a.join(b, ["query_id", "chunk_id"], "full_outer").withColumn("score", F.round(part("semantic_rank") + part("keyword_rank"), 9))
    return _top(both, k)


def hybrid_search(chunks: DataFrame, queries: DataFrame, k: int | None = 8, candidates: int = 20, mode: str = "all", rrf_k: int = 60, collection: str | None = None, stems: bool = True) -> DataFrame:
    """The fused k best chunks of each query (query_id, question, vector), with their columns.

    mode: all or any of the words or of their stems, websearch (with phrases, OR and -not), or bm25 over plain words.
    """
    pool = chunks.where(F.col("collection") == collection) if collection else chunks
    semantic = semantic_topn(pool, queries, candidates)
    keyword = bm25_topn(pool, queries, candidates) if mode == "bm25" else fulltext.search(pool, queries, candidates, mode, stems)
    top = fuse(semantic, keyword, k or 8, rrf_k)
    return top.join(chunks.drop("embedding"), "chunk_id")


def rerank(hits: DataFrame, score: Callable[[pd.Series, pd.Series], pd.Series], k: int) -> DataFrame:
    """Reorders hits (query_id, question, text, rank) by an injected pair scorer; equal scores keep their order."""
    scorer = F.pandas_udf(score, "double")
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    scored = hits.withColumn("rerank_score", scorer("question", "text")).withColumn("new_rank", F.row_number().over(order))
    return scored.where(F.col("new_rank") <= k).drop("rank").withColumnRenamed("new_rank", "rank")


def locations(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """(chunk_id, locations): the elements of each chunk (chunk_id, element_ids) in list order, with page, and bbox and source_file
    where elements have them; unknown ones vanish."""
    columns = ["element_id", "page", *[c for c in ("bbox", "source_file") if c in elements.columns]]
    each = chunks.select("chunk_id", F.posexplode("element_ids").alias("pos", "element_id")).join(elements.select(*columns), "element_id")
    found = each.groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *columns))), lambda e: F.struct(*[e[c].alias(c) for c in columns])).alias("locations"))
    empty = F.array().cast(found.schema["locations"].dataType)
    return chunks.select("chunk_id").join(found, "chunk_id", "left").select("chunk_id", F.coalesce("locations", empty).alias("locations"))


def related_items(links: DataFrame, wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """(element_id, other_id, method, score, title): other ends of links (target_id, text_element_id) that touch wanted (element_id).

    Where both ends are wanted only the text end is given, once.
    """
    w = wanted.select("element_id").distinct()
    out = links.join(w.withColumnRenamed("element_id", "target_id"), "target_id").select(F.col("target_id").alias("element_id"), F.col("text_element_id").alias("other_id"), "method", "score")
    back = links.join(w.withColumnRenamed("element_id", "text_element_id"), "text_element_id").join(w.withColumnRenamed("element_id", "target_id"), "target_id", "left_anti")
    both = out.union(back.select(F.col("text_element_id").alias("element_id"), F.col("target_id").alias("other_id"), "method", "score"))
    return both.join(titles.select(F.col("element_id").alias("other_id"), "title"), "other_id", "left").select("element_id", "other_id", "method", "score", "title")


def attach_related(hits: DataFrame, related: DataFrame) -> DataFrame:
    """(chunk_id, other_id, title, score): for each hit (chunk_id, element_ids), related items that are not its own, each once."""
    own = hits.select("chunk_id", "element_ids", F.explode("element_ids").alias("element_id"))
    rows = own.join(related, "element_id").where(~F.expr("array_contains(element_ids, other_id)"))
    first = Window.partitionBy("chunk_id", "other_id").orderBy(F.desc("score"), "element_id")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("chunk_id", "other_id", "title", "score")


def round_robin(hits: DataFrame, limit: int, exclude: str | None = None) -> DataFrame:
    """Passages over several queries (group_id, query_no, rank, chunk_id, text): first of each, then second of each, each chunk once."""
    pool = hits.where(~F.col("text").rlike(exclude)) if exclude else hits
    first = Window.partitionBy("group_id", "chunk_id").orderBy("rank", "query_no")
    order = Window.partitionBy("group_id").orderBy("rank", "query_no", "chunk_id")
    once = pool.withColumn("k", F.row_number().over(first)).where("k = 1")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit).drop("k")


def found_rank(hits: DataFrame, expected: DataFrame, top: int = 5) -> DataFrame:
    """(query_id, rank, found): first rank whose elements overlap the expected ids of a fixed query."""
    j = expected.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(F.when(F.arrays_overlap("element_ids", "expect"), F.col("rank"))).alias("rank"))
    return j.withColumn("found", F.coalesce(F.col("rank") <= top, F.lit(False)))


def compare_searches(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, left, right) of queries whose ordered ids differ between two results (query_id, rank, chunk_id)."""

    def listed(d: DataFrame, name: str) -> DataFrame:
        return d.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda e: e["chunk_id"]).alias(name))

    return listed(a, "left").join(listed(b, "right"), "query_id", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def shape_hits(hits: DataFrame, kind: str) -> DataFrame:
    """What a search tool shows: an excerpt and the distinct pages, ascending."""
    width = {"text": 1500, "figure": 700, "table": 1500}[kind]
    return hits.select("query_id", "rank", "chunk_id", F.substring("text", 1, width).alias("excerpt"), F.array_sort(F.array_distinct(F.transform("locations", lambda e: e["page"]))).alias("pages"))


def source_note(elements: DataFrame, chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """(source_file, note) 'Source: file, p. 1, 2' over element ids and the elements of chunk ids."""
    w = ids.select("id").distinct()
    direct = elements.join(w, elements["element_id"] == w["id"]).select("source_file", "page")
    via = chunks.join(w, chunks["chunk_id"] == w["id"]).select(F.explode("element_ids").alias("element_id")).join(elements, "element_id").select("source_file", "page")
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ", ")
    return direct.union(via).distinct().groupBy("source_file").agg(F.concat(F.lit("Source: "), F.first("source_file"), F.lit(", p. "), pages).alias("note"))


def websearch_topn(chunks: DataFrame, queries: DataFrame | str, n: int = 20, stems: bool = True) -> DataFrame:
    """(query_id, chunk_id, score, rank) of queries in web-search syntax; see fulltext.search()."""
    return fulltext.search(chunks, queries, n, "websearch", stems)
