"""Which elements are searched, bundled or counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIGURES = ("image", "vector_figure", "scanned_page")


def searchable_text(transcribed: Column) -> Column:
    """Text blocks, and scanned pages that were transcribed, with status ok and any text."""
    kind = (F.col("type") == "text") | ((F.col("type") == "scanned_page") & transcribed)
    return F.coalesce((F.col("status") == "ok") & (F.trim("text") != "") & kind, F.lit(False))


def searchable_figure(transcribed: Column) -> Column:
    """Figures with status ok that are no transcribed page."""
    return F.coalesce((F.col("status") == "ok") & F.col("type").isin(*FIGURES) & ~transcribed, F.lit(False))


def searchable(elements: DataFrame, tables: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(element_id, collection) of elements (element_id, type, status, text) that search finds: text, figure, or table with a record in tables."""
    read = transcripts.select("element_id").distinct().withColumn("read", F.lit(True))
    held = tables.select("element_id").distinct().withColumn("held", F.lit(True))
    j = elements.join(read, "element_id", "left").join(held, "element_id", "left")
    seen = F.coalesce("read", F.lit(False))
    table = (F.col("type") == "table") & F.coalesce("held", F.lit(False))
    kind = F.when(searchable_text(seen), "text").when(searchable_figure(seen), "figure").when(table, "table")
    return j.select("element_id", kind.alias("collection")).where("collection IS NOT NULL")


def containment_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n): how many chunks (text) hold each of a few terms, case aside, in one pass."""
    held = F.array_compact(F.array(*[F.when(F.contains(F.lower("text"), F.lower(F.lit(x))), F.lit(x)) for x in terms]))
    n = chunks.select(F.explode(held).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    every = reduce(DataFrame.union, [chunks.sparkSession.range(1).select(F.lit(x).alias("term")) for x in terms])
    return every.join(n, "term", "left").select("term", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bundle_jobs(elements: DataFrame, cached: DataFrame) -> DataFrame:
    """Elements to caption: figures with status ok, and tables of low confidence that have a picture, less those in the cache (content_hash)."""
    figure = F.col("type").isin(*FIGURES) & (F.col("status") == "ok")
    table = (F.col("type") == "table") & F.col("low_confidence") & F.col("asset_path").isNotNull()
    return elements.where(F.coalesce(figure | table, F.lit(False))).join(cached.select("content_hash"), "content_hash", "left_anti")
