"""A corpus pipeline of five stages; each takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame.

In every stage very long texts are worked on whole, an empty table gives no rows, and columns other than those of documents, whatever
their names, are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import materialize, table
from lodestone.llm.line_dedup import line_dedup
from lodestone.llm.mixing import mix_sources
from lodestone.llm.packing import best_fit_packing
from lodestone.llm.queries import vocabulary
from lodestone.llm.simhash_similar import similar_components
from lodestone.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more go; null and empty texts score low and stay, repeated rows are judged alike."""
    return toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), 0.3).where("predicted = 0").select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document stays, with what is left of its text and n_chars of that; null and empty texts stay as they are."""
    cleaned = line_dedup(docs).groupBy("doc_id", "row_key").agg(F.first("text").alias("new_text"))
    rest = docs.select("doc_id", "lang", "source", "n_chars", F.xxhash64("text").alias("row_key"))
    joined = rest.join(cleaned.hint("shuffle_hash"), rest["doc_id"].eqNullSafe(cleaned["doc_id"]) & (rest["row_key"] == cleaned["row_key"]))
    return joined.select(rest["doc_id"], F.col("new_text").alias("text"), "lang", "source", F.coalesce(F.length("new_text").cast("long"), F.col("n_chars")).alias("n_chars"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more, by SimHash) the document with the smallest doc_id stays; null and empty texts are copies of each other; one whose doc_id is null stays always."""
    kept = materialize(similar_components(docs, width=5, similarity=0.8).where("doc_id = component_id").select("doc_id", "row_key").distinct())
    rows = docs.select(*COLUMNS)
    same = rows.withColumn("row_key", F.xxhash64("text")).join(kept, ["doc_id", "row_key"], "left_semi")
    return same.select(*COLUMNS).union(rows.where("doc_id IS NULL"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target takes it; null and empty texts have no words to take, their copies follow their source's whole ones."""
    copies = mix_sources(docs).where("copies > 0").select("doc_id", "source", "row_key", "copies").distinct()
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("row_key"))
    same = rows["doc_id"].eqNullSafe(copies["doc_id"]) & rows["source"].eqNullSafe(copies["source"]) & (rows["row_key"] == copies["row_key"])
    joined = rows.join(copies, same).select(*[rows[c] for c in COLUMNS], "copies")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place in it; null and empty texts are one closing id, repeated rows are packed each."""
    return best_fit_packing(docs, vocabulary(), 2048)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("simhash_dedup", drop_copies), ("source_mixing", mix), ("packing", pack)]

#: Edit joins, XXH64 fingerprints, Pareto samples and tokens have no form in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
