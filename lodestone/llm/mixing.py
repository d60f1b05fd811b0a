"""Mixing sources to target weights by Pareto order sampling, DataFrame operations only.

A source's target over its size is how often each of its documents is wanted: the whole part is taken as certain copies,
the words still missing by a Pareto order sample. Inclusion probabilities are unequal (by `weight`, longer documents are
likelier by default) and scaled to the missing words, those that would exceed 1 being certain and their excess going to
the others; documents are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p), and taken in that order until the words are reached. The cut is found by sums over a grid of
ranks, refined once in the one cell that holds it, so a source that holds most rows never meets in one task.

Defined results: null texts have size 0; a source that is null is one of its own, last in order; u is a hash of the
document's id, source and seed, so reruns agree, and repeated rows are drawn together; documents of equal
rank at the cut (a tie of 64-bit hashes) are taken or left together; sources without words take none; very long texts are counted whole; an empty table gives no rows; columns other
than doc_id, source and text are ignored. Sources are labels of collections: their list is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
GRID = 4096


def water_filled(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target to sources (source, source_size): shares by cycling weights, none above `most` times its size."""
    total = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ranked) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    before, onward = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    s = s.withColumn("level", level)
    # the first source, in order of cap over weight, that the water does not fill sets its level
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "level"))).over(total)["level"], F.lit(0.0))
    return s.withColumn("water", level).select("source", "source_size", F.least("cap", F.col("water") * F.col("w")).alias("target"))


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("source_key")


def certain(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source_key, from_weight, odds_scale, sure_words): inclusion odds are odds_scale * weight, and documents of a weight from
    from_weight on, whose odds would exceed 1, are taken for certain; their excess is given to the others.

    sized: (source_key, size, weight). Sums by source and weight are written once; each round finds the weights certain at the
    present scale and works the scale out anew without them, until none is added; the certain never fill more than is missing,
    since odds below 1 still fill the rest.
    """
    sums = materialize(sized.where("size > 0").groupBy("source_key", "weight").agg(F.sum("size").alias("size")))
    now = plan.select("source_key", "missing", "heft", F.lit(float("inf")).alias("from_weight"), F.lit(0.0).alias("sure_words"))
    while True:
        scale = F.when(F.col("heft") > 0, (F.col("missing") - F.col("sure_words")) / F.col("heft"))
        now = now.withColumn("odds_scale", scale)
        limit = F.when(F.col("odds_scale") > 0, 1 / F.col("odds_scale")).otherwise(F.lit(float("inf")))
        over = sums.join(now.withColumn("limit", F.least(limit, "from_weight")), "source_key")
        is_sure = F.col("weight") >= F.col("limit")
        found = over.groupBy("source_key").agg(F.min(F.when(is_sure & (F.col("size") > 0), F.col("weight"))).alias("low"), F.sum(F.when(is_sure, F.col("size")).otherwise(0)).cast("double").alias("words"), F.sum(F.when(~is_sure, F.col("size") * F.col("weight")).otherwise(0.0)).alias("rest"))
        new = materialize(now.join(found, "source_key").select("source_key", "missing", F.col("rest").alias("heft"), F.least("from_weight", F.coalesce("low", F.lit(float("inf")))).alias("from_weight"), F.col("words").alias("sure_words"), F.col("sure_words").alias("before"), "odds_scale"))
        if new.where("sure_words > before").isEmpty():
            return new.select("source_key", "from_weight", "odds_scale", "sure_words")
        now = new.select("source_key", "missing", "heft", "from_weight", "sure_words")


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7, weight: Column | None = None) -> DataFrame:
    """doc_id, source, row_key (hash of the text), size, source_size, target, copies, taken of each row of docs (doc_id, source, text)."""
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("row_key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = materialize(sized.withColumn("weight", (weight if weight is not None else F.log1p("size")).cast("double")))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("weight")).alias("heft"))
    wanted = water_filled(sums.select("source", "source_size"), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = sums.select(_key(), "heft").join(wanted.select("*", _key()).drop("source"), "source_key")
    plan = plan.withColumn("whole", F.floor(ratio + 1e-9)).withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    plan = materialize(plan)
    sure = certain(sized.select(_key(), "size", "weight"), plan)
    # from here on missing is what the sample is to take besides the documents that are certain
    none = F.lit(float("inf"))  # sources without words have no sums
    plan = materialize(plan.join(sure, "source_key", "left").select("source_key", "source_size", "target", "whole", F.coalesce("from_weight", none).alias("from_weight"), "odds_scale", (F.col("missing") - F.coalesce("sure_words", F.lit(0.0))).alias("missing"), F.col("missing").alias("wanted")))
    every = sized.select("doc_id", "source", "row_key", "size", "weight", _key()).join(plan, "source_key").withColumn("sure", F.coalesce((F.col("weight") >= F.col("from_weight")) & (F.col("wanted") > 0), F.lit(False)))
    rows = every.where("NOT sure")
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "source", F.lit(seed)), 11).cast("double") + 0.5) / float(1 << 53)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.coalesce(F.col("odds_scale") * F.col("weight"), F.lit(0.5))))
    q = (u / (1 - u)) / (p / (1 - p))
    rows = rows.withColumn("rank", q / (1 + q))
    cell, fine = F.floor(F.col("rank") * GRID).cast("long"), F.floor(F.col("rank") * GRID * GRID).cast("long")
    rows = rows.withColumn("cell", cell).withColumn("fine", fine)

    def cut(sums: DataFrame, column: str, before: str) -> DataFrame:
        """Of each source, the grid cell in which its missing words are reached, and the words before it."""
        order = Window.partitionBy("source_key").orderBy(column)
        run = sums.withColumn("upto", F.col(before) + F.sum("words").over(order))
        return run.where("upto >= missing").groupBy("source_key").agg(F.min(F.struct(column, F.col("upto") - F.col("words"))).alias("c")).select("source_key", F.col("c")[column].alias(column), F.col("c.col2").alias("words_before"))

    coarse = rows.groupBy("source_key", "cell").agg(F.sum("size").alias("words"), F.first("missing").alias("missing")).withColumn("zero", F.lit(0))
    at = materialize(cut(coarse, "cell", "zero"))
    inner = rows.join(at, ["source_key", "cell"]).groupBy("source_key", "fine").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"), F.first("words_before").alias("zero"))
    at = materialize(cut(inner, "fine", "zero"))
    last = rows.join(at, ["source_key", "fine"]).select("source_key", "doc_id", "rank", "size", "missing", "words_before")
    each = last.groupBy("source_key", "rank", "doc_id").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"), F.first("words_before").alias("before"))
    run = each.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("source_key").orderBy("rank", "doc_id")))
    # the document at the border is taken if that comes nearer to the target
    border = run.where("upto - words / 2 <= missing").groupBy("source_key").agg(F.max("rank").alias("last_rank"))
    ends = materialize(at.select("source_key", "fine").join(border, "source_key", "left"))
    out = rows.drop("cell").withColumnRenamed("fine", "at").join(ends, "source_key", "left")
    taken = (F.col("missing") > 0) & (F.col("size") > 0) & F.coalesce((F.col("at") < F.col("fine")) | ((F.col("at") == F.col("fine")) & (F.col("rank") <= F.col("last_rank"))), F.lit(False))
    chosen = out.withColumn("copies", (F.col("whole") + taken.cast("int")).cast("long")).select("doc_id", "source", "row_key", "size", "source_size", "target", "copies")
    kept = every.where("sure").select("doc_id", "source", "row_key", "size", "source_size", "target", (F.col("whole") + (F.col("size") > 0).cast("int")).cast("long").alias("copies"))
    return chosen.union(kept).withColumn("taken", F.col("size") * F.col("copies"))
