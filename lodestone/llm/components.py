"""Connected components by alternating large-star and small-star steps, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Joins each node's neighbours (larger ones, or all but the least smaller one) to its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        linked = both.where("v > u").join(least.hint("merge"), "u")
        return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return linked.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) of any orderable type to (node, component): the least node of each component, for nodes with an edge.

    Loops, repeated and reversed edges do no harm; rows with a null end are no edges. Each round is written to the
    shared folder, so lineage stays short and nothing reaches the driver but the number of changed edges.
    """
    now = materialize(edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL"))
    nodes = now.select(F.col("u").alias("node")).union(now.select(F.col("v").alias("node"))).distinct()
    now = now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    state = None
    for _ in range(rounds):
        now = materialize(_star(_star(now, True), False))
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (row[0], row[1]) == state or not row[0]:
            break
        state = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
    return nodes.join(found.hint("merge"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
