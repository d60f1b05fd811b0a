"""Exact multi-condition search over chart placements (element_id, chart_no, kind, body, sign, house)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _holds(c: dict) -> Column:
    out = F.col("body") == c["body"]
    if c.get("houses"):
        out &= F.col("house").isin(list(c["houses"]))
    if c.get("signs"):
        out &= F.col("sign").isin(list(c["signs"]))
    return F.coalesce(out, F.lit(False))


def matching_charts(placements: DataFrame, conditions: list[dict], kind: str = "any") -> DataFrame:
    """(element_id, chart_no) of charts in which every distinct body named has a placement that meets one of its conditions."""
    pool = placements if kind == "any" else placements.where(F.col("kind") == kind)
    hit = pool.where(reduce(lambda a, b: a | b, map(_holds, conditions)))
    n = len({c["body"] for c in conditions})
    return hit.groupBy("element_id", "chart_no").agg(F.count_distinct("body").alias("bodies")).where(F.col("bodies") == n).select("element_id", "chart_no")


def find_charts(placements: DataFrame, conditions: list[dict], kind: str = "any", k: int | None = None) -> DataFrame:
    """Matching charts in order, with their placements as a map (signs of a body that has several joined by /) and the total number."""
    found = matching_charts(placements, conditions, kind)
    total = F.broadcast(found.agg(F.count("*").alias("total")))  # one row
    bodies = placements.join(found, ["element_id", "chart_no"]).groupBy("element_id", "chart_no", "kind", "body").agg(F.array_join(F.array_sort(F.collect_set("sign")), "/").alias("sign"))
    full = bodies.groupBy("element_id", "chart_no", "kind").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("body", "sign")))).alias("placements"))
    out = full.crossJoin(total).orderBy("element_id", "chart_no")
    return out.limit(k) if k else out


def house_from(lagna: Column, sign: Column) -> Column:
    """Whole-sign house of a sign number (0 to 11) from the rising one; null without it."""
    return F.pmod(sign - lagna, F.lit(12)) + 1


def placement_text(placements: DataFrame) -> DataFrame:
    """(element_id, chart_no, line) 'sign (house n): bodies; ...' in order of house, charts without houses by sign."""
    group = placements.groupBy("element_id", "chart_no", "sign").agg(F.min("house").alias("house"), F.array_join(F.array_sort(F.collect_set("body")), ", ").alias("bodies"))
    text = F.concat(F.col("sign"), F.when(F.col("house").isNotNull(), F.concat(F.lit(" (house "), F.col("house").cast("string"), F.lit(")"))).otherwise(""), F.lit(": "), F.col("bodies"))
    entry = F.struct(F.coalesce("house", F.lit(99)).alias("h"), "sign", text.alias("text"))
    return group.groupBy("element_id", "chart_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "; ").alias("line"))
