"""How filters interact, by a histogram of failure masks.

Each document gets a mask with one bit a filter that it fails, from column expressions. Whether a text stands under a
smaller doc_id as well is known from the smallest doc_id of each text (its SHA-256), a groupBy that combines before it
shuffles; a row passes if it joins that smallest pair of text and doc_id, so a text that a third of all rows share is
never one group of rows. Per part, the rows add up to at most 2^filters cells, and every order of the filters is read off
those cells: what step k removes, are the cells that fail its filter and none of those before. In a share of all orders a
cell falls to each of the filters that it fails alike, which gives the Shapley sum without walking the orders.

Defined results: a null text is empty; a null doc_id is smaller than none and larger than none, so such a row fails no copy
filter and makes none fail; rows that repeat a doc_id with its text are no copies of each other and count each; a null source
and an empty one are one part, ''; several label rows of a doc_id count as good or toxic if one says so, null labels say
nothing; very long texts are whole; an empty table has no parts and so no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
#: The letter of the filter that a text fails if it stands under a smaller doc_id too.
COPY = "E"


def words_of(text: Column) -> Column:
    """Runs of characters that are no ASCII space; an empty text has none."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def quality_filters(text: Column) -> dict[str, Column]:
    """Too short, too repetitive, too many capitals, signs of markup: whether the text fails, by letter."""
    words = words_of(text)
    n = F.size(words)
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, filters: Callable[[Column], dict[str, Column]] = quality_filters) -> tuple[DataFrame, list[str]]:
    """(doc_id, part, mask, n): n alike rows of docs (doc_id, text, source), and the letters of the bits from the lowest on."""
    text = F.coalesce("text", F.lit(""))
    fails = filters(text)
    letters = [*fails, COPY]
    own = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), own.alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    alike = materialize(rows.groupBy("doc_id", "part", "own", "digest").agg(F.count("*").alias("n")))
    first = alike.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    known = alike.where("doc_id IS NOT NULL").join(first.hint("merge"), ["digest", "doc_id"], "left")
    bit = F.when(F.col("is_first").isNull(), 1 << len(fails)).otherwise(0)
    out = known.select("doc_id", "part", (F.col("own") + bit).alias("mask"), "n")
    return out.union(alike.where("doc_id IS NULL").select("doc_id", "part", F.col("own").alias("mask"), "n")), letters


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of failure_masks() and how many of them labels (doc_id, quality, toxic) call good or toxic."""

    def said(c: str) -> Column:
        return F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))

    flags = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    # rows without doc_id go round the join, where they would meet in one task
    joined = masks.where("doc_id IS NOT NULL").join(flags.hint("merge"), "doc_id", "left").select("part", "mask", "n", "good", "toxic")
    rows = joined.union(masks.where("doc_id IS NULL").select("part", "mask", "n", F.lit(None).cast("int"), F.lit(None).cast("int")))
    sums = [F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]]
    return rows.groupBy("part", "mask").agg(*sums)


def order_report(cells: DataFrame, letters: list[str]) -> DataFrame:
    """One row a part of cells (part, mask, n, good, toxic), order of the filters and step; what is counted is in filter_audit()."""
    bits = {x: 1 << i for i, x in enumerate(letters)}
    steps = [("".join(o), k + 1, sum(bits[x] for x in o[:k]), bits[o[k]]) for o in permutations(sorted(letters)) for k in range(len(o))]
    each = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(before).alias("before"), F.lit(bit).alias("bit")) for o, k, before, bit in steps])
    # at most 2^filters cells a part
    rows = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")).withColumn("s", F.explode(each))

    def total(what: Callable[[Column], Column]) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda got, c: got + what(c))

    def where(holds: Callable[[Column], Column], count: str = "n") -> Column:
        return total(lambda c: F.when(holds(c["mask"]), c[count]).otherwise(F.lit(0).cast("long")))

    before, bit = F.col("s.before"), F.col("s.bit")

    def earlier(m: Column) -> Column:
        return m.bitwiseAND(before) != 0

    def own(m: Column) -> Column:
        return m.bitwiseAND(bit) != 0

    def removed(m: Column) -> Column:
        return ~earlier(m) & own(m)

    orders = factorial(len(letters))  # a cell with b failures falls to each of them in orders / b of the orders
    share = total(lambda c: F.when(own(c["mask"]), F.expr(f"{orders}L") * c["n"] / F.bit_count(c["mask"])).otherwise(F.lit(0.0)).cast("long"))
    return rows.select(
        "part", "s.filter_order", "s.step", where(lambda m: ~earlier(m) & ~own(m)).alias("kept"), where(removed).alias("removed"), where(lambda m: earlier(m) & own(m)).alias("redundant"),
        where(lambda m: m == bit).alias("unique_fails"), where(removed, "good").alias("good_lost"), where(removed, "toxic").alias("toxic_lost"), share.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], dict[str, Column]] = quality_filters) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for every part, order and step.

    kept: rows left after the step; removed: rows that go here; redundant: rows that fail its filter but were removed before;
    unique_fails: rows that fail its filter alone; good_lost, toxic_lost: of the removed, those labelled so; shapley: rows its
    filter removes, summed over all orders.
    """
    masks, letters = failure_masks(docs, filters)
    return order_report(mask_cells(masks, labels), letters)
