"""Boxes that are near each other, on a grid, and what grows from that: clusters, merged and grown regions.

A page with very many boxes is no single group: boxes are dealt to cells. Cells have levels, each twice as wide as the one below; a box is at
the level whose cells are as wide as its longer side, so that it touches at most four of them, and stands in the cells of every
coarser level as well. A pair meets at the coarser of its two levels, and of the cells it shares there it is taken in the one that
holds the lower left corner of what the boxes have in common, so once. That pays for pages with many boxes only: those of few are
compared whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import box_gap
from ..session import many, written

#: Pages of so many boxes at most are compared whole: that bounds what a task holds of a page.
WHOLE = 64


def _side(c: str, i: int) -> Column:
    return F.get(F.col(c), F.lit(i))


def _usable(c: str) -> Column:
    return F.col(c).isNotNull() & (F.size(c) == 4) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))) & (_side(c, 0) <= _side(c, 2)) & (_side(c, 1) <= _side(c, 3))


def _longer(c: str, more: float) -> Column:
    return F.greatest(_side(c, 2) - _side(c, 0), _side(c, 3) - _side(c, 1)) + more


def _placed(df: DataFrame, c: str, grow: float, cell: float, top: int, name: str) -> DataFrame:
    """df in every cell (level, cx, cy) of its own level and those above; `name`: its own level."""
    own = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(_longer(c, 2 * grow), F.lit(1e-9)) / cell))).cast("int")
    rows = df.withColumn(name, own).withColumn("level", F.explode(F.sequence(F.col(name), F.lit(top))))
    wide = F.pow(F.lit(2.0), F.col("level")) * cell

    def cells(low: int, high: int) -> Column:
        return F.explode(F.sequence(F.floor((_side(c, low) - grow) / wide), F.floor((_side(c, high) + grow) / wide)))

    return many(rows.withColumn("cx", cells(0, 2)).withColumn("cy", cells(1, 3)))


def grid_candidates(a: DataFrame, b: DataFrame, on: list[str], within: float = 0.0, cell: float | None = None) -> DataFrame:
    """Rows of a (on, ba) with rows of b (on, bb) whose boxes share a cell, each pair once; a superset of grid_join()'s."""
    a, b = a.where(_usable("ba")), b.where(_usable("bb"))
    size = a.select(_longer("ba", 2 * within).alias("s")).union(b.select(_longer("bb", 0.0).alias("s"))).agg(F.avg("s").alias("mean"), F.max("s").alias("most")).first()
    cell = cell or max(size["mean"] or 1.0, 1e-6)
    top = max(0, math.ceil(math.log2(max(size["most"] or 0.0, 1e-9) / cell))) + 1
    left, right = _placed(a, "ba", within, cell, top, "a_level"), _placed(b, "bb", 0.0, cell, top, "b_level")
    both = left.join(right, [*on, "level", "cx", "cy"]).where(F.col("level") == F.greatest("a_level", "b_level"))
    wide = F.pow(F.lit(2.0), F.col("level")) * cell
    corner = [F.floor(F.greatest(_side("ba", i) - within, _side("bb", i)) / wide) for i in (0, 1)]
    return both.where((corner[0] == F.col("cx")) & (corner[1] == F.col("cy"))).drop("level", "cx", "cy", "a_level", "b_level")


def grid_join(a: DataFrame, b: DataFrame, on: list[str], within: float = 0.0, cell: float | None = None, whole: int = WHOLE) -> DataFrame:
    """Rows of a (on, ba) with rows of b (on, bb) whose boxes are at most `within` apart. Broken boxes (null, not four, turned round) meet none.

    cell: the width of the smallest cells; the mean longer side of all boxes unless given. Pages with `whole` times `whole` pairs at
    most are joined as they are, without cells.
    """
    a, b = a.where(_usable("ba")), b.where(_usable("bb"))
    counted = lambda df, x, y: df.select(*on, F.lit(x).alias("x"), F.lit(y).alias("y"))
    pages = counted(a, 1, 0).union(counted(b, 0, 1)).groupBy(*on).agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    large = written(pages.where(F.col("x") * F.col("y") > whole * whole).select(*on))
    near = lambda pairs: pairs.where(box_gap(F.col("ba"), F.col("bb")) <= within)
    if large.isEmpty():
        return near(a.join(b, on))
    some = lambda df, how: df.join(large, on, how)
    return near(some(a, "left_anti").join(some(b, "left_anti"), on)).union(near(grid_candidates(some(a, "left_semi"), some(b, "left_semi"), on, within, cell)))


def split_pages(boxes: DataFrame, on: list[str], most: int = WHOLE) -> tuple[DataFrame, DataFrame | None]:
    """(boxes of pages that have at most `most`, those of all larger pages); None where no page is larger."""
    large = written(boxes.groupBy(*on).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*on))
    return (boxes, None) if large.isEmpty() else (boxes.join(large, on, "left_anti"), boxes.join(large, on, "left_semi"))


def _page_of(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """The number of each row's page, from 0, in a batch sorted by keys that are not null."""
    new = np.zeros(batch.num_rows, bool)
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return np.cumsum(new)


def _whole_pages(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a page does."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        if batch.num_rows:
            page = _page_of(batch, keys)
            last = int(np.searchsorted(page, page[-1]))
            if last:
                yield batch.slice(0, last)
            held = batch.slice(last)
    if held is not None:
        yield held


def clusters_of_pages(boxes: DataFrame, gap: float) -> DataFrame:
    """boxes (doc_id, page, no, bbox) with cluster, as components() of linked_boxes() has it, for pages of few boxes: each is dealt to one task."""
    on, sides, columns = ["doc_id", "page"], ["_x0", "_y0", "_x1", "_y1"], boxes.columns
    shape = T.StructType([*boxes.schema.fields, T.StructField("cluster", boxes.schema["no"].dataType)])

    def clustered(batch: pa.RecordBatch) -> pa.RecordBatch:
        page, no = _page_of(batch, on), batch.column("no")
        x0, y0, x1, y1 = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in sides)
        same, ends = ~np.diff(_page_of(batch, [*on, "no"])).astype(bool), []
        for d in count(1):  # every pair of a page is d rows apart, for some d
            a = np.flatnonzero(page[d:] == page[:-d])
            if not len(a):
                break
            b = a + d
            near = np.maximum.reduce([np.zeros(len(a)), x0[b] - x1[a], x0[a] - x1[b], y0[b] - y1[a], y0[a] - y1[b]]) <= gap
            if d == 1:
                near |= same[a]
            ends.append((a[near], b[near]))
        u, v = (np.concatenate(x) if x else np.empty(0, int) for x in ([e[i] for e in ends] for i in (0, 1)))
        root = np.arange(batch.num_rows)
        while True:
            least, now = np.minimum(root[u], root[v]), root.copy()
            np.minimum.at(now, u, least)
            np.minimum.at(now, v, least)
            now = now[now]
            if (now == root).all():
                break
            root = now
        return pa.RecordBatch.from_arrays([*map(batch.column, columns), no.take(pa.array(root))], names=shape.names)

    dealt = boxes.repartition(*on).sortWithinPartitions(*on, "no")
    each = dealt.select(*columns, *[F.when(_usable("bbox"), _side("bbox", i).cast("double")).alias(c) for i, c in enumerate(sides)])
    return each.mapInArrow(lambda batches: map(clustered, _whole_pages(batches, on)), shape)


def components(nodes: DataFrame, edges: DataFrame, on: list[str], rounds: int = 100) -> DataFrame:
    """(on, no, root): of nodes (on, no) linked by edges (on, u, v) the least number each can reach.

    Every round each node takes the least root of its neighbours, and then its root's root, so that long chains halve; a round is written.
    """
    both = written(edges.select(*on, "u", "v").union(edges.select(*on, F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    now = nodes.select(*on, "no", F.col("no").alias("root")).distinct()
    for _ in range(rounds):
        known = now.select(*on, F.col("no").alias("v"), F.col("root").alias("r"))
        least = both.join(known, [*on, "v"]).groupBy(*on, F.col("u").alias("no")).agg(F.min("r").alias("r"))
        taken = written(now.join(least, [*on, "no"], "left").select(*on, "no", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root")))
        jump = taken.select(*on, F.col("no").alias("root"), F.col("root").alias("far"))
        now = written(taken.join(jump, [*on, "root"], "left").select(*on, "no", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        if now.where("root <> old").isEmpty():
            return now.select(*on, "no", "root")
        now = now.select(*on, "no", "root")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _around(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
    box = F.array(F.min(_side("bbox", 0)), F.min(_side("bbox", 1)), F.max(_side("bbox", 2)), F.max(_side("bbox", 3)))
    return df.groupBy(*by).agg(box.alias("bbox"), *more)


def linked_boxes(boxes: DataFrame, gap: float) -> DataFrame:
    """(doc_id, page, u, v): pairs of boxes (doc_id, page, no, bbox) at most gap apart, u < v."""
    on = ["doc_id", "page"]
    a, b = boxes.select(*on, F.col("no").alias("u"), F.col("bbox").alias("ba")), boxes.select(*on, F.col("no").alias("v"), F.col("bbox").alias("bb"))
    return grid_join(a, b, on, gap).where("u < v").select(*on, "u", "v")


def merged_boxes(boxes: DataFrame, gap: float, rounds: int = 100) -> DataFrame:
    """(doc_id, page, no, bbox) after boxes at most gap apart became one around both, until no two are; the least number stays."""
    on = ["doc_id", "page"]
    now = written(boxes.select(*on, "no", "bbox"))
    for _ in range(rounds):
        near = written(linked_boxes(now, gap))
        if near.isEmpty():
            return now
        root = components(near.select(*on, F.col("u").alias("no")).union(near.select(*on, F.col("v").alias("no"))), near, on)
        now = written(_around(now.join(root, [*on, "no"], "left").withColumn("no", F.coalesce("root", "no")), [*on, "no"]))
    raise RuntimeError(f"boxes did not settle in {rounds} rounds")


def grown_boxes(boxes: DataFrame, labels: DataFrame, reach: float, beside: float, rounds: int = 200) -> DataFrame:
    """(doc_id, page, no, bbox): boxes that took in every label (doc_id, page, bbox) within reach, or level with them and `beside` at most, until none is left to take."""
    on = ["doc_id", "page"]
    now = written(boxes.select(*on, "no", "bbox"))
    words = written(labels.select(*on, F.col("bbox").alias("bb")).where(_usable("bb")))
    for _ in range(rounds):
        near = grid_join(now.select(*on, "no", F.col("bbox").alias("ba")), words, on, max(reach, beside))
        middle = (_side("bb", 1) + _side("bb", 3)) / 2
        aside = F.greatest(_side("bb", 0) - _side("ba", 2), _side("ba", 0) - _side("bb", 2))
        level = middle.between(_side("ba", 1), _side("ba", 3)) & aside.between(0, beside)
        held = (_side("ba", 0) <= _side("bb", 0)) & (_side("ba", 1) <= _side("bb", 1)) & (_side("bb", 2) <= _side("ba", 2)) & (_side("bb", 3) <= _side("ba", 3))
        taken = written(near.where(~held & ((box_gap(F.col("ba"), F.col("bb")) <= reach) | level)).select(*on, "no", F.col("bb").alias("bbox")))
        if taken.isEmpty():
            return now
        now = written(_around(now.union(taken), [*on, "no"]))
    raise RuntimeError(f"regions did not settle in {rounds} rounds")
