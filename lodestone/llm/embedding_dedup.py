"""Embedding near-dedup by collision-counting projections.

Unit vectors of a label are projected on `m` random directions. A pair collides on a direction when the one lies in the
window of half width w centred on the other; w is the distance that the similarity threshold allows, so linked pairs
collide on each direction with a known probability of at least about 0.68, unrelated ones far less often. In a tile of
vectors every projection is sorted, each query's windows are found by search and its collisions counted per partner;
pairs that reach the count calibrated for `recall` (a binomial quantile at the threshold) are verified by exact cosine.

Tiles come from cells: labels with more than `cell_rows` vectors are cut by g of further projections into grid cells,
in as many independent tables as the recall asks for, g growing with the logarithm of the label's size. A pair counts in
the first table in which it shares a cell. A cell that many vectors share is dealt out as block pairs. Tiles give the
number of links of each vector and a spanning forest, never pairs. Equal vectors are one vector with a count. Windows on
one direction hold a fifth of all vectors, so walking them entry by entry costs more than comparing ranks with window
ends for a whole block at once, which is how a tile counts; it is the cells that keep tiles small.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do those
whose label is null; vectors of unequal length never link; a vec_id under several labels or with several vectors is a
vector of its own each time; an empty table gives no rows; other columns are ignored; a row without vec_id is left out of others' counts and
answered with no links; rows that repeat a vec_id count each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash import forest

CELL = 1.0  # width of grid cells, in standard deviations of a unit vector's projection times sqrt(dimension)


def directions(d: int, n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((d, n))


def calibrated(threshold: float, m: int, recall: float) -> tuple[float, int]:
    """Half width of the windows, and the least count that pairs at the threshold reach with probability `recall`."""
    w = math.sqrt(2 - 2 * threshold)
    p = math.erf(1 / math.sqrt(2))  # a difference of projections is normal with deviation = distance
    upto, total = 0.0, 0
    while total <= m:
        upto += math.comb(m, total) * p**total * (1 - p) ** (m - total)
        if upto > 1 - recall:
            break
        total += 1
    return w, max(1, total)


def same_cell(distance: float) -> float:
    """Probability that two points whose projections differ by N(0, distance) fall in one cell of a random grid of width CELL."""
    x = np.linspace(-6, 6, 4001)
    density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    return float((np.maximum(0, 1 - np.abs(x) * distance / CELL) * density).sum() * (x[1] - x[0]))


def tables_for(g: int, threshold: float, recall: float) -> int:
    p = same_cell(math.sqrt(2 - 2 * threshold)) ** g
    return 1 if g == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def cells_of(x: np.ndarray, g: int, n: int, seed: int) -> np.ndarray:
    """The cell of each unit vector (row of x) in each of n tables of g projections."""
    if not g:
        return np.zeros((len(x), 1), np.int64)
    p = x @ directions(x.shape[1], g * n, seed + 1) + np.random.default_rng(seed + 2).random(g * n)[None, :] * CELL
    c = np.floor(p.reshape(len(x), n, g) / CELL).astype(np.int64)
    k = np.zeros((len(x), n), np.int64)
    for i in range(g):
        k = k * 1000003 + c[:, :, i]
    return k


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def _cells(levels: dict[int, int], seed: int):
    """rows (rep, label, g, vector, copies) to one row with its unit vector and its cell in each of the tables of level g."""

    def run(batches):
        for batch in batches:
            out = []
            for g, v in zip(batch.column(2).to_pylist(), batch.column(3)):
                x = unit(v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                out.append((cells_of(x[None, :], g, levels[g], seed)[0].tolist(), x.tobytes(), len(x)))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), batch.column(4)], ["rep", "label", "g", "cells", "x", "d", "copies"])

    return run


def ranked(z: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each projection (column) sorted, and the rank of every row in it."""
    kind, out = np.uint16 if len(z) < 1 << 16 else np.uint32, []
    for col in z.T:
        order = np.argsort(col)
        rank = np.empty(len(z), kind)
        rank[order] = np.arange(len(z), dtype=kind)
        out.append((col[order], rank))
    return out


def collisions(queries: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], w: float, since: int = 0) -> np.ndarray:
    """Count, for each query (row of projections) and each ranked row from `since` on, of the projections on which the row is in the query's window."""
    count = np.zeros((len(queries), len(rows[0][1]) - since), np.uint8)
    for q, (line, rank) in zip(queries.T, rows):
        lo, hi = np.searchsorted(line, q - w, "left").astype(rank.dtype), np.searchsorted(line, q + w, "right").astype(rank.dtype)
        # in the window: lo <= rank < hi, as one comparison of differences that wrap around below lo
        count += rank[None, since:] - lo[:, None] < (hi - lo)[:, None]
    return count


def _tile(threshold: float, m: int, recall: float, levels: dict[int, int], seed: int):
    w, least = calibrated(threshold, m, recall)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        label, table, _, d, g, i, j = key
        table, d, g = int(table), int(d), int(g)
        pdf = pdf.sort_values("rep")
        a, b = pdf[pdf["block"] == i], pdf[pdf["block"] == j]
        xa, xb = (np.frombuffer(b"".join(s["x"]), np.float64).reshape(len(s), d) for s in (a, b))
        ra, rb = a["rep"].to_numpy(np.int64), b["rep"].to_numpy(np.int64)
        na, nb = a["copies"].to_numpy(np.int64), b["copies"].to_numpy(np.int64)
        # a pair counts in the first table in which it shares a cell
        ca, cb = (cells_of(x, g, levels[g], seed)[:, :table] for x in (xa, xb))
        z = directions(d, m, seed)
        za, rows = xa @ z, ranked(xb @ z)
        links_a, links_b, us, vs = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), [], []
        for s in range(0, len(a), 256):
            since = s if i == j else 0  # within a block, pairs with earlier vectors have had their turn
            q, c = np.nonzero(collisions(za[s : s + 256], rows, w, since) >= least)
            q, c = q + s, c + since
            keep = ra[q] < rb[c] if i == j else ra[q] != rb[c]
            q, c = q[keep], c[keep]
            cos = np.einsum("ij,ij->i", xa[q], xb[c]) if len(q) <= 1 << 18 else np.concatenate([np.einsum("ij,ij->i", xa[q[t : t + (1 << 18)]], xb[c[t : t + (1 << 18)]]) for t in range(0, len(q), 1 << 18)])
            near = cos >= threshold
            q, c = q[near], c[near]
            if table:
                first = ~(ca[q] == cb[c]).any(1)
                q, c = q[first], c[first]
            np.add.at(links_a, q, nb[c])
            np.add.at(links_b, c, na[q])
            u, v = forest(ra[q], rb[c])
            us.append(u)
            vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        reps, links = np.concatenate([ra, rb, u]), np.concatenate([links_a, links_b, np.zeros(len(u), np.int64)])
        other = np.concatenate([ra, rb, v])
        use = (links > 0) | (reps != other)
        return pd.DataFrame({"label": label, "rep": reps[use], "n": links[use], "other": other[use]})

    return run


def embedding_links(vectors: DataFrame, threshold: float = 0.93, m: int = 32, recall: float = 0.99, cell_rows: int = 2048, block: int = 1024, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, label, embedding)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0) & F.col("vec_id").isNotNull()
    rows = materialize(vectors.select("vec_id", F.col("label").cast("string").alias("label"), x.alias("x"), F.coalesce(good, F.lit(False)).alias("good")))
    copies = materialize(rows.where("good").groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")))
    # a node is a distinct vector of a label, named by a number of its own: one vec_id may stand for several vectors and labels
    copies = materialize(copies.withColumn("rep", F.xxhash64("label", "x", "least")))
    sizes = copies.groupBy("label").agg(F.count("*").alias("n"))
    # unrelated unit vectors differ by about sqrt(2) on a direction
    shrink = -math.log(same_cell(math.sqrt(2)))
    g = F.greatest(F.lit(0), F.ceil(F.log(F.col("n") / cell_rows) / shrink)).cast("int")
    sized = copies.join(sizes.select("label", g.alias("g")), "label")
    levels = {r[0]: tables_for(r[0], threshold, recall) for r in sizes.select(g.alias("g")).distinct().collect()}  # some ten at most
    placed = materialize(sized.select("rep", "label", "g", "x", "copies").mapInArrow(_cells(levels, seed), "rep long, label string, g int, cells array<long>, x binary, d int, copies long"))
    # cells are counted and dealt by names alone; vectors join those that share a cell
    key = ["label", "t", "cell", "d"]
    probes = placed.select("rep", "label", "d", F.posexplode("cells").alias("t", "cell"))
    counts = probes.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    dealt = probes.join(counts, key).withColumn("n", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    dealt = materialize(dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(*key, F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "rep"))
    tiles = dealt.join(placed.select("rep", "g", "x", "copies"), "rep")
    found = materialize(tiles.groupBy("label", "t", "cell", "d", "g", "i", "j").applyInPandas(_tile(threshold, m, recall, levels, seed), "label string, rep long, n long, other long"))
    component = connected_components(found.where("rep <> other").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = materialize(copies.join(component.withColumnRenamed("node", "rep"), "rep", "left").join(links, "rep", "left").select("label", "x", "rep", "least", "copies", "n", F.coalesce("component", "rep").alias("component")))
    first = materialize(of.groupBy("component").agg(F.min("least").alias("component_id")))
    answer = of.join(first, "component").select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("good"))
    out = rows.join(answer, ["label", "x", "good"], "left")
    component_id = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"), (F.col("vec_id") == component_id).alias("kept"))
