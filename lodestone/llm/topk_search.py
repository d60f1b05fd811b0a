"""Exact top-k search: tiles of queries times tiles of candidates as integer matrix products, partial selection per tile, a tree of merges.

Queries and candidates are packed into tiles of rows; each candidate tile meets each query tile once. A tile
of products keeps each query's k best (ties to smaller ids) by partial selection, and the lists of a query merge by
groups of `fan` tiles, level by level, until one is left, so no task ever holds more than fan * k entries of a query.

Defined results: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part; a row
whose vec_id repeats is no candidate for queries of that vec_id, and of query rows that repeat one the least vector asks;
vectors of unequal length score over the shorter; empty vectors score 0; scores beyond 64 bits are held at their ends;
empty tables give no rows; columns other than those named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

EXACT = float(1 << 53)


def _packer(scale: int, rows: int):
    """Rows (id, vector of doubles) to tiles: ids, integer components as doubles (exact below 2**53), their count."""

    def run(batches):
        for batch in batches:
            by_length: dict[int, list] = {}
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i is not None and v.is_valid and v.values.null_count == 0:
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                    if np.isfinite(x).all():
                        by_length.setdefault(len(x), []).append((i, np.floor(x * scale)))
            for d, found in by_length.items():
                for a in range(0, len(found), rows):
                    part = found[a : a + rows]
                    ids, x = np.array([p[0] for p in part], np.int64), np.array([p[1] for p in part], np.float64).reshape(len(part), d)
                    tile = int(np.int64(hash((int(ids.min()), int(ids.max()), len(ids), d)) & 0x7FFFFFFFFFFFFFFF))
                    yield pa.RecordBatch.from_arrays([pa.array([tile], pa.int64()), pa.array([d], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["tile", "d", "ids", "x"])

    return run


def _asker(scale: int, rows: int):
    """Rows (id, vector, part) to tiles of one part and vector length each."""
    pack_up = _packer(scale, rows)

    def run(batches):
        for batch in batches:
            part = batch.column(2)
            for p in pc.unique(part).to_pylist():
                own = batch.filter(pc.equal(part, p)).select([0, 1])
                for t in pack_up([own]):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int64()), *[t.column(i) for i in (1, 2, 3)]], ["part", "q_d", "q_ids", "q_x"])

    return run


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows of integral doubles."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if not d or not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = np.abs(a).max() * np.abs(b).max() * d
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(v) for v in r] for r in a], object) @ np.array([[int(v) for v in r] for r in b], object).T
    return np.array([[max(-(1 << 63), min((1 << 63) - 1, v)) for v in r] for r in exact], np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at].astype(object) if len(at) and scores[at].min() == -(1 << 63) else -scores[at]))[:k]]


def _multiply(k: int, step: int = 256):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                c = {n: batch.column(i)[r].as_py() for i, n in enumerate(batch.schema.names)}
                q, ids = np.frombuffer(c["q_ids"], np.int64), np.frombuffer(c["ids"], np.int64)
                a, b = np.frombuffer(c["q_x"]).reshape(len(q), c["q_d"]), np.frombuffer(c["x"]).reshape(len(ids), c["d"])
                out = []
                for s in range(0, len(q), step):
                    p = products(a[s : s + step], b)
                    for row, query in zip(p, q[s : s + step]):
                        other = np.flatnonzero(ids != query)
                        at = other[best(row[other], ids[other], k)]
                        out.append((np.full(len(at), query), ids[at], row[at]))
                cols = [np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)] or [np.zeros(0, np.int64)] * 3
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(np.full(len(cols[0]), c["tile"]), pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["query_id", "tile", "vec_id", "score"])

    return run


def topk_search(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, tile_rows: int = 4096, fan: int = 64, ask_bytes: int = 64 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of vectors (vec_id, embedding) for each row of queries, exactly.

    Queries go in groups of at most about `ask_bytes` of packed tiles; a group is sent to all tasks, and the candidates stream
    past it as they lie, so the candidates are written once and never shuffled, however many queries there are.
    """
    kinds = "tile long, d int, ids binary, x binary"
    x = F.col("embedding").cast("array<double>")
    tiles = materialize(vectors.select("vec_id", x.alias("embedding")).mapInArrow(_packer(scale, tile_rows), kinds))
    lists = max(1, tiles.count())
    sound = queries.select("vec_id", x.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    asked = materialize(sound.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("bytes", 8 * F.size("embedding") + 8))
    n, size = asked.agg(F.count("*"), F.sum("bytes")).first()
    groups = max(1, math.ceil((size or 0) / ask_bytes))
    parts = groups * max(1, math.ceil((n or 0) / groups / tile_rows))
    # tiles of a group: queries of one hash part are packed in one task
    packed = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts))).repartition(parts, "part").select("vec_id", "embedding", "part")
    q = materialize(packed.mapInArrow(_asker(scale, tile_rows), "part long, q_d int, q_ids binary, q_x binary"))
    top = None
    for group in range(groups):
        own = q.where(F.pmod("part", F.lit(groups)) == group).drop("part").withColumn("all", F.lit(1))
        pairs = tiles.withColumn("all", F.lit(1)).join(F.broadcast(own), "all").select("tile", "d", "ids", "x", "q_d", "q_ids", "q_x")
        found = pairs.mapInArrow(_multiply(k), "query_id long, tile long, vec_id long, score long")
        found = materialize(found) if groups > 1 else found
        top = found if top is None else top.union(found)
    return merge_tree(top, k, fan, lists)


def merge_tree(top: DataFrame, k: int, fan: int, lists: int) -> DataFrame:
    entry = F.struct((-F.col("score").cast("decimal(20,0)")).alias("s"), F.col("vec_id").alias("v"))
    level, left = top.select("query_id", "tile", entry.alias("e")), lists
    while True:
        left = -(-left // fan)
        node = F.pmod(F.xxhash64("tile"), F.lit(left)) if left > 1 else F.lit(0).cast("long")
        merged = level.withColumn("tile", node).groupBy("query_id", "tile").agg(F.slice(F.array_sort(F.collect_list("e")), 1, k).alias("es"))
        if left <= 1:
            return merged.select("query_id", F.posexplode("es").alias("p", "e")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.v").alias("vec_id"), (-F.col("e.s")).cast("long").alias("score"))
        level = merged.select("query_id", "tile", F.explode("es").alias("e"))
