"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked by a byte-position inverted index with count filtering.

Two fingerprints that differ in at most d bits share at least 8 - d of their 8 positional bytes, so count filtering keeps
pairs whose tally of shared positional bytes reaches 8 - d. Postings of one positional byte hold 1/256 of all rows, and
tallying those would make a square of them; the index is keyed by (8 - d)-subsets of positional bytes instead, which
holds exactly the pairs whose tally reaches the minimum: the key implies the filter, and the tally of a pair that meets
under it is taken again only because two subsets may mix to one key. Rows with
equal fingerprints are one posting. A posting list that many fingerprints share is compared in blocks of numpy rows, in
one task up to `block` entries, and beyond that by tiles of block pairs dealt over tasks; only a spanning forest leaves.

Defined results: null and empty texts have fingerprint zero, linked like any other; a row without doc_id gets its
fingerprint and component but never names one; repeated rows are linked; a bit set in exactly half of the shingles is 0; very long
texts are hashed whole; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix
from .components import connected_components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Bit set where more than half of the shingles' XXH64 have it; A-Z are lower-cased, words split at ASCII space."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(flat, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - width] + 1]).tolist()
    ends = ends[width - 1 :].tolist()
    totals, step = np.zeros(64, np.int64), 1 << 15
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), step):
        h = np.array([digest(flat[a:b], seed) for a, b in zip(starts[i : i + step], ends[i : i + step])], "<u8")
        totals += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(starts), bitorder="little").view("<u8")[0])


def _printer(width: int, seed: int):
    def run(batches):
        for batch in batches:
            col = batch.column(1).cast(pa.binary()).fill_null(b"")
            out = np.fromiter((fingerprint(t.as_py(), width, seed) for t in col), np.uint64, len(col))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row of docs (doc_id, text)."""
    return docs.select("doc_id", "text").mapInArrow(_printer(width, seed), "doc_id long, fp long")


def _keys(differ: int):
    """Posting keys: one for each (8 - differ)-subset of positional bytes, mixed to 64 bits; equal keys of unequal subsets only cost a check."""
    masks = [np.uint64(sum(255 << 8 * p for p in c)) for c in combinations(range(8), 8 - differ)]

    def run(batches):
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            keys = np.concatenate([mix((f & m) ^ np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))) for i, m in enumerate(masks)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.tile(f.view(np.int64), len(masks)))], ["key", "fp"])

    return run


def _within(a: np.ndarray, b: np.ndarray, differ: int) -> np.ndarray:
    """The pairs of a and b that the count filter and then the exact check keep: positions in a, in b."""
    x = a[:, None] ^ b[None, :]
    tally = (x[..., None].view(np.uint8) == 0).sum(-1)
    return np.nonzero((tally >= 8 - differ) & (np.bitwise_count(x) <= differ))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) that join what the pairs a, b join: each node to the least of its component."""
    nodes, pos = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, root = pos[: len(a)], pos[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _linker(differ: int, chunk: int = 512):
    """Links within runs of equal keys; the input is sorted by key, and a run may go on in the next batch."""

    def links(f: np.ndarray):
        f = np.unique(f)
        for i in range(0, len(f), chunk):
            us, vs = [], []
            for j in range(i, len(f), chunk):
                a, b = _within(f[i : i + chunk], f[j : j + chunk], differ)
                us.append(f[i : i + chunk][a])
                vs.append(f[j : j + chunk][b])
            u, v = np.concatenate(us), np.concatenate(vs)
            yield forest(u[u < v], v[u < v])

    def run(batches):
        rest_k, rest_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            k = np.concatenate([rest_k, batch.column(0).to_numpy()])
            f = np.concatenate([rest_f, batch.column(1).to_numpy().view(np.uint64)])
            if not len(k):
                continue
            last = int(np.searchsorted(k, k[-1])) if (np.diff(k) >= 0).all() else int(np.flatnonzero(k != k[-1])[-1] + 1)
            yield from emit(k[:last], f[:last])
            rest_k, rest_f = k[last:], f[last:]
        yield from emit(rest_k, rest_f)

    def emit(k, f):
        if len(k) < 2:
            return
        edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        size = np.diff(edge)
        us, vs = [], []
        at = edge[:-1][size == 2]  # most runs are pairs
        x, y = f[at], f[at + 1]
        d = np.bitwise_count(x ^ y)
        near = (d <= differ) & (d > 0)
        us.append(np.maximum(x, y)[near])
        vs.append(np.minimum(x, y)[near])
        for a, n in zip(edge[:-1][size > 2], size[size > 2]):
            for u, v in links(f[a : a + n]):
                us.append(u)
                vs.append(v)
        u, v = np.concatenate(us), np.concatenate(vs)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def _tile(differ: int, chunk: int = 512):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = key[1], key[2]
        a = np.unique(pdf["fp"][pdf["block"] == i].to_numpy().view(np.uint64))
        b = np.unique(pdf["fp"][pdf["block"] == j].to_numpy().view(np.uint64))
        us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for s in range(0, len(a), chunk):
            for t in range(0, len(b), chunk):
                x, y = _within(a[s : s + chunk], b[t : t + chunk], differ)
                u, v = forest(a[s : s + chunk][x], b[t : t + chunk][y])
                us.append(u)
                vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs))
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def fingerprint_links(prints: DataFrame, differ: int = 4, block: int = 4096) -> DataFrame:
    """(u, v): a graph on the distinct values of prints.fp whose components are those of all pairs within `differ` bits (0 to 7)."""
    # a fixed number of partitions: a few bytes a fingerprint become 70 keys, which small merged partitions would make in few tasks
    distinct = prints.select("fp").distinct().repartition(2 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = distinct.mapInArrow(_keys(differ), "key long, fp long")
    counts = keys.groupBy("key").count()
    hot = materialize(counts.where(F.col("count") > block))
    if hot.isEmpty():
        cold, tiles = keys, None
    else:
        cold = keys.join(hot, "key", "left_anti")
        dealt = keys.join(hot, "key").withColumn("n", F.ceil(F.col("count") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        dealt = dealt.withColumn("o", other).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "fp")
        tiles = dealt.groupBy("key", "i", "j").applyInPandas(_tile(differ), "u long, v long")
    edges = cold.repartition("key").sortWithinPartitions("key").mapInArrow(_linker(differ), "u long, v long")
    return (edges.union(tiles) if tiles is not None else edges).distinct()


def simhash_components(docs: DataFrame, width: int = 4, differ: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row: component_id is the smallest doc_id reachable by links."""
    prints = materialize(fingerprints(docs, width, seed))
    linked = connected_components(fingerprint_links(prints, differ))
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    # written first: the join below is then between plain exchanges, of which Spark splits those that a large component fills
    of = materialize(first.join(linked.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), "first_id"))
    least = materialize(of.groupBy("component").agg(F.min("first_id").alias("component_id")))
    named = of.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")
