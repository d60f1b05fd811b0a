"""SimHash near-dedup at a similarity bound: wide fingerprints, an inverted index of positional bytes, exact verification.

Pairs with a Jaccard similarity of 0.8 on word shingles differ in about 15 of 100 fingerprint bits, too many for the
guarantee that 64-bit fingerprints within a few bits have. Fingerprints are therefore BITS wide here, and the minimum
of shared positional bytes is calibrated in place of guaranteed: of many subsets of `deep` positional bytes, as many
are indexed as a pair at the bound shares one of with probability `recall` (a pair that shares a subset has a tally of
at least `deep` bytes; closer pairs miss by far less). `deep` grows with the logarithm of the number of texts, so
that chance meetings stay bounded, up to four bytes (some four billion texts; past that they grow); a bound of similarity so low that
8192 subsets do not give the recall is refused. A key that very many fingerprints share is dealt to pairs of blocks. What meets under a key is first compared on CHECK bits that no key covers; a forest
of what is left gives candidate groups. Within a group, pairs whose whole fingerprints are close enough are verified by
their exact shingle sets, in tiles of block pairs; only a forest leaves, so groups of copies cost rows in proportion.

A text's set holds its runs of `width` words (A-Z lower-cased, split at ASCII space; a text of fewer words is one run).
Equal word sequences are one node.

Defined results: null and empty texts are one node; a row without doc_id has no part in it; rows of one doc_id are judged
by their texts, each by itself; a very long text is hashed in parts, whole; an empty table gives no rows; other columns, whatever
their names, are not looked at.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, mix, pack, sorted_runs, text_of, unpack
from .components import connected_components
from .simhash import forest
from .substring_dedup import powers, window_hashes, word_hashes, words_of

PART_BYTES = 2 << 20  # of text hashed at once
BITS, CHECK = 640, 128  # the first CHECK bits are for comparing, the others are indexed
BYTES = BITS // 8
KEYED = np.arange(CHECK // 8, BYTES)
SEEDS = mix(np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: The bits of a byte in a 64-bit word, one a byte.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def wide_fingerprints(shingles: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 13) -> np.ndarray:
    """One row of BYTES bytes for each run of sizes[i] > 0 shingles: bits that more than half of its shingles' hashes set."""
    ends = np.cumsum(sizes)
    total = np.zeros((len(sizes), BITS), np.int32)
    for a in range(0, len(shingles), chunk):
        part = shingles[a : a + chunk]
        h = mix(part[:, None] ^ SEEDS[None, :]).view(np.uint8)
        doc = np.searchsorted(ends, np.arange(a, a + len(part)), "right")
        # sums of at most 255 rows in byte lanes, then of lanes a document
        cut = np.unique(np.concatenate([np.arange(0, len(part), 255), np.flatnonzero(np.diff(doc)) + 1]))
        lanes = np.add.reduceat(SPREAD[h], cut, axis=0).view(np.uint8)
        np.add.at(total, doc[cut], lanes.astype(np.int32))
    return np.packbits(total * 2 > sizes[:, None], axis=1, bitorder="little")


def flip_rate(similarity: float) -> float:
    """Share of fingerprint bits in which two sets of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_flips(bits: int, rate: float, missed: float) -> int:
    """The least number of differing bits that pairs at `rate` exceed with a probability of at most `missed`."""
    upto = 0.0
    for k in range(bits + 1):
        upto += math.exp(math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(rate) + (bits - k) * math.log(1 - rate))
        if upto >= 1 - missed:
            return k
    return bits


@cache
def subsets(deep: int, similarity: float, recall: float, trials: int = 4000, most: int = 8192) -> np.ndarray:
    """Rows of `deep` byte positions: as many, evenly spread, as pairs at the bound share one of with probability `recall` (in trials)."""
    rng = np.random.default_rng([deep, 12])
    shared = rng.random((trials, len(KEYED))) < (1 - flip_rate(similarity)) ** 8
    missed, out = np.ones(trials, bool), []
    seen: set = set()
    while missed.mean() > 1 - recall and len(out) < most:
        for part in rng.permutation(len(KEYED))[: len(KEYED) // deep * deep].reshape(-1, deep):
            if (name := tuple(sorted(part.tolist()))) not in seen:
                seen.add(name)
                out.append(name)
                missed &= ~shared[:, list(name)].all(1)
    if missed.mean() > 1 - recall:
        raise ValueError(f"{most} subsets of {deep} bytes find only {1 - missed.mean():.3f} of pairs at similarity {similarity}")
    return KEYED[np.array(out)]


def depth(n: int, similarity: float, recall: float, most: float = 2000.0) -> int:
    """Bytes a key, so that a text meets at most about `most` unrelated ones among n."""
    deep = 2
    while deep < 4 and n * len(subsets(deep, similarity, recall)) / 256.0**deep > most:
        deep += 1
    return deep


def _parts(batch: pa.RecordBatch):
    """Slices of the batch of about PART_BYTES of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False))
    cuts = [0, *(np.flatnonzero(np.diff(size // PART_BYTES)) + 1), batch.num_rows]
    return [batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:]) if b > a]


def _hashed(part: pa.RecordBatch, width: int):
    """Hash of each text's words, window hashes of all words, first word of each text (one more at the end)."""
    data, offsets = text_of(part)
    data = LOWER[data]
    starts, ends, first = words_of(data, offsets)
    words = word_hashes(data, starts, ends)
    up, down = powers("word", len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    node = mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))
    return node, window_hashes(words, width), first


def _set(node: int, windows: np.ndarray, a: int, b: int, width: int) -> np.ndarray:
    """Distinct shingles of words a to b; a text of at most `width` words has one, that of all its words."""
    return np.unique(windows[a : b - width + 1]) if b - a > width else np.array([node], np.uint64)


def _sets(part: pa.RecordBatch, width: int):
    node, windows, first = _hashed(part, width)
    return node, [_set(node[i], windows, a, b, width) for i, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist()))]


def _printer(width: int):
    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                node, sets = _sets(part, width)
                prints = wide_fingerprints(np.concatenate(sets), np.array([len(s) for s in sets]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(list(map(bytes, prints)), pa.binary())], ["doc_id", "row_key", "node", "fp"])

    return run


def _namer(width: int):
    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                node, _, _ = _hashed(part, width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(node.view(np.int64)), part.column(1)], ["doc_id", "node", "text"])

    return run


def _setter(width: int):
    def run(batches):
        for batch in batches:
            for part in _parts(batch):
                node, sets = _sets(part, width)
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["node", "shingles"])

    return run


def _poster(sets: np.ndarray, buckets: int, rows: int = 4096, many: int = 256):
    """Posts each fingerprint's CHECK bits under each of its keys, dealt to hash buckets as compressed arrays.

    The rows of a key that more than `many` of the rows at hand share leave in a bucket of their own, below zero; a mark in the key's
    bucket says so.
    """
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    salts = mix(np.arange(1, len(sets) + 1, dtype=np.uint64))

    def run(batches):
        from pyspark import TaskContext

        alone = -1 - (TaskContext.get().partitionId() << 20)
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                fp = np.stack([np.frombuffer(x, np.uint8) for x in batch.column(0).slice(a, rows).to_pylist()])
                check = np.ascontiguousarray(fp[:, : CHECK // 8]).view(np.uint64)
                held = np.zeros((len(fp), len(sets)), np.uint64)
                for c in range(sets.shape[1]):
                    held = (held << np.uint64(8)) | fp[:, sets[:, c]]
                k, of = mix(held ^ salts[None, :]).ravel(), np.repeat(np.arange(len(fp)), len(sets))
                order = np.argsort(k)
                k, of = k[order], of[order]
                edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
                size = np.diff(edge)
                hot, marks = np.repeat(size > many, size), k[edge[:-1][size > many]]
                own = pack(k[hot], check[of[hot]].ravel()) if len(marks) else None
                k, of = k[~hot], of[~hot]
                names = np.arange(buckets + 1, dtype=np.uint64)
                cut, mark = np.searchsorted(k >> shift, names), np.searchsorted(marks >> shift, names)
                full = np.flatnonzero(np.diff(cut) + np.diff(mark))
                blobs = [pack(np.diff(k[cut[i] : cut[i + 1]], prepend=np.uint64(0)), check[of[cut[i] : cut[i + 1]]].ravel(), marks[mark[i] : mark[i + 1]]) for i in full]
                to = full.astype(np.int64).tolist()
                if own is not None:
                    blobs.append(own)
                    to.append(alone)
                    alone -= 1
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return run


def name_of(check: np.ndarray) -> np.ndarray:
    """A 64-bit name of each row of CHECK bits."""
    out = np.zeros(len(check), np.uint64)
    for c in range(check.shape[1]):
        out = mix(out ^ check[:, c])
    return out


def near_rows(check: np.ndarray, names: np.ndarray, other: np.ndarray, other_names: np.ndarray, most: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """A forest on the names of rows of check and rows of other that differ in at most `most` bits."""
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for i in range(0, len(check), chunk):
        for j in range(0, len(other), chunk):
            d = sum(np.bitwise_count(check[i : i + chunk, c][:, None] ^ other[j : j + chunk, c][None, :]).astype(np.int16) for c in range(check.shape[1]))
            p, q = np.nonzero(d <= most)
            u, v = forest(names[i : i + chunk][p], other_names[j : j + chunk][q])
            us.append(u)
            vs.append(v)
    return forest(np.concatenate(us), np.concatenate(vs))


def close_runs(k: np.ndarray, check: np.ndarray, most: int, hot: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest on the names of rows that share a key and differ in at most `most` bits, of keys of at most `hot` distinct rows that are not in marks; and the places of the other rows. k is sorted."""
    names = name_of(check)
    if not len(k):
        return names, names, np.zeros(0, np.int64)
    edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
    us, vs = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    # short runs by shifts of the whole array, long ones by themselves
    run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    size = np.diff(edge)
    marked = np.isin(k[edge[:-1]], marks)
    short = ((size <= 16) & ~marked)[run]
    for by in range(1, min(16, int(size.max(initial=1)))):
        at = np.flatnonzero((run[:-by] == run[by:]) & short[:-by])
        near = sum(np.bitwise_count(check[at, c] ^ check[at + by, c]).astype(np.int16) for c in range(check.shape[1])) <= most
        us.append(names[at[near]])
        vs.append(names[at[near] + by])
    left = []
    big = (size > 16) | marked
    for a, b, mark in zip(edge[:-1][big].tolist(), edge[1:][big].tolist(), marked[big].tolist()):
        _, one = np.unique(names[a:b], return_index=True)
        if mark or len(one) > hot:
            left.append(a + one)
            continue
        u, v = near_rows(check[a:b][one], names[a:b][one], check[a:b][one], names[a:b][one], most)
        us.append(u)
        vs.append(v)
    return *forest(np.concatenate(us), np.concatenate(vs)), np.concatenate(left) if left else np.zeros(0, np.int64)


MET = "u long, v long, hot long, bits binary"


def _meeter(most: int, hot: int):
    """Of a bucket: edges (u, v) of its keys, and of those that more than `hot` fingerprints share the rows (hot: the key, bits), to be dealt to blocks."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            k, c = (np.concatenate(x) for x in zip(*[unpack(blob, np.uint64, np.uint64) for blob in pdf["blob"]]))
            c = c.reshape(-1, CHECK // 64)
            return pd.DataFrame({"u": None, "v": None, "hot": k.view(np.int64), "bits": [x.tobytes() for x in c]})
        ks, cs, marks = [], [], []
        for blob in pdf["blob"]:
            d, c, m = unpack(blob, np.uint64, np.uint64, np.uint64)
            ks.append(np.cumsum(d, dtype=np.uint64))
            cs.append(c.reshape(-1, CHECK // 64))
            marks.append(m)
        k, c = np.concatenate(ks), np.concatenate(cs)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        u, v, left = close_runs(k, c, most, hot, np.concatenate(marks))
        n = len(left)
        return pd.DataFrame({
            "u": pd.array([*u.view(np.int64).tolist(), *[None] * n], "Int64"), "v": pd.array([*v.view(np.int64).tolist(), *[None] * n], "Int64"),
            "hot": pd.array([*[None] * len(u), *k[left].view(np.int64).tolist()], "Int64"), "bits": [*[None] * len(u), *[x.tobytes() for x in c[left]]],
        })

    return run


def _bits(blobs: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint64) for x in blobs])


def _block_pairs(most: int):
    """Runs of rows (key, i, j, block, bits) to a forest of what is close between blocks i and j of a key."""

    def run(batches):
        for (_, i, j), batch in sorted_runs(batches, 3):
            block, c = batch.column(3).to_numpy(), _bits(batch.column(4).to_pylist())
            names = name_of(c)
            a, b = block == i, block == j
            u, v = near_rows(c[a], names[a], c[b], names[b], most)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def meetings(posted: DataFrame, most: int, hot: int = 1024) -> DataFrame:
    """(u, v): a graph on names of fingerprints whose components are those of all that share a key and are close; posted: see _poster().

    Keys of up to `hot` fingerprints are settled in their bucket. The fingerprints of others are dealt to blocks of that size, and each
    pair of blocks is a task's run; a forest leaves each.
    """
    met = materialize(posted.groupBy("bucket").applyInPandas(_meeter(most, hot), MET))
    edges = met.where("u IS NOT NULL").select("u", "v")
    rows = met.where("hot IS NOT NULL").select(F.col("hot").alias("key"), "bits").distinct()
    sizes = materialize(rows.groupBy("key").agg(F.ceil(F.count("*") / hot).cast("int").alias("blocks")))
    if sizes.isEmpty():
        return edges.distinct()
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("bits", "key"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "bits")
    more = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_pairs(most), "u long, v long")
    return edges.union(more).distinct()


def _verifier(similarity: float, most: int):
    """Of runs of equal (component, i, j): a forest of the pairs of blocks i and j whose shingle sets are similar enough."""

    def tile(key, batch: pa.RecordBatch):
        _, i, j = key
        col = {n: batch.column(x) for x, n in enumerate(batch.schema.names)}
        node, block = col["node"].to_numpy(), col["block"].to_numpy()
        fp = np.stack([np.frombuffer(x, np.uint64) for x in col["fp"].to_pylist()])
        sets = [s.values.to_numpy() for s in col["shingles"]]
        n = np.array([len(s) for s in sets])
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        us, vs = [], []
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        for x in left.tolist():
            other = right[right > x] if i == j else right
            d = sum(np.bitwise_count(fp[other, c] ^ fp[x, c]).astype(np.int16) for c in range(fp.shape[1]))
            able = np.minimum(n[other], n[x]) + 1e-9 >= similarity * np.maximum(n[other], n[x])
            for y in other[(d <= most) & able].tolist():
                if find(x) == find(y):
                    continue
                common = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if common + 1e-9 >= similarity * (n[x] + n[y] - common):
                    root[max(find(x), find(y))] = min(find(x), find(y))
                    us.append(node[x])
                    vs.append(node[y])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    def run(batches):
        for key, batch in sorted_runs(batches, 3):
            yield tile(key, batch)

    return run


def similar_components(docs: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.995, block: int = 256, block_bytes: int = 16 << 20, hot: int = 1024, many: int = 256) -> DataFrame:
    """(doc_id, row_key, component_id) of every row of docs (doc_id, text) with a doc_id: the smallest doc_id reachable by links; row_key is xxhash64 of the text."""
    docs = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text").where("doc_id IS NOT NULL")
    rows = materialize(docs.mapInArrow(_printer(width), "doc_id long, row_key long, node long, fp binary"))
    nodes = materialize(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp")))
    rate = flip_rate(similarity)
    sets = subsets(depth(nodes.count(), similarity, recall), similarity, recall)
    posted = nodes.select("fp").mapInArrow(_poster(sets, bucket_count(docs), many=many), "bucket long, blob binary")
    met = meetings(posted, most_flips(CHECK, rate, 1e-3), hot)
    group = materialize(connected_components(materialize(met)))

    @F.pandas_udf("long")
    def name(fp: pd.Series) -> pd.Series:
        return pd.Series(name_of(np.stack([np.frombuffer(x, np.uint64)[: CHECK // 64] for x in fp])).view(np.int64)) if len(fp) else pd.Series([], dtype="int64")

    # groups are of fingerprints; nodes of one fingerprint are a group too
    named = materialize(nodes.withColumn("name", name("fp")))
    grouped = materialize(named.join(group.withColumnRenamed("node", "name"), "name", "left").select("node", "first_id", "fp", F.coalesce("component", "name").alias("group")))
    # counts are written before they join, so that the join is between plain exchanges, of which Spark splits a large group's
    held = materialize(grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group"))
    wanted = materialize(grouped.join(held, "group"))
    # texts of nodes in groups: of each node the row of its first document
    texts = docs.select("doc_id", "text").mapInArrow(_namer(width), "doc_id long, node long, text string")
    at = wanted.select("node", F.col("first_id").alias("doc_id"))
    found = texts.join(at.hint("shuffle_hash"), ["doc_id", "node"], "left_semi").select("node", "text")
    shingles = materialize(found.mapInArrow(_setter(width), "node long, shingles array<long>").dropDuplicates(["node"]))
    full = materialize(wanted.join(shingles, "node"))
    size = materialize(full.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(8 * F.size("shingles")) / block_bytes)).cast("int").alias("blocks")))
    dealt = full.join(size, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.select("group", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "fp", "shingles")
    linked = tiles.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(_verifier(similarity, most_flips(BITS, rate, 1e-4)), "u long, v long")
    component = connected_components(materialize(linked))
    of = materialize(nodes.join(component, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "first_id"))
    least = materialize(of.groupBy("component").agg(F.min("first_id").alias("component_id")))
    answer = materialize(of.join(least, "component").select("node", "component_id"))
    return rows.select("doc_id", "row_key", "node").join(answer, "node").select("doc_id", "row_key", "component_id")
