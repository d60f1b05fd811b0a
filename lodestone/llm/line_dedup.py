"""Line dedup by a segment-partition edit join.

Lines within `differ` edits of each other share one of `differ` + 1 segments of the shorter line, at a place that the
lengths bound. Each distinct line indexes its segments and probes the substrings that lines of its length and of up to
`differ` fewer characters could have as segments; keys meet in hash buckets as compressed arrays. The lines of a
key that several share are verified by banded bit-parallel edit distance on their texts, in the order of their first
places: what leaves is whether a line has an earlier neighbour, one row a line, never pairs.

A key that very many lines share (a common beginning, say) is dealt to blocks, which settle near copies among
themselves. If few of its lines are left without an earlier neighbour, they go to the key's other blocks and are compared with
the members there. If many are left, the key is refined: the segment is cut out of its lines, and what remains of them, still
within `differ` edits for any pair this key must find, is split into segments again, whose keys cover the segment before.
Each round a key holds more of a line, so lines that differ elsewhere part, and work grows with the lines, not with their
square. Only keys whose lines agree in all but a few characters cannot be refined; their blocks settle nearly all of them,
and lines left over meet the other blocks in groups of bounded size. In the buckets, too, a key that many lines of a task share leaves as rows of its own
with two of them standing for it.

A line goes if an equal line, or one within `differ` edits, starts earlier (smaller doc_id, or the same and an earlier
line); lines are judged on the input. Lines under `least` characters (spaces around them aside) always stay, those
under `near` characters go only as equal lines.

Defined results: null and empty texts stay as they are; a row without doc_id comes after all others, and two such rows tie;
rows of one doc_id tie where equal lines have the same number; a very long text is many lines, a very long line is compared
whole, in blocks of bounded bytes; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, materialize, pack, unpack

BLANK = " \t\r\x0b\x0c"


def line_hash(line: str) -> int:
    return xxhash.xxh64_intdigest(line.encode(), 42)


def segments(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each part of a line, the later ones longer by one where it does not divide."""
    base, over = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = base + (i >= parts - over)
        out.append((at, n))
        at += n
    return out


def keys_of(line: str, differ: int) -> tuple[list[int], list[int]]:
    """Hashes under which a line is indexed, and those it probes. A hash covers the indexed length, the segment's number and text."""
    n, digest = len(line), xxhash.xxh64_intdigest
    index = [digest(line[a : a + m].encode(), n * 64 + i) for i, (a, m) in enumerate(segments(n, differ + 1))]
    probes = []
    for shorter in range(max(1, n - differ), n + 1):
        d = n - shorter
        for i, (a, m) in enumerate(segments(shorter, differ + 1)):
            probes += [digest(line[s : s + m].encode(), shorter * 64 + i) for s in _shifts(a, m, i, d, n, differ)]
    return index, probes


#: Stands for what was cut out of a line; no line holds it.
CUT = "\n"


def _shifts(a: int, m: int, i: int, d: int, n: int, differ: int) -> range:
    """Where segment i (at a, m long) of a text can stand in one of n characters that is d longer and within differ edits."""
    return range(max(a - i, a + d - (differ - i), 0), min(a + i, a + d + (differ - i), n - m) + 1)


def first_views(line: str, key: int, differ: int) -> set[tuple[str, int, bool]]:
    """What remains of a line around the segment that key stands for: the rest, the length of an indexing line's rest, whether this line indexes it."""
    n, out = len(line), set()
    for shorter in range(max(1, n - differ), n + 1):
        for i, (a, m) in enumerate(segments(shorter, differ + 1)):
            for s in _shifts(a, m, i, n - shorter, n, differ):
                if xxhash.xxh64_intdigest(line[s : s + m].encode(), shorter * 64 + i) == key:
                    out.add((line[:s] + CUT + line[s + m :], shorter - m + 1, shorter == n and s == a))
    return out


def next_views(key: int, rest: str, length: int, indexed: bool, differ: int) -> dict[tuple[int, str], tuple[int, bool]]:
    """Of a view: its keys of the next round with what remains then, the length of an indexing rest, and whether this one indexes."""
    n, out = len(rest), {}
    if not length <= n <= length + differ:
        return out
    for i, (a, m) in enumerate(segments(length, differ + 1)):
        seed = (key + (i + 1) * 0x9E3779B97F4A7C15) % (1 << 64)
        for s in _shifts(a, m, i, n - length, n, differ):
            k = xxhash.xxh64_intdigest(rest[s : s + m].encode(), seed)
            view = (k, rest[:s] + CUT + rest[s + m :])
            out[view] = (length - m + 1, (indexed and s == a) or out.get(view, (0, False))[1])
    return out


def edit_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most `most`: common ends come off, the rest by bit vectors over a band of diagonals."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    i, n = 0, len(a)
    step = 64
    while i < n and a[i : i + step] == b[i : i + step] and i + step <= n:
        i += step
    while i < n and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j, n = 0, len(a)
    while j + step < n and a[n - j - step : n - j] == b[len(b) - j - step : len(b) - j]:
        j += step
    while j < n and a[n - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b = a[: n - j], b[: len(b) - j]
    if not a:
        return len(b) <= most
    return _banded(a, b, most)


def _banded(a: str, b: str, most: int) -> bool:
    """Bit-parallel over a band of 2 * most + 1 diagonals: bit d of level e tells that a prefix of b on diagonal d - most is e edits from one of a."""
    width, m, n = 2 * most + 1, len(a), len(b)
    full = (1 << width) - 1
    alive = [((1 << (e + 1)) - 1) << most & full for e in range(most + 1)]  # before the first character of a: e characters of b inserted
    for i in range(m):
        match = 0
        for d in range(width):  # diagonal d stands at character i + d - most of b
            j = i + d - most
            if 0 <= j < n and a[i] == b[j]:
                match |= 1 << d
        new = []
        for e in range(most + 1):
            x = alive[e] & match
            if e:
                x |= alive[e - 1] | alive[e - 1] >> 1  # substitution keeps the diagonal, deletion of a[i] goes one down
                x |= new[e - 1] << 1 & full  # insertion of a character of b goes one up
            new.append(x)
        alive = new
        if not any(alive):
            return False
    d = n - m + most
    return 0 <= d < width and any(x >> d & 1 for x in alive)


def _occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row_key, pos, h, length) of each line that may go."""
    line = F.trim(F.col("line"), F.lit(BLANK))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.select("doc_id", "row_key", "pos", F.xxhash64(line).alias("h"), F.length(line).alias("length")).where(F.col("length") >= least)


def _place(doc_id="doc_id", pos="pos"):
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(pos).alias("pos"))


def _sender(differ: int, near: int, buckets: int, rows: int = 400_000, many: int = 64):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def run(batches):
        from pyspark import TaskContext

        seen: set = set()
        keys, of, kind = array("Q"), array("Q"), array("B")
        alone = -1 - (TaskContext.get().partitionId() << 14)  # buckets below zero hold one task's lines of keys that many share

        def flush():
            nonlocal alone
            k, h, p = np.array(keys), np.array(of), np.array(kind)
            order = np.argsort(k)
            k, h, p = k[order], h[order], p[order]
            edge = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
            size, own = np.diff(edge), None
            if size.max() > many:
                hot = np.repeat(size > many, size)
                own = _once(k[hot], h[hot], p[hot])
                # two lines stand for the key in its bucket, of which the first indexes it if any does
                first = np.lexsort((1 - own[2], own[0]))
                named = own[0][first]
                two = first[np.arange(len(named)) - np.searchsorted(named, named) < 2]
                k, h, p = (np.concatenate([x[~hot], y[two]]) for x, y in zip((k, h, p), own))
                order = np.argsort(k)
                k, h, p = k[order], h[order], p[order]
                own = pack(*own)
            cut = np.searchsorted(k >> shift, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(cut))
            blobs = [pack(np.diff(k[cut[i] : cut[i + 1]], prepend=np.uint64(0)), h[cut[i] : cut[i + 1]], p[cut[i] : cut[i + 1]]) for i in full]
            names = full.astype(np.int64).tolist()
            if own is not None:
                blobs.append(own)
                names.append(alone)
                alone -= 1
            del keys[:], of[:], kind[:]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for batch in batches:
            for t in batch.column(0):
                for line in (t.as_py() or "").split("\n"):
                    line = line.strip(BLANK)
                    if len(line) < near:
                        continue
                    h = line_hash(line)
                    if h in seen:
                        continue
                    seen.add(h)
                    index, probes = keys_of(line, differ)
                    keys.extend(index + probes)
                    of.extend([h] * (len(index) + len(probes)))
                    kind.extend([1] * len(index) + [0] * len(probes))
                    if len(keys) > rows:
                        yield flush()
                        if len(seen) > 100_000:
                            seen.clear()
        if keys:
            yield flush()

    return run


def _once(k: np.ndarray, h: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By key, with each line once a key, as indexing it if it does."""
    order = np.lexsort((1 - p, h, k))
    k, h, p = k[order], h[order], p[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    return k[new], h[new], p[new]


def _sharers(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: the lines of each key that a line indexes and at least one other line has; indexed tells those that index it."""
    kinds = np.uint64, np.uint64, np.uint8
    if key[0] < 0:
        k, h, p = (np.concatenate(x) for x in zip(*[unpack(blob, *kinds) for blob in pdf["blob"]]))
        return pd.DataFrame({"key": k.view(np.int64), "h": h.view(np.int64), "indexed": p == 1})
    ks, hs, ps = [], [], []
    for blob in pdf["blob"]:
        d, h, p = unpack(blob, *kinds)
        ks.append(np.cumsum(d, dtype=np.uint64))
        hs.append(h)
        ps.append(p)
    k, h, p = _once(np.concatenate(ks), np.concatenate(hs), np.concatenate(ps))
    run = np.concatenate([[0], np.cumsum(k[1:] != k[:-1])])
    use = ((np.bincount(run) > 1) & (np.bincount(run, p) > 0))[run]
    return pd.DataFrame({"key": k[use].view(np.int64), "h": h[use].view(np.int64), "indexed": p[use] == 1})


def _texts(docs: DataFrame, wanted: DataFrame, near: int, small: int = 200_000) -> DataFrame:
    """(h, line) of the distinct lines whose hash is in wanted (h), which is sent to all tasks only while under `small` rows."""
    line = F.trim(F.col("line"), F.lit(BLANK))
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(line.alias("line")).where(F.length("line") >= near).select(F.xxhash64("line").alias("h"), "line")
    wanted = F.broadcast(wanted) if wanted.count() <= small else wanted
    return lines.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line"))


def _bag(line: str) -> np.ndarray:
    return np.bincount(np.frombuffer(line.encode("utf-32-le"), np.uint32) & 63, minlength=64).astype(np.int32)


def followers(places: list, indexed: list, asks: list, member: list, lines: list[str], differ: int) -> list[int]:
    """Positions of lines that ask and have a near member that starts earlier; of each pair one must index the key they share."""
    order = sorted(range(len(lines)), key=places.__getitem__)
    bags, last, out = np.stack([_bag(lines[i]) for i in order]), None, []
    can, here = np.array([indexed[i] for i in order]), np.array([member[i] for i in order])
    for at, i in enumerate(order):
        if not asks[i] or not at:
            continue

        def near(j: int) -> bool:
            c = order[j]
            return places[c] < places[i] and (indexed[c] or indexed[i]) and edit_within(lines[c], lines[i], differ)

        # in a group of copies the line that the one before met is met again
        if last is not None and near(last):
            out.append(i)
            continue
        # an edit changes at most two counts by one
        close = (np.abs(bags[:at] - bags[at]).sum(1) <= 2 * differ) & here[:at]
        found = next((j for j in np.flatnonzero(close if indexed[i] else close & can[:at]).tolist() if near(j)), None)
        if found is not None:
            out.append(i)
            last = found
    return out


RUN = ["key", "block", "part"]


def _runs(differ: int):
    """Of rows (RUN, h, indexed, asks, member, none, id, pos, line), sorted by RUN: h of lines with an earlier near member in their run."""

    def emit(rows: list):
        _, _, _, h, indexed, asks, member, none, doc, pos, line = zip(*rows)
        places = list(zip(none, [x or 0 for x in doc], pos))
        return [h[i] for i in followers(places, indexed, asks, member, line, differ)]

    def run(batches):
        rows: list = []
        for batch in batches:
            out = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and row[:3] != rows[0][:3]:
                    out += emit(rows)
                    rows = []
                rows.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["h"])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(emit(rows), pa.int64())], ["h"])

    return run


def _searched(rows: DataFrame, differ: int) -> DataFrame:
    rows = rows.select(*RUN, "h", "indexed", "asks", "member", F.col("first.none").alias("none"), F.col("first.id").alias("id"), F.col("first.pos").alias("pos"), "line")
    return rows.repartition(*RUN).sortWithinPartitions(*RUN).mapInArrow(_runs(differ), "h long").distinct()


def _viewer(differ: int):
    """Rows (key, h, line) to views (key, h, rest, length, indexed)."""

    def run(batches):
        for batch in batches:
            out = [(key, h, *view) for key, h, line in zip(*[c.to_pylist() for c in batch.columns]) for view in sorted(first_views(line, key % (1 << 64), differ))]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.bool_()))], ["key", "h", "rest", "length", "indexed"])

    return run


def _refiner(differ: int, rests: bool):
    """Views to those of the next round, or without rests to their keys (key, h, length, indexed), once a line."""

    def run(batches):
        for batch in batches:
            out = []
            for key, h, rest, length, indexed in zip(*[c.to_pylist() for c in batch.columns]):
                views = next_views(key % (1 << 64), rest, length, indexed, differ)
                if rests:
                    out += [((k - (1 << 64) if k >> 63 else k), h, r, n, i) for (k, r), (n, i) in views.items()]
                    continue
                keys: dict = {}
                for (k, _), (n, i) in views.items():
                    keys[k] = (n, i or keys.get(k, (0, False))[1])
                out += [((k - (1 << 64) if k >> 63 else k), h, n, i) for k, (n, i) in keys.items()]
            kinds = [pa.int64(), pa.int64(), *([pa.string()] if rests else []), pa.int32(), pa.bool_()]
            cols = list(zip(*out)) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["key", "h", *(["rest"] if rests else []), "length", "indexed"])

    return run


VIEW = "key long, h long, rest string, length int, indexed boolean"


def near_followers(docs: DataFrame, first: DataFrame, differ: int = 2, near: int = 20, block: int = 256, block_bytes: int = 16 << 20) -> DataFrame:
    """(h): hashes of distinct lines that have another line at most `differ` edits apart with an earlier first place. first: (h, first).

    One row a line and key, never pairs; see the module for keys of more than `block` lines (fewer, if they are very long).
    """
    buckets = bucket_count(docs)
    sent = docs.select("text").mapInArrow(_sender(differ, near, buckets), "bucket long, blob binary")
    rows = materialize(sent.groupBy("bucket").applyInPandas(_sharers, "key long, h long, indexed boolean"))
    texts = materialize(_texts(docs, rows.select("h").distinct(), near).join(first.select("h", "first"), "h"))
    texts = texts.withColumn("bytes", F.octet_length("line"))
    found, views, rows = None, None, rows.withColumn("length", F.lit(1 << 30))
    while True:
        lines = rows.join(texts, "h")
        lines = lines.withColumn("asks", F.lit(True)) if found is None else lines.join(found.withColumn("done", F.lit(True)), "h", "left").withColumn("asks", F.col("done").isNull())
        sizes = lines.groupBy("key").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.min("length").alias("key_length"), F.max("indexed").alias("has_index"), F.max("asks").alias("has_asking"))
        blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / block_bytes)).cast("int")
        sizes = materialize(sizes.where("n > 1 AND has_index AND has_asking").select("key", blocks.alias("blocks"), "key_length"))
        dealt = lines.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("h", "key"), F.col("blocks")).cast("int"))
        members = materialize(dealt.select("key", "block", F.lit(0).alias("part"), "blocks", "key_length", "h", "indexed", "asks", F.lit(True).alias("member"), "first", "line"))
        new = _searched(members, differ)
        found = materialize(new if found is None else found.union(new).distinct())
        many = members.where("blocks > 1")
        left = materialize(many.where("asks").join(found, "h", "left_anti"))
        open_keys = materialize(left.groupBy("key").agg(F.count("*").alias("asking"), F.min("key_length").alias("length")))
        if open_keys.isEmpty():
            return found
        # too little is left of lines to cut more out of, or so few ask that they can go everywhere
        ends = (F.col("asking") <= block) | (F.col("length") <= 2 * (differ + 1))
        parts = open_keys.where(ends).select("key", F.ceil(F.col("asking") / block).cast("int").alias("parts"))
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("block")))
        asking = left.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).withColumn("to", other).drop("block").withColumnRenamed("to", "block").withColumn("member", F.lit(False))
        resting = many.join(parts, "key").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(False))
        more = _searched(asking.select(resting.columns).union(resting), differ)
        found = materialize(found.union(more).distinct())
        deep = open_keys.where(~ends).select("key")
        if deep.isEmpty():
            return found
        if views is None:
            views = many.join(deep, "key", "left_semi").select("key", "h", "line").mapInArrow(_viewer(differ), VIEW)
        else:
            views = views.mapInArrow(_refiner(differ, True), VIEW).join(deep, "key", "left_semi").select("key", "h", "rest", "length", "indexed")
        views = materialize(views)
        rows = materialize(views.mapInArrow(_refiner(differ, False), "key long, h long, length int, indexed boolean"))


def _cleaner(at: dict[str, int]):
    def run(batches):
        for batch in batches:
            texts, gone = batch.column(at["text"]), batch.column(at["gone_lines"])
            out = []
            for t, g in zip(texts, gone):
                if not g.is_valid:
                    out.append(t.as_py())
                    continue
                drop = set(g.as_py())
                out.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in drop))
            cols = [pa.array(out, pa.string()) if n == "text" else batch.column(i) for n, i in at.items() if n != "gone_lines"]
            n_gone = pa.array([len(g.as_py()) if g.is_valid else 0 for g in gone], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, n_gone], [*[n for n in at if n != "gone_lines"], "n_lines_gone"])

    return run


def line_dedup(docs: DataFrame, differ: int = 2, least: int = 8, near: int = 20, block: int = 256) -> DataFrame:
    """(doc_id, row_key, text, n_lines_gone): the text of each row of docs (doc_id, text) without repeated lines."""
    docs = docs.select("doc_id", "text")
    lines = materialize(_occurrences(docs, least))
    first = materialize(lines.groupBy("h").agg(F.min(_place()).alias("first"), F.count("*").alias("n")))
    late = near_followers(docs, first, differ, near, block)
    # lines that occur once and have no earlier neighbour are no reason to move a row; of others all places but the first go, and
    # the first too if a near line starts earlier. Written first: both sides of the join below are then plain exchanges, of which
    # Spark splits those that one very common line fills
    known = first.join(late.withColumn("all", F.lit(True)), "h", "left").where("n > 1 OR all")
    known = materialize(known.select("h", F.coalesce("all", F.lit(False)).alias("all"), "first"))
    gone = lines.join(known, "h").where(F.col("all") | (_place() > F.col("first"))).groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set("pos")).alias("gone_lines"))
    gone = materialize(gone)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    keyed = gone.select(F.coalesce("doc_id", F.lit(0)).alias("k0"), F.col("doc_id").isNull().alias("k1"), "row_key", "gone_lines")
    joined = rows.withColumn("k0", F.coalesce("doc_id", F.lit(0))).withColumn("k1", F.col("doc_id").isNull()).join(keyed.hint("shuffle_hash"), ["k0", "k1", "row_key"], "left").select("doc_id", "row_key", "text", "gone_lines")
    at = {"doc_id": 0, "row_key": 1, "text": 2, "gone_lines": 3}
    return joined.mapInArrow(_cleaner(at), "doc_id long, row_key long, text string, n_lines_gone long")
