"""Best-fit packing by a grouping genetic algorithm, distributed as islands with elite migration.

Documents become token ids and a closing id 0; those longer than a sequence are cut, the first piece taking what is over.
Pieces are dealt to shards of about `shard` pieces. A chromosome is a grouping of the shard's pieces into sequences;
crossover injects the other parent's well-filled sequences whole, removes those of the first that hold the same pieces,
and places the displaced ones again: exchanges for one or two smaller pieces where that fills a sequence better, then best
fit. Islands of a shard evolve apart; after each epoch their best groupings migrate to all islands of the shard.
Sequences that are filled to `settled` stay; the pieces of the rest go on to the next level, where fewer shards pack them
with others like them, down to one shard, or until a level settles less than a tenth of its pieces: then they do not fit each other.

Best fit in order of length starts each shard. Where it meets the bound ceil(tokens / size) no grouping has fewer
sequences, and no epoch is spent. Short texts fill gaps so well that this is the usual case: on the given tables only
a few shards, mostly the last of the levels, are open after it (README has the counts). On lengths that leave no
such filling, as triplets that fill a sequence exactly, the search takes an eighth of the sequences off best fit's.

Defined results: null and empty texts are the closing id alone; rows without doc_id and repeated rows are packed like
others; very long texts are tokenized in parts and cut; of pieces of equal length the smaller doc_id and piece goes first;
an empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pack, unpack

_coders: dict = {}
SEGMENT = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in vocabularies of this family: printable ones for themselves, others in order from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(other)}}


class Coder:
    """Token ids as little-endian bytes, for a byte-level vocabulary in the json form of `tokenizers`.

    Added tokens (as `<|endoftext|>`) are found first, wherever they stand, as `tokenizers` does. Very long text between
    them is cut at single spaces, where the byte-level pattern always begins a token.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            form = json.load(f)
        byte = byte_alphabet()
        ranks = {bytes(byte[c] for c in token): i for token, i in form["model"]["vocab"].items()}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed: the pattern of this family of vocabularies
        self.encode = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in form["added_tokens"]):
            raise ValueError("added tokens that take part of their surroundings are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in form["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")").split if self.added else lambda t: [t]

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            return b"".join(self.added[x] if k % 2 else self._plain(x) for k, x in enumerate(self.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        return b"".join(array("I", self.encode(x)).tobytes() for x in self._cut(text))

    def _cut(self, text: str):
        a = 0
        while len(text) - a > SEGMENT:
            b = a + SEGMENT
            while 0 <= (b := text.find(" ", b)) and (b + 1 >= len(text) or text[b - 1].isspace() or text[b + 1].isspace()):
                b += 1
            if b < 0:
                break
            yield text[a:b]
            a = b
        yield text[a:]


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def _tokenizer(path: str, size: int):
    def run(batches):
        code = coder(path)
        for batch in batches:
            seen: dict = {}
            out = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = code.ids(t.as_py() or "") + b"\0\0\0\0"
                n, copy = len(ids) // 4, seen.get(i, 0)
                seen[i] = copy + 1
                a, b = 0, (n if n <= size else n % size or size)
                piece = 0
                while a < n:
                    out.append((i, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), copy))
                    a, b, piece = b, b + size, piece + 1
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "piece", "start", "length", "ids_crc32", "copy"])

    return run


def best_fit(items, lengths, bins: list, left: list, size: int) -> None:
    """Puts each item where it leaves least room. bins: item lists; left: sorted (room, bin number)."""
    for i in items:
        n = lengths[i]
        at = bisect.bisect_left(left, (n, -1))
        if at < len(left):
            room, b = left.pop(at)
            bins[b].append(i)
        else:
            room, b = size, len(bins)
            bins.append([i])
        if room > n:
            bisect.insort(left, (room - n, b))


def filled(bins, lengths) -> list[int]:
    return [sum(map(lengths.__getitem__, b)) for b in bins]


def group(items, lengths, kept: list, size: int) -> list:
    bins = [list(b) for b in kept]
    left = sorted((size - s, k) for k, s in enumerate(filled(bins, lengths)) if s < size)
    best_fit(items, lengths, bins, left, size)
    return bins


def fitness(bins, lengths, size: int) -> tuple[int, float]:
    """Fewer sequences first, then fullness concentrated in few of them."""
    return -len(bins), sum((s / size) ** 2 for s in filled(bins, lengths)) / max(1, len(bins))


def exchange(loose: list, bins: list, lengths, size: int) -> tuple[list, list]:
    """Swaps loose items into sequences for one or two smaller ones wherever that fills them better; gives what is loose then, and the sequences."""
    bins, fill = [list(b) for b in bins], filled(bins, lengths)
    held, where, parts = [], [], []
    for k, b in enumerate(bins):
        if fill[k] < size:
            some = b if len(b) <= 12 else sorted(b, key=lambda i: -lengths[i])[:12]
            for p in [(i,) for i in some] + [(i, j) for x, i in enumerate(some) for j in some[x + 1 :]]:
                held.append(sum(lengths[i] for i in p))
                where.append(k)
                parts.append(p)
    if not held:
        return loose, bins
    held, where = np.array(held), np.array(where)
    room, alive = size - np.array(fill)[where], np.ones(len(held), bool)
    out = []
    for i in sorted(loose, key=lambda i: -lengths[i]):
        gain = lengths[i] - held
        gain = np.where(alive & (gain <= room), gain, 0)
        best = int(gain.argmax())
        if gain[best] <= 0:
            out.append(i)
            continue
        k = where[best]
        bins[k] = [x for x in bins[k] if x not in parts[best]] + [i]
        out.extend(parts[best])
        alive[where == k] = False  # its other swaps were worked out for what it held
    return out, bins


def placed_again(loose: list, bins: list, lengths, size: int) -> list:
    """Repair after injection or mutation: exchanges, then best fit of what is loose, largest first."""
    loose, bins = exchange(loose, bins, lengths, size)
    return group(sorted(loose, key=lambda i: -lengths[i]), lengths, bins, size)


def crossover(a: list, b: list, lengths, size: int, rng, share: float = 0.4) -> list:
    """Brings whole well-filled sequences of b into a, takes out those of a that hold the same items, and places the displaced ones again."""
    fill = filled(b, lengths)
    best = sorted(range(len(b)), key=lambda k: -fill[k])[: max(1, len(b) // 2)]
    brought = [b[k] for k in rng.choice(best, max(1, int(len(best) * share)), replace=False)]
    inside = {i for x in brought for i in x}
    kept, displaced = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in inside]
    return placed_again(displaced, brought + kept, lengths, size)


def mutate(a: list, lengths, size: int, rng) -> list:
    """Empties the least filled sequences and a few others, and places what they held again."""
    fill = filled(a, lengths)
    order = sorted(range(len(a)), key=lambda k: fill[k])
    n = max(2, len(a) // 20)
    out = set(order[:n]) | set(rng.choice(len(a), min(n, len(a)), replace=False).tolist())
    return placed_again([i for k in out for i in a[k]], [x for k, x in enumerate(a) if k not in out], lengths, size)


def first_fit(lengths, size: int) -> list:
    """Best fit in order of length, the largest first: where it meets the bound no search is needed."""
    return group(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, [], size)


def evolve(lengths, starts: list, size: int, seed: int, people: int = 8, patience: int = 12, work: int = 60_000) -> list:
    """The best grouping found. It stops when no grouping can have fewer sequences, after `patience` rounds without a better
    one, or when about `work` items have been regrouped (some ten rounds at least)."""
    if not len(lengths):
        return []
    rng = np.random.default_rng(seed)
    least = -(-sum(lengths) // size)
    pool = [*starts] or [first_fit(lengths, size)]
    if len(pool[0]) > least:
        while len(pool) < people:
            noise = 1 + rng.uniform(0.05, 0.4) * rng.random(len(lengths))
            pool.append(group(sorted(range(len(lengths)), key=lambda i: -lengths[i] * noise[i]), lengths, [], size))
    pool = sorted(((fitness(g, lengths, size), g) for g in pool), key=lambda x: x[0], reverse=True)
    stale = 0
    for _ in range(max(10, work // len(lengths))):
        if len(pool[0][1]) <= least or stale >= patience:
            break
        before = pool[0][0]
        # parents by tournament; the child takes the place of the worst of a few, never of the best
        a, b = sorted(rng.choice(len(pool), 2, replace=False))
        child = crossover(pool[a][1], pool[b][1], lengths, size, rng)
        for g in (child, mutate(child, lengths, size, rng)):
            fit = fitness(g, lengths, size)
            if all(fit != f for f, _ in pool):
                pool.append((fit, g))
        pool = sorted(pool, key=lambda x: x[0], reverse=True)[:people]
        stale = 0 if pool[0][0] > before else stale + 1
    return pool[0][1]


def _shards():
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "copy"], ascending=[False, True, True, True])
        ok = pdf["doc_id"].notna().to_numpy()
        blob = pack(ok.astype(np.uint8), pdf["doc_id"].fillna(0).to_numpy(np.int64), *[pdf[c].to_numpy(k) for c, k in zip(COLUMNS, KINDS)])
        return pd.DataFrame({"shard": [key[0]], "items": [blob]})

    return run


COLUMNS, KINDS = ("piece", "start", "length", "ids_crc32", "copy"), (np.int32, np.int64, np.int64, np.int64, np.int32)


def _numbered(bins: list, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _grouped(of: np.ndarray) -> list:
    order = np.argsort(of, kind="stable")
    return [x.tolist() for x in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


ELITE = "shard long, island int, bins int, least int, fit double, elite binary"


def _island(size: int, epoch: int):
    """Rows (shard, island, items, elites) to the best grouping found; epoch 0 is plain best fit, later ones evolve from the elites."""

    def run(batches):
        for batch in batches:
            out = []
            for shard, island, items, elites in zip(*[c.to_pylist() for c in batch.columns]):
                lengths = unpack(items, np.uint8, np.int64, *KINDS)[4].tolist()
                starts = [_grouped(unpack(e, np.int32)[0]) for e in elites or []]
                found = evolve(lengths, starts, size, seed=(shard * 1009 + island * 31 + epoch) & 0x7FFFFFFF) if epoch else first_fit(lengths, size)
                out.append((shard, island, len(found), -(-sum(lengths) // size), fitness(found, lengths, size)[1], pack(_numbered(found, len(lengths)))))
            cols = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.binary()))], [x.split()[0] for x in ELITE.split(", ")])

    return run


ROWS = "doc_id long, piece int, start long, length long, ids_crc32 long, copy int, sequence_id long, offset long, fill long"


def _placed(level: int):
    def run(batches):
        for batch in batches:
            for shard, items, elite in zip(*[c.to_pylist() for c in batch.columns]):
                ok, ids, *rest = unpack(items, np.uint8, np.int64, *KINDS)
                of, length = unpack(elite, np.int32)[0].astype(np.int64), rest[2]
                order = np.argsort(of, kind="stable")
                run_ = np.cumsum(length[order]) - length[order]
                new = np.ones(len(order), bool)
                new[1:] = np.diff(of[order]) != 0
                offset = np.empty(len(order), np.int64)
                offset[order] = run_ - np.maximum.accumulate(np.where(new, run_, 0))
                fill = np.bincount(of, length)[of].astype(np.int64) if len(of) else of
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ok == 0), *map(pa.array, rest), pa.array((level << 58) + (shard << 24) + of), pa.array(offset), pa.array(fill)], [x.split()[0] for x in ROWS.split(", ")])

    return run


def grouped_shards(items: DataFrame, size: int, islands: int = 3, epochs: int = 3) -> DataFrame:
    """(shard, elite): the best grouping found of each of items (shard, items).

    Best fit comes first; where it meets the bound (the sum of lengths over `size`, rounded up) nothing can be better, and the
    shard is done. The others are given to `islands` populations each, whose best groupings migrate to all islands of their
    shard between epochs, until the bound is met or the epochs are over.
    """
    none = F.lit(None).cast("array<binary>").alias("elites")
    found = materialize(items.select("shard", F.lit(0).alias("island"), "items", none).mapInArrow(_island(size, 0), ELITE))
    rounds = [found]
    for epoch in range(1, epochs + 1):
        over = found.groupBy("shard").agg(F.min(F.col("bins") - F.col("least")).alias("over"), F.collect_list("elite").alias("elites")).where("over > 0").drop("over")
        open_ = materialize(items.join(over, "shard"))
        if open_.isEmpty():
            break
        work = open_.select("shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "items", "elites")
        found = materialize(work.repartition("shard", "island").mapInArrow(_island(size, epoch), ELITE))
        rounds.append(found)
    every = rounds[0]
    for x in rounds[1:]:
        every = every.union(x)
    return every.groupBy("shard").agg(F.max_by("elite", F.struct(-F.col("bins"), "fit", -F.col("island"))).alias("elite"))


def pack_pieces(pieces: DataFrame, size: int, shard: int = 4096, islands: int = 3, epochs: int = 3, settled: float = 0.99) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32, copy) of at most `size` tokens."""
    done, rest, n, level = [], pieces, pieces.count(), 0
    while True:
        shards = max(1, -(-n // shard))
        number = F.pmod(F.xxhash64("doc_id", "piece", "copy", "ids_crc32", F.lit(level)), F.lit(shards)).alias("shard")
        items = materialize(rest.select("*", number).groupBy("shard").applyInPandas(_shards(), "shard long, items binary"))
        best = grouped_shards(items, size, islands, epochs)
        placed = materialize(items.join(best, "shard").select("shard", "items", "elite").mapInArrow(_placed(level), ROWS))
        full = F.col("fill") >= settled * size
        left = 0 if shards == 1 else placed.where(~full).count()
        # on to the next level while one settles a tenth of its pieces; where none does, more company does not help them either
        last = shards == 1 or left > n - n // 10
        done.append((placed if last else placed.where(full)).drop("fill", "copy"))
        if last or not left:
            break
        rest, n, level = placed.where(~full).drop("fill", "sequence_id", "offset"), left, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def best_fit_packing(docs: DataFrame, vocabulary: str, size: int = 2048) -> DataFrame:
    """Per piece of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: the path of its json form."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, copy int"
    return pack_pieces(materialize(docs.select("doc_id", "text").mapInArrow(_tokenizer(vocabulary, size), kinds)), size)
