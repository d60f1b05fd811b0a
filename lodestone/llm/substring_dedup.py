"""Substring dedup: Rabin-Karp hashes of every window of words, counted by hash bucket; repeated windows become removal intervals.

Every window of `window` words gets a 64-bit rolling hash (a polynomial over word hashes, themselves polynomials over
bytes, each with a mixing step). A batch of documents keeps the first window of each hash, and sends its hashes to
buckets as compressed arrays, not rows; equal hashes meet in one bucket, where every window but the earliest is marked.
So a passage found everywhere costs one entry a batch, and no key gathers more than that in one task. Marks go back to
their batch, where overlapping windows merge into maximal intervals, one row a document that loses words. Different
word sequences are taken for equal with a probability of about pairs of windows / 2**64.

Defined results: null and empty texts have no words; a row without doc_id keeps all its words and precedes nobody; of rows
with the same doc_id, windows at the same start tie, and neither removes the other (one such row never doubles results);
very long texts are hashed whole; an empty table gives no rows; columns other than doc_id and text, whatever their names, are ignored.

Marks return to the batch that a hash came from, so a task that is run again must see the batches it saw before. Scans of files give
that; write the input to files first if it is anything else. A changed batch is an error, never a wrong result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_count, gaps, materialize, mix, pack, text_of, unpack

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.Generator(np.random.PCG64(20))
BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
BASES = {"byte": 0x9E3779B97F4A7C15, "word": 0xD1342543DE82EF95}  # odd, so that they have an inverse modulo 2**64
STEP, BATCH_BYTES = 1 << 20, 6 << 20
_powers: dict = {}


def powers(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n modulo 2**64, and their inverses."""
    if kind not in _powers or len(_powers[kind][0]) <= n:
        size, base = 1 << int(n).bit_length(), BASES[kind]
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size + 1, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[kind] = tuple(out)
    return _powers[kind]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in the bytes, and the number of the first word of each document (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    at = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[at] |= solid[at]
    at = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[at] |= solid[at]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STEP, "right")))
        lo = starts[a]
        piece = BYTE[data[lo : ends[b - 1]]]
        up, down = powers("byte", len(piece))
        piece *= up[: len(piece)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(piece, dtype=np.uint64)])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        a = b
    return out


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One rolling hash for each place where width words begin, document borders aside."""
    if len(words) < width:
        return np.zeros(0, np.uint64)
    up, down = powers("word", len(words))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return mix((total[width:] - total[:-width]) * down[: len(words) - width + 1])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, row key, bytes and offsets of parts of about BATCH_BYTES, in order of doc_id."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(0)))
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(size // BATCH_BYTES)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.slice(a, b - a)
            part = part.take(pc.sort_indices(part.column(0)))
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), *text_of(part)


def _sender(width: int, buckets: int):
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def send(batches):
        for ids, keys, data, offsets in _batches(batches):
            starts, ends, first = words_of(data, offsets)
            at = np.diff(first)
            h = window_hashes(word_hashes(data, starts, ends), width)
            doc = np.repeat(np.arange(len(ids)), at)[: len(h)]
            place = np.flatnonzero(np.arange(len(h)) + width <= first[1:][doc])
            h, doc = h[place], doc[place]
            order = np.argsort(h, kind="stable")  # places are in order of (doc_id, start)
            h, place, doc = h[order], place[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            start = place - first[doc]
            ties = (ids[doc] == ids[doc[lead]]) & (start == start[lead])
            batch_id = int.from_bytes(hashlib.blake2b(ids.tobytes() + keys.tobytes(), digest_size=8).digest(), "little", signed=True)
            local = np.sort(place[~ties])
            out = [(-1 - (batch_id % buckets), pack(gaps(ids), keys, at.astype(np.uint32), gaps(local).astype(np.uint32)))]
            h, place, doc, start = h[ties], place[ties], doc[ties], start[ties]
            borders = np.searchsorted(h >> shift, np.arange(buckets + 1, dtype=np.uint64)) if len(h) else np.zeros(buckets + 1, int)
            for k in np.flatnonzero(np.diff(borders)):
                a, b = borders[k], borders[k + 1]
                by = np.argsort(place[a:b])
                d, n = np.unique(doc[a:b], return_counts=True)
                # the bits that the bucket's number gives are left out
                rest = np.ascontiguousarray(h[a:b][by]).view(np.uint8).reshape(-1, 8)[:, : 8 - int(64 - shift) // 8]
                out.append((int(k), pack(rest.ravel(), gaps(ids[d]), n.astype(np.uint16 if n.max() < 65536 else np.uint32).astype(np.uint32), gaps(place[a:b][by]).astype(np.uint32), gaps(start[a:b][by].astype(np.int32)))))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([batch_id] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "batch", "blob"])

    return send


def _marker(buckets: int):
    bytes_left = 8 - (buckets.bit_length() - 1) // 8

    def mark(key, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:  # the documents of batches, on their way
            return pdf[["batch", "bucket", "blob"]]
        parts = []
        for i, blob in enumerate(pdf["blob"]):
            rest, ids, n, place, start = unpack(blob, np.uint8, np.int64, np.uint32, np.uint32, np.int32)
            h = np.zeros((len(place), 8), np.uint8)
            h[:, :bytes_left] = rest.reshape(-1, bytes_left)
            parts.append((h.view(np.uint64).ravel(), np.repeat(np.cumsum(ids), n), np.cumsum(start, dtype=np.int32), np.cumsum(place, dtype=np.uint32), np.full(len(place), i, np.int32)))
        h, ids, start, place, of = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((start, ids, h))
        h, ids, start, place, of = h[order], ids[order], start[order], place[order], of[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        late = (ids != ids[lead]) | (start != start[lead])
        of, place = of[late], place[late]
        out = [(pdf["batch"].iloc[i], pack(gaps(np.sort(place[of == i])))) for i in np.unique(of)]
        return pd.DataFrame({"batch": [x[0] for x in out], "bucket": np.int32(key[0]), "blob": [x[1] for x in out]})

    return mark


def _intervals(width: int):
    def merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["bucket"] < 0
        if not own.any():
            raise ValueError("marks without their batch: the input's batches changed between attempts; write it to files first")
        ids, keys, n, local = unpack(pdf["blob"][own].iloc[0], np.int64, np.int64, np.uint32, np.uint32)
        ids, n = np.cumsum(ids), n.astype(np.int64)
        first = np.concatenate([[0], np.cumsum(n)])
        places = np.concatenate([np.cumsum(local, dtype=np.uint32), *[np.cumsum(unpack(b, np.uint32)[0], dtype=np.uint32) for b in pdf["blob"][~own]]]).astype(np.int64)
        slots = first[:-1] + np.arange(len(ids))  # one free slot between documents, so that no run of windows spans two
        places = places + np.searchsorted(first, places, "right") - 1
        cover = np.zeros(first[-1] + len(ids) + 1, np.int32)
        np.add.at(cover, places, 1)
        np.add.at(cover, places + width, -1)
        edge = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=np.int8(0))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        doc = np.searchsorted(slots, a, "right") - 1
        rows = [(ids[d], keys[d], (a[doc == d] - slots[d]).tolist(), (b[doc == d] - slots[d]).tolist()) for d in np.unique(doc)]
        return pd.DataFrame(rows, columns=["doc_id", "row_key", "starts", "ends"])

    return merge


def removal_intervals(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, row_key, starts, ends): maximal intervals of words, ends excluded, for rows that lose any. Written to the shared folder."""
    buckets = bucket_count(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    sent = rows.mapInArrow(_sender(window, buckets), "bucket int, batch long, blob binary")
    marked = sent.groupBy("bucket").applyInPandas(_marker(buckets), "batch long, bucket int, blob binary")
    found = marked.groupBy("batch").applyInPandas(_intervals(window), "doc_id long, row_key long, starts array<int>, ends array<int>")
    return materialize(found)


def _cleaner(batches):
    for batch in batches:
        text = batch.column(1).fill_null("").cast(pa.binary())
        n_words, n_removed, kept = [], [], []
        for t, a, b in zip(text, batch.column(2), batch.column(3)):
            words = t.as_py().split()  # bytes split at the six ASCII spaces
            n_words.append(len(words))
            if a.is_valid:
                keep = np.ones(len(words), bool)
                for x, y in zip(a.as_py(), b.as_py()):
                    keep[x:y] = False
                words = [words[i] for i in np.flatnonzero(keep)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by a space) of each row of docs (doc_id, text)."""
    found = removal_intervals(docs, window).groupBy("doc_id", "row_key").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row_key"), "text")
    joined = rows.join(found.hint("shuffle_hash"), ["doc_id", "row_key"], "left").select("doc_id", "text", "starts", "ends")
    return joined.mapInArrow(_cleaner, "doc_id long, n_words long, n_removed long, kept_text string")
