"""Whitening of embeddings with covariances merged by Chan's formula.

Entries become integers, x = floor(scale * c). The fit list holds each distinct x vector once (a groupBy that combines copies
before they are shuffled, written once). A task turns its rows into count, mean and centred scatter; two such states merge as
n = a + b, mean = a's + delta b / n, scatter = a's + b's + delta delta' a b / n, in a treeReduce, so that one d x d matrix
reaches the driver, where eigh gives components and eigenvalues. A second pass over the fit list sums up the whitened vectors
the same way and says how far their covariance is from the identity. A last pass over all rows projects them; vectors never
leave their task.

Sums per dimension are exact: entries are added as two halves of 31 bits, in integers.

Defined results: rows whose vector is null or holds null or non-finite entries, or one that is no 62-bit integer, have no
result; so have vectors whose length is not the one most distinct vectors have (of equally common lengths the longer). Rows are
answered each for themselves, also when vec_id is null or repeats; copies weigh once in the fit. Components whose eigenvalue
is zero but for rounding (1e-11 of the trace or less) are left out: one distinct vector, empty vectors or an empty table give no
rows. A deviation that no 64-bit integer holds is null. Equal eigenvalues have their components in the order of eigh; the sign
makes each component's largest entry positive. Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship

LIMIT = float(1 << 62)
HALF = 31


class State(NamedTuple):
    """n rows: the two halves of their exact sums, their mean and their centred scatter."""

    n: int
    high: np.ndarray
    low: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray


def state_of(x: np.ndarray) -> State:
    """Of a matrix of at least one row, integers or doubles (whose sums are then of no use)."""
    mean = x.mean(axis=0, dtype=np.float64)
    apart = x - mean
    whole = x if x.dtype == np.int64 else np.zeros((1, x.shape[1]), np.int64)
    return State(len(x), (whole >> HALF).sum(axis=0), (whole & ((1 << HALF) - 1)).sum(axis=0), mean, apart.T @ apart)


def merged(a: State, b: State) -> State:
    n, delta = a.n + b.n, b.mean - a.mean
    return State(n, a.high + b.high, a.low + b.low, a.mean + delta * (b.n / n), a.scatter + b.scatter + np.outer(delta, delta) * (a.n * b.n / n))


def sums(s: State) -> list[int]:
    return [(int(h) << HALF) + int(low) for h, low in zip(s.high, s.low)]


def integers(col: pa.Array, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By vector length: places of usable rows and their integer entries, of a column of lists of doubles."""
    lengths = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    c = np.floor(np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64) * scale)
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(c) < LIMIT))])
    fine = (bad[ends] == bad[ends - lengths]) & pc.is_valid(col).to_numpy(zero_copy_only=False)
    out = {}
    for d in np.unique(lengths[fine]).tolist():
        at = np.flatnonzero(fine & (lengths == d))
        out[d] = at, c[(ends[at] - d)[:, None] + np.arange(d)].astype(np.int64)
    return out


def _narrow(scale: int):
    """Vectors as bytes of the narrowest integer kind that holds all of a vector's entries; equal vectors are equal bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, (_, x) in integers(batch.column(0), scale).items():
                if not d:
                    continue
                most = np.maximum(x.max(axis=1), ~x.min(axis=1))
                size = np.select([most < 1 << 7, most < 1 << 15, most < 1 << 31], [1, 2, 4], 8)
                for k in np.unique(size).tolist():
                    raw, step = x[size == k].astype(f"<i{k}").tobytes(), d * k
                    blobs = [raw[i : i + step] for i in range(0, len(raw), step)]
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["d", "x"])

    return run


def _wide(batches: Iterator[pa.RecordBatch], d: int, chunk: int = 4096) -> Iterator[np.ndarray]:
    """Matrices of at most chunk rows of what _narrow() packed."""
    for batch in batches:
        by_size: dict[int, list[bytes]] = {}
        for blob in batch.column(0).to_pylist():
            by_size.setdefault(len(blob) // d, []).append(blob)
        for k, blobs in by_size.items():
            for i in range(0, len(blobs), chunk):
                yield np.frombuffer(b"".join(blobs[i : i + chunk]), f"<i{k}").reshape(-1, d).astype(np.int64)


FIELDS = ("high", "low", "mean", "scatter")


def _summed(d: int, project=None):
    """One row a task: the state of its vectors, or of what project makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for x in _wide(batches, d):
            new = state_of(x if project is None else project(x))
            state = new if state is None else merged(state, new)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([state.n], pa.int64()), *[pa.array([getattr(state, f).tobytes()], pa.binary()) for f in FIELDS]], ["n", *FIELDS])

    return run


def _read(row) -> State:
    mean = np.frombuffer(row["mean"])
    return State(row["n"], np.frombuffer(row["high"], np.int64), np.frombuffer(row["low"], np.int64), mean, np.frombuffer(row["scatter"]).reshape(len(mean), len(mean)))


def chan_state(fit: DataFrame, d: int, project=None) -> State:
    """The merged state of fit (x), which has rows: a matrix a task, merged pairwise in executors."""
    parts = fit.select("x").mapInArrow(_summed(d, project), "n long, high binary, low binary, mean binary, scatter binary")
    return parts.rdd.map(_read).treeReduce(merged, depth=2)


class Whitener(NamedTuple):
    """n distinct vectors of d entries, their exact sums, components as columns by falling eigenvalue, and the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    trace: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([s / self.n for s in self.sums])
        return (x - mean) @ self.axes / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n x - sum)^2, exactly."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if most * most * max(x.shape[1], 1) < 1 << 63:
            apart = self.n * x - np.array(self.sums, np.int64)
            return np.einsum("ij,ij->i", apart, apart).tolist()
        exact = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]
        return [v if v < 1 << 63 else None for v in exact]


def whitener_of(state: State, components: int) -> Whitener:
    v = state.scatter / state.n
    trace = float(np.trace(v))
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    kept = values > 1e-11 * trace
    values, axes = values[kept], axes[:, kept]
    if axes.size:
        top = np.abs(axes).argmax(axis=0)
        axes = axes * np.where(axes[top, np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitener(state.n, sums(state), axes, values, trace)


def fit_list(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(d, x): every distinct integer vector of vectors (embedding) once, as packed bytes."""
    rows = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"))
    return materialize(rows.mapInArrow(_narrow(scale), "d int, x binary").distinct())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row of vectors (vec_id, embedding)."""
    ship(vectors.sparkSession)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    fit = fit_list(vectors, scale)
    common = fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    d = common["d"]
    same = fit.where(F.col("d") == d)
    model = whitener_of(chan_state(same, d), components)
    k = len(model.values)
    if not k:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    after = chan_state(same, d, model)
    error = float(np.abs(after.scatter / after.n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = integers(batch.column(1), scale).get(d, (None, None))
            if at is None:
                continue
            z, ids = model(x), batch.column(0).take(pa.array(np.repeat(at, k)))
            deviation = [v for v in model.deviation(x) for _ in range(k)]
            fixed = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), np.full(len(ids), model.n), deviation, z.ravel(), np.tile(model.values / model.trace, len(at)), np.full(len(ids), error)]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(v, t) for v, t in zip(fixed, kinds)]], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(project, f"vec_id {kind}, {OUT}")
