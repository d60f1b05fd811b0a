"""Folds over the ordered rows of a key, for what no window expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def streamed(df: DataFrame, keys: list[str], order: list[str], run: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, rows: int = 4096) -> DataFrame:
    """run(rows) of each key's rows in order, an iterator of tuples of df's columns; what it gives are rows of schema.

    Rows are dealt by key and sorted in their partition, and a task streams them: many small keys cost no call of Spark's
    each, and a large key is never held, only what run holds of it. Results leave in batches. A key's rows meet in one task,
    as their order demands.
    """
    shape = to_arrow_schema(T._parse_datatype_string(schema))
    at = [df.columns.index(k) for k in keys]

    def emit(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, shape)], schema=shape)

    def task(batches):
        every = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        out: list[tuple] = []
        for _, own in groupby(every, key=lambda row: tuple(row[i] for i in at)):
            for x in run(own):
                out.append(x)
                if len(out) >= rows:
                    yield emit(out)
                    out = []
        yield emit(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(task, schema)


def fold(df: DataFrame, keys: list[str], order: list[str], run: Callable[[list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """As streamed(), for a run that needs all rows of a key at once: they are held as a list."""
    return streamed(df, keys, order, lambda rows: run(list(rows)), schema)
