"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: Size that Spark assumes for inputs it knows nothing about is far above this.
UNKNOWN_BYTES = 1 << 55
CODEC = pa.Codec("zstd", compression_level=1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if all run on this machine."""
    sc = ship(spark).sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "/tmp/checkpoints")
    return sc.getCheckpointDir()


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lodestone-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df into the shared folder and read it again: the work is done once, its lineage ends and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{tables_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> bool:
    """Deletes what materialize() wrote for this application; results not yet read are lost with it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(tables_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the size of df, from its files; 0 where it has none."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return n if n < UNKNOWN_BYTES else 0


def bucket_count(df: DataFrame, bytes_each: int = 2 << 20, low: int = 512, high: int = 1 << 17) -> int:
    """A power of two: buckets that hash keys are dealt to, so that one bucket's share of the input stays near bytes_each."""
    want = input_bytes(df) / bytes_each or 2048
    return int(min(high, max(low, 1 << int(np.ceil(np.log2(max(want, 1)))))))


def text_of(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row in them; nulls count as empty."""
    col = batch.column(batch.schema.get_field_index(name)).fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each as one compressed byte string; unpack() needs the same kinds."""
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return head + np.uint32(len(body)).tobytes() + CODEC.compress(body, asbytes=True)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    k = len(kinds)
    lengths = np.frombuffer(blob, np.uint32, k + 1)
    body, at, out = CODEC.decompress(blob[4 * k + 4 :], int(lengths[k]), asbytes=True), 0, []
    for n, kind in zip(lengths[:k], kinds):
        out.append(np.frombuffer(body, kind, int(n), at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def gaps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))



def sorted_runs(batches, keys: int):
    """Of record batches sorted by their first `keys` columns: each run of equal keys as (key, one batch), across batch borders."""
    held: list[pa.RecordBatch] = []
    held_key = None

    def whole():
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_pylist() for i in range(keys)]
        names = list(zip(*cols))
        a = 0
        for b in range(1, len(names) + 1):
            if b == len(names) or names[b] != names[a]:
                if held and names[a] != held_key:
                    yield held_key, whole()
                    held = []
                held.append(batch.slice(a, b - a))
                held_key = names[a]
                a = b
    if held:
        yield held_key, whole()
