"""Sessions: one with sound settings where the caller has none, and this package on every executor."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_lock = threading.Lock()


def session(app: str = "lodestone", **more: str) -> SparkSession:
    """The active session, or one with adaptive plans, UTC and Arrow."""
    b = SparkSession.builder.appName(app)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.skewJoin.enabled": "true", **more}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python, once an application, so that it need not be installed there."""
    sc = spark.sparkContext
    with _lock:  # tools are dispatched from threads
        if sc.applicationId not in _shipped:
            root = Path(__file__).resolve().parent
            folder = tempfile.mkdtemp(prefix="lodestone-")  # on the driver, whose file server hands it out until the application ends
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            name = os.path.join(folder, "lodestone_package.zip")
            with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
                for p in sorted(root.rglob("*.py")):
                    z.write(p, p.relative_to(root.parent))
            sc.addPyFile(name)
            _shipped.add(sc.applicationId)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, one of our own if all run on this machine."""
    sc = ship(spark).sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "/tmp/checkpoints"
    return folder


def new_folder(spark: SparkSession) -> str:
    """A name that nothing has yet, in the shared folder."""
    return f"{shared_folder(spark)}/lodestone-{spark.sparkContext.applicationId}/made-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: its work is done once and its lineage ends."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def many(df: DataFrame) -> DataFrame:
    """df, sorted and merged wherever it is joined next.

    For rows that an explode makes: Spark takes them for as many as those they come from, and would gather and broadcast them through the
    driver where that estimate is small.
    """
    return df.hint("merge")


def hadoop_path(spark: SparkSession, path: str):
    """(path, file system) of the JVM for a path of any store."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
