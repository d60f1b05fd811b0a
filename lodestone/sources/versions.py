"""Document tables in versions: commits are atomic, readers see one version.

A store is a folder. Its tables are Parquet files in `data`, dealt to buckets by a hash of doc_id; version n is one small file,
`versions/n.json`, that names the files of every table and bucket. Writers put new files where nobody looks, and then publish
version n + 1 under a name that only one of them can take: whoever comes second gets Conflict, has changed nothing, and can start again from
the version that won. Readers resolve a version once and read its files, so that no commit in between shows. A
replacement rewrites the buckets of the documents it touches and takes over the others as they are. What a writer left that never published is
named by no version and goes with sweep().

Publishing needs a store whose rename fails if the name is taken (HDFS), or hard links (local folders).
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path
from .files import replace_document, replaced_documents


class Conflict(RuntimeError):
    """Another writer published the version first; nothing was changed."""


BUCKET = "_bucket"


@dataclass
class Version:
    """Number, and of each table its schema and the folders of each bucket."""

    number: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


class Store:
    """A folder of versions; buckets: over how many each table is spread, fixed when the first version is written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # versions

    def _listed(self, folder: str) -> list:
        p, fs = hadoop_path(self.spark, f"{self.path}/{folder}")
        return [s for s in fs.listStatus(p)] if fs.exists(p) else []

    def latest(self) -> Version:
        names = [s.getPath().getName() for s in self._listed("versions")]
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        return self.version(max(numbers)) if numbers else Version()

    def version(self, number: int) -> Version:
        text = self.spark.read.text(f"{self.path}/versions/{number:012}.json", wholetext=True).first()["value"]
        got = json.loads(text)
        self.buckets = got["buckets"]
        return Version(number, got["tables"])

    def read(self, version: Version | None = None) -> dict[str, DataFrame]:
        """Every table of a version, the latest unless given."""
        v = version or self.latest()
        return {name: self._frame(t, None) for name, t in v.tables.items()}

    def _frame(self, table: dict, buckets: set[int] | None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        paths = [f"{self.path}/{p}" for b, p in sorted(table["files"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # commits

    def _bucket(self, c: str = "doc_id"):
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _write(self, df: DataFrame) -> dict[str, str]:
        """Writes df to a new folder; the part of each bucket that has rows."""
        folder = f"data/{uuid.uuid4().hex}"
        df.withColumn(BUCKET, self._bucket()).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        named = [s.getPath().getName() for s in self._listed(folder)]
        return {n.split("=")[1]: f"{folder}/{n}" for n in named if n.startswith(f"{BUCKET}=")}

    def _publish(self, v: Version) -> None:
        jvm = self.spark.sparkContext._jvm
        temp, fs = hadoop_path(self.spark, f"{self.path}/data/{uuid.uuid4().hex}.json")
        final, _ = hadoop_path(self.spark, f"{self.path}/versions/{v.number:012}.json")
        fs.mkdirs(final.getParent())
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "tables": v.tables}).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":  # a hard link is made or the name is taken
                local = [jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()) for p in (final, temp)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                context.rename(temp, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            if "AlreadyExists" in str(e):
                raise Conflict(f"version {v.number} is taken") from None
            raise
        finally:
            fs.delete(temp, False)

    def commit(self, base: Version, tables: dict[str, DataFrame], touched: set[int] | None = None) -> Version:
        """Publishes the version after base, in which tables are new; touched: they hold these buckets only, the others stay base's.

        Tables of base that are not named stay as they are.
        """
        out = dict(base.tables)
        for name, df in tables.items():
            files = self._write(df)
            if touched is not None and name in base.tables:
                files = {**{b: p for b, p in base.tables[name]["files"].items() if int(b) not in touched}, **files}
            out[name] = {"schema": json.loads(df.schema.json()), "files": files}
        v = Version(base.number + 1, out)
        self._publish(v)
        return v

    def replace_documents(self, new: DataFrame, children: dict[str, DataFrame], documents: str = "documents", tries: int = 5) -> tuple[str, Version]:
        """("written" or "unchanged", version) after documents and their child tables replaced what the store had of them.

        New documents (doc_id, source_file, build_hash) equal to stored ones by id and hash change nothing; others take the place of
        those with their id or file, children included, as files.replace_document() has it. After a Conflict all is worked out anew.
        """
        for _ in range(tries):
            base = self.latest()
            if documents not in base.tables:
                first = new.withColumn("version", F.lit(1))
                try:
                    return "written", self.commit(base, {documents: first, **children})
                except Conflict:
                    continue
            old = self._frame(base.tables[documents], None)
            same = old.select("doc_id", "build_hash")
            fresh = new.join(same, ["doc_id", "build_hash"], "left_anti")
            moved = replaced_documents(old, new).select("doc_id").union(fresh.select("doc_id"))
            touched = {r[0] for r in moved.select(self._bucket()).distinct().collect()}  # at most as many as there are buckets
            if not touched:
                return "unchanged", base
            # versions are looked up over all documents; what is written are the buckets touched
            parts = {k: self._frame(base.tables[k], touched) for k in children}
            docs, kids = replace_document(old, parts, new, children)
            docs = docs.where(self._bucket().isin(sorted(touched)))
            try:
                return "written", self.commit(base, {documents: docs, **kids}, touched)
            except Conflict:
                continue
        raise Conflict(f"lost {tries} times")

    def remove(self, ids: DataFrame, tries: int = 5) -> Version:
        """Every table without the rows of the documents (doc_id)."""
        for _ in range(tries):
            base = self.latest()
            touched = {r[0] for r in ids.select(self._bucket()).distinct().collect()}
            kept = {k: self._frame(t, touched).join(ids.select("doc_id"), "doc_id", "left_anti").select(*[f["name"] for f in t["schema"]["fields"]]) for k, t in base.tables.items()}
            try:
                return self.commit(base, kept, touched) if touched else base
            except Conflict:
                continue
        raise Conflict(f"lost {tries} times")

    def sweep(self, keep: int = 10, older_than: float = 86_400.0) -> int:
        """Deletes versions but the last `keep`, and files that none of these names and that are older (seconds) than any writer works; how many."""
        numbers = sorted(int(s.getPath().getName()[:-5]) for s in self._listed("versions") if s.getPath().getName().endswith(".json"))
        held = {p.split("/")[1] for n in numbers[-keep:] for t in self.version(n).tables.values() for p in t["files"].values()}
        before, gone = (time.time() - older_than) * 1000, 0
        for n in numbers[:-keep]:
            p, fs = hadoop_path(self.spark, f"{self.path}/versions/{n:012}.json")
            gone += fs.delete(p, False)
        for s in self._listed("data"):
            if s.getPath().getName() not in held and s.getModificationTime() < before:
                gone += hadoop_path(self.spark, self.path)[1].delete(s.getPath(), True)
        return gone
