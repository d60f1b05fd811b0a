"""Line-delimited JSON sources and sinks, caches, golden sets, document replacement and restore checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import cost


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records between line feeds only; blank lines are no records and a damaged one fails the read."""
    return spark.read.schema(schema).option("lineSep", "\n").option("mode", "FAILFAST").json(path)


def read_jsonl_split(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records, damaged lines): nothing is dropped silently."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record"), parsed.where("r._corrupt_record IS NOT NULL").select(F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their number in their file, from 1, however the files are split into tasks.

    A task reads the lines of a split in order, so a line's place in its split is known from its id; what the splits before it
    hold is added. Only counts by split are gathered, and Spark's own reader does the reading, from any store.
    """
    at = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(at["file_path"].alias("file"), at["file_block_start"].alias("start"), "value", F.monotonically_increasing_id().alias("id"))
    splits = rows.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = splits.withColumn("before", before).select("file", "start", "first", "before")
    return rows.join(placed, ["file", "start"]).select("file", (F.col("before") + F.col("id") - F.col("first") + 1).alias("line"), "value")


def read_jsonl_numbered(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good records with file and line, damaged lines: file, line, value). Blank lines are counted and are neither."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = numbered_lines(spark, path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    return parsed.where("r._corrupt_record IS NULL").select("file", "line", "r.*").drop("_corrupt_record"), parsed.where("r._corrupt_record IS NOT NULL").select("file", "line", "value")


def write_jsonl(df: DataFrame, path: str, by: str | None = "doc_id") -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by and by in df.columns else w).json(path)


def last_per_key(cache: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """What an append-only cache holds: the last record of each key."""
    return cache.groupBy(key).agg(F.max_by(F.struct("*"), seq).alias("r")).select("r.*")


def merge_absent(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """old with the records of new whose key it lacks; vectors of another length are refused by raising at run time."""
    if "vector" in old.columns:
        size = old.agg(F.max(F.size("vector")).alias("dims"))
        new = new.crossJoin(F.broadcast(size)).withColumn("vector", F.when(F.coalesce(F.size("vector") == F.col("dims"), F.lit(True)) | F.col("dims").isNull(), F.col("vector")).otherwise(F.raise_error(F.lit("vectors of another model")).cast(new.schema["vector"].dataType))).drop("dims")
    return old.unionByName(new.join(old, key, "left_anti").select(*old.columns))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    return wanted.select(key).distinct().join(cache, key, "left_anti")


def replace_document(documents: DataFrame, children: dict[str, DataFrame], new: DataFrame, new_children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Next versions of documents (doc_id, source_file, build_hash, version) and their child tables (doc_id).

    A new document equal to the old by id and build_hash changes nothing; otherwise old ones of its file or id go with
    their children, and its version is one more. Write the results to a new folder and switch to it.
    """
    n = new.drop("version") if "version" in new.columns else new
    same = documents.select("doc_id", "build_hash")
    fresh = n.join(same, ["doc_id", "build_hash"], "left_anti")
    marks = fresh.select(F.col("doc_id").alias("n_id"), F.col("source_file").alias("n_file"))
    gone = documents.join(marks, documents["doc_id"] == marks["n_id"], "left_semi").select("doc_id", "source_file", "version").union(documents.join(marks, documents["source_file"] == marks["n_file"], "left_semi").select("doc_id", "source_file", "version")).distinct()
    last = gone.groupBy("source_file").agg(F.max("version").alias("old"))
    versioned = fresh.join(last, "source_file", "left").withColumn("version", F.coalesce("old", F.lit(0)) + 1).select(*documents.columns)
    docs = documents.join(gone, "doc_id", "left_anti").unionByName(versioned)
    ids = fresh.select("doc_id")
    return docs, {k: c.join(gone, "doc_id", "left_anti").unionByName(new_children[k].join(ids, "doc_id", "left_semi")) for k, c in children.items()}


def remove_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of the documents (doc_id)."""
    return {k: t.join(ids, "doc_id", "left_anti") for k, t in tables.items()}


def golden_problems(items: DataFrame) -> DataFrame:
    """(question_id, problem) of items (seq, question_id, follows): repeated ids, and parents that do not come before."""
    w = Window.partitionBy("question_id")
    dup = items.withColumn("n", F.count("*").over(w)).where("n > 1").select("question_id", F.lit("repeated id").alias("problem")).distinct()
    parents = items.select(F.col("question_id").alias("follows"), F.col("seq").alias("p_seq"))
    late = items.where("follows IS NOT NULL").join(parents, "follows", "left").groupBy("question_id").agg(F.min("p_seq").alias("p"), F.min("seq").alias("s")).where("p IS NULL OR p >= s").select("question_id", F.lit("follows a later or unknown question"))
    return dup.union(late)


def golden_subset(items: DataFrame, only: list[str]) -> DataFrame:
    """The named questions and those they follow."""
    chosen = items.where(F.col("question_id").isin(only))
    ids = chosen.select("question_id").union(chosen.where("follows IS NOT NULL").select("follows")).distinct()
    return items.join(ids, "question_id", "left_semi")


def append_log(log: DataFrame, new: DataFrame, prices: DataFrame) -> DataFrame:
    """The query log with new rows (trace_id, model, tokens_in, tokens_out, ...): each trace once, the cost from prices (model,
    price_in, price_out) a million tokens, null where the model has none."""
    fresh = new.dropDuplicates(["trace_id"]).join(log.select("trace_id"), "trace_id", "left_anti")
    priced = fresh.join(prices, "model", "left").withColumn("cost_usd", cost(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out")))
    return log.unionByName(priced.select(log.columns))


def migrate(tables: dict[str, DataFrame], applied: list[str], steps: list[tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]]]]) -> tuple[dict[str, DataFrame], list[str]]:
    """(tables, applied) after the steps (name, function) that are not applied yet, in their order; applied names must be the first of them."""
    names = [n for n, _ in steps]
    if names[: len(applied)] != list(applied) or len(set(names)) < len(names):
        raise ValueError("applied migrations are not the first of those known")
    out = dict(tables)
    for _, step in steps[len(applied) :]:
        out = step(out)
    return out, names


def restore_report(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, restored, same): of each table the rows before and after a restore, and whether they are the same rows."""

    def mark(d: DataFrame, name: str, n: str) -> DataFrame:
        return d.agg(F.count("*").alias(n), F.sum(F.xxhash64(*sorted(d.columns)).cast("decimal(38,0)")).alias(f"{n}_mark")).select(F.lit(name).alias("name"), n, f"{n}_mark")

    every = [mark(d, k, "rows").join(mark(after.get(k, d.limit(0)), k, "restored"), "name") for k, d in before.items()]
    return reduce(DataFrame.union, every).select("name", "rows", "restored", ((F.col("rows") == F.col("restored")) & F.col("rows_mark").eqNullSafe(F.col("restored_mark"))).alias("same"))


def replaced_documents(documents: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of documents that replace_document() would take out, to be archived first."""
    same = documents.select("doc_id", "build_hash")
    fresh = new.join(same, ["doc_id", "build_hash"], "left_anti").select(F.col("doc_id").alias("n_id"), F.col("source_file").alias("n_file"))
    by_id = documents.join(fresh, documents["doc_id"] == fresh["n_id"], "left_semi")
    return by_id.union(documents.join(fresh, documents["source_file"] == fresh["n_file"], "left_semi")).distinct()


def read_questions(path: str) -> list[dict]:
    """Questions or cases of a YAML file, a list of mappings; each needs an id of its own. A file of a person's hand, read on the driver."""
    import yaml

    with open(path, encoding="utf-8") as f:
        items = yaml.safe_load(f) or []
    ids = [x.get("id") for x in items]
    if None in ids or len(set(ids)) < len(ids):
        raise ValueError("every item needs an id of its own")
    return items
