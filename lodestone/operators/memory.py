"""Long-term memory: recall, upserts, idle threads and stale summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import before
from ..functions.text import ID, collapse
from .vectors import nearest


def recall(memories: DataFrame, queries: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, memory_id, kind, score, place): k semantic memories, then half as many episodes, of the asking user, by similarity."""
    top = nearest(memories, queries, k, "memory_id", within=["user_id"], kind="kind")
    order = Window.partitionBy("query_id", "kind").orderBy(F.desc("score"), "memory_id")
    top = top.withColumn("place", F.row_number().over(order)).where((F.col("kind") == "semantic") & (F.col("place") <= k) | (F.col("kind") == "episodic") & (F.col("place") <= max(1, k // 2)))
    return top.select("query_id", "memory_id", "kind", "score", "place")


def remember(memories: DataFrame, new: DataFrame) -> DataFrame:
    """memories (user_id, kind, subject, text, created_at, updated_at) with new ones merged by subject; created_at stays the first."""
    key = ["user_id", "kind", "subject"]
    return memories.unionByName(new).groupBy(*key).agg(F.max_by("text", F.struct("updated_at", "text")).alias("text"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))


def listed(memories: DataFrame, user_id) -> DataFrame:
    """A user's memories, newest first."""
    return memories.where(F.col("user_id") == user_id).orderBy(F.desc("updated_at"), "kind", "subject")


def delete(memories: DataFrame, user_id, keys: DataFrame | None = None) -> DataFrame:
    """memories without those of a user: all of them, or those that keys (kind, subject) name. Others' memories are never touched."""
    own = F.col("user_id") == user_id
    if keys is None:
        return memories.where(~F.coalesce(own, F.lit(False)))
    named = keys.select("kind", "subject").distinct().withColumn("user_id", F.lit(user_id).cast(memories.schema["user_id"].dataType))
    return memories.join(named, ["user_id", "kind", "subject"], "left_anti").select(memories.columns)


def forget(memories: DataFrame, as_of: str, days: int = 365) -> DataFrame:
    return memories.where(F.col("updated_at") >= before(as_of, days=days))


def idle_threads(log: DataFrame, as_of: str, minutes: int = 60) -> DataFrame:
    """(user_id, thread_id, last_at, questions) of owned threads whose last question is older, questions in order."""
    entry = F.struct("created_at", "trace_id", "question")
    g = log.where("user_id IS NOT NULL").groupBy("user_id", "thread_id").agg(F.max("created_at").alias("last_at"), F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["question"]).alias("questions"))
    return g.where(F.col("last_at") < before(as_of, mins=minutes))


def stale_episodes(idle: DataFrame, episodes: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Idle threads without a summary (thread_id, updated_at) as new as their last question, of users with memory on."""
    j = idle.join(episodes.select("thread_id", "updated_at"), "thread_id", "left").where(F.col("updated_at").isNull() | (F.col("updated_at") < F.col("last_at")))
    return j if users is None else j.join(users.where("memory_on").select("user_id"), "user_id", "left_semi")


def clean_statement(c: Column, most: int = 300) -> Column:
    """The statement in one line; null if empty, too long or holding ids."""
    s = collapse(c)
    return F.when((s != "") & (F.length(s) <= most) & ~s.rlike(rf"[(\[]\s*{ID}"), s)


def new_statements(statements: DataFrame, most: int = 5) -> DataFrame:
    """At most so many clean statements (user_id, seq, text) a user, each once."""
    s = statements.withColumn("text", clean_statement(F.col("text"))).where("text IS NOT NULL").groupBy("user_id", "text").agg(F.min("seq").alias("seq"))
    return s.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("seq"))).where(F.col("k") <= most).drop("k")
