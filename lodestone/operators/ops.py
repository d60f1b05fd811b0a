"""Operations: usage, cost, alerts, retention, sessions, sign-in rules. as_of is always a parameter."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import before, kept_until, moment, within
from .folds import streamed


def questions_per_day(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return log.where(within(F.col("created_at"), as_of, days=days)).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("questions"))


def dropped_rate(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """One row: share of answers that lost blocks; null without questions."""
    return log.where(within(F.col("created_at"), as_of, days=days)).agg(F.round(F.avg((F.col("validator_result") == "dropped_blocks").cast("int")), 6).alias("dropped_rate"))


def slowest(log: DataFrame, as_of: str, days: int = 30, n: int = 10) -> DataFrame:
    return log.where(within(F.col("created_at"), as_of, days=days)).orderBy(F.desc("latency_ms"), "trace_id").limit(n).select("trace_id", "user_id", "latency_ms")


def cost_per_user(log: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return log.where(within(F.col("created_at"), as_of, days=days)).groupBy("user_id").agg(F.count("*").alias("questions"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 2).alias("cost_usd"))


def failed_per_day(auth: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return auth.where(within(F.col("created_at"), as_of, days=days) & (F.col("event_type") == "login_failure")).groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("failed"))


def usage_today(log: DataFrame, as_of: str, most_questions: int = 100, most_cost: float = 5.0) -> DataFrame:
    """(user_id, questions, cost_usd, refused) since the last midnight of as_of, which is a local time of the zone of created_at."""
    today = log.where((F.col("created_at") >= F.date_trunc("day", moment(as_of))) & (F.col("created_at") <= moment(as_of)))
    g = today.groupBy("user_id").agg(F.count("*").alias("questions"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 2).alias("cost_usd"))
    return g.withColumn("refused", (F.col("questions") >= most_questions) | (F.col("cost_usd") >= most_cost))


def alerts(log: DataFrame, auth: DataFrame, as_of: str, most_cost: float = 5.0, most_dropped: float = 0.3, least_questions: int = 5, most_failures: int = 20) -> DataFrame:
    """(alert, value): up to three rows."""
    today = F.col("created_at") >= F.date_trunc("day", moment(as_of))
    hour = within(F.col("created_at"), as_of, hours=1)
    bad = F.col("validator_result") == "dropped_blocks"
    q = log.where(F.col("created_at") <= moment(as_of)).agg(F.round(F.coalesce(F.sum(F.when(today, F.col("cost_usd"))), F.lit(0.0)), 2).alias("cost"), F.count_if(hour).alias("n"), F.count_if(hour & bad).alias("dropped"))
    a = auth.agg(F.count_if(hour & (F.col("event_type") == "login_failure")).alias("failed"))
    one = q.crossJoin(a)  # one row each
    kinds = F.array(
        F.when(F.col("cost") > most_cost, F.struct(F.lit("cost_today").alias("alert"), F.col("cost").alias("value"))),
        F.when((F.col("n") >= least_questions) & (F.col("dropped") / F.col("n") > most_dropped), F.struct(F.lit("dropped_rate").alias("alert"), F.round(F.col("dropped") / F.col("n"), 6).alias("value"))),
        F.when(F.col("failed") > most_failures, F.struct(F.lit("failed_sign_ins").alias("alert"), F.col("failed").cast("double").alias("value"))),
    )
    return one.select(F.explode(F.array_compact(kinds)).alias("x")).select("x.alert", "x.value")


def retention(tables: dict[str, DataFrame], as_of: str, days: dict[str, int]) -> dict[str, DataFrame]:
    """Each table (with created_at, or expires_at and revoked_at for sessions) without the rows past its days."""
    out = {}
    for name, df in tables.items():
        ts = kept_until(F.col("expires_at"), F.col("revoked_at")) if "expires_at" in df.columns else F.col("created_at")
        out[name] = df.where(~F.coalesce(ts < before(as_of, days=days[name]), F.lit(False)))
    return out


def retention_counts(log: DataFrame, auth: DataFrame, as_of: str, log_days: int = 90, auth_days: int = 365) -> DataFrame:
    """(name, n) of rows that retention would delete."""
    a = log.agg(F.count_if(F.col("created_at") < before(as_of, days=log_days)).alias("n")).select(F.lit("query_log").alias("name"), "n")
    b = auth.agg(F.count_if(F.col("created_at") < before(as_of, days=auth_days)).alias("n")).select(F.lit("auth_events").alias("name"), "n")
    return a.union(b)


def orphan_threads(states: DataFrame, log: DataFrame) -> DataFrame:
    """Saved threads (thread_id) that no question names."""
    return states.select("thread_id").distinct().join(log.where("thread_id IS NOT NULL"), "thread_id", "left_anti")


def ip_throttle(auth: DataFrame, most: int = 20, minutes: int = 15) -> DataFrame:
    """auth rows (event_id, ip, event_type, created_at) with the failures of their address in the minutes before, and throttled.

    Time is cut into stretches of that many minutes; a failure counts in its own and in the next, so that a window needs one
    stretch only, and an address with very many events is spread over them.
    """
    span = minutes * 60_000_000
    rows = auth.withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp"))).withColumn("failed", (F.col("event_type") == "login_failure").cast("int"))
    rows = rows.withColumn("own", F.lit(True)).withColumn("stretch", F.floor(F.col("at") / span))
    carried = rows.where("failed = 1").withColumn("own", F.lit(False)).withColumn("stretch", F.col("stretch") + 1)
    w = Window.partitionBy("ip", "stretch").orderBy("at").rangeBetween(-span, -1)
    n = F.coalesce(F.sum("failed").over(w), F.lit(0)).cast("long")
    out = rows.union(carried).withColumn("recent_failures", n).where("own")
    return out.select(*auth.columns, "recent_failures", (F.col("recent_failures") >= most).alias("throttled"))


def sign_in_replay(attempts: DataFrame, most: int = 5, minutes: int = 15) -> DataFrame:
    """attempts (event_id, user_id, ts_seconds, good) with outcome: locked, ok or failed.

    Five failures lock the account for the minutes and clear the count; success clears it. A fold over one user's attempts.
    """

    at, ok = attempts.columns.index("ts_seconds"), attempts.columns.index("good")

    def replay(rows: Iterator[tuple]):
        failed, until = 0, float("-inf")
        for row in rows:
            if row[at] < until:
                outcome = "locked"
            elif row[ok]:
                failed, outcome = 0, "ok"
            else:
                failed, outcome = failed + 1, "failed"
                if failed >= most:
                    failed, until = 0, row[at] + 60 * minutes
            yield (*row, outcome)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in attempts.schema)
    return streamed(attempts, ["user_id"], ["ts_seconds", "event_id"], replay, f"{fields}, outcome string")


def threads_of(log: DataFrame, n: int = 50) -> DataFrame:
    """(user_id, thread_id, title, turns, last_at): each user's newest n threads, titled by their first question."""
    g = log.groupBy("user_id", "thread_id").agg(F.min_by("question", F.struct("created_at", "trace_id")).alias("title"), F.count("*").alias("turns"), F.max("created_at").alias("last_at"))
    order = Window.partitionBy("user_id").orderBy(F.desc("last_at"), "thread_id")
    return g.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def thread_turns(log: DataFrame, user_id, thread_id) -> DataFrame:
    """Turns of a thread in order, for its owner only."""
    return log.where((F.col("user_id") == user_id) & (F.col("thread_id") == thread_id)).orderBy("created_at", "trace_id")


def live_sessions(sessions: DataFrame, as_of: str, idle_minutes: int = 60) -> DataFrame:
    alive = F.col("revoked_at").isNull() & (F.col("expires_at") > moment(as_of)) & (F.col("last_seen_at") > before(as_of, mins=idle_minutes))
    return sessions.where(alive)


def password_problems(candidates: DataFrame, common: DataFrame, least: int = 12) -> DataFrame:
    """(email, problem) of candidates (email, password) that the policy refuses; null where it does not."""
    j = candidates.join(common.select(F.lower("password").alias("low"), F.lit(True).alias("known")).distinct(), F.lower(candidates["password"]) == F.col("low"), "left")
    name = F.lower(F.substring_index("email", "@", 1))
    why = F.when(F.length(candidates["password"]) < least, "too short").when(F.col("known"), "too common").when((name != "") & F.contains(F.lower(candidates["password"]), name), "contains the email name")
    return j.select("email", why.alias("problem"))


def library_counts(documents: DataFrame, chunks: DataFrame, collections: list[str]) -> DataFrame:
    """(source_file, documents, one count a collection) of every document, also those without chunks."""
    c = chunks.groupBy("doc_id").agg(*[F.count_if(F.col("collection") == x).alias(x) for x in collections])
    zero = [F.sum(F.coalesce(F.col(x), F.lit(0))).alias(x) for x in collections]
    return documents.join(c, "doc_id", "left").groupBy("source_file").agg(F.count("*").alias("documents"), *zero)


def recent_events(auth: DataFrame, users: DataFrame, n: int = 50) -> DataFrame:
    """The newest n events with the email of their user, or the one tried."""
    j = auth.join(users.select("user_id", "email"), "user_id", "left").select("event_id", "created_at", "event_type", F.coalesce("email", "email_attempted").alias("email"), "ip")
    return j.orderBy(F.desc("created_at"), F.desc("event_id")).limit(n)


def list_users(users: DataFrame, as_of: str) -> DataFrame:
    """(email, status, locked, created_at), by email; locked is null where no lock was ever set."""
    return users.select("email", "status", (F.col("locked_until") > moment(as_of)).alias("locked"), "created_at").orderBy("email")


def sign_in_outcomes(attempts: DataFrame, users: DataFrame, auth: DataFrame, most: int = 5, minutes: int = 15, ip_most: int = 20) -> DataFrame:
    """attempts (event_id, email, ip, created_at, good) with outcome: throttled, unknown, disabled, locked, failed or ok, in that order.

    Failures of an address are counted in the log (auth: event_id, ip, event_type, created_at) over the minutes before; only
    attempts that pass the address, the account (users: email, status) and its status count for the lock.
    """
    probe = attempts.select("event_id", "ip", F.lit("attempt").alias("event_type"), "created_at")
    seen = ip_throttle(auth.select("event_id", "ip", "event_type", "created_at").union(probe), ip_most, minutes).where("event_type = 'attempt'").select("event_id", (F.col("throttled") & F.col("ip").isNotNull()).alias("throttled"))
    j = attempts.join(seen, "event_id").join(users.select("email", "status"), "email", "left")
    early = F.when(F.col("throttled"), "throttled").when(F.col("status").isNull(), "unknown").when(F.col("status") != "active", "disabled")
    j = j.withColumn("early", early)
    due = j.where("early IS NULL").select("event_id", F.col("email").alias("user_id"), F.unix_seconds(F.col("created_at").cast("timestamp")).alias("ts_seconds"), "good")
    replayed = sign_in_replay(due, most, minutes).select("event_id", "outcome")
    return j.join(replayed, "event_id", "left").select(*attempts.columns, F.coalesce("early", "outcome").alias("outcome"))


def end_sessions(sessions: DataFrame, users: DataFrame, at: str) -> DataFrame:
    """sessions with those of the users (user_id) revoked at a moment, unless they were before: what a sign-out and a new password do."""
    out = sessions.join(users.select("user_id").distinct().withColumn("ends", F.lit(True)), "user_id", "left")
    return out.withColumn("revoked_at", F.when(F.col("ends"), F.coalesce("revoked_at", moment(at))).otherwise(F.col("revoked_at"))).select(sessions.columns)


def password_changes(requests: DataFrame, common: DataFrame, least: int = 12) -> DataFrame:
    """(email, result) of requests (email, verified, current, password): not signed in, wrong, the same, what the policy says, or changed."""
    policy = password_problems(requests.select("email", "password"), common, least)
    j = requests.join(policy, "email")
    result = F.when(F.col("verified").isNull(), "not signed in").when(~F.col("verified"), "the current password is not correct").when(F.col("password") == F.col("current"), "the new password must differ")
    return j.select("email", F.coalesce(result, "problem", F.lit("changed")).alias("result"))
