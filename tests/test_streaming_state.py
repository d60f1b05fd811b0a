"""The stateful stream of sign-ins against the batch replay."""

import random

from pyspark.sql import functions as F

from lodestone.operators import ops
from lodestone.streaming.sign_in import sign_ins


def test_sign_ins(spark, tmp_path):
    rng = random.Random(6)
    t0 = 1_700_000_000
    rows = [(i, rng.randrange(5), t0 + 40 * i + rng.randrange(-30, 30), rng.random() < 0.4) for i in range(400)]
    # files hold attempts out of order, within the delay; the last only moves the watermark on
    order = sorted(rows, key=lambda r: r[2] + rng.randrange(0, 500))
    schema = "event_id long, user_id long, ts long, good boolean"

    def frame(part):
        return spark.createDataFrame(part, schema).select("event_id", "user_id", F.timestamp_seconds("ts").alias("created_at"), "good")

    for k in range(0, 400, 100):
        frame(order[k : k + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    frame([(9999, 77, t0 + 10_000_000, True)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, user_id long, created_at timestamp, good boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def run():
        q = sign_ins(stream, most=3, minutes=15, late="10 minutes").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.event_id, r.outcome) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    batch = ops.sign_in_replay(spark.createDataFrame([(i, u, t, g) for i, u, t, g in rows], "event_id long, user_id long, ts_seconds long, good boolean"), most=3, minutes=15)
    want = sorted((r.event_id, r.outcome) for r in batch.collect())
    assert run() == want and {o for _, o in want} == {"ok", "failed", "locked"}
    # from the same checkpoint nothing is given twice, and state goes on
    frame([(10_000, 77, t0 + 20_000_000, True)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == sorted([*want, (9999, "ok")])


def test_seconds_as_the_sql_has_them(spark, tmp_path):
    """A lock from the nearest second on: 0.6 counts as 1, so that 3000 minutes later 0.4 is still locked."""
    import datetime

    import duckdb

    from lodestone.plans.registry import QUERIES

    at = [(0, 100_000), (1, 600_000), (180_001, 400_000), (180_002, 100_000)]
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(i, t0 + datetime.timedelta(seconds=s, microseconds=u), 7, "error", 1.0, '{"k": 1}') for i, (s, u) in enumerate(at)]
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    c.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    c.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    run, sql = QUERIES["sign_in_replay"]
    got = {r.event_id: r.outcome for r in run(spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(sql).fetchall()) and got[2] == "locked"
