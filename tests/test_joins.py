"""Rows that an explode makes are sorted and merged, not broadcast through the driver, however small the table they come from."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import spatial, verify
from lodestone.plans.registry import QUERIES


def broadcasts(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.mark.parametrize("name", ["claim_mismatches", "counted_houses", "lateral_claims", "period_mistakes", "unfounded_claims", "career_factors", "house_lookups"])
def test_charts(spark, sf, name):
    assert broadcasts(QUERIES[name][0](spark, sf)) == 0


def test_boxes(spark):
    b = spark.range(30).select(F.lit(1).alias("page"), F.col("id").alias("no"), F.array(*[(F.col("id") + i).cast("double") for i in (0, 0, 9, 9)]).alias("bbox"))
    b.count()
    near = spatial.grid_candidates(b.withColumnRenamed("bbox", "ba"), b.select("page", F.col("no").alias("v"), F.col("bbox").alias("bb")), ["page"])
    assert broadcasts(near) == 0 and near.count() >= 30 * 30 - 20 * 21


def test_stated_dates(spark):
    """Dates hold give or take a day, also of sub-periods; others, and days that no calendar has, are mistakes."""
    from lodestone.operators import astro, claims

    longitudes = {"Lagna": 5.0, "Sun": 10.0, "Moon": 45.0, "Mars": 100.0, "Mercury": 20.0, "Jupiter": 130.0, "Venus": 200.0, "Saturn": 300.0, "Rahu": 70.0}
    bodies = spark.createDataFrame([(1, b, x, False) for b, x in longitudes.items()], "chart_id int, body string, longitude double, retrograde boolean")
    periods = astro.dashas(spark.createDataFrame([(1, 45.0)], "chart_id int, longitude double").withColumn("birth", F.lit("1990-01-01").cast("date")))
    p, s = periods.where("seq = 2").first(), astro.antardashas(periods.where("seq = 2")).where("sub = 'Sun'").first()
    day = lambda d, by: (d + __import__("datetime").timedelta(days=by)).isoformat()
    said = [f"{p.lord} mahadasha from {day(p.start, i)} to {day(p.end, j)}" for i, j in ((0, 0), (1, -1), (2, 0), (0, -2))] + [f"Sun antardasha from {day(s.start, i)} to {day(s.end, j)}" for i, j in ((-1, 1), (0, 2))] + [f"{p.lord} mahadasha from 2024-02-31 to {p.end}"]
    texts = spark.createDataFrame([(n, 1, t + ".") for n, t in enumerate(said)], "text_id int, chart_id int, text string")
    got = claims.period_mistakes(texts, astro.placements(bodies), periods).collect()
    assert sorted(r.text_id for r in got) == [2, 3, 5, 6] and {r.kind for r in got} == {"maha dates", "antar dates"}


@pytest.mark.parametrize("name", ["lookup_answers", "house_lords", "fact_lines", "chart_yogas"])
def test_chart_rows(spark, sf, name):
    """What needs one chart's bodies only is worked out in the chart's row: orders are dealt, two columns each, and nothing else is shuffled."""
    plan = QUERIES[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(o_orderkey") == 1


@pytest.mark.parametrize("name, deals", [("unfounded_claims", 2), ("period_mistakes", 3)])
def test_statements_are_looked_up_in_their_charts(spark, sf, name, deals):
    """Orders are dealt, two columns at most, and neither statements nor what charts hold become rows that are dealt or written."""
    plan = QUERIES[name][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(o_orderkey") == deals and plan.count("FileScan") == plan.count("orders.parquet") == deals


def test_statements_of_odd_charts(spark):
    """A chart without its rising point has no houses and no lords, but its bodies; of an unknown chart nothing holds; charts may be one row each."""
    from lodestone.operators import astro

    bodies = [(1, "Sun", 10.0), (1, "Moon", 95.0), (2, "Lagna", 5.0), (2, "Sun", 10.0), (2, "Moon", 95.0)]
    rows = spark.createDataFrame([(*b, False) for b in bodies], "chart_id int, body string, longitude double, retrograde boolean")
    said = "Sun is exalted. Moon rules the 4th. Moon is the 4th from the Moon. The Lagna is Aries. Sun mahadasha runs until 2001."
    texts = spark.createDataFrame([(i * 10, i, said) for i in (1, 2, 3)] + [(40, None, said), (50, 2, None), (60, 2, "nothing")], "text_id int, chart_id int, text string")
    periods = spark.createDataFrame([(2, "Sun", "1995-01-01", "2001-01-01"), (3, "Sun", "1995-01-01", "2001-01-01")], "chart_id int, lord string, start string, end string").withColumn("end", F.col("end").cast("date"))
    every = {"dignity", "lord", "from moon", "lagna", "dasha end"}
    want = {10: every - {"dignity"}, 20: {"from moon"}, 30: every - {"dasha end"}, 40: every}
    charts = rows.groupBy("chart_id").agg(F.collect_list(F.struct("body", "longitude", "retrograde")).alias("bodies"))
    for placed in (astro.placements(rows), charts):
        for given in (periods, None):
            got = {}
            for r in astro.unfounded_claims(texts, placed, given).collect():
                got.setdefault(r.text_id, set()).add(r.kind)
            assert got == {k: v if given is not None else v - {"dasha end"} for k, v in want.items()}


def test_houses_are_counted_where_charts_are(spark, sf):
    """Each branch deals its orders, and nothing else is shuffled."""
    plan = QUERIES["house_lookups"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(o_orderkey" in plan and plan.count("Exchange hashpartitioning(") == plan.count("Exchange hashpartitioning(o_orderkey")


def test_dignities_are_read_off_tables(spark):
    """Every planet in every sign as the rules have it, others none, and no rule for each planet in the plan."""
    from lodestone.operators import astro

    bodies = [*astro.PLANETS, "Rahu", "Ketu", "Lagna", None]
    rows = [(i * 12 + s, b, 30.0 * s + 1, s % 2 == 0) for i, b in enumerate(bodies) for s in range(12)]
    p = astro.placements(spark.createDataFrame(rows, "chart_id int, body string, longitude double, retrograde boolean"))
    for r in p.collect():
        up = astro.SIGNS.index(astro.EXALTED[r.body]) if r.body in astro.EXALTED else None
        lord, planet = astro.RULERS[r.sign_no], r.body in astro.PLANETS
        assert r.dignity == (None if up is None else "exalted" if up == r.sign_no else "debilitated" if (up + 6) % 12 == r.sign_no else "own sign" if lord == r.body else None)
        assert r.relation == (None if not planet or lord == r.body else "friend's sign" if lord in astro.FRIENDS[r.body] else "enemy's sign" if lord in astro.ENEMIES[r.body] else "neutral sign")
    assert p.select("dignity", "relation")._jdf.queryExecution().optimizedPlan().toString().count("CASE WHEN") <= 2


def test_lines_are_dealt_before_they_are_grouped(spark, sf):
    """No task gathers the groups of a whole split before the rows are dealt."""
    from lodestone.plans.more import lines
    from lodestone.plans.registry import Tables

    plan = lines(Tables(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange") and "REPARTITION_BY_NUM" in plan


LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_linestatus string"


def test_validate_chart_on_odd_lines(spark, tmp_path):
    """Lines without a quantity or a key, orders that repeat a line, open ones and closed ones: as the SQL has them."""
    import duckdb

    rows = [(1, 1, 1, 1, 5.0, "O"), (1, 1, 1, 2, 5.0, "F"), (1, 1, 1, 3, 6.0, "F"), (2, 1, 1, 1, 0.0, "F"), (2, 1, 1, 2, 7.0, "O"), (3, 1, 1, 1, None, "F"), (4, 1, 1, 1, None, "O"), (4, 1, 1, 2, 8.0, "F")]
    rows += [(5, None, 1, 1, 9.0, "F"), (5, None, 1, 2, 9.5, "O"), (6, 1, 1, 1, 3.0, "F"), (6, 1, 1, 1, 3.0, "F"), (None, 1, 1, 1, 2.0, "O"), (None, 1, 1, 2, 2.0, "F"), (None, 1, 1, 3, 4.0, "F"), (7, 1, 1, 1, 1.0, None)]
    spark.createDataFrame(rows, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    run, sql = QUERIES["validate_chart"]
    got = {tuple(r) for r in run(spark, str(tmp_path)).select("chart_id", "ok", "n_errors").collect()}
    want = {r for r in duckdb.sql(f"WITH lineitem AS (FROM '{tmp_path}/lineitem.parquet/*.parquet') {sql}").fetchall()}
    assert got == want and len(got) == 8


def test_validate_chart_reads_lines_twice(spark, sf):
    """Charts are made once, and what only messages show is not dealt where none asks for them."""
    plan = QUERIES["validate_chart"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange") == 4 and "Broadcast" not in plan and "format_string" not in plan


def test_charts_meet_evidence_by_their_references(spark):
    """No reference is no id, whatever the chart's own; points keep to their references, citations count each; equal ids of two questions are two charts."""
    schema = "chart_id string, question_id int, chart_type string, labels array<string>, series array<struct<name:string,values:array<double>,unit:string>>, value_refs map<string,string>, citations array<string>"
    rows = [
        ("t", 1, "bar", ["a"], [("s", [1.0], "%")], {}, []), ("u", 1, "bar", ["a"], [("s", [1.0], "%")], None, ["zz", "zz", "t"]), ("v", 1, "pie", ["a", "b"], [("s", [1.0, 2.0], "%"), ("r", [2.0, 1.0], "%")], {"s:a": "t", "s:b": "w", "r:a": "w", "r:b": "w"}, []),
        ("v", 2, "bar", ["a"], [("s", [1.0], "%")], {"s:a": "t"}, []), ("n", 1, "bar", None, None, None, None), ("m", 1, "bar", ["a"], [("s", None, "%"), ("r", [3.0], "%")], {"r:a": "w"}, []),
        ("o", 1, "bar", ["a", "b"], [("s", [1.0, 2.0], "%")], {"s:b": "w", "s:a": "t"}, ["t"]),
    ]
    evidence = spark.createDataFrame([(1, "t", [1.0], []), (1, "w", [], [2.0])], "question_id int, id string, numbers array<double>, estimated array<double>")
    out = sorted((r.chart_id, r.n_errors, r.ok, r.approximate, r.chart_type, r.errors) for r in verify.validate_charts(spark.createDataFrame(rows, schema), evidence).collect())
    zz = "citation zz was not returned"
    assert out == [
        ("m", 1, False, False, "bar", ["r:a: value 3 not found in w; closest value there is 2"]), ("n", 0, True, False, "bar", []), ("o", 0, True, True, "bar", []), ("t", 1, False, False, "bar", ["no source given for s:a"]),
        ("u", 3, False, False, "bar", ["no source given for s:a", zz, zz]), ("v", 1, False, False, "bar", ["s:a: source t was not returned"]), ("v", 1, False, True, "pie", ["r:b: value 1 not found in w; closest value there is 2"]),
    ]
