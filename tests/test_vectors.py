"""Exact and indexed vector search against plain loops."""

import numpy as np
import pytest

from lodestone.operators import vectors as v


def brute(rows, queries, n):
    """rows (key, vector, group), queries (query_id, vector, group): {query_id: [(key, score)]}."""

    def usable(x):
        return x is not None and len(x) and all(c is not None for c in x)

    def cos(a, b):
        a, b = np.array(a, float), np.array(b, float)
        size = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / size), 9) if size else 0.0

    out = {}
    for q, x, g in queries:
        if usable(x):
            scored = [(k, cos(x, y)) for k, y, h in rows if h == g and usable(y) and len(x) == len(y)]
            if scored:
                out[q] = sorted(scored, key=lambda s: (-s[1], s[0]))[:n]
    return out


def ranked(df, key):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r[key], r.score))
    return {q: sorted(s, key=lambda x: (-x[1], x[0])) for q, s in out.items()}


def same(got, want):
    assert {q: [k for k, _ in s] for q, s in got.items()} == {q: [k for k, _ in s] for q, s in want.items()}
    assert all(abs(a[1] - b[1]) < 2e-9 for q in want for a, b in zip(got[q], want[q]))


def clustered(seed, n, centres, d=16, spread=0.25):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d))
    return (c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("ask_bytes", [64 << 20, 600])
def test_nearest(spark, ask_bytes):
    x = clustered(1, 300, 6, d=4)
    rows = [(f"k{i:03}", e.tolist(), f"g{i % 3}") for i, e in enumerate(x)] + [("z1", [0.0] * 4, "g0"), ("z2", None, "g0"), ("z3", [1.0, None, 1.0, 1.0], "g0"), ("z4", [1.0, 2.0], "g0"), ("z5", [], "g1"), ("z6", x[0].tolist(), None)]
    rows += [(f"t{i}", x[5].tolist(), "g2") for i in range(30)]
    queries = [(i, x[i * 7].tolist(), f"g{i % 4}") for i in range(20)] + [(30, None, "g0"), (31, [0.0] * 4, "g1"), (32, [1.0, 1.0], "g0"), (33, [], "g0"), (34, [1.0, None, 0.0, 0.0], "g0")]
    df = spark.createDataFrame(rows, "key string, embedding array<float>, grp string").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, vector array<float>, grp string")
    found = v._top(v.nearest(df, asked, 5, "key", ["grp"], ask_bytes=ask_bytes, ask_rows=3), 5, "key")
    same(ranked(found, "key"), brute(rows, queries, 5))
    every = v._top(v.nearest(df, asked, 5, "key", ask_bytes=ask_bytes), 5, "key")
    same(ranked(every, "key"), brute([(k, e, 0) for k, e, _ in rows], [(q, e, 0) for q, e, _ in queries], 5))
    assert v.nearest(df.limit(0), asked, 5, "key").count() == 0 and v.nearest(df, asked.limit(0), 5, "key").count() == 0


def test_index(spark, tmp_path):
    x = clustered(2, 4000, 40)
    rng = np.random.default_rng(3)
    # one group holds most rows, one very few; one vector is there many times
    groups = rng.choice(["big", "mid", "few"], len(x), p=[0.7, 0.29, 0.01])
    rows = [(i, e.tolist(), g) for i, (e, g) in enumerate(zip(x, groups))] + [(5000 + i, x[0].tolist(), "big") for i in range(700)]
    rows += [(6000, None, "big"), (6001, [1.0], "big"), (6002, [0.0] * 16, "mid"), (6003, [1.0, None] * 8, "mid")]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, collection string").repartition(4)
    index = v.build_index(df, str(tmp_path / "index"), within=["collection"])
    index = v.open_index(spark, index.path)
    queries = [(f"{g}{i}", (x[rng.integers(0, len(x))] + 0.1 * rng.standard_normal(16)).tolist(), g) for g in ("big", "mid", "few") for i in range(30)] + [("none", x[0].tolist(), "other"), ("zero", [0.0] * 16, "mid"), ("null", None, "mid"), ("short", [1.0], "mid")]
    asked = spark.createDataFrame(queries, "query_id string, vector array<double>, collection string")
    want = brute([r for r in rows if r[0] != 6001], queries, 10)
    want.pop("short", None)
    same(ranked(v.search_index(index, asked, 10, exact=True), "chunk_id"), want)
    got = ranked(v.search_index(index, asked, 10), "chunk_id")
    read = {r.query_id: r.rows for r in v.scanned(index, asked).collect()}
    size = {g: sum(h == g for _, _, h in rows) for g in ("big", "mid", "few")}
    for g in ("big", "mid", "few"):
        mine = [q for q, _, h in queries if h == g and q != "zero" and q in want]
        recall = np.mean([len({k for k, _ in got[q]} & {k for k, _ in want[q]}) / len(want[q]) for q in mine])
        assert recall >= 0.95 and all(len(got[q]) == 10 for q in mine), g
        assert np.mean([read[q] for q in mine]) <= (0.35 if g != "few" else 1.0) * size[g], g
    wider = v.scanned(index, asked.where("collection = 'mid'"), cells=4).agg({"rows": "sum"}).first()[0]
    assert wider < v.scanned(index, asked.where("collection = 'mid'"), cells=20).agg({"rows": "sum"}).first()[0]
    # the most rows of one tile stay bounded though one cell holds all copies
    assert max(len(r.ids) for r in index.table("tiles").select("ids").collect()) <= 2048
    assert v.drop_index(index)


def test_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "a")], "chunk_id long, embedding array<float>, collection string")
    index = v.build_index(df, str(tmp_path / "none"), within=["collection"])
    asked = spark.createDataFrame([(1, [1.0, 0.0], "a")], "query_id int, vector array<double>, collection string")
    assert v.search_index(index, asked, 3, exact=True).count() == 0


def test_index_without_groups(spark, tmp_path):
    x = clustered(4, 900, 9, d=8)
    df = spark.createDataFrame([(i, e.tolist()) for i, e in enumerate(x)], "chunk_id long, embedding array<float>")
    index = v.build_index(df, str(tmp_path / "all"))
    queries = [(i, x[i].tolist(), 0) for i in range(25)]
    asked = spark.createDataFrame([q[:2] for q in queries], "query_id int, vector array<float>")
    same(ranked(v.search_index(index, asked, 7, exact=True), "chunk_id"), brute([(i, e.tolist(), 0) for i, e in enumerate(x)], queries, 7))
