"""Commits of document tables: one of two writers wins, readers never see a mix, debris is no harm."""

import threading

import pytest

from lodestone.sources.versions import Conflict, Store, Version


def document(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source_file string, build_hash string")


def pieces(spark, ids, tag, n=3):
    return spark.createDataFrame([(i, f"{i}:{k}", tag) for i in ids for k in range(n)], "doc_id long, chunk_id string, tag string")


def state(store, version=None):
    t = store.read(version)
    docs = {r.doc_id: (r.source_file, r.build_hash, r.version) for r in t["documents"].collect()}
    tags = {}
    for r in t["chunks"].collect():
        tags.setdefault(r.doc_id, set()).add(r.tag)
    return docs, tags


def test_replace(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), buckets=8)
    assert s.read() == {} and s.latest() == Version()
    ids = list(range(20))
    assert s.replace_documents(document(spark, [(i, f"f{i}", "a") for i in ids]), {"chunks": pieces(spark, ids, "a")})[0] == "written"
    first = s.latest()
    assert s.replace_documents(document(spark, [(3, "f3", "a")]), {"chunks": pieces(spark, [3], "a")}) == ("unchanged", first)
    # by id, by file under another id, and a new one
    new = document(spark, [(3, "f3", "b"), (100, "f5", "b"), (200, "f200", "b")])
    assert s.replace_documents(new, {"chunks": pieces(spark, [3, 100, 200], "b")})[0] == "written"
    docs, tags = state(s)
    assert docs[3] == ("f3", "b", 2) and docs[100] == ("f5", "b", 2) and docs[200] == ("f200", "b", 1) and 5 not in docs and len(docs) == 21
    assert set(tags) == set(docs) and tags[3] == {"b"} and tags[4] == {"a"}
    assert state(s, first)[0] == {i: (f"f{i}", "a", 1) for i in ids}  # old versions stay readable
    kept = set(first.tables["chunks"]["files"].values()) & set(s.latest().tables["chunks"]["files"].values())
    assert kept  # buckets that were not touched are the same files
    s.remove(spark.createDataFrame([(3,), (999,)], "doc_id long"))
    docs, tags = state(s)
    assert 3 not in docs and 3 not in tags and len(docs) == 20


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "s")
    a, b = Store(spark, path, 4), Store(spark, path, 4)
    a.replace_documents(document(spark, [(1, "f", "0")]), {"chunks": pieces(spark, [1], "0")})
    base = a.latest()
    a.commit(base, {"documents": document(spark, [(1, "f", "a")]).selectExpr("*", "2 AS version")})
    with pytest.raises(Conflict):
        b.commit(base, {"documents": document(spark, [(1, "f", "b")]).selectExpr("*", "2 AS version")})
    assert state(b)[0][1][1] == "a"
    seen, done, errors = [], threading.Event(), []

    def reader():
        while not done.is_set():
            docs, tags = state(Store(spark, path))
            seen.append({(docs[i][1], *sorted(tags.get(i, ()))) for i in docs})

    def writer(tag):
        try:
            Store(spark, path).replace_documents(document(spark, [(i, f"f{i}", tag) for i in (10, 11)]), {"chunks": pieces(spark, [10, 11], tag)}, tries=20)
        except Exception as e:
            errors.append(e)

    watch = threading.Thread(target=reader)
    watch.start()
    race = [threading.Thread(target=writer, args=(t,)) for t in "xyz"]
    for t in race:
        t.start()
    for t in race:
        t.join()
    done.set()
    watch.join()
    assert not errors
    docs, tags = state(Store(spark, path))
    assert docs[10][2] == docs[11][2] == 3 and tags[10] == tags[11] == {docs[10][1]}
    for s in seen:  # of the raced documents all rows are one writer's
        raced = {x for x in s if x[0] in "xyz"}
        assert len(raced) <= 1 and all(len(x) == 2 and x[0] == x[1] for x in raced)


def test_half_written(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), 4)
    s.replace_documents(document(spark, [(1, "f", "a")]), {"chunks": pieces(spark, [1], "a")})
    before = state(s)

    class Dies(Store):
        def _publish(self, v):
            raise OSError("lost")

    with pytest.raises(OSError):
        Dies(spark, s.path).replace_documents(document(spark, [(1, "f", "b")]), {"chunks": pieces(spark, [1], "b")})
    assert state(s) == before
    assert s.sweep() == 0  # a writer may still be at work on them
    assert s.sweep(older_than=-10.0) == 2 and state(s) == before
    for k in range(3):
        s.replace_documents(document(spark, [(1, "f", f"c{k}")]), {"chunks": pieces(spark, [1], f"c{k}")})
    assert s.sweep(keep=1, older_than=-10.0) > 0 and state(s)[0][1] == ("f", "c2", 4)


@pytest.mark.parametrize("size", [50, 700, 1 << 20])
def test_numbered_lines(spark, tmp_path, size):
    """Whatever the splits, every line has its number in its file; damaged lines are told apart, blank ones are counted."""
    from pyspark.sql import types as T

    from lodestone.sources.files import read_jsonl_numbered

    files = {f"f{k}": [("" if n % 11 == 5 else '{"a": ' if n % 5 == 2 else f'{{"a": {n}, "b": "é{"x" * (n % 90)}"}}') for n in range(1, 60 + 40 * k)] for k in range(3)}
    (tmp_path / "in").mkdir()
    for name, lines in files.items():
        (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name != "f1" else ""), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        good, bad = read_jsonl_numbered(spark, str(tmp_path / "in"), T.StructType.fromDDL("a int, b string"))
        got = sorted((r.file.rsplit("/", 1)[1][:2], r.line, r.a) for r in good.collect())
        lost = sorted((r.file.rsplit("/", 1)[1][:2], r.line) for r in bad.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == sorted((f, n, n) for f, lines in files.items() for n, x in enumerate(lines, 1) if x.endswith("}"))
    assert lost == sorted((f, n) for f, lines in files.items() for n, x in enumerate(lines, 1) if x and not x.endswith("}"))
