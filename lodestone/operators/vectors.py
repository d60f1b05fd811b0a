"""Nearest vectors: exactly, by matrix products of packed tiles, and through an index of cells.

Exact search packs vectors and queries into tiles (rows of ids and a matrix), joins each tile of vectors to the tiles of
queries that ask of its group and keeps the best n of every product. Queries never pass through the driver: they are counted,
and dealt to groups so small that one can be broadcast; each group is one more pass over the vectors.

The index is for collections that are searched again and again. Its cells are the nearest of a set of centres, fitted by
spherical k-means on a bounded sample (every vector is indexed); it consists of tables in one folder: `tiles` (the vectors,
packed, by group and cell), `directory` (of each group: its cells, their sizes and radii), `opening` (how many cells a search of
the group opens), `centres`, and `members` (which cell each vector is in). A group is what a filter selects, a collection say. A
query opens the cells of its group that are nearest to it, so a filter costs no recall: only cells that hold rows of the group
count. How many is calibrated for each group when the index is built, on sampled vectors whose true neighbours are found by exact
search. With exact=True a second round opens every further
cell that could hold a vector as near as the worst one found, by the angle between query and centre less the cell's radius.

Null vectors, null entries and vectors of another length take no part; a zero vector has similarity 0 with all.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import hadoop_path, ship, written

TILE_BYTES = 4 << 20


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _runs(table: pa.Table, by: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Parts of a table sorted by `by`: runs of rows that agree there; nulls agree with each other."""
    if not table.num_rows:
        return
    values = list(zip(*[table.column(c).to_pylist() for c in by])) if by else [()] * table.num_rows
    a = 0
    for b in range(1, len(values) + 1):
        if b == len(values) or values[b] != values[a]:
            yield values[a], table.slice(a, b - a)
            a = b


def _packer(by: list[str], key: str, vector: str, rows: int | None, ordered: bool):
    """Rows (by, d, key, vector) to tiles (by, d, ids, x): unit vectors as bytes, ids ascending. ordered: input is sorted by `by`, runs go on across batches."""

    def tiles(names: tuple, part: pa.Table) -> Iterator[pa.RecordBatch]:
        d = names[-1]
        step = min(rows or 1 << 30, max(1, TILE_BYTES // (8 * d)))
        part = part.take(pc.sort_indices(part, sort_keys=[(key, "ascending")]))
        for i in range(0, part.num_rows, step):
            cut = part.slice(i, step).combine_chunks()
            ids = cut.column(key).combine_chunks()
            x = unit(_matrix(cut.column(vector).combine_chunks(), d))
            lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            fixed = [pa.array([v], part.schema.field(c).type) for c, v in zip([*by, "d"], names)]
            yield pa.RecordBatch.from_arrays([*fixed, lists, pa.array([x.tobytes()], pa.binary())], [*by, "d", "ids", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        name = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if not ordered:
                t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in [*by, "d"]]))
            for names, part in _runs(t, [*by, "d"]):
                full = sum(p.num_rows for p in held) >= (rows or 1 << 14)
                if held and (names != name or not ordered or full):
                    yield from tiles(name, pa.concat_tables(held))
                    held = []
                held.append(part)
                name = names
        if held:
            yield from tiles(name, pa.concat_tables(held))

    return run


def packed(df: DataFrame, key: str, vector: str, by: list[str], rows: int | None = None, ordered: bool = False) -> DataFrame:
    """(by, d, ids, x): df's usable vectors as tiles of at most `rows` rows; see _packer()."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    usable = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull()))
    vec = usable.select(*by, F.size(vector).alias("d"), key, F.col(vector).cast("array<double>").alias(vector))
    schema = f"{kinds + ', ' if kinds else ''}d int, ids array<{df.schema[key].dataType.simpleString()}>, x binary"
    return vec.mapInArrow(_packer(by, key, vector, rows, ordered), schema)


def best_of(scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of scores (rows, queries): row and query of the n best rows a query, ties to the smaller row."""
    t = scores.shape[0]
    if t > n:
        cut = np.partition(scores, t - n, axis=0)[t - n]
        r, c = np.nonzero(scores >= cut)
    else:
        r, c = np.nonzero(np.ones_like(scores, bool))
    order = np.lexsort((r, -scores[r, c], c))
    r, c = r[order], c[order]
    start = np.searchsorted(c, np.arange(scores.shape[1]))
    keep = np.arange(len(c)) - start[c] < n
    return r[keep], c[keep]


def _multiplied(n: int, names: tuple[str, str], more: list[str], kinds: tuple[pa.DataType, pa.DataType]):
    """Joined tiles (d, ids, x, q_ids, q, more) to (query_id, key, score, more): the n best of each query in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d, x, q = (batch.column(c)[i].as_py() for c in ("d", "x", "q"))
                ids, q_ids = batch.column("ids")[i].values, batch.column("q_ids")[i].values
                x, q = np.frombuffer(x).reshape(-1, d), np.frombuffer(q).reshape(-1, d)
                every = np.round(x @ q.T, 9)
                r, c = best_of(every, n)
                same = [batch.column(m).slice(i, 1).take(pa.array(np.zeros(len(r), np.int64))) for m in more]
                yield pa.RecordBatch.from_arrays([q_ids.take(pa.array(c)).cast(kinds[0]), ids.take(pa.array(r)).cast(kinds[1]), pa.array(every[r, c]), *same], [*names, "score", *more])

    return run


def multiplied(tiles: DataFrame, asked: DataFrame, on: list[str], n: int, key: str, kind: str | None = None) -> DataFrame:
    """(query_id, key, score, kind): the n best of every tile (on, d, ids, x, kind) for each query of the tiles asked (on, d, q_ids, q) it meets."""
    both = tiles.join(asked, [*on, "d"])
    types = [tiles.schema["ids"].dataType.elementType, asked.schema["q_ids"].dataType.elementType]
    more = [kind] if kind else []
    schema = f"query_id {types[1].simpleString()}, `{key}` {types[0].simpleString()}, score double"
    schema += f", `{kind}` {tiles.schema[kind].dataType.simpleString()}" if kind else ""
    arrow = tuple(_arrow(t) for t in (types[1], types[0]))
    return both.select("d", "ids", "x", "q_ids", "q", *more).mapInArrow(_multiplied(n, ("query_id", key), more, arrow), schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def nearest(vectors: DataFrame, queries: DataFrame, n: int, key: str, within: list[str] | None = None, kind: str | None = None, ask_bytes: int = 64 << 20, ask_rows: int = 256) -> DataFrame:
    """(query_id, key, score, and kind): candidates for the n nearest vectors of each query, at least those, by cosine to 9 digits.

    vectors: (key, embedding, within, kind); queries: (query_id, vector, and the columns `within`, which a vector must share).
    The queries' bytes are counted; past ask_bytes they go in groups, each broadcast for a pass of its own.
    """
    within = within or []
    tiles = packed(vectors, key, "embedding", [*within, *([kind] if kind else [])])
    size = queries.select(F.sum(F.size("vector")).alias("n")).first()["n"] or 0
    groups = max(1, -(-8 * size // ask_bytes))
    out = None
    for g in range(groups):
        part = queries if groups == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        asked = packed(part, "query_id", "vector", within, ask_rows).withColumnsRenamed({"ids": "q_ids", "x": "q"})
        found = multiplied(tiles, F.broadcast(asked), within, n, key, kind)  # at most ask_bytes
        out = found if out is None else out.union(found)
    return out


# The index.


@dataclass
class VectorIndex:
    """The folder of an index and what it was built with."""

    spark: SparkSession
    path: str
    key: str
    within: list[str]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def centres(self) -> np.ndarray:
        rows = self.table("centres").orderBy("cell").collect()  # bounded when the index is built
        return np.array([r["centre"] for r in rows])


def _sample(vectors: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """Rows of about a share of all keys, the same ones whatever the partitions."""
    return vectors.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))


def _nearest_cells(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T).argmax(axis=1)


def _sums(d: int, centres: np.ndarray):
    def run(batches):
        total, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
        for batch in batches:
            x = unit(_matrix(batch.column(0), d))
            cell = _nearest_cells(x, centres)
            np.add.at(total, cell, x)
            count += np.bincount(cell, minlength=len(centres))
        at = np.flatnonzero(count)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cell", "total"])

    return run


def fit_centres(vectors: DataFrame, key: str, cells: int, d: int, rows: int, per_cell: int = 64, rounds: int = 5, seed: int = 3) -> np.ndarray:
    """Unit centres by spherical k-means on a sample of about cells * per_cell of the rows; vectors: (key, embedding), all of length d."""
    share = min(1.0, cells * per_cell / max(rows, 1))
    sample = _sample(vectors, key, share, seed).select(key, "embedding")
    starts = sample.orderBy(F.xxhash64(key, F.lit(seed + 1)), key).limit(cells).collect()  # as many as there are cells
    centres = unit(np.array([r["embedding"] for r in starts], np.float64).reshape(-1, d))
    for _ in range(rounds):
        sums = sample.select("embedding").mapInArrow(_sums(d, centres), "cell int, total array<double>")
        by_cell = sums.groupBy("cell").agg(F.collect_list("total").alias("t"))  # at most one vector a task
        added = F.aggregate(F.slice("t", 2, F.size("t")), F.element_at("t", 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
        new = by_cell.select("cell", added.alias("total")).collect()
        moved = centres.copy()
        for r in new:
            moved[r["cell"]] = r["total"]
        centres = unit(moved)
    return centres


def _assigned(d: int, centres: np.ndarray):
    """Rows (key, embedding, within) with their cell and the angle to its centre."""

    def run(batches):
        for batch in batches:
            x = unit(_matrix(batch.column(1), d))
            cell = _nearest_cells(x, centres)
            angle = np.arccos(np.clip(np.einsum("ij,ij->i", x, centres[cell]), -1.0, 1.0))
            zero = ~x.any(axis=1)  # similarity 0 with every query, as at a right angle to it
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(np.where(zero, np.pi, angle))], [*batch.schema.names, "cell", "angle"])

    return run


def build_index(vectors: DataFrame, path: str, key: str = "chunk_id", within: list[str] | None = None, cells: int | None = None, recall: float = 0.97, n: int = 10, centre_bytes: int = 64 << 20, asks: int = 64, seed: int = 3) -> VectorIndex:
    """Writes an index of vectors (key, embedding, within) to path. cells: the square root of the rows unless given, as far as all centres stay under centre_bytes.

    The length of vectors is the commonest one; others are not indexed. The cells to open are calibrated on `asks` vectors of
    each group, so that searches for n find `recall` of the true ones.
    """
    spark, within = ship(vectors.sparkSession), within or []
    usable = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull())).select(key, F.col("embedding").cast("array<double>").alias("embedding"), *within)
    common = usable.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d, rows = (common["d"], common["count"]) if common else (1, 0)
    usable = usable.where(F.size("embedding") == d)
    cells = max(1, min(cells or int(rows**0.5), centre_bytes // (8 * d)))
    centres = fit_centres(usable, key, cells, d, rows, seed=seed)
    if not len(centres):
        centres = np.zeros((1, d))
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    kinds = ", ".join(f"`{c}` {usable.schema[c].dataType.simpleString()}" for c in [key, "embedding", *within])
    placed = usable.mapInArrow(_assigned(d, centres), f"{kinds}, cell int, angle double")
    # by range of group, cell and key: a cell that holds very many rows is many ranges
    by = [*within, "cell"]
    ranged = placed.repartitionByRange(*by, key).sortWithinPartitions(*by)
    packed(ranged, key, "embedding", by, 2048, ordered=True).write.parquet(f"{path}/tiles")
    placed.select(key, *within, "cell", "angle").write.parquet(f"{path}/members")
    index = VectorIndex(spark, path, key, within)
    sizes = index.table("members").groupBy(*by).agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    # a group has at most as many entries as there are cells
    sizes.groupBy(*within).agg(F.array_sort(F.collect_list(F.struct("cell", "n", "radius"))).alias("cells")).where("size(cells) > 0").write.parquet(f"{path}/directory")
    calibrated(index, usable, asks, n, recall, seed).write.parquet(f"{path}/opening")
    spark.createDataFrame([(json.dumps({"key": key, "within": within}),)], "value string").coalesce(1).write.text(f"{path}/about")
    return index


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    about = json.loads(ship(spark).read.text(f"{path}/about").first()["value"])
    return VectorIndex(spark, path, about["key"], about["within"])


def calibrated(index: VectorIndex, vectors: DataFrame, asks: int, n: int, recall: float, seed: int) -> DataFrame:
    """(within, open): the fewest cells that hold `recall` of the n true neighbours of `asks` vectors of each group, themselves not counted."""
    key, within = index.key, index.within
    drawn = Window.partitionBy(*within).orderBy(F.xxhash64(key, F.lit(seed)), key)
    asked = vectors.withColumn("draw", F.row_number().over(drawn)).where(F.col("draw") <= asks)
    asked = written(asked.select(F.col(key).alias("query_id"), F.col("embedding").alias("vector"), *within))
    true = _top(nearest(vectors, asked, n + 1, key, within).where(F.col("query_id") != F.col(key)), n, key).select("query_id", key)
    ranked = _chosen(index, asked, lambda angles, entries, kth, cells: np.arange(len(entries)), cells=1).select("query_id", *within, "cell", "place")
    places = true.join(index.table("members").select(key, "cell"), key).join(ranked, ["query_id", "cell"]).groupBy(*within, "place").count()
    order = Window.partitionBy(*within).orderBy("place")
    share = F.sum("count").over(order) / F.sum("count").over(Window.partitionBy(*within))
    reached = places.withColumn("share", share).where(F.col("share") >= recall)
    return reached.groupBy(*within).agg((F.min("place") + 1).cast("int").alias("open")).where("open IS NOT NULL")


def _chosen(index: VectorIndex, queries: DataFrame, choose: Callable, kth: bool = False, cells: int | None = None) -> DataFrame:
    """(query_id, within, cell, place, n, vector): of each query (query_id, vector, within; kth) the cells of its group that choose() picks.

    choose(angles, entries, kth, cells): the angles to the group's cells in their order and the entries (n, radius), nearest first.
    """
    centres, within = index.centres(), index.within
    d = centres.shape[1]
    listed = index.table("directory")
    if cells is None:
        opening = index.table("opening")
        listed = listed.join(opening, within, "left") if within else listed.join(F.broadcast(opening), how="left")  # without groups one row each
        listed = listed.withColumn("open", F.coalesce("open", F.lit(1)))
    else:
        listed = listed.withColumn("open", F.lit(cells))
    asked = queries.where(F.size("vector") == d).select("query_id", F.col("vector").cast("array<double>").alias("vector"), *within, *(["kth"] if kth else []))
    with_cells = asked.join(listed, within) if within else asked.join(F.broadcast(listed.limit(1)))  # without groups the directory is one row

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q = unit(np.array(batch.column("vector")[i].as_py(), np.float64)[None, :])[0]
                entries = batch.column("cells")[i].values
                cell = entries.field("cell").to_numpy()
                size, radius = entries.field("n").to_numpy(), entries.field("radius").to_numpy()
                angle = np.arccos(np.clip(centres[cell] @ q, -1.0, 1.0))
                order = np.argsort(angle, kind="stable")
                worst = batch.column("kth")[i].as_py() if kth else None
                at = choose(angle[order], np.stack([size[order], radius[order]], axis=1), worst, batch.column("open")[i].as_py())
                if not len(at):
                    continue
                picked = order[at]
                same = [batch.column(c).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64))) for c in ["query_id", "vector", *within]]
                yield pa.RecordBatch.from_arrays([*same, pa.array(cell[picked], pa.int32()), pa.array(np.asarray(at, np.int32)), pa.array(size[picked], pa.int64())], ["query_id", "vector", *within, "cell", "place", "n"])

    kinds = ", ".join(f"`{c}` {asked.schema[c].dataType.simpleString()}" for c in ["query_id", "vector", *within])
    return with_cells.mapInArrow(run, f"{kinds}, cell int, place int, n long")


def _opened(index: VectorIndex, chosen: DataFrame, n: int, ask_rows: int = 256) -> DataFrame:
    """(query_id, key, score): the best of the chosen cells. Queries of a cell are dealt to 16 tasks before they are packed."""
    by = [*index.within, "cell"]
    dealt = chosen.withColumn("deal", F.pmod(F.xxhash64("query_id"), F.lit(16))).repartition(*by, "deal").sortWithinPartitions(*by)
    asked = packed(dealt, "query_id", "vector", by, ask_rows, ordered=True).withColumnsRenamed({"ids": "q_ids", "x": "q"})
    return multiplied(index.table("tiles"), asked.hint("shuffle_hash"), by, n, index.key)


def _top(found: DataFrame, n: int, key: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def first_cells(least: int) -> Callable:
    """As many of the nearest cells as are to be opened, and more while they hold fewer than `least` rows together."""

    def choose(angles, entries, kth, cells):
        enough = int(np.searchsorted(np.cumsum(entries[:, 0]), least)) + 1
        return np.arange(min(len(angles), max(cells, enough)))

    return choose


def further_cells(least: int) -> Callable:
    """The other cells that may hold a vector whose similarity is kth or more."""
    first = first_cells(least)

    def choose(angles, entries, kth, cells):
        at = np.arange(len(first(angles, entries, None, cells)), len(angles))
        near = np.maximum(0.0, angles[at] - entries[at, 1])
        # a radius of pi stands for zero vectors, whose similarity is 0
        bound = np.where(entries[at, 1] >= np.pi, 1.0, np.cos(near))
        return at[bound >= (-2.0 if kth is None else kth) - 2e-9]

    return choose


def search_index(index: VectorIndex, queries: DataFrame, n: int = 10, cells: int | None = None, exact: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the n nearest vectors of each query (query_id, vector, within) in its group; see the module.

    cells: how many to open in place of what was calibrated.
    """
    first = _opened(index, _chosen(index, queries, first_cells(n), cells=cells), n)
    top = _top(first, n, index.key)
    if not exact:
        return top
    top = written(top)
    worst = top.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("got")).select("query_id", F.when(F.col("got") >= n, F.col("kth")).alias("kth"))
    again = _chosen(index, queries.join(worst, "query_id", "left"), further_cells(n), kth=True, cells=cells)
    return _top(top.drop("rank").unionByName(_opened(index, again, n)), n, index.key)


def scanned(index: VectorIndex, queries: DataFrame, n: int = 10, cells: int | None = None) -> DataFrame:
    """(query_id, rows): how many vectors a search of the index compares with each query."""
    return _chosen(index, queries, first_cells(n), cells=cells).groupBy("query_id").agg(F.sum("n").alias("rows"))


def drop_index(index: VectorIndex) -> bool:
    path, fs = hadoop_path(index.spark, index.path)
    return fs.delete(path, True)
