"""Nearest neighbours by vantage-point trees per shard (operator 12).

The rows are dealt into cells by a small vantage-point tree fitted on a bounded sample (``ROUTER_BYTES`` of vectors),
and a cell that outgrows ``SHARD_BYTES`` into several shards. Each shard builds its own vantage-point tree, down to
buckets of ``BUCKET`` rows; every row is in one bucket. A query first searches the shards of its own cell, then, with
the distance of its k-th neighbour as radius, all shards and buckets that the triangle inequality leaves: one whose
least possible distance, times ``factor``, exceeds the radius is passed over. Factor one is an exact search; a larger
one looks at less and may miss neighbours.

Queries are written once to the shared folder and read there block by block, so a task holds one shard and one block,
whatever the number of queries; only the neighbours found are shuffled.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows
without an id; only vectors of equal length are compared; of several rows with a query's id the least vector asks, and
none of them is its neighbour; elsewhere repeated rows count each for itself; ties go to the smaller id; with fewer
candidates than k all are found; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.store import open_folder, stored
from ebbtide.session import broadcast_if_small, scratch_path

SHARD_BYTES = 16 << 20  # of vectors as doubles
ROUTER_BYTES = 16 << 20
MAX_CELLS = 1 << 11
MIN_SHARD = 1 << 10  # rows below which more shards would not be worth their queries
BUCKET = 256
BLOCK_BYTES = 8 << 20  # queries that are searched at once
EXACT = 1.0


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances of the rows of ``a`` to those of ``b``, up to rounding (see ``_slack``)."""
    with np.errstate(over="ignore", invalid="ignore"):
        d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        if not np.isfinite(d2).all():  # out of range when squared: scaled down and up again
            scale = max(np.abs(a).max(), np.abs(b).max())
            return scale * _pairs(a / scale, b / scale) if scale > 1 else np.full(d2.shape, np.inf)
    return np.sqrt(np.maximum(d2, 0))


def _slack(*arrays: np.ndarray) -> float:
    """Bound of the rounding error of ``_pairs``: a product's error under the root, for vectors of this size."""
    return 1e-6 * max((np.abs(a).max() * np.sqrt(a.shape[1]) for a in arrays if len(a)), default=0.0)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance row by row, summed from the first component to the last in double precision."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.cumsum((a - b) ** 2, axis=1)[:, -1])


class Tree:
    """A vantage-point tree of given depth, level by level: node k has the near half 2k + 1 and the far half 2k + 2.

    ``order`` puts the rows so that every node is a run of them; ``inner`` and ``outer`` are the greatest distance
    from the vantage point in the near half and the least in the far half.
    """

    def __init__(self, vectors: np.ndarray, depth: int):
        n, self.depth = len(vectors), depth
        self.order = np.arange(n)
        self.points = np.zeros(((1 << depth) - 1, vectors.shape[1]))
        self.inner, self.outer = np.zeros(len(self.points)), np.zeros(len(self.points))
        bounds = [0, n]
        for level in range(depth):
            cut = [0]
            for j, (a, b) in enumerate(zip(bounds, bounds[1:])):
                k, rows, mid = (1 << level) - 1 + j, self.order[a:b], (a + b) // 2
                if b > a:
                    self.points[k] = point = self._vantage(vectors, rows)
                    d = exact(vectors[rows], point)
                    by = np.argsort(d, kind="stable")
                    self.order[a:b], d = rows[by], d[by]
                    self.inner[k], self.outer[k] = d[mid - a - 1] if mid > a else -np.inf, d[mid - a]
                else:
                    self.inner[k], self.outer[k] = -np.inf, np.inf
                cut += [mid, b]
            bounds = cut
        self.bounds = np.array(bounds)

    @staticmethod
    def _vantage(vectors: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of a few rows of the node, the one whose distances to others spread most."""
        few = vectors[rows[np.linspace(0, len(rows) - 1, min(len(rows), 8)).astype(int)]]
        some = vectors[rows[np.linspace(0, len(rows) - 1, min(len(rows), 64)).astype(int)]]
        return few[_pairs(few, some).std(axis=1).argmax()]


def bounds_of(points: np.ndarray, inner: np.ndarray, outer: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least possible distance of each query to each bucket, and the bucket on whose side the query lies throughout."""
    low, home = np.zeros((len(queries), 1)), np.zeros(len(queries), np.int64)
    if not len(points):
        return low, home
    d = _pairs(queries, points)
    for level in range(len(points).bit_length()):
        first = (1 << level) - 1
        s = slice(first, 2 * first + 1)
        near, far = d[:, s] - inner[s], outer[s] - d[:, s]
        low = np.repeat(low, 2, axis=1)
        low[:, 0::2] = np.maximum(low[:, 0::2], near)
        low[:, 1::2] = np.maximum(low[:, 1::2], far)
        own = first + home
        home = 2 * home + (d[np.arange(len(queries)), own] - inner[own] > outer[own] - d[np.arange(len(queries)), own])
    return low, home


class Shard:
    """A shard's rows in the order of its tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray, inner: np.ndarray, outer: np.ndarray, bounds: np.ndarray):
        self.ids, self.vectors, self.points, self.inner, self.outer, self.bounds = ids, vectors, points, inner, outer, bounds
        self.looked_at = 0  # pairs of query and row whose distance was worked out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, radius: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row id, distance) of each query's ``k`` nearest here, as far as they lie within its radius."""
        m, slack = len(queries), _slack(queries, self.vectors)
        low, home = bounds_of(self.points, self.inner, self.outer, queries)
        best_d, best_id = np.full((m, k), np.inf), np.full((m, k), np.iinfo(np.int64).max)
        radius = radius.copy()

        def look(bucket: int, rows: np.ndarray) -> None:
            a, b = self.bounds[bucket], self.bounds[bucket + 1]
            if a == b or not len(rows):
                return
            self.looked_at += len(rows) * int(b - a)
            other = self.ids[a:b] != query_ids[rows][:, None]
            d = np.where(other, _pairs(queries[rows], self.vectors[a:b]), np.inf)
            limit = radius[rows]
            if b - a > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            r, c = np.nonzero((d <= limit[:, None] + 2 * slack) & other)
            if not len(r):
                return
            near = exact(queries[rows[r]], self.vectors[a + c])
            count = np.bincount(r, minlength=len(rows))
            place = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
            new_d, new_id = np.full((len(rows), count.max()), np.inf), np.full((len(rows), count.max()), np.iinfo(np.int64).max)
            new_d[r, place], new_id[r, place] = near, self.ids[a + c]
            all_d, all_id = np.concatenate([best_d[rows], new_d], axis=1), np.concatenate([best_id[rows], new_id], axis=1)
            by = np.lexsort((all_id, all_d), axis=1)[:, :k]
            best_d[rows], best_id[rows] = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_id, by, 1)
            radius[rows] = np.minimum(radius[rows], best_d[rows, k - 1])

        for bucket in np.unique(home):
            look(bucket, np.flatnonzero(home == bucket))
        for bucket in range(low.shape[1]):
            left = (factor * np.maximum(low[:, bucket] - slack, 0) <= radius) & (home != bucket)
            look(bucket, np.flatnonzero(left))
        q, c = np.nonzero((best_id != np.iinfo(np.int64).max) & (best_d <= radius[:, None]))
        return query_ids[q], best_id[q, c], best_d[q, c]


@dataclass(frozen=True)
class Router:
    """The tree that deals vectors of the most frequent length into cells; others are all in cell 0 of their length."""

    dim: int
    points: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    def low(self, vectors: np.ndarray) -> np.ndarray:
        """Least possible distance to the rows of each cell."""
        if vectors.shape[1] != self.dim:
            return np.zeros((len(vectors), 1))
        return bounds_of(self.points, self.inner, self.outer, vectors)[0]

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector: by side of the same threshold that ``low`` bounds distances with."""
        cell = np.zeros(len(vectors), np.int64)
        if vectors.shape[1] == self.dim and len(self.points):
            for _ in range(len(self.points).bit_length()):
                node = (1 << _) - 1 + cell
                cell = 2 * cell + (exact(vectors, self.points[node]) > self.inner[node])
        return cell


def router(rows: DataFrame, shard_bytes: int = SHARD_BYTES) -> Router:
    """Fits the router on a sample of rows of the most frequent length; its cells follow the size of the data."""
    dims = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return Router(0, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    dim, n = dims[0]
    spark = rows.sparkSession
    wanted = max(n * dim * 8 / shard_bytes, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n / MIN_SHARD))
    depth = max(0, min(int(np.ceil(np.log2(max(wanted, 1)))), MAX_CELLS.bit_length() - 1))
    size = max(1 << depth, ROUTER_BYTES // (8 * dim))
    some = rows.where(F.size("vector") == dim).select("vector")
    sample = some.sample(min(1.0, 0.9 * size / n), seed=7).limit(size).toArrow() if size < n else some.toArrow()  # at most ROUTER_BYTES either way
    flat = sample.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float)
    vectors = flat.reshape(-1, dim)
    tree = Tree(vectors, depth if len(vectors) else 0)
    # one threshold for both sides: a row of the table may lie between the sample's halves
    return Router(dim, tree.points, tree.inner, tree.inner)


INDEX = "dim int, cell long, sub long, n long, ids binary, vectors binary, points binary, inner binary, outer binary, bounds binary"


@dataclass(frozen=True)
class Index:
    shards: DataFrame  # a row per shard (INDEX)
    rows: DataFrame  # vec_id, vector, dim, cell of every row that takes part
    router: Router


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def build(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, bucket: int = BUCKET) -> Index:
    """The index over every usable row: cells by the router, shards of at most about ``shard_bytes``, a tree in each."""
    usable_rows = table.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    rows = usable_rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    r = router(rows, shard_bytes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell = np.zeros(len(dims), np.int64)
            mine = np.flatnonzero(dims == r.dim)
            if len(mine):
                cell[mine] = r.cell(_matrix(batch.column("vector").take(pa.array(mine)), r.dim))
            yield batch.append_column("cell", pa.array(cell))

    with_dim = rows.withColumn("dim", F.size("vector"))
    dealt = stored(with_dim.mapInArrow(cells, "vec_id long, vector array<double>, dim int, cell long").withColumn("row", F.monotonically_increasing_id()), "vectors")
    counts = dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * 8 / shard_bytes).alias("subs"))
    # the number of a row, fixed once written, splits cells of any content, rows of one id too
    sharded = dealt.join(broadcast_if_small(counts), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("row"), F.col("subs")))

    def plant(t: pa.Table) -> pa.Table:
        dim, cell, sub = (t.column(c)[0].as_py() for c in ("dim", "cell", "sub"))
        t = t.take(pa.array(np.argsort(t.column("row").to_numpy(), kind="stable")))
        vectors = _matrix(t.column("vector"), dim)
        tree = Tree(vectors, max(0, int(np.ceil(np.log2(max(1, len(vectors) / bucket))))))
        held = {"ids": t.column("vec_id").to_numpy()[tree.order].astype("<i8"), "vectors": vectors[tree.order], "points": tree.points,
                "inner": tree.inner, "outer": tree.outer, "bounds": tree.bounds.astype("<i8")}
        return pa.table({"dim": pa.array([dim], pa.int32()), "cell": [cell], "sub": [sub], "n": [len(vectors)],
                         **{k: pa.array([v.tobytes()], pa.binary()) for k, v in held.items()}})

    shards = sharded.select("dim", "cell", "sub", "vec_id", "vector", "row").groupBy("dim", "cell", "sub").applyInArrow(plant, INDEX)
    return Index(stored(shards, "vector-shards"), dealt.drop("row"), r)


def _blocks(folder: str, dim: int, cell: int | None) -> Iterator[pa.RecordBatch]:
    """Blocks of the stored queries of a length (of one cell or of all)."""
    from pyarrow import fs
    from pyarrow import parquet as pq
    system, path = open_folder(folder)
    within = f"{path}/dim={dim}" if cell is None else f"{path}/dim={dim}/cell={cell}"
    for f in sorted(system.get_file_info(fs.FileSelector(within, allow_not_found=True, recursive=True)), key=lambda f: f.path):
        if f.is_file and f.path.endswith(".parquet"):
            with system.open_input_file(f.path) as file:
                yield from pq.ParquetFile(file).iter_batches(batch_size=max(64, BLOCK_BYTES // (8 * dim)))


def _searched(index: Index, folder: str, k: int, factor: float, own_cell: bool) -> DataFrame:
    """(query_id, vec_id, score) of the nearest rows in each shard to the stored queries: those of the shard's own cell,
    or all others within their radius."""
    r = index.router

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim, cell = row["dim"], row["cell"]
                array = {c: np.frombuffer(row[c], "<i8" if c in ("ids", "bounds") else "<f8") for c in ("ids", "vectors", "points", "inner", "outer", "bounds")}
                shard = Shard(array["ids"], array["vectors"].reshape(-1, dim), array["points"].reshape(-1, dim), array["inner"], array["outer"], array["bounds"])
                for block in _blocks(folder, dim, cell if own_cell else None):
                    ids, vectors = block.column("query_id").to_numpy(), _matrix(block.column("vector"), dim)
                    if own_cell:
                        radius = np.full(len(ids), np.inf)
                    else:
                        radius = block.column("radius").to_numpy()
                        low = r.low(vectors)[:, cell]
                        go = (factor * np.maximum(low - _slack(vectors, r.points if dim == r.dim else vectors), 0) <= radius) & (block.column("home").to_numpy() != cell)
                        ids, vectors, radius = ids[go], vectors[go], radius[go]
                    q, v, d = shard.search(ids, vectors, radius, k, factor) if len(ids) else ([], [], [])
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(d, pa.float64())})

    tasks = max(1, index.shards.count())  # a row per shard; each is a task
    spread = index.shards.repartition(tasks, "dim", "cell", "sub")
    return spread.mapInArrow(search, "query_id long, vec_id long, score double")


def nearest(index: Index, queries: DataFrame, k: int = 10, factor: float = EXACT) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of the index to every query (query_id, vector: array<double>),
    those of the query's own id left out."""
    spark, r = queries.sparkSession, index.router

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, home = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int64)
            mine = np.flatnonzero(dims == r.dim)
            if len(mine):
                home[mine] = r.cell(_matrix(batch.column("vector").take(pa.array(mine)), r.dim))
            yield batch.append_column("home", pa.array(home))

    asked = queries.where(F.col("query_id").isNotNull() & usable(F.col("vector"))).groupBy("query_id").agg(F.min("vector").alias("vector"))
    asked = stored(asked.withColumn("dim", F.size("vector")).mapInArrow(homes, "query_id long, vector array<double>, dim int, home long"), "queries")
    first, second = scratch_path(spark, "queries-home"), scratch_path(spark, "queries-radius")
    asked.withColumn("cell", F.col("home")).write.partitionBy("dim", "cell").parquet(first)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    at_home = stored(_searched(index, first, k, factor, True).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "nearest-home")
    radius = at_home.where(F.col("rank") == k).select("query_id", F.col("score").alias("radius"))
    wide = asked.join(radius, "query_id", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    wide.write.partitionBy("dim").parquet(second)
    found = at_home.drop("rank").unionByName(_searched(index, second, k, factor, False))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 100, k: int = 10, factor: float = EXACT) -> DataFrame:
    """Query form: the rows whose id is divisible by ``every`` against all rows."""
    queries = embeddings.where(F.col("vec_id") % every == 0)
    index = build(embeddings)
    return nearest(index, queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("vector")), k, factor)
