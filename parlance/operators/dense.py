"""Dense retrieval by blocks: exact top-k (#67) and an index of residual codes (#68).

Queries are a stated set.  They go to the tasks in chunks of bounded size; every task multiplies its Arrow
batches of vectors with the chunk, keeps the k best rows per query and hands on only those, which are merged
in two levels.  Pairs of query and vector never become rows.

Distances are squared L2.  The matrix product only picks rows that may be among the best; their distances are
then summed from the differences in double and rounded to 1e-9, so that equal vectors tie
(then the lower id wins).

The index (``fit``, ``build``, ``add``, ``search``): vectors are filed in the cell of their nearest centroid,
and what is left over is cut into ``parts`` pieces, each replaced by the number of its nearest codeword.  It lies in a
folder: the model, and rows of at most ``BLOCK`` codes of one cell.  Rows can be added under the same model.  A query
compares itself with the vectors that the codes of its ``nprobe`` nearest cells stand for, by blocks, and only
the ``rerank`` nearest by code are compared as whole vectors.  A search has as many tasks as its pairs of query and code
need.  The model is trained on a documented sample: the ``SAMPLE`` vectors with the least hashed ids.

Null vectors, and those of another length than the first query (or the model), are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.session import arrow_map, ensure_checkpoint_dir

#: Numbers of a chunk of queries (8 bytes each) and queries of a chunk, at most.
CHUNK_NUMBERS, CHUNK_QUERIES = 1 << 22, 1 << 14
#: Pairs whose distances a task holds at once.
PAIRS = 1 << 22
#: Codes that are compared with a part of the queries at once, and pairs of query and code of a task.
SLAB, TASK_PAIRS = 1 << 14, 1 << 28
#: The matrix product is off by less than this, relative to the squared lengths.
SLACK = 1e-9
#: Groups of tasks whose results are merged first.
FAN = 32
#: Vectors that train an index, its rounds of training, codewords per piece, and codes of a stored row.
SAMPLE, ROUNDS, WORDS, BLOCK = 65_536, 12, 256, 4096


def merge_top_k(rows: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The k first rows of each query, with their ``rank``: within groups of tasks, then over all."""
    group = F.pmod(F.spark_partition_id(), F.lit(FAN))
    near = rows.withColumn("_group", group).withColumn(
        "_at", F.row_number().over(Window.partitionBy("query_id", "_group").orderBy(*order))).where(F.col("_at") <= k)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return near.drop("_group", "_at").withColumn("rank", place).where(F.col("rank") <= k)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of length ``dim`` as rows, and their places."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    right = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), dim), False).to_numpy(zero_copy_only=False))
    flat = vectors.take(pa.array(right)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(right), dim), right


def _chunks(queries: DataFrame, columns: list[str]) -> Iterator[pa.Table]:
    """The stated queries, a bounded part at a time, as Arrow tables."""
    first = queries.select(F.size("query_vector").alias("n")).where("n > 0").first()
    if first is None:
        return
    count = queries.count()
    parts = -(-count * first["n"] // CHUNK_NUMBERS) if count <= CHUNK_QUERIES else max(
        -(-count // CHUNK_QUERIES), -(-count * first["n"] // CHUNK_NUMBERS))
    for part in range(parts):
        own = queries.where(F.size("query_vector") == first["n"]).select(*columns)
        table = (own.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part) if parts > 1 else own).toArrow()
        if table.num_rows:
            yield table


class _Nearest:
    """The k nearest rows of each query so far: query number, distance, id and the row's other fields."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor, self.rows = k, np.full(queries, np.inf), None
        self.number, self.distance, self.ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, number: np.ndarray, distance: np.ndarray, ids: np.ndarray, rows: pa.Table | None = None) -> None:
        number, distance = np.append(self.number, number), np.append(self.distance, distance)
        ids = np.append(self.ids, ids)
        order = np.lexsort((ids, distance, number))
        ascending = number[order]
        within = np.arange(len(order)) - np.searchsorted(ascending, ascending)
        keep = order[within < self.k]
        self.number, self.distance, self.ids = number[keep], distance[keep], ids[keep]
        if rows is not None:
            self.rows = (pa.concat_tables([self.rows, rows]) if self.rows is not None else rows).take(pa.array(keep))
        full = np.flatnonzero(np.bincount(self.number, minlength=len(self.floor)) == self.k)
        self.floor[full] = self.distance[np.searchsorted(self.number, full, side="right") - 1]


def _near(far: np.ndarray, floor: np.ndarray, k: int, slack: float | np.ndarray = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Places of a matrix (queries x rows) that may be among each query's k least."""
    if far.shape[1] > k:
        floor = np.minimum(floor, np.partition(far, k - 1, axis=1)[:, k - 1])
    return np.nonzero((far <= floor[:, None] + slack) & (far < np.inf))


def _scan(queries: pa.Table, dim: int, k: int, in_shop: bool, fields: list[str]):
    def run(batches) -> Iterator[pa.RecordBatch]:
        q, _ = _matrix(queries.column("query_vector"), dim)
        length = (q * q).sum(1)
        shops = queries.column("shop_id").to_pylist() if in_shop else None
        best = _Nearest(len(q), k)
        for batch in batches:
            vectors, place = _matrix(batch.column("dense_vector"), dim)
            ids = batch.column("id").to_numpy(zero_copy_only=False)[place]
            own_shops = np.array(batch.column("shop_id").to_pylist(), object)[place] if in_shop else None
            rows = pa.Table.from_batches([batch]).select(fields).take(pa.array(place))
            step = max(1, PAIRS // max(1, len(q)))
            for at in range(0, len(vectors), step):
                v = vectors[at:at + step]
                own = (v * v).sum(1)
                far = length[:, None] + own[None, :] - 2 * (q @ v.T)
                if in_shop:
                    of = np.array(own_shops[at:at + step])
                    far[np.array([s is None for s in shops])[:, None] | (np.array(shops, object)[:, None] != of[None, :])] = np.inf
                n, i = _near(far, best.floor, k, SLACK * (1 + length[:, None] + own[None, :]))
                if len(n):
                    exact = np.round(((q[n] - v[i]) ** 2).sum(1), 9)
                    best.add(n, exact, ids[at + i], rows.take(pa.array(at + i)))
        if best.rows is not None:
            out = pa.table({"query_id": queries.column("query_id").take(pa.array(best.number)), "id": pa.array(best.ids),
                            "distance": pa.array(best.distance), **{f: best.rows.column(f) for f in fields}})
            yield from out.combine_chunks().to_batches()
    return run


def dense_top_k(queries: DataFrame, vectors: DataFrame, k: int = 10, output_fields=("text_content", "shop_id", "metadata"),
                in_shop: bool = False) -> DataFrame:
    """#67: ``query_id, id, distance, rank`` and the output fields of the k nearest vectors of each query.

    ``queries``: distinct ``query_id``, ``query_vector`` (and ``shop_id``, if ``in_shop``: then only vectors of the
    query's shop are searched, and a null shop finds nothing).  Ids of vectors are integers."""
    fields = list(output_fields)
    needed = list(dict.fromkeys(["id", "dense_vector", *(["shop_id"] if in_shop else []), *fields]))
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType()),
                           *(T.StructField(f, vectors.schema[f].dataType) for f in fields)])
    found = None
    for chunk in _chunks(queries, ["query_id", "query_vector", *(["shop_id"] if in_shop else [])]):
        dim = len(chunk.column("query_vector")[0])
        rows = vectors.select(*needed).withColumn("id", F.col("id").cast("long"))
        near = arrow_map(rows, _scan(chunk, dim, k, in_shop, fields), schema)
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    return merge_top_k(found, k, ["distance", "id"])


# -- the index -----------------------------------------------------------------------------

@dataclass
class Model:
    """Centroids of the cells, and the codewords of each piece of what is left over."""

    centers: np.ndarray   # cells x dim
    words: np.ndarray     # parts x words x dim / parts

    def cells(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centers)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = (x - self.centers[cells]).reshape(len(x), len(self.words), -1)
        return np.stack([_nearest(rest[:, p], w) for p, w in enumerate(self.words)], 1).astype(np.uint8)

    def tables(self, queries: np.ndarray, cell: int) -> np.ndarray:
        """For each query and piece, the distance of every codeword."""
        rest = (queries - self.centers[cell]).reshape(len(queries), len(self.words), 1, -1)
        return ((rest - self.words[None]) ** 2).sum(-1)

    def row(self) -> tuple:
        return (list(self.centers.shape), self.centers.tobytes(), list(self.words.shape), self.words.tobytes())

    @classmethod
    def of_row(cls, r) -> "Model":
        return cls(np.frombuffer(r["centers"]).reshape(r["centers_shape"]), np.frombuffer(r["words"]).reshape(r["words_shape"]))


_MODEL = "centers_shape array<long>, centers binary, words_shape array<long>, words binary"


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    step, out = max(1, PAIRS // len(centers)), []
    for at in range(0, len(x), step):
        out.append(((centers ** 2).sum(1)[None] - 2 * x[at:at + step] @ centers.T).argmin(1))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _means(x: np.ndarray, count: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """Centers of ``count`` groups of the rows (Lloyd's rounds); an empty group takes a row at random."""
    centers = x[rng.choice(len(x), count, replace=len(x) < count)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers)
        held = np.bincount(own, minlength=count)
        order = np.argsort(own, kind="stable")
        filled = np.flatnonzero(held)
        sums = np.add.reduceat(x[order], np.append(0, np.cumsum(held)[:-1])[filled], axis=0)
        centers[filled] = sums / held[filled, None]
        centers[held == 0] = x[rng.choice(len(x), (held == 0).sum())]
    return centers


def fit(vectors: DataFrame, nlist: int | None = None, parts: int | None = None, seed: int = 7) -> Model:
    """A model for a frame ``id, dense_vector``: ``nlist`` cells (the square root of the row count by default, as
    the table grows) and ``parts`` pieces (four dimensions each by default)."""
    whole = vectors.where(F.size("dense_vector") > 0)
    taken = whole.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("dense_vector").toArrow()
    if not taken.num_rows:
        raise ValueError("an index needs vectors to learn from")
    dim = len(taken.column(0)[0])
    x, _ = _matrix(taken.column(0), dim)
    parts = parts or max(1, dim // 4)
    if dim % parts:
        raise ValueError(f"{parts} pieces don't divide {dim} dimensions")
    rng = np.random.default_rng(seed)
    centers = _means(x, min(nlist or max(1, round(whole.count() ** 0.5)), len(x)), rng)
    rest = (x - centers[_nearest(x, centers)]).reshape(len(x), parts, -1)
    return Model(centers, np.stack([_means(rest[:, p], min(WORDS, len(x)), rng) for p in range(parts)]))


def _encode(model: Model):
    dim = model.centers.shape[1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, place = _matrix(batch.column("dense_vector"), dim)
            if len(x):
                cells = model.cells(x)
                codes = model.codes(x, cells)
                yield pa.record_batch([batch.column("id").take(pa.array(place)), pa.array(cells, pa.int32()),
                                       pa.array([c.tobytes() for c in codes], pa.binary())], names=["id", "cell", "code"])
    return run


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """Rows ordered by cell as blocks of one cell each."""
    def block(cell: int, ids: list, codes: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([cell], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                                pa.array([b"".join(codes)], pa.binary())], names=["cell", "ids", "codes"])

    now, ids, codes = None, [], []
    for batch in batches:
        for i, cell, code in zip(*(c.to_pylist() for c in batch.columns)):
            if ids and (cell != now or len(ids) == BLOCK):
                yield block(now, ids, codes)
                ids, codes = [], []
            now = cell
            ids.append(i)
            codes.append(code)
    if ids:
        yield block(now, ids, codes)


def add(path: str, vectors: DataFrame) -> None:
    """File vectors under the model of the index in ``path``."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), "dense_vector")
    each = arrow_map(rows, _encode(load(vectors.sparkSession, path)), "id long, cell int, code binary")
    # a hot cell is spread over as many tasks as it has of the numbers
    dealt = each.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(16))).sortWithinPartitions("cell", "id")
    arrow_map(dealt, _blocks, "cell int, ids array<long>, codes binary").write.mode("append").parquet(f"{path}/blocks")


def build(vectors: DataFrame, model: Model, path: str | None = None) -> str:
    """A new index of all vectors; the folder it lies in (by default under ``spark.checkpoint.dir``)."""
    spark = vectors.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/vector-index-{uuid.uuid4().hex}"
    spark.createDataFrame([model.row()], _MODEL).coalesce(1).write.parquet(f"{path}/model")
    add(path, vectors)
    return path


def load(spark: SparkSession, path: str) -> Model:
    return Model.of_row(spark.read.schema(_MODEL).parquet(f"{path}/model").first())


def _whole(model: Model, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The vectors that codes stand for."""
    return model.centers[cells] + model.words[np.arange(len(model.words)), codes].reshape(len(codes), -1)


def _first(cells: np.ndarray, codes: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least ids of each code: others of the same distance can't be among the k nearest."""
    whole = np.concatenate([np.ascontiguousarray(cells, np.int64).view(np.uint8).reshape(len(cells), 8), codes], 1)
    equal = np.unique(np.ascontiguousarray(whole).view(np.dtype((np.void, whole.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, equal))
    ascending = equal[order]
    return order[np.arange(len(order)) - np.searchsorted(ascending, ascending) < k]


def _slabs(batches, parts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cells, ids and codes of stored blocks, about ``SLAB`` rows at a time."""
    cells, ids, codes, held = [], [], [], 0
    for batch in batches:
        for cell, own, code in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            ids.append(own.values.to_numpy())
            cells.append(np.full(len(ids[-1]), cell))
            codes.append(np.frombuffer(code, np.uint8).reshape(-1, parts))
            held += len(ids[-1])
            if held >= SLAB:
                yield np.concatenate(cells), np.concatenate(ids), np.concatenate(codes)
                cells, ids, codes, held = [], [], [], 0
    if held:
        yield np.concatenate(cells), np.concatenate(ids), np.concatenate(codes)


def _probe(model: Model, queries: pa.Table, nprobe: int, rerank: int):
    dim = model.centers.shape[1]

    def run(batches) -> Iterator[pa.RecordBatch]:
        q, _ = _matrix(queries.column("query_vector"), dim)
        length = (q * q).sum(1)
        step = max(1, PAIRS // SLAB)
        slices = [slice(at, at + step) for at in range(0, len(q), step)]
        best, probed = [], []
        for own in slices:
            far = (model.centers ** 2).sum(1)[None] - 2 * q[own] @ model.centers.T
            asked = np.zeros(far.shape, bool)
            np.put_along_axis(asked, np.argsort(far, axis=1, kind="stable")[:, :nprobe], True, axis=1)
            probed.append(asked)
            best.append(_Nearest(len(far), rerank))
        for cells, ids, codes in _slabs(batches, len(model.words)):
            keep = _first(cells, codes, ids, rerank)
            cells, ids = cells[keep], ids[keep]
            x = _whole(model, cells, codes[keep])
            own = (x * x).sum(1)
            for at, asked, near in zip(slices, probed, best):
                far = length[at, None] + own[None, :] - 2 * (q[at] @ x.T)
                far[~asked[:, cells]] = np.inf
                n, i = _near(far, near.floor, rerank, SLACK * (1 + length[at, None] + own.max()))
                if len(n):
                    # sums of differences, so that equal codes tie
                    exact = np.concatenate([((q[at][n[j:j + SLAB]] - x[i[j:j + SLAB]]) ** 2).sum(1)
                                            for j in range(0, len(n), SLAB)])
                    near.add(n, exact, ids[i])
        for at, near in zip(slices, best):
            if len(near.ids):
                yield pa.record_batch([pc.take(queries.column("query_id"), pa.array(at.start + near.number)).combine_chunks(),
                                       pa.array(near.ids), pa.array(near.distance)], names=["query_id", "id", "near"])
    return run


def candidates(path: str, queries: DataFrame, nprobe: int, rerank: int) -> DataFrame:
    """``query_id, id``: the ``rerank`` nearest vectors of each query by their codes."""
    spark = queries.sparkSession
    model, found = load(spark, path), None
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("near", T.DoubleType())])
    blocks = spark.read.schema("cell int, ids array<long>, codes binary").parquet(f"{path}/blocks")
    rows = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).first()["n"]
    for chunk in _chunks(queries, ["query_id", "query_vector"]):
        # pairs of query and code grow with the square of the table: so do the tasks, not the pairs of one
        dealt = blocks.repartition(-(-max(1, rows) * chunk.num_rows // TASK_PAIRS))
        near = arrow_map(dealt, _probe(model, chunk, nprobe, rerank), schema)
        found = near if found is None else found.unionByName(near)
    if found is None:
        found = spark.createDataFrame([], schema)
    return merge_top_k(found, rerank, ["near", "id"]).select("query_id", "id")


def search(path: str, queries: DataFrame, vectors: DataFrame, k: int = 10, nprobe: int = 10, rerank: int = 100,
           output_fields=("text_content", "shop_id", "metadata")) -> DataFrame:
    """#68: the k nearest of the ``rerank`` candidates of each query, by exact distance."""
    fields = list(output_fields)
    whole = vectors.select(F.col("id").cast("long").alias("id"), "dense_vector", *fields)
    pairs = (candidates(path, queries, nprobe, rerank).join(whole, "id")
             .join(queries.select("query_id", "query_vector"), "query_id"))
    apart = F.zip_with("query_vector", "dense_vector", lambda a, b: (a.cast("double") - b.cast("double")) * (
        a.cast("double") - b.cast("double")))
    near = pairs.withColumn("distance", F.round(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return (near.select("query_id", "id", "distance", *fields).withColumn("rank", place).where(F.col("rank") <= k))
