"""Whitening of embeddings by a tiled covariance.

Pairs of dimensions are cut into square tiles. Rows are dealt into row blocks, of
each of which its column blocks are shuffled to one task; that task multiplies the
pairs of column blocks, one product a tile, and sums them over its row blocks;
then each tile is summed over all tasks. What reaches the driver are the sums of
the dimensions and the tiles, whatever the number of rows; there they are put
together, and the eigenvectors found.

Vectors are whole numbers: ``floor(64 * c) + 1000000`` of each entry, so sums and
deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lists

#: Dimensions of a tile's side; rows of a row block.
TILE, BLOCK_ROWS = 32, 4096
#: Components of a whitened vector.
COMPONENTS = 32
#: Steps of one and the place of zero in whole numbers.
SCALE, ZERO = 64, 1_000_000


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors were fitted, with ``sums`` of each dimension; components are the columns of ``axes``, by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    axes: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers less their mean, to double precision: differences are taken before division."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.float64) / self.n
        return (x - base) - rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum)^2, exactly."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], np.int64)
        near = x - base
        most = (int(np.abs(near).max(initial=0)) + 1) * self.n
        if most * most * max(1, x.shape[1]) < 1 << 63:
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        wide = near.astype(object) * self.n - rest.astype(object)
        return (wide * wide).sum(1).tolist()

    def whiten(self, x: np.ndarray, components: int) -> np.ndarray:
        k = min(components, len(self.values))
        return self.centred(x) @ (self.axes[:, :k] / np.sqrt(self.values[:k]))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows whose vector is not null and has only finite entries, as doubles.

    The dimension is the most frequent length, the greater one of equally
    frequent ones; rows of another length, and entries beyond 2^40, count as not
    finite. Empty vectors are left out.
    """
    vec = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    rows = rows.where(F.forall("vec", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float(1 << 40)), F.lit(False))))
    most = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("vec") == (most[0].d if most else 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def whole(c: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * c).astype(np.int64) + ZERO


def dimension_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """(n, sums) of whole-number vectors; a row a task and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dim, np.int64)
        for batch in batches:
            n, sums = n + batch.num_rows, sums + whole(_matrix(batch.column(0), dim)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dim)), pa.array([n, *sums.tolist()], pa.int64())], names=["dim", "total"])

    parts = rows.select("vec").mapInArrow(run, "dim long, total long")
    found = dict(parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toArrow().to_pandas().itertuples(index=False))
    return int(found[-1]), [int(found[j]) for j in range(dim)]


def _packed(part: np.ndarray) -> tuple[int, int, bytes]:
    """(low, width, data): whole numbers less the least one in as few bytes each as they take; doubles as they are, with width 0."""
    if part.dtype.kind == "f":
        return 0, 0, np.ascontiguousarray(part).tobytes()
    low = int(part.min())
    kind = np.min_scalar_type(int(part.max()) - low)
    return low, kind.itemsize, (part - low).astype(kind).tobytes()


def _unpacked(low: int, width: int, data: bytes, rows: int) -> np.ndarray:
    return (np.frombuffer(data).reshape(rows, -1) if not width else np.frombuffer(data, f"<u{width}").reshape(rows, -1).astype(np.int64) + low)


def _column_blocks(rows: DataFrame, dim: int, columns: Callable[[np.ndarray], np.ndarray], tile: int) -> DataFrame:
    """(row_block, column_block, n, low, width, data): the columns that ``columns`` makes of the rows' whole numbers, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                x = columns(whole(_matrix(batch.column(0).slice(at, BLOCK_ROWS), dim)))
                parts = [_packed(x[:, k : k + tile]) for k in range(0, x.shape[1], tile)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
                each = [(number, k, len(x), *part) for k, part in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*each, strict=True), kinds, strict=True)], names=["row_block", "column_block", "n", "low", "width", "data"])
                number += 1

    return rows.select("vec").mapInArrow(run, "row_block long, column_block int, n int, low long, width int, data binary")


def covariance(rows: DataFrame, dim: int, n: int, columns: Callable[[np.ndarray], np.ndarray], size: int, centre: Callable[[np.ndarray, int], np.ndarray], tile: int = TILE) -> np.ndarray:
    """The covariance, divisor ``n``, of the ``size`` columns that ``columns`` makes of rows (vec) of ``dim`` whole numbers.

    ``centre`` takes the mean off a column block, given the number of its first column.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        held, block = [], None

        def products() -> None:
            for i, a in enumerate(held):
                for j in range(i, len(held)):
                    one = a.T @ held[j]
                    tiles[i, j] = tiles[i, j] + one if (i, j) in tiles else one

        for batch in batches:
            for row_block, column_block, count, low, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_block != block:
                    products()
                    held, block = [], row_block
                held.append(centre(_unpacked(low, width, data, count), column_block * tile))
        products()
        for (i, j), one in tiles.items():
            yield _tile(i, j, one, TaskContext.get().partitionId())

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for i, j, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = np.frombuffer(data)
                if (i, j) != key:
                    if key:
                        yield _tile(*key, total)
                    key, total = (i, j), one
                else:
                    total = total + one
        if key:
            yield _tile(*key, total)

    blocks = _column_blocks(rows, dim, columns, tile).repartition("row_block").sortWithinPartitions("row_block", "column_block")
    tiles = blocks.mapInArrow(multiply, "i int, j int, data binary, task int").repartition("i", "j").sortWithinPartitions("i", "j", "task")
    out = np.zeros((size, size))
    for i, j, data, _ in tiles.select("i", "j", "data").mapInArrow(add, "i int, j int, data binary, task int").collect():  # size * size numbers in all
        a, b = slice(i * tile, min(size, (i + 1) * tile)), slice(j * tile, min(size, (j + 1) * tile))
        out[a, b] = np.frombuffer(data).reshape(a.stop - a.start, b.stop - b.start)
        out[b, a] = out[a, b].T
    return out / n


def _tile(i: int, j: int, total: np.ndarray, task: int = 0) -> pa.RecordBatch:
    arrays = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([task], pa.int32())]
    return pa.RecordBatch.from_arrays(arrays, names=["i", "j", "data", "task"])


def fit(rows: DataFrame) -> Whitening | None:
    """The whitening of all vectors (vec) that ``usable`` gives; None if there is none.

    Eigenvalues that are zero to double precision have no component: copies of
    one vector have none at all.
    """
    first = rows.select(F.size("vec").alias("d")).limit(1).collect()
    if not first:
        return None
    dim = first[0].d
    n, sums = dimension_sums(rows, dim)

    def centre(x: np.ndarray, at: int) -> np.ndarray:
        return Whitening(n, sums[at : at + x.shape[1]]).centred(x)

    v = covariance(rows, dim, n, lambda x: x, dim, centre)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    sound = values > max(float(values[0]), 0.0) * dim * np.finfo(float).eps
    return Whitening(n, sums, values[sound], axes[:, sound], float(np.trace(v)))


def identity_error(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them by tiles too.

    Whitened vectors have their mean taken off already.
    """
    k = min(components, len(model.values))
    if not k:
        return 0.0
    found = covariance(rows, len(model.sums), model.n, lambda x: model.whiten(x, k), k, lambda x, at: x)
    return float(np.abs(found - np.eye(k)).max())


def whiten(rows: DataFrame, model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, deviation, whitened) of each row: the exact sum over dimensions of (n * x - sum)^2, and its first components."""
    dim, k = len(model.sums), min(components, len(model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(_matrix(batch.column(1), dim))
            found = model.whiten(x, k)
            deviations = pa.array(map(Decimal, model.deviations(x)), pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), deviations, lists(found.reshape(-1), np.arange(1, len(x) + 1) * k, pa.float64())], names=["vec_id", "deviation", "whitened"])

    return rows.select("vec_id", "vec").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def components_of(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Null ids stay null, repeated rows have rows each, other columns are not read;
    an empty table, or one without a usable vector, gives an empty result, and so
    does one whose vectors are all equal.
    """
    rows = usable(vectors, id_col, vector_col)
    model = fit(rows)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model, components)
    shares = F.array(*(F.lit(float(v / model.trace)) for v in model.values[:components]))
    each = whiten(rows, model, components).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
