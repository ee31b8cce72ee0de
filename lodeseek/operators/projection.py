"""Embedding maps: principal components, nearest-neighbour graph, force layout of landmarks, placement of the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from . import search

#: Neighbours, epochs, negative samples and seed of the layout; points below which components are used alone.
NEIGHBOURS, EPOCHS, NEGATIVES, SEED, FEW = 15, 300, 5, 42, 50
#: The most landmarks that are laid out on the driver by default, and at all.
LANDMARKS, MOST_LANDMARKS = 5000, 60_000
#: Bytes of vectors that are sent to the tasks at once, and scores that a task holds at once.
BLOCK_BYTES, _SCORES = 64 << 20, 1 << 21
#: Dimensions up to which a covariance is summed as a whole; directions of a subspace iteration.
WIDEST, SUBSPACE = 512, 8


def landmark_budget(capacity_gb: float, dim: int, layout: bool = True) -> int:
    """Landmarks that an eighth or so of the memory holds, within bounds that grow with it: other ones for a layout than for components alone."""
    # Share of memory, copies of a vector, least dimension, and bounds.
    fit = int(capacity_gb * 0.12 * 2**30 / (max(256, dim) * 4 * 5))
    least, most, at_six = (5000, 60_000, 15_000) if layout else (20_000, 250_000, 60_000)
    return max(2000, min(fit, max(least, min(most, int(capacity_gb / 6 * at_six)))))


def point_cap(capacity_gb: float, dim: int, layout: bool = True) -> int:
    """Points that a map has in all, landmarks and placed ones: what the memory holds of their vectors, within a bound."""
    # Share of memory, copies of a vector, least dimension, and bound.
    return max(landmark_budget(capacity_gb, dim, layout), min(int(capacity_gb * 0.12 * 2**30 / (max(256, dim) * 4 * 2)), 250_000))


def moments(points: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance): each task sums its rows' outer products, so dim * dim numbers a task are sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, None, None
        for batch in batches:
            if batch.num_rows:
                x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)).astype(np.float64)
                first = x.sum(0) if first is None else first + x.sum(0)
                second = x.T @ x if second is None else second + x.T @ x
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first.tolist()]), pa.array([second.reshape(-1).tolist()])], names=["n", "first", "second"])

    n, first, second = 0, 0.0, 0.0
    for row in points.select("vec").mapInArrow(run, "n long, first array<double>, second array<double>").toLocalIterator():
        n, first = n + row.n, first + np.array(row.first)
        second = second + np.array(row.second).reshape(len(row.first), -1)
    if not n:
        return 0, np.zeros(0), np.zeros((0, 0))
    mean = first / n
    return n, mean, (second - n * np.outer(mean, mean)) / max(n - 1, 1)


def _signed(top: np.ndarray) -> np.ndarray:
    """Components as rows whose largest entry is positive."""
    return top * np.sign(top[np.arange(len(top)), np.abs(top).argmax(1)])[:, None]


def components(points: DataFrame, k: int = 2, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, components as rows, share of variance); a component's largest entry is positive.

    Up to ``widest`` dimensions the covariance is summed as a whole; wider vectors
    take ``subspace``, and the covariance only where that does not settle.
    """
    first = points.select(F.size("vec").alias("d")).limit(1).collect()
    if first and first[0].d > widest:
        found = subspace(points, k)
        if found is not None:
            return found
    n, mean, covariance = moments(points)
    if not n:
        return mean, np.zeros((k, 0)), 0.0
    values, vectors = np.linalg.eigh(covariance)
    return mean, _signed(vectors[:, ::-1][:, :k].T), float(values[::-1][:k].sum() / max(values.sum(), 1e-30))


def _summed(rows: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all tasks of what ``of`` makes of their vectors, an array of ``width`` columns: a row a task and array row is shuffled, one an array row comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                one = of(_rows(batch.column(0), batch.num_rows))
                total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)], names=["at", *(f"c{j}" for j in range(width))])

    parts = rows.select("vec").mapInArrow(run, "at int, " + ", ".join(f"c{j} double" for j in range(width)))
    found = parts.groupBy("at").agg(*(F.sum(f"c{j}").alias(f"c{j}") for j in range(width))).toArrow().sort_by("at")
    return np.stack([found.column(f"c{j}").to_numpy() for j in range(width)], 1)


def subspace(points: DataFrame, k: int = 2, block: int = SUBSPACE, passes: int = 40, tolerance: float = 2e-4, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, float] | None:
    """``components`` by subspace iteration, None where it does not settle in ``passes`` passes.

    A pass multiplies all centred vectors with a block of ``block`` directions, so
    a task sends dimensions x block numbers. Rayleigh-Ritz values and vectors come
    from the block, and the residual of the first ``k`` against their values tells
    when they are settled. At least 99.9 % of the exact components' variance is
    theirs.
    """
    whole = _summed(points, 2, lambda x: np.concatenate([np.stack([x.sum(0), (x * x).sum(0)], 1), [[len(x), 0.0]]]))
    n, dim = whole[-1, 0], len(whole) - 1
    mean = whole[:-1, 0] / n
    total = float((whole[:-1, 1] - n * mean * mean).sum()) / max(n - 1, 1)
    block = min(block, dim)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, block)))[0]
    for _ in range(passes):
        y = _summed(points, block, lambda x, q=q: (x - mean).T @ ((x - mean) @ q)) / max(n - 1, 1)
        values, turns = np.linalg.eigh(q.T @ y)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, image = q @ turns[:, :k], y @ turns[:, :k]
        residual = np.linalg.norm(image - ritz * values[:k], axis=0)
        if (residual <= tolerance * max(float(values[0]), 1e-30)).all():
            return mean, _signed(ritz.T), float(values[:k].sum() / max(total, 1e-30))
        q = np.linalg.qr(y)[0]
    return None


def project(points: DataFrame, mean: np.ndarray, top: np.ndarray) -> DataFrame:
    """(path, x, y): places along the first two components."""
    centred = F.zip_with(F.col("vec"), vx.literal(mean.tolist()), lambda a, b: a.cast("double") - b)
    return points.select("path", centred.alias("c")).select("path", *(vx.dot(F.col("c"), vx.literal(t.tolist())).alias(n) for n, t in zip("xy", top, strict=False)))


def _first_k(row: np.ndarray, to: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which of (row, to, score) are the first ``k`` of their row: highest scores, ties to the smaller id; in this order."""
    order = np.lexsort((to, -score, row))
    place = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[place < k]


class _Nearest:
    """The ``k`` nearest so far of some points, as more of the others come by."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.row, self.to, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, to: np.ndarray, matrix: np.ndarray) -> None:
        """``matrix`` has the others as rows."""
        for at in range(0, len(to), step := max(1, _SCORES // max(1, len(self.ids)))):
            ids, part = to[at : at + step], matrix[at : at + step]
            scores = self.x @ part.T
            scores[(self.ids[:, None] == ids[None, :]) | ~np.isfinite(scores)] = -np.inf
            n = min(self.k, len(ids))
            least = np.partition(scores, len(ids) - n, 1)[:, len(ids) - n]
            # What is before this block has its place already; only scores that may be among the first are sorted.
            known = np.full(len(self.ids), -np.inf)
            full = np.bincount(self.row, minlength=len(self.ids)) >= self.k
            if full.any():
                worst = np.full(len(self.ids), np.inf)
                np.minimum.at(worst, self.row, self.score)
                known[full] = worst[full]
            row, column = np.nonzero((scores >= np.maximum(least, known)[:, None]) & (scores > -np.inf))
            row, found, score = (np.concatenate(x) for x in ((self.row, row), (self.to, ids[column]), (self.score, scores[row, column])))
            keep = _first_k(row, found, score, self.k)
            self.row, self.to, self.score = row[keep], found[keep], score[keep]

    def batch(self) -> pa.RecordBatch:
        rank = np.arange(len(self.row)) - np.searchsorted(self.row, self.row) + 1
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.row]), pa.array(self.to), pa.array(rank, pa.int32()), pa.array(self.score)], names=["src", "dst", "rank", "score"])


_NEAR = "src long, dst long, rank int, score double"


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def neighbours(points: DataFrame, against: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(src, dst, rank, score): the ``k`` nearest of ``against`` (id, vec) to each point (id, vec), itself left out; ties go to the smaller id.

    If ``against`` fits in ``BLOCK_BYTES``, it is sent to the tasks. Else the points
    are dealt in groups of that size, and every group gets all of ``against`` in
    blocks, one after another, through the shuffle: a task holds a group and a
    block, and nothing goes through the driver. A group's result is final.
    """
    n, dim = against.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if 8 * n * (dim or 1) > BLOCK_BYTES:
        return _dealt_neighbours(points, against, k, dim)
    rows = against.select("id", F.col("vec").cast("array<double>").alias("vec")).toArrow()  # at most BLOCK_BYTES
    to = rows.column("id").to_numpy()
    matrix = rows.column("vec").combine_chunks().flatten().to_numpy().reshape(len(to), -1) if len(to) else np.zeros((0, dim or 1))
    cast = points.sparkSession.sparkContext.broadcast((to, np.ascontiguousarray(matrix)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, matrix = cast.value
        for batch in batches if len(to) else ():
            for at in range(0, batch.num_rows, step := max(1, _SCORES // len(to))):
                part = batch.slice(at, step)
                found = _Nearest(part.column(0).to_numpy(), _rows(part.column(1), part.num_rows), k)
                found.meet(to, matrix)
                yield found.batch()

    return points.select("id", "vec").mapInArrow(run, _NEAR)


def _dealt_neighbours(points: DataFrame, against: DataFrame, k: int, dim: int) -> DataFrame:
    groups = max(1, -(-8 * dim * points.count() // BLOCK_BYTES))
    rows = max(1, min(4096, BLOCK_BYTES // 256 // (8 * dim)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                matrix = _rows(part.column(1), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, near = None, [], None
        for batch in batches:
            for at, (own, side) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if own != group:
                    if near:
                        yield near.batch()
                    group, held, near = own, [], None
                if side == 0:
                    held.append((batch.column(2)[at].as_py(), batch.column(3)[at].values.to_numpy(zero_copy_only=False)))
                elif held:
                    near = near or _Nearest(np.array([i for i, _ in held], np.int64), np.stack([v for _, v in held]).astype(np.float64), k)
                    ids = np.frombuffer(batch.column(4)[at].as_buffer(), np.int64)
                    near.meet(ids, np.frombuffer(batch.column(5)[at].as_buffer()).reshape(len(ids), -1))
        if near:
            yield near.batch()

    null = lambda kind: F.lit(None).cast(kind)
    own = points.select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("side"), "id", F.col("vec").cast("array<double>").alias("vec"), null("binary").alias("ids"), null("binary").alias("matrix"))
    others = against.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(cut, "ids binary, matrix binary")
    others = others.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("side"), null("long").alias("id"), null("array<double>").alias("vec"), "ids", "matrix")
    return own.unionByName(others).repartition(groups, "group").sortWithinPartitions("group", "side").mapInArrow(run, _NEAR)


def force_layout(ids: list[int], start: np.ndarray, edges: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> np.ndarray:
    """Places of landmarks: neighbours attract, random others repel; ``edges`` are (row, row). Bounded by the landmark budget."""
    y = start * (5.0 / max(float(start.std()), 1e-12))
    draw = np.random.default_rng(seed)
    a, b = edges[:, 0], edges[:, 1]
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        d = y[a] - y[b]
        q = (d * d).sum(1, keepdims=True)
        pull = np.clip(-2 / (1 + q) * d, -4, 4)
        step = np.zeros_like(y)
        np.add.at(step, a, pull)
        np.add.at(step, b, -pull)
        for _ in range(NEGATIVES):
            other = draw.integers(0, len(ids), len(a))
            d = y[a] - y[other]
            q = (d * d).sum(1, keepdims=True)
            np.add.at(step, a, np.clip(2 / ((0.001 + q) * (1 + q)) * d, -4, 4))
        y = y + rate * step / max(1, NEGATIVES)
    return y


def layout(points: DataFrame, k: int = NEIGHBOURS, epochs: int = EPOCHS) -> DataFrame:
    """(path, x, y) of landmarks (id, path, vec): force layout; components alone for few points or where it diverges.

    More than ``MOST_LANDMARKS`` points are an error: ``embedding_map`` places the rest.
    """
    mean, top, _ = components(points)
    flat = project(points, mean, top)
    n = points.count()
    if n > MOST_LANDMARKS:
        raise ValueError(f"{n} points are more than a layout takes: use embedding_map")
    if n <= max(FEW, k, 2):
        return flat
    rows = points.select("id", "path").join(flat, "path").orderBy("id").collect()  # landmarks: bounded by their budget
    place = {r.id: i for i, r in enumerate(rows)}
    edges = np.array([(place[r.src], place[r.dst]) for r in neighbours(points, points, k).select("src", "dst").collect()])
    y = force_layout(list(place), np.array([(r.x, r.y) for r in rows]), edges, epochs)
    if not np.isfinite(y).all():
        return flat
    return points.sparkSession.createDataFrame([(r.path, float(a), float(b)) for r, (a, b) in zip(rows, y, strict=True)], "path string, x double, y double")


def place_rest(rest: DataFrame, marks: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(id, x, y): each point at the weighted mean of its ``k`` nearest landmarks (id, vec, x, y)."""
    near = neighbours(rest, marks, k).join(F.broadcast(marks.select(F.col("id").alias("dst"), "x", "y")), "dst")
    w = 1 / (2 - 2 * F.col("score") + 1e-4)
    return near.groupBy(F.col("src").alias("id")).agg((F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))


def embedding_map(points: DataFrame, budget: int = LANDMARKS, k: int = NEIGHBOURS, epochs: int = EPOCHS, cap: int | None = None) -> DataFrame:
    """(path, x, y) of every point (id, path, vec): ``layout`` of up to ``budget`` landmarks at an even stride, ``place_rest`` of the others.

    With ``cap``, the map has that many points at most, landmarks first.
    """
    n = points.count()
    if n <= budget and (cap is None or n <= cap):
        return layout(points, k, epochs)
    marked = search.landmarks(search.with_index(points.select("path")), budget, n if cap is None else max(cap, min(budget, n)))
    # Collected once, so that both sides see the same landmarks: bounded by the budget.
    picked = F.broadcast(points.sparkSession.createDataFrame([(r.path,) for r in marked.where("is_landmark").select("path").collect()], "path string"))
    marks, rest = points.join(picked, "path", "left_semi"), points.join(picked, "path", "left_anti")
    if cap is not None:
        rest = rest.join(marked.where("not is_landmark").select("path"), "path", "left_semi")
    laid = layout(marks, k, epochs)
    placed = place_rest(rest, marks.join(laid, "path"), k).join(rest.select("id", "path"), "id")
    return laid.unionByName(placed.select("path", "x", "y"))


def folder_map(chunks: DataFrame, folder: str, budget: int = LANDMARKS, k: int = NEIGHBOURS, epochs: int = EPOCHS, capacity_gb: float | None = None) -> DataFrame:
    """(path, kind, x, y) of every file at or below a folder, by the mean of its vectors; none for '' and '/'.

    With ``capacity_gb``, the landmarks' budget and the cap on all points follow from the memory that the map may take.
    """
    own = chunks.where(search.in_folder(F.col("path"), folder)) if folder.rstrip("/") else chunks.limit(0)
    files, cap = search.with_index(search.file_vectors(own)).withColumnRenamed("idx", "id"), None
    if capacity_gb is not None:
        dim = own.agg(F.max(F.size("vec"))).first()[0] or 0
        budget, cap = min(landmark_budget(capacity_gb, dim), MOST_LANDMARKS), point_cap(capacity_gb, dim)
    kinds = own.groupBy("path").agg(F.max("kind").alias("kind"))
    return embedding_map(files, budget, k, epochs, cap).join(kinds, "path").select("path", "kind", "x", "y")


def preservation(flat: DataFrame, graph: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(kept): share of each point's neighbours that are also its nearest in the plane (id, x, y)."""
    lifted = flat.select("id", F.array(F.lit(1.0), F.col("x"), F.col("y"), -(F.col("x") * F.col("x") + F.col("y") * F.col("y"))).alias("vec"))
    # Nearest by distance: the largest 2 * a.b - b.b among all b.
    asked = flat.select("id", F.array(F.lit(0.0), 2 * F.col("x"), 2 * F.col("y"), F.lit(1.0)).alias("vec"))
    plane = neighbours(asked, lifted, k).select("src", "dst")
    both = graph.where(F.col("rank") <= k).select("src", "dst").join(plane.withColumn("hit", F.lit(1)), ["src", "dst"], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("kept"))


def spotlight(graph: DataFrame, src: int, n: int = 10) -> DataFrame:
    """The point and its ``n`` nearest."""
    return graph.where((F.col("src") == src) & (F.col("rank") <= n)).select("dst", "rank")
