"""Search: exact best-passage-per-file top-k, batches of queries, coarse-to-fine, passages, similar files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packed as pk
from ..functions import text as tx
from ..functions import vectors as vx
from ..plans.search_spec import SearchSpec
from ..schema import TOP_PASSAGES, TOP_STORE
from ..sources.shared import shared_folder

#: Queries that are broadcast at once.
QUERY_BLOCK = 4096
#: Scores that a task holds at once.
_SCORES = 1 << 19
_HIT_TYPES = ["string", "double", "string", "string", "int", "double", "int", "int", "double", "string", "long"]
_HIT = ["path", "score", "snippet", "kind", "chunk_index", "modified", "width", "height", "duration", "locator", "chunk_count"]


def in_folder(path: Column, folder: str) -> Column:
    """``path`` is the folder or below it; ``/d`` does not hold ``/dz``."""
    folder = folder.rstrip("/")
    return (path == folder) | path.startswith(folder + "/")


def of_file(kinds: frozenset[str] = frozenset(), folder: str | None = None, ext: str = "") -> Column:
    """The predicates that hold for a whole file; they reach the scan."""
    out = F.lit(True)
    if kinds:
        out &= F.col("kind").isin(sorted(kinds))
    if folder and folder != "/":
        out &= in_folder(F.col("path"), folder)
    if ext:
        out &= F.lower("path").endswith("." + ext.lower())
    return out


def _first_of(query: np.ndarray, path: pa.Array, score: np.ndarray, index: np.ndarray, top_k: int) -> pa.RecordBatch:
    """Of rows of any order: the best of each query and path (ties: least index), and of these the ``top_k`` of each query (ties: smaller path)."""
    names = path.dictionary_encode()
    place = np.empty(len(names.dictionary), np.int64)
    place[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(place))
    file = place[names.indices.to_numpy(zero_copy_only=False)]
    order = np.lexsort((index, -score, file, query))
    keep = order[np.concatenate([[True], (np.diff(query[order]) != 0) | (np.diff(file[order]) != 0)])[: len(order)]]
    keep = keep[np.lexsort((file[keep], -score[keep], query[keep]))]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(query[keep]) != 0])[: len(keep)])
    rank = np.arange(len(keep)) - np.repeat(starts, np.diff(np.append(starts, len(keep))))
    keep = keep[rank < top_k]
    return pa.RecordBatch.from_arrays([pa.array(query[keep], pa.int32()), path.take(pa.array(keep)).cast(pa.string()), pa.array(score[keep]), pa.array(index[keep], pa.int32())], names=["query", "path", "score", "chunk_index"])


def nearest_files(chunks: DataFrame, queries: np.ndarray, top_k: int) -> DataFrame:
    """(query, path, score, chunk_index): the best chunk of the ``top_k`` files that each task has nearest to each query (a row of ``queries``).

    The files that are nearest of all are among them: a file that is before
    another in the task of the latter's best chunk is before it everywhere. So
    what is shuffled afterwards is ``top_k`` rows a task and query, and not a row
    a file. Vectors that are null, not finite or of another dimension have no score.
    ``vec`` may be binary as a packed store has it: it is multiplied straight from
    the Arrow buffer, and a blob that is too short counts as zeros.
    """
    packed = isinstance(chunks.schema["vec"].dataType, T.BinaryType)
    cast = chunks.sparkSession.sparkContext.broadcast(np.ascontiguousarray(queries.T, np.float64))
    dim, asked = queries.shape[1], max(1, len(queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        # Of each query, the score of the file that is the last of the ``top_k`` first so far: what is below it is never held.
        floor = np.full(cast.value.shape[1], -np.inf)

        def reduced() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            best = _first_of(*(c if n == "path" else c.to_numpy() for n, c in zip(whole.schema.names, whole.columns, strict=True)), top_k)
            query, score = best.column(0).to_numpy(), best.column(2).to_numpy()
            full = np.bincount(query, minlength=len(floor)) >= top_k
            least = np.full(len(floor), np.inf)
            np.minimum.at(least, query, score)
            floor[full] = least[full]
            return best

        for batch in batches:
            for at in range(0, batch.num_rows, step := max(1, _SCORES // asked)):
                part = batch.slice(at, step)
                vec = part.column(2)
                x = pk.matrix(vec, dim) if packed else vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                scores = x.astype(np.float64) @ cast.value
                scores[~np.isfinite(scores)] = -np.inf
                if len(scores) > 8 * top_k:  # one file may have several chunks: only what may be among the first is sorted
                    chunk_of = part.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                    order = np.argsort(chunk_of, kind="stable")
                    best = np.maximum.reduceat(scores[order], np.flatnonzero(np.diff(chunk_of[order], prepend=-1)), 0)
                    least = np.partition(best, max(0, len(best) - top_k), 0)[max(0, len(best) - top_k)]
                else:
                    least = np.full(scores.shape[1], -np.inf)
                row, query = np.nonzero((scores >= np.maximum(least, floor)) & (scores > -np.inf))
                if len(row):
                    held.append(_first_of(query, part.column(0).take(pa.array(row)), scores[row, query], part.column(1).to_numpy()[row], top_k))
                if len(held) > 1 and sum(x.num_rows for x in held) > 2 * top_k * asked or len(held) > 16:
                    held = [reduced()]
        if held:
            yield reduced()

    rows = chunks.where(F.col("vec").isNotNull() if packed else F.size("vec") == dim).select("path", F.col("chunk_index").cast("int").alias("chunk_index"), "vec")
    return rows.mapInArrow(run, "query int, path string, score double, chunk_index int")


def _best(found: DataFrame, *by: str) -> DataFrame:
    """The best of the tasks' rows of each path."""
    best = found.groupBy(*by, "path").agg(F.max(F.struct("score", (-F.col("chunk_index")).alias("order"))).alias("best"))
    return best.select(*by, "path", F.col("best.score").alias("score"), (-F.col("best.order")).alias("chunk_index"))


def search(chunks: DataFrame, query: list[float], top_k: int = TOP_STORE, kinds: frozenset[str] = frozenset(), folder: str | None = None, ext: str = "", since: float | None = None) -> DataFrame:
    """The ``top_k`` files whose best chunk is nearest to ``query``.

    The scan reads path, kind, chunk_index, modified and vec; the winners' other
    columns are fetched last. Kinds, folder and extension filter files; ``since``
    filters chunks, so a file's older chunks still count in ``chunk_count``.
    Ties go to the smaller path. No file for ``top_k`` of 0 or less.
    """
    if top_k <= 0 or not query:
        return chunks.limit(0).select(*(F.lit(None).cast(t).alias(c) if c in ("score", "chunk_count") else F.col(c) for c, t in zip(_HIT, _HIT_TYPES, strict=True) if c in {*chunks.columns, "score", "chunk_count"}))
    admitted = chunks.where(of_file(kinds, folder, ext))
    if since is not None:
        admitted = admitted.where(F.col("modified") >= since)
    found = _best(nearest_files(admitted, np.array([query]), top_k))
    top = found.orderBy(F.desc("score"), "path").limit(top_k).withColumnRenamed("chunk_index", "best")
    # A file a row, at most top_k: small whatever the index's size.
    rest = chunks.drop("vec", "size").join(F.broadcast(top), "path")
    rest = rest.withColumn("chunk_count", F.count(F.lit(1)).over(Window.partitionBy("path"))).where(F.col("chunk_index") == F.col("best"))
    return rest.select(*(c for c in _HIT if c in rest.columns))


def run(chunks: DataFrame, query: list[float], spec: SearchSpec, now: float) -> DataFrame:
    """``search`` of a specification. Threshold and order apply to the top files only, and do not widen them."""
    hits = search(chunks, query, spec.top_k, spec.kinds, spec.folder, spec.ext, spec.since(now))
    hits = hits.where(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) >= spec.min_score)
    orders = {"relevance": [F.desc("score"), "path"], "name": [F.lower(tx.basename(F.col("path"))), "path"], "date": [F.desc("modified"), "path"]}
    return hits.orderBy(*orders[spec.sort])


def search_batch(chunks: DataFrame, queries: DataFrame, top_k: int = TOP_STORE) -> DataFrame:
    """(query_id, rank, path, score, chunk_index, chunk_count) of every query (query_id, vec).

    Queries are taken ``QUERY_BLOCK`` at a time, and more of them take more passes
    over the chunks: that many vectors are the most that is sent to the tasks, or
    held by the driver, at once; the blocks' results are written in between.
    Chunks are counted for the files found only. No file for ``top_k`` of 0
    or less; a query without a vector finds none.
    """
    spark, top_k = chunks.sparkSession, max(top_k, 0)
    asked = queries.where("vec is not null").select("query_id", F.col("vec").cast("array<double>").alias("q"))
    blocks, out = max(1, -(-asked.count() // QUERY_BLOCK)), None
    named = chunks.select("path").groupBy("path").agg(F.count(F.lit(1)).alias("chunk_count"))
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if rows.num_rows:
            vectors = rows.column("q").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            ids = spark.createDataFrame(list(enumerate(rows.column("query_id").to_pylist())), T.StructType([T.StructField("query", T.IntegerType()), T.StructField("query_id", queries.schema["query_id"].dataType)]))
            found = _best(nearest_files(chunks, vectors, top_k), "query")
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
            part = found.withColumn("rank", rank).where(F.col("rank") <= top_k).join(F.broadcast(ids), "query").drop("query")  # a row a query of the block
            if blocks > 1:
                part.write.parquet(path := shared_folder(spark))
                part = spark.read.schema(part.schema).parquet(path)
            out = part if out is None else out.unionByName(part)
    if out is None:
        out = queries.limit(0).select("query_id", F.lit("").alias("path"), F.lit(0.0).alias("score"), F.lit(0).alias("chunk_index"), F.lit(0).alias("rank"))
    return out.join(named, "path").select("query_id", "path", "score", "chunk_index", "chunk_count", "rank")


def funnel(chunks: DataFrame, codes: DataFrame, query: list[float], top_k: int = TOP_STORE, candidates: int | None = None, admit: Column | None = None) -> DataFrame:
    """Coarse scores on 4-bit codes choose chunks, which are then scored exactly and reduced as in ``search``.

    ``codes`` has path, chunk_index and groups (see ``quantise4``) and the
    columns that ``admit`` needs; filters come before the candidates are cut.
    """
    top_k = max(top_k, 0)
    if candidates is None:
        candidates = min(4096, max(1024, 32 * top_k))
    coarse = codes.where(F.lit(True) if admit is None else admit).select("path", "chunk_index", vx.dot(vx.dequantise4(F.col("groups")), vx.literal(query)).alias("coarse"))
    chosen = coarse.orderBy(F.desc("coarse"), "path", "chunk_index").limit(candidates)
    exact = chunks.select("path", "chunk_index", "vec").join(F.broadcast(chosen), ["path", "chunk_index"]).select("path", "chunk_index", vx.dot(F.col("vec"), vx.literal(query)).alias("score"))
    return _best(exact.where(vx.finite(F.col("score")))).orderBy(F.desc("score"), "path").limit(top_k)


def coarse_candidates(codes: DataFrame, query: list[float], candidates: int, admit: Column | None = None) -> DataFrame:
    """(path, chunk_index, coarse) of the ``candidates`` chunks of a replica (scales, codes) with the highest coarse scores; vectors are not read."""
    asked, schema = np.asarray(query, np.float64), "path string, chunk_index int, coarse double"
    groups = -(-len(query) // pk.GROUP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pk.coarse_scores(pk.rows_of(batch.column(2), 2 * groups, "<f4"), pk.rows_of(batch.column(3), groups * pk.GROUP // 2, "u1"), asked)
            least = np.partition(scores, len(scores) - candidates)[len(scores) - candidates] if len(scores) > candidates else -np.inf
            own = pa.array(np.flatnonzero(scores >= least))  # ties with the last one too: the order below decides
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(scores).take(own)], names=["path", "chunk_index", "coarse"])

    rows = codes.where(F.lit(True) if admit is None else admit).select("path", "chunk_index", "scales", "codes")
    return rows.mapInArrow(run, schema).orderBy(F.desc("coarse"), "path", "chunk_index").limit(candidates)


def funnel_stored(store, query: list[float], top_k: int = TOP_STORE, candidates: int | None = None, admit: Column | None = None) -> DataFrame:
    """(path, score, chunk_index): ``funnel`` over a packed store's own replica.

    The replica of the base chooses candidates, of which the files that hold them
    are opened; chunks of the delta have no replica and are all scored exactly.
    ``admit`` may use path, modified, size, kind and chunk_index.
    """
    top_k = max(top_k, 0)
    if candidates is None:
        candidates = min(4096, max(1024, 32 * top_k))
    spark, admitted = store.spark, F.lit(True) if admit is None else admit
    chosen = spark.read.parquet(store.scratch(coarse_candidates(store.codes(), query, candidates, admit), "chosen"))
    near = store.rows_at(chosen.select("path")).join(F.broadcast(chosen.select("path", "chunk_index")), ["path", "chunk_index"], "left_semi")
    # What a delta has anew is not in the replica, so no chunk comes twice.
    rows = near.select("path", "chunk_index", "vec").unionByName(store.delta_chunks().where(admitted).select("path", "chunk_index", "vec"))
    return _best(nearest_files(rows, np.array([query]), top_k)).orderBy(F.desc("score"), "path").limit(top_k)


def rank_chunks(chunks: DataFrame, query: list[float], path: str, top_k: int = TOP_PASSAGES) -> DataFrame:
    """The best passages of one file."""
    scored = chunks.where(F.col("path") == path).withColumn("score", vx.dot(F.col("vec"), vx.literal(query))).where(vx.finite(F.col("score")))
    return scored.orderBy(F.desc("score"), "chunk_index").limit(max(top_k, 0)).select("chunk_index", "score", "snippet", "locator")


def file_vectors(chunks: DataFrame) -> DataFrame:
    """(path, vec): the mean of each file's vectors, scaled to length 1; files whose mean is 0 are left out.

    A task adds up the vectors of each batch's files from the Arrow buffer, and a
    row a file and batch is shuffled. Null vectors are left out; those of another
    length than the table's longest count as not there.
    """
    if not isinstance(chunks.schema["vec"].dataType, T.ArrayType):
        raise TypeError("vectors as stored: Store.chunks() has them as arrays")
    dim = chunks.agg(F.max(F.size("vec"))).first()[0]
    if not dim or dim < 1:
        return chunks.limit(0).select("path", F.col("vec").cast("array<double>").alias("vec"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch.column(0).dictionary_encode()
                file = names.indices.to_numpy(zero_copy_only=False)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                order = np.argsort(file, kind="stable")
                sums = np.add.reduceat(x[order], np.flatnonzero(np.diff(file[order], prepend=-1)), 0)
                yield pa.RecordBatch.from_arrays([names.dictionary, _vectors(sums), pa.array(np.bincount(file))], names=["path", "total", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, total, n = None, None, 0

        def mean() -> pa.RecordBatch | None:
            length = np.sqrt((total * total).sum()) if n else 0.0  # the mean and the sum have the same direction
            return pa.RecordBatch.from_arrays([pa.array([path]), _vectors((total / length)[None])], names=["path", "vec"]) if length > 0 else None

        for batch in batches:
            sums, out = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), []
            for own, one, m in zip(batch.column(0).to_pylist(), sums, batch.column(2).to_pylist(), strict=True):
                if own != path:
                    out.append(mean())
                    path, total, n = own, one, m
                else:
                    total, n = total + one, n + m
            out = [x for x in out if x is not None]
            if out:
                yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
        if (last := mean()) is not None:
            yield last

    sums = chunks.where(F.size("vec") == dim).select("path", "vec").mapInArrow(add, "path string, total array<double>, n long")
    return sums.repartition("path").sortWithinPartitions("path").mapInArrow(merge, "path string, vec array<double>")


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))


def find_similar(chunks: DataFrame, path: str, top_k: int = TOP_STORE) -> DataFrame:
    """Files near to a file's own vector, itself included; none if the file is not there."""
    own = file_vectors(chunks.where(F.col("path") == path)).first()
    return search(chunks, list(own.vec) if own else [], top_k) if own else search(chunks.limit(0), [], top_k)


def landmarks(files: DataFrame, count: int, cap: int) -> DataFrame:
    """``files`` (with idx from 0 in order of path) with is_landmark and place: ``count`` at an even stride, then the rest up to ``cap``."""
    total = files.count()
    count = min(count, cap, total)
    stride = total / count if count else 1.0
    # idx is a landmark if some j has int(j * stride) = idx: the least j with j * stride >= idx.
    j = F.ceil(F.col("idx") / stride)
    marked = files.withColumn("is_landmark", (F.floor(j * stride) == F.col("idx")) & (j < count))
    landmark_place = j
    before = F.least(F.ceil(F.col("idx") / stride), F.lit(count))
    place = F.when(F.col("is_landmark"), landmark_place).otherwise(count + F.col("idx") - before)
    return marked.withColumn("place", place.cast("long")).where(F.col("place") < cap)


def with_index(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with idx, their place from 0 in an order (by default, of path): ranges are counted, then numbered within; no task gets all rows.

    The ordered rows are written to the shared folder: the ranges that are counted
    must be those that are numbered, and ranges are found by sampling.
    """
    order = order or ("path",)
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    parts = parts.withColumn("own", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("long"), 33))
    parts.write.parquet(path := shared_folder(rows.sparkSession))
    own = rows.sparkSession.read.schema(parts.schema).parquet(path)
    sizes = own.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "start")
    return own.join(F.broadcast(starts), "part").withColumn("idx", F.col("own") + F.col("start")).drop("part", "own", "start")


def recall_at(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """(recall) of the top ``k`` (query_id, path, rank) of ``found`` against ``exact``, averaged over queries."""
    truth = exact.where(F.col("rank") <= k).select("query_id", "path")
    hits = found.where(F.col("rank") <= k).select("query_id", "path").withColumn("hit", F.lit(1))
    per = truth.join(hits, ["query_id", "path"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / k).alias("recall"))
    return per.agg(F.avg("recall").alias("recall"))


def mean_reciprocal_rank(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(top1, mrr) of the gold (query_id, path) in ``ranked`` (query_id, path, rank); absent counts 0."""
    own = gold.join(ranked.select("query_id", "path", "rank"), ["query_id", "path"], "left")
    return own.agg(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)).alias("top1"), F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))).alias("mrr"))
