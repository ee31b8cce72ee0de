"""Table functions for SQL: ``chunk`` of a text, and ``nearest`` of a table of chunks.

    SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 1800) c

    SELECT path, max(score) AS score
    FROM nearest(TABLE(SELECT path, chunk_index, vec FROM chunks), array(0.1, ...), 10)
    GROUP BY path ORDER BY score DESC, path LIMIT 10

``nearest`` gives the best chunk of the k files that each task has nearest, among
which are those that are nearest of all; the query puts them in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udtf, udtf

from ..schema import CHUNK_LIMIT, CHUNK_OVERLAP, LEAST_LIMIT

_CHUNK = T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("chunk", T.StringType()), T.StructField("locator", T.StringType())])
_NEAREST = T.StructType([T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("chunk_index", T.IntegerType())])


class _Chunk:
    """The windows of a text as ``text.chunks`` has them; a null text has none, a null limit is the usual one."""

    def eval(self, text: str, limit: int) -> Iterator[tuple]:
        if text is None:
            return
        limit = max(LEAST_LIMIT, CHUNK_LIMIT if limit is None else limit)
        step, at, line = max(1, limit - CHUNK_OVERLAP), 0, 1
        many = len(text) > limit
        n = -(-(len(text) - limit) // step) + 1 if many else 1
        for i in range(n):
            yield i, at, text[at : at + limit], f"Line {line}" if many else ""
            line += text.count("\n", at, at + step)
            at += step


class _Nearest:
    """The best chunk of each of the k nearest files of a task, by the product with the query; null and other vectors have no score."""

    def __init__(self):
        self.best: dict[str, tuple[float, int]] = {}
        self.k = 0

    def eval(self, rows: pa.RecordBatch, query: pa.Array, k: pa.Array) -> Iterator[pa.Table]:
        if not rows.num_rows:
            return iter(())
        asked, self.k = np.array(query[0].as_py(), np.float64), max(int(k[0].as_py()), 0)
        paths, places, vectors = (rows.column(name) for name in ("path", "chunk_index", "vec"))
        own = np.flatnonzero(np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False)) == len(asked))
        found = vectors.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1) @ asked
        for at in np.flatnonzero(np.isfinite(found)).tolist():
            path, score, place = paths[int(own[at])].as_py(), float(found[at]), places[int(own[at])].as_py()
            had = self.best.get(path)
            if had is None or (score, -place) > (had[0], -had[1]):
                self.best[path] = (score, place)
        if len(self.best) > 64 * self.k + 10_000:
            self.best = dict(self._first())
        return iter(())

    def _first(self) -> list[tuple[str, tuple[float, int]]]:
        return sorted(self.best.items(), key=lambda x: (-x[1][0], x[0]))[: self.k]

    def terminate(self) -> Iterator[pa.Table]:
        first = self._first()
        yield pa.table({"path": pa.array([p for p, _ in first], pa.string()), "score": pa.array([s for _, (s, _) in first], pa.float64()), "chunk_index": pa.array([i for _, (_, i) in first], pa.int32())})


def register(spark: SparkSession) -> None:
    """Make ``chunk`` and ``nearest`` known to this session's SQL."""
    spark.udtf.register("chunk", udtf(_Chunk, returnType=_CHUNK))
    spark.udtf.register("nearest", arrow_udtf(_Nearest, returnType=_NEAREST))
