"""Words of whole texts, by blocks of documents that each number their own words.

A task reads its documents in blocks of about ``BLOCK_BYTES`` of text. A block has
a row for each document, with the numbers of its distinct features and how often
each occurs, and a row for each feature. So what is known of a word is looked up
once a block and not once a document: the most frequent word has a row a block.
Features are words and, if asked for, runs of up to ``longest`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, lists, text_batches

BLOCK_BYTES = 16 << 20
_SEGMENT = 1 << 22
_SCHEMA = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("flag", pa.bool_()), ("n_words", pa.int64()), ("features", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("place", pa.int32()), ("word", pa.string()), ("parts", pa.list_(pa.int32())), ("flagged", pa.int64()), ("others", pa.int64())])
_DDL = "block long, doc_id long, flag boolean, n_words long, features array<int>, times array<int>, place int, word string, parts array<int>, flagged long, others long"
_WHITE = re.compile(rb"[ \t-\r]")

#: Byte tables: A-Z in lower case; for LETTERS, of the other ASCII bytes only letters and digits stay and the rest are spaces.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
LETTERS = bytes(WORDS[b] if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class _Numbers(dict):
    """Keys get numbers in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = value = len(self)
        return value


def _segments(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some megabytes at a time."""
    at = 0
    while at < len(data):
        cut = _WHITE.search(data, at + _SEGMENT)
        end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


class _Block:
    def __init__(self, number: int, longest: int):
        self.number, self.longest, self.size = number, longest, 0
        self.words, self.runs, self.docs = _Numbers(), _Numbers(), []

    def add(self, doc: int | None, flag: bool, text: str | None, table: bytes) -> None:
        data = (text or "").encode().translate(table)
        parts = [np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)) for words in _segments(data)]
        own = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        n = len(own)
        if self.longest > 1:
            listed = own.tolist()
            runs = [np.fromiter((-1 - self.runs[x] for x in zip(*(listed[j:] for j in range(size)))), np.int64) for size in range(2, self.longest + 1)]  # below zero: a run of words
            own = np.concatenate([own, *runs])
        features, times = np.unique(own, return_counts=True)
        self.docs.append((doc, flag, n, features.astype(np.int32), times.astype(np.int32)))
        self.size += len(data) + 64

    def rows(self) -> Iterator[pa.RecordBatch]:
        n, sums = len(self.words), np.zeros((2, len(self.words) + len(self.runs)), np.int64)
        for at in range(0, len(self.docs), 5000):
            docs, ids, flags, sizes = [], [], [], []
            for doc, flag, size, features, times in self.docs[at : at + 5000]:
                features = np.where(features < 0, n - 1 - features, features)
                sums[int(flag)][features] += times
                docs.append((features, times))
                ids.append(doc)
                flags.append(flag)
                sizes.append(size)
            ends = np.cumsum([len(x) for x, _ in docs])
            yield self._batch(doc_id=ids, flag=flags, n_words=sizes, features=lists(np.concatenate([x for x, _ in docs]), ends, pa.int32()), times=lists(np.concatenate([x for _, x in docs]), ends, pa.int32()))
        words, runs = [x.decode() for x in self.words], list(self.runs)
        for at in range(0, len(words), 50_000):
            own = words[at : at + 50_000]
            end = at + len(own)
            yield self._batch(place=np.arange(at, end), word=own, flagged=sums[1][at:end], others=sums[0][at:end])
        for at in range(0, len(runs), 50_000):
            own = runs[at : at + 50_000]
            a, b = n + at, n + at + len(own)
            yield self._batch(place=np.arange(a, b), parts=[list(x) for x in own], flagged=sums[1][a:b], others=sums[0][a:b])

    def _batch(self, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        arrays = [pa.array(np.full(n, self.number)) if f.name == "block" else pa.nulls(n, f.type) if f.name not in columns else columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in _SCHEMA]
        return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def word_blocks(docs: DataFrame, flag: Column, table: bytes = WORDS, longest: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of documents and of features, to be written before they are used; ``documents`` and ``features`` take them apart.

    A document: block, doc_id, flag, n_words, features, times. A feature of a
    block: block, place, word or else parts (places of a run's words), and how
    often it occurs in flagged documents and in others. Null text has no word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        block = _Block(first, longest)
        for batch in batches:
            for doc, flagged, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block.add(doc, flagged, text.as_py(), table)
                if block.size >= BLOCK_BYTES:
                    yield from block.rows()
                    made += 1
                    block = _Block(first + made, longest)
        if block.docs:
            yield from block.rows()

    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(flag, F.lit(False)).alias("flag"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, _DDL)


def keep(work: Workspace, blocks: DataFrame) -> DataFrame:
    """``word_blocks`` written and read back, in fewer bytes than Spark takes by default: the table is as large as the texts."""
    path = work.path("blocks")
    blocks.write.option("compression", "zstd").parquet(path)
    return work.spark.read.schema(blocks.schema).parquet(path)


def documents(blocks: DataFrame) -> DataFrame:
    return blocks.where("place is null").select("block", "doc_id", "flag", "n_words", "features", "times")


def features(blocks: DataFrame) -> DataFrame:
    return blocks.where("place is not null").select("block", "place", "word", "parts", "flagged", "others")


def by_document(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, times) of all documents of a block, end to end."""
    column = table.column("features").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    counts = table.column("times").combine_chunks()
    counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(), counts.flatten().to_numpy()
