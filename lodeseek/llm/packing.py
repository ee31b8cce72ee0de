"""Best-fit packing of token sequences by the sum-of-squares rule.

An open sequence's gap is the room it has left. Each piece goes where the sum
over all gaps of the squared number of open sequences with that gap becomes
smallest. That keeps the gaps varied, so that later pieces find one that they
fill. Pieces come in descending length, and a new sequence is opened where none
has room.

Pieces are dealt to partitions by a hash of their identity and packed there
independently; a partition of ``PER_PARTITION`` pieces loses a sequence or two
against packing all in one place. Sequences that are no more than half full go
through a second round as units, across partitions, so that the number of
partitions costs next to nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import CachedEncoder, Workspace

PER_PARTITION = 100_000
_BIN_BITS = 33


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]) of each row's tokens and the end id.

    Only a document of more than ``capacity`` tokens is cut, into pieces of
    ``capacity``; the last may be shorter. Null text is empty: one piece that
    holds the end id. ``ids`` are little-endian unsigned 32-bit integers. Repeated
    rows have pieces each, a null doc_id stays null, an empty table has no piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, step, end = CachedEncoder(tokenizer), 4 * capacity, end_id.to_bytes(4, "little")
        for batch in batches:
            rows, out = [], []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        out.append(part)
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays, names = [*arrays, pa.array(out, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, placed in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)  # of open bins by gap; those without a gap are closed
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - s changes the sum by 2 * (count[g-s] - count[g]) + 2, and by 1 less if it
        # is then full. A new bin is opened only where none has room: in descending order that takes fewer in all.
        here = counts[s:capacity]
        gaps, best = np.flatnonzero(here), capacity
        if len(gaps):
            change_of = 2 * (counts[gaps] - here[gaps]) + 2
            if gaps[0] == 0:
                change_of[0] -= 1
            best = int(gaps[np.argmin(change_of)]) + s
        if best == capacity:
            at, made = made, made + 1
        else:
            at = open_bins[best].pop()
            counts[best] -= 1
        bins[i], offsets[i] = at, capacity - best
        if best > s:
            open_bins[best - s].append(at)
            counts[best - s] += 1
    return bins, offsets


def _packed(items: DataFrame, capacity: int, parts: int, length: str, order: list[str], taken: int) -> DataFrame:
    """``items`` with (bin, place): packed within each of ``parts`` partitions; ``taken`` tells rounds' bins apart."""
    schema = T.StructType([*items.schema, T.StructField("bin", T.LongType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in batches if x.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            bins, places = sum_of_squares(table.column(length).to_numpy(), capacity)
            first = (taken << 60) + (TaskContext.get().partitionId() << _BIN_BITS)
            yield from table.append_column("bin", pa.array(bins + first)).append_column("place", pa.array(places)).to_batches(max_chunksize=50_000)

    dealt = items.repartition(parts, F.xxhash64(*order)).sortWithinPartitions(F.desc(length), *order)
    return dealt.mapInArrow(run, schema)


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any other columns, whatever their names) with (sequence_id, offset).

    Every row is placed, repeated rows too; places in a sequence are gapless
    from 0. A length of null, below 1 or above ``capacity`` is an error. Columns
    that are called sequence_id or offset give way to the result's.
    """
    work, own = Workspace(pieces.sparkSession), ["doc_id", "piece", "length"]
    names = {c: c if c in own else f"__other{k}" for k, c in enumerate(pieces.columns) if c not in ("sequence_id", "offset")}
    given, pieces = pieces, pieces.select(*(pieces[c].alias(x) for c, x in names.items()))
    n = given.count()
    parts = max(1, -(-n // PER_PARTITION))
    first = work.keep(_packed(pieces, capacity, parts, "length", ["doc_id", "piece"], 0), "first")
    fills = first.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") * 2 <= capacity)
    second = _packed(fills.withColumnRenamed("bin", "unit"), capacity, max(1, -(-parts // 64)), "fill", ["unit"], 1)
    second = work.keep(second.select("unit", "bin", "place"), "second")
    placed = first.join(second.select(F.col("unit").alias("__unit"), F.col("bin").alias("__bin"), F.col("place").alias("__place")), F.col("bin") == F.col("__unit"), "left")
    return placed.select(*(F.col(x).alias(c) for c, x in names.items()), F.coalesce("__bin", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("__place", F.lit(0))).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` with their sequence and offset; see ``token_pieces`` and ``pack``.

    An empty table gives an empty result; a null doc_id stays null; repeated
    rows are packed once each; other columns of ``docs`` are not read.
    """
    work = Workspace(docs.sparkSession)
    return pack(work.keep(token_pieces(docs, tokenizer, capacity, end_id, with_ids), "pieces"), capacity)
