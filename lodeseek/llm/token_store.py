"""Token ids as binary blocks: one id array, with Elias-Fano encoded document boundaries.

Documents are written in ascending order of doc_id. A block holds, one after
another,

* a header (magic ``LSB1``, bytes an id, documents, documents whose id is null,
  ids, least doc_id),
* the doc_ids less the least one, and the documents' ends in the id array, each
  as an Elias-Fano sequence,
* the ids of its documents, little-endian, in two bytes each if the vocabulary
  allows, else in four.

An Elias-Fano sequence of n values below u keeps the log2(u/n) low bits of each
value as they are and the rest in unary, 2 + log2(u/n) bits a value in all;
the place of every 256th one bit makes ``select`` a short search: ``fetch`` finds
a document's ids in a block by binary search over ``select`` and decodes nothing
else. Blocks are written and read by Spark as rows of a Parquet table (shard,
block, base, n_docs, n_tokens, first_doc, last_doc, payload), so any store that
Spark reaches holds them, and a lost task's blocks are written anew by the commit
protocol.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import CachedEncoder

MAGIC = b"LSB1"
HEADER = struct.Struct("<4sBIIQq")
BLOCK_DOCS, BLOCK_IDS = 4096, 1 << 21
#: Bytes of text that a task encodes, and how many tasks there are at most: beyond it, each encodes more, in more blocks.
SHARD_BYTES, MOST_SHARDS = 64 << 20, 20_000
SAMPLE = 256
_EF = struct.Struct("<QQBQ")


class EliasFano:
    """A non-decreasing sequence of unsigned integers."""

    def __init__(self, n: int, universe: int, width: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.universe, self.width, self.low, self.high = n, universe, width, low, np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, np.uint32)

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the values must not decrease")
        universe = int(values[-1]) + 1 if n else 0
        width = max(0, (universe // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(n, universe, width, np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype(np.uint32).tobytes())

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, bit = divmod(at, 8)
        word = int(self.high[byte]) >> bit << bit
        while (ones := word.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        high = byte * 8 + (word & -word).bit_length() - 1 - i
        first, last = i * self.width // 8, ((i + 1) * self.width + 7) // 8
        low = int.from_bytes(self.low[first:last], "little") >> i * self.width % 8 & (1 << self.width) - 1
        return high << self.width | low

    def values(self) -> np.ndarray:
        """All values: ``select`` of every index at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), count=self.n * self.width, bitorder="little").reshape(self.n, self.width)
        low = (bits.astype(np.uint64) << np.arange(self.width, dtype=np.uint64)).sum(1, dtype=np.uint64)
        return ((ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)) | low

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.universe, self.width, len(self.high)) + self.low + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence at byte ``at``, and where it ends."""
        n, universe, width, high = _EF.unpack_from(data, at)
        at += _EF.size
        parts = []
        for size in ((n * width + 7) // 8, high, 4 * -(-n // SAMPLE)):
            parts.append(bytes(data[at : at + size]))
            at += size
        return cls(n, universe, width, *parts), at


def write_block(doc_ids: list[int | None], texts_ids: list[bytes], id_bytes: int) -> bytes:
    """A block of documents, given their doc_ids (nulls first, then ascending) and ids (4 bytes each)."""
    known = np.array([x for x in doc_ids if x is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // 4 for x in texts_ids]) if texts_ids else np.zeros(0, np.int64)
    ids = np.frombuffer(b"".join(texts_ids), "<u4").astype(f"<u{id_bytes}")
    head = HEADER.pack(MAGIC, id_bytes, len(doc_ids), len(doc_ids) - len(known), len(ids), least)
    gaps = (known.view(np.uint64) - np.uint64(least & (1 << 64) - 1)) if len(known) else np.zeros(0, np.uint64)
    return head + EliasFano.encode(gaps).to_bytes() + EliasFano.encode(ends).to_bytes() + ids.tobytes()


class Block:
    """A block as it was written; nothing is decoded but what is asked for."""

    def __init__(self, payload: bytes):
        magic, id_bytes, self.n, self.nulls, n_ids, self.least = HEADER.unpack_from(payload)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        view = memoryview(payload)
        self.known, at = EliasFano.from_bytes(view, HEADER.size)
        self.ends, at = EliasFano.from_bytes(view, at)
        self.ids = np.frombuffer(payload, f"<u{id_bytes}", n_ids, at)

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.known.values() + np.uint64(self.least & (1 << 64) - 1)).view(np.int64).tolist()

    def span(self, place: int) -> tuple[int, int]:
        """Where the ids of a document start and end."""
        return self.ends.select(place - 1) if place else 0, self.ends.select(place)

    def places(self, doc_id: int) -> range:
        """The places of the documents with this id, by binary search."""
        value = doc_id - self.least
        first = bisect_left(range(self.known.n), value, key=self.known.select)
        return range(self.nulls + first, self.nulls + bisect_right(range(self.known.n), value, lo=first, key=self.known.select))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every row of ``docs`` (null text: the end id alone) as blocks at ``path``.

    Rows come in ascending order of doc_id, null ids first; rows with the same
    doc_id by their text, and such rows may be in several tasks. An empty table
    writes no block. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, shard = CachedEncoder(tokenizer), end_id.to_bytes(4, "little"), TaskContext.get().partitionId()
        id_bytes = 2 if max(encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        doc_ids, ids, size, block, base = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            named = [x for x in doc_ids if x is not None] or [None]
            row = ([shard], [block], [base], [len(doc_ids)], [size], [named[0]], [named[-1]], [write_block(doc_ids, ids, id_bytes)])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names=["shard", "block", "base", "n_docs", "n_tokens", "first_doc", "last_doc", "payload"])

        for batch in batches:
            for doc, found in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                if doc_ids and (len(doc_ids) >= BLOCK_DOCS or size + len(found) // 4 >= BLOCK_IDS):
                    yield flush()
                    doc_ids, ids, base, size, block = [], [], base + size, 0, block + 1
                doc_ids.append(doc)
                ids.append(found + end)
                size += len(found) // 4 + 1
        if doc_ids:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_SHARDS, -(-size // SHARD_BYTES)))
    # Ranges are found from the ids and the first characters of sampled rows.
    ordered = source.repartitionByRange(parts, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, "shard int, block int, base long, n_docs long, n_tokens long, first_doc long, last_doc long, payload binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document of the blocks at ``path``.

    ``start`` is the number of ids of all documents before it; the CRC is over
    the ids as little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.parquet(path)
    # A row a write task, of which there are ``MOST_SHARDS`` or as many as there are shuffle partitions.
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = Block(payload.as_py())
                to = block.ends.values().astype(np.int64)
                at = np.concatenate([[0], to[:-1]]).astype(np.int64)
                wide = memoryview(block.ids.astype("<u4").tobytes())
                parts = [wide[4 * a : 4 * b] for a, b in zip(at.tolist(), to.tolist(), strict=True)]
                arrays = [pa.array(block.doc_ids(), pa.int64()), pa.array(at + first), pa.array(to - at), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                if with_ids:
                    arrays.append(pa.array([x.tobytes() for x in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("shard_start")).alias("first"), "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def fetch(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents with these ids, a bounded list; ids that are not there give no row.

    Only blocks whose range of doc_ids holds one of them are read, and in these
    only the documents themselves.
    """
    wanted = sorted({int(x) for x in doc_ids if x is not None})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                block = Block(payload.as_py())
                rows = [(x, *block.span(place)) for x in wanted[bisect_left(wanted, first) : bisect_right(wanted, last)] for place in block.places(x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, *_ in rows], pa.int64()), pa.array([b - a for _, a, b in rows], pa.int64()), pa.array([block.ids[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary())], names=["doc_id", "n_tokens", "ids"])

    near = F.exists(F.lit(wanted).cast("array<long>"), lambda x: x.between(F.col("first_doc"), F.col("last_doc")))
    least, most = (wanted[0], wanted[-1]) if wanted else (1, 0)
    blocks = spark.read.parquet(path).where((F.col("first_doc") <= most) & (F.col("last_doc") >= least) & near)
    return blocks.select("first_doc", "last_doc", "payload").mapInArrow(run, "doc_id long, n_tokens long, ids binary")
