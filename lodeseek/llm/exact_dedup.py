"""Exact dedup by composable polynomial fingerprints.

A text's bytes, white space normalised, are the coefficients of a polynomial
that is evaluated at two fixed points modulo a Mersenne prime. Fingerprints
compose: that of ``a + b`` is ``f(a) * x**len(b) + f(b)``, so the chunks of a
huge text, one of ``HUGE`` bytes or more, are dealt to tasks and hashed in
parallel, and combined by length-shifted arithmetic; a smaller text's are hashed
where it is. Either way gives the same fingerprint.

Rows with equal fingerprints are then compared chunk by chunk: every chunk
position of such a group is reduced to its least and greatest content, which
are the same if and only if all members agree there. The reduction combines
before the shuffle, so a group of any size, a third of all rows included, is a
few rows a task, and no task ever holds more of a text than its own chunks.
Groups that disagree (colliding fingerprints) are split by a SHA-256 digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace, utf8

#: Modulus and evaluation points of the fingerprints.
PRIME = (1 << 31) - 1
POINTS = (1_134_903_170, 1_836_311_903)
CHUNK = 1 << 16
#: Bytes from which a text's chunks are hashed in parallel.
HUGE = 16 << 20

_SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b" " * 5)


def normalise(text: bytes) -> bytes:
    """``text`` with each run of [\\x20\\x09-\\x0D] replaced by one space."""
    text = text.translate(_SPACES)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


class Fingerprint:
    """Polynomial fingerprints; a value is (length, f at each point).

    ``prime`` can be set small in tests, so that fingerprints collide.
    """

    def __init__(self, prime: int = PRIME, chunk: int = CHUNK):
        self.prime, self.chunk = prime, chunk
        powers = []
        for x in POINTS:
            p = [1]
            for _ in range(chunk - 1):
                p.append(p[-1] * x % prime)
            powers.append(p[::-1])
        self.powers = np.array(powers, np.uint64)

    def of_chunk(self, data: np.ndarray) -> tuple[int, ...]:
        """Of at most ``chunk`` bytes: each term is below 2**40, so a chunk's sum fits 64 bits."""
        n = len(data)
        coefficients = data.astype(np.uint64) + np.uint64(1)
        return (n, *(int(np.dot(coefficients, p[self.chunk - n :]) % np.uint64(self.prime)) for p in self.powers))

    def combine(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """Of two texts end to end."""
        return (a[0] + b[0], *((f * pow(x, b[0], self.prime) + g) % self.prime for x, f, g in zip(POINTS, a[1:], b[1:], strict=True)))

    def of(self, data: bytes) -> tuple[int, ...]:
        values = np.frombuffer(data, np.uint8)
        out: tuple[int, ...] = (0, 0, 0)
        for i in range(0, len(values), self.chunk):
            part = self.of_chunk(values[i : i + self.chunk])
            out = self.combine(out, part) if i else part
        return out


def fingerprints(docs: DataFrame, work: Workspace, prime: int = PRIME) -> DataFrame:
    """(doc_id, n_bytes, f0, f1, text_sha256) of every row's normalised text (columns doc_id and text); null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprint(prime)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            rows = []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                text = normalise(data[a:b].tobytes())
                rows.append((*make.of(text), hashlib.sha256(text).hexdigest()))
            n, f0, f1, sha = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "f0", "f1", "text_sha256"])

    huge = F.coalesce(F.octet_length("text") >= HUGE, F.lit(False))
    small = docs.where(~huge).mapInArrow(run, _PRINTS)
    # Written with a number a row, which the chunks of equal rows are told apart by.
    whole = work.keep(docs.where(huge).select("doc_id", normalised_column(F.col("text")).alias("text"), F.monotonically_increasing_id().alias("row")), "huge")
    return small if whole.isEmpty() else small.unionByName(_in_parallel(whole, prime))


_PRINTS = "doc_id long, n_bytes long, f0 long, f1 long, text_sha256 string"


def _in_parallel(whole: DataFrame, prime: int) -> DataFrame:
    """``fingerprints`` of normalised texts (row, doc_id, text), by chunks that are dealt to all tasks."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for row, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                for first in range(a, b, 64 * CHUNK):
                    parts = [data[i : min(i + CHUNK, b)].tobytes() for i in range(first, min(first + 64 * CHUNK, b), CHUNK)]
                    at = (first - a) // CHUNK
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(at, at + len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["row", "at", "content"])

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprint(prime)
        for batch in batches:
            parts = [make.of(x.as_py()) for x in batch.column(2)]
            n, f0, f1 = zip(*parts, strict=True) if parts else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, f0, f1))], names=["row", "at", "n", "f0", "f1"])

    def combine(key: tuple, table: pa.Table) -> pa.Table:
        make, out = Fingerprint(prime), (0, 0, 0)
        parts = table.sort_by("at").select(["n", "f0", "f1"]).to_pylist()
        for p in parts:
            out = make.combine(out, tuple(p.values()))
        return pa.table({"row": [key[0].as_py()], "n_bytes": [out[0]], "f0": [out[1]], "f1": [out[2]]})

    pieces = whole.select("row", "text").mapInArrow(split, "row long, at int, content binary")
    hashed = pieces.repartition("row", "at").mapInArrow(chunk, "row long, at int, n long, f0 long, f1 long")
    prints = hashed.groupBy("row").applyInArrow(combine, "row long, n_bytes long, f0 long, f1 long")
    own = whole.select("row", "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
    return own.join(prints, "row").select("doc_id", "n_bytes", "f0", "f1", "text_sha256")


def normalised_column(text):
    """The normalised text as a column expression; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prime: int = PRIME, work: Workspace | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``keep_id`` is the smallest doc_id among rows with an equal normalised text,
    ``group_size`` their number. Null text equals empty text. A null doc_id is
    larger than any other and is kept only where all ids of a group are null.
    Rows that repeat a doc_id stay separate rows: of several rows with the kept
    id and the same text, each is marked kept; ``drop_duplicates`` leaves one.
    An empty table gives an empty result. Other columns of ``docs``, whatever
    their names, are not read.
    """
    work = work or Workspace(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = work.keep(fingerprints(source, work, prime), "prints")
    work.drop("huge")
    key = ["n_bytes", "f0", "f1"]
    groups = prints.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"))
    # Written on its own, so that Spark can split a hot group's side of the join.
    shared = work.keep(groups.where("rows > 1").drop("rows"), "shared")
    members = work.keep(prints.join(shared, key).select("doc_id", *key).distinct(), "members")
    # Chunks are cut by characters, at the same places in equal texts.
    chunks = (
        source.join(members.hint("shuffle_hash"), source.doc_id.eqNullSafe(members.doc_id))
        .select(*key, normalised_column(F.col("text")).alias("text"))
        .select(*key, "text", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / CHUNK))).alias("chunk"))
        .select(*key, "chunk", F.substr("text", F.col("chunk") * CHUNK + 1, F.lit(CHUNK)).alias("content"))
    )
    differ = chunks.groupBy(*key, "chunk").agg(F.min("content").alias("least"), F.max("content").alias("greatest")).where("least <> greatest").select(*key).distinct().withColumn("differs", F.lit(True))
    differ = work.keep(differ, "differ")
    exact = prints.join(differ, key, "left").withColumn("part", F.when(F.col("differs"), F.col("text_sha256")).otherwise(F.lit("")))
    exact = exact.select("doc_id", *key, "part", "text_sha256")
    kept = exact.groupBy(*key, "part").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    kept = work.keep(kept, "kept")
    return exact.join(kept, [*key, "part"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; of repeated rows (same id, same text) one stays:
    that with the least text as it is, then with the least hash of its columns.

    Null text equals empty text; a null doc_id stays only where no row of its
    text has one; an empty table gives an empty result.
    """
    work, sha = Workspace(docs.sparkSession), next(f"sha_{k}" for k in range(len(docs.columns) + 1) if f"sha_{k}" not in docs.columns)
    verdict = exact_dedup(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), work=work).where("kept")
    verdict = verdict.groupBy(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_text")).agg((F.count(F.lit(1)) > 1).alias("again"))
    verdict = work.keep(verdict, "verdict")
    work.drop("prints", "shared", "members", "differ", "kept")
    marked = docs.withColumn(sha, F.sha2(normalised_column(F.col(text_col)).cast("binary"), 256))

    def among(rows: DataFrame) -> DataFrame:
        return marked.join(rows.hint("shuffle_hash"), marked[id_col].cast("long").eqNullSafe(rows.of_id) & (marked[sha] == rows.of_text), "left_semi")

    once = among(verdict.where("not again"))
    again = verdict.where("again")
    if not again.isEmpty():
        hashed = F.xxhash64(*(docs[c] for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind))
        first = F.min_by(F.struct(*(marked[c] for c in docs.columns), marked[sha]), F.struct(marked[text_col].cast("string"), hashed))
        once = once.unionByName(among(again).groupBy(id_col, sha).agg(first.alias("row")).select("row.*"))
    return once.drop(sha)
