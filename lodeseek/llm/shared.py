"""What the operators of this subpackage share: written intermediate tables and work on Arrow text columns.

Intermediate tables go to the folder in ``spark.checkpoint.dir``, which every
executor can read, so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import gc
import json
import os
import re
import tempfile
import time
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of the class [\x20\x09-\x0D], which separates words.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: All ASCII bytes but letters and digits: words between them carry no punctuation.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_ROOT = np.uint64(0x9E3779B97F4A7C15)
_SEGMENT = 1 << 18


#: Rows of text in an Arrow batch: texts may be long, and a batch is held several times over.
BATCH_ROWS = 1000


def text_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of this session have at most ``BATCH_ROWS`` rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which must be set to one that all executors share.

    Only where driver and executors are one process (``local``) is there a
    folder of our own if it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lodeseek-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lodeseek-{uuid.uuid4().hex}"


class Workspace:
    """Named Parquet tables of one run of an operator."""

    released = 0.0

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.tables = spark, shared_dir(spark), {}
        text_batches(spark)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: its lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(name))
        self._release()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def keep_bucketed(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """Like ``keep``, bucketed by a column: joins on it do not shuffle this table."""
        table, parts = f"lodeseek_{uuid.uuid4().hex}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(parts, by).option("path", self.path(name)).saveAsTable(table)
        self.tables[name] = table
        self._release()
        return self.spark.table(table)

    def _release(self) -> None:
        """Shuffle files of finished steps go once the driver has collected what refers to them; steps that take no time are let be."""
        if time.monotonic() - Workspace.released < 3:
            return
        Workspace.released = time.monotonic()
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            if name in self.tables:
                self.spark.sql(f"DROP TABLE {self.tables.pop(name)}")
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: Rows with one key that a task joins.
HOT = 2000


def spread_join(rows: DataFrame, others: DataFrame, key: str, work: Workspace, name: str, hot: int = HOT) -> DataFrame:
    """Inner join of ``rows``, a written table, with ``others`` on a column; columns named ``__salt`` and ``__salts`` must not be there.

    The rows of a key that has more than ``hot`` of them are dealt by a salt,
    and its others are sent to each salt: a third of all rows may have one key.
    """
    counts = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / hot).cast("int").alias("__salts")).where("__salts > 1")
    counts = work.keep(counts, f"{name}_hot")
    if counts.isEmpty():
        return rows.join(others, key)
    salted = rows.join(counts, key).withColumn("__salt", F.pmod(F.xxhash64(*rows.columns), F.col("__salts")).cast("int")).drop("__salts")
    copies = others.join(counts, key).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    plain = rows.join(counts, key, "left_anti").join(others, key)
    return plain.unionByName(salted.join(copies, [key, "__salt"]).drop("__salt"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, end to end, and where each row starts (one more entry than rows); null is empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    # The buffers are read where they are: a batch may be large.
    _, ends, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(ends, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row that has more."""
    row = 0
    while row < len(offsets) - 1:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


class WordHasher:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of many texts at once, A-Z in lower case.

    A word's hash is the difference of two prefix sums of a polynomial, moved
    back to power zero, then mixed: the cost is a few array operations a byte,
    whatever the words' lengths. Texts are taken in segments cut at white
    space, so memory does not grow with the text.
    """

    def __init__(self, separators: np.ndarray = WHITE) -> None:
        self.separators = separators
        values = mix(np.arange(1, 257, dtype=np.uint64) * _ROOT)
        values[65:91] = values[97:123]
        self.values = values
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            base = int(_ROOT) | 1
            for name, b in (("powers", base), ("inverse", pow(base, -1, 1 << 64))):
                p = np.full(n, b & (1 << 64) - 1, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start byte, end byte) of each word, and for each row the index of its first word (one more entry than rows)."""
        parts, at, n = [], 0, len(data)
        begins = np.zeros(n + 1, bool)
        begins[offsets] = True
        while at < n:
            end = min(n, at + _SEGMENT)
            while end < n and not self.separators[data[end]] and not begins[end]:
                end += 1
            parts.append(self._segment(data[at:end], begins[at : end + 1], at))
            at = end
        h, starts, ends = (np.concatenate(x) if parts else np.zeros(0, t) for x, t in zip(zip(*parts, strict=True) if parts else ((), (), ()), (np.uint64, np.int64, np.int64), strict=True))
        return h, starts, ends, np.searchsorted(starts, offsets)

    def _segment(self, data: np.ndarray, begins: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        self._grow(max(n + 1, _SEGMENT + 1))
        solid = ~self.separators[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | begins[1:n]
        last[:-1] &= ~solid[1:] | begins[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64)), starts + at, ends + at


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of ``k`` words; of the whole sequence if it has fewer words; none if it has none."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = mix(out * _ROOT + words[j : n - k + 1 + j])
    return out


def longs(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones that Spark stores."""
    return x.view(np.int64)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its values and the end of each row."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, kind))


#: Latin letters and numbers up to U+017F; with spaces, line feeds and the marks below, the characters of which
#: case, normal form and class are the same in Python and in the tokenizers library.
_L, _N = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾"
_PLAIN = re.compile("[^\n\x20-\x7e¡-¬®-įı-ſ‐-‧‰-⁞]").search
_SPLITS = {
    "byte": re.compile(rf" ?[{_L}]+| ?[{_N}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^ \n{_L}{_N}]+|[ \n]+(?![^ \n])|[ \n]+").findall,
    "word": re.compile(rf"[{_L}]+|[{_N}]|'s|'t|'re|'ve|'m|'ll|'d|[^ \n{_L}{_N}]+").findall,
}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class CachedEncoder:
    """Token ids of whole texts by the ``tokenizers`` library, equal to encoding each text as a whole.

    For the two pre-tokenizers that it knows, and texts of common characters
    only, a text is split into its pre-tokens here; the library's model encodes
    each distinct one, and its ids are remembered. Any other text, any text of
    another tokenizer, and any in which a token stands that was added to the
    vocabulary (its id is given, as the library does), is encoded whole.
    ``capacity`` bounds the bytes that remembered pre-tokens take; further ones
    are encoded each time.
    """

    def __init__(self, path: str, capacity: int = 96 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.model, self.kind = self.tokenizer.model, self._kind()
        self.split = _SPLITS.get(self.kind)
        self.letters = _byte_letters()
        self.capacity, self.size, self.cache = capacity, 0, {}

    def _kind(self) -> str | None:
        spec = json.loads(self.tokenizer.to_str())
        before, normal = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        bpe = spec["model"]["type"] == "BPE" and not spec["model"]["dropout"]
        if bpe and not normal and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
            return "byte"
        steps, splits = normal.get("normalizers", []), before.get("pretokenizers", [])
        if bpe and [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in splits] == ["Split", "ByteLevel"]:
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
            first, last = splits
            if first["pattern"] == {"Regex": pattern} and first["behavior"] == "Removed" and first["invert"] and not last["use_regex"] and not last["add_prefix_space"]:
                return "word"
        return None

    def _encode(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isalnum()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [x.id for x in self.model.tokenize(piece)]).tobytes()

    def _pieces(self, text: str) -> list[str] | bytes:
        """The text's pre-tokens, or its ids if it has to be encoded whole."""
        if self.split is None or _PLAIN(text):
            return self._whole(text)
        own = text.lower() if self.kind == "word" else text
        if any(x in text or x in own for x in self.added):
            return self._whole(text)
        return self.split(own)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str | None], limit: int = 2_000_000) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers; null counts as empty.

        Texts are taken together until they hold ``limit`` characters.
        """
        group: list[list[str] | bytes] = []
        size = 0
        for text in texts:
            group.append(self._pieces(text) if text else [])
            size += len(text or "")
            if size >= limit:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[list[str] | bytes]) -> Iterator[bytes]:
        seen: set[str] = set()
        for pieces in group:
            if type(pieces) is list:
                seen.update(pieces)
        found = {x: self._encode(x) for x in seen.difference(self.cache)}
        get = self.cache.__getitem__
        if self.size < self.capacity:
            kept = {x: b for x, b in found.items() if len(x) <= 64}
            self.cache.update(kept)
            self.size += sum(len(x) + len(b) + 190 for x, b in kept.items())  # with what Python adds to each
            found = found if len(kept) < len(found) else {}
        if found:
            get = _Both(self.cache, found).__getitem__
        for pieces in group:
            yield b"".join(map(get, pieces)) if type(pieces) is list else pieces


class _Both(dict):
    """Lookup in a small dictionary first, then in a large one that is not copied."""

    def __init__(self, large: dict[str, bytes], small: dict[str, bytes]):
        super().__init__(small)
        self.large = large

    def __missing__(self, key: str) -> bytes:
        return self.large[key]
