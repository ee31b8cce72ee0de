"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of words, without case and
punctuation. Windows of ``least`` words that a document shares with an item are
the seeds, joined on their hash: first those by which a leak must be found, the
rest for the pairs that these give. For each document and item with enough seeds,
the longest matches that do not overlap are marked again and again, down to
``least`` words, so a passage that was cut up and reordered is still found whole.
An item is leaked where the marked words are at least ``threshold`` of it.

Candidate matches of one length are found by running Karp-Rabin hashes, which
prefix sums give for any length, and are compared word by word before they are
marked. Only words within seeds can be part of a match, so a pair costs its
shared passages and not the document's length.

Of the documents, only windows that pass a filter of the benchmark's seeds, of a
fixed size, are shuffled; nothing else of the benchmark is broadcast, and none of
it is collected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HOT, PUNCTUATION, WordHasher, Workspace, lists, longs, shingle_hashes, slices, spread_join, utf8

LEAST = 5
THRESHOLD = 0.5
#: log2 of the bits of the filter of seeds, which is broadcast.
FILTER_BITS = 26
#: Leaking documents whose ids and hashes are broadcast, some 10 MB.
FEW = 200_000

_BASE = 0x9E3779B97F4A7C15


def _running(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the words' polynomial, and the inverse powers that move a window's difference back to power zero."""
    powers, inverse = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(words), b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers[:-1], out=sums[1:])
    return sums, inverse


def _windows(sums: np.ndarray, inverse: np.ndarray, length: int) -> np.ndarray:
    return (sums[length:] - sums[:-length]) * inverse[: len(sums) - length] if length < len(sums) else np.zeros(0, np.uint64)


def _open(free: np.ndarray, length: int) -> np.ndarray:
    """Whether all words of each window are free."""
    sums = np.concatenate([[0], np.cumsum(~free)])
    return sums[length:] == sums[:-length]


def tiles(text: np.ndarray, pattern: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in text, start in pattern, length) of the greedy tiling, longest first."""
    with np.errstate(over="ignore"):
        text_sums, text_inverse = _running(text)
        pattern_sums, pattern_inverse = _running(pattern)
        free_text, free_pattern = np.ones(len(text), bool), np.ones(len(pattern), bool)
        out: list[tuple[int, int, int]] = []

        def matches(length: int) -> list[tuple[int, int]]:
            """Starts of equal free windows."""
            a, b = _windows(text_sums, text_inverse, length), _windows(pattern_sums, pattern_inverse, length)
            if not len(a) or not len(b):
                return []
            open_a, open_b = _open(free_text, length), _open(free_pattern, length)
            where = defaultdict(list)
            for j in np.flatnonzero(open_b).tolist():
                where[int(b[j])].append(j)
            starts = np.flatnonzero(open_a & np.isin(a, b[open_b]))
            return [(i, j) for i in starts.tolist() for j in where[int(a[i])] if np.array_equal(text[i : i + length], pattern[j : j + length])]

        # The longest match is found by bisection: a match of any length has matches of all shorter ones.
        longest = min(len(text), len(pattern))
        while longest >= least:
            low, high = least - 1, longest
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if matches(middle) else (low, middle - 1)
            longest = low
            if longest < least:
                break
            for i, j in matches(longest):
                if free_text[i : i + longest].all() and free_pattern[j : j + longest].all():
                    free_text[i : i + longest] = False
                    free_pattern[j : j + longest] = False
                    out.append((i, j, longest))
    return out


def _word_hashes(column: pa.Array, hasher: WordHasher) -> Iterator[np.ndarray]:
    data, offsets = utf8(pc.utf8_lower(column))
    for a, b in slices(offsets):
        h, _, _, first = hasher.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for i, j in zip(first[:-1], first[1:], strict=True):
            yield h[i:j]


def benchmark_items(benchmark: DataFrame, least: int, item_col: str, item_text: str, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, n_words, pattern) of each row with a word, and (item, seed, times, need) of its distinct seeds.

    ``pattern`` are the words' hashes, ``times`` is in how many places the item
    has the seed, and ``need`` how many such places a document must have at
    least, if all of the item is to be covered. A row of fewer than ``least``
    words is one seed; null and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, at = WordHasher(PUNCTUATION), TaskContext.get().partitionId() << 40
        for batch in batches:
            for item, words in zip(batch.column(0), _word_hashes(batch.column(1), hasher), strict=True):
                if len(words):
                    seeds, times = np.unique(shingle_hashes(words, least), return_counts=True)
                    columns = [pa.array([at]), pa.array([item.as_py()], pa.int64()), pa.array([len(words)], pa.int32()), *(lists(x, np.array([len(x)]), t) for x, t in ((longs(words), pa.int64()), (longs(seeds), pa.int64()), (times, pa.int32())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["item", "item_id", "n_words", "pattern", "seeds", "times"])
                    at += 1

    source = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    items = work.keep(source.mapInArrow(run, "item long, item_id long, n_words int, pattern array<long>, seeds array<long>, times array<int>"), "items")
    each = items.select("item", (F.col("n_words") / F.least("n_words", F.lit(least))).alias("need"), F.explode(F.arrays_zip("seeds", "times")).alias("s"))
    return items.drop("seeds", "times"), each.select("item", "need", F.col("s.seeds").alias("seed"), F.col("s.times").alias("times"))


def _seed_filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each value that the top ``FILTER_BITS`` bits of a seed can have; what is collected has at most as many bits, whatever the benchmark."""
    top = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")
    words = seeds.groupBy(F.shiftright(top, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _passing_windows(docs: DataFrame, seeds: DataFrame, sizes: list[int]) -> DataFrame:
    """(row, doc_id, text_hash, at, seed, words) of each document window that the filter of seeds lets pass; ``row`` numbers the rows of ``docs``."""
    cast = docs.sparkSession.sparkContext.broadcast(_seed_filter(seeds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, hasher, row = cast.value, WordHasher(PUNCTUATION), TaskContext.get().partitionId() << 40
        for batch in batches:
            for k, words in enumerate(_word_hashes(batch.column(1), hasher)):
                for size in sizes:
                    windows = shingle_hashes(words, size) if len(words) >= size else words[:0]
                    top = windows >> np.uint64(64 - FILTER_BITS)
                    places = np.flatnonzero(bits[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1))
                    for part in np.split(places, range(10_000, len(places), 10_000)):
                        if len(part):
                            own = words[part[:, None] + np.arange(size)].reshape(-1)
                            ids = pa.array([batch.column(0)[k].as_py()] * len(part), pa.int64())
                            texts = pa.array(np.full(len(part), batch.column(2)[k].as_py()))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), row)), ids, texts, pa.array(part), pa.array(longs(windows[part])), lists(longs(own), np.arange(1, len(part) + 1) * size, pa.int64())], names=["row", "doc_id", "text_hash", "at", "seed", "words"])
                row += 1

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "row long, doc_id long, text_hash long, at long, seed long, words array<long>")


def _tiled(at: list[int], windows: np.ndarray, pattern: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The tiles of an item in a document of which the shared windows are known, as (start in the document, start in the item, words)."""
    size = windows.shape[1]
    places, first = np.unique((np.array(at)[:, None] + np.arange(size)).reshape(-1), return_index=True)
    breaks = np.flatnonzero(np.diff(places) > 1) + 1
    # Words of separate stretches must not join: each break gets a value of its own, which no word has.
    text = np.insert(windows.reshape(-1)[first], breaks, np.arange(len(breaks), dtype=np.uint64))
    origin = np.insert(places, breaks, -1)
    return [(int(origin[i]), j, n) for i, j, n in tiles(text, pattern, min(least, len(pattern)))]


def _lookups(items: DataFrame, seeds: DataFrame, windows: DataFrame, threshold: float, least: int, work: Workspace) -> DataFrame:
    """``seeds`` (item, need, seed, times) with ``frequent``: the seeds of an item by which no document needs to be found.

    Frequent seeds, most frequent in ``windows`` first, are left out as long as all
    the words that they cover are too few for a leak: a document that leaks the
    item has another of its seeds. So a phrase that many documents and items
    share brings no pairs, and none is lost.
    """
    found = windows.groupBy("seed").agg(F.count(F.lit(1)).alias("found"))
    counted = work.keep(seeds.join(found, "seed").groupBy("item").agg(F.collect_list(F.struct("seed", "found")).alias("found")), "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, pattern, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = pattern.values.to_numpy().view(np.uint64)
                own, size = shingle_hashes(words, least), min(least, len(words))
                seeds, counts = (found.values.field(k).to_numpy() for k in (0, 1))
                at, order = np.argsort(own, kind="stable"), np.lexsort((seeds, -counts))
                covered, total, frequent = np.zeros(len(words), bool), 0, []
                for seed in seeds[order].view(np.uint64):
                    places = at[np.searchsorted(own[at], seed) : np.searchsorted(own[at], seed, "right")]
                    new = np.unique((places[:, None] + np.arange(size)).reshape(-1))
                    more = int((~covered[new]).sum())
                    if (total + more) / len(words) >= threshold:
                        break
                    covered[new] = True
                    total += more
                    frequent.append(seed)
                if frequent:
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(frequent)), pa.array(longs(np.array(frequent, np.uint64)))], names=["item", "seed"])

    marked = items.join(counted, "item").select("item", "pattern", "found").mapInArrow(run, "item long, seed long").withColumn("frequent", F.lit(True))
    return seeds.join(marked, ["item", "seed"], "left").withColumn("frequent", F.coalesce("frequent", F.lit(False)))


def _leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, least: int, item_col: str, item_text: str) -> DataFrame:
    """``leaked`` for (doc_id, text), with the column text_hash."""
    work = Workspace(docs.sparkSession)
    items, seeds = benchmark_items(benchmark, least, item_col, item_text, work)
    seeds = work.keep(seeds, "seeds")
    sizes = [r.n for r in items.select(F.least("n_words", F.lit(least)).alias("n")).distinct().collect()]  # ``least`` values at most
    windows = work.keep(_passing_windows(docs, seeds, sorted(sizes)), "windows")
    marked = work.keep(_lookups(items, seeds, windows, threshold, least, work), "marked")
    columns = ["row", "doc_id", "text_hash", "item", "need", "times", "at", "words"]
    met = work.keep(spread_join(windows, marked.where("not frequent").drop("frequent"), "seed", work, "windows", HOT).select(*columns), "met")
    # The frequent seeds of the items that a document was found by.
    candidates = work.keep(met.select("row", "item").distinct(), "candidates")
    asked = spread_join(candidates, marked.where("frequent").drop("frequent"), "item", work, "candidates", HOT)
    met = met.unionByName(windows.join(asked, ["row", "seed"]).select(*columns))
    pairs = met.groupBy("row", "doc_id", "text_hash", "item").agg(F.sum("times").alias("times"), F.first("need").alias("need"), F.collect_list(F.struct("at", "words")).alias("shared"))
    pairs = work.keep(pairs.where(F.col("times") >= F.col("need") * F.lit(threshold)).drop("times", "need"), "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                doc, text, item, n_words, shared, pattern = (c[k] for c in batch.columns)
                at, windows = shared.values.field("at").to_pylist(), shared.values.field("words")
                own = windows.flatten().to_numpy().view(np.uint64).reshape(len(at), -1)
                found = _tiled(at, own, pattern.values.to_numpy().view(np.uint64), least)
                coverage = sum(n for _, _, n in found) / n_words.as_py()
                if coverage >= threshold:
                    rows.append({"doc_id": doc.as_py(), "text_hash": text.as_py(), "item_id": item.as_py(), "coverage": coverage, "n_tiles": len(found), "n_words": n_words.as_py(), "tiles": [{"doc_word": i, "item_word": j, "words": n} for i, j, n in found]})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _LEAKS)

    both = spread_join(pairs, items, "item", work, "pairs", HOT)
    return both.select("doc_id", "text_hash", "item_id", "n_words", "shared", "pattern").mapInArrow(run, "doc_id long, text_hash long, item_id long, coverage double, n_tiles int, n_words int, tiles array<struct<doc_word:int,item_word:int,words:int>>")


_LEAKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("n_words", pa.int32()), ("tiles", pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())])))])


def leaked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, n_words, tiles) of each document row and item it leaks.

    ``tiles`` are (start word in the document, start word in the item, words).
    Null and empty texts leak nothing, and neither do items without words; an
    item of fewer than ``least`` words is looked for whole. Repeated rows, of
    documents or items, give repeated results; null ids stay null. Empty tables
    give an empty result; other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _leaks(source, benchmark, threshold, least, item_col, item_text).drop("text_hash")


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whatever their names, that leak no item; cases as in ``leaked``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = _leaks(source, benchmark, threshold, least, item_col, item_text)
    gone = Workspace(docs.sparkSession).keep(found.select("doc_id", "text_hash").distinct(), "gone")
    same = docs[id_col].cast("long").eqNullSafe(gone.doc_id) & (F.xxhash64(docs[text_col].cast("string")) == gone.text_hash)
    # Up to FEW rows of two numbers are sent to the documents; more of them meet the documents in the shuffle.
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone.hint("shuffle_hash"), same, "left_anti")
