"""Importance resampling towards a target distribution, over an integer word dictionary.

Distinct words get ids. A run of words is a tuple of ids; each distinct tuple is
put together from the dictionary and hashed once, and its bucket is joined back to
the places where the tuple occurs. The counts of buckets in the source and in the
target give each bucket's gain, the mean gain of a document's runs its weight, and
weights with Gumbel noise that depends on the document's id alone a sample without
replacement.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import word_blocks
from .shared import Workspace, spread_join

BUCKETS = 10_000


def dictionary(found: DataFrame, work: Workspace) -> DataFrame:
    """(word, id, source, target) of each distinct word, with its counts in the source and in the target."""
    words = found.where("word is not null").groupBy("word").agg(F.sum("others").alias("source"), F.sum("flagged").alias("target"))
    return work.keep(words.withColumn("id", F.monotonically_increasing_id()), "dictionary")


def _numbered_runs(found: DataFrame, known: DataFrame, words: DataFrame, work: Workspace) -> DataFrame:
    """(block, place, ids, source, target) of each block's runs of two words or more; a block's words give ids to its runs."""
    ids = spread_join(known, words, "word", work, "numbered").select(F.col("block").alias("of"), F.col("place").alias("at"), "id")

    def run(runs: pa.Table, numbers: pa.Table) -> pa.Table:
        of = np.zeros(numbers.num_rows, np.int64)
        of[numbers.column("at").to_numpy()] = numbers.column("id").to_numpy()
        parts = [[int(of[k]) for k in x] for x in runs.column("parts").to_pylist()]
        return pa.Table.from_arrays([runs.column("block"), runs.column("place"), pa.array(parts, pa.list_(pa.int64())), runs.column("others"), runs.column("flagged")], names=["block", "place", "ids", "source", "target"])

    runs = found.where("parts is not null").select("block", "place", "parts", "others", "flagged")
    numbered = runs.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(run, "block long, place int, ids array<long>, source long, target long")
    return work.keep(numbered, "runs")


def hashed_runs(runs: DataFrame, words: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(ids, source, target, bucket) of each distinct tuple: its words are looked up and its bytes hashed once."""
    out = runs.groupBy("ids").agg(F.sum("source").alias("source"), F.sum("target").alias("target"))
    for k in range(longest):
        out = out.join(words.select(F.col("id").alias(f"id{k}"), F.col("word").alias(f"word{k}")), F.get("ids", F.lit(k)) == F.col(f"id{k}"), "left").drop(f"id{k}")
    text = F.concat_ws(" ", *(f"word{k}" for k in range(longest)))
    return out.select("ids", "source", "target", _bucket(text, buckets))


def _bucket(text, buckets: int):
    return (F.crc32(F.encode(text, "UTF-8")) % buckets).cast("int").alias("bucket")


def gains(counts: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket from rows (bucket, source, target); a row a bucket reaches the driver."""
    found = {r.bucket: (r.source, r.target) for r in counts.groupBy("bucket").agg(F.sum("source").alias("source"), F.sum("target").alias("target")).collect()}
    source, target = (sum(x[k] for x in found.values()) for k in (0, 1))
    out = []
    for b in range(buckets):
        s, t = found.get(b, (0, 0))
        out.append(math.floor(1000 * math.log((t + 1.0) * (source + buckets) / ((s + 1.0) * (target + buckets)))))
    return out


def weigh(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs``: the floored mean gain of its runs of 1 to ``longest`` words.

    A document without a word has weight 0. Null texts are empty; repeated rows
    are counted and weighed each; null ids stay null; an empty table gives an
    empty result, an empty target no gain but for what the source lacks; other
    columns are not read.
    """
    work = Workspace(docs.sparkSession)
    columns = [F.lit(False).alias("__target"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    both = docs.select(*columns).unionByName(target.select(F.lit(True).alias("__target"), F.lit(None).cast("long").alias("doc_id"), F.col(target_text).cast("string").alias("text")))
    blocks = word_blocks.keep(work, word_blocks.word_blocks(both, F.col("__target"), word_blocks.LETTERS, longest))
    found = word_blocks.features(blocks)
    known = found.where("word is not null").select("block", "place", "word")
    words = dictionary(found, work)
    counts = words.select(_bucket(F.col("word"), buckets), "source", "target")
    placed = spread_join(known, words.select("word", _bucket(F.col("word"), buckets)), "word", work, "known").select("block", "place", "bucket")
    if longest > 1:
        runs = _numbered_runs(found, known, words.select("word", "id"), work)
        hashed = work.keep(hashed_runs(runs, words, longest, buckets), "hashed")
        counts = counts.unionByName(hashed.select("bucket", "source", "target"))
        placed = placed.unionByName(spread_join(runs.select("block", "place", "ids"), hashed.select("ids", "bucket"), "ids", work, "placed").select("block", "place", "bucket"))
    gain = np.array(gains(counts, buckets), np.int64)

    def run(documents: pa.Table, values: pa.Table) -> pa.Table:
        own = np.zeros(values.num_rows, np.int64)
        own[values.column("at").to_numpy()] = gain[values.column("bucket").to_numpy()]
        row, feature, times = word_blocks.by_document(documents)
        n = documents.num_rows
        sums, sizes = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(sums, row, own[feature] * times)
        np.add.at(sizes, row, times)
        weight = np.where(sizes > 0, sums // np.maximum(sizes, 1), 0)
        return pa.Table.from_arrays([documents.column("doc_id"), documents.column("n_words"), pa.array(sizes), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    sources = word_blocks.documents(blocks).where("not flag")
    return sources.groupBy("block").cogroup(placed.select(F.col("block").alias("of"), F.col("place").alias("at"), "bucket").groupBy("of")).applyInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, chosen, order: list, n: int) -> DataFrame:
    """``rows``, a written table, with ``rank``, from 1, of the first ``n`` rows for which ``chosen`` holds, by ``order``; others have null.

    Ranges of rows are sorted on their own; a count a range says where it starts.
    """
    work = Workspace(rows.sparkSession)
    ranges = rows.where(chosen).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranges = work.keep(ranges, "ranges")
    part = F.shiftright("__at", 33)
    starts = ranges.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row a task
    starts = starts.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    drawn = ranges.join(F.broadcast(starts), part == F.col("__part")).select(*rows.columns, F.when(place <= n, place).alias("rank"))
    return drawn.unionByName(rows.where(~F.coalesce(chosen, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, seed: int, percent: int, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs``.

    Of the documents of at least ``least_words`` words, ``percent`` in a hundred
    are drawn: those with the highest scores, ties to the smaller doc_id; ``rank``
    is null for all others. Rows that are alike in both have an order that is not
    told. A null id is noise of its own, as an empty text, and comes last. Other
    cases as in ``weigh``.
    """
    work = Workspace(docs.sparkSession)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = work.keep(weigh(docs, target, longest, buckets, id_col, text_col, target_text).withColumn("score", F.col("weight") + noise), "weighed")
    long_enough = F.col("n_words") >= least_words
    n = weighed.where(long_enough).count() * percent // 100
    return ranked(weighed, long_enough, [F.desc("score"), F.asc_nulls_last("doc_id")], n)
