"""Language-model scores by subword lattice likelihood.

The model spells a text as a sequence of pieces. The probability of a word is that
of all its segmentations together, by a forward recursion in log space over the
lattice of

* the pieces of an existing vocabulary, of which all single bytes are some,
* the whole word, where it was seen in the texts that are learned from.

A text is a sequence of words and one end, so its marginal probability is the
product of theirs; words do not overlap, which is why each distinct word goes
through its lattice once, however often it occurs.

Learned are the counts of words, and the weights of pieces: from the vocabulary's
own scores, a few rounds of expectation-maximisation go over the distinct words,
each counted once, because pieces are there to spell words not seen before. How
much probability they get against whole words is the Witten-Bell rule: distinct
words over tokens and distinct words. Probabilities of all texts add up to one at
most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import word_blocks
from .lattice import Lattice, vocabulary
from .shared import Workspace, spread_join

#: Rounds of expectation-maximisation; how many pieces the vocabulary's own scores count for in each.
ROUNDS, PRIOR = 3, 1000.0


@dataclass(frozen=True)
class Model:
    """``tokens`` and ``distinct`` tokens learned from, ``ends`` of them ends of texts; weights of the pieces."""

    pieces: list[bytes]
    logp: np.ndarray
    tokens: int
    distinct: int
    ends: int

    @property
    def spelled(self) -> float:
        """The share of tokens that are spelled."""
        return self.distinct / (self.tokens + self.distinct) if self.tokens else 1.0

    def word_logs(self, spelled_log: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The natural log of each word's probability, from that of its pieces' segmentations and its count: the whole word is one more edge."""
        with np.errstate(divide="ignore"):
            whole = np.log(counts / max(self.tokens, 1)) + np.log1p(-self.spelled)
        return np.logaddexp(whole, np.log(self.spelled) + spelled_log)

    def base_logs(self, counts: np.ndarray) -> np.ndarray:
        """log10 of add-one estimates."""
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))


def count_words(blocks: DataFrame) -> DataFrame:
    """(word, count) of every word of the blocks: how often it is in flagged documents, 0 if only in others."""
    return word_blocks.features(blocks).groupBy("word").agg(F.sum("flagged").alias("count"))


def _together(batches: Iterator[pa.RecordBatch], rows: int = 1 << 15, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until they have so many rows or bytes: a lattice costs less a word for many words."""
    held, n, total = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, total = n + batch.num_rows, total + batch.nbytes
        if n >= rows or total >= size:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n, total = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fit(words: DataFrame, documents: int, path: str) -> Model:
    """A model from (word, count), a written table, and the number of documents that were counted."""
    learned = words.where("count > 0")
    found = learned.agg(F.count(F.lit(1)), F.sum("count")).first()
    pieces, own = vocabulary(path)
    logp, n = own, len(pieces)
    for _ in range(ROUNDS if found[0] else 0):

        def run(batches: Iterator[pa.RecordBatch], logp: np.ndarray = logp) -> Iterator[pa.RecordBatch]:
            lattice, sums = Lattice(pieces), np.zeros(n)
            for batch in _together(batches):
                texts = [x.encode() for x in batch.column(0).to_pylist()]
                sums += lattice.expected(texts, np.ones(len(texts)), logp)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[used])], names=["piece", "times"])

        # A row a piece comes back, whatever the words.
        rows = learned.select("word").mapInArrow(run, "piece long, times double").groupBy("piece").agg(F.sum("times").alias("times")).toArrow()
        times = np.zeros(n)
        times[rows.column("piece").to_numpy()] = rows.column("times").to_numpy()
        times[0] = 1  # the end is one of the tokens
        logp = np.log(times + PRIOR * np.exp(own)) - np.log(times.sum() + PRIOR)
    return Model(pieces, logp, (found[1] or 0) + documents, found[0] + (documents > 0), documents)


def spell(words: DataFrame, model: Model) -> DataFrame:
    """(word, count, spelled): the natural log of the probability of all segmentations of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.pieces)
        for batch in _together(batches):
            found = lattice.forward([x.encode() for x in batch.column(0).to_pylist()], model.logp)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["word", "count", "spelled"])

    return words.select("word", "count").mapInArrow(run, "word string, count long, spelled double")


_SCORES = "doc_id long, learned boolean, n_tokens long, n_known long, base_score double, score double, spelled_score double"


def score(docs: DataFrame, learn: Column, path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Model]:
    """(doc_id, learned, n_tokens, n_known, base_score, score, spelled_score) of every row of ``docs``, and the model.

    The model learns from rows for which ``learn`` holds (null: does not). All
    scores are log10: of add-one estimates of tokens, of the lattice, and of the
    lattice without whole words. Null and empty texts are one end. Without a row
    to learn from, all is spelled by the vocabulary's own scores, and the base
    score is 0. Repeated rows are counted and scored each; null ids stay null; an
    empty table gives an empty result; other columns are not read.
    """
    work = Workspace(docs.sparkSession)
    blocks = word_blocks.keep(work, word_blocks.word_blocks(docs, learn, word_blocks.WORDS, 1, id_col, text_col))
    words = work.keep(count_words(blocks), "words")
    model = fit(words, word_blocks.documents(blocks).where("flag").count(), path)
    spelled = work.keep(spell(words, model), "spelled")
    work.drop("words")
    known = spread_join(word_blocks.features(blocks).select("block", "place", "word"), spelled, "word", work, "known").select(F.col("block").alias("of"), "place", "count", "spelled")

    def run(documents: pa.Table, values: pa.Table) -> pa.Table:
        place = values.column("place").to_numpy()
        counts, logs = np.zeros(len(place)), np.zeros(len(place))
        counts[place], logs[place] = values.column("count").to_numpy(), values.column("spelled").to_numpy()
        row, feature, times = word_blocks.by_document(documents)
        n = documents.num_rows

        def summed(each: np.ndarray) -> np.ndarray:
            return np.bincount(row, each[feature] * times, n)

        end, ends = model.logp[:1], np.array([float(model.ends)])
        scores = [summed(model.base_logs(counts)) + model.base_logs(ends), (summed(model.word_logs(logs, counts)) + model.word_logs(end, ends)) / np.log(10), (summed(logs) + end) / np.log(10)]
        known = summed((counts > 0).astype(float)).astype(np.int64) + int(model.ends > 0)
        columns = [documents.column("doc_id"), documents.column("flag"), pa.array(documents.column("n_words").to_numpy() + 1), pa.array(known), *map(pa.array, scores)]
        return pa.Table.from_arrays(columns, names=["doc_id", "learned", "n_tokens", "n_known", "base_score", "score", "spelled_score"])

    return word_blocks.documents(blocks).groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, _SCORES), model
