"""Language identification by error-correcting output codes.

Every learned language has a codeword of bits. One binary classifier a bit, a
linear scorer of hashed byte n-grams, tells whether a text's language has that
bit set; the languages on either side of a bit differ from bit to bit, so
several must err together before another codeword is nearer. Decoding is
loss-weighted: a language's loss is the sum over the bits of the logistic loss
of the calibrated margin against its codeword, weighed by how well that bit's
classifier did on held-back rows. The least loss wins; a text whose second best
is within ``AMBIGUOUS`` of it is flagged.

The classifiers are fitted on a bounded sample, ``per_language`` rows of each
language, those with the least hash of their id, whatever the size of the
table: n-gram counts of one half give the weights, margins on the other half
their scale and the bits' weights.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import mix, slices, text_batches, utf8

BITS = 16
ORDERS = (2, 3, 4)
PER_LANGUAGE = 2000
AMBIGUOUS = 0.5
FIXED = 1 << 16
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of ``n`` languages: all splits up to 7 languages, else a fixed random code."""
    if not n:
        return np.zeros((0, 0), np.int8)
    if n <= 7:
        columns = [[(k >> i) & 1 for i in range(n)] for k in range(1, 2 ** max(n - 1, 0))]
        code = np.array(columns, np.int8).reshape(-1, n).T
    else:
        width, best, found = int(np.ceil(10 * np.log2(n))), -1, None
        draw = np.random.default_rng(7)
        for _ in range(200):
            trial = draw.integers(0, 2, (n, width), np.int8)
            trial = trial[:, (trial.any(0)) & (~trial.all(0))]
            apart = (trial[:, None, :] != trial[None, :, :]).sum(2) + np.eye(n, dtype=np.int64) * width
            if apart.min() > best:
                best, found = apart.min(), trial
        code = found
    return code * 2 - 1


def grams(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the rows: hashed n-gram indices of all orders (orders x bytes) and the rows' byte offsets.

    Case is folded and every ASCII byte that is no letter counts as a space. As
    many spaces stand between rows as keep an n-gram from spanning two of them.
    """
    data, offsets = utf8(pc.utf8_lower(column))
    for a, b in slices(offsets, 1 << 18):
        ends = offsets[a : b + 1] - offsets[a]
        lengths = np.diff(ends) + max(ORDERS)
        at = np.concatenate([[0], np.cumsum(lengths)])
        text = np.full(at[-1] + max(ORDERS), 32, np.uint64)
        where = np.arange(ends[-1]) + np.repeat(at[:-1] - ends[:-1] + max(ORDERS) - 1, np.diff(ends))
        text[where] = _FOLD[data[offsets[a] : offsets[b]]]
        n, out, code = at[-1], [], text[: at[-1]].copy()
        for order in range(2, max(ORDERS) + 1):
            code = (code << np.uint64(8)) | text[order - 1 : order - 1 + n]
            if order in ORDERS:
                out.append((mix(code + np.uint64(order << 40)) >> np.uint64(64 - BITS)).astype(np.int32))
        yield np.array(out), at


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # of n-grams, by bit, as whole multiples of 1 / FIXED
    scale: np.ndarray
    shift: np.ndarray
    trust: np.ndarray

    def margins(self, column: pa.Array) -> np.ndarray:
        """The mean n-gram weight of each row, by bit."""
        parts = [np.zeros((0, self.code.shape[1]))]
        for index, at in grams(column):
            # Whole numbers: the sum is the same wherever a text stands in a batch.
            sums = np.zeros((len(at) - 1, self.code.shape[1]), np.int64)
            for row in index:
                for bit in range(self.code.shape[1]):
                    sums[:, bit] += np.add.reduceat(self.weights[bit][row], at[:-1], dtype=np.int64)
            parts.append(sums / (np.diff(at) * len(ORDERS) * FIXED)[:, None])
        return np.concatenate(parts)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, probability, second loss less best loss) of each row."""
        z = margins * self.scale + self.shift
        losses = (np.logaddexp(0, -z[:, None, :] * self.code[None]) * self.trust).sum(2)
        best = losses.argmin(1)
        p = np.exp(losses.min(1, keepdims=True) - losses)
        two = np.partition(losses, 1, 1)[:, :2] if losses.shape[1] > 1 else np.stack([losses[:, 0], losses[:, 0] + 100], 1)
        return best, 1 / p.sum(1), two[:, 1] - two[:, 0]


def _counts(sample: DataFrame, languages: list[str]) -> np.ndarray:
    """n-gram counts of the sampled rows by language; the sample is bounded, and so is what comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), 1 << BITS), np.int64)
        place = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            row = 0
            langs = batch.column(0).to_pylist()
            for index, at in grams(batch.column(1)):
                for k in range(len(at) - 1):
                    counts[place[langs[row]]] += np.bincount(index[:, at[k] : at[k + 1]].reshape(-1), minlength=1 << BITS)
                    row += 1
        used = [i for i in range(len(languages)) if counts[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(counts[i].tobytes(), 1) for i in used], pa.binary())], names=["lang", "counts"])

    out = np.zeros((len(languages), 1 << BITS))
    for row in sample.select("lang", "text").coalesce(8).mapInArrow(run, "lang int, counts binary").toLocalIterator():
        out[row.lang] += np.frombuffer(zlib.decompress(row.counts), np.int64)
    return out


def fit(rows: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of ``rows``; rows without id, text or language are not used.

    Rows that repeat a sampled id are all used. Without any row, as in an empty
    table, the model knows no language.
    """
    text_batches(rows.sparkSession)
    named = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc_id is not null and lang is not null")
    # Ids first, and of a frequent language only those whose hash is below a bound that four times enough rows pass.
    known = named.where("text is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    share = known.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count(F.lit(1))).alias("share"))  # a row a language
    near = known.join(F.broadcast(share), "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share")).drop("share")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    chosen = near.withColumn("rank", order).where(F.col("rank") <= per_language).drop("rank")
    sample = named.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").persist()
    languages = [x.lang for x in sample.select("lang").distinct().orderBy("lang").collect()]
    code = codewords(len(languages))
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    counts = _counts(sample.where(half), languages) if languages else np.zeros((0, 1 << BITS))
    p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << BITS))
    weights = [np.log(p[code[:, b] > 0].mean(0)) - np.log(p[code[:, b] < 0].mean(0)) for b in range(code.shape[1])]
    n_bits = code.shape[1]
    model = Model(languages, code, np.rint(np.array(weights).reshape(n_bits, 1 << BITS) * FIXED).astype(np.int32), np.ones(n_bits), np.zeros(n_bits), np.ones(n_bits))
    if n_bits:
        _calibrate(model, sample.where(~half))
    sample.unpersist()
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """Scale, shift and trust of each bit, by logistic regression of the margins of at most the sample's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.margins(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(found), pa.list_(pa.float64()))], names=["lang", "margins"])

    rows = sample.select("lang", "text").mapInArrow(run, "lang string, margins array<double>").collect()
    if not rows:
        return
    x = np.array([r.margins for r in rows])
    place = {name: i for i, name in enumerate(model.languages)}
    y = model.code[[place[r.lang] for r in rows]]
    for b in range(x.shape[1]):
        spread = x[:, b].std() or 1.0
        a, c = 1.0, 0.0
        v = x[:, b] / spread
        side = np.where(y[:, b] > 0, 0.5 / max(1, (y[:, b] > 0).sum()), 0.5 / max(1, (y[:, b] < 0).sum()))
        for _ in range(200):  # Newton's method with a ridge
            q = 1 / (1 + np.exp(-np.clip(a * v + c, -30, 30)))
            g = side * (q - (y[:, b] > 0))
            h = side * q * (1 - q)
            ga, gc = (g * v).sum() + 1e-3 * a, g.sum() + 1e-4 * c
            haa, hac, hcc = (h * v * v).sum() + 1e-3, (h * v).sum(), h.sum() + 1e-4
            det = haa * hcc - hac * hac
            da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
            a, c = a - da, c - dc
            if abs(da) + abs(dc) < 1e-8:
                break
        right = float((side * ((a * v + c > 0) == (y[:, b] > 0))).sum())
        model.scale[b], model.shift[b] = a / spread, c
        model.trust[b] = max(0.05, np.log(min(right, 0.9999) / (1 - min(right, 0.9999)))) if right > 0.5 else 0.05
    model.trust /= model.trust.mean()


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous, margin) of each row of ``docs``.

    ``lang_pred`` is ``und`` with score 0 where text is null or has no letter,
    and for every row if no language was learned. ``margin`` is by how much the
    second nearest codeword's loss exceeds the nearest one's. Repeated rows are each
    answered, a null doc_id stays null, an empty table gives an empty result; other
    columns are not read.
    """
    text_batches(docs.sparkSession)
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cast.value
        for batch in batches:
            best, p, apart = model.decode(model.margins(batch.column(1)))
            known = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.where(known, p, 0.0)), pa.array(known & (apart < AMBIGUOUS)), pa.array(np.where(known, apart, 0.0))], names=["doc_id", "lang_pred", "score", "ambiguous", "margin"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.select("doc_id", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("known"))
    if not model.languages:
        return source.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"), F.lit(0.0).alias("margin"))
    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean, margin double")


def known(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language can be told.

    Rejected are texts that are null or have no letter, and those flagged as
    ambiguous of which no language is more likely than all others together.
    Without a learned language only the former are.
    """
    lettered = docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    if not model.languages:
        return lettered
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = cast.value
        for batch in batches:
            _, p, apart = model.decode(model.margins(batch.column(0).field(text_col)))
            yield batch.filter(pa.array((p >= 0.5) | (apart >= AMBIGUOUS)))

    rows = lettered.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")
