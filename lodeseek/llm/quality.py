"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. They overlap
and err, and how much is not known: expectation-maximisation estimates, from
their agreement alone, how often each votes what on good and on bad documents.
All that it needs of the corpus is how many documents have each pattern of
votes, which is bounded by 3 to the number of labellers however many documents
there are, so it runs over all of them. The posterior of a pattern labels its
documents, and a linear scorer of hashed byte trigrams and the labellers'
measures is trained on a bounded sample of posterior labels; it also ranks
documents whose pattern is undecided.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WHITE, WordHasher, Workspace, lists, mix, shingle_hashes, slices, utf8

#: (measure, bad below, good from, good to, bad above): votes by where the measure falls, none in between.
LABELLERS = (
    ("words", 2, 20, np.inf, np.inf),
    ("symbols", -1, -1, 0.06, 0.10),  # bytes that are neither letters, digits nor white space
    ("capitals", -1, -1, 0.15, 0.40),  # of ASCII letters
    ("fresh_trigrams", 0.5, 0.8, 2, 2),  # distinct word trigrams by word trigrams
    ("fresh_lines", 0.5, 0.9, 2, 2),
    ("word_bytes", 2.0, 3.0, 8.5, 12.0),
    ("sentences", 0.008, 0.02, 0.35, 0.6),  # full stops, question and exclamation marks by words
    ("short_words", -1, 0.15, 0.8, 0.95),  # of up to three bytes
    ("lone_symbols", -1, -1, 0.01, 0.04),  # words without a letter or digit
)
HASH_BITS = 18
SAMPLE = 8000
KEEP = 0.8
#: The most good documents that a labeller is taken to accuse, as a share: a bound that the estimates of
#: expectation-maximisation are held to. Each labeller looks for its own kind of fault, so few accuse the same
#: document, and without the bound a fault that only one of them sees is taken for a habit of good documents.
FALSE_ALARMS = 0.01

_KIND = np.zeros(256, np.uint8)  # 1 letter or digit, 2 capital, 4 symbol, 8 sentence end
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 0 if WHITE[_b] else 1 if _b >= 128 or _c.isalnum() else 4
    if _b < 128 and _c.isupper():
        _KIND[_b] |= 2
    if _c in ".?!":
        _KIND[_b] |= 8


def measures(column: pa.Array) -> np.ndarray:
    """A row of the labellers' measures for each text; null counts as empty."""
    data, offsets = utf8(column)
    hasher, out = WordHasher(), []
    for a, b in slices(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        h, starts, ends, first = hasher.words(part, at)
        kinds = _KIND[part]
        count = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])  # noqa: E731, B023
        n = np.diff(at)
        letters = np.maximum(count((kinds & 1 > 0) & (part < 128)), 1)
        symbols, capitals, stops = count(kinds & 4 > 0), count(kinds & 2 > 0), count(kinds & 8 > 0)
        size = ends - starts
        short = np.diff(np.concatenate([[0], np.cumsum(size <= 3)])[first])
        lettered = np.concatenate([[0], np.cumsum(kinds & 1 > 0)])
        named = lettered[ends] - lettered[starts]
        total = np.diff(np.concatenate([[0], np.cumsum(size)])[first])
        words = np.diff(first)
        for k in range(b - a):
            own = h[first[k] : first[k + 1]]
            grams = shingle_hashes(own, 3)
            lines = [x for x in part[at[k] : at[k + 1]].tobytes().split(b"\n") if x]
            lone = int((named[first[k] : first[k + 1]] == 0).sum())
            # Shares count some normal text in, so that a short text is not judged by a character or two.
            out.append(
                (
                    words[k],
                    (symbols[k] + 3) / (n[k] + 100),
                    (capitals[k] + 3) / (letters[k] + 60),
                    (len(np.unique(grams)) + 10) / (len(grams) + 10),
                    (len(set(lines)) + 3) / (len(lines) + 3),
                    (total[k] + 50) / (words[k] + 10),
                    (stops[k] + 2) / (words[k] + 30),
                    (short[k] + 9) / (words[k] + 30),
                    lone / (words[k] + 30),
                )
            )
    return np.array(out, np.float64).reshape(-1, len(LABELLERS))


def votes(found: np.ndarray) -> np.ndarray:
    """2 for good, 0 for bad, 1 for no vote, of each labeller."""
    out = np.ones(found.shape, np.int64)
    for k, (_, below, least, most, above) in enumerate(LABELLERS):
        x = found[:, k]
        out[(x >= least) & (x <= most), k] = 2
        out[(x < below) | (x > above), k] = 0
    return out


def patterns(found: np.ndarray) -> np.ndarray:
    return votes(found) @ 3 ** np.arange(len(LABELLERS))


def estimate(pattern: np.ndarray, count: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, P(vote | class) as class x labeller x vote, share of good)."""
    v = pattern[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    w = count / max(count.sum(), 1)
    # At first, one vote against decides: each labeller looks for its own kind of fault.
    good = 1 / (1 + np.exp(6.0 * (v == 0).sum(1) - 2.0))
    one_hot = np.eye(3)[v]
    table, share = None, 0.5
    for _ in range(rounds):
        weight = np.stack([w * (1 - good), w * good])
        # Prior counts, so that a labeller that never errs in the table is not taken as certain.
        table = np.einsum("cp,plv->clv", weight, one_hot) + 1e-3
        table /= table.sum(2, keepdims=True)
        # Labellers that never meet in one document could else pass for noise of good ones.
        excess = np.maximum(table[1, :, 0] - FALSE_ALARMS, 0)
        table[1, :, 0] -= excess
        table[1, :, 2] += excess
        share = min(max(float(weight[1].sum()), 0.01), 0.99)
        logs = np.einsum("plv,clv->pc", one_hot, np.log(table)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -50, 50)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    return good, table, share


@dataclass
class Scorer:
    weights: np.ndarray  # of hashed trigrams
    direct: np.ndarray  # of the squashed measures
    bias: float

    def score(self, column: pa.Array, found: np.ndarray) -> np.ndarray:
        data, offsets = utf8(column)
        out = []
        for a, b in slices(offsets, 1 << 20):
            at = offsets[a : b + 1] - offsets[a]
            sums = np.concatenate([[0.0], np.cumsum(self.weights[_trigrams(data[offsets[a] : offsets[b]])], dtype=np.float64), [0.0, 0.0]])
            # The last trigram of a text starts two bytes before its end.
            ends = np.maximum(at[1:] - 2, at[:-1])
            out.append((sums[ends] - sums[at[:-1]]) / np.maximum(np.diff(at), 1))
        text = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(text + squashed(found) @ self.direct + self.bias, -50, 50)))


def squashed(found: np.ndarray) -> np.ndarray:
    """Measures on a like scale: 1 where good, down to -1 where bad."""
    out = np.zeros(found.shape)
    for k, (_, below, least, most, above) in enumerate(LABELLERS):
        x = found[:, k]
        low = np.clip((x - below) / max(least - below, 1e-9), 0, 1) if least > below else np.ones(len(x))
        high = np.clip((above - x) / max(above - most, 1e-9), 0, 1) if np.isfinite(above) and above > most else np.ones(len(x))
        out[:, k] = 2 * np.minimum(low, high) - 1
    return out


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed byte trigrams, in order."""
    text = data.astype(np.uint64)
    code = text[:-2] << np.uint64(16) | text[1:-1] << np.uint64(8) | text[2:]
    return (mix(code + np.uint64(1)) >> np.uint64(64 - HASH_BITS)).astype(np.int32)


@dataclass
class Sample:
    """Trigram counts of the sampled rows, end to end: each row's distinct indices and their shares of its text."""

    index: np.ndarray
    share: np.ndarray
    starts: np.ndarray  # one more entry than rows
    measures: np.ndarray

    def blocks(self, entries: int = 1 << 20) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, indices, shares, row of each entry from 0) of some rows at a time."""
        row = 0
        while row < len(self.starts) - 1:
            end = max(row + 1, int(np.searchsorted(self.starts, self.starts[row] + entries, "right")) - 1)
            a, b = self.starts[row], self.starts[end]
            yield slice(row, end), self.index[a:b], self.share[a:b], np.repeat(np.arange(end - row), np.diff(self.starts[row : end + 1]))
            row = end


def _features(rows: DataFrame) -> Sample:
    """The sampled rows, at most ``SAMPLE`` or what the caller asked for; a row takes two or three bytes a distinct trigram on its way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            found, packed, n = measures(batch.column(0)), [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                counts = np.zeros(1 << HASH_BITS, np.uint32)
                for i in range(a, b, 1 << 20):
                    counts += np.bincount(_trigrams(data[i : min(b, i + (1 << 20) + 2)]), minlength=1 << HASH_BITS).astype(np.uint32)
                used = np.flatnonzero(counts)
                packed.append(zlib.compress(np.diff(used, prepend=0).astype(np.uint32).tobytes() + counts[used].tobytes(), 1))
                n.append(max(b - a, 1))
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), pa.array(n, pa.int64()), lists(found.reshape(-1), np.arange(1, len(found) + 1) * len(LABELLERS), pa.float64())], names=["counts", "n", "measures"])

    got = rows.select("text").mapInArrow(run, "counts binary, n long, measures array<double>").toArrow()
    index, share, sizes = [], [], []
    for packed, n in zip(got.column("counts"), got.column("n").to_pylist(), strict=True):
        own = np.frombuffer(zlib.decompress(packed.as_py()), np.uint32).reshape(2, -1)
        index.append(np.cumsum(own[0]).astype(np.int32))
        share.append((own[1] / n).astype(np.float32))
        sizes.append(own.shape[1])
    whole = [np.concatenate(x) if x else np.zeros(0, t) for x, t in ((index, np.int32), (share, np.float32))]
    found = np.array(got.column("measures").to_pylist(), np.float64).reshape(-1, len(LABELLERS))
    return Sample(*whole, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64), found)


def train(sample: Sample, target: np.ndarray, rounds: int = 80, ridge: float = 1e-4) -> Scorer:
    """Logistic regression on posterior labels, by accelerated gradient steps; trigram shares are scaled by their spread."""
    size, n = 1 << HASH_BITS, len(target)
    total, square = np.zeros(size), np.zeros(size)
    for _, index, share, _ in sample.blocks():
        total += np.bincount(index, share, size)
        square += np.bincount(index, share.astype(np.float64) ** 2, size)
    spread = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0)) + 1e-4
    # As many features count as the rows' entries, not as there are buckets.
    scale = (1 / spread / np.sqrt(max(len(sample.index) / n, 1))).astype(np.float32)
    direct, y = squashed(sample.measures), target.astype(np.float64)
    # The two classes weigh the same, however rare one is.
    side = y / max(y.mean(), 1e-3) + (1 - y) / max(1 - y.mean(), 1e-3)
    norms = (direct * direct).sum(1) + 1
    for rows, index, share, row in sample.blocks():
        norms[rows] += np.bincount(row, (share * scale[index]) ** 2, rows.stop - rows.start)
    step = 4 / float((side * norms).mean() + 1e-9)
    shape = (size, direct.shape[1], 1)
    w = [np.zeros(k) for k in shape]
    v = [x.copy() for x in w]
    for k in range(rounds):
        at = [a + k / (k + 3) * (a - b) for a, b in zip(w, v, strict=True)]
        scaled, grad = (at[0] * scale).astype(np.float32), np.zeros(size)
        base, error = direct @ at[1] + at[2][0], np.zeros(n)
        for rows, index, share, row in sample.blocks():
            z = base[rows] + np.bincount(row, share * scaled[index], rows.stop - rows.start)
            error[rows] = side[rows] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows])
            grad += np.bincount(index, share * error[rows].astype(np.float32)[row], size)
        grads = [grad * scale / n, direct.T @ error / n, np.array([error.mean()])]
        v, w = w, [a - step * (g + ridge * a) for a, g in zip(at, grads, strict=True)]
    return Scorer((w[0] * scale).astype(np.float32), w[1], float(w[2][0]))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """One row per row of ``docs``: doc_id, quality (0 to 1, the scorer's), posterior (the labellers'), kept.

    A document stays if the mean of both is ``keep`` or more. Null text is
    empty; a text without a word has quality and posterior 0 and goes. An empty
    table gives an empty result. Repeated rows are each judged; other columns of
    ``docs`` are not read.
    """
    work = Workspace(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns(found)), pa.array(found[:, 0].astype(np.int64))], names=["doc_id", "pattern", "words"])

    voted = work.keep(source.mapInArrow(measure, "doc_id long, pattern long, words long"), "voted")
    counts = voted.where("words > 0").groupBy("pattern").count().collect()  # 3 ** labellers rows at most
    pattern = np.array([r.pattern for r in counts], np.int64)
    good, _, _ = estimate(pattern, np.array([r["count"] for r in counts], np.float64))
    by_pattern = np.zeros(3 ** len(LABELLERS))
    by_pattern[pattern] = good
    if not len(pattern):
        return voted.select("doc_id", F.lit(0.0).alias("quality"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    # The sample: the documents with the least hash, as many from either side as there are, up to half each.
    side = docs.sparkSession.createDataFrame([(int(p), bool(g >= 0.5)) for p, g in zip(pattern, good, strict=True)], "pattern long, good boolean")
    sided = voted.where("words > 0").join(F.broadcast(side), "pattern").select("doc_id", "good", F.xxhash64("doc_id").alias("h")).where("doc_id is not null")
    ids = None
    for which in (True, False):
        part = sided.where(F.col("good") == which).orderBy("h", "doc_id").limit(sample // 2).select("doc_id")
        ids = part if ids is None else ids.unionByName(part)
    chosen = source.join(F.broadcast(ids.distinct()), "doc_id", "left_semi")
    features = _features(chosen)
    scorer = train(features, by_pattern[patterns(features.measures)]) if len(features.measures) else Scorer(np.zeros(1 << HASH_BITS, np.float32), np.zeros(len(LABELLERS)), 0.0)  # no id
    cast = docs.sparkSession.sparkContext.broadcast((scorer, by_pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, by_pattern = cast.value
        for batch in batches:
            found = measures(batch.column(1))
            some = found[:, 0] > 0
            quality = np.where(some, scorer.score(batch.column(1), found), 0.0)
            posterior = np.where(some, by_pattern[patterns(found)], 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(quality), pa.array(posterior), pa.array(some & ((quality + posterior) / 2 >= keep))], names=["doc_id", "quality", "posterior", "kept"])

    return source.mapInArrow(run, "doc_id long, quality double, posterior double, kept boolean")
