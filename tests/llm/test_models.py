"""Whitening, lattice scores and importance resampling, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import importance, lattice, lm_scoring, queries, whitening, word_blocks

VECTORS = "vec_id long, embedding array<float>, component string, vec int"
DOCS = "doc_id long, text string, block string, flag int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], VECTORS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


# Whitening.


@pytest.fixture(scope="module")
def some_vectors():
    rng = np.random.default_rng(3)
    found = rng.normal(size=(700, 40)) @ rng.normal(size=(40, 40))
    return [(int(i), [float(np.float32(x)) for x in row]) for i, row in enumerate(found)]


def test_whitening_equals_numpy(spark, some_vectors, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    odd = [(1000, None), (1001, [float("nan")] * 40), (1002, [float("inf")] + [0.0] * 39), (1003, [None] + [0.0] * 39), (1004, [1.0] * 39), (1005, []), (None, some_vectors[0][1]), (5, some_vectors[5][1])]
    rows = whitening.components_of(vectors(spark, some_vectors + odd).repartition(7)).collect()
    kept = [*some_vectors, (None, some_vectors[0][1]), (5, some_vectors[5][1])]
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert {r.n for r in rows} == {n} and len(rows) == n * 32
    assert max(r.identity_error for r in rows) < 1e-9
    found = {}
    for r in rows:
        found.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    deviations = ((n * x - sums) ** 2).sum(1).tolist()
    signs = None
    for (i, _), d, c in zip(kept, deviations, centred, strict=True):
        own = np.array([found[i, d][k + 1][0] for k in range(32)])
        want = c @ axes[:, :32] / np.sqrt(values[:32])
        signs = np.sign(own * want) if signs is None else signs
        assert np.allclose(own, want * signs, atol=1e-7)


def test_tiles_do_not_change_the_covariance(spark, some_vectors):
    rows = whitening.usable(vectors(spark, some_vectors))
    n, sums = whitening.dimension_sums(rows, 40)

    def centre(x, at):
        return whitening.Whitening(n, sums[at : at + x.shape[1]]).centred(x)

    one, many = (whitening.covariance(rows, 40, n, lambda x: x, 40, centre, tile) for tile in (40, 7))
    assert np.allclose(one, many, rtol=1e-12)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [0.5])]])
def test_whitening_without_components(spark, rows):
    assert whitening.components_of(vectors(spark, rows)).collect() == []


def test_whitening_leaves_out_empty_directions(spark):
    rng = random.Random(1)
    rows = [(i, [a := rng.random(), 2 * a, rng.random(), 7.0]) for i in range(200)]
    rows = [(i, [float(np.float32(round(c * 64) / 64)) for c in v]) for i, v in rows]
    found = whitening.components_of(vectors(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2} or {r.component for r in found} == {1, 2, 3}
    assert found[0].identity_error < 1e-6


def test_large_deviations_are_exact():
    model = whitening.Whitening(10**9, [10**15, 3])
    x = np.array([[1_000_100, 5], [1 << 30, 0]])
    assert model.deviations(x) == [sum((10**9 * int(c) - s) ** 2 for c, s in zip(row, model.sums, strict=True)) for row in x]


# Lattice scores.


def segmentations(word):
    return [[word]] + [[word[:k], *rest] for k in range(1, len(word)) for rest in segmentations(word[k:])]


def small_lattice():
    pieces = [b"", *(bytes([b]) for b in range(256)), b" a", b"ab", b"aba", b" ab", b"ba", b" abab", "é".encode(), b"bb"]
    weights = np.log(np.random.default_rng(2).dirichlet(np.ones(len(pieces))))
    return pieces, weights


def test_forward_is_the_sum_over_all_segmentations():
    pieces, logp = small_lattice()
    known, tool = dict(zip(pieces, logp, strict=True)), lattice.Lattice(pieces)
    words = [b"a", b"abab", b"babab", "éaé".encode(), b"abbab", b"x", b"aaaa", b"ab" * 5]
    for word, found in zip(words, tool.forward(words, logp), strict=True):
        want = sum(math.exp(sum(known[p] for p in s)) for s in segmentations(b" " + word) if all(p in known for p in s))
        assert found == pytest.approx(math.log(want), rel=1e-12)


def test_expected_pieces_are_those_of_all_segmentations():
    pieces, logp = small_lattice()
    known, tool = dict(zip(pieces, logp, strict=True)), lattice.Lattice(pieces)
    words, weights = [b"abab", b"babb", b"abab"], np.array([2.0, 1.0, 0.5])
    want = Counter()
    for word, w in zip(words, weights, strict=True):
        paths = [(s, math.exp(sum(known[p] for p in s))) for s in segmentations(b" " + word) if all(p in known for p in s)]
        total = sum(p for _, p in paths)
        for s, p in paths:
            for piece in s:
                want[piece] += w * p / total
    found = tool.expected(words, weights, logp)
    assert {p: found[i] for i, p in enumerate(pieces) if found[i] > 0} == pytest.approx(dict(want))


def test_a_very_long_word_and_all_lengths_at_once():
    pieces, logp = small_lattice()
    tool = lattice.Lattice(pieces)
    words = [b"ab" * 20_000, b"", b"b", b"ab" * 3]
    together = tool.forward(words, logp)
    assert together.tolist() == pytest.approx([tool.forward([w], logp)[0] for w in words])


def test_vocabulary_is_a_distribution():
    pieces, logp = lattice.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    assert np.exp(logp).sum() == pytest.approx(1) and len(set(pieces)) == len(pieces)
    assert all(len(p) == 1 for p in pieces[1:257]) and all(p == p.lower() and b" " not in p[1:] for p in pieces[257:])


def scored(spark, rows, learn):
    found, model = lm_scoring.score(documents(spark, rows).repartition(5), learn, public_tokenizers.path("piece_bpe_32k.model"))
    return found.collect(), model


def test_scores_equal_brute_force(spark, odd_rows):
    rows = odd_rows + [(k, f"new{k} one two ABC Straße {k % 3}") for k in range(100, 160)]
    learn = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    found, model = scored(spark, rows, learn)
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for i, t in enumerate(x for _, x in rows)}
    counts, ends = Counter(), 0
    for k, (i, _) in enumerate(rows):
        if i is None or i % 3 != 0:
            counts.update(tokens[k])
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert (model.tokens, model.distinct, model.ends) == (n, v, ends)
    tool, logs = lattice.Lattice(model.pieces), {}
    words = sorted({w for x in tokens.values() for w in x})
    for w, log in zip(words, tool.forward(words, model.logp), strict=True):
        logs[w] = log
    want = []
    spelled = v / (n + v)
    for k, (i, _) in enumerate(rows):
        own = tokens[k]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own) + math.log10((ends + 1) / (n + v + 1))
        score = sum(math.log10((1 - spelled) * counts[w] / n + spelled * math.exp(logs[w])) for w in own) + math.log10((1 - spelled) * ends / n + spelled * math.exp(model.logp[0]))
        want.append((str(i), i is None or i % 3 != 0, len(own) + 1, sum(counts[w] > 0 for w in own) + 1, round(base, 4), round(score, 4)))
    assert sorted((str(r.doc_id), r.learned, r.n_tokens, r.n_known, round(r.base_score, 4), round(r.score, 4)) for r in found) == sorted(want)


def test_scores_without_anything_to_learn_and_without_rows(spark):
    found, model = scored(spark, [(1, "some words"), (2, None)], F.lit(False))
    assert model.tokens == 0 and all(r.base_score == 0 and r.score < 0 and r.n_known == 0 and r.score == pytest.approx(r.spelled_score) for r in found)
    assert scored(spark, [], F.lit(True))[0] == []


def test_probabilities_add_up_to_one_at_most(spark):
    found, model = scored(spark, [(1, "a b a"), (2, "b c")], F.lit(True))
    assert np.exp(model.logp).sum() == pytest.approx(1)
    counts = np.array([2.0, 2.0, 1.0])
    known = np.exp(model.word_logs(lattice.Lattice(model.pieces).forward([b"a", b"b", b"c"], model.logp), counts)).sum()
    assert known + np.exp(model.word_logs(model.logp[:1], np.array([2.0])))[0] < 1


def test_learned_words_cost_less_than_invented_ones(spark):
    prose = "the cat sat on the mat and the dog lay on the rug "
    found, _ = scored(spark, [(1, prose * 20), (2, "the dog sat on the mat"), (3, "zqx dgo xxq no hte tqm")], F.col("doc_id") == 1)
    by = {r.doc_id: r.score for r in found}
    assert by[2] > by[3] + 5


# Importance resampling.


def brute_resampling(rows, target, seed, percent, longest=1, buckets=10_000, least=20):
    def runs(text):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(word_blocks.WORDS))
        return len(words), [b" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(zlib.crc32(x) % buckets for x in runs(text)[1])
    for text in target:
        t.update(zlib.crc32(x) % buckets for x in runs(text)[1])
    S, T, out = sum(s.values()), sum(t.values()), []
    for i, text in rows:
        n, own = runs(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in (zlib.crc32(x) % buckets for x in own)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    drawn = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0]))
    ranks = {id(x): k for k, x in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return [(*x, ranks.get(id(x))) for x in out]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_brute_force(spark, odd_rows, longest, monkeypatch):
    monkeypatch.setattr(word_blocks, "BLOCK_BYTES", 3000)
    rng = random.Random(7)
    rows = [x for x in odd_rows if x != (5, "one")] + [(k, " ".join(rng.choice("alpha beta-gamma Δέλτα x1 the_of İx ".split()) for _ in range(rng.randrange(60)))) for k in range(100, 400)]
    target = [None, "", "alpha beta gamma one two three", "the of the of " * 10]
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    found = importance.resample(documents(spark, rows).repartition(6), bench, seed=2024, percent=30, longest=longest).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, brute_resampling(rows, target, 2024, 30, longest)))


def test_resampling_of_empty_tables_and_repeats(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(documents(spark, []), bench, 1, 50).collect() == []
    rows = [(1, "word " * 30), (1, "word " * 30), (2, "other " * 30), (3, "few words")]
    found = importance.resample(documents(spark, rows), bench, 1, 50).collect()
    assert len(found) == 4 and sorted(r.rank for r in found if r["rank"]) == [1] and next(r for r in found if r.doc_id == 3)["rank"] is None


def test_long_texts_are_cut_at_white_space_only(monkeypatch):
    monkeypatch.setattr(word_blocks, "_SEGMENT", 10)
    words = [b"w%d" % k * (1 + k % 9) for k in range(500)]
    assert [w for part in word_blocks._segments(b" ".join(words)) for w in part] == words


def test_registered_queries_on_a_small_table(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    found = queries.op12_lm_scoring(spark, d).collect()
    assert len(found) == n and all(r.score < 0 and r.n_known <= r.n_tokens for r in found) and len({r.train_tokens for r in found}) == 1
    assert max(r.identity_error for r in queries.op11_whitening(spark, d).collect()) <= 1e-4
    assert queries.op13_importance(spark, d).count() == n
