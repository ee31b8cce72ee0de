"""Packing, token store and edit-aware counts against encoding each text as a whole."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodeseek.llm import packing, token_counts, token_store
from lodeseek.llm.shared import CachedEncoder, Workspace

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab AB zZ \n\t éÉÀ Σσς'!1²½ ́  中😀  ﬁI'm's'S't''re'LL İıßſ–—“ŉǅ<|endoftext|>.,;:µªº\r\x1c\x85\xad"


def plain(path):
    found = Tokenizer.from_file(path)
    return lambda texts: [x.ids for x in found.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder(path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 60))) for _ in range(3000)] + [None, ""]
    added = [x.content for x in Tokenizer.from_file(path).get_added_tokens_decoder().values()]
    texts += [f"{a}{x}{b}" for x in [*added, *(x.upper() for x in added)] for a in ("", "a", "a \n\n", "Σ") for b in ("", " b", "\n\n c", added[0])]
    want = plain(path)(texts)
    for capacity in (10**9, 10**4, 0):
        encoder = CachedEncoder(path, capacity)
        assert encoder.kind
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, 500)] == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_sum_of_squares(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    bins, offsets = packing.sum_of_squares(lengths, 50)
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths.tolist(), bins.tolist(), strict=True) if x == b)
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) <= 50
    # No two sequences could be one.
    fill = sorted(np.bincount(bins, lengths).tolist()) if len(lengths) else []
    assert len(fill) < 2 or fill[0] + fill[1] > 50


def test_sum_of_squares_takes_few():
    rng = np.random.default_rng(0)
    lengths = np.sort(rng.integers(1, 2049, 5000))[::-1]
    bins, _ = packing.sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * max(lengths.sum() / 2048, (lengths > 1024).sum())


def check_packing(rows, got, capacity):
    ids = plain(WORD)([t for _, t in rows])
    want = sorted(((d, k, at, len(x[at : at + capacity]), zlib.crc32(np.array(x[at : at + capacity], "<u4").tobytes())) for (d, _), x in zip(rows, [i + [0] for i in ids], strict=True) for k, at in enumerate(range(0, len(x), capacity))), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist() and sum(n for _, n in own) <= capacity
    return len(sequences)


def test_packing(table, odd_rows, near_rows, monkeypatch):
    rows = odd_rows + near_rows
    check_packing(rows, packing.pack_documents(table(rows), WORD).collect(), 2048)
    # Many partitions, then the second round.
    monkeypatch.setattr(packing, "PER_PARTITION", 10)
    few = check_packing(rows, packing.pack_documents(table(rows), WORD, capacity=300).collect(), 300)
    total = sum(len(x) + 1 for x in plain(WORD)([t for _, t in rows]))
    assert few <= 1.15 * total / 300 + 2
    assert packing.pack_documents(table([]), WORD).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1) | st.integers(0, 5000), max_size=700))
def test_elias_fano(values):
    values.sort()
    # The unary part takes a bit a step of the width: keep it small.
    made = token_store.EliasFano.encode(np.array(values, np.uint64))
    read, end = token_store.EliasFano.from_bytes(memoryview(b"xy" + made.to_bytes()), 2)
    assert end == 2 + len(made.to_bytes())
    assert read.values().tolist() == values
    for i in range(0, len(values), 13):
        assert read.select(i) == values[i]
    with pytest.raises(IndexError):
        read.select(len(values))


def test_elias_fano_is_small():
    made = token_store.EliasFano.encode(np.cumsum(np.random.default_rng(1).integers(1, 2000, 4096)))
    assert len(made.to_bytes()) * 8 < 4096 * 13


def test_token_store(spark, table, odd_rows, near_rows, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_DOCS", 7)
    rows = odd_rows + near_rows
    path = Workspace(spark).path("tokens")
    token_store.write_tokens(table(rows), path, BYTE)
    got = token_store.read_tokens(spark, path, with_ids=True).collect()
    ids = [x + [0] for x in plain(BYTE)([t for _, t in rows])]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    at, want = 0, []
    for i in order:
        raw = np.array(ids[i], "<u4").tobytes()
        want.append((rows[i][0], at, len(ids[i]), zlib.crc32(raw), raw))
        at += len(ids[i])
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got), key=lambda x: x[1]) == want
    # Looked up on their own.
    some = [x for x in sorted({i for i, _ in rows if i is not None})[::7]] + [9, 5, -1, 2**61]
    found = sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_store.fetch(spark, path, some).collect())
    assert found == sorted((i, n, raw) for i, _, n, _, raw in want if i in some)
    assert token_store.fetch(spark, path, []).count() == 0
    empty = Workspace(spark).path("tokens")
    token_store.write_tokens(table([]), empty, BYTE)
    assert token_store.fetch(spark, empty, [1]).count() == 0
    assert token_store.read_tokens(spark, empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(ALPHABET, max_size=400), st.lists(st.tuples(st.integers(-2, 420), st.integers(-1, 60), st.text(ALPHABET, max_size=40)), max_size=6))
def test_edits(text, edits):
    encode = plain(BYTE)
    count = lambda t: len(encode([t])[0])
    leaves = token_counts.cut(text, 16)
    assert "".join(leaves) == text
    tree = token_counts.CountTree.of(list(map(len, leaves)), [count(x) for x in leaves])
    assert tree.total == count(text)
    for k, (at, remove, insert) in enumerate(edits):
        begin = min(max(at, 0), len(text))
        want = text[:begin] + insert + text[min(begin + max(remove, 0), len(text)) :]
        text = tree.edit(text, at, remove, insert)
        assert text == want and tree.chars[0] == len(text)
        if k % 2:  # several edits may wait for their counts
            tree.settle([count(x) for x in tree.missing()])
            assert tree.total == count(text)
    tree.settle([count(x) for x in tree.missing()])
    kept = tree.stored()
    at = 0
    for leaf, _ in kept.leaves():
        assert kept.tokens[leaf] == count(text[at : at + kept.chars[leaf]])
        at += kept.chars[leaf]
    assert at == len(text) and kept.total == count(text)
    for node, right in enumerate(kept.right):
        if right:
            assert kept.tokens[node] == kept.tokens[node + 1] + kept.tokens[right] and kept.chars[node] == kept.chars[node + 1] + kept.chars[right]


def test_edits_change_few_sums():
    """An edit costs the sums above its leaf, in a small and in a large tree, also after very many at one place."""
    encode = plain(BYTE)
    count = lambda t: len(encode([t])[0])
    costs = []
    for n in (100, 10_000):
        text = "some words " * (n * token_counts.LEAF // 11)
        leaves = token_counts.cut(text)
        tree = token_counts.CountTree.of(list(map(len, leaves)), [len(x) // 5 for x in leaves])
        for k in range(50):
            text = tree.edit(text, k * len(text) // 50, 3, "new")
        tree.settle([len(x) // 5 for x in tree.missing()])
        costs.append(tree.touched / 50)
        assert tree.encoded < 50 * 3 * token_counts.LEAF
    assert costs[0] < 2.2 * 10 and costs[1] < 2.2 * 16
    tree, text = token_counts.CountTree.of([], []), ""
    for k in range(3000):
        text = tree.edit(text, len(text), 0, f"{k} more words at the end of the text ")
    tree.settle([count(x) for x in tree.missing()])
    assert tree.total == count(text) and tree.touched < 3000 * 60 and max(len(p) for _, p in tree.leaves()) < 50


def test_edited_table(spark, table, odd_rows):
    edits = spark.createDataFrame([(9, 1, 10, 5, "new words"), (9, 0, 0, 0, "first "), (2, 0, 5, 5, None), (99, 0, 0, 0, "x"), (5, 0, 1, 1, "é")], "doc_id long, seq int, at int, remove int, insert string")
    got = token_counts.count_edited(table(odd_rows), edits, BYTE).collect()
    texts = []
    for i, t in odd_rows:
        after = t or ""
        if i == 9:
            after = "first " + after
            after = after[:10] + "new words" + after[15:]
        if i == 5:
            after = after[:1] + "é" + after[2:]
        texts.append((i, t, after))
    before, after = plain(BYTE)([t for _, t, _ in texts]), plain(BYTE)([a for _, _, a in texts])
    want = sorted(((i, len(b), len(a)) for (i, _, _), b, a in zip(texts, before, after, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.n_tokens_after) for r in got), key=str) == want
    long = next(r for r in got if r.doc_id == 9)
    assert long.chars_encoded < 3000  # of 400,000
    assert token_counts.count_edited(table([]), edits, BYTE).count() == 0
