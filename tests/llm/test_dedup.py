"""Exact dedup and n-gram Jaccard join against brute force."""

import hashlib
import itertools
import re
from collections import defaultdict

import pytest

from lodeseek.llm import components, exact_dedup, jaccard_join
from lodeseek.llm.shared import Workspace


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for i, t in rows:
        ids = groups[normal(t)]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("prime", [exact_dedup.PRIME, 13])
def test_exact(table, odd_rows, near_rows, prime):
    """With a tiny modulus nearly all fingerprints collide, and the comparison has to split the groups."""
    rows = odd_rows + [r for r in near_rows if r[0] > 12]
    got = exact_dedup.exact_dedup(table(rows), prime=prime).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_exact_in_parallel(table, odd_rows, near_rows, monkeypatch):
    """Texts of which the chunks are hashed by several tasks, with characters of several bytes where chunks meet."""
    monkeypatch.setattr(exact_dedup, "HUGE", 300)
    long = "é\t \n中 😀" * 40_000
    rows = odd_rows + near_rows[:40] + [(500, long), (501, long.replace("\t \n", " ")), (501, long), (502, long + "x"), (None, long)]
    got = exact_dedup.exact_dedup(table(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute_exact(rows)


def test_exact_empty(table):
    assert exact_dedup.exact_dedup(table([])).count() == 0


def test_drop_duplicates(table, odd_rows):
    df = table(odd_rows)
    got = exact_dedup.drop_duplicates(df)
    assert got.columns == df.columns
    kept = sorted(((r.doc_id, normal(r.text)) for r in got.collect()), key=str)
    least = {}
    for i, t in odd_rows:
        n = normal(t)
        least[n] = i if n not in least or least[n] is None or (i is not None and i < least[n]) else least[n]
    assert kept == sorted(((i, n) for n, i in least.items()), key=str)


def test_fingerprints_compose():
    f = exact_dedup.Fingerprint(chunk=7)
    data = bytes(range(256)) * 3
    whole = f.of(data)
    for cut in (0, 1, 6, 7, 100, 767, 768):
        assert f.combine(f.of(data[:cut]), f.of(data[cut:])) == whole
    assert exact_dedup.Fingerprint().of(data) == whole
    assert f.of(b"\0") != f.of(b"\0\0")


def test_long_texts_that_differ_late(table):
    a = "x" * (3 * exact_dedup.CHUNK)
    rows = [(1, a), (2, a + "y"), (3, a), (4, a[:-1] + "z")]
    got = {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(table(rows), prime=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4}


def brute_components(rows, k, percent):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = min(k, len(words))
        return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 50), (1, 100)])
def test_jaccard(table, near_rows, k, percent):
    got = jaccard_join.jaccard_components(table(near_rows), k, percent).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(near_rows, k, percent)


def test_jaccard_long_lists_and_rounds(table, near_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 2)
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0.0)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    got = jaccard_join.jaccard_components(table(near_rows), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(near_rows, 3, 90)


def test_jaccard_odd_rows(table, odd_rows):
    got = jaccard_join.jaccard_components(table(odd_rows), 3, 90).collect()
    assert sorted(map(tuple, got), key=str) == brute_components(odd_rows, 3, 90)
    assert jaccard_join.jaccard_components(table([]), 3, 90).count() == 0


def test_keep_one(table, near_rows):
    df = table(near_rows)
    got = jaccard_join.keep_one(df)
    assert got.columns == df.columns
    assert {r.doc_id for r in got.collect()} == {root for _, _, root in brute_components(near_rows, 5, 80)}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100 + i, 99) for i in range(20)] + [(7, 7), (200, 200), (None, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in components.components(df, Workspace(spark)).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 99 for i in range(99, 120)} | {200: 200}
    assert components.components(df.limit(0), Workspace(spark)).count() == 0
