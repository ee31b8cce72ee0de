"""Frequent seeds, long items, repeated rows and clashing columns."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm import decontaminate, exact_dedup, packing, queries, token_store
from lodeseek.llm.shared import Workspace


def words(rng, n, pool=4000):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def brute_leaks(docs, items, threshold=0.5, least=5):
    out = set()
    for d, text in docs:
        for i, item in items:
            own, pattern = text.lower().split(), item.lower().split()
            number = {w: k for k, w in enumerate(dict.fromkeys(own + pattern), 1)}
            a, b = (np.array([number[w] for w in x], np.uint64) for x in (own, pattern))
            if sum(n for *_, n in decontaminate.tiles(a, b, min(least, len(b)))) / len(b) >= threshold:
                out.add((d, i))
    return out


def test_a_phrase_that_all_share_brings_no_pairs(spark, monkeypatch):
    rng, phrase = random.Random(4), "this phrase of seven words is everywhere"
    docs = [(k, " ".join([*words(rng, 20), phrase, *words(rng, 20)])) for k in range(300)]
    items = [(k, " ".join([*words(rng, 12), phrase, *words(rng, 12)])) for k in range(60)]
    docs += [(1000, items[3][1]), (1001, " ".join([*words(rng, 9), *items[7][1].split()[6:30]])), (1002, " ".join([*items[9][1].split()[19:], *words(rng, 3), *items[9][1].split()[:19]]))]
    made = {}
    keep = Workspace.keep
    monkeypatch.setattr(Workspace, "keep", lambda self, df, name: made.setdefault(name, keep(self, df, name)))
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == brute_leaks(docs, items) and {(1000, 3), (1001, 7), (1002, 9)} <= found
    assert made["met"].count() < 500  # 18,000 pairs share the phrase


def test_leaks_of_frequent_seeds_alone(spark):
    """Items whose seeds are all frequent, nested items, and documents near the threshold on either side."""
    rng = random.Random(8)
    passages = [words(rng, 12, 60) for _ in range(5)]
    items = [(k, " ".join(sum((rng.choice(passages)[: rng.randrange(3, 12)] for _ in range(3)), []))) for k in range(25)] + [(90, "one two"), (91, "w1")]
    docs = [(k, " ".join(sum((rng.choice(passages)[rng.randrange(4) :] for _ in range(rng.randrange(1, 5))), []) + ["one", "two"] * (k % 3 == 0))) for k in range(80)]
    found = decontaminate.leaked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == brute_leaks(docs, items)


def test_a_very_long_document_holds_a_very_long_item():
    rng = np.random.default_rng(1)
    item = rng.integers(1, 1 << 60, 60_000).astype(np.uint64)
    text = np.concatenate([rng.integers(1, 1 << 60, 90_000).astype(np.uint64), item[30_000:], item[:30_000]])
    began = time.time()
    found = decontaminate.tiles(text, item)
    assert [n for *_, n in found] == [30_000, 30_000] and time.time() - began < 20


def test_edits_do_not_depend_on_the_order_of_rows(spark):
    rows = [(1, "a" * 600), (1, "b" * 60), (2, "c" * 50), (3, None)]
    found = [sorted(map(tuple, queries.edit_script(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).collect())) for x in (rows, rows[::-1])]
    assert found[0] == found[1] and [x[2] for x in found[0]] == [20, 30, 45, 16, 25, 37]


def test_which_of_repeated_rows_stays(spark):
    rows = [(1, "a  b", "x", 1), (1, "a b", "z", 2), (1, "a\tb", "y", 3), (1, "a\tb", "y", 3), (2, "a b", "w", 4), (3, None, "n", 5), (3, None, "m", 6)]
    schema = "doc_id long, text string, row string, sha_0 int"
    found = [sorted(map(str, exact_dedup.drop_duplicates(spark.createDataFrame(x, schema).repartition(n)).collect())) for x, n in ((rows, 1), (rows[::-1], 3))]
    assert found[0] == found[1] and len(found[0]) == 2 and "a\\tb" in found[0][0]


def test_packing_keeps_columns_of_any_name(spark):
    names = ["bin", "place", "unit", "fill", "__unit", "__other3", "sequence_id"]
    pieces = spark.createDataFrame([(k, 0, 1 + k % 9, *[f"{n}{k}" for n in names]) for k in range(60)], "doc_id long, piece int, length long, " + ", ".join(f"{n} string" for n in names))
    found = packing.pack(pieces, 10)
    assert found.columns == ["doc_id", "piece", "length", *names[:-1], "sequence_id", "offset"]
    rows = found.collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names[:-1]) and len(rows) == 60
    assert max(r.length for r in found.groupBy("sequence_id").agg(F.sum("length").alias("length")).collect()) <= 10


def test_shards_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 10)
    monkeypatch.setattr(token_store, "MOST_SHARDS", 12)
    docs = spark.createDataFrame([(k, "some words " * (k % 5)) for k in range(200)], "doc_id long, text string")
    path = Workspace(spark).path("tokens")
    import public_tokenizers

    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    assert spark.read.parquet(path).select("shard").distinct().count() <= 12
    rows = token_store.read_tokens(spark, path).orderBy("doc_id").collect()
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])])[:-1].tolist()


def test_pairs_with_too_few_shared_prefix_shingles_are_not_verified(spark):
    from lodeseek.llm import jaccard_join

    heads = {1: ([10, 20, 30], 2), 2: ([10, 20, 40], 3), 3: ([10, 50], 2), 4: ([10, 20, 30], 1)}
    shared = spark.createDataFrame([(d, t, l) for d, (tokens, l) in heads.items() for t in tokens], "doc_id long, token long, l int")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 4), (3, 4), (2, 3)], "a long, b long")
    assert sorted(map(tuple, jaccard_join._matched(pairs, shared, Workspace(spark)).collect())) == [(1, 2), (1, 4), (3, 4)]


def test_clean_does_not_depend_on_how_many_leak(spark, monkeypatch):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, 20))) for k in range(5)]
    docs = spark.createDataFrame([(k if k % 4 else None, items[k % 5][1] if k % 3 == 0 else " ".join(words(rng, 30)), k) for k in range(60)] + [(7, None, 60)], "doc_id long, text string, row long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = []
    for few in (10**6, 0):
        monkeypatch.setattr(decontaminate, "FEW", few)
        found.append(sorted(r.row for r in decontaminate.clean(docs, bench).collect()))
    assert found[0] == found[1] == [k for k in range(61) if k % 3 or k == 60]
