"""The pipeline's rows against the stages' rules, by brute force, and the registered queries."""

import itertools
import random


import corpus_pipeline
from lodeseek.llm import decontaminate, queries
from tests.llm.conftest import prose
from tests.llm.test_dedup import brute_components, normal
from tests.llm.test_tokens import check_packing


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, prose(rng, 30)) for i in range(5)]
    clean = [prose(rng, rng.randrange(30, 120)) for _ in range(60)]
    near = [" ".join(w if k != 7 else "changed" for k, w in enumerate(t.split())) for t in clean[:10]]
    texts = clean + clean[10:20] + near + [prose(rng, 20) + " " + t for _, t in items] + ["123 456", "", None, "..."]
    rng.shuffle(texts)
    rows = [(i, t, "xx" if i % 2 else "yy", "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    # The two languages here are one: what cannot be told goes, whatever it is.
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, docs, str(tmp_path))
    assert known.columns == docs.columns
    lettered = {r.doc_id for r in known.select("doc_id").collect()}
    assert not any(t is None or not any(c.isalpha() for c in t) for i, t, *_ in rows if i in lettered)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [(i, t) for i, t, *_ in rows if i in lettered]
    first = {}
    for i, t in left:
        first.setdefault(normal(t), i)
    left = [(i, t) for i, t in left if first[normal(t)] == i]
    roots = {i: root for i, _, root in brute_components(left, 5, 80)}
    left = [(i, t) for i, t in left if roots[i] == i]
    grams = lambda t: set(itertools.pairwise(t.split()))
    left = [(i, t) for i, t in left if not any(len(grams(t) & grams(x)) > 15 for _, x in items)]
    assert {r.doc_id for r in got} == {i for i, _ in left}
    check_packing(left, got, 2048)


def test_names():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    assert decontaminate.LEAST == 5
