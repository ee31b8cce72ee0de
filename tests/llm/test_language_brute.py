"""Language identification against plain counting and decoding."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodeseek.llm import language_id as li

MASK = (1 << 64) - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_grams(text):
    """Buckets of all n-grams of a text between spaces, one for each place and order."""
    raw = bytes(32 if b < 128 and not chr(b).isalpha() else b for b in text.lower().encode())
    padded = b"   " + raw + b"        "
    return [mixed(int.from_bytes(padded[at : at + n], "big") + (n << 40) & MASK) >> 48 for n in (2, 3, 4) for at in range(len(raw) + 4)]


def test_model_and_answers_equal_plain_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").where("length(text) < 3000")
    model = li.fit(rows, per_language=25)
    h = F.xxhash64("doc_id")
    half = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 0
    known = [r for r in rows.where("text is not null and lang is not null").select("doc_id", "text", "lang", h.alias("h"), half.alias("half")).collect()]
    languages = sorted({r.lang for r in known})
    assert model.languages == languages and len(languages) > 2
    chosen = [r for x in languages for r in sorted((r for r in known if r.lang == x), key=lambda r: (r.h, r.doc_id))[:25]]
    counts = {x: Counter() for x in languages}
    for r in chosen:
        if r.half:
            counts[r.lang].update(plain_grams(r.text))
    code = [[1 if k >> i & 1 else -1 for k in range(1, 2 ** (len(languages) - 1))] for i in range(len(languages))]
    assert model.code.tolist() == code
    size = {x: sum(c.values()) + 0.5 * 65536 for x, c in counts.items()}
    weights = []
    for bit in range(len(code[0])):
        sides = {s: [x for i, x in enumerate(languages) if code[i][bit] == s] for s in (1, -1)}
        mean = lambda g, side: sum((counts[x][g] + 0.5) / size[x] for x in side) / len(side)
        weights.append([round((math.log(mean(g, sides[1])) - math.log(mean(g, sides[-1]))) * 65536) for g in range(65536)])
    assert np.abs(np.array(weights) - model.weights).max() <= 1  # halves may round either way
    texts = [*(r.text for r in known[:60]), "", None, "12 34", "ß", "Straße und Haus", "x" * 5000]
    got = li.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for text, r in zip(texts, got, strict=True):
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0.0, False)
            continue
        grams = plain_grams(text)
        z = [sum(int(model.weights[b][g]) for g in grams) / (len(grams) * 65536) * model.scale[b] + model.shift[b] for b in range(len(model.scale))]
        losses = [sum(model.trust[b] * math.log1p(math.exp(-z[b] * code[i][b])) for b in range(len(z))) for i in range(len(languages))]
        best = min(range(len(languages)), key=losses.__getitem__)
        gap = sorted(losses)[1] - losses[best]
        assert r.lang_pred == languages[best] and abs(r.score - 1 / sum(math.exp(losses[best] - x) for x in losses)) < 1e-9
        assert abs(r.margin - gap) < 1e-9 and r.ambiguous == (gap < li.AMBIGUOUS)
