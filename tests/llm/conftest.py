"""Small document tables for the operators."""

import random

import pytest

WORDS = "der die und the of and les des que por para con alpha beta gamma delta omega zeta run fox tree stone".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and white texts, ties, repeated rows, one long text, ids that are null, negative or far apart."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (6, "One  two\tthree"), (7, "one two three"), (8, " one two three"),
        (None, "a text without an id"), (None, None), (-3, "one two three"), (2**62, long), (9, long), (10, long + " end"), (11, "ß中😀 ́ x"),
    ]


@pytest.fixture(scope="session")
def near_rows():
    """Families of near copies around bases, chains of edits, copies, and unrelated texts, some with a passage in common."""
    rng = random.Random(11)
    rows, passage = [], prose(rng, 40)
    for family in range(6):
        base = prose(rng, 90).split()
        for k in range([30, 12, 8, 5, 3, 1][family]):
            words = list(base)
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
            rows.append(" ".join(words))
            if k % 3 == 0:
                rows.append(" ".join(words).upper())
    chain = prose(rng, 80).split()
    for _ in range(15):
        chain[rng.randrange(len(chain))] = f"step{rng.randrange(1000)}"
        rows.append(" ".join(chain))
    rows += [prose(rng, rng.randrange(1, 30)) + " " + passage for _ in range(25)]
    rows += [prose(rng, rng.randrange(0, 8)) for _ in range(25)] + ["", None, "x", "x y", "x y", "x y z"]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.fixture
def table(spark):
    """A table of (doc_id, text), with a further column that no operator must touch."""

    def make(rows, parts=3):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        return df.withColumn("n_shingles", F.lit("clash")).withColumn("row", F.lit(1)).withColumn("b", F.lit(None).cast("int"))

    return make
