"""What the third round's findings showed: small inputs on which results were wrong, or work grew."""

import random

import pytest
from pyspark.sql import functions as F

from lodeseek import catalogue
from lodeseek.functions import text as tx
from lodeseek.operators import history, telemetry
from lodeseek.streaming import live


def test_snippet_keeps_spaces_beside_line_feeds(spark):
    texts = ["\n a b\n", "a \n", "\t\n  a\n\n b \t", " a ", "\n\t", " \n a", " a\n", "\na "]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.snippet(F.col("t")).alias("s"))
    want = [" ".join(x for x in t.replace("\t", "\n").split("\n") if x) for t in texts]
    assert [r.s for r in rows.orderBy("i").collect()] == want


@pytest.mark.parametrize("last", ["\u00fcber die Stra\u00dfe", "\u00dcBER DIE STRASSE", "zum Fu\u00df"])
def test_history_edits_finds_queries_that_upper_case_changes(spark, tmp_path, last):
    rows = [(1, 0, "alpha"), (2, 0, "beta\nmore"), (3, 0, last)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.query, r.bookmarked) for r in catalogue.history_edits(spark, str(tmp_path)).collect()}
    assert got == {("beta", False), (last, True)}


def test_collapse_is_the_same_over_many_ranges_and_makes_no_row_a_beginning(spark):
    rng = random.Random(3)
    queries = {"".join(rng.choice("ab\u00e4") for _ in range(rng.randrange(9))) for _ in range(700)} | {"a" * 3000, "a" * 2999, "A" * 20 + "b"}
    rows = [(q, rng.random() < 0.2, rng.choice([None, *range(8)])) for q in queries] + [(None, False, 1)]
    goes_on = lambda q, u: any(v is not None and v >= u and x != q and x.lower().startswith(q.lower()) for x, _, v in rows if x is not None)
    want = {(q, u) for q, b, u in rows if b or q is None or u is None or len(q) < 2 or not goes_on(q, u)}
    items = spark.createDataFrame(rows, "query string, bookmarked boolean, last_used long")
    for n in ("1", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = history.collapse(items)
            assert sorted(found.collect(), key=str) == sorted((x for x in items.collect() if (x.query, x.last_used) in want), key=str)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        plan = found._jdf.queryExecution().toString()
        assert "Generate" not in plan


def test_rate_limit_keeps_few_states_however_many_addresses(spark, tmp_path):
    posts = spark.range(900).select(F.col("id").alias("run_id"), F.concat(F.lit("a"), F.col("id") % 300).alias("ip_hash"), (F.col("id") + 7_200_000).alias("created_at"), F.timestamp_millis(F.col("id") + 7_200_000).alias("ts"))
    got = {}
    for part in range(2):
        posts.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
        query = live.accepted(spark.readStream.schema(posts.schema).parquet(f"{tmp_path}/in"), 2).writeStream.option("checkpointLocation", f"{tmp_path}/progress").outputMode("update")
        query.foreachBatch(lambda b, n: got.update({r.run_id: r.allowed for r in b.collect()})).trigger(availableNow=True).start().awaitTermination()
    # Of each address two of its three posts: the even ids come first.
    want = {}
    for i in [*range(0, 900, 2), *range(1, 900, 2)]:
        want[i] = sum(want[j] for j in want if j % 300 == i % 300) < 2
    assert got == want
    state = spark.read.format("statestore").option("path", f"{tmp_path}/progress").option("stateVarName", "count").load()
    assert state.count() <= 16


def test_medians_write_digits_and_not_values(spark, tmp_path, monkeypatch):
    values = [2.0 ** (i / 100) for i in range(-10_000, 10_001)]
    rows = spark.createDataFrame([(i % 2, v) for i, v in enumerate(values)], "g int, v double")
    monkeypatch.setattr(telemetry, "shared_folder", lambda _: f"file://{tmp_path}/work")
    found = {(r.gid, r.g): r.v for r in telemetry.medians(rows, ["g"], ["v"], [["g"], []]).collect()}
    assert found == {(0, 0): values[10_000], (0, 1): (values[9_999] + values[10_001]) / 2, (1, None): values[10_000]}
    held = [spark.read.parquet(str(p)).count() for p in tmp_path.glob("*/*") if p.name != "keyed"]
    assert max(held) < 12_000
