"""Stateful streams, figures of passes, and table functions."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodeseek.functions import embed, tables, text
from lodeseek.operators import search, telemetry
from lodeseek.plans import index_pass
from lodeseek.plans.progress import BatchEvents, Progress
from lodeseek.sources import changes
from lodeseek.sources.store import Store
from lodeseek.streaming import live

POSTS = "run_id long, ip_hash string, created_at long, ts timestamp"
COUNTS = "path string, kind string, ext string, chunks long, seq long"


def parts(spark, tmp_path, batches, schema, run):
    """Each batch is appended to a folder, and the query run from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(2).write.mode("append").parquet(f"file://{tmp_path}/in")
        run(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")).awaitTermination()


def test_posts_are_decided_as_they_come(spark, tmp_path):
    rng = random.Random(6)
    posts = sorted((rng.randrange(5 * 3_600_000), k) for k in range(300))
    rows = [(k, "hot" if rng.random() < 0.6 else f"a{k % 5}", at) for at, k in posts]
    full = [(k, who, at, None) for k, who, at in rows]
    withts = spark.createDataFrame(full, POSTS).withColumn("ts", F.timestamp_millis("created_at"))
    rows = [tuple(r) for r in withts.orderBy("created_at", "run_id").collect()]
    got = {}

    def told(batch, n):
        for r in batch.collect():
            assert r.run_id not in got
            got[r.run_id] = r.allowed

    def run(stream):
        return live.accepted(stream, 4).writeStream.option("checkpointLocation", f"file://{tmp_path}/progress").outputMode("update").foreachBatch(told).trigger(availableNow=True).start()

    parts(spark, tmp_path, [rows[:90], rows[90:95], rows[95:]], POSTS, run)
    want = {r.run_id: r.allowed for r in telemetry.limited(withts, 4).collect()}
    assert got == want and Counter(got.values())[False] > 50


def test_an_hour_is_forgotten_after_it(spark, tmp_path):
    rows = [(1, "a", 0, None), (2, "a", 1, None), (3, "a", 20 * 3_600_000, None)]
    with_ts = [(k, who, at, __import__("datetime").datetime.fromtimestamp(at / 1000, __import__("datetime").UTC).replace(tzinfo=None)) for k, who, at, _ in rows]
    kept = []

    def run(stream):
        query = live.accepted(stream, 1).writeStream.option("checkpointLocation", f"file://{tmp_path}/progress").outputMode("update").foreachBatch(lambda b, n: b.collect()).trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append(query.lastProgress.stateOperators[0].numRowsTotal)
        return query

    parts(spark, tmp_path, [with_ts[:2], with_ts[2:], [(4, "b", 21 * 3_600_000, with_ts[2][3])]], POSTS, run)
    state = spark.read.format("statestore").option("path", f"file://{tmp_path}/progress").option("stateVarName", "count").load()
    hours = sorted(r.hour for r in state.select("key.hour").collect())
    assert 0 not in hours and hours == [20, 21]


def test_counters_move_by_the_newest_count(spark, tmp_path):
    batches = [
        [("/a.txt", "text", "txt", 3, 1), ("/b.png", "image", "png", 1, 1), ("/c.txt", "text", "txt", 0, 1)],
        [("/a.txt", "text", "txt", 5, 2), ("/a.txt", "text", "txt", 0, 3), ("/b.png", "image", "png", 4, 0), ("/c.txt", "text", "txt", 2, 2)],
        [("/a.txt", "text", "txt", 7, 2), ("/b.png", "scan", "pdf", 2, 9)],
    ]

    def run(stream):
        return live.write_moves(live.counter_moves(stream), f"file://{tmp_path}/moves", f"file://{tmp_path}/progress")

    want = [{("text", "txt", 1, 3), ("image", "png", 1, 1)}, {("text", "txt", 1, 2), ("image", "png", 1, 1)}, {("text", "txt", 1, 2), ("scan", "pdf", 1, 2)}]
    for k, batch in enumerate(batches):
        parts(spark, tmp_path, [batch], COUNTS, run)
        assert {tuple(r) for r in live.counters_at(spark, f"file://{tmp_path}/moves").collect()} == want[k]
    parts(spark, tmp_path, [batches[2]], COUNTS, run)  # the same again
    assert {tuple(r) for r in live.counters_at(spark, f"file://{tmp_path}/moves").collect()} == want[2]


class Failing(embed.HashEmbedder):
    def embed(self, texts):
        out = super().embed(texts)
        out[[i for i, t in enumerate(texts) if "broken" in t]] = np.nan
        return out


def files(spark, rows):
    return spark.createDataFrame([(p, float(m), len(t), "text", bytearray(t.encode())) for p, m, t in rows], "path string, modified double, size long, kind string, content binary")


def test_figures_of_passes_and_batches(spark, tmp_path):
    store, told = Store(spark, f"file://{tmp_path}/s"), []
    seen = Progress(told.append)
    first = [("/r/a.txt", 1, "alpha"), ("/r/b.txt", 1, "alpha"), ("/r/c.txt", 1, " "), ("/r/d.txt", 1, "broken")]
    index_pass.index(store, files(spark, first), ["/r"], Failing(), progress=seen)
    assert seen.figures == {"scanned": 4, "unchanged": 0, "reused": 0, "embedded": 2, "empty": 1, "failed": 1, "deleted": 0}
    assert len(told) == 3 and told[0]["scanned"] == 4 and told[0]["embedded"] == 0 and told[-1] == seen.figures
    seen = Progress()
    done = index_pass.index(store, files(spark, [("/r/a.txt", 1, "alpha"), ("/r/n.txt", 1, "alpha")]), ["/r"], Failing(), progress=seen)
    by = Counter(r.status for r in done.collect())
    assert {k: v for k, v in seen.figures.items() if v and k != "scanned"} == by == {"unchanged": 1, "reused": 1, "deleted": 1}


def test_figures_of_a_stream(spark, tmp_path):
    listener, seen = BatchEvents(), Progress()
    spark.streams.addListener(listener)
    store = Store(spark, f"file://{tmp_path}/s")
    there = files(spark, [(f"/r/{k}.txt", 1, f"text {k}") for k in range(6)])
    try:
        changes.append(spark.createDataFrame([(f"/r/{k}.txt", "create", k) for k in range(8)], changes.SCHEMA), f"file://{tmp_path}/journal")
        query = index_pass.follow(store, changes.changes(spark, f"file://{tmp_path}/journal"), lambda: there, Failing(), f"file://{tmp_path}/progress", every="0 seconds", progress=seen)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert seen.figures["embedded"] == 6 and seen.figures["scanned"] == 8 and seen.figures["unchanged"] == 2
    assert sum(n for *_, n in listener.batches) == 8


def test_table_functions(spark):
    tables.register(spark)
    rng = random.Random(9)
    rows = [(k, v) for k, v in enumerate(["", None, "a" * 260, *("".join(rng.choice("ab\n😀") for _ in range(rng.randrange(2000))) for _ in range(5))])]
    df = spark.createDataFrame(rows, "id int, t string")
    df.createOrReplaceTempView("some_texts")
    got = sorted(map(tuple, spark.sql("SELECT id, c.* FROM some_texts, LATERAL chunk(t, 260) c").collect()))
    want = sorted(map(tuple, df.select("id", F.explode(text.chunks(F.col("t"), 260)).alias("c")).select("id", "c.*").collect()))
    assert got == want
    chunks = [(f"/f{k // 3}", k % 3, None if k == 7 else [float(rng.randrange(-2, 3)) for _ in range(3 - (k == 11))]) for k in range(200)] + [("/bad", 0, [float("nan"), 0.0, 0.0])]
    table = spark.createDataFrame(chunks, "path string, chunk_index int, vec array<float>").repartition(6)
    table.createOrReplaceTempView("some_chunks")
    for k in (0, 4, 500):
        got = spark.sql(f"SELECT path, max(struct(score, -chunk_index AS p)) AS b FROM nearest(TABLE(some_chunks), array(1D, 0.5D, -2D), {k}) GROUP BY path ORDER BY b.score DESC, path LIMIT {k}").collect()
        exact = search.search(table.withColumns({"snippet": F.lit(""), "kind": F.lit("text")}), [1.0, 0.5, -2.0], k).orderBy(F.desc("score"), "path").collect()
        assert [(r.path, r.b.score, -r.b.p) for r in got] == [(r.path, r.score, r.chunk_index) for r in exact]


def test_counts_and_first_posts_of_a_stream(spark, tmp_path):
    rows = [(k % 7, "a" if k % 3 else "b", k * 600_000, None) for k in range(40)]
    posts = spark.createDataFrame(rows, POSTS).withColumn("ts", F.timestamp_millis("created_at"))
    posts.write.parquet(f"file://{tmp_path}/in")
    for name, build, mode in (("counts", live.hourly_counts, "complete"), ("first", live.first_posts, "append")):
        stream = build(spark.readStream.schema(posts.schema).parquet(f"file://{tmp_path}/in"))
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(availableNow=True).start().awaitTermination()
    want = Counter((who, at // 3_600_000) for _, who, at, _ in rows)
    got = spark.table("counts").select("ip_hash", F.unix_millis("start").alias("t"), "n").collect()
    assert {(r.ip_hash, r.t // 3_600_000): r.n for r in got} == want
    assert sorted(r.run_id for r in spark.table("first").collect()) == list(range(7))


def test_small_operators(spark):
    from lodeseek.functions import ignore
    from lodeseek.operators import indexing

    df = spark.createDataFrame([("rule\n",)], "t string").select(ignore.text_hash(F.col("t")).alias("h"), F.sha2(F.lit("rule\n"), 256).alias("w")).first()
    assert df.h == df.w
    keys = spark.createDataFrame([("/a", "k"), ("/b", "k"), ("/c", "k")], "path string, key string")
    chunks = spark.createDataFrame([("/a", "image"), ("/b", "text")], "path string, kind string")
    assert sorted(r.path for r in indexing.delete_keys_of_kind(keys, chunks, ["image"]).collect()) == ["/b", "/c"]
    runs = spark.createDataFrame([(1, 5, "x"), (1, 3, "y"), (1, 3, "z"), (2, 1, "w")], "run_id long, created_at long, row string")
    assert {tuple(r) for r in telemetry.first_of_run(runs, "row").collect()} == {(1, 3, "y"), (2, 1, "w")}


def test_a_counted_store(spark, tmp_path):
    from lodeseek.operators import indexing
    from lodeseek.schema import CHUNKS

    chunk = lambda path, i: (path, 1.0, 1, "text", i, "", [1.0], 0, 0, 0.0, "")
    store = Store(spark, f"file://{tmp_path}/s", counted=True)
    rows = lambda *x: spark.createDataFrame(list(x), CHUNKS)
    store.apply(rows(chunk("/a.txt", 0), chunk("/a.txt", 1), chunk("/b.md", 0)))
    store.apply(rows(chunk("/a.txt", 0)), spark.createDataFrame([("/b.md",), ("/none",)], "path string"))
    assert [tuple(r) for r in store.counters().collect()] == [("text", "txt", 1, 1)]
    store.fold()
    store.apply(rows(chunk("/c", 0)))
    assert indexing.diverged(store.counters(), store.chunks()).count() == 0 and store.counters().count() == 2
