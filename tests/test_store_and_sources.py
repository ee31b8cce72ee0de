"""Chunks of long texts, the walk, the change journal, and what the store reads and keeps."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import embed, packed, text
from lodeseek.operators import search
from lodeseek.plans import index_pass
from lodeseek.schema import CHUNKS
from lodeseek.sources import changes, files, store as stores, walk
from lodeseek.sources.store import Store

FILES = "path string, modified double, size long, kind string, content binary"


def table(spark, rows):
    return spark.createDataFrame([(p, float(m), len(t.encode()), "text", bytearray(t.encode())) for p, m, t in rows], FILES)


# Chunks.


def plain_chunks(value, limit):
    step = max(1, limit - 200)
    if len(value) <= limit:
        return [(0, 0, value, "")]
    n = -(-(len(value) - limit) // step) + 1
    return [(i, i * step, value[i * step : i * step + limit], f"Line {value[: i * step].count(chr(10)) + 1}") for i in range(n)]


@pytest.mark.parametrize("limit", [200, 260, 399, 400, 1800])
def test_chunks_equal_plain_python(spark, limit):
    rng = random.Random(limit)
    values = ["", "a", "x" * limit, "x" * (limit + 1)] + ["".join(rng.choice("ab\n😀ü ") for _ in range(rng.randrange(3000))) for _ in range(8)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(99, None)], "id int, t string")
    for r in df.select("id", text.chunks(F.col("t"), limit).alias("c")).collect():
        assert (r.c is None) == (r.id == 99)
        if r.c is not None:
            assert [tuple(c) for c in r.c] == plain_chunks(values[r.id], limit)


def test_running_sums(spark):
    values = [[], [5], list(range(2000)), [1] * 512, [1] * 513]
    df = spark.createDataFrame([(v,) for v in values], "v array<int>").select("v", text.running_sums(F.col("v")).alias("s"))
    for r in df.collect():
        assert r.s == np.concatenate([[0], np.cumsum(r.v)])[: len(r.v)].astype(int).tolist()


def test_chunks_of_long_texts_take_time_in_proportion(spark):
    took = []
    for n in (1 << 19, 1 << 21):
        df = spark.range(1).select(F.repeat(F.lit("some words\nand more of them "), n // 27).alias("t"))
        best = 99.0
        for _ in range(2):
            began = time.time()
            df.select(F.explode(text.chunks(F.col("t"))).alias("c")).agg(F.max("c.locator")).collect()
            best = min(best, time.time() - began)
        took.append(best)
    assert took[1] < 10 and took[1] < 8 * max(took[0], 0.3)


# The walk.


@pytest.fixture
def tree(tmp_path):
    made = {
        "a.txt": "alpha", "sub/b.md": "beta", "sub/deep/er/c.txt": "gamma", "sub/.hidden/d.txt": "x", ".e.txt": "x", "node_modules/p/f.txt": "x",
        "sub/node_modules/g.txt": "x", "Tool.app/Contents/h.txt": "x", "out/keep/i.txt": "delta", "sub/data.csv": "x", "raw.bin": "x", "Ünïcode dir/j k.txt": "eps",
    }
    for name, content in made.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    (tmp_path / "link").symlink_to(tmp_path / "sub")
    return tmp_path


POLICY = "node_modules/\n*.csv\n"


def test_walk_enters_only_what_it_takes(spark, tree):
    found, listed = walk.Walk(spark, [str(tree)], policy=POLICY).run()
    below = lambda rows: sorted(r.path[len(str(tree)) :] for r in rows.collect())
    assert below(found) == ["/a.txt", "/out/keep/i.txt", "/sub/b.md", "/sub/deep/er/c.txt", "/Ünïcode dir/j k.txt"]
    assert below(listed) == ["", "/out", "/out/keep", "/sub", "/sub/deep", "/sub/deep/er", "/Ünïcode dir"]


def test_walk_finds_what_spark_lists(spark, tree):
    (tree / "link").unlink()
    (tree / "Ünïcode dir/j k.txt").unlink()  # Spark's own source encodes such names
    both = [sorted(tuple(r) for r in files.crawl(spark, [str(tree)], policy=POLICY, with_content=True, prune=p).select("path", "modified", "size", "kind", "content").collect()) for p in (True, False)]
    assert both[0] == both[1] and len(both[0]) == 4


def test_walk_of_nothing(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    for root in (tmp_path / "empty", tmp_path / "missing"):
        assert walk.Walk(spark, [f"file://{root}"]).run()[0].count() == 0


def test_look_at_paths(spark, tree):
    w = walk.Walk(spark, [str(tree)], policy=POLICY)
    ask = lambda *names: sorted(r.path[len(str(tree)) :] for r in w.look(spark.createDataFrame([(f"{tree}{n}" if n else str(tree),) for n in names], "path string")).collect())
    assert ask("/sub", "/sub/deep", "/a.txt", "/gone", "/raw.bin") == ["/a.txt", "/sub/b.md", "/sub/deep/er/c.txt"]
    assert ask("/node_modules/p", "/sub/.hidden/d.txt", "/Tool.app") == []
    assert w.look(spark.createDataFrame([("/etc/hosts.txt",)], "path string")).count() == 0


def test_pass_and_updates_over_a_real_tree(spark, tree):
    """An index from the walk, and batches that look at their own paths only."""
    store, maker = Store(spark, f"file://{tree}-store"), embed.HashEmbedder()
    w = walk.Walk(spark, [str(tree)], policy=POLICY)
    index_pass.index(store, w.run()[0].drop("root"), [str(tree)], maker, read=walk.read_content)
    held = lambda: {r.path[len(str(tree)) :]: r.snippet for r in store.chunks().collect()}
    assert held() == {"/a.txt": "alpha", "/out/keep/i.txt": "delta", "/sub/b.md": "beta", "/sub/deep/er/c.txt": "gamma", "/Ünïcode dir/j k.txt": "eps"}
    (tree / "sub/deep").rename(tree / "moved")
    (tree / "a.txt").write_text("alpha two")
    (tree / "out/keep/i.txt").unlink()
    (tree / "out/new.txt").write_text("not told of")
    events = spark.createDataFrame([(f"{tree}/sub/deep", "delete", 1), (f"{tree}/moved", "create", 2), (f"{tree}/a.txt", "modify", 3), (f"{tree}/out/keep/i.txt", "delete", 4)], "path string, op string, event_id long")
    index_pass.update(store, events, lambda paths: w.look(paths).drop("root"), maker, index_pass.Settings(policy=POLICY), read=walk.read_content, batch="1")
    assert held() == {"/a.txt": "alpha two", "/moved/er/c.txt": "gamma", "/sub/b.md": "beta", "/Ünïcode dir/j k.txt": "eps"}


# The journal.


def test_journal_goes_on_where_it_stopped(spark, tmp_path):
    events = lambda ids: spark.createDataFrame([(f"/f{i % 7}", "modify", i) for i in ids], changes.SCHEMA)
    journal, seen = f"file://{tmp_path}/journal", []

    def run(progress, since=-1):
        query = changes.changes(spark, journal, since).writeStream.option("checkpointLocation", f"file://{tmp_path}/{progress}").foreachBatch(lambda b, n: seen.append(sorted(r.event_id for r in b.collect()))).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        out = [i for batch in seen for i in batch]
        seen.clear()
        return out

    changes.append(events(range(100)).repartition(4), journal)
    assert run("p") == list(range(100))
    assert run("p") == []
    changes.append(events(range(100, 150)), journal)
    assert run("p") == list(range(100, 150))
    assert run("q", since=120) == list(range(121, 150))


def test_journal_partitions_are_row_groups_in_range(spark, tmp_path):
    changes.append(spark.createDataFrame([("/a", "modify", i) for i in range(10)], changes.SCHEMA), f"file://{tmp_path}/j")
    changes.append(spark.createDataFrame([("/b", "modify", i) for i in range(10, 30)], changes.SCHEMA), f"file://{tmp_path}/j")
    reader = changes.ChangeReader(f"file://{tmp_path}/j", -1)
    assert reader.latestOffset() == {"event_id": 29}
    parts = reader.partitions({"event_id": 9}, {"event_id": 20})
    assert sorted(x for p in parts for b in reader.read(p) for x in b.column(2).to_pylist()) == list(range(10, 21))
    assert changes.ChangeReader(f"file://{tmp_path}/none", 5).latestOffset() == {"event_id": 5}


# The store.


def rows(spark, n, start=0, dim=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return spark.createDataFrame([(f"/d{i % 5}/f{i:05d}.txt", 1.0, 1, "text", 0, f"s{i}", v.tolist(), 0, 0, 0.0, "") for i, v in enumerate(x, start)], CHUNKS)


def test_lookups_open_what_they_touch(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.apply(rows(spark, 800))
        store.fold()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store.record_keys(store.chunks().select("path", F.concat(F.lit("k"), "path").alias("key"), "modified", "size"))
    store.fold()
    ask = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    all_files = len(store.chunks().inputFiles())
    one = store.rows_at(ask("/d1/f00001.txt", "/nowhere"))
    assert [r.path for r in one.collect()] == ["/d1/f00001.txt"]
    opened = [f for f in one.inputFiles() if "/base-" in f]
    assert all_files >= 6 and 1 <= len(opened) <= 2
    below = store.at_or_below(ask("/d3", "/d1/f00001.txt", "/d"))
    assert below.count() == 161 and len([f for f in below.inputFiles() if "/base-" in f]) < all_files
    found = store.keys_for(spark.createDataFrame([("k/d2/f00002.txt",), ("none",)], "key string"))
    assert [r.path for r in found.collect()] == ["/d2/f00002.txt"]
    # What a delta replaced is not found at its old place, also where very many paths are asked for.
    store.apply(rows(spark, 1, 1, seed=5).withColumn("snippet", F.lit("new")), ask("/d2/f00002.txt"), forgotten=ask("/d2/f00002.txt"))
    stores.LOOKUP, kept = 0, stores.LOOKUP
    try:
        wide = {r.path: r.snippet for r in store.rows_at(ask("/d1/f00001.txt", "/d2/f00002.txt")).collect()}
    finally:
        stores.LOOKUP = kept
    assert wide == {r.path: r.snippet for r in store.rows_at(ask("/d1/f00001.txt", "/d2/f00002.txt")).collect()} == {"/d1/f00001.txt": "new"}
    assert store.keys_for(spark.createDataFrame([("k/d2/f00002.txt",)], "key string")).count() == 0


def test_chunks_and_keys_change_in_one_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    before = store.manifest()["version"]
    index_pass.index(store, table(spark, [("/r/a.txt", 1, "alpha"), ("/r/b.txt", 1, "beta")]), ["/r"], embed.HashEmbedder())
    m = store.manifest()
    assert m["version"] == before + 1 and len(m["delta"]) == len(m["keys_delta"]) == 1
    index_pass.update(store, spark.createDataFrame([("/r/b.txt", "delete", 1)], "path string, op string, event_id long"), table(spark, [("/r/a.txt", 1, "alpha")]), embed.HashEmbedder(), batch="x")
    assert store.manifest()["version"] == m["version"] + 1 and [r.path for r in store.keys().collect()] == ["/r/a.txt"]
    store._commit(store.manifest() | {"schema": stores.SCHEMA_VERSION - 1})
    assert store.chunks().count() == 0 and store.keys().count() == 0


def test_contents_are_not_copied(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    index_pass.index(store, table(spark, [("/r/a.txt", 1, "alpha" * 1000)]), ["/r"], embed.HashEmbedder())
    kinds = {f.name: [x for x in spark.read.parquet(str(f)).columns if x == "content"] for f in (tmp_path / "s/data").iterdir()}
    assert kinds and not any(kinds.values())


def test_packed_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", packed=True)
    store.apply(rows(spark, 50))
    store.fold()
    store.apply(rows(spark, 10, 45, seed=9))
    want = {r.path: r.vec for r in rows(spark, 50).collect()} | {r.path: r.vec for r in rows(spark, 10, 45, seed=9).collect()}
    got = {r.path: r.vec for r in store.chunks().collect()}
    assert got.keys() == want.keys()
    for p, v in want.items():
        assert np.array_equal(np.float32(got[p]), embed.decode_blob(embed.encode_bf16(np.float32(v)), 8))
    query = [1.0, -0.5, 0.25, 0, 0, 0, 1, 2]
    exact = search.search(store.chunks(), query, 7).select("path", "score").collect()
    assert sorted((r.path, round(r.score, 9)) for r in search.search(store.packed_chunks(), query, 7).collect()) == sorted((r.path, round(r.score, 9)) for r in exact)
    with pytest.raises(ValueError):
        store.apply(rows(spark, 1, dim=4))


def test_blobs_of_any_length():
    x = np.float32([[1.5, -2.0, 0.1]])
    import pyarrow as pa

    blobs = pa.array([x.tobytes(), packed.to_bf16(x).tobytes(), b"\x00", None, packed.to_bf16(x).tobytes() + b"zz"], pa.binary())
    want = [embed.decode_blob(b or b"", 3) for b in blobs.to_pylist()]
    assert np.array_equal(packed.matrix(blobs, 3), np.stack(want))
    assert np.array_equal(packed.matrix(blobs.slice(1, 1), 3), want[1][None])


def test_codes_are_near_to_the_vectors():
    x = np.random.default_rng(0).normal(size=(20, 100)).astype(np.float32)
    x[3] = 0.5
    scales, codes = packed.quantise(x)
    q = np.random.default_rng(1).normal(size=100)
    assert codes.shape == (20, 64) and np.abs(packed.coarse_scores(scales, codes, q) - x @ q).max() < 0.1 * np.linalg.norm(q) * 10**0.5
    assert packed.coarse_scores(scales, codes, q)[3] == pytest.approx(0.5 * q.sum(), abs=1e-4)


def test_replica_search_finds_base_and_delta(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", packed=True)
    store.apply(rows(spark, 3000, dim=32))
    store.fold()
    store.apply(rows(spark, 40, 2990, dim=32, seed=4), spark.createDataFrame([("/d0/f00000.txt",)], "path string"))
    codes = store.codes()
    assert codes.count() == 2989 and "vec" not in codes.columns
    hits = 0
    for seed in range(6):
        query = np.random.default_rng(100 + seed).normal(size=32).tolist()
        exact = [r.path for r in search.search(store.packed_chunks(), query, 10).orderBy(F.desc("score")).collect()]
        hits += len({r.path for r in search.funnel_stored(store, query, 10, candidates=200).collect()} & set(exact))
    assert hits >= 57
    chosen = search.coarse_candidates(codes, query, 200)
    assert "vec" not in chosen._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1].split("\n")[0]
    only = search.funnel_stored(store, query, 10, admit=F.col("path").startswith("/d3/")).collect()
    assert len(only) == 10 and all(r.path.startswith("/d3/") for r in only)


def test_steps_become_runs_and_runs_a_base(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stores, "STEPS", 3)
    rng, want, keys = random.Random(12), {}, {}
    for packed_store in (False, True):
        store = Store(spark, f"file://{tmp_path}/{packed_store}", packed=packed_store, counted=True)
        want, keys, shapes = {}, {}, set()
        for step in range(8):
            new = rows(spark, 20, rng.randrange(40), seed=step).withColumn("snippet", F.lit(f"s{step}")).cache()
            gone = [f"/d{i % 5}/f{i:05d}.txt" for i in rng.sample(range(60), 6)]
            fresh = {r.path for r in new.collect()}
            for p in gone:
                want.pop(p, None)
                keys.pop(p, None)
            want |= dict.fromkeys(fresh, f"s{step}")
            keys |= {p: f"k{step}" for p in fresh}
            named = new.select("path", F.lit(f"k{step}").alias("key"), "modified", "size")
            store.apply(new, spark.createDataFrame([(p,) for p in gone], "path string"), named, spark.createDataFrame([(p,) for p in gone if p not in fresh], "path string"))
            m = store.manifest()
            shapes.add((len(m["base"]), sum(bool(x.get("ranges")) for x in m["delta"])))
            assert {r.path: r.snippet for r in store.chunks().collect()} == want and {r.path: r.key for r in store.keys().collect()} == keys
            asked = spark.createDataFrame([(p,) for p in list(want)[:5] + gone], "path string")
            assert {r.path for r in store.rows_at(asked).collect()} == {p for p in list(want)[:5] + gone if p in want}
        found = store.keys_for(spark.createDataFrame([("k7",), ("k6",)], "key string"))
        assert {r.path for r in found.collect()} == {p for p, k in keys.items() if k in ("k6", "k7")}
        assert (0, 1) in shapes and (0, 2) in shapes and m["delta_rows"] >= 20
        monkeypatch.setattr(stores, "FOLD_ROWS", 1)
        store.apply(removed=spark.createDataFrame([("/none",)], "path string"))
        monkeypatch.setattr(stores, "FOLD_ROWS", 50_000)
        m = store.manifest()
        assert len(m["base"]) == 1 and m["delta"] == [] and m["rows"] == len(want) and {r.path: r.snippet for r in store.chunks().collect()} == want
        from lodeseek.operators import indexing

        assert indexing.diverged(store.counters(), store.chunks()).count() == 0
