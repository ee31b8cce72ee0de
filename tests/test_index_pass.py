"""Index passes, live updates and the store around them, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import embed, text
from lodeseek.operators import history, indexing, projection, search, telemetry
from lodeseek.plans import index_pass
from lodeseek.schema import CHUNKS
from lodeseek.sources import files as sources
from lodeseek.sources.store import SCHEMA_VERSION, Store, temporary, write_report

FILES = "path string, modified double, size long, kind string, content binary"


def table(spark, rows):
    return spark.createDataFrame([(p, float(m), len(t.encode()), "text", bytearray(t.encode())) for p, m, t in rows], FILES)


class Counting(embed.HashEmbedder):
    """Fails on texts with the word ``broken``."""

    def embed(self, texts):
        out = super().embed(texts)
        out[[i for i, t in enumerate(texts) if "broken" in t]] = np.nan
        return out


def held(store):
    return sorted((r.path, r.modified, r.snippet) for r in store.chunks().collect())


def test_passes(spark, tmp_path):
    store, maker = Store(spark, f"file://{tmp_path}/store"), Counting()
    first = [("/r/a.txt", 1, "alpha"), ("/r/b.txt", 1, "alpha"), ("/r/c.txt", 1, "  "), ("/r/d.txt", 1, "broken words"), ("/r/e.md", 1, "beta"), ("/r/x.bin", 1, "no kind")]
    done = {r.path: r.status for r in index_pass.index(store, table(spark, first), ["/r"], maker).collect()}
    assert done == {"/r/a.txt": "embedded", "/r/b.txt": "embedded", "/r/c.txt": "empty", "/r/d.txt": "failed", "/r/e.md": "embedded"}
    assert held(store) == [("/r/a.txt", 1.0, "alpha"), ("/r/b.txt", 1.0, "alpha"), ("/r/e.md", 1.0, "beta")]
    vecs = {r.path: r.vec for r in store.chunks().collect()}
    assert vecs["/r/a.txt"] == vecs["/r/b.txt"] == pytest.approx(maker.embed(["Document: alpha"])[0].tolist())
    # Unchanged, touched, emptied, new with a known content, gone.
    second = [("/r/a.txt", 1, "alpha"), ("/r/b.txt", 2, "alpha"), ("/r/n.txt", 1, "alpha"), ("/r/e.md", 3, "")]
    done = {r.path: r.status for r in index_pass.index(store, table(spark, second), ["/r"], maker).collect()}
    assert done == {"/r/a.txt": "unchanged", "/r/b.txt": "reused", "/r/n.txt": "reused", "/r/e.md": "empty"}
    assert held(store) == [("/r/a.txt", 1.0, "alpha"), ("/r/b.txt", 2.0, "alpha"), ("/r/n.txt", 1.0, "alpha")]
    # A cancelled pass deletes nothing, a root without files neither.
    rest = table(spark, second[:1])
    index_pass.index(store, rest, ["/r"], maker, cancelled=True).collect()
    index_pass.index(store, rest, ["/other"], maker).collect()
    assert len(held(store)) == 3
    done = {r.path: r.status for r in index_pass.index(store, rest, ["/r"], maker).collect()}
    assert done == {"/r/a.txt": "unchanged", "/r/b.txt": "deleted", "/r/n.txt": "deleted"}
    assert sorted(r.path for r in store.keys().collect()) == ["/r/a.txt"]
    forced = index_pass.index(store, rest, ["/r"], maker, index_pass.Settings(force=True)).collect()
    assert [r.status for r in forced] == ["reused"]


def test_updates(spark, tmp_path):
    store, maker = Store(spark, f"file://{tmp_path}/store"), Counting()
    events = lambda rows: spark.createDataFrame(rows, "path string, op string, event_id long")
    there = [("/r/a.txt", 1, "alpha"), ("/r/b.txt", 1, "beta"), ("/p/c.txt", 1, "gamma")]
    index_pass.update(store, events([(p, "create", i) for i, (p, *_) in enumerate(there)]), table(spark, there), maker, paused=["/p"], batch="1")
    assert [p for p, *_ in held(store)] == ["/r/a.txt", "/r/b.txt"]
    again = events([("/r/a.txt", "modify", 4), ("/r/b.txt", "delete", 6), ("/r/b.txt", "modify", 5), ("/r/none.txt", "delete", 7)])
    now = table(spark, [("/r/a.txt", 2, "alpha two")])
    for _ in range(2):  # the same batch twice
        index_pass.update(store, again, now, maker, batch="2")
        assert held(store) == [("/r/a.txt", 2.0, "alpha two")]
    remote = table(spark, [("/r/a.txt", 3, "not here")]).withColumn("dataless", F.lit(True))
    index_pass.update(store, events([("/r/a.txt", "modify", 9)]), remote, maker, batch="3")
    assert held(store) == [("/r/a.txt", 2.0, "alpha two")]


def test_file_as_query(spark):
    files = table(spark, [("/r/a.txt", 1, " alpha ")])
    maker = Counting()
    for as_document, prefix in ((False, "Query: "), (True, "Document: ")):
        assert index_pass.file_query(files, maker, as_document).first().vec == pytest.approx(maker.embed([prefix + "alpha"])[0].tolist())


def chunk(path, index=0, vec=(1.0, 0.0), kind="text", modified=1.0):
    return (path, modified, 1, kind, index, "s", [float(x) for x in vec], 0, 0, 0.0, "")


def test_store_versions(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = lambda *r: spark.createDataFrame(list(r), CHUNKS)
    store.replace_many(rows(chunk("/a"), chunk("/b")))
    stale = store.manifest()
    store.set("note", "x" * 100_000)
    assert store.get("note") == "x" * 100_000
    with pytest.raises(RuntimeError):  # another writer was first
        store._commit(stale)
    store.record_keys(spark.createDataFrame([("/a", "k", 1.0, 1), ("/b", "k", 1.0, 1)], "path string, key string, modified double, size long"))
    store.delete_chunks("/a")
    assert [r.path for r in store.chunks().collect()] == ["/b"] and store.keys().count() == 2
    before = store.chunks()
    assert store.compact() and [r.path for r in before.collect()] == ["/b"]  # a reader of the version before goes on
    store.close()
    store.close()
    assert len(store._manifests()) <= 4 and store.keys().count() == 2
    old = store.manifest() | {"schema": SCHEMA_VERSION - 1}
    store._commit(old)
    assert store.chunks().count() == 0 and store.get("note")
    with temporary(spark, f"file://{tmp_path}") as trial:
        trial.replace_many(rows(chunk("/t")))
        assert trial.chunks().count() == 1
        root = trial.root
    assert not (tmp_path / root.rsplit("/", 1)[-1]).exists()
    write_report(spark.createDataFrame([(1, "a")], "n int, s string"), f"file://{tmp_path}/report")
    assert spark.read.json(f"file://{tmp_path}/report").first().s == "a"


def test_added_columns_have_defaults(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.replace_many(spark.createDataFrame([chunk("/a")], CHUNKS))
    old = f"file://{tmp_path}/old"
    spark.createDataFrame([chunk("/b")], CHUNKS).drop("locator", "width").write.parquet(old)
    m = store.manifest()
    store._commit(m | {"delta": [*m["delta"], {"gone": None, "rows": old}]})
    assert {r.path: (r.locator, r.width) for r in store.chunks().collect()} == {"/a": ("", 0), "/b": ("", 0)}


def test_search_by_brute_force(spark):
    """Random tables with ties, broken vectors and filters, in many tasks."""
    rng = random.Random(3)
    for trial in range(4):
        rows = []
        for f in range(60):
            for i in range(rng.randrange(1, 6)):
                vec = [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]
                if rng.random() < 0.05:
                    vec[0] = float("nan")
                rows.append(chunk(f"/d{f % 3}/f{f:02d}.txt", i, vec, rng.choice(["text", "image"]), rng.random()))
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, CHUNKS).repartition(7)
        query, k, since = [1.0, 0.5, -0.25], rng.choice([1, 5, 100]), rng.choice([None, 0.5])
        kinds = rng.choice([frozenset(), frozenset({"image"})])
        best, size = {}, {}
        for path, modified, _, kind, index, _, vec, *_ in rows:
            size[path] = size.get(path, 0) + 1
            score = sum(a * b for a, b in zip(query, vec, strict=True))
            if score == score and (not kinds or kind in kinds) and (since is None or modified >= since):
                best[path] = max(best.get(path, (-9.0, 0)), (score, -index))
        want = sorted(((-s, p, -i) for p, (s, i) in best.items()))[:k]
        got = search.search(df, query, k, kinds, None, "", since).collect()
        assert sorted((-r.score, r.path, r.chunk_index) for r in got) == sorted(want)
        assert all(r.chunk_count == size[r.path] for r in got)
        asked = spark.createDataFrame([(j, query if j % 2 else [0.0, 1.0, 0.0]) for j in range(5)] + [(9, None)], "query_id int, vec array<double>")
        ranked = search.search_batch(df, asked, k).where("query_id = 1").orderBy("rank").collect()
        every = {}
        for path, _, _, _, index, _, vec, *_ in rows:
            score = sum(a * b for a, b in zip(query, vec, strict=True))
            if score == score:
                every[path] = max(every.get(path, (-9.0, 0)), (score, -index))
        assert [(r.path, r.score, r.chunk_index) for r in ranked] == [(p, s, -i) for s, p, i in sorted(((s, p, i) for p, (s, i) in every.items()), key=lambda x: (-x[0], x[1]))][:k]
    assert search.search(df, query, 0).count() == 0 and search.search_batch(df, asked, 0).count() == 0
    assert search.search(df.limit(0), query, 3).count() == 0 and search.search_batch(df, asked.limit(0), 3).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(50, 4)) * 2) / 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    scores = x @ x.T
    np.fill_diagonal(scores, -np.inf)
    want = {i: sorted(range(50), key=lambda j: (-round(scores[i, j], 9), j))[:5] for i in range(50)}
    for size in (64 << 20, 500):
        monkeypatch.setattr(projection, "BLOCK_BYTES", size)
        got = {}
        for r in projection.neighbours(df, df, 5).collect():
            got.setdefault(r.src, []).append((round(-r.score, 9), r.dst))
        assert {i: [j for _, j in sorted(v)] for i, v in got.items()} == want


def test_budgets_and_orders(spark):
    assert projection.landmark_budget(6, 768) == 15_000 and projection.landmark_budget(6, 768, layout=False) == 50_331
    assert projection.landmark_budget(0.1, 1024) == 2000 and projection.landmark_budget(64, 768) == 60_000
    assert index_pass.next_work({"events": True, "restart": True}) == "restart" and index_pass.next_work({"events": True}, busy=True) is None
    assert sources.default_roots("/home/u/") == ["/home/u/Documents", "/home/u/Downloads", "/home/u/Desktop"]
    assert text.extensions_of("scan") == [] and text.extensions_of("audio")[0] == "aac"
    kept = indexing.counters(spark.createDataFrame([chunk("/a.txt"), chunk("/b.md")], CHUNKS))
    assert indexing.diverged(kept, spark.createDataFrame([chunk("/a.txt")], CHUNKS)).collect()[0].ext == "md"
    done = spark.createDataFrame([("/r", "/r/a"), ("/r", "/r/b"), ("/s", None)], "root string, path string")
    found = {r.root: (r.done, r.total, r.fraction) for r in telemetry.progress(done, done.where("path = '/r/a'")).collect()}
    assert found == {"/r": (1, 2, 0.5), "/s": (0, 0, 0.0)}


def test_recording(spark):
    items = spark.createDataFrame([("ca", False, 1.0), ("Dog", True, 2.0)], "query string, bookmarked boolean, last_used double")
    record = lambda raw, **k: sorted((r.query, r.bookmarked) for r in history.recorded(items, raw, k.pop("text", raw), 5.0, **k).collect())
    same = [("Dog", True), ("ca", False)]
    assert record("cat") == [("Dog", True), ("cat", False)]
    assert record("dog") == [("ca", False), ("dog", True)]
    assert record("cat", mode="manual") == same and record("cat", mode="submit") == same and record("type:image c", text="c") == same and record("cat", replayed="cat ") == same
    assert record("cat", mode="submit", submitted=True) == [("Dog", True), ("cat", False)]


def test_preview(spark):
    rows = [("/a.mp4", "video", "4:00", True), ("/a.mp4", "video", "", False), ("/a.pdf", "scan", "Page 2", True), ("/a.pdf", "text", "Line 2", False), ("/a.pdf", "scan", "Page 0", False), ("/a.txt", "text", "Page 2", False)]
    df = spark.createDataFrame(rows, "path string, kind string, locator string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", text.expects_preview(F.col("path"), F.col("kind"), F.col("locator"))).collect())
