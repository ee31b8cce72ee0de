"""Operators against brute force, and the store and stream end to end."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek import catalogue, serving
from lodeseek.functions import embed, ignore
from lodeseek.operators import history, indexing, projection, search
from lodeseek.schema import CHUNKS
from lodeseek.sources import files as crawling
from lodeseek.sources import mapping
from lodeseek.sources.store import Store
from lodeseek.streaming import live

KINDS = ["text", "image", "audio", "video"]


def corpus(spark, rng, n=40, dim=8):
    rows = []
    for f in range(n):
        path = f"/d{f % 7}/file{f}.{['txt', 'png', 'md'][f % 3]}"
        for i in range(int(rng.integers(1, 4))):
            v = rng.integers(-3, 4, dim).astype(float)
            v = v / (np.linalg.norm(v) or 1)
            rows.append((path, float(rng.integers(0, 1000)), 10, KINDS[f % 4], i, f"{path}#{i}", v.tolist(), 0, 0, 0.0, ""))
    return rows, spark.createDataFrame(rows, CHUNKS)


def brute(rows, query, k, kinds, folder, ext, since):
    best, count = {}, {}
    for path, modified, _, kind, i, *_, vec, _, _, _, _ in [(r[0], r[1], r[2], r[3], r[4], r[6], 0, 0, 0, 0) for r in rows]:
        count[path] = count.get(path, 0) + 1
        if kinds and kind not in kinds or folder and not (path == folder or path.startswith(folder + "/")):
            continue
        if ext and not path.endswith("." + ext) or since is not None and modified < since:
            continue
        score = sum(float(np.float32(a)) * float(b) for a, b in zip(vec, query, strict=True))
        if np.isfinite(score) and (path not in best or (score, -i) > best[path]):
            best[path] = (score, -i)
    top = sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:k]
    return [(p, round(s, 9), -i, count[p]) for p, (s, i) in top]


def test_search(spark):
    rng = np.random.default_rng(1)
    rows, df = corpus(spark, rng)
    df = df.cache()
    for trial in range(8):
        query = rng.normal(size=8).tolist()
        kinds = frozenset({"text", "audio"}) if trial % 3 == 0 else frozenset()
        folder = f"/d{trial % 7}" if trial % 4 == 1 else None
        ext = "md" if trial % 4 == 2 else ""
        since = 400.0 if trial % 4 == 3 else None
        got = search.search(df, query, 5, kinds, folder, ext, since).collect()
        want = brute(rows, query, 5, kinds, folder, ext, since)
        assert sorted((r.path, round(r.score, 9), r.chunk_index, r.chunk_count) for r in got) == sorted(want)
    assert search.search(df, query, 0).count() == 0


def test_search_skips_scores_that_are_not_finite(spark):
    rows = [("/a.txt", 1.0, 1, "text", 0, "s", [float("nan"), 1.0], 0, 0, 0.0, ""), ("/b.txt", 1.0, 1, "text", 0, "s", [0.5, 0.5], 0, 0, 0.0, "")]
    got = search.search(spark.createDataFrame(rows, CHUNKS), [1.0, 1.0], 5).collect()
    assert [r.path for r in got] == ["/b.txt"]


def test_funnel_recall(spark, tmp_path):
    """Many near vectors whose order the codes do not tell: the registered query finds the files of the exact search."""
    rng = np.random.default_rng(3)
    near = rng.normal(size=64) + 0.01 * rng.normal(size=(600, 64))
    vecs = np.concatenate([near, rng.normal(size=(900, 64))])
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    exact = search.search(mapping.chunks(spark, str(tmp_path)), mapping.query_vector(spark, str(tmp_path), catalogue.QUERY), 10)
    found = catalogue.QUERIES["funnel_search"](spark, str(tmp_path))
    assert {r.path for r in found.collect()} == {r.path for r in exact.collect()}


def test_landmarks(spark):
    files = spark.createDataFrame([(i, f"/f{i}") for i in range(10)], "idx long, path string")
    got = search.landmarks(files, 4, 8).orderBy("place").collect()
    assert [r.idx for r in got] == [0, 2, 5, 7, 1, 3, 4, 6]
    assert [r.is_landmark for r in got] == [True] * 4 + [False] * 4


def test_changes_and_reconcile(spark):
    known = spark.createDataFrame([("/r/a.txt", 1.0, 5, "text"), ("/r/b.png", 1.0, 5, "image"), ("/s/c.txt", 1.0, 5, "text"), ("/r/d.txt", 1.0, 5, "text")], "path string, modified double, size long, kind string")
    crawl = spark.createDataFrame([("/r/a.txt", 2.0, 5), ("/r/e.txt", 1.0, 1), ("/r/d.txt", 1.0, 5)], "path string, modified double, size long")
    assert {r.path: r.status for r in indexing.changes(crawl, known).collect()} == {"/r/a.txt": "modified", "/r/b.png": "gone", "/s/c.txt": "gone", "/r/d.txt": "unchanged", "/r/e.txt": "new"}
    gone = lambda **x: {r.path for r in indexing.stale(known, crawl, ["/r", "/s"], frozenset({"text", "image"}), **x).collect()}
    assert gone() == {"/r/b.png"}  # nothing of /s was seen: not reachable
    assert gone(cancelled=True) == set()
    assert gone(ignored=F.col("path").endswith(".png")) == set()


def test_scan_relabel(spark):
    of = lambda path, snippets: [(path, 1.0, 1, "text", i, s, [1.0], 0, 0, 0.0, "") for i, s in enumerate(snippets)]
    rows = of("/a.pdf", ["a.pdf - page 1", "a.pdf"]) + of("/b.pdf", ["b.pdf - page 1", "own words"]) + of("/c.txt", ["c.txt"]) + of("/d.pdf", ["d.pdf - page x"]) + of("/e.pdf", ["e.pdf - e.pdf"])
    got = {r.path: r.kind for r in indexing.relabel_scans(spark.createDataFrame(rows, CHUNKS)).collect()}
    assert got == {"/a.pdf": "scan", "/b.pdf": "text", "/c.txt": "text", "/d.pdf": "text", "/e.pdf": "scan"}


def test_store(spark, tmp_path):
    rows, df = corpus(spark, np.random.default_rng(2), 12)
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.chunks().count() == 0
    store.replace_many(df, batch="1")
    assert store.replace_many(df, batch="1") is False
    new = df.where("path = '/d0/file0.txt'").limit(1).withColumn("snippet", F.lit("new"))
    store.replace_many(new, df.where("path = '/d1/file1.png'").select("path"))
    left = {(r.path, r.snippet) for r in store.chunks().collect()}
    assert left == {(r[0], r[5]) for r in rows if r[0] not in ("/d0/file0.txt", "/d1/file1.png")} | {("/d0/file0.txt", "new")}
    store.fold()
    assert {(r.path, r.snippet) for r in store.chunks().collect()} == left
    with pytest.raises(ValueError, match="dimensions"):
        store.replace_many(new.withColumn("vec", F.array(F.lit(1.0)).cast("array<float>")))
    store.set("a", "b")
    assert Store(spark, store.root).get("a") == "b"
    assert store.migrate_scans() and not store.migrate_scans()
    store.delete_paths(store.chunks().where("path > '/d3'").select("path"))
    before = store.chunks().count()
    assert store.compact() and store.chunks().count() == before and not store.compact()
    assert store.outdated("2|8|m", 9) and not store.outdated("2|8|m", 8)
    store.wipe()
    assert store.chunks().count() == 0


def test_crawl(spark, tmp_path):
    for name, content in {"a.txt": b" hello ", "sub/b.md": "caf\xe9".encode("latin-1"), ".hidden/c.txt": b"x", "node_modules/d.js": b"x", "e.bin": b"x", "f.csv": b"1"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = crawling.crawl(spark, [str(tmp_path)], disabled_extensions=frozenset({"csv"}), policy=ignore.synthesise(), with_content=True)
    texts = {r.path.rsplit("/", 1)[-1]: r.text for r in crawling.read_text(found).collect()}
    assert texts == {"a.txt": "hello", "b.md": "café"}


def test_stream(spark, tmp_path):
    events = spark.createDataFrame([("/a.txt", "create", 1), ("/b.txt", "create", 2), ("/a.txt", "delete", 3), ("/c.png", "create", 4), ("/d.bin", "create", 5)], "path string, op string, event_id long")
    crawl = spark.createDataFrame([("/b.txt", 1.0, 1), ("/c.png", 1.0, 1), ("/d.bin", 1.0, 1)], "path string, modified double, size long")
    known = spark.createDataFrame([("/a.txt", 1.0, 1), ("/b.txt", 1.0, 1), ("/d.bin", 1.0, 1)], "path string, modified double, size long")
    got = {r.path: r.action for r in live.actions(events, crawl, known, frozenset({"text"})).collect()}
    assert got == {"/a.txt": "delete", "/b.txt": "none", "/c.png": "none", "/d.bin": "delete"}
    samples = spark.createDataFrame([("r", 0.0, 0.0), ("r", 1.0, 10.0), ("r", 2.0, 30.0)], "root string, t double, n double")
    for i in range(3):
        samples.where(F.col("t") == float(i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.smoothed_rates(live.replay(spark, str(tmp_path / "in"), "root string, t double, n double"))
    query = stream.writeStream.format("memory").queryName("rates").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert 15.0 in {r.rate for r in spark.table("rates").collect()}


def test_projection(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(30, 16)) * 0.05 + c for c in rng.normal(size=(3, 16))]).astype(np.float32)
    points = spark.createDataFrame([(i, f"/{i}", v.tolist()) for i, v in enumerate(x)], "id long, path string, vec array<float>").repartition(3)
    mean, top, share = projection.components(points)
    values = np.linalg.eigvalsh(np.cov(x.T.astype(np.float64)))[::-1]
    assert share == pytest.approx(values[:2].sum() / values.sum(), rel=1e-6)
    graph = projection.neighbours(points, points, 5).collect()
    scores = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(scores, -np.inf)
    for r in graph:
        assert r.dst in np.argsort(-scores[r.src], kind="stable")[:6]
    assert len(graph) == 90 * 5
    placed = projection.layout(points, 5, 40).collect()
    where = {int(r.path[1:]): np.array([r.x, r.y]) for r in placed}
    y = np.array([where[i] for i in range(90)])
    assert np.isfinite(y).all()
    blobs = y.reshape(3, 30, 2)
    inside = np.mean([np.linalg.norm(b - b.mean(0), axis=1).mean() for b in blobs])
    between = np.linalg.norm(blobs.mean(1)[0] - blobs.mean(1)[1])
    assert between > inside


def test_map_beyond_the_budget(spark):
    """Only the landmarks are laid out; every point has one place, those of a cluster near each other."""
    rng = np.random.default_rng(4)
    vecs = np.repeat(np.eye(8)[:2], 100, axis=0) + 0.05 * rng.normal(size=(200, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    points = spark.createDataFrame([(i, f"p{i:03}", v.tolist()) for i, v in enumerate(vecs)], "id long, path string, vec array<double>")
    rows = projection.embedding_map(points, 60, 5, 40).collect()
    assert sorted(r.path for r in rows) == [f"p{i:03}" for i in range(200)]
    at = np.array([(r.x, r.y) for r in sorted(rows)])
    marks = [int(j * 200 / 60) for j in range(60)]
    laid = {r.path: (r.x, r.y) for r in projection.layout(points.where(F.col("id").isin(marks)), 5, 40).collect()}
    assert all(np.allclose(at[i], laid[f"p{i:03}"]) for i in marks)
    assert np.isfinite(at).all() and np.linalg.norm(at[:100].mean(0) - at[100:].mean(0)) > at[:100].std()


def test_history(spark):
    rows = [("car", False, 1), ("carpet", False, 2), ("CA", True, 0), ("dog", False, 3), ("do", False, 9), ("Dog", True, 2)]
    items = history.latest(spark.createDataFrame(rows, "query string, bookmarked boolean, last_used long"))
    assert {(r.query, r.bookmarked) for r in history.collapse(items).collect()} == {("carpet", False), ("CA", True), ("dog", True), ("do", False)}
    assert {r.query for r in history.clear(items).collect()} == {"CA", "dog"}
    assert {r.query for r in history.prune(items, 10, cap=1).collect()} == {"CA", "dog", "do"}


def test_serving(spark):
    made = embed.HashEmbedder()
    vec = made.embed([embed.QUERY_PREFIX + "cats"])[0].tolist()
    df = spark.createDataFrame([("/a.txt", 1.0, 1, "text", 0, "s", vec, 0, 0, 0.0, ""), ("/b.png", 1.0, 1, "image", 0, "s", vec, 0, 0, 0.0, "")], CHUNKS)
    got = serving.search({"query": "cats", "filters": {"kinds": ["text"]}}, df, made)["results"]
    assert [r["path"] for r in got] == ["/a.txt"] and got[0]["score"] == pytest.approx(1.0)
    with pytest.raises(serving.Failure):
        serving.search({"query": " "}, df, made)
    reply = serving.rpc({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "cats"}}}, df, made)
    assert len(reply["result"]["structuredContent"]["results"]) == 2
    assert serving.rpc({"id": 2, "method": "nope"}, df, made)["error"]["code"] == -32601
    out = serving.openai_embeddings({"input": ["a", "b c"], "encoding_format": "base64"}, made)
    assert out["usage"]["total_tokens"] == 3 and len(out["data"]) == 2
    assert len(serving.gemini_embeddings({"requests": [{"content": {"parts": [{"text": "x"}]}}]}, made)["embeddings"][0]["values"]) == 64
    assert serving.cohere_embeddings({"texts": ["a"]}, made)["texts"] == ["a"]
    assert serving.authorised("/health", {}, {}, "t") and serving.authorised("/x", {"Authorization": "Bearer t"}, {}, "t") and not serving.authorised("/x", {}, {}, "t")
