"""Operators that keep no group, table or matrix in one place, against plain results."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.operators import projection, search, telemetry


def test_medians_of_any_values(spark):
    rng = random.Random(2)
    values = [0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 3.25, 3.25]
    rows = [("all", rng.choice(values), rng.gauss(0, 1e6)) for _ in range(3001)] + [("even", float(k), None) for k in range(10)] + [("one", -7.0, 2.0), (None, 4.0, float("nan")), (None, 6.0, 1.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(6)
    found = {r.g: (r.a, r.b) for r in telemetry.medians(df, ["g"], ["a", "b"]).collect()}
    assert found.keys() == {"all", "even", "one", None, "none"}
    for g, (a, b) in found.items():
        for got, k in ((a, 1), (b, 2)):
            own = [r[k] for r in rows if r[0] == g and r[k] is not None and r[k] == r[k]]
            assert got == (np.median(own) if own else None)


def test_reports_do_not_depend_on_how_medians_are_found(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice(["M1", "M2", None]), rng.choice(["1.0", "1.1", None]), rng.random(), rng.random() * 9, k * 10, rng.choice([None, rng.random()]), None) for k in range(400)]
    df = spark.createDataFrame(rows, "run_id long, chip string, app_version string, files_per_sec double, tokens_per_sec double, created_at long, seconds double, vram_delta double")
    one, two = (sorted(telemetry.by_chip_and_version(df, n).select("chip", "app_version", "level", "runs", "median_files", "median_tokens", "median_seconds", "median_vram", "std_files").collect(), key=str) for n in (10**6, 0))
    assert len(one) == len(two) == 15
    for a, b in zip(one, two, strict=True):
        assert a[:4] == b[:4] and list(a[4:]) == pytest.approx(list(b[4:]))


def test_subspace_captures_the_variance(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 30)) * np.linspace(4, 0.5, 30) + 5
    df = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>").repartition(5)
    mean, top, share = projection.subspace(df, 2)
    _, exact, known = projection.components(df, 2)
    assert np.allclose(mean, x.mean(0)) and share >= 0.999 * known and np.abs((top * exact).sum(1)).min() > 0.999
    assert projection.subspace(df, 2, passes=1) is None
    by_width = projection.components(df, 2, widest=8)
    assert np.allclose(by_width[1], top) and by_width[2] == pytest.approx(share)


def test_batches_of_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    chunks = spark.createDataFrame([(f"/f{i // 2}", i % 2, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 4)))], "path string, chunk_index int, vec array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 4)))], "query_id int, vec array<double>")
    found = lambda: sorted((r.query_id, r["rank"], r.path, round(r.score, 9), r.chunk_index, r.chunk_count) for r in search.search_batch(chunks, asked, 3).collect())
    whole = found()
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert found() == whole and len(whole) == 27


def test_dealt_neighbours_with_ties_and_broken_vectors(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [float(rng.randrange(3)) for _ in range(3)]) for i in range(120)] + [(500, [float("nan"), 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vec array<double>").repartition(4)
    whole = sorted(map(tuple, projection.neighbours(df, df, 6).collect()))
    monkeypatch.setattr(projection, "BLOCK_BYTES", 700)
    monkeypatch.setattr(projection, "_SCORES", 64)
    assert sorted(map(tuple, projection.neighbours(df, df, 6).collect())) == whole
    want = []
    for i, v in rows[:-1]:
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows[:-1] if j != i)[:6]
        want += [(i, j, k, -s) for k, (s, j) in enumerate(near, 1)]
    assert whole == sorted(want)
    assert projection.neighbours(df, df.where("id < 0"), 6).count() == 0


def test_file_vectors_of_odd_tables(spark):
    rng = np.random.default_rng(8)
    rows = [(f"/f{i % 13}", i, rng.normal(size=5).tolist()) for i in range(300)] + [("/zero", 0, [1.0] * 5), ("/zero", 1, [-1.0] * 5), ("/null", 0, None), ("/short", 0, [1.0])]
    df = spark.createDataFrame(rows, "path string, chunk_index int, vec array<float>").repartition(7)
    got = {r.path: r.vec for r in search.file_vectors(df).collect()}
    assert got.keys() == {f"/f{k}" for k in range(13)}
    for k in range(13):
        mean = np.mean([np.float32(v) for p, _, v in rows if p == f"/f{k}"], 0)
        assert np.allclose(got[f"/f{k}"], mean / np.linalg.norm(mean), atol=1e-6)
    assert search.file_vectors(df.where("path = '/null'")).count() == 0 and search.file_vectors(df.limit(0)).count() == 0


def test_maps_keep_to_their_budget_and_cap(spark):
    assert projection.point_cap(6, 768) == 125_829 and projection.point_cap(0.01, 768) == 2000 and projection.point_cap(64, 256) == 250_000
    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(i, f"/p{i:03}", v.tolist()) for i, v in enumerate(rng.normal(size=(150, 6)))], "id long, path string, vec array<double>")
    rows = projection.embedding_map(points, 60, 5, 10, cap=100).collect()
    marks = {f"/p{int(j * 2.5):03}" for j in range(60)}
    assert len(rows) == len({r.path for r in rows}) == 100 and marks <= {r.path for r in rows}
    chunks = points.select("path", F.lit("text").alias("kind"), F.lit(0).alias("chunk_index"), "vec").withColumn("path", F.concat(F.lit("/m"), "path"))
    assert projection.folder_map(chunks, "/m", epochs=5, capacity_gb=1).count() == 150


def test_file_vectors_do_not_take_stored_ones(spark):
    with pytest.raises(TypeError):
        search.file_vectors(spark.createDataFrame([("/a", bytearray(b"xx"))], "path string, vec binary"))
