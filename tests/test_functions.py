"""Column functions against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.functions import audio, embed, ignore
from lodeseek.functions import text as tx
from lodeseek.functions import vectors as vx
from lodeseek.operators import telemetry


def one(spark, *columns):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()
    return row[0] if len(columns) == 1 else tuple(row)


def ignored(spark, policy, path, is_dir=False, ancestors=False):
    f = ignore.ignored_with_ancestors if ancestors else ignore.ignored
    return one(spark, f(F.lit(path), F.lit(is_dir), ignore.parse(policy)))


def test_ignore(spark):
    assert ignored(spark, "*.log", "/a/x.LOG")
    assert not ignored(spark, "*.log\n!keep.log", "/a/keep.log")
    assert ignored(spark, "build/", "/a/build", True)
    assert not ignored(spark, "build/", "/a/build")
    assert ignored(spark, "build/", "/a/build/b.txt", ancestors=True)
    assert ignored(spark, "/src/gen", "/src/gen/x.c")
    assert not ignored(spark, "/src/gen", "/a/src/gen/x.c")
    assert ignored(spark, "a/**/z.txt", "/a/z.txt") and ignored(spark, "a/**/z.txt", "/a/b/c/z.txt")
    assert ignored(spark, "logs/**", "/logs/a/b")
    assert ignored(spark, "x[0-9].t", "/x5.t") and not ignored(spark, "x[!0-9].t", "/x5.t")
    assert ignored(spark, "a[b", "/a[b") and ignored(spark, "a?c", "/abc")
    assert ignored(spark, "\\#x", "/#x") and not ignored(spark, "# x", "/x")
    assert not ignored(spark, "", "/x")
    for noise in ("node_modules", ".git"):
        assert ignored(spark, ignore.synthesise(), f"/p/{noise}/a.txt", ancestors=True)
    assert ignored(spark, ignore.synthesise({"text", "audio", "video"}), "/p/a.png")
    assert ignored(spark, ignore.synthesise(disabled_extensions={"csv"}), "/p/a.csv")


def test_chunks(spark):
    text = ("a" * 99 + "\n") * 100
    rows = one(spark, tx.chunks(F.lit(text)))
    assert [r.chunk_index for r in rows] == list(range(7))
    assert all(r.text == text[1600 * i : 1600 * i + 1800] for i, r in enumerate(rows))
    assert rows[1].locator == "Line 17"
    assert [r.locator for r in one(spark, tx.chunks(F.lit("short")))] == [""]
    assert [r.text for r in one(spark, tx.chunks(F.lit("")))] == [""]
    paged = one(spark, tx.chunks(F.lit("x" * 4000), pages=F.array(*map(F.lit, (0, 1500, 3000)))))
    assert [r.locator for r in paged] == ["Page 1", "Page 2", "Page 3"]
    assert {r.locator for r in one(spark, tx.chunks(F.lit("x" * 4000), plain=False))} == {""}
    assert len(one(spark, tx.chunks(F.lit("x" * 203), limit=100))) == 4  # floor of 200, step of one


def test_text_functions(spark):
    assert one(spark, tx.snippet(F.lit("\n\na\tb\n c \n"))) == "a b  c "
    assert one(spark, tx.extension(F.lit("/a.b/c"))) == "" and one(spark, tx.extension(F.lit("/x/.env"))) == ""
    assert one(spark, tx.extension(F.lit("/x/A.Tar.GZ"))) == "gz"
    assert one(spark, tx.kind_of(F.lit("/x/a.JPG")), tx.kind_of(F.lit("/x/a.bin"))) == ("image", None)
    assert one(spark, tx.clock(F.lit(3725.5)), tx.clock(F.lit(59.0)), tx.clock_seconds(F.lit("1:02:05")), tx.clock_seconds(F.lit("x"))) == ("1:02:05", "0:59", 3725, None)
    blob = "é中😀".encode()
    for cap in range(1, len(blob) + 1):
        want = blob[:cap].decode("utf-8", "ignore") if len(blob) >= cap else None
        assert one(spark, tx.decode(F.lit(blob), cap)) == want
    assert one(spark, tx.decode(F.lit("café".encode("latin-1")))) == "café"
    assert [r.locator for r in one(spark, tx.segments(F.lit(500.0)))] == ["0:00", "4:00", "8:00"]
    assert [r.locator for r in one(spark, tx.segments(F.lit(200.0), single=True))] == [""]
    assert one(spark, tx.token_estimate(F.array(F.lit("a b\tc"), F.lit("")))) == 4


def test_vectors(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=64).astype(np.float32)
    column = F.array(*(F.lit(float(x)).cast("float") for x in v))
    bits = v.view(np.uint32)
    want = ((bits + 0x7FFF + (bits >> 16 & 1)) >> 16 << 16).astype(np.uint32).view(np.float32)
    assert one(spark, F.transform(column, vx.bf16)) == want.tolist()
    assert embed.decode_blob(embed.encode_bf16(v), 64).tolist() == want.tolist()
    assert embed.decode_blob(v.tobytes(), 64).tolist() == v.tolist()
    assert embed.decode_blob(b"xx", 64).tolist() == [0.0] * 64
    back = one(spark, vx.dequantise4(vx.quantise4(column)))
    assert np.abs(np.array(back) - v).max() <= (v.max() - v.min()) / 30 + 1e-6
    assert one(spark, vx.normalise(F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, vx.hamming(F.lit(5), F.lit(6))) == 2
    assert one(spark, vx.distinct_frames(F.array(*(F.lit(x).cast("long") for x in (0, 1, 0xFFFF, 0xFFF0))))) == [0, 2]
    assert one(spark, vx.smart_resize(F.lit(1000), F.lit(1000))).asDict() == {"height": 992, "width": 992}


def test_embedder():
    vectors = embed.HashEmbedder().embed(["a", "b", ""])
    assert vectors.shape == (3, 64) and np.allclose((vectors**2).sum(1), 1, atol=1e-5)
    assert not np.allclose(vectors[0], vectors[1])


def test_audio():
    t = np.arange(16_000) / 16_000
    mel = audio.log_mel(np.sin(2 * np.pi * 440 * t).astype(np.float32))
    assert mel.shape == (128, 100) and np.isfinite(mel).all()
    peak = audio.filters()[mel.mean(1).argmax()].argmax() * 8000 / 200
    assert abs(peak - 440) < 80
    assert audio.log_mel(np.zeros(300, np.float32)) is None
    assert len(audio.resample(np.ones((2, 48_000)), 48_000)) == 16_000


def test_versions_and_rates(spark):
    newer = [("1.2", "1.1.9", True), ("1.2", "1.2.0", False), ("1.10", "1.9", True), ("1.x", "1.0", False)]
    for a, b, want in newer:
        assert one(spark, telemetry.is_newer(F.lit(a), F.lit(b))) is want
    assert one(spark, telemetry.release_year(F.lit("Apple M3 Ultra")), telemetry.release_year(F.lit("M3")), telemetry.release_year(F.lit("Z80"))) == (2025, 2023, None)
    times = ((0.0, 0.0), (0.2, 5.0), (1.0, 10.0), (2.0, 10.0), (3.0, 30.0))
    samples = spark.createDataFrame([(k, t, n) for k in ("a", "b") for t, n in times] + [("c", 1.0, 1.0)], "root string, t double, n double")
    assert {r.root: r.rate for r in telemetry.smoothed(samples, "root").collect()} == {"a": pytest.approx(15.0), "b": pytest.approx(15.0), "c": None}
