"""Column expressions on vectors (arrays of float); sums run in double, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product; for unit vectors, the cosine."""
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def normalise(a: Column) -> Column:
    """``a`` scaled to length 1; null where it is null or its length is 0."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def all_finite(a: Column) -> Column:
    return F.forall(a, lambda x: finite(x.cast("double")))


def truncate(a: Column, k: int) -> Column:
    """The first ``k`` dimensions, scaled to length 1."""
    return normalise(F.slice(a, 1, k))


def bf16(x: Column) -> Column:
    """``x`` with 8 bits of precision, halves to even; zero and non-finite values stay."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.abs(x.cast("double")))) - 7)
    return F.when((x == 0) | ~finite(x.cast("double")), x.cast("double")).otherwise(F.rint(x.cast("double") / step) * step)


def quantise4(a: Column, group: int = 64) -> Column:
    """Per group of dimensions: (scale, bias, codes 0 to 15); a constant group has scale 0 and codes 0."""

    def of(start: Column) -> Column:
        part = F.transform(F.slice(a, start, F.lit(group)), lambda x: x.cast("double"))
        low, scale = F.array_min(part), (F.array_max(part) - F.array_min(part)) / 15
        code = lambda x: F.when(scale == 0, 0).otherwise(F.least(F.greatest(F.rint((x - low) / scale), F.lit(0.0)), F.lit(15.0))).cast("int")
        return F.struct(scale.alias("scale"), low.alias("bias"), F.transform(part, code).alias("codes"))

    return F.transform(F.sequence(F.lit(1), F.size(a), F.lit(group)), of)


def dequantise4(groups: Column) -> Column:
    return F.flatten(F.transform(groups, lambda g: F.transform(g.codes, lambda c: c * g.scale + g.bias)))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit values differ."""
    return F.bit_count(a.bitwiseXOR(b))


def average_hash(gray: Column) -> Column:
    """64-bit hash of 64 gray levels: a bit is set where the level is above the integer mean."""
    mean = F.floor(F.aggregate(gray, F.lit(0).cast("long"), lambda a, x: a + x) / F.size(gray))
    bits = F.transform(gray, lambda x, i: F.when(x > mean, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def distinct_frames(hashes: Column, apart: int = 8) -> Column:
    """Indices of the frames whose hash differs in ``apart`` bits or more from every frame kept before."""

    def step(kept: Column, i: Column) -> Column:
        near = F.exists(kept, lambda k: hamming(F.element_at(hashes, (k + 1).cast("int")), F.element_at(hashes, (i + 1).cast("int"))) < apart)
        return F.when(near, kept).otherwise(F.concat(kept, F.array(i)))

    return F.aggregate(F.sequence(F.lit(0), F.size(hashes) - 1), F.array().cast("array<int>"), step)


def frame_times(start: Column, end: Column, n: int) -> Column:
    """``n`` instants at the middles of equal parts of [start, end]."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * (i + 0.5) / n)


def smart_resize(height: Column, width: Column, factor: int = 32, least: int = 262_144, most: int = 1_310_720) -> Column:
    """(height, width) rounded to multiples of ``factor`` and scaled so that the area is within bounds."""
    h = F.greatest(F.lit(factor), F.rint(height / factor) * factor)
    w = F.greatest(F.lit(factor), F.rint(width / factor) * factor)
    shrink, grow = F.sqrt(height * width / most), F.sqrt(least / (height * width))
    down = lambda x: F.greatest(F.lit(factor), F.floor(x / shrink / factor) * factor)
    up = lambda x: F.ceil(x * grow / factor) * factor
    pick = lambda x, y: F.when(h * w > most, down(x)).when(h * w < least, up(x)).otherwise(y).cast("int")
    return F.struct(pick(height, h).alias("height"), pick(width, w).alias("width"))
