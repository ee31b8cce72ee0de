"""Telemetry of profiling runs: validation, rate limit, groupings, versions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.shared import shared_folder

#: Bounds of a report's fields, dataset versions, accepted reports an address and hour.
BOUNDS = {"files": 200_000, "scanned": 200_000, "failed": 200_000, "seconds": 86_400, "error_rate": 1, "vram_delta": 1e15, "memory": 1e15, "cores": 4096}
RATES = ["files_per_sec", "tokens_per_sec"]
DATASETS, HOURLY = ["v1", "v2"], 20
#: Values of a group that a task may hold for a median.
BUFFERED = 1_000_000
#: Release year by the first of these that a chip's name contains.
CHIP_YEARS = [
    ("M1 Ultra", 2022), ("M1 Pro", 2021), ("M1 Max", 2021), ("M1", 2020),
    ("M2 Ultra", 2023), ("M2 Pro", 2023), ("M2 Max", 2023), ("M2", 2022),
    ("M3 Ultra", 2025), ("M3 Pro", 2023), ("M3 Max", 2023), ("M3", 2023),
    ("M4 Ultra", 2025), ("M4 Pro", 2024), ("M4 Max", 2024), ("M4", 2024),
    ("M5", 2025),
]


def release_year(chip: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, year in reversed(CHIP_YEARS):
        out = F.when(F.contains(chip, F.lit(name)), year).otherwise(out)
    return out


def version_key(version: Column) -> Column:
    """Sort key of a dotted version: its numbers in order; a part that is none sorts lowest."""
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version ``a`` is later than ``b``; missing and other parts count as 0."""
    number = lambda v: F.transform(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    longest = F.greatest(F.size(number(a)), F.size(number(b)))
    pad = lambda v: F.concat(number(v), F.array_repeat(F.lit(0), longest - F.size(number(v))))
    return pad(a) > pad(b)


def valid(columns: list[str]) -> Column:
    """Whether a report's fields, as far as it has them, are within bounds."""
    out = F.lit(True)
    for c, most in BOUNDS.items():
        if c in columns:
            out &= F.coalesce(F.col(c).between(0, most), F.lit(False))
    for c in RATES:
        if c in columns:
            out &= F.coalesce((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) < float("inf")), F.lit(False))
    if "run_id" in columns:
        out &= F.length(F.col("run_id").cast("string")).between(8, 64)
    if "dataset" in columns:
        out &= F.col("dataset").isin(DATASETS)
    if "year" in columns:
        out &= F.col("year").isNull() | F.col("year").between(1990, 2100)
    return out


def limited(runs: DataFrame, most: int = HOURLY) -> DataFrame:
    """``runs`` with hour and allowed: the first ``most`` of each ip_hash and hour."""
    hour = runs.withColumn("hour", F.floor(F.col("created_at") / 3_600_000))
    place = F.row_number().over(Window.partitionBy("ip_hash", "hour").orderBy("created_at", "run_id"))
    return hour.withColumn("allowed", place <= most)


def first_of_run(runs: DataFrame, *ties: str) -> DataFrame:
    """The first row of each run_id by created_at, then by the columns ``ties``: the least combines before the shuffle, however often a run comes."""
    first = F.min_by(F.struct(*runs.columns), F.struct("created_at", *ties)).alias("row")
    return runs.groupBy("run_id").agg(first).select("row.*")


def half_up(x: Column, digits: int = 1) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


@F.arrow_udf(T.LongType())
def _sortable(x: pa.Array) -> pa.Array:
    """Whole numbers in the order of the doubles: negative ones have their other bits turned round."""
    bits = x.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), mask=x.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.DoubleType())
def _unsorted(x: pa.Array) -> pa.Array:
    bits = x.to_numpy(zero_copy_only=False)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64))


def medians(rows: DataFrame, by: list[str], values: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """(by..., values...): the exact median of each column of each group, null where it has no value.

    The middle values are found by four rounds over 16 bits of them: a round has a
    row for each of at most 65,536 digits of a group and column, whatever the
    group's size, and its counts combine before the shuffle; no values are
    shuffled or held. With ``sets`` of columns, there are groups of each set, as
    for GROUPING SETS: the columns that are not in it are null, and ``gid`` is the
    set's place.
    """
    spark, work = rows.sparkSession, shared_folder(rows.sparkSession)
    levels = F.array(*(F.struct(F.lit(i).alias("gid"), *(F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in by)) for i, keys in enumerate(sets or [by])))
    # -0.0 is 0.0; a value that is none has no key.
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + F.lit(0.0)) for c in values]
    rows.select(levels.alias("levels"), F.array(*map(_sortable, clean)).alias("keys")).write.parquet(f"{work}/keyed")
    keyed = spark.read.parquet(f"{work}/keyed")
    long = keyed.select("levels", F.posexplode("keys").alias("which", "key")).where("key is not null").select("which", "key", F.explode("levels").alias("g"))
    asked = None
    for shift in (48, 32, 16, 0):
        # Of the first round, the digit has the sign; of the others, it is below 65,536.
        here = long.select("g", "which", (F.shiftright("key", shift + 16) if shift < 48 else F.lit(0).cast("long")).alias("high"), (F.shiftright("key", shift) if shift == 48 else F.shiftright("key", shift).bitwiseAND(0xFFFF)).alias("digit"))
        if asked is not None:
            here = here.join(asked.select("g", "which", "high").distinct(), ["g", "which", "high"], "left_semi")
        here.groupBy("g", "which", "high", "digit").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{work}/digits-{shift}")
        digits = spark.read.parquet(f"{work}/digits-{shift}")
        if asked is None:  # the ranks of the one or two middle values
            sizes = digits.groupBy("g", "which").agg(F.sum("n").alias("n"))
            asked = sizes.select("g", "which", F.explode(F.array_distinct(F.array(F.expr("(n + 1) div 2"), F.expr("n div 2 + 1")))).alias("rank"), F.lit(0).cast("long").alias("high"))
            asked = asked.withColumn("left", F.col("rank"))
        until = F.sum("n").over(Window.partitionBy("g", "which", "high").orderBy("digit"))
        found = digits.withColumn("until", until).join(asked, ["g", "which", "high"]).where((F.col("until") >= F.col("left")) & (F.col("until") - F.col("n") < F.col("left")))
        whole = F.col("digit") if shift == 48 else F.shiftleft("high", 16).bitwiseOR(F.col("digit"))
        asked = found.select("g", "which", "rank", whole.alias("high"), (F.col("left") - F.col("until") + F.col("n")).alias("left"))
        asked.write.parquet(f"{work}/round-{shift}")
        asked = spark.read.parquet(f"{work}/round-{shift}")
    middle = asked.groupBy("g", "which").agg(F.avg(_unsorted("high")).alias("m"))
    out = middle.groupBy("g").agg(*(F.max(F.when(F.col("which") == i, F.col("m"))).alias(c) for i, c in enumerate(values)))
    groups = keyed.select(F.explode("levels").alias("g")).distinct()
    found = groups.join(out, "g", "left").select("g.*", *values)
    return found if sets else found.drop("gid")


def _newest(named: DataFrame, grouped: DataFrame, values: list[str]) -> DataFrame:
    """``grouped`` (gid, chip, app_version, newest_<value>: the time of the newest run that has it) with these runs' values; of one time, the last run_id's."""
    keys = ["gid", "chip", "app_version"]
    levels = F.array(*(F.struct(F.lit(gid).cast("long").alias("gid"), *(F.col(c) if c in own else F.lit(None).cast("string").alias(c) for c in keys[1:])) for gid, own in _LEVELS))
    times = grouped.select(*(F.col(c).alias(f"__{c}") for c in keys), *(f"newest_{c}" for c in values))
    runs = named.select("created_at", "run_id", *values, F.explode(levels).alias("g")).select("created_at", "run_id", *values, "g.*")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys))
    is_newest = {c: F.col(c).isNotNull() & F.col("created_at").eqNullSafe(F.col(f"newest_{c}")) for c in values}
    few = runs.join(times, same).where(reduce(lambda a, b: a | b, is_newest.values()))
    found = few.groupBy(*(F.col(c).alias(f"__{c}") for c in keys)).agg(*(F.max_by(c, F.when(is_newest[c], F.struct("run_id"))).alias(c) for c in values))
    return grouped.drop(*(f"newest_{c}" for c in values)).join(found, same, "left").drop(*(f"__{c}" for c in keys))


#: (grouping id, columns) of the levels chip, chip_version and version.
_LEVELS = [(1, ["chip"]), (0, ["chip", "app_version"]), (2, ["app_version"])]


def by_chip_and_version(runs: DataFrame, buffered: int = BUFFERED) -> DataFrame:
    """(chip, app_version, level, runs, medians, deviations, ...) for chips, their versions, and versions.

    Levels are chip, chip_version and version; a run without a chip counts as
    Unknown, without a version as ?. Release year, memory and video memory are
    those of the newest run that has them, and ``systems`` the system versions,
    the newest run's first. Columns that ``runs`` lacks are null. Values that are
    not finite count as none. Where a group could have more than ``buffered``
    values, its medians come from ``medians``, which holds no group in one place.
    All else is numbers that combine in a hash table, so no run is sorted.
    """
    have = set(runs.columns)
    known = [c if c in have else F.lit(None).cast(t).alias(c) for c, t in (("seconds", "double"), ("vram_delta", "double"), ("release_year", "int"), ("mem_bytes", "long"), ("vram_bytes", "long"), ("system", "string"))]
    clean = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    named = runs.select(F.coalesce("chip", F.lit("Unknown")).alias("chip"), F.coalesce("app_version", F.lit("?")).alias("app_version"), clean("files_per_sec").alias("f"), clean("tokens_per_sec").alias("t"), "created_at", "run_id", *known)
    seen = F.array_sort(F.collect_list(F.struct((-F.col("created_at")).alias("order"), "system")))
    systems = named.where("system is not null").groupBy("chip", "system").agg(F.max("created_at").alias("created_at")).groupBy("chip").agg(F.transform(seen, lambda x: x.system).alias("systems"))
    middles = {"f": "median_files", "t": "median_tokens", "seconds": "median_seconds", "vram_delta": "median_vram"}
    newest = ["release_year", "mem_bytes", "vram_bytes"]
    few = runs.count() <= buffered
    sets = named.groupingSets([[F.col("chip")], [F.col("chip"), F.col("app_version")], [F.col("app_version")]], "chip", "app_version")
    grouped = sets.agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("runs"),
        *(F.percentile(c, 0.5).alias(x) for c, x in middles.items() if few),
        F.stddev_samp("f").alias("std_files"),
        F.stddev_samp("t").alias("std_tokens"),
        *(F.max(F.when(F.col(c).isNotNull(), F.col("created_at"))).alias(f"newest_{c}") for c in newest),
        F.max("created_at").alias("last"),
    )
    grouped.write.parquet(path := shared_folder(runs.sparkSession))  # a row a group: its size is known to the joins
    grouped = _newest(named, runs.sparkSession.read.schema(grouped.schema).parquet(path), newest)
    if not few:
        found = medians(named.select("chip", "app_version", *middles), ["chip", "app_version"], list(middles), [keys for _, keys in _LEVELS])
        gid = F.element_at(F.array(*(F.lit(gid).cast("long") for gid, _ in _LEVELS)), F.col("gid") + 1)
        own = [f"__{c}" for c in ("gid", "chip", "app_version")]
        found = found.select(gid.alias("__gid"), *(F.col(c[2:]).alias(c) for c in own[1:]), *(F.col(c).alias(x) for c, x in middles.items()))
        same = reduce(lambda a, b: a & b, (F.col(c[2:]).eqNullSafe(F.col(c)) for c in own))
        grouped = grouped.join(found, same, "left").drop(*own)
    level = F.element_at(F.create_map(F.lit(1), F.lit("chip"), F.lit(0), F.lit("chip_version"), F.lit(2), F.lit("version")), F.col("gid").cast("int"))
    return grouped.withColumn("level", level).drop("gid").join(systems.withColumn("level", F.lit("chip")), ["chip", "level"], "left")


def report(runs: DataFrame) -> DataFrame:
    """``by_chip_and_version`` with place: chips by their runs, most first; versions, of a chip or of all, newest first."""
    found = by_chip_and_version(runs)
    newest = F.when(F.col("level") != "chip", version_key(F.col("app_version")))
    order = Window.partitionBy("level", F.when(F.col("level") == "chip_version", F.col("chip"))).orderBy(F.when(F.col("level") == "chip", -F.col("runs")), F.desc(newest), "chip")
    return found.withColumn("place", F.row_number().over(order))


def recent(runs: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` newest runs, with rates and seconds rounded as they are shown."""
    top = runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(n)
    shown = {"files_per_sec": half_up(F.col("files_per_sec")), "tokens_per_sec": half_up(F.col("tokens_per_sec"), 0).cast("long"), "seconds": half_up(F.col("seconds")) if "seconds" in runs.columns else F.lit(None).cast("double")}
    return top.withColumns(shown)


def throughput(total: Column, failed: Column, scanned: Column, tokens: Column, seconds: Column) -> Column:
    """(files_per_sec, tokens_per_sec, error_rate) of a pass."""
    s = F.greatest(seconds, F.lit(1e-4))
    return F.struct((total / s).alias("files_per_sec"), (tokens / s).alias("tokens_per_sec"), F.when(scanned > 0, failed / scanned).otherwise(0.0).alias("error_rate"))


def budget(capacity_gb: Column, anchor: float, floor: float, ceiling: float) -> Column:
    return F.greatest(F.least(F.floor(capacity_gb / 6 * anchor), F.lit(ceiling)), F.lit(floor))


def smoothed(samples: DataFrame, key: str, least_gap: float = 0.4) -> DataFrame:
    """(key, rate) of samples (key, t, n): gaps below ``least_gap`` wait, no change holds, the first rate is taken as it is.

    Samples come sorted to their task and are folded one after another, so a
    long history is never held in one row; a key has a row however many it has.
    """
    schema = T.StructType([samples.schema[key], T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, done = None, None, []  # last: time, number, rate
        for batch in batches:
            for k, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is None or k != own:
                    if last is not None:
                        done.append((own, last[2]))
                    own, last = k, (t, n, None)
                elif t - last[0] >= least_gap:
                    now = (n - last[1]) / (t - last[0])
                    last = (t, n, last[2] if n == last[1] else now if last[2] is None else last[2] * 0.5 + now * 0.5)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip((key, "rate"), x, strict=True)) for x in done], to_arrow_schema(schema))
                done = []
        if last is not None:
            yield pa.RecordBatch.from_pylist([{key: own, "rate": last[2]}], to_arrow_schema(schema))

    return samples.select(key, F.col("t").cast("double"), F.col("n").cast("double")).repartition(key).sortWithinPartitions(key, "t", "n").mapInArrow(run, schema)


def progress(scanned: DataFrame, finished: DataFrame) -> DataFrame:
    """(root, done, total, fraction) of files (root, path) and those finished (path); a root without files has fraction 0."""
    marked = scanned.join(finished.select("path", F.lit(1).alias("ok")).distinct(), "path", "left")
    found = marked.groupBy("root").agg(F.count("ok").alias("done"), F.count("path").alias("total"))
    return found.withColumn("fraction", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0))
