"""Crawling: files under roots, with kinds, caps and policies applied before contents are read."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ignore
from ..functions import text as tx
from ..operators.indexing import supported, within_cap
from ..schema import EXTENSIONS
from .walk import PACKAGES, Walk, read_content

def crawl(spark: SparkSession, roots: list[str], enabled: frozenset[str] = frozenset(EXTENSIONS), disabled_extensions: frozenset[str] = frozenset(), policy: str = "", with_content: bool = False, remote: Column | None = None, prune: bool = True) -> DataFrame:
    """(path, modified, size, kind, root[, content]) of the files that an index pass takes.

    Hidden files are left out, files inside packages (directories that are shown
    as one file), and those whose directory below the root, or that themselves,
    the policy ignores. Files for which ``remote`` holds have no content here and
    are left out. Without ``with_content`` no file is read.

    Directories are walked level by level on the executors, and what is left out
    is not entered. For a store that only Spark reaches, ``prune=False`` lists
    everything below the roots by Spark's own file source, with the same result.
    """
    if prune:
        rows, _ = Walk(spark, roots, enabled, disabled_extensions, policy).run()
        rows = rows if remote is None else rows.where(~remote)
        return read_content(rows) if with_content else rows
    rules, out = ignore.parse(policy), None
    for root in roots:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.regexp_replace("path", "^file:/*", "/")
        kind = tx.kind_of(F.col("path"))
        rows = found.select(path.alias("path"), F.unix_micros("modificationTime").cast("double").alias("m"), F.col("length").alias("size"), *(["content"] if with_content else []))
        rows = rows.withColumn("kind", kind).withColumn("modified", F.col("m") / 1e6).drop("m").withColumn("root", F.lit(root))
        below = F.concat(F.lit("/"), F.substring(F.col("path"), F.length(F.regexp_replace(F.lit(root), "^file:/*", "/")) + 1, F.lit(1 << 30)))
        below = F.regexp_replace(below, "^/+", "/")
        rows = rows.where(supported(F.col("path"), enabled, disabled_extensions) & within_cap(F.col("kind"), F.col("size")) & ~below.rlike(r"/\.") & ~F.lower(below).rlike(rf"\.({'|'.join(PACKAGES)})/"))
        if remote is not None:
            rows = rows.where(~remote)
        if rules:
            rows = rows.where(~ignore.ignored_with_ancestors(below, F.lit(False), rules))
        out = rows if out is None else out.unionByName(rows)
    return out


def default_roots(home: str | None = None) -> list[str]:
    """The folders that are indexed when none is named."""
    home = (home or os.path.expanduser("~")).rstrip("/")
    return [f"{home}/{name}" for name in ("Documents", "Downloads", "Desktop")]


def read_text(files: DataFrame) -> DataFrame:
    """(path, text) of files with content; texts are decoded and trimmed, and empty ones left out."""
    return files.select("path", tx.trim(tx.decode(F.col("content"))).alias("text")).where("text <> ''")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, ok): whether a file's MD5 is that in the manifest (path, md5)."""
    return manifest.join(files.select("path", F.md5("content").alias("own")), "path", "left").select("path", F.coalesce(F.col("own") == F.lower("md5"), F.lit(False)).alias("ok"))
