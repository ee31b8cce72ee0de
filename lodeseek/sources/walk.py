"""Walking directories level by level on the executors.

A frontier of directories is dealt out, each is listed by a task, what may be
entered of what was found is the next frontier, dealt anew. Hidden directories,
packages and ignored directories are never listed, so a tree that the policy
leaves out costs one entry. The driver counts a level's directories and sees
none of them. Levels are written to the shared folder: a directory is listed once,
also where an executor is lost later.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ignore
from ..functions import text as tx
from ..operators.indexing import supported, within_cap
from ..operators.search import in_folder
from ..schema import EXTENSIONS, TEXT_CAP
from .shared import shared_folder

#: Extensions of directories that are shown as one file.
PACKAGES = "app bundle framework plugin kext photoslibrary xcodeproj xcworkspace rtfd pages key numbers".split()
#: Directories that a task lists.
PER_TASK = 500

_FOUND = "root string, path string, is_dir boolean, size long, modified double"
_NAMES = ["root", "path", "is_dir", "size", "modified"]


def _local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _system(path: str) -> tuple[fs.FileSystem, str]:
    path = _local(path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _rows(root: str, infos: list[fs.FileInfo], local: bool) -> Iterator[tuple]:
    for x in infos:
        # A link could lead out of the root, or round in a circle.
        if x.type in (fs.FileType.File, fs.FileType.Directory) and not (local and os.path.islink(x.path)):
            yield root, x.path, x.type == fs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1_000_000 / 1e3


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=_NAMES)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of directories (root, path); those that cannot be listed, or are gone meanwhile, have none."""
    for batch in batches:
        for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                system, own = _system(path)
                infos = system.get_file_info(fs.FileSelector(own))
            except OSError:
                continue
            rows = list(_rows(root, infos, isinstance(system, fs.LocalFileSystem)))
            for at in range(0, len(rows), 10_000):
                yield _batch(rows[at : at + 10_000])


def _stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is at paths (root, path); nothing where nothing is."""
    for batch in batches:
        rows = []
        for root, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                system, own = _system(path)
                rows += _rows(root, system.get_file_info([own]), isinstance(system, fs.LocalFileSystem))
            except OSError:
                continue
        yield _batch(rows)


class Walk:
    """What a walk takes: kinds, extensions and a policy, below some roots."""

    def __init__(self, spark: SparkSession, roots: list[str], enabled: frozenset[str] = frozenset(EXTENSIONS), disabled_extensions: frozenset[str] = frozenset(), policy: str = ""):
        self.spark, self.roots = spark, [_local(r).rstrip("/") or "/" for r in roots]
        self.enabled, self.disabled, self.rules = enabled, disabled_extensions, ignore.parse(policy)

    def _below(self) -> Column:
        """A path from its root on, with a leading slash."""
        return F.concat(F.lit("/"), F.regexp_replace(F.substr("path", F.length("root") + 1), "^/+", ""))

    def _may_enter(self) -> Column:
        below = self._below()
        return ~below.rlike(r"/\.") & ~F.lower(below).rlike(rf"\.({'|'.join(PACKAGES)})(/|$)") & ~self._ignored(below, F.lit(True))

    def _may_take(self) -> Column:
        below, kind = self._below(), tx.kind_of(F.col("path"))
        return supported(F.col("path"), self.enabled, self.disabled) & within_cap(kind, F.col("size")) & ~below.rlike(r"/\.") & ~F.lower(below).rlike(rf"\.({'|'.join(PACKAGES)})/") & ~self._ignored(below, F.lit(False))

    def _ignored(self, below: Column, is_dir: Column) -> Column:
        return ignore.ignored_with_ancestors(below, is_dir, self.rules) if self.rules else F.lit(False)

    def _files(self, found: DataFrame) -> DataFrame:
        return found.where(~F.col("is_dir") & self._may_take()).select("path", "modified", "size", tx.kind_of(F.col("path")).alias("kind"), "root")

    def levels(self, frontier: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(files, directories that were listed) from a frontier (root, path) on, by as many rounds as there are levels."""
        folder, files, listed, level = shared_folder(self.spark), [], [], 0
        n = frontier.count()
        while n:
            entered = frontier.repartition(max(1, -(-n // PER_TASK)))
            found = entered.mapInArrow(_list, _FOUND)
            found = found.where(F.when(F.col("is_dir"), self._may_enter()).otherwise(self._may_take()))
            found.write.parquet(f"{folder}/level-{level}")
            found = self.spark.read.schema(_FOUND).parquet(f"{folder}/level-{level}")
            files.append(self._files(found))
            listed.append(frontier)
            frontier, level = found.where("is_dir").select("root", "path"), level + 1
            n = frontier.count()
        empty = self.spark.createDataFrame([], _FOUND)
        all_files, all_listed = self._files(empty), empty.select("root", "path")
        for a, b in zip(files, listed, strict=True):
            all_files, all_listed = all_files.unionByName(a), all_listed.unionByName(b)
        return all_files, all_listed

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(files, directories that were listed) of all roots."""
        return self.levels(self.spark.createDataFrame([(r, r) for r in self.roots], "root string, path string"))

    def look(self, paths: DataFrame) -> DataFrame:
        """The files at or below paths, which are looked at one by one; a path outside the roots, or where the walk would not come, has none.

        This is what ``index_pass.update`` asks for a batch of change events.
        """
        root = F.coalesce(*(F.when(in_folder(F.col("path"), r), F.lit(r)) for r in self.roots))
        asked = paths.select(root.alias("root"), "path").where("root is not null").distinct()
        folder = shared_folder(self.spark)
        asked.mapInArrow(_stat, _FOUND).write.parquet(f"{folder}/stat")
        found = self.spark.read.schema(_FOUND).parquet(f"{folder}/stat")
        below, _ = self.levels(found.where(F.col("is_dir") & ((F.col("path") == F.col("root")) | self._may_enter())).select("root", "path"))
        # Of nested touched folders, a file is found under each.
        return self._files(found).unionByName(below).dropDuplicates(["path"])


def read_content(files: DataFrame) -> DataFrame:
    """``files`` with content: of text the bytes that are used of it, of other kinds all; files that are gone meanwhile are left out."""
    schema = files.select("*", F.lit(None).cast("binary").alias("content")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (path, kind) in enumerate(zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True)):
                try:
                    system, own = _system(path)
                    with system.open_input_stream(own) as stream:
                        content = stream.read(TEXT_CAP) if kind == "text" else stream.read()
                except OSError:
                    continue
                # A file a batch: contents may be large.
                yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns, pa.array([content], pa.binary())], names=[*batch.schema.names, "content"])

    return files.mapInArrow(run, schema)


def write_files(files: DataFrame) -> DataFrame:
    """(path) of files (path, content), each written by the task that has it when the result is used; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                system, own = _system(path)
                folder = own.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(own) as stream:
                    stream.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("path")], names=["path"])

    return files.select("path", "content").mapInArrow(run, "path string")
