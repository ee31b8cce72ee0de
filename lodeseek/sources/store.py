"""The durable index: versioned Parquet snapshots, a delta beside the newest one, and a manifest of key-value pairs.

A version is written in full before the manifest names it, so readers see
either the old or the new one; chunks and content keys change in one version.
Reading and writing go through Spark and its file systems only.

The base of the chunks is sorted by path, that of the content keys by key, and
beside each is a table of the range of every file. ``rows_at``, ``at_or_below`` and
``keys_for`` open the files that a batch touches, and the delta, which is bounded;
what they read does not grow with the index. When a delta has many steps, they are
merged into one, a sorted run with ranges of its own; only when the runs are a tenth
of the base is the base written anew, so a row is written a bounded number of times.

A packed store keeps vectors in two bytes a number, as binary, and beside its base
a replica in four bits a number, for searches that choose candidates first. A counted
store carries the counters of its files and chunks from version to version; a change
reads the rows of its own paths to move them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import packed as pk
from ..operators import indexing
from ..schema import CHUNKS, DEAD_SHARE, FOLD_ROWS, KEYS

SCHEMA_VERSION = 2
#: Paths or keys that are looked up by ranges, and files that are named one by one; more of them read all files. The result is the same.
LOOKUP, NAMED = 10_000, 10_000
#: Steps of a delta before they are merged into a run, and the share of the base at which runs are folded into it.
STEPS, RUNS_SHARE = 32, 0.1

#: (prefix in the manifest, layout, order) of what the store holds.
_LAYERS = {"chunks": ("", CHUNKS, ["path", "chunk_index"]), "keys": ("keys_", KEYS, ["key", "path"])}
_NOTHING = {"base": [], "delta": [], "ranges": None, "rows": 0, "delta_rows": 0, "keys_base": [], "keys_delta": [], "keys_ranges": None, "keys_rows": 0, "keys_delta_rows": 0, "codes": None, "counters": None}
_PACKED = T.StructType([T.StructField("vec", T.BinaryType()) if f.name == "vec" else f for f in CHUNKS])


class Store:
    def __init__(self, spark: SparkSession, root: str, packed: bool = False, counted: bool = False):
        self.spark, self.root, self.packed, self.counted = spark, root.rstrip("/"), packed, counted
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # The manifest: the last complete one by number.

    def manifest(self) -> dict:
        base = self._path(f"{self.root}/manifest")
        if not self._fs.exists(base):
            return {"version": 0, "meta": {}, "schema": SCHEMA_VERSION} | _NOTHING
        return self._migrated(self._read(self._manifests()[-1]))

    def _manifests(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/manifest")))

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifest/{name}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    @staticmethod
    def _migrated(manifest: dict) -> dict:
        """An index of another layout is empty, chunks and content keys, and made anew; columns that were added since get their defaults when read."""
        if manifest.get("schema") == SCHEMA_VERSION:
            return manifest
        return manifest | _NOTHING | {"dim": None, "schema": SCHEMA_VERSION}

    def _commit(self, manifest: dict) -> None:
        manifest = manifest | {"version": manifest["version"] + 1}
        hidden = self._path(f"{self.root}/_{uuid.uuid4().hex}")
        stream = self._fs.create(hidden)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        jvm, target = self.spark._jvm, self._path(f"{self.root}/manifest/{manifest['version']:012d}")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:  # refused if the version is there already
            context.rename(self._fs.makeQualified(hidden), self._fs.makeQualified(target), none)
        except Py4JJavaError as error:
            self._fs.delete(hidden, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise RuntimeError("another writer committed this version") from None
            raise

    def get(self, key: str) -> str | None:
        return self.manifest()["meta"].get(key)

    def set(self, key: str, value: str) -> None:
        m = self.manifest()
        self._commit(m | {"meta": m["meta"] | {key: value}})

    # Reading.

    def chunks(self, dim: int | None = None) -> DataFrame:
        """All live chunks; those of another dimension than the index's are skipped."""
        m = self.manifest()
        return self._of_dimension(self._layer(m, "chunks"), dim or m.get("dim"))

    def packed_chunks(self) -> DataFrame:
        """All live chunks of a packed store with vec as it is stored, for ``search``, which multiplies it where it is."""
        return self._layer(self.manifest(), "chunks", raw=True)

    def keys(self) -> DataFrame:
        """The content key of each path that has one."""
        return self._layer(self.manifest(), "keys")

    def rows_at(self, paths: DataFrame, dim: int | None = None) -> DataFrame:
        """The chunks of these paths."""
        asked = self._kept_paths(paths)
        m = self.manifest()
        spans = asked.select(F.col("path").alias("lo"), F.col("path").alias("hi"))
        return self._of_dimension(self._layer(m, "chunks", spans, lambda rows: rows.join(asked, "path", "left_semi")), dim or m.get("dim"))

    def at_or_below(self, paths: DataFrame, dim: int | None = None) -> DataFrame:
        """The chunks of these paths and of all paths below them."""
        asked = self._kept_paths(paths)
        m = self.manifest()
        below = asked.select(F.concat("path", F.lit("/")).alias("lo"), F.concat("path", F.lit("0")).alias("hi"))
        spans = asked.select(F.col("path").alias("lo"), F.col("path").alias("hi")).unionByName(below)

        def keep(rows: DataFrame) -> DataFrame:
            above = rows.select("path").distinct().select("path", F.explode(indexing.self_and_above(F.col("path"))).alias("asked"))
            found = above.join(asked.withColumnRenamed("path", "asked"), "asked", "left_semi").select("path").distinct()
            return rows.join(found, "path", "left_semi")

        return self._of_dimension(self._layer(m, "chunks", spans, keep), dim or m.get("dim"))

    def keys_for(self, keys: DataFrame) -> DataFrame:
        """The rows of these content keys (column key)."""
        asked = self.spark.read.parquet(self.scratch(keys.select("key").distinct(), "asked"))
        m = self.manifest()
        spans = asked.select(F.col("key").alias("lo"), F.col("key").alias("hi"))
        return self._layer(m, "keys", spans, lambda rows: rows.join(asked, "key", "left_semi"))

    def delta_chunks(self, raw: bool = False) -> DataFrame:
        """The live chunks that came after the base."""
        return self._layer(self.manifest() | {"base": []}, "chunks", raw=raw)

    def codes(self) -> DataFrame:
        """(path, modified, size, kind, chunk_index, scales, codes): the replica of a packed store's base, without what a delta replaced."""
        m = self.manifest()
        if not m["codes"]:
            raise ValueError("this store has no replica: only the base of a packed one has")
        return self._without_gone(self.spark.read.parquet(m["codes"]), m["delta"])

    def counters(self) -> DataFrame:
        """(kind, ext, files, chunks) of a counted store, as they were carried; ``indexing.diverged`` compares them with a recount."""
        return self._counters(self.manifest())

    def _counters(self, m: dict) -> DataFrame:
        schema = "kind string, ext string, files long, chunks long"
        if m["counters"]:
            return self.spark.read.schema(schema).parquet(m["counters"])
        if m["base"] or m["delta"]:  # counted from now on
            return indexing.counters(self._layer(m, "chunks"))
        return self.spark.createDataFrame([], schema)

    def _kept_paths(self, paths: DataFrame) -> DataFrame:
        return self.spark.read.parquet(self.scratch(paths.select("path").distinct(), "asked"))

    def _touched(self, dataset: str, ranges: str | None, spans: DataFrame | None) -> list[str]:
        """The files of a dataset whose range meets one of the spans (lo, hi); all of it without spans or ranges, or for many spans or files."""
        if spans is None or not ranges:
            return [dataset]
        found = self.spark.read.parquet(ranges).join(F.broadcast(spans), (F.col("lo") <= F.col("high")) & (F.col("hi") >= F.col("low")), "left_semi").select("file").limit(NAMED + 1).collect()
        return [dataset] if len(found) > NAMED else [f"{dataset}/{r.file}" for r in found]

    def _layer(self, m: dict, layer: str, spans: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows, raw: bool = False) -> DataFrame:
        """Base and delta, or what keeps to the spans (lo, hi) of them: what a step replaced is left out before its rows are added."""
        prefix, schema, _ = _LAYERS[layer]
        if spans is not None and spans.limit(LOOKUP + 1).count() > LOOKUP:
            spans = None
        parts = [(None, x, m[prefix + "ranges"]) for x in m[prefix + "base"]] + [(x.get("gone"), x.get("rows"), x.get("ranges")) for x in m[prefix + "delta"]]
        out = None
        for gone, rows, ranges in parts:
            if gone and out is not None:
                out = self._without_gone(out, [{"gone": gone}])
            files = self._touched(rows, ranges, spans) if rows else []
            if files:
                part = keep(self._stored(layer, *files, raw=raw))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], _PACKED if raw else schema) if out is None else out

    def _without_gone(self, rows: DataFrame, delta: list[dict]) -> DataFrame:
        for step in delta:
            if step.get("gone"):
                rows = rows.join(self.spark.read.parquet(step["gone"]).distinct(), "path", "left_anti")
        return rows

    def _stored(self, layer: str, *paths: str, raw: bool = False) -> DataFrame:
        """Stored rows; a column that was added after they were written has its default."""
        if layer == "keys":
            return self.spark.read.schema(KEYS).parquet(*paths)
        binary = [p for p in paths if "-packed-" in p]
        plain = [p for p in paths if "-packed-" not in p]
        defaults = {"width": 0, "height": 0, "duration": 0.0, "locator": "", "snippet": ""}
        out = self.spark.read.schema(CHUNKS).parquet(*plain).fillna(defaults) if plain else None
        if raw and out is not None:
            out = out.withColumn("vec", pk.pack(F.col("vec")))
        if binary:
            own = self.spark.read.schema(_PACKED).parquet(*binary).fillna(defaults)
            own = own if raw else own.withColumn("vec", pk.unpack(self.manifest()["dim"])(F.col("vec")))
            out = own if out is None else out.unionByName(own)
        return out

    @staticmethod
    def _of_dimension(rows: DataFrame, dim: int | None) -> DataFrame:
        return rows if dim is None else rows.where(F.size("vec") == dim)

    # Writing.

    def _write(self, df: DataFrame, name: str) -> str:
        path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def scratch(self, df: DataFrame, name: str) -> str:
        """Write rows of a step beside the data; compaction deletes them."""
        return self._write(df, f"step-{name}")

    def apply(self, items: DataFrame | None = None, removed: DataFrame | None = None, keys: DataFrame | None = None, forgotten: DataFrame | None = None, batch: str | None = None) -> bool:
        """One version: replace the chunks of the paths in ``items``, drop those of ``removed``, record ``keys``, drop the keys of ``forgotten``.

        The first rows fix the index's dimension; others are refused. ``batch``
        names the change: one that was committed before is not made again.
        """
        m = self.manifest()
        if batch is not None and m["meta"].get("batch:last") == batch:
            return False
        if batch is not None:
            m |= {"meta": m["meta"] | {"batch:last": batch}}
        if items is not None or removed is not None:
            items = items if items is not None else self.spark.createDataFrame([], CHUNKS)
            plain = self._write(items.select(*CHUNKS.names), "step-rows" if self.packed else "rows")
            kept = self.spark.read.schema(CHUNKS).parquet(plain)
            dims = [r.d for r in kept.select(F.size("vec").alias("d")).distinct().limit(2).collect()]
            dim = m.get("dim") or (dims[0] if dims else None)
            if any(d != dim for d in dims):
                raise ValueError(f"vectors of {dims} dimensions in an index of {dim}")
            rows = self._write(kept.withColumn("vec", pk.pack(F.col("vec"))), "rows-packed") if self.packed else plain
            step = {"gone": self._gone(kept, removed), "rows": rows}
            if self.counted:
                before = self.rows_at(self.spark.read.parquet(step["gone"]))
                m |= {"counters": self._write(indexing.advanced(self._counters(m), before, kept).coalesce(1), "counters")}
            m |= {"delta": [*m["delta"], step], "dim": dim, "delta_rows": m["delta_rows"] + kept.count()}
        if keys is not None or forgotten is not None:
            new = self.spark.createDataFrame([], KEYS)
            rows = None
            if keys is not None:
                rows = self._write(indexing.upsert(new, keys.select(*KEYS.names), "path", "modified"), "keys")
                new = self.spark.read.schema(KEYS).parquet(rows)
            m |= {"keys_delta": [*m["keys_delta"], {"gone": self._gone(new, forgotten), "rows": rows}], "keys_delta_rows": m["keys_delta_rows"] + new.count()}
        self._commit(m)
        for layer, (prefix, *_) in _LAYERS.items():
            if m[prefix + "delta_rows"] > max(FOLD_ROWS, RUNS_SHARE * m[prefix + "rows"]):
                self.fold()
            elif sum(1 for x in m[prefix + "delta"] if not x.get("ranges")) >= STEPS:
                self.merge(layer)
        return True

    def merge(self, layer: str) -> None:
        """The steps that are not in a run yet become one, sorted, with ranges: the same rows."""
        m = self.manifest()
        prefix, *_ = _LAYERS[layer]
        runs, steps = ([x for x in m[prefix + "delta"] if bool(x.get("ranges")) is kind] for kind in (True, False))
        live = self._layer(m | {prefix + "base": [], prefix + "delta": steps}, layer, raw=self.packed and layer == "chunks")
        found = self._new_base(live, layer)
        gone = [self.spark.read.parquet(x["gone"]) for x in steps if x.get("gone")]
        run = {"gone": self._write(reduce(DataFrame.unionByName, gone).distinct(), "gone") if gone else None, "rows": found[prefix + "base"][0], "ranges": found[prefix + "ranges"]}
        count = sum(self.spark.read.parquet(x["ranges"]).agg(F.sum("n")).first()[0] or 0 for x in [*runs, run])
        self._commit(m | {prefix + "delta": [*runs, run], prefix + "delta_rows": count})

    def _gone(self, rows: DataFrame, removed: DataFrame | None) -> str:
        gone = rows.select("path") if removed is None else rows.select("path").unionByName(removed.select("path"))
        return self._write(gone.distinct(), "gone")

    def replace_many(self, items: DataFrame, removed: DataFrame | None = None, batch: str | None = None) -> bool:
        """``apply`` to chunks alone."""
        return self.apply(items, removed, batch=batch)

    def record_keys(self, new: DataFrame) -> None:
        """Insert or replace the keys (path, key, modified, size) of these paths."""
        self.apply(keys=new)

    def delete_keys(self, paths: DataFrame) -> None:
        self.apply(forgotten=paths)

    def delete_chunks(self, path: str) -> None:
        """Drop a path's chunks and leave its content key, which is harmless: it matches no chunk."""
        self.apply(removed=self.spark.createDataFrame([(path,)], "path string"))

    def delete_paths(self, paths: DataFrame) -> None:
        """Drop chunks and content keys of these paths."""
        self.apply(removed=paths, forgotten=paths)

    def _new_base(self, df: DataFrame, layer: str) -> dict:
        """``df``, sorted so that ranges prune, with the range of each of its files."""
        prefix, _, order = _LAYERS[layer]
        name = layer if layer == "keys" else "base-packed" if self.packed else "base"
        base = self._write(df.repartitionByRange(order[0]).sortWithinPartitions(*order), name)
        stored = self.spark.read.parquet(base)
        ranges = stored.select(order[0], F.col("_metadata.file_name").alias("file")).groupBy("file").agg(F.min(order[0]).alias("low"), F.max(order[0]).alias("high"), F.count(F.lit(1)).alias("n"))
        ranges = self._write(ranges.repartition(1), "ranges")  # a row a file
        rows = self.spark.read.parquet(ranges).agg(F.sum("n")).first()[0] or 0
        return {prefix + "base": [base], prefix + "delta": [], prefix + "ranges": ranges, prefix + "rows": rows, prefix + "delta_rows": 0}

    def rewrite(self, df: DataFrame) -> None:
        """Make ``df`` the new base of the chunks; a packed store's replica is made with it."""
        m = self.manifest()
        # Counters are made anew when they are next needed: the rows may be others.
        self._commit(m | self._chunk_base(df.withColumn("vec", pk.pack(F.col("vec"))) if self.packed else df, m) | {"counters": None})

    def _chunk_base(self, df: DataFrame, m: dict) -> dict:
        found = self._new_base(df, "chunks")
        if self.packed and m.get("dim"):
            stored = self.spark.read.schema(_PACKED).parquet(*found["base"])
            found["codes"] = self._write(pk.quantised(stored, m["dim"]), "codes")
        return found

    def fold(self) -> None:
        """Bases that have a delta become new ones with it: the same rows."""
        m = self.manifest()
        new = self._chunk_base(self._layer(m, "chunks", raw=self.packed), m) if m["delta"] else {}
        new |= self._new_base(self._layer(m, "keys"), "keys") if m["keys_delta"] else {}
        if new:
            self._commit(m | new)

    def compact(self, least: float = DEAD_SHARE, keep: int = 2) -> bool:
        """Fold if at least this share of the stored rows is dead.

        Manifests but the last ``keep`` are deleted, and data that none of these
        names: readers of a version before may still be at work.
        """
        m = self.manifest()
        stored = m["rows"] + m["delta_rows"]
        live = self.chunks().count()
        if not stored or (stored - live) / stored < least:
            return False
        self.fold()
        names = self._manifests()
        held = [self._read(x) for x in names[-keep:]]
        used = [p for m in held for x in ("", "keys_") for p in [*m.get(x + "base", []), m.get(x + "ranges"), *(y for step in m.get(x + "delta", []) for y in step.values())]] + [m.get(x) for m in held for x in ("codes", "counters")]
        for name in names[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifest/{name}"), False)
        live = {p.rsplit("/", 1)[-1] for p in used if p}
        for x in self._fs.listStatus(self._path(f"{self.root}/data")):
            if x.getPath().getName() not in live:
                self._fs.delete(x.getPath(), True)
        return True

    def close(self) -> None:
        """Fold what is beside the bases, if anything; closing again does nothing."""
        m = self.manifest()
        if m["delta"] or m["keys_delta"]:
            self.fold()

    def drop(self) -> None:
        """Delete the whole index."""
        self._fs.delete(self._path(self.root), True)

    def wipe(self) -> None:
        m = self.manifest()
        m.pop("dim", None)
        self._commit(m | _NOTHING)

    def migrate_scans(self) -> bool:
        """Relabel scans, once."""
        if self.get("scan_kind_migrated"):
            return False
        self.rewrite(indexing.relabel_scans(self.chunks()))
        self.set("scan_kind_migrated", "1")
        return True

    def outdated(self, fingerprint: str, dim: int) -> bool:
        """Whether the index was made by another model: the dimension decides first, then the recorded fingerprint."""
        m = self.manifest()
        if m.get("dim") not in (None, dim):
            return True
        known = m["meta"].get("embedding_version")
        return known is not None and known != fingerprint and f"|{dim}|" in known


@contextmanager
def temporary(spark: SparkSession, root: str) -> Iterator[Store]:
    """A store in a folder of its own below ``root``, for a trial run; it is deleted at the end."""
    store = Store(spark, f"{root.rstrip('/')}/trial-{uuid.uuid4().hex}")
    try:
        yield store
    finally:
        store.drop()


def write_report(rows: DataFrame, path: str) -> None:
    """A report as JSON lines, in one file or more as Spark writes them."""
    rows.write.mode("error").json(path)
