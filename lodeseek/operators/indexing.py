"""Keeping the index: changes, reconciliation, reuse of equal contents, mutations of the chunk table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..schema import EXTENSIONS, SIZE_CAPS
from .search import in_folder


def supported(path: Column, enabled: frozenset[str] = frozenset(EXTENSIONS), disabled_extensions: frozenset[str] = frozenset()) -> Column:
    kind = tx.kind_of(path)
    return F.coalesce(kind.isin(sorted(enabled)), F.lit(False)) & ~tx.extension(path).isin(sorted(disabled_extensions))


def within_cap(kind: Column, size: Column) -> Column:
    """Only images are capped by size."""
    out = F.lit(True)
    for k, cap in SIZE_CAPS.items():
        out &= (kind != k) | (size <= cap)
    return out


def interleave(files: DataFrame, root: str = "root", path: str = "path") -> DataFrame:
    """``files`` with turn and place: one file of each root in turn."""
    turn = F.row_number().over(Window.partitionBy(root).orderBy(path))
    return files.withColumn("turn", turn)


def canonical_roots(roots: DataFrame, path: str = "path") -> DataFrame:
    """The roots that are in no other root."""
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split(path, "/"), F.lit(1), n), "/"))
    above = roots.select(path, F.explode(F.filter(parents, lambda p: p != "")).alias("parent"))
    # An equi-join with each root's parents: a root nested in another has it among them.
    nested = above.join(roots.select(F.col(path).alias("parent")).distinct(), "parent", "left_semi").select(path).distinct()
    return roots.select(path).distinct().join(nested, path, "left_anti")


def changes(crawl: DataFrame, known: DataFrame) -> DataFrame:
    """(path, status) with new, modified, unchanged or gone, by exact modified and size."""
    a = crawl.select("path", F.col("modified").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("seen"))
    b = known.select("path", F.col("modified").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("had"))
    status = F.when(F.col("had").isNull(), "new").when(F.col("seen").isNull(), "gone").when(F.col("m1").eqNullSafe(F.col("m0")) & F.col("s1").eqNullSafe(F.col("s0")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def stale(known: DataFrame, crawl: DataFrame, roots: list[str], enabled: frozenset[str], ignored: Column | None = None, cancelled: bool = False, remote: DataFrame | None = None) -> DataFrame:
    """Known paths to delete after a pass: not seen, under a root that had any file, of an enabled kind, not ignored.

    A cancelled pass deletes nothing; a root without a single file is taken as
    unreachable. ``remote`` are paths whose content is not here (and so are not
    in the crawl), which are never deleted.
    """
    if cancelled or not roots:
        return known.select("path").limit(0)
    seen = {r: F.count_if(in_folder(F.col("path"), r)).alias(f"r{i}") for i, r in enumerate(roots)}
    counts = crawl.agg(*seen.values()).first()
    live = [r for i, r in enumerate(roots) if counts[i]]
    scope = F.lit(False)
    for r in live:
        scope |= in_folder(F.col("path"), r)
    scope &= tx.governing(F.col("kind")).isin(sorted(enabled))
    if ignored is not None:
        scope &= ~ignored
    gone = known.where(scope).join(crawl.select("path"), "path", "left_anti").select("path")
    return gone if remote is None else gone.join(remote.select("path"), "path", "left_anti")


def reusable(keys: DataFrame, chunks: DataFrame, dim: int) -> DataFrame:
    """(key, source): for each content key the least path whose chunks all carry the recorded modified, dimension and finite vectors."""
    sound = (F.col("modified") == F.col("recorded")) & (F.size("vec") == dim) & vx.all_finite(F.col("vec"))
    joined = chunks.select("path", "modified", "vec").join(keys.select("path", "key", F.col("modified").alias("recorded")), "path")
    return joined.groupBy("key", "path").agg(F.bool_and(sound).alias("sound")).where("sound").groupBy("key").agg(F.min("path").alias("source"))


def rewritten(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunks of each target (path, modified, size, source): those of its source, with its own path and times; a snippet that is the source's basename becomes its own."""
    own = targets.select(F.col("path").alias("to"), F.col("modified").alias("m"), F.col("size").alias("s"), F.col("source").alias("path"))
    moved = F.when(F.col("snippet") == tx.basename(F.col("path")), tx.basename(F.col("to"))).otherwise(F.col("snippet"))
    both = chunks.join(own, "path").withColumn("snippet", moved)
    return both.withColumns({"path": F.col("to"), "modified": F.col("m"), "size": F.col("s")}).select(*chunks.columns)


def finite_files(chunks: DataFrame) -> DataFrame:
    """(path, sound): a file with any vector that is not finite fails as a whole."""
    return chunks.groupBy("path").agg(F.bool_and(vx.all_finite(F.col("vec"))).alias("sound"))


def replace(chunks: DataFrame, items: DataFrame, delete_empty: DataFrame | None = None) -> DataFrame:
    """``chunks`` with the rows of each path in ``items`` replaced; paths in ``delete_empty`` lose theirs."""
    gone = items.select("path").distinct()
    if delete_empty is not None:
        gone = gone.unionByName(delete_empty.select("path")).distinct()
    return chunks.join(gone, "path", "left_anti").unionByName(items.select(*chunks.columns))


def delete_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return rows.join(paths.select("path").distinct(), "path", "left_anti")


def delete_under(rows: DataFrame, folder: str) -> DataFrame:
    """Without the folder's rows; no change for '' and '/'. The range reaches the scan."""
    folder = folder.rstrip("/")
    if not folder:
        return rows
    path = F.col("path")
    return rows.where(~((path == folder) | ((path >= folder + "/") & (path < folder + "0"))))


def delete_kind(rows: DataFrame, kinds: list[str]) -> DataFrame:
    return rows.where(~F.col("kind").isin(kinds))


def delete_keys_of_kind(keys: DataFrame, chunks: DataFrame, kinds: list[str]) -> DataFrame:
    return keys.join(chunks.where(F.col("kind").isin(kinds)).select("path").distinct(), "path", "left_anti")


def delete_extensions(rows: DataFrame, extensions: list[str]) -> DataFrame:
    return rows.where(~tx.extension(F.col("path")).isin([e.lower() for e in extensions]))


def upsert(rows: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The latest row of each key by ``order``; of new and old rows at the same place, the new one."""
    both = rows.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__new"), F.desc(order)))
    return both.withColumn("__rank", latest).where("__rank = 1").drop("__rank", "__new")


def relabel_scans(chunks: DataFrame) -> DataFrame:
    """``chunks`` with kind scan for PDF files all of whose snippets are the bare name, or the name with a page."""
    base = tx.basename(F.col("path"))
    bare = (F.col("snippet") == base) | (F.col("snippet") == F.concat(base, F.lit(" - "), base)) | (F.col("snippet").startswith(F.concat(base, F.lit(" - page "))) & F.substr("snippet", F.length(base) + 9).rlike(r"^\d+$"))
    pdf = F.lower("path").endswith(".pdf") & (F.col("kind") == "text")
    scans = chunks.where(pdf).groupBy("path").agg(F.bool_and(bare).alias("bare")).where("bare").select("path", F.lit(True).alias("__scan"))
    return chunks.join(scans, "path", "left").withColumn("kind", F.when(F.col("__scan"), "scan").otherwise(F.col("kind"))).select(*chunks.columns)


def indexed_files(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("path").agg(F.max("modified").alias("modified"), F.max("size").alias("size"), F.max("kind").alias("kind"))


def summary(chunks: DataFrame) -> DataFrame:
    """(files, chunks, kinds, exts) of the whole index; files without extension add none."""
    per = chunks.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    ext = tx.extension(F.col("path"))
    return per.agg(
        F.count_distinct("path").alias("files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.array_sort(F.collect_set(F.when(ext != "", ext))).alias("exts"),
    )


def self_and_above(path: Column) -> Column:
    """A path and all folders above it but the root."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))


def folder_counts(chunks: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, files): distinct files at or below each folder, 0 if none; folders may overlap.

    Every path is met by its own folders above it, so the join is on equality.
    """
    held = chunks.select("path").distinct().select("path", F.explode(self_and_above(F.col("path"))).alias("folder"))
    counts = held.join(folders.select("folder").distinct(), "folder", "left_semi").groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return folders.join(counts, "folder", "left").select("folder", F.coalesce("n", F.lit(0)).alias("files"))


def media_ready(kind: Column, side: Column, seconds: Column, characters: Column, least_side: int = 0, least_seconds: float = 0.0, least_characters: int = 0) -> Column:
    """Whether a file reaches the least size set for its kind."""
    return F.when(kind == "image", side >= least_side).when(kind.isin("audio", "video"), seconds >= least_seconds).otherwise(characters >= least_characters)


def stored_files(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """``indexed_files`` of the paths asked for; those that are not there give no row."""
    return indexed_files(chunks.join(paths.select("path").distinct(), "path", "left_semi"))


def file_count(chunks: DataFrame, kinds: list[str]) -> DataFrame:
    """(files): files of the kinds, each kind counted on its own."""
    return chunks.where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count_distinct("path").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def chunk_counts(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, chunks) of each path asked for, 0 if it is not there."""
    asked = paths.select("path").distinct()
    found = chunks.join(asked, "path", "left_semi").groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return asked.join(found, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("chunks"))


def counters(chunks: DataFrame) -> DataFrame:
    """(kind, ext, files, chunks) of the whole index."""
    per = chunks.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind", tx.extension(F.col("path")).alias("ext")).agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("chunks"))


def advanced(known: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """``counters`` after the chunks of some paths, ``before``, gave way to ``after``: only these rows are read."""
    change = counters(after).unionByName(counters(before).select("kind", "ext", (-F.col("files")).alias("files"), (-F.col("chunks")).alias("chunks")))
    return known.unionByName(change).groupBy("kind", "ext").agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks")).where("files <> 0 or chunks <> 0")


def diverged(known: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows of kept counters that differ from what the index holds; none if all is well."""
    columns = ["kind", "ext", "files", "chunks"]
    true = counters(chunks).select(*columns)
    return known.select(*columns).exceptAll(true).unionByName(true.exceptAll(known.select(*columns))).select("kind", "ext").distinct()
