"""An index pass and live updates as a whole: change test, contents, reuse, chunks, vectors, gate, store, reconciliation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import embed as em
from ..functions import ignore
from ..functions import text as tx
from ..operators import indexing
from ..schema import CHUNK_LIMIT, CHUNK_OVERLAP, CHUNKS, EXTENSIONS, KIND_ORDER
from ..sources.store import Store
from ..streaming import live
from .progress import Progress, counted

#: What takes files (path, kind, content) and gives (path, text, page_starts) of those it can read; page_starts is null for plain text.
Extractor = Callable[[DataFrame], DataFrame]


def plain_text(files: DataFrame) -> DataFrame:
    """The default extractor: text files, decoded and trimmed. Other media and formats take an extractor of their own."""
    text = tx.trim(tx.decode(F.col("content")))
    return files.where("kind = 'text'").select("path", text.alias("text"), F.lit(None).cast("array<int>").alias("page_starts")).where("text <> ''")


@dataclass(frozen=True)
class Settings:
    enabled: frozenset[str] = frozenset(EXTENSIONS)
    policy: str = ""
    limit: int = CHUNK_LIMIT
    least_characters: int = 0
    force: bool = False


def fingerprint(settings: Settings) -> str:
    """What, besides its content, a file's vectors depend on."""
    return f"c{settings.limit},o{CHUNK_OVERLAP}"


def chunk_rows(files: DataFrame, texts: DataFrame, embedder: em.Embedder, settings: Settings) -> DataFrame:
    """Rows of the chunk table for files (path, modified, size, kind) and their texts; a file with a vector that is not finite has none."""
    both = files.select("path", "modified", "size", "kind").join(texts, "path")
    windows = F.when(F.col("page_starts").isNull(), tx.chunks(F.col("text"), settings.limit)).otherwise(tx.chunks(F.col("text"), settings.limit, F.col("page_starts")))
    each = both.select("path", "modified", "size", "kind", F.explode(windows).alias("w")).select("path", "modified", "size", "kind", "w.chunk_index", "w.text", "w.locator")
    made = em.embed(each, embedder, prefix=em.DOCUMENT_PREFIX)
    return made.withColumn("snippet", tx.snippet(F.col("text"))).withColumns({"width": F.lit(0), "height": F.lit(0), "duration": F.lit(0.0)}).select(*CHUNKS.names)


#: What takes files (path, kind, ...) and gives them with content; it is called for the files whose content is needed.
Reader = Callable[[DataFrame], DataFrame]


def with_content(rows: DataFrame, files: DataFrame, read: Reader | None) -> DataFrame:
    """``rows`` with content: by ``read``, or from the column of ``files``."""
    return read(rows) if read is not None else rows.join(files.select("path", "content"), "path")


def store_files(store: Store, todo: DataFrame, known: DataFrame, embedder: em.Embedder, settings: Settings, extract: Extractor = plain_text, removed: DataFrame | None = None, batch: str | None = None, read: Reader | None = None, progress: Progress | None = None) -> DataFrame:
    """Bring files (path, modified, size, kind[, content]) into the store as one version; (path, status) of each.

    A file whose content key is known takes the vectors of the least path that
    has it, as long as all of that path's chunks are as they were recorded; of
    new files with equal contents one is embedded. Status is reused, embedded,
    empty (a known file loses its chunks) or failed (a vector that is not finite:
    what is stored stays). ``removed`` paths go in the same version. Contents are
    hashed where they are read and not written; those of the one file that is
    embedded for its key are read again. Of the index, only what these files'
    paths and keys touch is read.
    """
    dim = embedder.dim
    # Their own contents need no join.
    keyed = (todo.where("path is not null") if read is None else read(todo.drop("content"))).withColumn("key", tx.content_key(F.col("kind"), F.col("path"), F.col("content"), dim, fingerprint(settings)))
    small = store.spark.read.parquet(store.scratch(keyed.drop("content"), "todo"))
    recorded = store.spark.read.parquet(store.scratch(store.keys_for(small.select("key")), "recorded"))
    stored = store.rows_at(recorded.select("path"), dim)
    sources = indexing.reusable(recorded, stored, dim)
    again = small.join(sources, "key")  # its own vectors too, where only its time changed
    reused = indexing.rewritten(stored, again)
    fresh = small.join(again.select("path"), "path", "left_anti")
    chosen = fresh.groupBy("key").agg(F.min("path").alias("source"))
    firsts = small.join(chosen.select(F.col("source").alias("path")), "path", "left_semi")
    texts = extract(with_content(firsts, todo, read)).where(F.length("text") >= settings.least_characters)
    made = store.spark.read.schema(CHUNKS).parquet(store.scratch(chunk_rows(firsts, texts, embedder, settings), "made"))
    sound = indexing.finite_files(made)
    # Few of them as a rule: written, they have a size by which chunks need not be shuffled to meet them.
    bad = store.spark.read.parquet(store.scratch(sound.where("not coalesce(sound, false)").select("path"), "bad"))
    good = made.join(bad, "path", "left_anti")
    copies = indexing.rewritten(good, store.spark.read.parquet(store.scratch(fresh.join(chosen, "key").where("source <> path"), "copies")))
    items = store.spark.read.schema(CHUNKS).parquet(store.scratch(reused.unionByName(good).unionByName(copies), "items"))
    failed = fresh.join(chosen, "key").join(sound.where("not sound").select(F.col("path").alias("source")), "source", "left_semi").select("path")
    has = items.select("path").distinct()
    empty = small.select("path").join(has, "path", "left_anti").join(failed, "path", "left_anti")
    gone = empty.join(known.select("path"), "path", "left_semi")
    gone = gone if removed is None else gone.unionByName(removed.select("path")).distinct()
    gone = store.spark.read.parquet(store.scratch(gone, "gone"))
    # What is told of each file is worked out before the version is there: later it would find its own keys.
    how = F.when(F.col("again"), "reused").when(F.col("has"), "embedded").when(F.col("bad"), "failed").otherwise("empty")
    marks = small.select("path").join(again.select("path", F.lit(True).alias("again")), "path", "left").join(has.withColumn("has", F.lit(True)), "path", "left").join(failed.withColumn("bad", F.lit(True)), "path", "left")
    marks = marks.select("path", how.alias("status"))
    if progress is not None:
        marks = progress.watch(marks, **{x: F.col("status") == x for x in ("reused", "embedded", "failed", "empty")})
    done = store.spark.read.parquet(store.scratch(marks, "done"))
    store.apply(items, gone, small.join(has, "path", "left_semi"), gone, batch)
    if progress is not None:
        progress.settle()
    return done


def index(store: Store, files: DataFrame, roots: list[str], embedder: em.Embedder, settings: Settings = Settings(), extract: Extractor = plain_text, cancelled: bool = False, read: Reader | None = None, progress: Progress | None = None) -> DataFrame:
    """A whole pass over crawled files (path, modified, size, kind[, content]): (path, status) of every file, and of known ones that went.

    Without a column content, ``read`` reads the contents that are needed.
    ``progress`` gets its figures as the steps end.

    Unchanged files (equal time and size) are left as they are, unless forced;
    the others go to ``store_files``. Known files that were not seen are deleted
    afterwards (``indexing.stale``), but not by a cancelled pass.
    """
    rules = ignore.parse(settings.policy)
    wanted = files.where(indexing.supported(F.col("path"), settings.enabled))
    known = store.spark.read.parquet(store.scratch(indexing.indexed_files(store.chunks(embedder.dim)), "known"))
    status = indexing.changes(wanted, known)
    if progress is not None:
        same = F.col("status") == "unchanged"
        status = progress.watch(status, scanned=F.col("status") != "gone", unchanged=same & F.lit(not settings.force))
    status = store.spark.read.parquet(store.scratch(status, "status"))
    if progress is not None:
        progress.settle()
    same = status.where("status = 'unchanged'").select("path") if not settings.force else status.limit(0).select("path")
    done = store_files(store, wanted.join(same, "path", "left_anti"), known, embedder, settings, extract, read=read, progress=progress)
    ignored = ignore.ignored_with_ancestors(F.col("path"), F.lit(False), rules) if rules else None
    stale = indexing.stale(known, files, roots, settings.enabled, ignored, cancelled)
    stale = stale if progress is None else progress.watch(stale, deleted=F.col("path").isNotNull())
    stale = store.spark.read.parquet(store.scratch(stale, "stale"))
    if not stale.isEmpty():
        store.delete_paths(stale)
    if progress is not None:
        progress.settle()
    return done.unionByName(same.withColumn("status", F.lit("unchanged"))).unionByName(stale.withColumn("status", F.lit("deleted")))


#: What takes touched paths (path) and gives the files (path, modified, size, kind[, content, dataless]) that are at or below them now.
Look = Callable[[DataFrame], DataFrame]


def among(files: DataFrame) -> Look:
    """Looks in a table of all files."""

    def look(paths: DataFrame) -> DataFrame:
        above = files.select("path", F.explode(indexing.self_and_above(F.col("path"))).alias("asked"))
        found = above.join(paths.select(F.col("path").alias("asked")), "asked", "left_semi").select("path").distinct()
        return files.join(found, "path", "left_semi")

    return look


def update(store: Store, events: DataFrame, files: DataFrame | Look, embedder: em.Embedder, settings: Settings = Settings(), extract: Extractor = plain_text, paused: list[str] = (), batch: str | None = None, read: Reader | None = None, progress: Progress | None = None) -> None:
    """Apply change events (path, op, event_id) against the files that are there now; a batch that was committed before changes nothing.

    An event of a folder stands for all files at or below it: those that are
    there now, and those that the index knows there. Only the batch's paths are
    looked at, in the file system and in the index. ``files`` is a table of all
    files or what looks at paths.
    """
    if batch is not None and store.get("batch:last") == batch:
        return
    spark, look = store.spark, among(files) if isinstance(files, DataFrame) else files
    touched = spark.read.parquet(store.scratch(live.coalesce_events(events), "touched"))
    known = spark.read.parquet(store.scratch(indexing.indexed_files(store.at_or_below(touched, embedder.dim)), "known"))
    there = look(touched.select("path"))
    light = spark.read.parquet(store.scratch(there.drop("content"), "there"))
    implied = known.select("path").unionByName(light.select("path")).distinct().join(touched.select("path"), "path", "left_anti")
    expanded = touched.unionByName(implied.select("path", F.lit("modify").alias("op"), F.lit(None).cast("long").alias("event_id")))
    acts = live.actions(expanded, light, known, settings.enabled, ignore.parse(settings.policy), list(paused), dataless="dataless" in light.columns)
    if progress is not None:
        acts = progress.watch(acts, scanned=F.lit(True), unchanged=F.col("action") == "none", deleted=F.col("action") == "delete")
    acts = spark.read.parquet(store.scratch(acts, "acts"))
    wanted = acts.where("action = 'embed'").select("path")
    todo = (light if read is not None else there).join(wanted, "path", "left_semi")
    store_files(store, todo, known, embedder, settings, extract, acts.where("action = 'delete'").select("path"), batch, read, progress)


def follow(store: Store, stream: DataFrame, files: Callable[[], DataFrame] | Look, embedder: em.Embedder, checkpoint: str, settings: Settings = Settings(), extract: Extractor = plain_text, every: str | None = "1.5 seconds", read: Reader | None = None, looks: bool = False, progress: Progress | None = None):
    """Keep the store up with a stream of change events.

    ``files`` lists what is there when a batch is applied; with ``looks``, it
    takes the batch's paths instead (``Look``), and nothing else is listed.
    """

    def apply(batch: DataFrame, number: int) -> None:
        update(store, batch, files if looks else files(), embedder, settings, extract, batch=f"{checkpoint}#{number}", read=read, progress=progress)

    return live.live_update(counted(stream), apply, checkpoint, every)


def file_query(files: DataFrame, embedder: em.Embedder, as_document: bool = False, extract: Extractor = plain_text) -> DataFrame:
    """(path, vec) of files used as queries, read as an index pass reads them; as documents for files that are alike, else as queries."""
    return em.embed(extract(files), embedder, prefix=em.DOCUMENT_PREFIX if as_document else em.QUERY_PREFIX).select("path", "vec")


def in_kind_order(kind: Column) -> Column:
    """Sort key of the order in which a pass takes kinds; others come last."""
    place = F.array_position(F.array(*map(F.lit, KIND_ORDER)), tx.governing(kind))
    return F.when(place > 0, place).otherwise(len(KIND_ORDER) + 1).cast("int")


#: Fixed value: the order in which work that waited for a pass is done, so that passes never overlap.
DEFERRED = ("removals", "restart", "catch_up", "events")


def next_work(pending: dict[str, bool], busy: bool = False) -> str | None:
    """What is done next of the work that is pending; nothing while a pass runs."""
    return None if busy else next((x for x in DEFERRED if pending.get(x)), None)
