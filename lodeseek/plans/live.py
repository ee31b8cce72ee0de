"""A whole live index from a change stream: events, micro-batches, versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed
from ..functions import text as tx
from ..operators import indexing
from ..sources import changes, mapping, walk
from ..sources.shared import shared_folder
from ..sources.store import Store
from ..streaming import live
from . import index_pass
from .progress import Progress


def replay_changes(spark: SparkSession, sf_dir: str, batches: int = 3) -> DataFrame:
    """(path, modified, size, kind, chunk_index, snippet) after all change events, written as ``batches`` files and read as a stream.

    A file is there if its last event does not delete it; its content is a line of words.
    """
    root = shared_folder(spark)
    events = mapping.changes(spark, sf_dir).select("path", "op", "event_id", F.unix_micros("ts").alias("micros"))
    events.repartitionByRange(batches, "event_id").write.parquet(f"{root}/events")
    last = live.coalesce_events(events).where("op <> 'delete'")
    words = F.concat(F.lit("words of "), tx.basename(F.col("path")), F.lit(" after "), (F.col("event_id") % 50).cast("string"))
    files = last.select("path", F.col("event_id").cast("double").alias("modified"), F.octet_length(words).cast("long").alias("size"), tx.kind_of(F.col("path")).alias("kind"), words.cast("binary").alias("content"))
    store = Store(spark, f"{root}/store")
    stream = live.replay(spark, f"{root}/events", events.schema)
    index_pass.follow(store, stream, lambda: files, embed.HashEmbedder(), f"{root}/progress", every=None).awaitTermination()
    return store.chunks().select("path", "modified", "size", "kind", "chunk_index", "snippet")


def two_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, modified, size, chunk_index, locator, snippet, status) after two passes over all documents: before the second, a seventh of the files got a new time, and new files came whose contents are known."""
    store = Store(spark, f"{shared_folder(spark)}/store")
    files = mapping.files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")).drop("text")
    roots = ["/"]
    index_pass.index(store, files.drop("doc_id"), roots, embed.HashEmbedder())
    later = files.withColumn("modified", F.when(F.col("doc_id") % 7 == 0, F.col("modified") + 1).otherwise(F.col("modified")))
    copies = files.withColumns({"path": F.concat(F.lit("/copies"), "path"), "modified": F.col("modified") + 2})
    done = index_pass.index(store, later.unionByName(copies).drop("doc_id"), roots, embed.HashEmbedder())
    done = spark.read.parquet(store.scratch(done, "status"))
    return store.chunks().join(done, "path").select("path", "modified", "size", "chunk_index", "locator", "snippet", "status")


def pass_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(figure, n) of the progress of a second pass: of all documents, a seventh has a new time, and an eleventh is gone."""
    store, seen = Store(spark, f"{shared_folder(spark)}/store"), Progress()
    files = mapping.files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")).drop("text")
    index_pass.index(store, files.drop("doc_id"), ["/"], embed.HashEmbedder())
    later = files.where("doc_id % 11 <> 0").withColumn("modified", F.when(F.col("doc_id") % 7 == 0, F.col("modified") + 1).otherwise(F.col("modified")))
    index_pass.index(store, later.drop("doc_id"), ["/"], embed.HashEmbedder(), progress=seen)
    return spark.createDataFrame([(k, v) for k, v in seen.figures.items()], "figure string, n long")


def kept_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, ext, files, chunks, sound): counters carried over a change of every file of two folders, and whether they are what a recount gives."""
    chunks = mapping.chunks(spark, sf_dir)
    touched = F.col("path").startswith("/d1/") | F.col("path").startswith("/d2/")
    before = chunks.where(touched)
    after = before.where(F.col("chunk_index") < 2).withColumn("path", F.regexp_replace("path", r"\.txt$", ".md"))
    now = chunks.where(~touched).unionByName(after)
    kept = indexing.advanced(indexing.counters(chunks), before, after)
    wrong = indexing.diverged(kept, now).withColumn("sound", F.lit(False))
    return kept.join(wrong, ["kind", "ext"], "left").withColumn("sound", F.coalesce("sound", F.lit(True)))


def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, op, event_id, n): the last of each path's events and how many there are, from a journal read as a stream.

    Half of the events are in the journal when the query first runs; it stops,
    the rest is appended, and it starts again from the event id in its
    checkpoint. Each micro-batch writes a folder of its own, so a batch that is
    run again counts once.
    """
    root = shared_folder(spark)
    events = mapping.changes(spark, sf_dir).select("path", "op", "event_id")
    cut = events.agg(F.max("event_id")).first()[0] or 0

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for part in (events.where(F.col("event_id") <= cut // 2), events.where(F.col("event_id") > cut // 2)):
        changes.append(part, f"{root}/journal")
        query = changes.changes(spark, f"{root}/journal").writeStream.option("checkpointLocation", f"{root}/progress").foreachBatch(written).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("path").agg(F.max(F.struct("event_id", "op")).alias("m"), F.count(F.lit(1)).alias("n")).select("path", "m.op", "m.event_id", "n")


def walked_files(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    """(path, size, kind) below a new folder to which every document was written as a file, as far as the walk takes it."""
    root = shared_folder(spark)
    docs = mapping.files(spark, sf_dir).select(F.concat(F.lit(root), "path").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    walk.write_files(docs).count()
    files, _ = walk.Walk(spark, [root], policy=policy).run()
    return files.select(F.substr("path", F.length("root") + 1).alias("path"), "size", "kind")


def moved_folder(spark: SparkSession, sf_dir: str, old: str = "/src1", new: str = "/moved/src1") -> DataFrame:
    """(path, chunk_index, locator, snippet, status) after a folder was moved, of which there are two events: one for where it was, one for where it is."""
    store = Store(spark, f"{shared_folder(spark)}/store")
    files = mapping.files(spark, sf_dir).withColumn("content", F.col("text").cast("binary")).drop("text", "doc_id")
    index_pass.index(store, files, ["/"], embed.HashEmbedder())
    store.fold()
    inside = F.col("path").startswith(f"{old}/")
    now = files.withColumn("path", F.when(inside, F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1)))).otherwise(F.col("path")))
    events = spark.createDataFrame([(old, "delete", 1), (new.rsplit("/", 1)[0], "create", 2)], "path string, op string, event_id long")
    index_pass.update(store, events, now, embed.HashEmbedder(), batch="move")
    return store.chunks().select("path", "chunk_index", "locator", "snippet")


def packed_store(spark: SparkSession, sf_dir: str) -> Store:
    """A packed store of all test chunks: two folders in three are its base, with its replica, and the rest its delta."""
    store = Store(spark, f"{shared_folder(spark)}/store", packed=True)
    chunks = mapping.chunks(spark, sf_dir).withColumns({"width": F.lit(0), "height": F.lit(0), "duration": F.lit(0.0)})
    late = F.col("path").startswith("/d2/") | F.col("path").startswith("/d5/")
    store.apply(chunks.where(~late))
    store.fold()
    store.apply(chunks.where(late))
    return store


def limited_stream(spark: SparkSession, sf_dir: str, most: int = 2) -> DataFrame:
    """(run_id, hour, allowed) of all posts as a stream decides them: two appended parts, and a restart in between."""
    root = shared_folder(spark)
    posts = mapping.telemetry(spark, sf_dir).select("run_id", "ip_hash", "created_at", F.timestamp_millis("created_at").alias("ts"))
    cut = posts.agg(F.expr("percentile_approx(created_at, 0.5)")).first()[0] or 0

    def written(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    for early in (True, False):
        posts.where((F.col("created_at") <= cut) == F.lit(early)).write.mode("append").parquet(f"{root}/posts")
        stream = spark.readStream.schema(posts.schema).parquet(f"{root}/posts")
        query = live.accepted(stream, most).writeStream.option("checkpointLocation", f"{root}/progress").outputMode("update").foreachBatch(written)
        query.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/out").select("run_id", "hour", "allowed")


def counted_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, ext, files, chunks) after a stream of files' counts: all files, then, after a restart, the changes of two folders."""
    root, chunks = shared_folder(spark), mapping.chunks(spark, sf_dir)
    n = lambda rows, seq: rows.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("chunks")).select("path", "kind", tx.extension(F.col("path")).alias("ext"), "chunks", F.lit(seq).cast("long").alias("seq"))
    touched = F.col("path").startswith("/d1/") | F.col("path").startswith("/d2/")
    after = chunks.where(touched & (F.col("chunk_index") < 2)).withColumn("path", F.regexp_replace("path", r"\.txt$", ".md"))
    gone = n(chunks.where(touched & F.col("path").endswith(".txt")), 1).withColumn("chunks", F.lit(0).cast("long"))
    first = n(chunks, 0)
    for part in (first, n(after, 1).unionByName(gone)):
        part.write.mode("append").parquet(f"{root}/counts")
        stream = spark.readStream.schema(first.schema).parquet(f"{root}/counts")
        live.write_moves(live.counter_moves(stream), f"{root}/moves", f"{root}/progress").awaitTermination()
    return live.counters_at(spark, f"{root}/moves")


def counted_store(spark: SparkSession, sf_dir: str) -> Store:
    """A counted store of all test chunks, after one folder's text files got other names and another folder went."""
    store = Store(spark, f"{shared_folder(spark)}/store", counted=True)
    chunks = mapping.chunks(spark, sf_dir).withColumns({"width": F.lit(0), "height": F.lit(0), "duration": F.lit(0.0)})
    store.apply(chunks)
    renamed = F.col("path").startswith("/d3/") & F.col("path").endswith(".txt")
    items = chunks.where(renamed).withColumn("path", F.regexp_replace("path", r"\.txt$", ".md"))
    store.apply(items, chunks.where(renamed | F.col("path").startswith("/d4/")).select("path"))
    return store


def thinned_store(spark: SparkSession, sf_dir: str) -> Store:
    """A store of all test chunks after a third of the files was deleted by path, a folder went, and it was compacted and folded."""
    store = Store(spark, f"{shared_folder(spark)}/store")
    chunks = mapping.chunks(spark, sf_dir).withColumns({"width": F.lit(0), "height": F.lit(0), "duration": F.lit(0.0)})
    store.apply(chunks)
    store.delete_paths(chunks.where("fid % 3 = 1").select("path"))
    store.compact()
    store.rewrite(indexing.delete_under(store.chunks(), "/d5"))
    store.close()
    return store
