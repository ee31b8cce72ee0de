"""Files, chunks and other tables of the engine, derived from the test tables by fixed rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three vectors make a file."""
    fid, i = F.expr("vec_id div 3"), (F.col("vec_id") % 3).cast("int")
    at = (F.expr("vec_id div 3") % 6).cast("int") + 1
    ext = F.element_at(F.array(*map(F.lit, ["txt", "png", "md", "mp3", "mp4", "pdf"])), at)
    kind = F.element_at(F.array(*map(F.lit, ["text", "image", "text", "audio", "video", "scan"])), at)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        fid.alias("fid"),
        F.concat(F.lit("/d"), fid % 7, F.lit("/file"), fid, F.lit("."), ext).alias("path"),
        (EPOCH + fid * 7919 % 1_000_000 + i).cast("double").alias("modified"),
        (100 + fid).alias("size"),
        kind.alias("kind"),
        i.alias("chunk_index"),
        F.concat(F.lit("file"), fid, F.lit("#"), i).alias("snippet"),
        F.col("embedding").alias("vec"),
        F.when(ext == "pdf", F.concat(F.lit("Page "), i + 1)).otherwise(F.lit("")).alias("locator"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = F.element_at(F.array(*map(F.lit, ["txt", "md", "json", "csv"])), (F.col("doc_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.lit("."), ext).alias("path"),
        (EPOCH + F.col("doc_id") * 3600).cast("double").alias("modified"),
        F.octet_length("text").cast("long").alias("size"),
        F.lit("text").alias("kind"),
        "text",
    )


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, bookmarked, last_used): the first lines of conversation turns."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.substring_index("text", "\n", 1).alias("query"),
        (F.col("conv_id") % 5 == 0).alias("bookmarked"),
        (EPOCH + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("last_used"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("user_id") % 29 != 0, F.concat(F.lit("chip"), F.col("user_id") % 8)).alias("chip"),
        F.concat(F.lit("0."), F.col("user_id") % 3, F.lit("."), F.col("user_id") % 17).alias("app_version"),
        F.col("value").alias("files_per_sec"),
        (F.col("value") * 1000).alias("tokens_per_sec"),
        millis.alias("created_at"),
        F.sha2(F.col("user_id").cast("string").cast("binary"), 256).alias("ip_hash"),
        (F.col("value") * 3).alias("seconds"),
        F.when(F.col("user_id") % 4 != 0, F.col("value") * 1e6).alias("vram_delta"),
        F.when(F.col("event_id") % 3 != 0, 2020 + F.col("event_id") % 6).cast("int").alias("release_year"),
        F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 8 + 1) * 8_000_000_000).alias("mem_bytes"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 4 + 1) * 1_000_000_000).alias("vram_bytes"),
        F.concat(F.lit("1"), F.col("user_id") % 6, F.lit(".0")).alias("system"),
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change events (path, op, event_id, ts)."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type").isin("click", "view"), "modify").otherwise("create")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("/u/file"), "user_id", F.lit(".txt")).alias("path"), op.alias("op"), "event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
