"""Queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, importance, jaccard_join, language_id, line_dedup, lm_scoring, packing, pii, quality, token_counts, token_store, whitening
from .shared import Workspace


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; see ``exact_dedup.exact_dedup`` for nulls, repeats and empty tables."""
    return exact_dedup.exact_dedup(_documents(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; see ``jaccard_join.jaccard_components`` for short, null and repeated rows."""
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), k=3, percent=90)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a piece of every document; see ``packing`` for nulls, repeats and empty tables."""
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; ``und`` without a letter; see ``language_id`` for nulls and empty tables."""
    docs = _documents(spark, sf_dir)
    # A null doc_id has no remainder: it is not held out, and the fit takes rows with an id only.
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; see ``quality.classify`` for nulls, repeats and empty tables."""
    return quality.classify(_documents(spark, sf_dir))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, as read back from the blocks; see ``token_store`` for nulls, repeats and empty tables."""
    path = Workspace(spark).path("tokens")
    token_store.write_tokens(_documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_tokens(spark, path)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document row and item it leaks; see ``decontaminate.leaked`` for nulls, repeats and empty tables."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.leaked(_documents(spark, sf_dir), benchmark)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms; see ``pii.pseudonymise`` for nulls, repeats and empty tables."""
    return pii.pseudonymise(_documents(spark, sf_dir), key="pseudonym key of the registered query")


def edit_script(docs: DataFrame) -> DataFrame:
    """Three edits of every document: words put in after a third, 20 characters taken out at the middle, 10 replaced at three quarters.

    A document with null text has none, one with empty text has them at its
    start; of rows that repeat a doc_id, each edit is the one that comes first in
    the text, whatever the rows' order. Other columns are not read, and an empty
    table has no edit.
    """
    n = F.length("text")

    def edit(seq: int, at, remove: int, insert: str):
        return F.struct(F.lit(seq).alias("seq"), F.floor(at).cast("int").alias("at"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))

    edits = F.array(edit(0, n / 3, 0, " inserted words"), edit(1, n / 2, 20, ""), edit(2, n * 3 / 4, 10, " 42 new\n"))
    each = docs.where("text is not null").select("doc_id", F.explode(edits).alias("e"))
    return each.groupBy("doc_id", "e.seq").agg(F.min("e").alias("e")).select("doc_id", "e.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, before and after ``edit_script``; see ``token_counts.apply_edits`` for nulls, repeats and empty tables."""
    docs = _documents(spark, sf_dir)
    return token_counts.count_edited(docs, edit_script(docs), public_tokenizers.path("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated blocks; see ``line_dedup.line_dedup`` for nulls, repeats and empty tables."""
    return line_dedup.line_dedup(_documents(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a usable row of ``embeddings`` and component; see ``whitening.components_of`` for nulls, repeats and empty tables."""
    found = whitening.components_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document, learned from those that are not held out; see ``lm_scoring.score`` for nulls, repeats and empty tables."""
    docs = _documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    found, model = lm_scoring.score(docs, ~held_out, public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumns({"held_out": ~F.col("learned"), "train_tokens": F.lit(model.tokens).cast("long")}).drop("learned")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a document; see ``importance.resample`` for nulls, ties, repeats and empty tables."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = importance.resample(_documents(spark, sf_dir), benchmark, seed=2024, percent=10)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


_ALL = (op1_exact_dedup, op2_jaccard_join, op3_best_fit_packing, op4_pii, op5_token_counts, op6_language_id, op7_line_dedup, op8_quality, op9_token_store, op10_decontamination, op11_whitening, op12_lm_scoring, op13_importance)
QUERIES = {f.__name__: f for f in _ALL}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS n FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(n) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY n)
    """,
    "op13_importance": r"""
        WITH letters AS (SELECT doc_id, FALSE AS target, text FROM documents UNION ALL SELECT NULL, TRUE, text FROM benchmark),
        split AS (SELECT doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM letters),
        each AS (SELECT doc_id, target, unnest(words) AS word FROM split),
        counted AS (SELECT word, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM each GROUP BY word),
        crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entries FROM range(256) r(i)),
        bytes AS (SELECT word, s, t, list_transform(range(octet_length(encode(word))), lambda k: CAST(16 * (strpos('0123456789ABCDEF', substr(hex(word), 2 * k + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(word), 2 * k + 2, 1)) - 1 AS BIGINT)) AS b FROM counted),
        hashed AS (SELECT word, s, t, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, entries[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc),
        totals AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM hashed),
        gains AS (SELECT bucket, floor(1000 * ln((sum(t) + 1)::DOUBLE * (any_value(s_all) + 10000) / ((sum(s) + 1)::DOUBLE * (any_value(t_all) + 10000)))) AS gain FROM hashed, totals GROUP BY bucket),
        weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM each JOIN hashed USING (word) JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
        digits AS (SELECT doc_id, lower(substr(sha256('2024:' || doc_id), 1, 8)) AS d FROM documents),
        noise AS (SELECT doc_id, list_sum(list_transform(range(8), lambda k: (strpos('0123456789abcdef', substr(d, k + 1, 1)) - 1) * pow(16, 7 - k)))::DOUBLE AS h FROM digits),
        scored AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
                   FROM documents d JOIN noise USING (doc_id) LEFT JOIN weights USING (doc_id)),
        drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
                  QUALIFY rank <= 10 * (SELECT count(*) FROM scored WHERE n_features >= 20) // 100)
        SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, rank::BIGINT AS rank FROM scored LEFT JOIN drawn USING (doc_id)
    """,
}
