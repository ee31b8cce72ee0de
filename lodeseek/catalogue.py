"""Registered queries of the engine, each with the equivalent DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import embed, ignore, tables
from .functions import text as tx
from .functions import vectors as vx
from .operators import history, indexing, projection, search, telemetry
from .plans import search_spec
from .sources import mapping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

QUERY, EPOCH = 7, mapping.EPOCH
NOW = EPOCH + 700_000
HISTORY_NOW = EPOCH + 10 * 86_400
POLICY = "*.csv\n!doc_1*.csv\nsrc3/\n/src1/en/\nsrc[4-6]/**/doc_?2.md\n"

#: Tables that several statements start from.
CHUNKS = """
    chunks AS (
        SELECT vec_id, vec_id // 3 AS fid, (vec_id % 3)::INT AS chunk_index,
               '/d' || (vec_id // 3) % 7 || '/file' || vec_id // 3 || '.' || ['txt', 'png', 'md', 'mp3', 'mp4', 'pdf'][((vec_id // 3) % 6 + 1)::INT] AS path,
               (1704067200 + (vec_id // 3) * 7919 % 1000000 + vec_id % 3)::DOUBLE AS modified, 100 + vec_id // 3 AS size,
               ['text', 'image', 'text', 'audio', 'video', 'scan'][((vec_id // 3) % 6 + 1)::INT] AS kind,
               'file' || vec_id // 3 || '#' || vec_id % 3 AS snippet, embedding::DOUBLE[] AS vec,
               CASE WHEN (vec_id // 3) % 6 = 5 THEN 'Page ' || (vec_id % 3 + 1) ELSE '' END AS locator
        FROM embeddings)
"""
SCORED = CHUNKS + ", scored AS (SELECT *, list_dot_product(vec, (SELECT vec FROM chunks WHERE vec_id = 7)) AS score FROM chunks)"
FILES = """
    files AS (
        SELECT doc_id, '/' || source || '/' || lang || '/doc_' || doc_id || '.' || ['txt', 'md', 'json', 'csv'][(doc_id % 4 + 1)::INT] AS path,
               (1704067200 + doc_id * 3600)::DOUBLE AS modified, octet_length(encode(text)) AS size, 'text' AS kind, text
        FROM documents)
"""
HISTORY = """
    items AS (
        SELECT conv_id, turn, split_part(text, chr(10), 1) AS query, conv_id % 5 = 0 AS bookmarked, 1704067200 + conv_id * 3600 + turn * 60 AS last_used FROM conversations),
    latest AS (
        SELECT arg_max(query, (last_used, query)) AS query, max(last_used) AS last_used, bool_or(bookmarked) AS bookmarked FROM items GROUP BY lower(query))
"""
RUNS = """
    runs AS (
        SELECT event_id AS run_id, CASE WHEN user_id % 29 <> 0 THEN 'chip' || user_id % 8 END AS chip, '0.' || user_id % 3 || '.' || user_id % 17 AS app_version,
               value AS files_per_sec, value * 1000 AS tokens_per_sec, epoch_us(ts) // 1000 AS created_at, sha256(user_id::VARCHAR) AS ip_hash,
               value * 3 AS seconds, CASE WHEN user_id % 4 <> 0 THEN value * 1e6 END AS vram_delta, CASE WHEN event_id % 3 <> 0 THEN (2020 + event_id % 6)::INT END AS release_year,
               CASE WHEN event_id % 2 = 0 THEN (event_id % 8 + 1) * 8000000000 END AS mem_bytes, CASE WHEN event_id % 5 = 0 THEN (event_id % 4 + 1) * 1000000000 END AS vram_bytes,
               '1' || user_id % 6 || '.0' AS system
        FROM events)
"""
EXT = "lower(regexp_extract(split_part(path, '/', -1), '[^.]\\.([^.]+)$', 1))"


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _hits(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6)).select("path", "score", "kind", "chunk_index", "snippet", "modified", "locator", "chunk_count")


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return mapping.query_vector(spark, sf_dir, QUERY)


def _search_sql(files: str = "true", rows: str = "true", k: int = 10, after: str = "") -> str:
    return f"""
        WITH {SCORED},
        fit AS (SELECT *, count(*) OVER (PARTITION BY path) AS chunk_count FROM scored),
        best AS (SELECT * FROM fit WHERE {files} AND {rows} QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_index) = 1),
        top AS (SELECT * FROM best ORDER BY score DESC, path LIMIT {k})
        SELECT path, round(score, 6) AS score, kind, chunk_index, snippet, modified, locator, chunk_count FROM top {after}
    """


# Search.


@query(_search_sql())
def search_topk(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10))


@query(_search_sql("kind IN ('text', 'audio')"))
def search_kind_filter(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10, kinds=frozenset({"text", "audio"})))


@query(_search_sql("(path = '/d3' OR starts_with(path, '/d3/'))"))
def search_folder_filter(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10, folder="/d3"))


@query(_search_sql("ends_with(lower(path), '.md')"))
def search_ext_filter(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10, ext="MD"))


@query(_search_sql(rows=f"modified >= {EPOCH + 500_001}"))
def search_since_filter(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10, since=float(EPOCH + 500_001)))


@query(_search_sql("kind IN ('text', 'scan') AND starts_with(path, '/d2/')", f"modified >= {EPOCH + 200_001}"))
def search_combined_filters(spark, d):
    return _hits(search.search(mapping.chunks(spark, d), _vector(spark, d), 10, frozenset({"text", "scan"}), "/d2", "", float(EPOCH + 200_001)))


@query(_search_sql(k=60, after="WHERE least(greatest(score, 0), 1) >= 0.2"))
def search_min_score_after_topk(spark, d):
    return _hits(search.run(mapping.chunks(spark, d), _vector(spark, d), search_spec.bind("anything score:20%"), NOW))


@query(_search_sql(k=60, after="ORDER BY lower(split_part(path, '/', -1)), path"))
def search_sort_name(spark, d):
    return _hits(search.run(mapping.chunks(spark, d), _vector(spark, d), search_spec.bind("anything sort:name"), NOW))


@query(_search_sql(f"kind = 'text'", k=60, after="ORDER BY modified DESC, path"))
def search_sort_date(spark, d):
    return _hits(search.run(mapping.chunks(spark, d), _vector(spark, d), search_spec.bind("anything type:text -type:scan sort:date"), NOW))


_BATCH = f"""
    WITH {CHUNKS}, scored AS (
        SELECT q.vec_id AS query_id, c.path, c.chunk_index, list_dot_product(c.vec, q.vec) AS score
        FROM chunks c, chunks q WHERE q.vec_id % 100 = 0),
    best AS (SELECT *, count(*) OVER (PARTITION BY query_id, path) AS chunk_count FROM scored
             QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY score DESC, chunk_index) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM best)
"""


@query(_BATCH + "SELECT query_id, path, round(score, 6) AS score, chunk_index, chunk_count, rank::INT AS rank FROM ranked WHERE rank <= 10")
def search_batch_topk(spark, d):
    return search.search_batch(mapping.chunks(spark, d), mapping.query_vectors(spark, d), 10).withColumn("score", F.round("score", 6))


@query(f"WITH {SCORED} SELECT chunk_index, round(score, 6) AS score, snippet, locator FROM scored WHERE path = '/d2/file2.md' ORDER BY score DESC, chunk_index LIMIT 6")
def rank_chunks(spark, d):
    return search.rank_chunks(mapping.chunks(spark, d), _vector(spark, d), "/d2/file2.md").withColumn("score", F.round("score", 6))


_FILE_VECTORS = f"""
    {CHUNKS}, each AS (SELECT path, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM chunks),
    mean AS (SELECT path, i, avg(x) AS x FROM each GROUP BY path, i),
    whole AS (SELECT path, list(x ORDER BY i) AS m, sqrt(sum(x * x)) AS n FROM mean GROUP BY path),
    vectors AS (SELECT path, list_transform(m, lambda x: x / n) AS vec FROM whole WHERE n > 0)
"""


@query(f"WITH {_FILE_VECTORS} SELECT path, unnest(list_transform(vec, lambda x: round(x, 6))) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vectors")
def file_vector(spark, d):
    return search.file_vectors(mapping.chunks(spark, d)).select("path", F.posexplode(F.transform("vec", lambda x: F.round(x, 6))).alias("i", "x")).select("path", "x", F.col("i").cast("long").alias("i"))


@query(
    f"""
    WITH {_FILE_VECTORS}, own AS (SELECT vec FROM vectors WHERE path = '/d2/file2.md'),
    best AS (SELECT path, max(list_dot_product(vec, (SELECT vec FROM own))) AS score, count(*) AS chunk_count FROM chunks GROUP BY path)
    SELECT path, round(score, 6) AS score, chunk_count FROM best ORDER BY score DESC, path LIMIT 10
    """
)
def find_similar(spark, d):
    return search.find_similar(mapping.chunks(spark, d), "/d2/file2.md", 10).select("path", F.round("score", 6).alias("score"), "chunk_count")


def _points(spark, d) -> DataFrame:
    return mapping.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


_KNN = """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings), ranked AS (
        SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.vec, b.vec) AS score,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.vec_id) AS rank
        FROM e a, e b WHERE a.vec_id <> b.vec_id)
    SELECT src, dst, round(score, 6) AS score, rank::INT AS rank FROM ranked WHERE rank <= 15
"""


@query(_KNN)
def knn_graph(spark, d):
    points = _points(spark, d)
    return projection.neighbours(points, points).withColumn("score", F.round("score", 6))


def _truncated(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("vec", vx.truncate(F.col("vec"), k))


_MRL = f"""
    WITH {CHUNKS}, short AS (
        SELECT * REPLACE (list_transform(vec[1:16], lambda x: x / sqrt(list_sum(list_transform(vec[1:16], lambda y: y * y)))) AS vec) FROM chunks)
"""


def _ranks_sql(table: str) -> str:
    return f"""
        SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM (
            SELECT q.vec_id AS query_id, c.path, max(list_dot_product(c.vec, q.vec)) AS score FROM {table} c, {table} q WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
    """


@query(
    f"""
    {_MRL}, exact AS ({_ranks_sql('chunks')}), found AS ({_ranks_sql('short')})
    SELECT round(avg(r), 6) AS recall FROM (
        SELECT query_id, count(f.path) / 10.0 AS r FROM (SELECT * FROM exact WHERE rank <= 10) e LEFT JOIN (SELECT * FROM found WHERE rank <= 10) f USING (query_id, path) GROUP BY query_id)
    """
)
def recall_at_k(spark, d):
    chunks, queries = mapping.chunks(spark, d), mapping.query_vectors(spark, d)
    found = search.search_batch(_truncated(chunks, 16), _truncated(queries, 16), 10)
    return search.recall_at(found, search.search_batch(chunks, queries, 10), 10).select(F.round("recall", 6).alias("recall"))


@query(
    f"""
    {_MRL}, found AS ({_ranks_sql('short')}), gold AS (SELECT vec_id AS query_id, path FROM chunks WHERE vec_id % 100 = 0)
    SELECT round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6)::DOUBLE AS top1, round(avg(CASE WHEN rank <= 50 THEN 1.0 / rank ELSE 0 END), 6)::DOUBLE AS mrr FROM gold JOIN found USING (query_id, path)
    """
)
def mrr_eval(spark, d):
    chunks, queries = mapping.chunks(spark, d), mapping.query_vectors(spark, d)
    gold = chunks.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "path")
    found = search.search_batch(_truncated(chunks, 16), _truncated(queries, 16), 50)
    return search.mean_reciprocal_rank(found, gold).select(F.round("top1", 6).alias("top1"), F.round("mrr", 6).alias("mrr"))


@query(_MRL + "SELECT vec_id, list_transform(vec, lambda x: round(x, 6)) AS vec FROM short")
def mrl_truncate(spark, d):
    return _truncated(mapping.chunks(spark, d), 16).select("vec_id", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


_BF16 = "CASE WHEN x = 0 THEN x ELSE round_even(x / pow(2, floor(log2(abs(x))) - 7), 0) * pow(2, floor(log2(abs(x))) - 7) END"


@query(f"SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: {_BF16}) AS vec FROM embeddings")
def bf16_roundtrip(spark, d):
    return mapping.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: vx.bf16(x)).alias("vec"))


_QUANT = """
    quant AS (
        SELECT vec_id, list_min(v) AS bias, (list_max(v) - list_min(v)) / 15 AS scale, v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)),
    codes AS (SELECT vec_id, scale, bias, list_transform(v, lambda x: CASE WHEN scale = 0 THEN 0 ELSE least(greatest(round_even((x - bias) / scale, 0), 0), 15)::INT END) AS codes FROM quant)
"""


@query(f"WITH {_QUANT} SELECT vec_id, round(scale, 6) AS scale, round(bias, 6) AS bias, codes FROM codes")
def quant4_codes(spark, d):
    one = vx.quantise4(F.col("embedding"))[0]
    return mapping.table(spark, d, "embeddings").select("vec_id", one.alias("q")).select("vec_id", F.round("q.scale", 6).alias("scale"), F.round("q.bias", 6).alias("bias"), "q.codes")


@query(
    f"""
    WITH {SCORED}, {_QUANT}, own AS (SELECT vec AS q FROM chunks WHERE vec_id = 7),
    coarse AS (SELECT vec_id, path, chunk_index, score, list_dot_product(list_transform(codes, lambda c: c * scale + bias), (SELECT q FROM own)) AS rough FROM scored JOIN codes USING (vec_id)),
    chosen AS (SELECT * FROM coarse ORDER BY rough DESC, path, chunk_index LIMIT 64),
    best AS (SELECT * FROM chosen QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_index) = 1)
    SELECT path, round(score, 6) AS score, chunk_index FROM best ORDER BY score DESC, path LIMIT 10
    """
)
def funnel_search(spark, d):
    chunks = mapping.chunks(spark, d)
    codes = chunks.select("path", "chunk_index", vx.quantise4(F.col("vec")).alias("groups"))
    return search.funnel(chunks, codes, _vector(spark, d), 10).withColumn("score", F.round("score", 6))


@query(
    f"""
    WITH {CHUNKS}, files AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS idx FROM (SELECT DISTINCT path FROM chunks)),
    size AS (SELECT count(*) AS n FROM files), marks AS (SELECT j, floor(j * (n / 16.0))::BIGINT AS idx FROM range(16) t(j), size),
    rest AS (SELECT idx, 16 + row_number() OVER (ORDER BY idx) - 1 AS place FROM files WHERE idx NOT IN (SELECT idx FROM marks))
    SELECT path, idx, m.j IS NOT NULL AS is_landmark, coalesce(m.j, r.place) AS place FROM files LEFT JOIN marks m USING (idx) LEFT JOIN rest r USING (idx) WHERE coalesce(m.j, r.place) < 60
    """
)
def landmark_sample(spark, d):
    files = search.with_index(mapping.chunks(spark, d).select("path").distinct())
    return search.landmarks(files, 16, 60).select("path", "idx", "is_landmark", "place")


@query()
def pca_project(spark, d):
    points = mapping.chunks(spark, d)
    mean, top, _ = projection.components(points)
    return projection.project(points, mean, top)


@query(
    """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings),
    near AS (
        SELECT a.vec_id AS id, b.vec[1] AS x, b.vec[2] AS y, 1 / (2 - 2 * list_dot_product(a.vec, b.vec) + 1e-4) AS w
        FROM e a, e b WHERE a.vec_id % 5 <> 0 AND b.vec_id % 5 = 0
        QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.vec, b.vec) DESC, b.vec_id) <= 15)
    SELECT id, round(sum(w * x) / sum(w), 6) AS x, round(sum(w * y) / sum(w), 6) AS y FROM near GROUP BY id
    """
)
def idw_place(spark, d):
    points = _points(spark, d)
    marks = points.where("id % 5 = 0").withColumns({"x": F.col("vec")[0].cast("double"), "y": F.col("vec")[1].cast("double")})
    return projection.place_rest(points.where("id % 5 <> 0"), marks).select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def force_map(spark, d):
    return projection.embedding_map(_points(spark, d).withColumn("path", F.col("id").cast("string")))


# Text.

_WINDOWS = """
    counted AS (SELECT doc_id, text, CASE WHEN length(text) <= 1800 THEN 1 ELSE ceil((length(text) - 1800) / 1600.0)::INT + 1 END AS n FROM documents),
    windows AS (SELECT doc_id, text AS whole, n, unnest(range(n)) AS chunk_index FROM counted)
"""


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_index::INT AS chunk_index, md5(substring(whole, chunk_index * 1600 + 1, 1800)) AS digest, length(substring(whole, chunk_index * 1600 + 1, 1800)) AS n_chars FROM windows")
def chunk_documents(spark, d):
    each = mapping.table(spark, d, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c"))
    return each.select("doc_id", "c.chunk_index", F.md5(F.col("c.text").cast("binary")).alias("digest"), F.length("c.text").cast("long").alias("n_chars"))


@query(
    f"""
    WITH {_WINDOWS}, heads AS (SELECT *, substring(whole, 1, chunk_index * 1600) AS head FROM windows)
    SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN n = 1 THEN '' ELSE 'Line ' || (1 + length(head) - length(replace(head, chr(10), ''))) END AS locator FROM heads
    """
)
def line_locators(spark, d):
    return mapping.table(spark, d, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"))).alias("c")).select("doc_id", "c.chunk_index", "c.locator")


@query(
    f"""
    WITH {_WINDOWS}
    SELECT doc_id, chunk_index::INT AS chunk_index, CASE WHEN n = 1 THEN '' ELSE 'Page ' || (chunk_index * 1600 // 1000 + 1) END AS locator FROM windows
    """
)
def page_locators(spark, d):
    starts = F.sequence(F.lit(0), F.length("text"), F.lit(1000))
    return mapping.table(spark, d, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"), pages=starts)).alias("c")).select("doc_id", "c.chunk_index", "c.locator")


@query(r"SELECT doc_id, substring(array_to_string(list_filter(regexp_split_to_array(text, '[\n\t]'), lambda x: x <> ''), ' '), 1, 220) AS snippet FROM documents")
def snippets(spark, d):
    return mapping.table(spark, d, "documents").select("doc_id", tx.snippet(F.col("text")).alias("snippet"))


@query(
    """
    WITH m AS (SELECT event_id, value * 40 AS d, greatest(1, ceil(value * 40 / 240)::INT) AS n FROM events),
    s AS (SELECT event_id, d, unnest(range(n))::INT AS chunk_index FROM m)
    SELECT event_id, chunk_index, chunk_index * 240.0::DOUBLE AS start_s, round(least(d, (chunk_index + 1) * 240), 6)::DOUBLE AS end_s,
           CASE WHEN chunk_index * 240 >= 3600 THEN format('{}:{:02d}:{:02d}', chunk_index * 240 // 3600, chunk_index * 240 // 60 % 60, chunk_index * 240 % 60)
                ELSE format('{}:{:02d}', chunk_index * 240 // 60, chunk_index * 240 % 60) END AS locator
    FROM s
    """
)
def media_segments(spark, d):
    each = mapping.table(spark, d, "events").select("event_id", F.explode(tx.segments(F.col("value") * 40)).alias("s"))
    return each.select("event_id", "s.chunk_index", F.col("s.start").alias("start_s"), F.round("s.end", 6).alias("end_s"), "s.locator")


@query("SELECT doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '[ \\n\\t]'), lambda x: x <> ''))) AS tokens FROM documents")
def token_estimate(spark, d):
    return mapping.table(spark, d, "documents").select("doc_id", tx.token_estimate(F.array("text")).cast("long").alias("tokens"))


@query(f"WITH {CHUNKS} SELECT kind, count(*) AS files FROM (SELECT DISTINCT path, CASE WHEN {EXT} IN ('png') THEN 'image' WHEN {EXT} = 'mp4' THEN 'video' WHEN {EXT} = 'mp3' THEN 'audio' ELSE 'text' END AS kind FROM chunks) GROUP BY kind")
def ext_kind_scan(spark, d):
    return mapping.chunks(spark, d).select("path").distinct().groupBy(tx.kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("files"))


@query(
    """
    SELECT doc_id, CASE WHEN octet_length(encode(text)) < 2000000 THEN sha256(text) END AS digest FROM documents
    """
)
def utf8_cap_decode(spark, d):
    files = mapping.table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return files.select("doc_id", F.sha2(tx.decode(F.col("content")).cast("binary"), 256).alias("digest"))


_IGNORED = {
    "csv": r"regexp_matches(p, '(^|/)[^/]*\.csv(/.*)?$')",
    "not": r"regexp_matches(p, '(^|/)doc_1[^/]*\.csv(/.*)?$')",
    "glob": r"regexp_matches(p, '^/src[4-6]/(.*/)?doc_[^/]2\.md(/.*)?$')",
}


@query(
    f"""
    WITH {FILES}, f AS (SELECT path, path AS p FROM files)
    SELECT path, CASE WHEN {_IGNORED['glob']} THEN true WHEN {_IGNORED['not']} THEN false ELSE {_IGNORED['csv']} END AS ignored FROM f
    """
)
def ignore_last_match(spark, d):
    return mapping.files(spark, d).select("path", ignore.ignored(F.col("path"), F.lit(False), ignore.parse(POLICY)).alias("ignored"))


_ANCESTORS = f"""
    WITH {FILES}, f AS (SELECT path, path AS p FROM files), v AS (
        SELECT path, starts_with(path, '/src3/') OR starts_with(path, '/src1/en/') OR CASE WHEN {_IGNORED['glob']} THEN true WHEN {_IGNORED['not']} THEN false ELSE {_IGNORED['csv']} END AS ignored FROM f)
"""


@query(_ANCESTORS + "SELECT path, ignored FROM v")
def ignore_ancestors(spark, d):
    return mapping.files(spark, d).select("path", ignore.ignored_with_ancestors(F.col("path"), F.lit(False), ignore.parse(POLICY)).alias("ignored"))


@query(
    _ANCESTORS
    + """
    SELECT count_if(NOT ignored)::BIGINT AS kept, count_if(ignored)::BIGINT AS removed, (SELECT list(path ORDER BY path) FROM (SELECT path FROM v WHERE ignored ORDER BY path LIMIT 12)) AS samples,
           CASE WHEN count_if(ignored) > 0 AND count_if(NOT ignored) = 0 THEN 'all' WHEN count_if(ignored) > 0 AND count_if(ignored) * 2 >= count(*) THEN 'half' ELSE '' END AS danger FROM v
    """
)
def ignore_preview(spark, d):
    return ignore.preview(mapping.files(spark, d), ignore.parse(POLICY))


@query(
    r"""
    WITH h AS (SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(split_part(text, chr(10), 1), '\s+'), lambda x: x <> ''), ' ') AS text, turn % 6 AS k FROM conversations)
    SELECT conv_id, turn, text, CASE k WHEN 1 THEN ['image'] WHEN 2 THEN ['audio', 'image', 'video'] ELSE [] END AS kinds, CASE k WHEN 3 THEN 'md' ELSE '' END AS ext,
        CASE k WHEN 4 THEN '/d1/My Files' END AS folder, CASE k WHEN 3 THEN 'month' WHEN 5 THEN 'week' ELSE 'any' END AS range, CASE k WHEN 4 THEN 0.5 ELSE 0 END::DOUBLE AS min_score,
        CASE k WHEN 5 THEN 'name' ELSE 'relevance' END AS sort,
        trim(text || ' ' || CASE k WHEN 1 THEN 'type:image' WHEN 2 THEN 'type:audio,image,video' WHEN 3 THEN 'ext:md date:month' WHEN 4 THEN 'in:"/d1/My Files" score:50%' WHEN 5 THEN 'date:week sort:name' ELSE '' END) AS canonical
    FROM h
    """
)
def parse_query_batch(spark, d):
    schema = "text string, kinds array<string>, ext string, folder string, range string, min_score double, sort string, canonical string"

    @F.pandas_udf(schema)
    def bound(queries):
        import pandas as pd

        specs = [search_spec.bind(q) for q in queries]
        return pd.DataFrame([(s.text, sorted(s.kinds), s.ext, s.folder, s.range, s.min_score, s.sort, search_spec.serialise(s)) for s in specs], columns=["text", "kinds", "ext", "folder", "range", "min_score", "sort", "canonical"])

    extra = F.element_at(F.array(*map(F.lit, ["", " type:image", " -type:text", " ext:.md after:14d", ' in:"/d1/My Files" score:50%', " sort:name date:week"])), (F.col("turn") % 6).cast("int") + 1)
    return mapping.history(spark, d).select("conv_id", "turn", bound(F.concat("query", extra)).alias("s")).select("conv_id", "turn", "s.*")


# History.


@query(
    f"""
    WITH {HISTORY} SELECT query, last_used, bookmarked FROM latest a WHERE bookmarked OR NOT EXISTS (
        SELECT 1 FROM latest b WHERE b.last_used >= a.last_used AND starts_with(lower(b.query), lower(a.query)) AND length(b.query) > length(a.query) AND length(a.query) >= 2)
    """
)
def history_prefix_collapse(spark, d):
    return history.collapse(history.latest(mapping.history(spark, d)))


@query(
    f"""
    WITH {HISTORY}, g AS (SELECT *, {HISTORY_NOW // 86_400} - last_used // 86400 AS days FROM latest)
    SELECT query, last_used, CASE WHEN bookmarked THEN 'Bookmarks' WHEN days <= 0 THEN 'Today' WHEN days = 1 THEN 'Yesterday' WHEN days < 7 THEN 'Previous 7 Days' ELSE 'Earlier' END AS label FROM g
    """
)
def history_groups(spark, d):
    return history.latest(mapping.history(spark, d)).select("query", "last_used", history.group_of(F.col("bookmarked"), F.col("last_used"), HISTORY_NOW).alias("label"))


@query(
    f"""
    WITH {HISTORY}, r AS (SELECT * FROM latest WHERE NOT bookmarked AND last_used >= {HISTORY_NOW - 7 * 86_400} ORDER BY last_used DESC, query LIMIT 200)
    SELECT query, last_used, bookmarked FROM latest WHERE bookmarked UNION ALL SELECT query, last_used, bookmarked FROM r
    """
)
def history_prune(spark, d):
    return history.prune(history.latest(mapping.history(spark, d)), HISTORY_NOW)


# Index.

_KEY = "'1|text|' || ['txt', 'md', 'json', 'csv'][(doc_id % 4 + 1)::INT] || '|m64|c1800,o200|' || sha256(text)"


@query(f"WITH {FILES} SELECT path, {_KEY} AS key FROM files")
def content_keys(spark, d):
    return mapping.files(spark, d).select("path", tx.content_key(F.col("kind"), F.col("path"), F.col("text").cast("binary"), 64, "c1800,o200").alias("key"))


@query(
    f"""
    WITH {FILES}, keyed AS (SELECT *, {_KEY} AS key FROM files), owners AS (SELECT key, min(path) AS source FROM keyed WHERE doc_id % 7 <> 0 GROUP BY key)
    SELECT path, source, source IS NOT NULL AS reused FROM keyed LEFT JOIN owners USING (key)
    """
)
def dedup_reuse(spark, d):
    files = mapping.files(spark, d)
    keyed = files.select("doc_id", "path", "modified", tx.content_key(F.col("kind"), F.col("path"), F.col("text").cast("binary"), 64, "c1800,o200").alias("key"))
    # Of every seventh file the chunks no longer carry the modification time on record.
    chunks = files.select("path", (F.col("modified") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)).alias("modified"), F.array_repeat(F.lit(0.125), 64).alias("vec"))
    owners = indexing.reusable(keyed, chunks, 64)
    return keyed.join(owners, "key", "left").select("path", "source", F.col("source").isNotNull().alias("reused"))


_SNAPSHOTS = f"""
    {FILES}, known AS (SELECT path, modified, size, kind FROM files WHERE doc_id % 10 <> 3),
    crawl AS (SELECT path, modified + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS modified, size FROM files WHERE doc_id % 17 <> 5)
"""


def _snapshots(spark, d) -> tuple[DataFrame, DataFrame]:
    files = mapping.files(spark, d)
    crawl = files.where("doc_id % 17 <> 5").withColumn("modified", F.col("modified") + F.when(F.col("doc_id") % 13 == 0, 1).otherwise(0))
    return crawl.select("path", "modified", "size"), files.where("doc_id % 10 <> 3").select("path", "modified", "size", "kind")


@query(
    f"""
    WITH {_SNAPSHOTS} SELECT path, CASE WHEN k.modified IS NULL THEN 'new' WHEN c.modified IS NULL THEN 'gone' WHEN c.modified = k.modified AND c.size = k.size THEN 'unchanged' ELSE 'modified' END AS status
    FROM crawl c FULL JOIN known k USING (path)
    """
)
def change_detect(spark, d):
    return indexing.changes(*_snapshots(spark, d))


@query(f"WITH {_SNAPSHOTS} SELECT path FROM known WHERE (starts_with(path, '/src1/') OR starts_with(path, '/src2/')) AND NOT starts_with(path, '/src2/fr/') AND path NOT IN (SELECT path FROM crawl)")
def reconcile_stale(spark, d):
    crawl, known = _snapshots(spark, d)
    ignored = ignore.ignored_with_ancestors(F.col("path"), F.lit(False), ignore.parse("/src2/fr/\n"))
    return indexing.stale(known, crawl, ["/src1", "/src2", "/nowhere"], frozenset({"text"}), ignored)


@query(
    f"""
    WITH {CHUNKS}, new AS (SELECT path, chunk_index, 'new ' || snippet AS snippet FROM chunks WHERE fid % 5 = 0 AND chunk_index < 2)
    SELECT path, chunk_index, snippet FROM chunks WHERE path NOT IN (SELECT path FROM new) UNION ALL SELECT * FROM new
    """
)
def replace_snapshot(spark, d):
    rows = mapping.chunks(spark, d).select("path", "chunk_index", "snippet", "fid")
    new = rows.where("fid % 5 = 0 and chunk_index < 2").withColumn("snippet", F.concat(F.lit("new "), "snippet"))
    return indexing.replace(rows, new).select("path", "chunk_index", "snippet")


@query(f"WITH {CHUNKS} SELECT path, chunk_index FROM chunks WHERE NOT starts_with(path, '/d3/')")
def delete_under_folder(spark, d):
    return indexing.delete_under(mapping.chunks(spark, d), "/d3/").select("path", "chunk_index")


@query(f"WITH {CHUNKS} SELECT path, chunk_index FROM chunks WHERE kind NOT IN ('audio', 'scan')")
def delete_kinds(spark, d):
    return indexing.delete_kind(mapping.chunks(spark, d), ["audio", "scan"]).select("path", "chunk_index")


@query(f"WITH {CHUNKS} SELECT path, chunk_index FROM chunks WHERE {EXT} NOT IN ('md', 'png')")
def delete_extensions(spark, d):
    return indexing.delete_extensions(mapping.chunks(spark, d), ["MD", "png"]).select("path", "chunk_index")


@query(f"WITH {CHUNKS} SELECT path, chunk_index, CASE WHEN fid % 6 = 5 AND fid % 4 <> 3 THEN 'scan' WHEN fid % 6 = 5 THEN 'text' ELSE kind END AS kind FROM chunks")
def scan_relabel(spark, d):
    base = tx.basename(F.col("path"))
    pdf = F.col("fid") % 6 == 5
    page = F.concat(base, F.lit(" - page "), F.col("chunk_index") + 1)
    # PDFs whose last chunk has text of its own stay texts.
    shown = F.when(pdf & ((F.col("fid") % 4 != 3) | (F.col("chunk_index") < 2)), page).when(pdf, F.lit("words of a page")).otherwise(F.col("snippet"))
    rows = mapping.chunks(spark, d).withColumn("snippet", shown).withColumn("kind", F.when(pdf, "text").otherwise(F.col("kind")))
    # A file with fewer than three chunks is the last one only; it has no text of its own.
    whole = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(whole, "path").withColumn("snippet", F.when(pdf & (F.col("fid") % 4 == 3) & (F.col("n") < 3), "words of a page").otherwise(F.col("snippet"))).drop("n")
    return indexing.relabel_scans(rows).select("path", "chunk_index", "kind")


@query(
    f"""
    WITH {CHUNKS} SELECT count(DISTINCT path) AS files, count(*) AS chunks, list_sort(list(DISTINCT kind)) AS kinds, list_sort(list(DISTINCT {EXT})) AS exts FROM chunks
    """
)
def index_summary(spark, d):
    return indexing.summary(mapping.chunks(spark, d))


@query(f"WITH {CHUNKS} SELECT path, max(modified) AS modified, max(size) AS size, max(kind) AS kind FROM chunks GROUP BY path")
def indexed_files(spark, d):
    return indexing.indexed_files(mapping.chunks(spark, d))


@query(
    f"""
    WITH {CHUNKS}, f(folder) AS (VALUES ('/d0'), ('/d3'), ('/d'), ('/d5/file5.pdf'), ('/none'))
    SELECT folder, count(DISTINCT path) AS files FROM f LEFT JOIN chunks ON path = folder OR starts_with(path, folder || '/') GROUP BY folder
    """
)
def folder_counts(spark, d):
    folders = spark.createDataFrame([("/d0",), ("/d3",), ("/d",), ("/d5/file5.pdf",), ("/none",)], "folder string")
    return indexing.folder_counts(mapping.chunks(spark, d), folders)


@query(f"WITH {CHUNKS} SELECT kind, {EXT} AS ext, count(DISTINCT path) AS files, count(*) AS chunks FROM chunks GROUP BY 1, 2")
def kind_ext_counts(spark, d):
    return mapping.chunks(spark, d).groupBy("kind", tx.extension(F.col("path")).alias("ext")).agg(F.count_distinct("path").alias("files"), F.count(F.lit(1)).alias("chunks"))


@query(f"WITH {FILES} SELECT path, '/' || split_part(path, '/', 2) AS root, row_number() OVER (PARTITION BY split_part(path, '/', 2) ORDER BY path)::INT AS turn FROM files")
def interleave_roots(spark, d):
    rows = mapping.files(spark, d).select("path", F.concat(F.lit("/"), F.split("path", "/")[1]).alias("root"))
    return indexing.interleave(rows)


@query(
    f"""
    WITH {FILES}, roots AS (
        SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN '/' || source ELSE '/' || source || '/' || lang END AS path FROM documents WHERE source <> 'src7' OR doc_id % 3 <> 0)
    SELECT path FROM roots a WHERE NOT EXISTS (SELECT 1 FROM roots b WHERE starts_with(a.path, b.path || '/'))
    """
)
def roots_canonical(spark, d):
    own = F.concat(F.lit("/"), "source")
    rows = mapping.table(spark, d, "documents").where("source <> 'src7' or doc_id % 3 <> 0")
    return indexing.canonical_roots(rows.select(F.when(F.col("doc_id") % 3 == 0, own).otherwise(F.concat(own, F.lit("/"), "lang")).alias("path")))


@query(f"WITH {CHUNKS} SELECT path, NOT bool_or(vec_id % 11 = 0) AS sound FROM chunks GROUP BY path")
def finite_gate(spark, d):
    broken = F.transform("vec", lambda x, i: F.when((F.col("vec_id") % 11 == 0) & (i == 3), float("nan")).otherwise(x))
    return indexing.finite_files(mapping.chunks(spark, d).withColumn("vec", broken))


# Telemetry.


@query(
    f"""
    WITH {RUNS} SELECT coalesce(chip, 'Unknown') AS chip, count(*) AS runs, round(median(files_per_sec), 4) AS median_files, round(median(tokens_per_sec), 4) AS median_tokens,
        round(stddev_samp(files_per_sec), 4) AS std_files, round(stddev_samp(tokens_per_sec), 2) AS std_tokens FROM runs GROUP BY 1
    """
)
def telemetry_by_chip(spark, d):
    rows = telemetry.by_chip_and_version(mapping.telemetry(spark, d)).where("level = 'chip'")
    return rows.select("chip", "runs", F.round("median_files", 4).alias("median_files"), F.round("median_tokens", 4).alias("median_tokens"), F.round("std_files", 4).alias("std_files"), F.round("std_tokens", 2).alias("std_tokens"))


@query(
    f"""
    WITH {RUNS}, r AS (SELECT * REPLACE (coalesce(chip, 'Unknown') AS chip) FROM runs)
    SELECT CASE WHEN grouping(chip) = 1 THEN 'version' ELSE 'chip_version' END AS level, chip, app_version, count(*) AS runs, round(median(files_per_sec), 4) AS median_files, max(created_at) AS last
    FROM r GROUP BY GROUPING SETS ((chip, app_version), (app_version))
    """
)
def telemetry_by_version(spark, d):
    rows = telemetry.by_chip_and_version(mapping.telemetry(spark, d)).where("level <> 'chip'")
    return rows.select("level", "chip", "app_version", "runs", F.round("median_files", 4).alias("median_files"), "last")


@query(f"WITH {RUNS} SELECT run_id, floor(files_per_sec * 10 + 0.5) / 10 AS files_per_sec, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 25")
def telemetry_recent(spark, d):
    return telemetry.recent(mapping.telemetry(spark, d)).select("run_id", "files_per_sec", "created_at")


_VALID = "length(run_id) BETWEEN 8 AND 64 AND files BETWEEN 0 AND 200000 AND seconds BETWEEN 0 AND 86400 AND error_rate BETWEEN 0 AND 1 AND dataset IN ('v1', 'v2')"


@query(
    f"""
    WITH p AS (SELECT event_id, 'run-' || event_id * 7919 AS run_id, event_id * 31 % 250000 AS files, user_id * 97 AS seconds, value / 100 AS error_rate, 'v' || event_id % 3 AS dataset FROM events)
    SELECT event_id, {_VALID} AS accepted FROM p
    """
)
def telemetry_validate(spark, d):
    posts = mapping.table(spark, d, "events").select(
        "event_id",
        F.concat(F.lit("run-"), F.col("event_id") * 7919).alias("run_id"),
        (F.col("event_id") * 31 % 250_000).alias("files"),
        (F.col("user_id") * 97).alias("seconds"),
        (F.col("value") / 100).alias("error_rate"),
        F.concat(F.lit("v"), F.col("event_id") % 3).alias("dataset"),
    )
    return posts.select("event_id", telemetry.valid(posts.columns).alias("accepted"))


@query(f"WITH {RUNS} SELECT run_id, created_at // 3600000 AS hour, row_number() OVER (PARTITION BY ip_hash, created_at // 3600000 ORDER BY created_at, run_id) <= 2 AS allowed FROM runs")
def rate_limit_hourly(spark, d):
    return telemetry.limited(mapping.telemetry(spark, d), 2).select("run_id", "hour", "allowed")


@query(
    """
    WITH RECURSIVE s AS (
        SELECT user_id, event_id, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS t, sum((event_id % 3)::DOUBLE) OVER w AS n, row_number() OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    f AS (
        SELECT user_id, k, t, n, NULL::DOUBLE AS rate FROM s WHERE k = 1
        UNION ALL
        SELECT s.user_id, s.k, CASE WHEN s.t - f.t < 0.4 THEN f.t ELSE s.t END, CASE WHEN s.t - f.t < 0.4 THEN f.n ELSE s.n END,
               CASE WHEN s.t - f.t < 0.4 OR s.n = f.n THEN f.rate WHEN f.rate IS NULL THEN (s.n - f.n) / (s.t - f.t) ELSE f.rate * 0.5 + (s.n - f.n) / (s.t - f.t) * 0.5 END
        FROM f JOIN s ON s.user_id = f.user_id AND s.k = f.k + 1)
    SELECT user_id, round(arg_max(rate, k), 9) AS rate FROM f GROUP BY user_id HAVING arg_max(rate, k) IS NOT NULL
    """
)
def ewma_rate(spark, d):
    events = mapping.table(spark, d, "events").select("user_id", "event_id", (F.unix_millis(F.col("ts").cast("timestamp")) / 1000).alias("t"))
    n = F.sum((F.col("event_id") % 3).cast("double")).over(Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return telemetry.smoothed(events.withColumn("n", n), "user_id").select("user_id", F.round("rate", 9).alias("rate")).where("rate is not null")


@query(f"WITH {RUNS}, v AS (SELECT DISTINCT app_version FROM runs) SELECT app_version, row_number() OVER (ORDER BY list_transform(string_split(app_version, '.'), lambda x: x::INT) DESC)::INT AS place FROM v")
def version_sort(spark, d):
    versions = mapping.telemetry(spark, d).select("app_version").distinct()
    return search.with_index(versions, F.desc(telemetry.version_key(F.col("app_version")))).select("app_version", (F.col("idx") + 1).cast("int").alias("place"))


@query()
def embed_hash(spark, d):
    rows = mapping.table(spark, d, "documents").select("doc_id", "text")
    return embed.embed(rows, embed.HashEmbedder(), prefix=embed.DOCUMENT_PREFIX).select("doc_id", "vec")


@query(
    """
    WITH e AS (SELECT '/u/file' || user_id || '.txt' AS path, event_id, CASE event_type WHEN 'error' THEN 'delete' ELSE 'change' END AS op, user_id FROM events),
    last AS (SELECT path, max(event_id) AS event_id, arg_max(op, event_id) AS op FROM e GROUP BY path),
    t AS (SELECT *, 'words of ' || split_part(path, '/', -1) || ' after ' || event_id % 50 AS words FROM last WHERE op <> 'delete')
    SELECT path, event_id::DOUBLE AS modified, octet_length(encode(words)) AS size, 'text' AS kind, 0::INT AS chunk_index, words AS snippet FROM t
    """
)
def stream_live_update(spark, d):
    """Replay the change events in micro-batches into a store: each is classified, read, embedded and merged."""
    from .plans.live import replay_changes

    return replay_changes(spark, d)


@query(
    rf"""
    WITH {FILES}, t AS (SELECT doc_id, path, modified, size, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM files),
    n AS (SELECT *, CASE WHEN length(text) <= 1800 THEN 1 ELSE ceil((length(text) - 1800) / 1600.0)::INT + 1 END AS n FROM t WHERE text <> ''),
    w AS (SELECT *, unnest(range(n)) AS i FROM n),
    c AS (SELECT *, substring(text, 1, i * 1600) AS head, array_to_string(list_filter(regexp_split_to_array(substring(text, i * 1600 + 1, 1800), '[\n\t]'), lambda x: x <> ''), ' ') AS line FROM w),
    twice AS (
        SELECT path, modified + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS modified, CASE WHEN doc_id % 7 = 0 THEN 'reused' ELSE 'unchanged' END AS status, size, i, n, head, line FROM c
        UNION ALL SELECT '/copies' || path, modified + 2, 'reused', size, i, n, head, line FROM c)
    SELECT path, modified, size, i::INT AS chunk_index, CASE WHEN n = 1 THEN '' ELSE 'Line ' || (1 + length(head) - length(replace(head, chr(10), ''))) END AS locator, substring(line, 1, 220) AS snippet, status FROM twice
    """
)
def index_pass(spark, d):
    """Two index passes over all documents; see ``plans.live.two_passes``."""
    from .plans.live import two_passes

    return two_passes(spark, d)


@query(
    f"""
    WITH {CHUNKS}, now AS (
        SELECT CASE WHEN fid % 7 IN (1, 2) THEN regexp_replace(path, '\\.txt$', '.md') ELSE path END AS path, kind FROM chunks WHERE fid % 7 NOT IN (1, 2) OR chunk_index < 2)
    SELECT kind, {EXT} AS ext, count(DISTINCT path) AS files, count(*) AS chunks, true AS sound FROM now GROUP BY 1, 2
    """
)
def incremental_counters(spark, d):
    from .plans.live import kept_counters

    return kept_counters(spark, d).select("kind", "ext", "files", "chunks", "sound")


_ASKED = [(f"/d{i % 7}/file{i}.{e}",) for i, e in enumerate("txt png md mp3 mp4 pdf".split() * 3)] + [("/none.txt",)]
_ASKED_SQL = "asked(path) AS (VALUES " + ", ".join(f"('{p}')" for (p,) in _ASKED) + ")"


@query(f"WITH {CHUNKS}, {_ASKED_SQL} SELECT path, max(modified) AS modified, max(size) AS size, max(kind) AS kind FROM chunks JOIN asked USING (path) GROUP BY path")
def stored_files(spark, d):
    return indexing.stored_files(mapping.chunks(spark, d), spark.createDataFrame(_ASKED, "path string"))


@query(f"WITH {CHUNKS}, {_ASKED_SQL} SELECT path, count(vec_id) AS chunks FROM asked LEFT JOIN chunks USING (path) GROUP BY path")
def chunk_counts(spark, d):
    return indexing.chunk_counts(mapping.chunks(spark, d), spark.createDataFrame(_ASKED, "path string"))


@query(f"WITH {CHUNKS} SELECT count(DISTINCT path) AS files FROM chunks WHERE kind IN ('image', 'scan')")
def file_count_kinds(spark, d):
    return indexing.file_count(mapping.chunks(spark, d), ["image", "scan"])


@query(f"WITH {CHUNKS} SELECT DISTINCT path, kind, CASE kind WHEN 'image' THEN 1 WHEN 'audio' THEN 2 WHEN 'video' THEN 3 ELSE 4 END::INT AS place FROM chunks")
def kind_order(spark, d):
    from .plans.index_pass import in_kind_order

    return mapping.chunks(spark, d).select("path", "kind", in_kind_order(F.col("kind")).alias("place")).distinct()


@query(f"WITH {FILES} SELECT '/' || split_part(path, '/', 2) AS root, count(*) FILTER (doc_id % 3 = 0) AS done, count(*) AS total, round(count(*) FILTER (doc_id % 3 = 0) / count(*), 6) AS fraction FROM files GROUP BY 1")
def root_progress(spark, d):
    files = mapping.files(spark, d).select("doc_id", "path", F.concat(F.lit("/"), F.split("path", "/")[1]).alias("root"))
    return telemetry.progress(files, files.where("doc_id % 3 = 0")).withColumn("fraction", F.round("fraction", 6))


@query(
    f"""
    WITH {CHUNKS} SELECT path, chunk_index, CASE WHEN kind = 'video' THEN chunk_index > 0 WHEN {EXT} = 'pdf' THEN chunk_index > 1 ELSE false END AS expected FROM chunks
    """
)
def preview_expected(spark, d):
    at = F.col("chunk_index")
    where = F.when(F.col("kind") == "video", F.when(at > 0, tx.clock(at * 240.0)).otherwise(F.lit(""))).otherwise(F.concat(F.lit("Page "), at - 1))
    page = F.when(at > 0, where).otherwise(F.lit("Line 3"))
    shown = F.when(page == "Page 0", F.lit("Page x")).otherwise(page)
    return mapping.chunks(spark, d).select("path", "chunk_index", tx.expects_preview(F.col("path"), F.col("kind"), F.when(F.col("kind") == "video", where).otherwise(shown)).alias("expected"))


@query(
    r"""
    WITH t AS (SELECT doc_id, text, octet_length(encode(text)) AS bytes, regexp_replace(text, '[^\x00-\x{FF}]', '?', 'g') AS latin FROM documents WHERE text IS NOT NULL),
    p AS (SELECT *, length(regexp_extract(latin, '^[\x00-\x7F]*')) + 1 AS first, list_max(list_filter(range(0, 200), lambda k: octet_length(encode(substring(text, 1, k))) <= 199)) AS fit FROM t)
    SELECT doc_id, md5(CASE WHEN bytes >= 199 THEN substring(text, 1, fit) ELSE text END) AS utf8,
           md5(CASE WHEN length(latin) >= 199 AND first BETWEEN 197 AND 199 THEN substring(latin, 1, first - 1) ELSE substring(latin, 1, 199) END) AS latin1
    FROM p
    """
)
def decode_at_cap(spark, d):
    """Texts cut at a cap within a character, and texts that are not UTF-8."""
    rows = mapping.table(spark, d, "documents").where("text is not null")
    own = lambda c: F.md5(tx.decode(c, 199).cast("binary"))
    return rows.select("doc_id", own(F.col("text").cast("binary")).alias("utf8"), own(F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")).alias("latin1"))


_SYSTEMS = "SELECT chip, list(system ORDER BY newest DESC, system) AS systems FROM (SELECT coalesce(chip, 'Unknown') AS chip, system, max(created_at) AS newest FROM runs GROUP BY 1, 2) GROUP BY chip"


@query(
    f"""
    WITH {RUNS}, s AS ({_SYSTEMS}), r AS (
        SELECT coalesce(chip, 'Unknown') AS chip, count(*) AS runs, round(median(seconds), 4) AS median_seconds, round(median(vram_delta), 2) AS median_vram,
               arg_max(release_year, (created_at, run_id)) FILTER (release_year IS NOT NULL) AS release_year, arg_max(mem_bytes, (created_at, run_id)) FILTER (mem_bytes IS NOT NULL) AS mem_bytes,
               arg_max(vram_bytes, (created_at, run_id)) FILTER (vram_bytes IS NOT NULL) AS vram_bytes
        FROM runs GROUP BY 1)
    SELECT r.*, systems, row_number() OVER (ORDER BY runs DESC, chip)::INT AS place FROM r JOIN s USING (chip)
    """
)
def telemetry_chip_report(spark, d):
    rows = telemetry.report(mapping.telemetry(spark, d)).where("level = 'chip'")
    return rows.select("chip", "runs", F.round("median_seconds", 4).alias("median_seconds"), F.round("median_vram", 2).alias("median_vram"), "release_year", "mem_bytes", "vram_bytes", "systems", "place")


@query(
    f"""
    WITH {RUNS}, r AS (SELECT app_version, count(*) AS runs, round(median(files_per_sec), 4) AS median_files, round(median(tokens_per_sec), 2) AS median_tokens FROM runs GROUP BY 1)
    SELECT *, row_number() OVER (ORDER BY list_transform(string_split(app_version, '.'), lambda x: x::INT) DESC)::INT AS place FROM r
    """
)
def telemetry_version_report(spark, d):
    rows = telemetry.report(mapping.telemetry(spark, d)).where("level = 'version'")
    return rows.select("app_version", "runs", F.round("median_files", 4).alias("median_files"), F.round("median_tokens", 2).alias("median_tokens"), "place")


@query(
    f"""
    WITH {RUNS} SELECT chip, app_version, system, mem_bytes, floor(files_per_sec * 10 + 0.5) / 10 AS files_per_sec, floor(tokens_per_sec + 0.5)::BIGINT AS tokens_per_sec,
        floor(seconds * 10 + 0.5) / 10 AS seconds, vram_delta, created_at FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 25
    """
)
def telemetry_recent_rows(spark, d):
    return telemetry.recent(mapping.telemetry(spark, d)).select("chip", "app_version", "system", "mem_bytes", "files_per_sec", "tokens_per_sec", "seconds", "vram_delta", "created_at")


@query(
    f"""
    WITH {_FILE_VECTORS} SELECT path, kind FROM vectors JOIN (SELECT DISTINCT path, kind FROM chunks) USING (path) WHERE starts_with(path, '/d4/')
    """
)
def folder_map(spark, d):
    """Files of a folder map; that every one is placed is all that SQL can tell."""
    return projection.folder_map(mapping.chunks(spark, d), "/d4", epochs=20).where("x is not null and y is not null").select("path", "kind")


# Media, metadata and the rest of the scalar surface.


@query(
    """
    SELECT event_id, list_transform(range(6), lambda i: round(value + (value * 3 + 1 - value) * (i + 0.5) / 6, 6)) AS times FROM events
    """
)
def frame_times(spark, d):
    times = vx.frame_times(F.col("value"), F.col("value") * 3 + 1, 6)
    return mapping.table(spark, d, "events").select("event_id", F.transform(times, lambda t: F.round(t, 6)).alias("times"))


_GRAY = "list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::BIGINT)"


@query(
    f"""
    WITH g AS (SELECT vec_id, {_GRAY} AS gray FROM embeddings), m AS (SELECT vec_id, gray, floor(list_sum(gray) / 64.0)::BIGINT AS mean FROM g)
    SELECT vec_id, array_to_string(list_transform(gray, lambda x: CASE WHEN x > mean THEN '1' ELSE '0' END), '') AS bits FROM m
    """
)
def average_hash(spark, d):
    gray = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5))
    return mapping.table(spark, d, "embeddings").select("vec_id", F.reverse(F.lpad(F.bin(vx.average_hash(gray)), 64, "0")).alias("bits"))


@query(
    f"""
    WITH {CHUNKS}, g AS (SELECT path, chunk_index, list_transform(vec, lambda x: floor((x + 1) * 127.5)::BIGINT) AS gray FROM chunks),
    h AS (SELECT path, list(list_transform(gray, lambda x: x > floor(list_sum(gray) / 64.0)) ORDER BY chunk_index) AS hs FROM g GROUP BY path),
    d AS (
        SELECT path, len(hs) AS n, len(list_filter(list_zip(hs[1], hs[2]), lambda p: p[1] <> p[2])) AS d01, len(list_filter(list_zip(hs[1], hs[3]), lambda p: p[1] <> p[2])) AS d02,
               len(list_filter(list_zip(hs[2], hs[3]), lambda p: p[1] <> p[2])) AS d12 FROM h)
    SELECT path, list_filter([0, CASE WHEN n > 1 AND d01 >= 8 THEN 1 END, CASE WHEN n > 2 AND d02 >= 8 AND (d01 < 8 OR d12 >= 8) THEN 2 END], lambda i: i IS NOT NULL) AS frames FROM d
    """
)
def distinct_frames(spark, d):
    """Frames of each file, by the hashes of its vectors, without those near to an earlier one."""
    gray = F.transform("vec", lambda x: F.floor((x.cast("double") + 1) * 127.5))
    rows = mapping.chunks(spark, d).select("path", "chunk_index", vx.average_hash(gray).alias("h"))
    per = rows.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "h"))), lambda s: s.h).alias("hashes"))
    return per.select("path", vx.distinct_frames(F.col("hashes")).alias("frames"))


@query("SELECT path, size, page_count, CASE WHEN page_count > 1 THEN 'Page ' || (i + 1) ELSE '' END AS locator, i::INT AS chunk_index FROM (SELECT 'p' || page_id AS path, length(html) AS size, page_id % 4 + 1 AS page_count, unnest(range(page_id % 4 + 1)) AS i FROM pages)")
def scan_pages(spark, d):
    rows = mapping.table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), F.length("html").cast("long").alias("size"), (F.col("page_id") % 4 + 1).alias("page_count"))
    return rows.select("path", "size", "page_count", F.explode(tx.scan_pages(F.col("page_count").cast("int"))).alias("c")).select("path", "size", "page_count", "c.locator", "c.chunk_index")


@query(
    """
    WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS pages FROM conversations GROUP BY conv_id),
    e AS (SELECT conv_id, list_transform(pages, lambda p: CASE WHEN ends_with(p, chr(10)) THEN p ELSE p || chr(10) END) AS pages FROM t)
    SELECT conv_id, length(array_to_string(pages, ''))::BIGINT AS n_chars, list_transform(range(len(pages)), lambda i: CASE WHEN i = 0 THEN 0 ELSE list_sum(list_transform(pages[1:i], lambda p: length(p)))::BIGINT END) AS starts FROM e
    """
)
def paged_text(spark, d):
    per = mapping.table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("pages"))
    joined = per.select("conv_id", tx.paged_text(F.col("pages")).alias("p"))
    return joined.select("conv_id", F.length("p.text").cast("long").alias("n_chars"), F.col("p.page_starts").cast("array<bigint>").alias("starts"))


@query(
    """
    WITH s AS (SELECT event_id, user_id * 37 AS t FROM events), l AS (
        SELECT event_id, t, CASE WHEN t >= 3600 THEN format('{}:{:02d}:{:02d}', t // 3600, t // 60 % 60, t % 60) ELSE format('{}:{:02d}', t // 60, t % 60) END AS locator FROM s)
    SELECT event_id, locator, t::INT AS seconds, (event_id - 1)::INT AS page FROM l
    """
)
def locator_parse(spark, d):
    rows = mapping.table(spark, d, "events").select("event_id", tx.clock((F.col("user_id") * 37).cast("double")).alias("locator"), F.concat(F.lit("Page "), "event_id").alias("p"))
    return rows.select("event_id", "locator", tx.clock_seconds(F.col("locator")).alias("seconds"), tx.page_index(F.col("p")).alias("page"))


@query(
    """
    WITH v AS (SELECT DISTINCT user_id % 3 AS a, user_id % 17 AS b FROM events)
    SELECT '0.' || x.a || '.' || x.b AS left_v, '0.' || y.a AS right_v, (x.a, x.b) > (y.a, 0) AS newer FROM v x, (SELECT DISTINCT a FROM v) y
    """
)
def version_newer(spark, d):
    v = mapping.table(spark, d, "events").select((F.col("user_id") % 3).alias("a"), (F.col("user_id") % 17).alias("b")).distinct()
    short = v.select(F.concat(F.lit("0."), "a").alias("right_v")).distinct()
    rows = v.select(F.concat(F.lit("0."), "a", F.lit("."), "b").alias("left_v")).crossJoin(F.broadcast(short))  # three short versions
    return rows.withColumn("newer", telemetry.is_newer(F.col("left_v"), F.col("right_v")))


@query(
    """
    SELECT n_name, CASE n_nationkey % 5 WHEN 0 THEN 2025 WHEN 1 THEN 2021 WHEN 2 THEN 2022 WHEN 3 THEN NULL ELSE 2024 END::INT AS year,
           greatest(least(floor(n_nationkey / 6.0 * 250), 900), 100)::DOUBLE AS budget FROM nation
    """
)
def chip_years(spark, d):
    chip = F.element_at(F.array(*map(F.lit, ["Apple M3 Ultra", "Apple M1 Pro", "M2", "M9", "Apple M4 Max"])), F.col("n_nationkey") % 5 + 1)
    return mapping.table(spark, d, "nation").select("n_name", telemetry.release_year(chip).alias("year"), telemetry.budget(F.col("n_nationkey"), 250, 100.0, 900.0).cast("double").alias("budget"))


@query(
    """
    WITH k AS (SELECT user_id AS path, max_by(event_type, event_id) AS key, max(event_id) AS event_id FROM events GROUP BY user_id) SELECT path, key, event_id FROM k
    """
)
def upsert_keys(spark, d):
    rows = mapping.table(spark, d, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("key"), "event_id")
    cut = rows.agg(F.max("event_id")).first()[0] // 2
    old = rows.where(F.col("event_id") <= cut)
    return indexing.upsert(old, rows.where(F.col("event_id") > cut), "path", "event_id")


@query(
    """
    SELECT event_id, round(user_id / greatest(value, 1e-4), 4) AS files_per_sec, CASE WHEN user_id > 0 THEN round((event_id % 7) / user_id::DOUBLE, 6) ELSE 0 END::DOUBLE AS error_rate FROM events
    """
)
def profiling_metrics(spark, d):
    found = telemetry.throughput(F.col("user_id"), F.col("event_id") % 7, F.col("user_id"), F.col("user_id") * 5, F.col("value"))
    return mapping.table(spark, d, "events").select("event_id", found.alias("m")).select("event_id", F.round("m.files_per_sec", 4).alias("files_per_sec"), F.round("m.error_rate", 6).alias("error_rate"))


@query(
    f"""
    WITH {CHUNKS} SELECT path, CASE kind WHEN 'image' THEN size >= 130 WHEN 'audio' THEN size * 2.0 >= 290 WHEN 'video' THEN size * 2.0 >= 290 ELSE length(path) >= 14 END AS ready
    FROM (SELECT DISTINCT path, kind, size FROM chunks)
    """
)
def least_sizes(spark, d):
    files = mapping.chunks(spark, d).select("path", "kind", "size").distinct()
    return files.select("path", indexing.media_ready(F.col("kind"), F.col("size"), F.col("size") * 2.0, F.length("path"), 130, 290.0, 14).alias("ready"))


@query()
def map_preservation(spark, d):
    """Share of each point's neighbours that the first two components keep near."""
    points = _points(spark, d)
    mean, top, _ = projection.components(points)
    flat = projection.project(points.withColumn("path", F.col("id").cast("string")), mean, top).withColumn("id", F.col("path").cast("long"))
    return projection.preservation(flat, projection.neighbours(points, points))


@query(_KNN.replace("WHERE rank <= 15", "WHERE rank <= 10 AND src = 7").replace("SELECT src, dst, round(score, 6) AS score, rank::INT AS rank", "SELECT dst, rank::INT AS rank"))
def spotlight(spark, d):
    points = _points(spark, d)
    return projection.spotlight(projection.neighbours(points.where(F.col("id") == QUERY), points), QUERY)


# Live sources and the store's layout.


@query(
    """
    WITH e AS (SELECT '/u/file' || user_id || '.txt' AS path, event_id, CASE WHEN event_type = 'error' THEN 'delete' WHEN event_type IN ('click', 'view') THEN 'modify' ELSE 'create' END AS op FROM events)
    SELECT path, arg_max(op, event_id) AS op, max(event_id) AS event_id, count(*) AS n FROM e GROUP BY path
    """
)
def event_source(spark, d):
    """A journal read as a stream that stops in the middle and goes on; see ``plans.live.journal_replay``."""
    from .plans.live import journal_replay

    return journal_replay(spark, d)


@query(f"WITH {FILES} SELECT path, coalesce(size, 0) AS size, kind FROM files WHERE NOT starts_with(path, '/src3/') AND NOT ends_with(path, '.csv')")
def pruned_crawl(spark, d):
    """All documents as files below a folder, walked under a policy; see ``plans.live.walked_files``."""
    from .plans.live import walked_files

    return walked_files(spark, d, "src3/\n*.csv\n")


@query(
    rf"""
    WITH {FILES}, t AS (SELECT path, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM files),
    n AS (SELECT *, CASE WHEN length(text) <= 1800 THEN 1 ELSE ceil((length(text) - 1800) / 1600.0)::INT + 1 END AS n FROM t WHERE text <> ''),
    w AS (SELECT *, unnest(range(n)) AS i FROM n),
    c AS (SELECT *, substring(text, 1, i * 1600) AS head, array_to_string(list_filter(regexp_split_to_array(substring(text, i * 1600 + 1, 1800), '[\n\t]'), lambda x: x <> ''), ' ') AS line FROM w)
    SELECT CASE WHEN starts_with(path, '/src1/') THEN '/moved' || path ELSE path END AS path, i::INT AS chunk_index, CASE WHEN n = 1 THEN '' ELSE 'Line ' || (1 + length(head) - length(replace(head, chr(10), ''))) END AS locator, substring(line, 1, 220) AS snippet FROM c
    """
)
def folder_events(spark, d):
    """An index after two events of folders; see ``plans.live.moved_folder``."""
    from .plans.live import moved_folder

    return moved_folder(spark, d)


_PACKED = f"""
    WITH {CHUNKS}, halves AS (SELECT path, chunk_index, list_transform(vec, lambda x: {_BF16}) AS vec, vec AS own, vec_id FROM chunks),
    scored AS (SELECT path, chunk_index, list_dot_product(vec, (SELECT own FROM halves WHERE vec_id = 7)) AS score FROM halves)
    SELECT path, round(score, 6) AS score, chunk_index FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_index) = 1 ORDER BY score DESC, path LIMIT 10
"""


@query(_PACKED)
def packed_search(spark, d):
    """Exact search over stored vectors of two bytes a number, base and delta."""
    from .plans.live import packed_store

    found = search.search(packed_store(spark, d).packed_chunks(), _vector(spark, d), 10)
    return found.select("path", F.round("score", 6).alias("score"), "chunk_index")


@query(_PACKED)
def replica_search(spark, d):
    """Candidates from the stored replica of the base, the delta exactly; its SQL is the exact search."""
    from .plans.live import packed_store

    return search.funnel_stored(packed_store(spark, d), _vector(spark, d), 10).select("path", F.round("score", 6).alias("score"), "chunk_index")


@query(ORACLE_SQL["rate_limit_hourly"])
def rate_limit_stream(spark, d):
    """Posts accepted or refused as a stream brings them; see ``plans.live.limited_stream``."""
    from .plans.live import limited_stream

    return limited_stream(spark, d)


@query(f"SELECT * EXCLUDE (sound) FROM ({ORACLE_SQL['incremental_counters']})")
def counter_stream(spark, d):
    """Counters that move as a stream brings files' counts; see ``plans.live.counted_stream``."""
    from .plans.live import counted_stream

    return counted_stream(spark, d)


@query(
    rf"""
    WITH {FILES}, t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') <> '' AS has FROM files),
    n AS (SELECT count(*) FILTER (doc_id % 11 <> 0) AS scanned, count(*) FILTER (has AND doc_id % 11 <> 0 AND doc_id % 7 <> 0) AS unchanged, count(*) FILTER (has AND doc_id % 11 <> 0 AND doc_id % 7 = 0) AS reused,
                 0 AS embedded, count(*) FILTER (NOT has AND doc_id % 11 <> 0) AS empty, 0 AS failed, count(*) FILTER (has AND doc_id % 11 = 0) AS deleted FROM t)
    SELECT figure, n::BIGINT AS n FROM (UNPIVOT n ON COLUMNS(*) INTO NAME figure VALUE n)
    """
)
def pass_progress(spark, d):
    """The figures that a pass tells of itself; see ``plans.live.pass_figures``."""
    from .plans.live import pass_figures

    return pass_figures(spark, d)


# Table functions in SQL.


@query(ORACLE_SQL["chunk_documents"])
def sql_chunks(spark, d):
    """The chunks of all documents by SQL text with a lateral join."""
    tables.register(spark)
    documents = mapping.table(spark, d, "documents")
    found = spark.sql("SELECT d.doc_id, c.chunk_index, c.start, c.chunk, c.locator FROM {documents} d, LATERAL chunk(d.text, 1800) c", documents=documents)
    return found.select("doc_id", "chunk_index", F.md5(F.col("chunk").cast("binary")).alias("digest"), F.length("chunk").cast("long").alias("n_chars"))


@query(ORACLE_SQL["packed_search"].replace(_BF16, "x"))
def sql_search(spark, d):
    """The nearest files of one passage by SQL text over a table function."""
    tables.register(spark)
    asked = "array(" + ", ".join(f"{x!r}D" for x in map(float, _vector(spark, d))) + ")"
    return spark.sql(
        f"""
        WITH found AS (SELECT path, max(struct(score, -chunk_index AS place)) AS best FROM nearest(TABLE(SELECT path, chunk_index, vec FROM {{chunks}}), {asked}, 10) GROUP BY path)
        SELECT path, round(best.score, 6) AS score, -best.place AS chunk_index FROM found ORDER BY best.score DESC, path LIMIT 10
        """,
        chunks=mapping.chunks(spark, d),
    )


@query(
    """
    WITH runs AS (SELECT user_id AS run_id, event_id, epoch_us(ts) // 1000 AS created_at FROM events)
    SELECT run_id, event_id, created_at FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY created_at, event_id) = 1
    """
)
def first_runs(spark, d):
    runs = mapping.table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"))
    return telemetry.first_of_run(runs, "event_id")


@query(
    f"""
    WITH {FILES}, manifest AS (SELECT path, CASE WHEN doc_id % 10 = 0 THEN md5('other') ELSE upper(md5(text)) END AS md5 FROM files UNION ALL SELECT '/missing', md5(''))
    SELECT m.path, coalesce(md5(f.text) = lower(m.md5), false) AS ok FROM manifest m LEFT JOIN files f USING (path)
    """
)
def manifest_check(spark, d):
    """Files against a manifest of MD5 sums, of which a tenth are wrong and one file is missing."""
    from .sources.files import verified

    found = mapping.files(spark, d).withColumn("content", F.col("text").cast("binary"))
    manifest = found.select("path", F.when(F.col("doc_id") % 10 == 0, F.md5(F.lit("other").cast("binary"))).otherwise(F.upper(F.md5("content"))).alias("md5"))
    return verified(found, manifest.union(spark.createDataFrame([("/missing", "d41d8cd98f00b204e9800998ecf8427e")], "path string, md5 string")))


@query(f"WITH {CHUNKS} SELECT CASE WHEN fid % 7 = 3 THEN regexp_replace(path, '[.]txt$', '.md') ELSE path END AS path, kind FROM chunks WHERE fid % 7 <> 4".join(["SELECT kind, " + EXT + " AS ext, count(DISTINCT path) AS files, count(*) AS chunks FROM (", ") GROUP BY 1, 2"]))
def store_counters(spark, d):
    """The counters that a store carries over two changes; see ``plans.live.counted_store``."""
    from .plans.live import counted_store

    return counted_store(spark, d).counters()


# Filters, mutations and small operators that other queries show in passing only.

_LATEST = f"WITH {HISTORY} SELECT query, last_used, bookmarked FROM latest"
_NOISY = "CASE doc_id % 9 WHEN 0 THEN '/node_modules' WHEN 1 THEN '/build' WHEN 2 THEN '/rebuild' ELSE '' END"


@query(
    f"""
    WITH {FILES}, t AS (SELECT {_NOISY} || path || CASE WHEN doc_id % 5 = 0 THEN '.bin' WHEN doc_id % 5 = 1 THEN '.PNG' ELSE '' END AS path, doc_id * 400000 AS size FROM files)
    SELECT path FROM t WHERE NOT starts_with(path, '/node_modules/') AND NOT starts_with(path, '/build/') AND NOT ends_with(path, '.bin') AND NOT ends_with(path, '.csv') AND (NOT ends_with(path, '.PNG') OR size <= 200000000)
    """
)
def supported_files(spark, d):
    """Files by kind, extensions that are off, size caps and the noise directories of the default policy."""
    rules = ignore.parse(ignore.synthesise(disabled_extensions={"csv"}))
    noisy = F.when(F.col("doc_id") % 9 == 0, "/node_modules").when(F.col("doc_id") % 9 == 1, "/build").when(F.col("doc_id") % 9 == 2, "/rebuild").otherwise("")
    ending = F.when(F.col("doc_id") % 5 == 0, ".bin").when(F.col("doc_id") % 5 == 1, ".PNG").otherwise("")
    rows = mapping.files(spark, d).select(F.concat(noisy, "path", ending).alias("path"), (F.col("doc_id") * 400_000).alias("size"))
    taken = indexing.supported(F.col("path")) & indexing.within_cap(tx.kind_of(F.col("path")), F.col("size"))
    return rows.where(taken & ~ignore.ignored_with_ancestors(F.col("path"), F.lit(False), rules)).select("path")


@query(
    f"""
    WITH {FILES}, there AS (SELECT path, modified, size FROM files WHERE doc_id % 6 <> 0), known AS (SELECT path, modified + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS modified, size FROM files WHERE doc_id % 7 <> 0)
    SELECT f.path, CASE WHEN t.path IS NULL OR starts_with(f.path, '/src5/') THEN CASE WHEN k.path IS NULL THEN 'none' ELSE 'delete' END
                        WHEN doc_id % 10 = 1 THEN 'none' WHEN k.modified = t.modified THEN 'none' ELSE 'embed' END AS action
    FROM files f LEFT JOIN there t USING (path) LEFT JOIN known k USING (path) WHERE NOT starts_with(f.path, '/src2/')
    """
)
def update_actions(spark, d):
    """What is done with each changed path: one root is paused, one folder ignored, and some files have no content here."""
    from .streaming import live

    files = mapping.files(spark, d)
    there = files.where("doc_id % 6 <> 0").withColumn("dataless", F.col("doc_id") % 10 == 1)
    known = files.where("doc_id % 7 <> 0").withColumn("modified", F.col("modified") + F.when(F.col("doc_id") % 4 == 0, 1).otherwise(0))
    events = files.select("path", F.lit("modify").alias("op"), F.col("doc_id").alias("event_id"))
    return live.actions(events, there, known, rules=ignore.parse("/src5/\n"), paused=["/src2"], dataless=True).select("path", "action")


@query(f"WITH {CHUNKS} SELECT path, chunk_index FROM chunks WHERE NOT starts_with(path, '/d5/') AND fid % 3 <> 1")
def store_deletes(spark, d):
    """What a store holds after deletions by path and of a folder, a compaction and a fold."""
    from .plans.live import thinned_store

    return thinned_store(spark, d).chunks().select("path", "chunk_index")


@query(
    f"""
    WITH {SCORED}, sound AS (SELECT * FROM scored WHERE vec_id % 11 <> 3),
    best AS (SELECT path, chunk_index, score FROM sound QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, chunk_index) = 1)
    SELECT path, round(score, 6) AS score, chunk_index FROM best ORDER BY score DESC, path LIMIT 10
    """
)
def search_finite(spark, d):
    """Search over a table in which an eleventh of the vectors hold a value that is not finite, or are null."""
    broken = F.when(F.col("vec_id") % 2 == 0, F.transform("vec", lambda x, i: F.when(i == 3, float("nan")).otherwise(x).cast("float")))
    chunks = mapping.chunks(spark, d).withColumn("vec", F.when(F.col("vec_id") % 11 == 3, broken).otherwise(F.col("vec")))
    return search.search(chunks, _vector(spark, d), 10).select("path", F.round("score", 6).alias("score"), "chunk_index")


@query(f"{_LATEST} WHERE lower(query) <> (SELECT min(lower(query)) FROM latest)".replace("query, last_used, bookmarked FROM", "query, last_used, (bookmarked <> (lower(query) = (SELECT max(lower(query)) FROM latest))) AS bookmarked FROM"))
def history_edits(spark, d):
    """One item's bookmark set or taken off, another item removed."""
    items = history.latest(mapping.history(spark, d))
    # The texts as they were typed: of a letter such as \u00df, upper and lower case do not lead back to it.
    ends = items.agg(F.min_by("query", F.lower("query")), F.max_by("query", F.lower("query"))).first()
    return history.remove(history.toggle(items, ends[1] or ""), ends[0] or "")


@query(f"{_LATEST} WHERE bookmarked")
def history_clear(spark, d):
    return history.clear(history.latest(mapping.history(spark, d)))


@query(
    """
    WITH t AS (SELECT event_id, 20 + event_id * 37 % 3000 AS h, 20 + user_id * 91 % 4000 AS w FROM events),
    r AS (SELECT *, greatest(32, round_even(h / 32.0, 0) * 32) AS a, greatest(32, round_even(w / 32.0, 0) * 32) AS b, sqrt(h::DOUBLE * w / 1310720) AS shrink, sqrt(262144 / (h::DOUBLE * w)) AS grow FROM t)
    SELECT event_id, CASE WHEN a * b > 1310720 THEN greatest(32, floor(h / shrink / 32) * 32) WHEN a * b < 262144 THEN ceil(h * grow / 32) * 32 ELSE a END::INT AS height,
           CASE WHEN a * b > 1310720 THEN greatest(32, floor(w / shrink / 32) * 32) WHEN a * b < 262144 THEN ceil(w * grow / 32) * 32 ELSE b END::INT AS width FROM r
    """
)
def smart_resize(spark, d):
    sides = mapping.table(spark, d, "events").select("event_id", (20 + F.col("event_id") * 37 % 3000).alias("h"), (20 + F.col("user_id") * 91 % 4000).alias("w"))
    return sides.select("event_id", vx.smart_resize(F.col("h").cast("double"), F.col("w").cast("double")).alias("s")).select("event_id", "s.height", "s.width")


@query(f"WITH {_WINDOWS} SELECT doc_id, chunk_index::INT AS chunk_index, '' AS locator, md5(substring(whole, chunk_index * 1600 + 1, 1800)) AS digest FROM windows")
def opaque_chunks(spark, d):
    """Chunks of texts whose lines mean nothing to a reader: no locator."""
    each = mapping.table(spark, d, "documents").select("doc_id", F.explode(tx.chunks(F.col("text"), plain=False)).alias("c"))
    return each.select("doc_id", "c.chunk_index", "c.locator", F.md5(F.col("c.text").cast("binary")).alias("digest"))


@query(
    f"""
    WITH {CHUNKS}, keys AS (SELECT DISTINCT path, 'k' || fid % 50 AS key FROM chunks)
    SELECT path, key FROM keys WHERE path NOT IN (SELECT path FROM chunks WHERE kind IN ('image', 'audio'))
    """
)
def keys_of_kinds(spark, d):
    """Content keys after those of two kinds were dropped."""
    chunks = mapping.chunks(spark, d)
    keys = chunks.select("path", F.concat(F.lit("k"), F.col("fid") % 50).alias("key")).distinct()
    return indexing.delete_keys_of_kind(keys, chunks, ["image", "audio"])


@query("SELECT round(sum(v), 6) AS total, count(*) AS dims FROM (SELECT var_samp(x) AS v FROM (SELECT unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS dim FROM embeddings) GROUP BY dim)")
def pca_variance(spark, d):
    """The variance that all components of the vectors have together: the covariance's trace."""
    _, _, covariance = projection.moments(mapping.table(spark, d, "embeddings").select(F.col("embedding").alias("vec")))
    return spark.createDataFrame([(round(float(covariance.trace()), 6), len(covariance))], "total double, dims long")
