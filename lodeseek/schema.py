"""Constants, kinds and table layouts of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: Characters a chunk, overlap, snippet, least chunk limit; bytes read of a text file.
CHUNK_LIMIT, CHUNK_OVERLAP, SNIPPET, LEAST_LIMIT, TEXT_CAP = 1800, 200, 220, 200, 2_000_000
#: Results of a search by caller (store, application, HTTP, MCP) and passages of a file.
TOP_STORE, TOP_APP, TOP_HTTP, TOP_MCP, TOP_PASSAGES = 40, 60, 20, 10, 6
#: Seconds of a media segment; results history keeps; delta rows before a fold; share of dead rows before compaction.
SEGMENT_S, RECENT_CAP, FOLD_ROWS, DEAD_SHARE = 240, 200, 50_000, 0.15

#: Extensions of each kind.
EXTENSIONS = {
    "image": "png jpg jpeg gif bmp tiff tif heic heif webp".split(),
    "video": "mp4 mov m4v avi mkv webm mpg mpeg wmv flv 3gp".split(),
    "audio": "mp3 wav m4a aac flac ogg oga aiff aif caf wma".split(),
    "text": (
        "txt text md markdown rst org tex csv tsv json jsonl ndjson yaml yml toml ini cfg conf xml html htm css log"
        " swift py js mjs ts tsx jsx c h cpp cc hpp m mm java kt go rs rb php pl lua r scala sh bash zsh fish sql graphql proto"
        " make cmake gradle dockerfile gitignore env"
        " pdf"
        " rtf rtfd doc docx odt pages webarchive"
    ).split(),
}
#: Bytes above which files of a kind are skipped; characters a page below which a document is a scan.
SIZE_CAPS, SCAN_CHARS = {"image": 200_000_000}, 8
KINDS = ["image", "video", "audio", "text", "scan"]
#: Fixed value: the order in which an index pass takes kinds.
KIND_ORDER = ["image", "audio", "video", "text"]

CHUNKS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("snippet", T.StringType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("duration", T.DoubleType()),
        T.StructField("locator", T.StringType()),
    ]
)
KEYS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("modified", T.DoubleType()),
        T.StructField("size", T.LongType()),
    ]
)
FILES = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.DoubleType()),
        T.StructField("size", T.LongType()),
        T.StructField("kind", T.StringType()),
    ]
)
