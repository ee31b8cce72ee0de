"""Search history: identity, prefix collapse, groups, pruning."""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..schema import RECENT_CAP
from ..sources.shared import shared_folder
from .search import with_index

DAY = 86_400


def latest(items: DataFrame) -> DataFrame:
    """One item a query, without regard to case: the last used, bookmarked if any was."""
    key = F.lower("query")
    return items.groupBy(key.alias("key")).agg(F.max(F.struct("last_used", "query")).alias("m"), F.bool_or("bookmarked").alias("bookmarked")).select("m.query", "m.last_used", "bookmarked")


class _Beginnings:
    """For texts that come in descending order: the latest use of those that begin with the text that comes next.

    They are the ones just before it. What is held is the last text, and for each
    length that it shares with some before it the latest use of these.
    """

    def __init__(self):
        self.text, self.held = "", []  # (length, latest use), lengths ascending

    def _share(self, text: str) -> None:
        n, latest = len(commonprefix((self.text, text))), []
        while self.held and self.held[-1][0] >= max(n, 1):
            latest.append(self.held.pop()[1])
        if n and latest:
            self.held.append((n, max(latest)))
        self.text = text

    def meet(self, text: str, used):
        """The latest use of the texts so far that begin with ``text``, null if there is none; then ``text`` is one of them."""
        self._share(text)
        later = self.held.pop()[1] if self.held and self.held[-1][0] == len(text) else None
        both = [x for x in (later, used) if x is not None]
        if text and both:
            self.held.append((len(text), max(both)))
        return later

    def go_on(self, text: str, held: list) -> None:
        """Meet a stretch of texts that ends with ``text`` and of which this is held."""
        self._share(text)
        both = dict(self.held)
        for n, used in held:
            both[n] = max(used, both.get(n, used))
        self.held = sorted(both.items())


def collapse(items: DataFrame) -> DataFrame:
    """``items`` (a query once, as ``latest`` gives them) without those, not bookmarked, that a later query begins with and goes on from.

    Queries are sorted, so those that go on from one are next to it, and a task
    reads its range once and holds what its last query shares with others. What
    a range hands to the next is found first: a row a range. Ranges are written
    to the shared folder, as those that hand on must be those that are handed to.
    """
    spark, used = items.sparkSession, items.schema["last_used"]
    low = F.lower("query")
    parts = items.where("query is not null").repartitionByRange(low.desc()).select(F.spark_partition_id().alias("part"), low.alias("low"), F.struct(*items.columns).alias("row"))
    parts.write.parquet(path := shared_folder(spark))
    own = spark.read.schema(parts.schema).parquet(path)
    held = T.ArrayType(T.StructType([T.StructField("length", T.IntegerType()), T.StructField("used", used.dataType)]))
    handed = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("low", T.StringType()), T.StructField("held", held)])

    def told(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"part": n, "low": x.text, "held": [{"length": k, "used": u} for k, u in x.held]} for n, x in rows], to_arrow_schema(handed))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = None, _Beginnings()
        for batch in batches:
            for n, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is not None and n != part:
                    yield told([(part, run)])
                    run = _Beginnings()
                part = n
                run.meet(text, at)
        if part is not None:
            yield told([(part, run)])

    def hand_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Beginnings()
        for batch in batches:
            for x in batch.to_pylist():
                yield told([(x["part"], run)])  # what comes before this range
                run.go_on(x["low"], [(y["length"], y["used"]) for y in x["held"]])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = _Beginnings()
        for batch in batches:
            row, stays = batch.column(3), []
            at, marked, query = (row.field(x).to_pylist() for x in ("last_used", "bookmarked", "query"))
            for first, text, before, u, mark, q in zip(row.is_null().to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), at, marked, query, strict=True):
                if first:
                    run = _Beginnings()
                    run.text, run.held = text, [(y["length"], y["used"]) for y in before]
                    stays.append(False)
                    continue
                later = run.meet(text, u)
                stays.append(bool(mark) or later is None or u is None or later < u or len(q) < 2)
            yield pa.RecordBatch.from_arrays([row.filter(pa.array(stays))], names=["row"])

    last = own.select("part", "low", "row.last_used").repartition("part").sortWithinPartitions("part", F.desc("low")).mapInArrow(ends, handed)
    starts = last.repartition(1).sortWithinPartitions("part").mapInArrow(hand_on, handed)
    rows = own.select("part", "low", F.lit(None).cast(held).alias("held"), "row").unionByName(starts.withColumn("row", F.lit(None).cast(parts.schema["row"].dataType)))
    kept = rows.repartition("part").sortWithinPartitions("part", F.col("row").isNotNull(), F.desc("low")).mapInArrow(keep, T.StructType([T.StructField("row", parts.schema["row"].dataType)]))
    return kept.select("row.*").unionByName(items.where("query is null"))


def group_of(bookmarked: Column, last_used: Column, now: int) -> Column:
    """Bookmarks, Today, Yesterday, Previous 7 Days or Earlier, by UTC days."""
    days = F.lit(now // DAY) - F.floor(last_used / DAY)
    return F.when(bookmarked, "Bookmarks").when(days <= 0, "Today").when(days == 1, "Yesterday").when(days < 7, "Previous 7 Days").otherwise("Earlier")


def prune(items: DataFrame, now: int, keep_days: int = 7, cap: int = RECENT_CAP) -> DataFrame:
    """Bookmarks, and the ``cap`` last used of the others that are not older than ``keep_days``."""
    recent = items.where(~F.col("bookmarked") & (F.col("last_used") >= now - keep_days * DAY)).orderBy(F.desc("last_used"), "query").limit(cap)
    return items.where("bookmarked").unionByName(recent)


def clear(items: DataFrame) -> DataFrame:
    return items.where("bookmarked")


def toggle(items: DataFrame, query: str) -> DataFrame:
    """``items`` with the bookmark of one query, in whatever case, set or taken off."""
    return items.withColumn("bookmarked", F.when(F.lower("query") == F.lower(F.lit(query)), ~F.col("bookmarked")).otherwise(F.col("bookmarked")))


def remove(items: DataFrame, query: str) -> DataFrame:
    return items.where(F.lower("query") != F.lower(F.lit(query)))


def ranked(items: DataFrame) -> DataFrame:
    """``items`` with place: bookmarked first, then last used first."""
    return with_index(items, F.desc("bookmarked"), F.desc("last_used"), "query").withColumn("place", (F.col("idx") + 1).cast("int")).drop("idx")


#: When a search is recorded.
MODES = ("auto", "submit", "manual")


def recorded(items: DataFrame, raw: str, text: str, at: float, mode: str = "auto", submitted: bool = False, replayed: str | None = None) -> DataFrame:
    """``items`` with a search (``raw`` as typed, ``text`` without qualifiers) recorded, and its beginnings collapsed.

    Nothing is recorded in manual mode, before a query is submitted in submit
    mode, for a text of fewer than two characters, or for the query that was just
    run from the history. A query that was used before, in whatever case, is used
    again and keeps its bookmark.
    """
    raw = raw.strip()
    if mode == "manual" or (mode == "submit" and not submitted) or len(text.strip()) < 2 or raw == (replayed or "").strip():
        return items
    new = items.sparkSession.createDataFrame([(raw, False, at)], "query string, bookmarked boolean, last_used double")
    return collapse(latest(items.select("query", "bookmarked", F.col("last_used").cast("double").alias("last_used")).unionByName(new)))
