"""Live updates: change events to index versions, rate limits and smoothed rates, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import ignore
from ..functions import text as tx
from ..operators.indexing import supported
from ..schema import EXTENSIONS


def coalesce_events(events: DataFrame) -> DataFrame:
    """The last event (path, op, event_id) of each path in a batch."""
    return events.groupBy("path").agg(F.max(F.struct("event_id", "op")).alias("m")).select("path", "m.op", "m.event_id")


def actions(events: DataFrame, crawl: DataFrame, known: DataFrame, enabled: frozenset[str] = frozenset(EXTENSIONS), rules: list[ignore.Rule] = (), paused: list[str] = (), dataless: bool = False) -> DataFrame:
    """(path, action) of each changed path: delete, embed, or none.

    A path that is gone, unsupported or ignored is deleted if it is known; one
    of a kind that is off, under a paused root, unchanged, or without local
    content is left as it is.
    """
    last = coalesce_events(events)
    for root in paused:
        last = last.where(~((F.col("path") == root) | F.col("path").startswith(root.rstrip("/") + "/")))
    there = crawl.select("path", F.col("modified").alias("m1"), F.col("size").alias("s1"), F.lit(True).alias("there"), *([F.col("dataless")] if dataless else [F.lit(False).alias("dataless")]))
    had = known.select("path", F.col("modified").alias("m0"), F.col("size").alias("s0"), F.lit(True).alias("had"))
    both = last.join(there, "path", "left").join(had, "path", "left")
    off = F.coalesce(~tx.kind_of(F.col("path")).isin(sorted(enabled)), F.lit(False))
    # What is there now decides, not the event: a late event of a deletion must not take a file that came back.
    lost = F.col("there").isNull() | ~(supported(F.col("path")))
    if rules:
        lost |= ignore.ignored_with_ancestors(F.col("path"), F.lit(False), rules)
    same = F.col("m0").eqNullSafe(F.col("m1")) & F.col("s0").eqNullSafe(F.col("s1"))
    action = F.when(lost, F.when(F.col("had"), "delete").otherwise("none")).when(off | F.col("dataless"), "none").when(F.col("had") & same, "none").otherwise("embed")
    return both.select("path", action.alias("action"), "event_id")


def live_update(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "1.5 seconds") -> StreamingQuery:
    """Run ``apply`` on the last event of each path of every micro-batch.

    The checkpoint holds how far the stream was read; ``apply`` gets the batch's
    number, by which a store leaves out a batch that it has committed before.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: apply(coalesce_events(batch), n))
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def hourly_counts(posts: DataFrame) -> DataFrame:
    """(ip_hash, start, n): posts an hour; hours close an hour late."""
    return posts.withWatermark("ts", "1 hour").groupBy("ip_hash", F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("ip_hash", F.col("w.start").alias("start"), "n")


def first_posts(posts: DataFrame) -> DataFrame:
    """Posts without those whose run_id came within a day before."""
    return posts.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["run_id"])


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keeps_state(spark: SparkSession) -> None:
    """State variables and timers take the store that has them."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


#: Groups into which the addresses of an hour are dealt: each is a call and a state of its own, whatever the number of addresses.
ADDRESS_GROUPS = 16


class _Accept(StatefulProcessor):
    """Of each address and hour the first ``most`` posts are accepted, in order of (created_at, run_id) within a batch.

    A key is an hour and a group of addresses, so state is read and written once
    a group and batch, as one value, and a batch's posts are decided together. No
    more posts of an address are held than may still be accepted.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "ips array<string>, n array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        group, hour = key
        before = self.count.get() if self.count.exists() else ((), ())
        had = pd.Series(list(before[1]), index=pd.Index(list(before[0]), dtype="object"), dtype="int64")
        seen, first = [], None  # those that are first so far

        def told(posts: pd.DataFrame, allowed: bool) -> pd.DataFrame:
            return pd.DataFrame({"run_id": posts["run_id"].astype("int64"), "ip_hash": posts["ip_hash"], "hour": hour, "allowed": allowed})

        for frame in rows:
            new = frame[["run_id", "ip_hash", "created_at"]]
            seen.append(new["ip_hash"].value_counts(dropna=False))
            both = new if first is None else pd.concat([first, new])
            both = both.sort_values(["created_at", "run_id"], kind="stable")
            room = self.most - both["ip_hash"].map(had).fillna(0)
            taken = both.groupby("ip_hash", sort=False, dropna=False).cumcount() < room
            first = both[taken]
            if not taken.all():
                yield told(both[~taken], False)
        if first is not None and len(first):
            yield told(first, True)
        now = pd.concat([had, *seen]).groupby(level=0, dropna=False).sum().clip(upper=self.most)
        self.count.update(([None if x is None or x != x else x for x in now.index], now.tolist()))
        # An hour after the watermark has passed it, nothing of this hour comes any more.
        self.handle.registerTimer((int(hour) + 2) * 3_600_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.count.clear()
        return iter(())

    def close(self) -> None: ...


def accepted(posts: DataFrame, most: int) -> DataFrame:
    """(run_id, ip_hash, hour, allowed) of a stream of posts (run_id, ip_hash, created_at in milliseconds, ts): each is decided when it comes.

    Batches are taken as they come; of posts in order this is ``telemetry.limited``.
    An hour's count goes when the watermark, an hour behind, is an hour beyond it.
    """
    _keeps_state(posts.sparkSession)
    group = F.pmod(F.xxhash64("ip_hash"), F.lit(ADDRESS_GROUPS)).alias("addresses")
    keyed = posts.withWatermark("ts", "1 hour").select("run_id", "ip_hash", "created_at", "ts", F.floor(F.col("created_at") / 3_600_000).alias("hour"), group)
    return keyed.groupBy("addresses", "hour").transformWithStateInPandas(_Accept(most), "run_id long, ip_hash string, hour long, allowed boolean", "Update", "EventTime")


class _Counted(StatefulProcessor):
    """What a file's newest count changes: a file comes when its chunks go from none to some, and goes the other way."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "kind string, ext string, chunks long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had = self.now.get() if self.now.exists() else None
        last = None
        for frame in rows:
            row = frame.loc[frame["seq"].idxmax()]
            if last is None or row["seq"] > last["seq"]:
                last = row
        if had is not None and last["seq"] <= had[3]:
            return
        new = (last["kind"], last["ext"], int(last["chunks"]), int(last["seq"]))
        self.now.update(new)
        moves = [(kind, ext, sign, sign * n) for (kind, ext, n, _), sign in ((had or (None, None, 0, 0), -1), (new, 1)) if n > 0]
        if moves:
            yield pd.DataFrame(moves, columns=["kind", "ext", "files", "chunks"])

    def close(self) -> None: ...


def counter_moves(changes: DataFrame) -> DataFrame:
    """(kind, ext, files, chunks) by which the counters move, from a stream of files' counts (path, kind, ext, chunks, seq).

    A file's state is its newest count by ``seq``; a count that comes late, or
    again, changes nothing. ``write_moves`` adds them up.
    """
    _keeps_state(changes.sparkSession)
    schema = "kind string, ext string, files long, chunks long"
    return changes.groupBy("path").transformWithStateInPandas(_Counted(), schema, "Update", "None")


def write_moves(moves: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write each batch's moves, added up, to a folder of its own: a batch that runs again counts once. ``counters_at`` reads them."""

    def apply(batch: DataFrame, number: int) -> None:
        summed = batch.groupBy("kind", "ext").agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks"))
        summed.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return moves.writeStream.option("checkpointLocation", checkpoint).outputMode("update").foreachBatch(apply).trigger(availableNow=True).start()


def counters_at(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, ext, files, chunks) after all batches in ``folder``."""
    return spark.read.parquet(folder).groupBy("kind", "ext").agg(F.sum("files").alias("files"), F.sum("chunks").alias("chunks")).where("files <> 0 or chunks <> 0")


def smoothed_rates(samples: DataFrame, least_gap: float = 0.4) -> DataFrame:
    """(root, rate): running smoothed throughput of samples (root, t, n), kept as state a root."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, n, rate = state.get if state.exists else (None, None, None)
        for frame in frames:
            for row in frame.sort_values(["t", "n"]).itertuples():
                if t is None:
                    t, n = row.t, row.n
                elif row.t - t >= least_gap:
                    if row.n != n:
                        now = (row.n - n) / (row.t - t)
                        rate = now if rate is None else (rate + now) / 2
                    t, n = row.t, row.n
        state.update((t, n, rate))
        yield pd.DataFrame({"root": [key[0]], "rate": [rate]})

    return samples.groupBy("root").applyInPandasWithState(step, "root string, rate double", "t double, n double, rate double", "update", GroupStateTimeout.NoTimeout)


def replay(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of a folder as a stream, one a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
