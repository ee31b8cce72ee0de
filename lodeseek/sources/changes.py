"""A journal of change events as a streaming source, by event id.

The journal is a folder of Parquet files (path, op, event_id) to which events are
appended, each time with greater ids than before. The source's offset is the last
event id that was read, so a query that starts again goes on after the id that its
checkpoint holds, and a new one replays from any id (option ``since``). A
micro-batch's partitions are row groups whose range of ids meets it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "path string, op string, event_id long"
_COLUMNS = ["path", "op", "event_id"]


@dataclass
class Part(InputPartition):
    file: str
    row_group: int
    after: int
    to: int


class ChangeReader(DataSourceStreamReader):
    def __init__(self, folder: str, since: int):
        self.folder, self.since, self.ranges = folder, since, {}

    def _system(self) -> tuple[fs.FileSystem, str]:
        folder = "/" + self.folder[5:].lstrip("/") if self.folder.startswith("file:") else self.folder
        return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)

    def _look(self) -> None:
        """The ranges of ids of row groups of files that were not seen before; only footers are read."""
        system, folder = self._system()
        for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            name = info.base_name
            if info.type != fs.FileType.File or name.startswith(("_", ".")) or not name.endswith(".parquet") or info.path in self.ranges:
                continue
            with system.open_input_file(info.path) as file:
                meta = pq.ParquetFile(file).metadata
            column = meta.schema.to_arrow_schema().get_field_index("event_id")
            stats = [(k, meta.row_group(k).column(column).statistics) for k in range(meta.num_row_groups)]
            self.ranges[info.path] = [(k, s.min, s.max) for k, s in stats if s is not None and s.has_min_max]

    def initialOffset(self) -> dict:
        return {"event_id": self.since}

    def latestOffset(self) -> dict:
        self._look()
        return {"event_id": max([self.since, *(high for groups in self.ranges.values() for _, _, high in groups)])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if not self.ranges:
            self._look()
        after, to = start["event_id"], end["event_id"]
        return [Part(file, k, after, to) for file, groups in sorted(self.ranges.items()) for k, low, high in groups if high > after and low <= to]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        system, _ = self._system()
        with system.open_input_file(partition.file) as file:
            for batch in pq.ParquetFile(file).iter_batches(50_000, [partition.row_group], _COLUMNS):
                ids = batch.column(2)
                yield batch.filter(pc.and_(pc.greater(ids, partition.after), pc.less_equal(ids, partition.to)))

    def commit(self, end: dict) -> None:
        """Nothing: the journal stays, for other readers and for replay."""


class ChangeSource(DataSource):
    """Options: path, the journal's folder; since, the event id after which a new query starts (-1: from the first)."""

    @classmethod
    def name(cls) -> str:
        return "lodeseek_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangeReader:
        return ChangeReader(self.options["path"], int(self.options.get("since", "-1")))


def changes(spark: SparkSession, folder: str, since: int = -1) -> DataFrame:
    """The journal's events as a stream, after the event id ``since``."""
    spark.dataSource.register(ChangeSource)
    return spark.readStream.format(ChangeSource.name()).option("path", folder).option("since", str(since)).load()


def append(events: DataFrame, folder: str) -> None:
    """Append events (path, op, event_id) to a journal, sorted, so that row groups have ranges of ids."""
    events.select(*_COLUMNS).repartitionByRange("event_id").sortWithinPartitions("event_id").write.mode("append").parquet(folder)
