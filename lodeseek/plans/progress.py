"""Figures of a pass, or of a stream's batches, while they run: taken from the rows that are written anyway, without a job of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

#: What is counted of files.
FIGURES = ("scanned", "unchanged", "reused", "embedded", "empty", "failed", "deleted")


class Progress:
    """Counts that steps add to; ``told`` is called with all of them whenever some have changed."""

    def __init__(self, told: Callable[[dict[str, int]], None] | None = None):
        self.figures, self.told, self._waiting = dict.fromkeys(FIGURES, 0), told, []

    def watch(self, rows: DataFrame, **figures: Column) -> DataFrame:
        """``rows``, of which these figures are taken when they are next computed as a whole; ``settle`` adds them."""
        seen = Observation()
        self._waiting.append(seen)
        return rows.observe(seen, *(F.count_if(c).alias(name) for name, c in figures.items()))

    def settle(self) -> None:
        """Add what was watched, after the rows were written."""
        for seen in self._waiting:
            for name, n in seen.get.items():
                self.figures[name] += n
        if self._waiting and self.told:
            self.told(dict(self.figures))
        self._waiting = []


class BatchEvents(StreamingQueryListener):
    """Events of each micro-batch of streams that count them (``counted``): (query's name or id, batch, events)."""

    def __init__(self):
        self.batches: list[tuple[str, int, int]] = []

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        seen = p.observedMetrics.get("events")
        if seen is not None:
            self.batches.append((p.name or str(p.id), p.batchId, seen["n"]))

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...


def counted(stream: DataFrame) -> DataFrame:
    """A stream whose events ``BatchEvents`` counts."""
    return stream.observe("events", F.count(F.lit(1)).alias("n"))
