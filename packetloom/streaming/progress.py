"""Numbers that streams and scans report while they run, without a second scan."""

from __future__ import annotations

import threading
import time
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener


class ProgressTotals(StreamingQueryListener):
    """Adds up, by query, the input rows, the rows dropped behind the watermark and the observed metrics of all batches.

    Observed metrics must be counts or sums.  ``follow`` registers a listener; progress arrives on its own thread.
    """

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))

    @classmethod
    def follow(cls, spark: SparkSession) -> ProgressTotals:
        listener = cls()
        spark.streams.addListener(listener)
        return listener

    def totals(self, query_id: str) -> dict[str, int]:
        with self._lock:
            return dict(self._totals[str(query_id)])

    def settled(self, query_id: str, input_rows: int, seconds: float = 30.0) -> dict[str, int]:
        """The totals once so many rows have been reported: progress of the last batch may come after the query's end."""
        end = time.monotonic() + seconds
        while self.totals(query_id).get("input_rows", 0) < input_rows and time.monotonic() < end:
            time.sleep(0.05)
        return self.totals(query_id)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        with self._lock:
            query = str(progress.id)
            total = self._totals[query]
            total["input_rows"] += progress.numInputRows
            total["dropped_rows"] += sum(s.numRowsDroppedByWatermark for s in progress.stateOperators)
            for row in progress.observedMetrics.values():
                for name, value in row.asDict().items():
                    total[name] += value or 0


def observed(df: DataFrame, name: str, metrics: dict[str, Column]) -> DataFrame:
    """``df`` with aggregates that are taken while its rows pass by; streams report them for each batch."""
    return df.observe(name, *[c.alias(n) for n, c in metrics.items()])
