"""The best interaction of each pair over a stream, kept as state that expires."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType

from netloom.session import ship_code

STATE = "score double, row_id long, until long"
RESULT = "protein1 string, protein2 string, score double, row_id long"


class BestPair(StatefulProcessor):
    """Keeps a pair's best score, the first row of equals, until no row of it has come for ``keep_ms`` of event time."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        score, row_id, until = self.best.get() if self.best.exists() else (None, None, 0)
        old, due = (score, row_id), until
        for part in rows:
            for s, r, t in zip(part["score"], part["row_id"], part["at"], strict=True):
                until = max(until, int(t) + self.keep_ms)
                if not pd.isna(s) and (score is None or s > score or (s == score and r < row_id)):
                    score, row_id = float(s), int(r)
        if until != due:
            if due:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(until)
        self.best.update((score, row_id, until))
        if (score, row_id) != old:
            yield pd.DataFrame({"protein1": [key[0]], "protein2": [key[1]], "score": [score], "row_id": [row_id]})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.best.clear()
        yield from ()

    def close(self) -> None:
        pass


def best_pairs(stream: DataFrame, time: str = "ts", delay: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """(protein1, protein2, score, row_id) whenever a pair's best changes, from a stream (time, protein1, protein2, score, row_id).

    A pair is the same in both directions. Rows later than ``delay`` are left out. A pair that has had no row for ``keep``
    is forgotten, so state is bounded by the pairs of that time, and starts anew. Rows without an end, time or id are left
    out; a null score only keeps a pair alive. The query runs in update mode with the RocksDB state store.
    """
    ship_code(stream.sparkSession)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = stream.withWatermark(time, delay).where(f"protein1 IS NOT NULL AND protein2 IS NOT NULL AND row_id IS NOT NULL AND `{time}` IS NOT NULL")
    pairs = rows.select(time, F.least("protein1", "protein2").cast("string").alias("protein1"), F.greatest("protein1", "protein2").cast("string").alias("protein2"), F.col("score").cast("double").alias("score"), F.col("row_id").cast(LongType()).alias("row_id"), F.unix_millis(F.col(time).cast("timestamp")).alias("at"))
    return pairs.groupBy("protein1", "protein2").transformWithStateInPandas(BestPair(keep_ms), RESULT, "Update", "eventTime")
