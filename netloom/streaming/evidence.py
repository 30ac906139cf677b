"""Interactions that arrive over time, translated and counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.operators.idmap import map_edges


def evidence_counts(stream: DataFrame, table: DataFrame, time: str = "ts", delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """(window, protein1, protein2, n) of a stream (time, protein1, protein2): ends go through ``table`` (key, to).

    Rows later than ``delay`` are left out; with the append mode a window comes once it is over. Works on batches too.
    """
    known = map_edges(stream.withWatermark(time, delay), table)
    ends = known.select(time, F.least("protein1", "protein2").alias("protein1"), F.greatest("protein1", "protein2").alias("protein2"))
    return ends.groupBy(F.window(time, length), "protein1", "protein2").agg(F.count(F.lit(1)).alias("n"))
