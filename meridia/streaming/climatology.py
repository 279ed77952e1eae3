"""Climatologies kept up to date from a stream of observations.

An extension: per cell and unit the count, sum, minimum and maximum are mergeable, so a streaming
aggregation yields at any time what the batch climatology over the same rows would.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def climatology(rows: DataFrame, unit: Column, value: Column, *, cell: str = "cell", event_time: str | None = None, lateness: str = "1 day", every: str | None = None) -> DataFrame:
    """(cell, unit[, window], n, mean, total, low, high), for batch and streaming frames alike. With `event_time`, rows later
    than `lateness` are left out; with `every`, there is one climatology per window of that length."""
    if event_time and rows.isStreaming:
        rows = rows.withWatermark(event_time, lateness)
    keys = [F.col(cell), unit.alias("unit"), *([F.window(event_time, every).alias("window")] if every else [])]
    v = F.when(~F.isnan(value), value)
    return rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"))


def keep(stream: DataFrame, name: str, checkpoint: str | None = None) -> DataStreamWriter:
    """A writer that keeps the whole result in a queryable in-memory table (tests, small grids)."""
    out = stream.writeStream.outputMode("complete").format("memory").queryName(name)
    return out.option("checkpointLocation", checkpoint) if checkpoint else out
