"""Streaming forms of the counting operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.tokens import ngrams


def stream_ngrams(units: DataFrame, n: int) -> DataFrame:
    """Running (gram, c) over a stream of units (ops); use update or complete mode."""
    return units.select(F.explode(ngrams(F.col("ops"), n)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))


def stream_windows(events: DataFrame, at: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts of events by tumbling window and kind; rows later than ``late`` are dropped."""
    windows = events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count(F.lit(1)).alias("c"))
    return windows.select(F.col("window.start").alias("start"), kind, "c")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Process all there is and stop, into an in-memory table (for small results)."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
