"""Extras for incremental jobs: each works on a batch or a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _late(events: DataFrame, ts: str, late: str | None) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming and late else events


def tumbling(events: DataFrame, ts: str, size: str, by: list[str], late: str | None = "1 day") -> DataFrame:
    """(window, by, n): counts in windows that don't overlap."""
    return _late(events, ts, late).groupBy(F.window(ts, size), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(events: DataFrame, ts: str, gap: str, by: list[str], late: str | None = "1 day") -> DataFrame:
    """(session, by, n): a session ends when nothing comes for a gap."""
    return _late(events, ts, late).groupBy(F.session_window(ts, gap).alias("session"), *by).agg(F.count(F.lit(1)).alias("n"))


def first_only(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events without repeats of a key within the time that late ones may take."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def read_traces(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of JSON lines."""
    return spark.readStream.schema(schema).json(path)
