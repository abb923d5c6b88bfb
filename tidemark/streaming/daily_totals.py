"""Daily totals per entity as a stream with late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canon import col


def daily_totals(events: DataFrame, *, entity: str, ts: str, amount: str, key: str, late_seconds: int) -> DataFrame:
    """(entity, day, total, n): one row per entity and day, final once the stream is late_seconds past the day's end.

    `events` is a stream (or a batch) with integer seconds in ts. Copies of a key that come within late_seconds count once;
    events later than that are dropped, as the watermark says. State is one row per open entity and day, and the keys of
    the last late_seconds. Use with output mode append. Rows with NULL entity or ts are left out; a NULL amount is 0.
    """
    e = events.select(col(entity).alias("entity"), F.timestamp_seconds(col(ts)).alias("at"), F.coalesce(col(amount), F.lit(0)).cast("bigint").alias("amount"), col(key).alias("key"))
    e = e.filter("entity IS NOT NULL AND at IS NOT NULL").withWatermark("at", f"{late_seconds} seconds").dropDuplicatesWithinWatermark(["key"])
    days = e.groupBy("entity", F.window("at", "1 day")).agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))
    return days.select("entity", F.floor(F.unix_timestamp("window.start") / 86_400).alias("day"), "total", "n")
