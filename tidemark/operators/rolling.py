"""Totals and averages over trailing days, per entity and day, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.copies import one_per_key


def daily_cells(events: DataFrame, entity: str, ts: str, amount: str, key: str | None, floor_day: int, last_day: int, day_seconds: int = 86_400) -> DataFrame:
    """(entity, day, total, n): one row per entity and day with events, hash-partitioned by entity.

    Days before floor_day are counted on floor_day, days after last_day not at all.
    """
    names = {entity: "entity", ts: "ts", amount: "amount"} | ({key: "key"} if key else {})
    e = events.select(*(col(c).alias(a) for c, a in names.items())).filter("entity IS NOT NULL AND ts IS NOT NULL")
    if key:
        e = one_per_key(e, ["key"], ["entity", "ts", "amount"])
    day = F.floor(F.col("ts") / day_seconds)
    cells = e.select("entity", F.greatest(day, F.lit(floor_day).cast("bigint")).alias("day"), F.coalesce("amount", F.lit(0)).cast("bigint").alias("amount")).filter(F.col("day") <= last_day)
    return cells.groupBy("entity", "day").agg(F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n"))


def trailing_totals(
    events: DataFrame,
    entity: str,
    ts: str,
    amount: str,
    *,
    key: str | None = None,
    first_day: int,
    last_day: int,
    windows: Sequence[int] = (7, 30),
    entities: DataFrame | None = None,
    day_seconds: int = 86_400,
) -> DataFrame:
    """Per entity and day first_day … last_day: total, count and averages over the trailing `windows` days.

    Columns: entity's name, day, and per window w total_{w}d, count_{w}d, avg_day_{w}d (total / w) and avg_event_{w}d
    (NULL without an event). The window of day d is d-w+1 … d; it reaches back before first_day where there are events.

    Method: prefix sums over an entity's days with events, carried forward across the dates up to the next such day;
    a trailing total is the prefix of the window's last day less that of the day before its first.

    Scale: events are brought to one row per entity and day before anything is gathered by entity, so an entity has at
    most as many rows in a task as the period has days, however many events it has. `entities` (one column, an
    entity's id) restricts the result; it is applied to the daily rows.

    Defined cases: rows with NULL entity or ts belong to no cell and are left out; a NULL amount counts as an event of
    amount 0; with `key`, rows with the same key count once (see one_per_key); an empty table gives an empty result.
    """
    widest = max(windows)
    if min(windows) < 1 or last_day < first_day:
        raise ConfigError("windows must be positive and last_day not before first_day")
    cells = daily_cells(events, entity, ts, amount, key, first_day - widest, last_day, day_seconds)
    if entities is not None:
        cells = cells.join(entities.select(col(entities.columns[0]).alias("entity")).distinct(), "entity", "left_semi")
    by_day = Window.partitionBy("entity").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = cells.select(
        "entity",
        F.col("day").alias("since"),
        F.sum("total").over(so_far).alias("total"),
        F.sum("n").over(so_far).alias("n"),
        F.lag("day").over(by_day).isNull().alias("is_first"),
        F.coalesce(F.lead("day").over(by_day), F.lit(last_day + 1).cast("bigint")).alias("until"),
    )
    start = F.when(F.col("is_first"), F.least(F.col("since"), F.lit(first_day).cast("bigint"))).otherwise(F.col("since"))
    began = F.col("day") >= F.col("since")
    dense = prefixes.withColumn("day", F.explode(F.sequence(start, F.col("until") - 1))).select(
        "entity", "day", F.when(began, F.col("total")).otherwise(F.lit(0)).alias("total"), F.when(began, F.col("n")).otherwise(F.lit(0)).alias("n")
    )
    out = [F.col("entity").alias(entity), F.col("day")]
    for w in windows:
        out += [
            (F.col("total") - F.lag("total", w, 0).over(by_day)).alias(f"total_{w}d"),
            (F.col("n") - F.lag("n", w, 0).over(by_day)).alias(f"count_{w}d"),
        ]
    result = dense.select(*out).filter(F.col("day") >= first_day)
    for w in windows:
        total, n = F.col(f"total_{w}d"), F.col(f"count_{w}d")
        result = result.withColumns({f"avg_day_{w}d": total / w, f"avg_event_{w}d": F.when(n > 0, total / n)})
    return result
