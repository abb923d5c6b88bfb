"""Sessions separated by inactivity, by pointer doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.copies import one_per_key
from tidemark.session import Scratch


def sessions(events: DataFrame, keys: Sequence[str], ts: str, gap: int, scratch: Scratch, *, event_key: str | None = None, slices_per_gap: int = 8) -> DataFrame:
    """One row per session: keys, start_ts, end_ts, duration, n_events.

    A session of one key combination ends where more than `gap` pass without an event; a gap of exactly `gap` does not
    end it. Method: every moment with events points to the earliest moment within the gap before it; where that is not
    yet the start of a session, pointers are joined with the table of pointers itself, each round doubling their reach,
    until all point to a start; then events are aggregated by the start they point to.

    Scale: events of one key and moment are counted before they are sent, so that a key, NULL among them, has at most
    one row for each second. Moments are cut into time slices of slices_per_gap gaps, each with the last two gaps before
    it as context, and pointers are found per key and slice: a task holds no more of a key than a slice has seconds.
    Rounds run over the few moments whose pointer is no start. Each round is written to the shared folder.

    Defined cases: rows with NULL ts belong to no session and are left out; NULL keys are keys like any other; events
    at the same moment are in the same session; with event_key, rows with the same event_key count once; an empty table
    gives an empty result.
    """
    if gap < 1 or slices_per_gap < 3:
        raise ConfigError("gap must be positive and slices_per_gap at least 3")
    width = gap * slices_per_gap
    k = [f"k{i}" for i in range(len(keys))]
    rows = events.select(*(col(c).alias(a) for c, a in zip(keys, k, strict=True)), col(ts).cast("bigint").alias("ts"), *([col(event_key).alias("event_key")] if event_key else []))
    rows = rows.filter(F.col("ts").isNotNull())
    if event_key:
        rows = one_per_key(rows, ["event_key"], [*k, "ts"])
    own = F.floor(F.col("ts") / width)
    also = F.when(F.col("ts") >= (own + 1) * width - 2 * gap, F.array(own, own + 1)).otherwise(F.array(own))
    # Equal moments become one row in each task before any row is sent, then one in all.
    moments = rows.groupBy(*k, "ts").agg(F.count(F.lit(1)).alias("n")).withColumn("slice", F.explode(also))
    by_ts = Window.partitionBy(*k, "slice").orderBy("ts")
    within = by_ts.rangeBetween(-gap, Window.currentRow)
    starts = F.coalesce(F.col("ts") - F.lag("ts").over(by_ts) > gap, F.lit(True))
    linked = (
        moments.withColumn("starts", starts)
        .withColumns({"to": F.first("ts").over(within), "to_starts": F.first("starts").over(within)})
        .filter(F.floor(F.col("ts") / width) == F.col("slice"))  # context rows have done their part
        .select(*k, "ts", "n", "starts", "to", "to_starts")
    )
    linked = scratch.table(linked, "linked")
    at_start = linked.filter("to_starts").select(*k, "ts", F.col("to").alias("start"), "n")
    far = linked.filter("NOT to_starts").select(*k, "ts", "to", "n")
    # One step along pointers that already end at a start; the rest then point into `far` itself.
    target = linked.filter("to_starts AND NOT starts").select(*(F.col(c).alias(f"t_{c}") for c in k), F.col("ts").alias("t_ts"), F.col("to").alias("t_start"))
    far = scratch.table(far.join(target, _same(k, far, target), "left").select(*k, "ts", "to", "n", F.col("t_start").alias("start")), "far0")
    turn = 0
    while not far.filter("start IS NULL").isEmpty():
        target = far.select(*(F.col(c).alias(f"t_{c}") for c in k), F.col("ts").alias("t_ts"), F.col("to").alias("t_to"), F.col("start").alias("t_start"))
        pending = far.filter("start IS NULL")
        stepped = pending.join(target, _same(k, pending, target)).select(*k, "ts", F.coalesce("t_to", "to").alias("to"), "n", F.col("t_start").alias("start"))
        far, turn = scratch.table(far.filter("start IS NOT NULL").unionByName(stepped), f"far{turn + 1}"), turn + 1
        scratch.drop(f"far{turn - 1}")
    assigned = at_start.unionByName(far.select(*k, "ts", "start", "n"))
    found = assigned.groupBy(*k, "start").agg(F.max("ts").alias("end_ts"), F.sum("n").alias("n_events"))
    return found.select(*(F.col(a).alias(c) for c, a in zip(keys, k, strict=True)), F.col("start").alias("start_ts"), "end_ts", (F.col("end_ts") - F.col("start")).alias("duration"), "n_events")


def _same(k: Sequence[str], pointing: DataFrame, target: DataFrame):
    """The pointer's target: the row with the same keys at the moment pointed to."""
    cond = pointing["to"] == target["t_ts"]
    for c in k:
        cond = cond & pointing[c].eqNullSafe(target[f"t_{c}"])
    return cond
