"""Attributes as they were known at the time of an event."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.copies import one_per_key
from tidemark.session import Scratch

_STATE = ["__entity", "__slice", "__from", "__to", "__since", "__known"]


def versions(unit: list, begin: list, end: list, rank: list) -> tuple[list, list, list]:
    """(unit, at, winner) of current-state versions: from `at` on, `winner` is the place of the interval in force.

    Interval i holds for begin[i] <= t < end[i]; of those that hold, the one with the greatest rank wins, which settles
    ties before any event is looked up. winner is None where none holds. A sweep over the boundaries of a unit with a
    heap of the intervals that hold: n log n for n intervals.
    """
    out: tuple[list, list, list] = ([], [], [])
    order = sorted((i for i in range(len(unit)) if begin[i] < end[i]), key=lambda i: (unit[i], begin[i]))
    place = 0
    while place < len(order):
        u, mine = unit[order[place]], []
        while place < len(order) and unit[order[place]] == u:
            mine.append(order[place])
            place += 1
        descending = {r: -j for j, r in enumerate(sorted({rank[i] for i in mine}))}
        bounds, heap, nxt, last = sorted({begin[i] for i in mine} | {end[i] for i in mine}), [], 0, -1
        for at in bounds:
            while nxt < len(mine) and begin[mine[nxt]] <= at:
                heapq.heappush(heap, (descending[rank[mine[nxt]]], mine[nxt]))
                nxt += 1
            while heap and end[heap[0][1]] <= at:
                heapq.heappop(heap)
            now = heap[0][1] if heap else None
            if now != last:
                for column, x in zip(out, (u, at, now), strict=True):
                    column.append(x)
                last = now
    return out


def _asof_bucket(rank_columns: Sequence[str], payload: Sequence[str], out_schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(events: pa.Table, states: pa.Table) -> pa.Table:
        import duckdb

        columns = states.select([*_STATE[:4], *rank_columns]).to_pydict()
        # NULLs of the tie columns rank below all values.
        ranks = list(zip(*([(x is not None, x) if x is not None else (False,) for x in columns[c]] for c in rank_columns), strict=True))
        numbers: dict = {}
        units = [numbers.setdefault(u, len(numbers)) for u in zip(columns["__entity"], columns["__slice"], strict=True)]
        first = {u: place for place, u in reversed(list(enumerate(units)))}
        unit, at, winner = versions(units, columns["__from"], columns["__to"], ranks)
        of = states.select(["__entity", "__slice"]).take(pa.array([first[u] for u in unit], pa.int64()))
        v = of.rename_columns(["entity", "slice"]).append_column("at", pa.array(at, pa.int64())).append_column("winner", pa.array(winner, pa.int64()))
        e = events.select(["__entity", "__slice", "__ts"]).rename_columns(["entity", "slice", "ts"]).append_column("place", pa.array(range(events.num_rows), pa.int64()))
        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as db:
            db.register("e", e)
            db.register("v", v)
            found = db.sql("SELECT e.place, v.winner FROM e ASOF LEFT JOIN v ON e.entity = v.entity AND e.slice = v.slice AND e.ts >= v.at").to_arrow_table().combine_chunks()
        hit = events.take(found["place"])
        label = states.take(found["winner"]) if states.num_rows else None
        arrays = []
        for f in out_schema:
            if f.name in payload:
                a = label[f.name] if label is not None else pa.nulls(hit.num_rows, f.type)
            else:
                a = hit[f.name]
            arrays.append(a.cast(f.type))
        return pa.Table.from_arrays(arrays, schema=out_schema)

    return run


def attributes_as_known(
    events: DataFrame,
    states: DataFrame,
    scratch: Scratch,
    *,
    event_key: str,
    event_entity: str,
    event_ts: str,
    entity: str,
    valid_from: str,
    valid_to: str,
    known_at: str,
    tie: Sequence[str] = (),
    state_key: Sequence[str] = (),
    payload: Sequence[str],
    prefix: str = "",
    slice_seconds: int = 30 * 86_400,
    rows_per_bucket: int = 200_000,
) -> DataFrame:
    """Every event once, with the payload of the state of its entity that was in force and known at the event's time.

    Of the states with valid_from <= ts < valid_to and known_at <= ts the one with the latest valid_from, then the
    latest known_at, then the greatest `tie` values counts. Columns: event_key, event_entity, event_ts and the payload
    under `prefix`. A state whose known_at lies later, or is NULL (never known), is never used.

    Method: events and states are hash-partitioned into buckets. In a bucket the states of each entity are swept into
    current-state versions ordered by when they became available, max(valid_from, known_at), ties settled; then an
    embedded DuckDB joins them by ASOF LEFT JOIN.

    Scale: the unit that is kept together is an entity in a slice of slice_seconds; a state is given to each slice that
    it touches between the first and the last event. A unit with more than rows_per_bucket events is salted over more
    buckets, its states repeated in each, so that a bucket has about rows_per_bucket events.

    Defined cases: rows with the same event_key count once, and so do states with the same entity and state_key;
    events with NULL entity or ts are kept, without a state; states with NULL entity, valid_from or valid_to, or that
    end before they begin, are never in force; an empty states table leaves all payload NULL.
    """
    if rows_per_bucket < 1 or slice_seconds < 1:
        raise ConfigError("rows_per_bucket and slice_seconds must be positive")
    e = one_per_key(events.select(col(event_key).alias("__key"), col(event_entity).alias("__entity"), col(event_ts).cast("bigint").alias("__ts")), ["__key"], ["__entity", "__ts"])
    e = scratch.table(e.withColumn("__slice", F.floor(F.col("__ts") / slice_seconds)), "events")
    low, high, rows = e.agg(F.min("__ts"), F.max("__ts"), F.count(F.lit(1))).first()
    buckets = max(1, math.ceil(rows / rows_per_bucket))

    names = list(dict.fromkeys([*state_key, *tie, *payload]))
    s = states.select(col(entity).alias("__entity"), col(valid_from).cast("bigint").alias("__since"), col(valid_to).cast("bigint").alias("__to"), col(known_at).cast("bigint").alias("__known"), *(col(c).alias(f"s_{c}") for c in names))
    if state_key:
        keys = ["__entity", *(f"s_{c}" for c in state_key)]
        s = one_per_key(s, keys, [c for c in s.columns if c not in keys])
    s = s.filter("__entity IS NOT NULL AND __known IS NOT NULL").withColumn("__from", F.greatest("__since", "__known"))
    s = s.filter(F.col("__since").isNotNull() & (F.col("__from") < F.col("__to")) & (F.col("__from") <= F.lit(high or 0)) & (F.col("__to") > F.lit(low or 0)))
    first = F.floor(F.greatest(F.col("__from"), F.lit(low or 0)) / slice_seconds)
    last = F.floor((F.least(F.col("__to") - 1, F.lit(high or 0))) / slice_seconds)
    s = s.withColumn("__slice", F.explode(F.sequence(first, last)))

    counts = e.filter("__entity IS NOT NULL AND __ts IS NOT NULL").groupBy("__entity", "__slice").agg(F.count(F.lit(1)).alias("rows"))
    heavy = scratch.table(counts.filter(F.col("rows") > rows_per_bucket).select("__entity", "__slice", F.ceil(F.col("rows") / rows_per_bucket).cast("int").alias("__salts")), "heavy")
    if heavy.isEmpty():
        e, s = e.withColumn("__salt", F.lit(0)), s.withColumn("__salt", F.lit(0))
    else:
        salts = F.coalesce("__salts", F.lit(1))
        e = e.join(heavy, ["__entity", "__slice"], "left").withColumn("__salt", F.pmod(F.xxhash64("__key", "__ts"), salts).cast("int")).drop("__salts")
        s = s.join(heavy, ["__entity", "__slice"], "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")

    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64("__entity", "__slice", "__salt"), F.lit(buckets)).cast("int"))

    left = bucket(e).select("__bucket", "__slice", "__key", "__entity", "__ts")
    right = bucket(s).select("__bucket", *_STATE, *(f"s_{c}" for c in names))
    shape = e.select(col("__key").alias(event_key), col("__entity").alias(event_entity), col("__ts").alias(event_ts)).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    inner = StructType([StructField(c, left.schema[c].dataType) for c in ("__key", "__entity", "__ts")] + [StructField(f"s_{c}", right.schema[f"s_{c}"].dataType) for c in payload])
    run = _asof_bucket(["__since", "__known", *(f"s_{c}" for c in tie)], [f"s_{c}" for c in payload], to_arrow_schema(inner))
    joined = left.groupBy("__bucket").cogroup(right.groupBy("__bucket")).applyInArrow(lambda a, b: run(a, b), inner)
    back: list[Column] = [F.col(f"`__{a}`").alias(f.name) for a, f in zip(("key", "entity", "ts"), shape.fields, strict=True)]
    return joined.select(*back, *(F.col(f"`s_{c}`").alias(f"{prefix}{c}") for c in payload))
