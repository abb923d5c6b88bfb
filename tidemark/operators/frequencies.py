"""Per-key results where a few keys hold most rows, by counting equal values of a key first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.copies import one_per_key
from tidemark.session import Scratch


def value_frequencies(df: DataFrame, fields: Sequence[str], value: str, key: str | None = None) -> DataFrame:
    """(field_name, key_id, value, n): how often each value occurs with each key of each field.

    Grouping is by field, key and value, so the rows of a heavy key spread over all tasks by their values, and equal
    ones are already counted before the shuffle. NULL keys form a group of their own, so that the n of one field add
    up to all rows. Keys are cast to bigint.
    """
    names = [*fields, value]
    rows = df.select(*map(col, names), *([col(key).alias("__key")] if key else []))
    if key:
        rows = one_per_key(rows, ["__key"], names)
    pairs = F.explode(F.array(*(F.struct(F.lit(i).alias("field_no"), col(f).cast("bigint").alias("key_id")) for i, f in enumerate(fields))))
    long = rows.select(pairs.alias("pair"), col(value).cast("bigint").alias("value")).select("pair.field_no", "pair.key_id", "value")
    counted = long.groupBy("field_no", "key_id", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.element_at(F.array(*map(F.lit, fields)), F.col("field_no") + 1).alias("field_name"), "key_id", "value", "n")


def value_bucket(value: Column, per_doubling: int = 1024) -> Column:
    """A bucket number that never falls as the value rises, with per_doubling buckets for each doubling of |value|."""
    return (F.signum(value) * F.floor(F.log2(F.abs(value) + 1.0) * per_doubling)).cast("bigint")


def rank_values(frequencies: DataFrame, keys: Sequence[str], targets: DataFrame, scratch: Scratch) -> DataFrame:
    """(keys, q, rank_value): for each target (keys, q, rank) the least value with at least `rank` weighted values at or below it.

    frequencies is (keys, value, n) with one row per key and value; a target whose rank is above the key's weight, or
    not positive, has no row. No key's values are gathered: the weights of value buckets (at most 1024 for each
    doubling of the value's size) say which bucket holds the rank, and only the values of these buckets are sorted,
    each bucket for itself.
    """
    k = list(keys)
    valued = frequencies.filter("value IS NOT NULL").select(*k, "value", "n", value_bucket(F.col("value")).alias("bucket"))
    weights = valued.groupBy(*k, "bucket").agg(F.sum("n").alias("weight"))
    upward = Window.partitionBy(*k).orderBy("bucket")
    before = F.coalesce(F.sum("weight").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    weights = weights.select(*k, "bucket", "weight", before.alias("before"))
    aimed = targets.select(*(col(c).alias(f"t_{c}") for c in k), "q", "rank")
    held = weights.join(aimed, _same(k, weights, aimed, "t_"))
    held = held.filter("rank > before AND rank <= before + weight").select(*(col(c).alias(f"h_{c}") for c in k), F.col("bucket").alias("h_bucket"), "before", "q", "rank")
    held = scratch.table(held, "held")
    same = _same(k, valued, held, "h_") & (valued["bucket"] == held["h_bucket"])
    in_bucket = Window.partitionBy(*k, "q", "bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = valued.join(held, same).select(*k, "q", "bucket", "value", "rank", (F.col("before") + F.sum("n").over(in_bucket)).alias("upto")).filter("upto >= rank")
    return reached.groupBy(*k, "q").agg(F.min("value").alias("rank_value"))


def _same(k: Sequence[str], left: DataFrame, right: DataFrame, prefix: str) -> Column:
    cond = left[k[0]].eqNullSafe(right[prefix + k[0]])
    for c in k[1:]:
        cond = cond & left[c].eqNullSafe(right[prefix + c])
    return cond


def rank_of(n: Column, share: tuple[int, int]) -> Column:
    """The least rank that covers p/q of n values: ceil(n * p / q), exactly."""
    p, q = share
    return F.ceil(n.cast("decimal(20,0)") * F.lit(p).cast("decimal(9,0)") / F.lit(q).cast("decimal(9,0)")).cast("bigint")


def key_profiles(frequencies: DataFrame, scratch: Scratch, quantiles: Mapping[str, tuple[int, int]] | None = None) -> DataFrame:
    """One row per field and key from weighted values: n, n_values, distinct_values, total, min, max, mode, percentiles.

    quantiles maps a column name to a share p/q, given as (p, q): the least value with at least that share of the
    key's values at or below it. All results are exact. The mode is the commonest value, of equally common ones the
    least. NULL values count in n only. An empty input gives an empty result.

    Scale: sums of one key are combined map-side; percentiles are found by rank_values.
    """
    frequencies = scratch.table(frequencies, "frequencies")
    value, n = F.col("value"), F.col("n")
    # One number that is larger for commoner, then for smaller values: max_by then stays in hash aggregation.
    commoner = n.cast("decimal(38,0)") * F.expr("10000000000000000000BD") - value.cast("decimal(20,0)")
    profiles = frequencies.groupBy("field_name", "key_id").agg(
        F.sum(n).alias("n"),
        F.coalesce(F.sum(F.when(value.isNotNull(), n)), F.lit(0)).alias("n_values"),
        F.count(value).alias("distinct_values"),
        F.coalesce(F.sum(value * n), F.lit(0)).alias("total"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.max_by(value, F.when(value.isNotNull(), commoner)).alias("mode_value"),
    )
    if not quantiles:
        return profiles
    if any(not 0 < p <= q for p, q in quantiles.values()):
        raise ConfigError("a quantile is a share p/q with 0 < p <= q")
    profiles = scratch.table(profiles, "profiles")
    names = list(quantiles)
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), rank_of(F.col("n_values"), share).alias("rank")) for i, share in enumerate(quantiles.values()))))
    targets = profiles.select("field_name", "key_id", ranks.alias("r")).select("field_name", "key_id", "r.q", "r.rank")
    values = rank_values(frequencies, ["field_name", "key_id"], targets, scratch)
    found = values.groupBy("field_name", "key_id").agg(*(F.min(F.when(F.col("q") == i, F.col("rank_value"))).alias(c) for i, c in enumerate(names)))
    same = profiles["field_name"].eqNullSafe(found["field_name"]) & profiles["key_id"].eqNullSafe(found["key_id"])
    return profiles.join(found, same, "left").select(*(profiles[c] for c in profiles.columns), *(found[c] for c in names))
