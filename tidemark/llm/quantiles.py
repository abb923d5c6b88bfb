"""Percentiles per group over very many values: mergeable KLL sketches, and exact values found through them.

The sketch is Spark's own KLL implementation (hierarchies of compactors that sort their values and keep every other
one from a random start, merged level by level), which runs inside the JVM's aggregation. Of a sketch with parameter k
over any number of values the rank error of an answer is at most 2.296 / k^0.9021 with 99 % probability.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.frequencies import rank_of, rank_values
from tidemark.session import Scratch

K = 1024


def rank_error(k: int) -> float:
    """Normalised rank error of one answer that is kept with 99 % probability."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, groups: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(groups, sketch): one mergeable sketch per group. Each task sends one sketch per group, so hot groups are harmless.

    NULL values are left out; a group of only NULL values has an empty sketch; NULL is a group like any other.
    """
    return df.groupBy(*map(col, groups)).agg(F.kll_sketch_agg_bigint(col(value).cast("bigint"), k).alias("sketch"))


def merge_sketches(parts: DataFrame, groups: Sequence[str], k: int = K) -> DataFrame:
    """(groups, sketch): sketches of separate partitions, days or batches, merged level by level; a group without values has none."""
    return parts.filter(F.kll_sketch_get_n_bigint("sketch") > 0).groupBy(*map(col, groups)).agg(F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def estimates(merged: DataFrame, groups: Sequence[str], shares: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(groups, n, and per share its estimated percentile): within rank_error(k) of the true rank."""
    return merged.select(*map(col, groups), F.kll_sketch_get_n_bigint("sketch").alias("n"), *(F.kll_sketch_get_quantile_bigint("sketch", F.lit(p / q)).alias(name) for name, (p, q) in shares.items()))


def exact_percentiles(df: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, tuple[int, int]], scratch: Scratch, merged: DataFrame, k: int = K) -> DataFrame:
    """(groups, n, and per share the least value with at least that share of the group's values at or below it), exact.

    The merged sketches of df's groups bracket each percentile by twice their rank error. df is then counted: what lies
    below a bracket, and how often each value in it occurs; the value at the remaining rank is then found without
    gathering a group (rank_values). That a bracket holds its rank is checked on the counts; where it does not (about
    once in 10 000), the group is done again with the bracket open on both sides. df is read a few times and should be
    a written table. NULL values are left out; a group of only NULL values and an empty table give no row.
    """
    if any(not 0 < p <= q for p, q in shares.values()):
        raise ConfigError("a share p/q needs 0 < p <= q")
    g = [f"g{i}" for i in range(len(groups))]
    rows = df.select(*(col(c).alias(a) for c, a in zip(groups, g, strict=True)), col(value).cast("bigint").alias("value")).filter("value IS NOT NULL")
    merged = scratch.table(merged.select(*(col(c).alias(a) for c, a in zip(groups, g, strict=True)), "sketch", F.kll_sketch_get_n_bigint("sketch").alias("n")), "merged")
    wide = 2 * rank_error(k)

    def bound(share: float):
        return F.kll_sketch_get_quantile_bigint("sketch", F.lit(min(1.0, max(0.0, share))))

    brackets = [F.struct(F.lit(i).alias("q"), rank_of(F.col("n"), (p, q)).alias("rank"), bound(p / q - wide).alias("low"), bound(p / q + wide).alias("high")) for i, (p, q) in enumerate(shares.values())]
    targets = scratch.table(merged.select(*g, F.array(*brackets).alias("b")), "targets")
    done = None
    for turn in range(2):
        t = targets.select(*(F.col(c).alias(f"t_{c}") for c in g), F.col("b").alias("brackets"))
        same = F.lit(True)
        for c in g:
            same = same & rows[c].eqNullSafe(t[f"t_{c}"])
        # Values below a bracket are only counted, in one row per group and task; those in one are told apart.
        met = rows.join(t, same).select(*g, "value", "brackets")
        numbers = range(len(shares))
        under = met.groupBy(*g).agg(*(F.count_if(F.exists("brackets", _below(i))).alias(f"q{i}") for i in numbers))
        under = under.select(*g, F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.col(f"q{i}").alias("n")) for i in numbers))).alias("u")).select(*g, "u.q", F.lit(None).cast("bigint").alias("value"), "u.n")
        inside = met.select(*g, "value", F.filter("brackets", lambda b: (F.col("value") >= b["low"]) & (F.col("value") <= b["high"])).alias("brackets")).filter(F.size("brackets") > 0)
        inside = inside.select(*g, F.explode("brackets.q").alias("q"), "value").groupBy(*g, "q", "value").agg(F.count(F.lit(1)).alias("n"))
        counted = scratch.table(under.unionByName(inside), f"counted{turn}")
        below = counted.groupBy(*g, "q").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"), F.sum("n").alias("upto"))
        b = below.select(*(F.col(c).alias(f"t_{c}") for c in g), F.col("q").alias("t_q"), "below", "upto")
        each = targets.select(*g, F.explode("b").alias("b")).select(*g, "b.*")
        same = each["q"] == b["t_q"]
        for c in g:
            same = same & each[c].eqNullSafe(b[f"t_{c}"])
        checked = scratch.table(each.join(b, same).select(*g, "q", "rank", "below", "upto"), f"checked{turn}")
        held = checked.filter("below < rank AND rank <= upto").select(*g, "q", (F.col("rank") - F.col("below")).alias("rank"))
        values = scratch.table(_values(counted, g, held, scratch), f"values{turn}")
        done = values if done is None else done.unionByName(values)
        missed = checked.filter("NOT (below < rank AND rank <= upto)")
        if missed.isEmpty():
            break
        open_ended = (F.lit(-(2**63)).cast("bigint").alias("low"), F.lit(2**63 - 1).cast("bigint").alias("high"))
        targets = scratch.table(missed.groupBy(*g).agg(F.collect_list(F.struct("q", "rank", *open_ended)).alias("b")), "targets_again")
    per_group = done.groupBy(*g).agg(*(F.min(F.when(F.col("q") == i, F.col("rank_value"))).alias(name) for i, name in enumerate(shares)))
    p = per_group.select(*(F.col(c).alias(f"p_{c}") for c in g), *shares)
    same = F.lit(True)
    for c in g:
        same = same & merged[c].eqNullSafe(p[f"p_{c}"])
    return merged.join(p, same).select(*(F.col(a).alias(c) for c, a in zip(groups, g, strict=True)), "n", *shares)


def _below(q: int):
    return lambda b: (b["q"] == q) & (F.col("value") < b["low"])


def _values(counted: DataFrame, g: Sequence[str], held: DataFrame, scratch: Scratch) -> DataFrame:
    """(g, q, rank_value): each percentile has candidates of its own, so its number is one of the keys."""
    keys = [*g, "no"]
    found = rank_values(counted.withColumnRenamed("q", "no"), keys, held.withColumn("no", F.col("q")), scratch)
    return found.select(*g, "q", "rank_value")
