"""Chronological splits with purge gaps, entity exclusion, and a reference pool drawn by keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, InvariantViolation
from tidemark.functions.ids import ACCOUNT_INTERNAL, kind_of
from tidemark.functions.keyed import stable_key, with_keyed_uniform, with_keyed_uniforms
from tidemark.functions.timebase import DAY, snapshot_cutoff
from tidemark.operators.ranking import rank_in_groups
from tidemark.operators.truth import union_points
from tidemark.sources.digest import multiset_digest


@dataclass(frozen=True)
class SplitPlan:
    """Ends of the training and validation period, the end of the data, and the longest horizon, in seconds."""

    train_end: int
    val_end: int
    sim_end: int
    h_max: int

    def __post_init__(self) -> None:
        if not 0 < self.train_end < self.val_end < self.sim_end or self.h_max >= min(self.train_end, self.val_end - self.train_end, self.sim_end - self.val_end):
            raise ConfigError("periods must be in order and each longer than the horizon")

    def blocks(self) -> dict[str, tuple[int, int]]:
        """First and last cutoff of each block: a block's horizon ends by the block's own end, which leaves the purge gap."""
        return {"TRAIN": (0, self.train_end - self.h_max), "VAL": (self.train_end, self.val_end - self.h_max), "TEST": (self.val_end, self.sim_end - 1 - self.h_max)}


def days_within(low: int, high: int) -> range:
    """Snapshot days from 1 on whose cutoff t = day * 86400 - 1 has low <= t <= high."""
    return range(max(1, -(-(low + 1) // DAY)), (high + 1) // DAY + 1)


def points(accounts: DataFrame, days: range) -> DataFrame:
    """(account_id, day, t) of internal accounts open by the snapshot of each day."""
    internal = accounts.filter("account_kind = 'internal'").select("account_id", "opened_at")
    if not len(days):
        return internal.limit(0).select("account_id", F.lit(0).cast("bigint").alias("day"), F.lit(0).cast("bigint").alias("t"))
    spread = internal.withColumn("day", F.explode(F.sequence(F.lit(days.start).cast("bigint"), F.lit(days.stop - 1).cast("bigint"))))
    return spread.withColumn("t", snapshot_cutoff(F.col("day"))).filter("opened_at <= t").drop("opened_at")


@dataclass(frozen=True)
class SplitIndex:
    train_all: DataFrame
    val: DataFrame
    test: DataFrame
    ood: DataFrame
    plan: SplitPlan

    def train(self, mode: str = "include_immature") -> DataFrame:
        """All training points, or with mature_only those whose labels have had time to become known."""
        if mode == "include_immature":
            return self.train_all
        if mode == "mature_only":
            return self.train_all.filter("is_mature")
        raise ConfigError(f"unknown mode {mode}")

    def digest(self) -> DataFrame:
        """Order-free digest of all points and their blocks."""
        blocks = [df.select("account_id", "day", "t", F.lit(name).alias("block")) for name, df in (("TRAIN", self.train_all), ("VAL", self.val), ("TEST", self.test), ("OOD", self.ood))]
        return multiset_digest(union_points(blocks))


def example_index(accounts: DataFrame, ood_accounts: DataFrame, ref_accounts: DataFrame, plan: SplitPlan, horizon_s: int, maturity_s: int) -> SplitIndex:
    """Points of the three blocks without accounts that are out-of-distribution or in the reference pool; those, tagged by group, are `ood`."""
    if horizon_s > plan.h_max:
        raise ConfigError("the horizon is longer than the longest that the plan allows for")
    held = ood_accounts.select("account_id", F.lit("ood").alias("group")).unionByName(ref_accounts.select("account_id", F.lit("ref").alias("group"))).groupBy("account_id").agg(F.min("group").alias("group"))
    made, apart = {}, []
    for name, (low, high) in plan.blocks().items():
        p = points(accounts, days_within(low, high))
        made[name] = p.join(held, "account_id", "left_anti")
        apart.append(p.join(held, "account_id").withColumn("block", F.lit(name)))
    train = made["TRAIN"].withColumn("is_mature", F.lit(plan.train_end) - (F.col("t") + horizon_s) >= maturity_s)
    return SplitIndex(train, made["VAL"], made["TEST"], union_points(apart), plan)


def normal_accounts(accounts: DataFrame) -> DataFrame:
    """Internal accounts that no scenario created, by the kind in their id."""
    return accounts.filter(kind_of(F.col("account_id")) == ACCOUNT_INTERNAL)


def cell_keys(cells: Sequence[str], key: str) -> list[int]:
    """The key of each cell's numbers, and of the none cell's, which comes last. The names' prefix is a fixed value."""
    return [stable_key(key) ^ stable_key(f"recruit-cell/{name}") for name in (*cells, "NONE")]


def rendezvous_partition(accounts: DataFrame, cells: int | Sequence[str], share_none: float, key: str) -> DataFrame:
    """(account_id, cell): the number of the cell with the greatest weighted score -w / ln(u), u keyed by cell and account; -1 is none.

    `cells` are the cells' names, or how many there are. Each account meets each cell inside its own row (an array of
    scores), so nothing is joined or shuffled, and adding a cell moves only accounts to it or to none. The none cell
    weighs cells * (1 - s) / s for a share s of eligible accounts; the first of equal scores wins, none last.
    """
    names = list(map(str, range(cells))) if isinstance(cells, int) else list(cells)
    if not names or not 0 < share_none < 1:
        raise ConfigError("at least one cell, and a share between 0 and 1")
    eligible = 1 - share_none
    weights = [1.0] * len(names) + [len(names) * (1 - eligible) / eligible]
    drawn = with_keyed_uniforms(accounts.select("account_id"), cell_keys(names, key), F.col("account_id"))
    scored = drawn.withColumn("score", F.zip_with("u", F.array(*map(F.lit, weights)), lambda u, w: -w / F.log(u)))
    place = F.array_position("score", F.array_max("score"))
    return scored.select("account_id", F.when(place > len(names), -1).otherwise(place - 1).cast("int").alias("cell"))


def reference_pool(eligible: DataFrame, everyone: DataFrame, fraction: float, key: str, method: str) -> DataFrame:
    """(account_id) of the pool: a fraction of everyone, drawn from the eligible by a keyed hash.

    none_cell_hash keeps u < fraction * |everyone| / |eligible|; stratified_archetype takes per archetype the
    round-half-even(fraction * n) eligible accounts with the least u, ties by id, and raises if there are too few. Both
    inputs are (account_id, archetype).
    """
    drawn = with_keyed_uniform(eligible, stable_key(key), F.col("account_id"))
    if method == "none_cell_hash":
        n_all, n = everyone.count(), eligible.count()
        return drawn.filter(F.col("u") * n < fraction * n_all).select("account_id")
    if method != "stratified_archetype":
        raise ConfigError(f"unknown method {method}")
    goal = everyone.groupBy("archetype").agg(F.bround(F.count(F.lit(1)) * F.lit(fraction)).cast("bigint").alias("goal"))
    short = goal.join(eligible.groupBy("archetype").agg(F.count(F.lit(1)).alias("n")), "archetype", "left").filter("coalesce(n, 0) < goal")
    bad = short.select("archetype").limit(5).collect()
    if bad:
        raise InvariantViolation(f"too few eligible accounts of {[r[0] for r in bad]}")
    ranked = rank_in_groups(drawn, ["archetype"], F.floor(F.col("u") * 4_096), [F.col("u"), F.col("account_id")], "no")
    return ranked.join(F.broadcast(goal), "archetype").filter("no <= goal").select("account_id")  # a row per archetype


def pool_composition(pool: DataFrame, everyone: DataFrame) -> DataFrame:
    """(archetype, n_pool, share_pool, share_population, diff_pp)."""
    inside = everyone.join(pool, "account_id", "left_semi")

    def shares(df: DataFrame, n: str, share: str) -> DataFrame:
        c = df.groupBy("archetype").agg(F.count(F.lit(1)).alias(n))
        return c.withColumn(share, F.col(n) / F.sum(n).over(Window.partitionBy()))  # a row per archetype

    both = shares(everyone, "n_all", "share_population").join(shares(inside, "n_pool", "share_pool"), "archetype", "left")
    return both.select("archetype", F.coalesce("n_pool", F.lit(0)).alias("n_pool"), F.coalesce("share_pool", F.lit(0.0)).alias("share_pool"), "share_population", (100 * (F.coalesce("share_pool", F.lit(0.0)) - F.col("share_population"))).alias("diff_pp"))
