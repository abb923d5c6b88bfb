"""The account-centric view of transactions: one row per transaction and side, and what runs along an account."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SETTLED = "SETTLED"


def sides(transactions: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two rows per transaction: account_id, counterparty_id, is_credit, before, after, delta (what settled moved), and ts, event_id, amount_minor, status.

    The source side comes with is_credit false. One scan, no shuffle. Further columns in `keep` are passed on.
    """
    moved = F.when(F.col("status") == SETTLED, F.col("amount_minor")).otherwise(F.lit(0).cast("bigint"))
    debit = F.struct(
        F.col("src_account_id").alias("account_id"), F.col("dst_account_id").alias("counterparty_id"), F.lit(False).alias("is_credit"),
        F.col("src_balance_before_minor").alias("before"), F.col("src_balance_after_minor").alias("after"), (-moved).alias("delta"),
    )
    credit = F.struct(
        F.col("dst_account_id").alias("account_id"), F.col("src_account_id").alias("counterparty_id"), F.lit(True).alias("is_credit"),
        F.col("dst_balance_before_minor").alias("before"), F.col("dst_balance_after_minor").alias("after"), moved.alias("delta"),
    )
    names = dict.fromkeys(["event_id", "ts", "amount_minor", "status", *keep])
    return transactions.select(*names, F.explode(F.array(debit, credit)).alias("side")).select("side.*", *names)


def in_order(*partition: str):
    """Along the global order (ts, event_id); of one transaction on both sides of an account the debit comes first."""
    return Window.partitionBy(*partition).orderBy("ts", "event_id", "is_credit")


def order_number() -> Column:
    """The place in the order (ts, event_id, is_credit) as one number, with which max_by stays in hash aggregation."""
    event = F.col("event_id").cast("decimal(19,0)") * 2 + F.col("is_credit").cast("int")
    return (F.col("ts").cast("decimal(18,0)") * F.expr("100000000000000000000BD") + event).cast("decimal(38,0)")


SLICE = 3_600  # seconds of an account that are kept together


def along(df: DataFrame, sums: Mapping[str, str] | None = None, lasts: Mapping[str, Column] | None = None, slice_seconds: int = SLICE) -> DataFrame:
    """df of sides with, for each name in sums, the running sum of a column along its account up to and including the row,
    and for each in lasts the last non-NULL value of an expression strictly earlier in (ts, event_id).

    Two levels: within a slice of the account's time by a window, and over the account's slices by one row for each. So
    a task never holds more of an account than one of its slices, and one row for each of them. NULLs add nothing to a sum.
    """
    sums, lasts = dict(sums or {}), dict(lasts or {})
    marked = df.withColumns({"__slice": F.floor(F.col("ts") / slice_seconds)} | {f"__last{i}": value for i, value in enumerate(lasts.values())})
    order = order_number()
    per = [F.sum(value).alias(f"__sum{i}") for i, value in enumerate(sums.values())]
    per += [F.max_by(f"__last{i}", F.when(F.col(f"__last{i}").isNotNull(), order)).alias(f"__last{i}") for i in range(len(lasts))]
    earlier = Window.partitionBy("account_id").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.coalesce(F.sum(f"__sum{i}").over(earlier), F.lit(0)).alias(f"__carried_sum{i}") for i in range(len(sums))]
    carried += [F.last(f"__last{i}", ignorenulls=True).over(earlier).alias(f"__carried_last{i}") for i in range(len(lasts))]
    before = marked.groupBy("account_id", "__slice").agg(*per).select(F.col("account_id").alias("__account"), F.col("__slice").alias("__of"), *carried)
    # A RANGE frame of the order less itself would be needed for equal keys; both sides of a transaction to itself are
    # excluded by the integrity checks, so rows do.
    within = in_order("account_id", "__slice")
    upto, earlier = within.rowsBetween(Window.unboundedPreceding, Window.currentRow), within.rowsBetween(Window.unboundedPreceding, -1)
    own = {f"__own_sum{i}": F.coalesce(F.sum(value).over(upto), F.lit(0)) for i, value in enumerate(sums.values())}
    own |= {f"__own_last{i}": F.last(f"__last{i}", ignorenulls=True).over(earlier) for i in range(len(lasts))}
    both = marked.withColumns(own).join(before, (F.col("account_id") == F.col("__account")) & (F.col("__slice") == F.col("__of")))
    found = [(F.col(f"__own_sum{i}") + F.col(f"__carried_sum{i}")).alias(name) for i, name in enumerate(sums)]
    found += [F.coalesce(f"__own_last{i}", f"__carried_last{i}").alias(name) for i, name in enumerate(lasts)]
    return both.select(*df.columns, *found)


def last_before(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df of sides with the last non-NULL `value` of an account strictly earlier in (ts, event_id)."""
    return along(df, lasts={name: value})


def running_total(df: DataFrame, value: str, name: str) -> DataFrame:
    """df of sides with the running sum of `value` along its account up to and including the row."""
    return along(df, sums={name: value})
