"""Daily snapshot features: for each account and snapshot day what the trailing windows before that day hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.timebase import DAY, HOUR, day_of, is_night, snapshot_cutoff
from tidemark.operators.sides import SETTLED, last_before, order_number, sides

# Fixed value: a holding time is capped at this, and is this where there is no earlier credit.
HOLD_CAP = 30 * DAY

WINDOWED = ("total_amount", "total_amount_in", "total_amount_out", "txn_count", "in_degree", "out_degree", "avg_holding_time", "max_amount", "net_flow_ratio", "atm_share", "night_share", "declined_count", "distinct_devices", "distinct_ips")


DISTINCT = ("in_degree", "out_degree", "distinct_devices", "distinct_ips")


def feature_names(windows: Sequence[int] = (7, 30)) -> list[str]:
    return [f"{f}_{w}d" for w in windows for f in WINDOWED] + ["account_age_days", "balance"]


def rolling_distinct(pairs: DataFrame, windows: Sequence[int], kinds: Sequence[str]) -> DataFrame:
    """(account_id, day, {kind}_{w}d …): changes of the number of distinct keys of a kind seen in the w days before a day.

    pairs is (account_id, kind, key, day). A key's last day before counts for w days: it enters the window of day x+1
    and leaves that of day x+w+1 unless it comes again before. The running sum of the changes is the exact count. All
    kinds and windows go through one shuffle.
    """
    seen = pairs.filter("key IS NOT NULL").distinct()
    again = F.lead("day").over(Window.partitionBy("account_id", "kind", "key").orderBy("day"))
    moves = []
    for i, w in enumerate(windows):
        leaves = F.least(F.col("again"), F.col("day") + w) + 1
        moves += [F.struct((F.col("day") + 1).alias("day"), F.lit(i).alias("w"), F.lit(1).alias("change")), F.struct(leaves.alias("day"), F.lit(i).alias("w"), F.lit(-1).alias("change"))]
    long = seen.withColumn("again", again).select("account_id", "kind", F.explode(F.array(*moves)).alias("m")).select("account_id", "kind", "m.*")
    sums = [F.sum(F.when((F.col("w") == i) & (F.col("kind") == n), F.col("change")).otherwise(0)).alias(f"{kind}_{w}d") for n, kind in enumerate(kinds) for i, w in enumerate(windows)]
    return long.groupBy("account_id", "day").agg(*sums)


def snapshot_features(
    transactions: DataFrame,
    logins: DataFrame,
    accounts: DataFrame,
    first_day: int,
    last_day: int,
    windows: Sequence[int] = (7, 30),
    *,
    days: Sequence[int] | None = None,
    internal_only: bool = True,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """(account_id, day, features) for each internal account and snapshot day first_day … last_day that it was open by.

    With `days` only these of them are given, with internal_only=False external accounts as well, and with `only` just
    the named features: what the others need is then not computed.

    A snapshot of day d sees whole days before d only; its window of w days is d-w … d-1. Money features use settled
    transactions; in- and out-degree distinct counterparties of settled transfers; declined_count the account's own
    transactions that did not settle; devices and IPs those of successful logins. avg_holding_time is the amount-weighted
    time, in hours, since the account's previous settled credit, at most 720. Ratios without a denominator are 0
    (net_flow_ratio 1). balance is the last recorded one before the day, else the initial balance.

    Scale: external accounts, which carry most rows, are left out before anything is gathered by account; events become
    one row per account and day in one aggregation, and all windows run over one sorted table of days. Equal keys of an
    account are counted once per day. Inputs have one row per key.
    """
    if first_day < 1 or last_day < first_day or any(not first_day <= d <= last_day for d in days or ()):
        raise ConfigError("snapshot days start with 1 and lie between the first and the last")
    wanted = list(only) if only is not None else feature_names(windows)
    if unknown := set(wanted) - set(feature_names(windows)):
        raise ConfigError(f"unknown features {sorted(unknown)}")
    bases = {f.rpartition("_")[0] if f[-1] == "d" else f for f in wanted}
    internal = (accounts.filter("account_kind = 'internal'") if internal_only else accounts).select("account_id", "opened_at", "initial_balance_minor")
    both_sides = sides(transactions.filter(F.col("ts") <= snapshot_cutoff(last_day)), ("txn_type",)).join(internal.select("account_id"), "account_id", "left_semi")
    settled, credit = F.col("status") == SETTLED, F.col("is_credit")
    if "avg_holding_time" in bases:
        own = last_before(both_sides, F.when(settled & credit, F.col("ts")), "credit_ts")
    else:
        own = both_sides.withColumn("credit_ts", F.lit(None).cast("bigint"))
    amount, day = F.col("amount_minor"), day_of("ts")
    hold = F.least(F.coalesce(F.col("ts") - F.col("credit_ts"), F.lit(HOLD_CAP)), F.lit(HOLD_CAP))
    out = settled & ~credit

    def total(cond, what=amount):
        return F.sum(F.when(cond, what).otherwise(0))

    daily = own.groupBy("account_id", day.alias("day")).agg(
        total(settled & credit).alias("amount_in"),
        total(out).alias("amount_out"),
        F.count_if(settled).alias("n"),
        F.max(F.when(settled, amount)).alias("largest"),
        total(out, amount.cast("double") * hold).alias("held"),
        total(out & (F.col("txn_type") == "ATM_WITHDRAWAL")).alias("atm"),
        F.count_if(settled & is_night("ts")).alias("night"),
        F.count_if(~settled & ~credit).alias("declined"),
        F.max_by("after", order_number()).alias("closing"),
    )
    transfers = both_sides.filter(settled & (F.col("txn_type") == "TRANSFER")).select("account_id", F.when(credit, 0).otherwise(1).alias("kind"), F.col("counterparty_id").alias("key"), day.alias("day"))
    entered = logins.filter("outcome = 'SUCCESS'").filter(F.col("ts") <= snapshot_cutoff(last_day)).join(internal.select("account_id"), "account_id", "left_semi")
    used = F.explode(F.array(F.struct(F.lit(2).alias("kind"), F.col("device_id").alias("key")), F.struct(F.lit(3).alias("kind"), F.col("ip_id").alias("key"))))
    pairs = transfers.unionByName(entered.select("account_id", day.alias("day"), used.alias("u")).select("account_id", "u.*", "day"))
    if bases & {"in_degree", "out_degree"} and not bases & {"distinct_devices", "distinct_ips"}:
        pairs = transfers
    changes = rolling_distinct(pairs, windows, DISTINCT)
    opening = F.greatest(F.lit(first_day).cast("bigint"), F.ceil((F.col("opened_at") + 1) / DAY))
    begins = F.lit(0).cast("bigint")
    spine = internal.select("account_id", "opened_at", "initial_balance_minor", opening.alias("shown_from"), F.explode(F.sequence(begins, F.lit(last_day).cast("bigint"))).alias("day"))
    facts = daily.unionByName(changes, allowMissingColumns=True)
    if not bases & set(DISTINCT):
        facts = daily.select("*", *(F.lit(None).cast("bigint").alias(c) for c in changes.columns if c not in ("account_id", "day")))
    elif bases <= {*DISTINCT, "account_age_days"}:
        facts = changes.select("*", *(F.lit(None).cast(daily.schema[c].dataType).alias(c) for c in daily.columns if c not in ("account_id", "day")))
    # All facts of one account and day in one row: a single shuffle for the daily rows and the changes.
    merged = facts.groupBy("account_id", "day").agg(*(F.sum(c).alias(c) if c not in ("largest", "closing") else F.max(c).alias(c) for c in facts.columns if c not in ("account_id", "day")))
    rows = spine.join(merged, ["account_id", "day"], "left")
    by_day = Window.partitionBy("account_id").orderBy("day")
    columns = []
    for w in windows:
        trailing = by_day.rowsBetween(-w, -1)

        def over(c, trailing=trailing):
            return F.coalesce(F.sum(c).over(trailing), F.lit(0))

        a_in, a_out, n = over("amount_in"), over("amount_out"), over("n")
        both = a_in + a_out
        features = {
            "total_amount": both,
            "total_amount_in": a_in,
            "total_amount_out": a_out,
            "txn_count": n,
            "in_degree": _running(f"in_degree_{w}d", by_day),
            "out_degree": _running(f"out_degree_{w}d", by_day),
            "avg_holding_time": F.when(a_out > 0, over("held") / a_out / HOUR).otherwise(F.lit(HOLD_CAP / HOUR)),
            "max_amount": F.coalesce(F.max("largest").over(trailing), F.lit(0)),
            "net_flow_ratio": F.when(both > 0, F.abs(a_in - a_out) / both).otherwise(F.lit(1.0)),
            "atm_share": F.when(a_out > 0, over("atm") / a_out).otherwise(F.lit(0.0)),
            "night_share": F.when(n > 0, over("night") / n).otherwise(F.lit(0.0)),
            "declined_count": over("declined"),
            "distinct_devices": _running(f"distinct_devices_{w}d", by_day),
            "distinct_ips": _running(f"distinct_ips_{w}d", by_day),
        }
        columns += [features[f].alias(f"{f}_{w}d") for f in WINDOWED]
    closing = F.last("closing", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, -1))
    age = (snapshot_cutoff(F.col("day")) - F.col("opened_at")) / DAY
    result = rows.select("account_id", "day", "shown_from", *columns, age.alias("account_age_days"), F.coalesce(closing, "initial_balance_minor").alias("balance"))
    result = result.filter("day >= shown_from")
    if days is not None:
        result = result.filter(F.col("day").isin(*days))
    return result.select("account_id", "day", *wanted)


def _running(change: str, by_day) -> Column:
    return F.coalesce(F.sum(change).over(by_day.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
