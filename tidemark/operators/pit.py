"""Features with a cutoff for each row: the direct form of what the grid computes for day boundaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, FutureAccessError
from tidemark.functions.timebase import DAY, HOUR, day_of, is_night
from tidemark.operators.grid import HOLD_CAP
from tidemark.operators.sides import SETTLED, order_number, sides


def check_cutoffs(cutoffs: DataFrame, accounts: DataFrame, sim_end: int) -> None:
    """Raise unless every cutoff (account_id, t) lies in the horizon and its account is known and open by then."""
    j = cutoffs.join(accounts.select("account_id", "opened_at"), "account_id", "left")
    outside, unknown, early = j.agg(F.count_if((F.col("t") < 0) | (F.col("t") >= sim_end) | F.col("t").isNull()), F.count_if(F.col("opened_at").isNull()), F.count_if(F.col("opened_at") > F.col("t"))).first()
    if outside:
        raise ConfigError(f"{outside} cutoffs are outside of the horizon")
    if unknown:
        raise ConfigError(f"{unknown} cutoffs name an unknown account")
    if early:
        raise FutureAccessError(f"{early} cutoffs are before the account was opened")


def in_windows(cutoffs: DataFrame, events: DataFrame, window_days: int) -> DataFrame:
    """Each cutoff (row_id, account_id, t) with the account's events in (t - window, t].

    The range becomes an equi-join on account and day: a cutoff is given to each of the days that its window touches, so
    a busy account is spread over its days and no cutoff meets events outside of its window's days.
    """
    start = F.col("t") - window_days * DAY
    spread = cutoffs.select("row_id", F.col("account_id").alias("c_account"), "t", F.explode(F.sequence(day_of(start + 1), day_of("t"))).alias("c_day"))
    e = events.withColumn("e_day", day_of("ts"))
    return spread.join(e, (F.col("c_account") == F.col("account_id")) & (F.col("c_day") == F.col("e_day")) & (F.col("ts") > start) & (F.col("ts") <= F.col("t"))).drop("c_account", "c_day", "e_day")


#: What a row of window_features is, of a transaction's side, a login, or a bound; bounds are the highest.
CREDIT, DEBIT, ATM, DECLINED, DEVICE, IP, START, CUTOFF = range(8)


def window_features(cutoffs: DataFrame, transactions: DataFrame, logins: DataFrame, windows: Sequence[int] = (7, 30)) -> DataFrame:
    """(row_id, features): the windowed features of the grid over (t - w days, t] for each cutoff (row_id, account_id, t).

    The starts and ends of all windows of an account cut its time into pieces, so each window is whole pieces. Events
    and bounds go by account once, each event goes to its piece only, and windows run over one row per piece: nothing
    is repeated for the cutoffs that see it, and no table is joined whose size Spark takes for that of a smaller one. A
    key counts from its piece until it comes again in a later one or leaves the window. All of an account's rows are
    sorted in one task, which spills.
    """
    settled, credit = F.col("status") == SETTLED, F.col("is_credit")
    code = F.when(settled & credit, CREDIT).when(settled & (F.col("txn_type") == "ATM_WITHDRAWAL"), ATM).when(settled, DEBIT).when(~settled & ~credit, DECLINED)
    key = F.when(settled & (F.col("txn_type") == "TRANSFER"), F.col("counterparty_id"))
    moved = sides(transactions, ("txn_type",)).select("account_id", "ts", code.alias("code"), key.alias("key"), "event_id", "amount_minor").filter("code IS NOT NULL")
    used = F.explode(F.array(F.struct(F.lit(DEVICE).alias("code"), F.col("device_id").alias("key")), F.struct(F.lit(IP).alias("code"), F.col("ip_id").alias("key"))))
    entered = logins.filter("outcome = 'SUCCESS'").select("account_id", "ts", used.alias("u")).select("account_id", "ts", "u.*")
    bound = F.explode(F.array(F.struct(F.col("t").alias("ts"), F.lit(CUTOFF).alias("code")), *(F.struct((F.col("t") - w * DAY).alias("ts"), F.lit(START).alias("code")) for w in windows)))
    bounds = cutoffs.select("account_id", bound.alias("b")).select("account_id", "b.*")
    rows = moved.unionByName(entered, allowMissingColumns=True).unionByName(bounds, allowMissingColumns=True).filter("account_id IS NOT NULL AND ts IS NOT NULL")
    whole = Window.unboundedPreceding
    # The bound at or after a row ends its piece; rows after an account's last bound are in no window.
    back = Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("code")).rowsBetween(whole, Window.currentRow)
    rows = rows.withColumn("piece", F.min(F.when(F.col("code") >= START, F.col("ts"))).over(back)).filter((F.col("code") != START) & F.col("piece").isNotNull())
    earlier = Window.partitionBy("account_id").orderBy("ts", "event_id", F.col("code") == CREDIT).rowsBetween(whole, -1)
    rows = rows.withColumn("credit_ts", F.max(F.when(F.col("code") == CREDIT, F.col("ts"))).over(earlier))
    rows = rows.withColumn("again", F.lead("piece").over(Window.partitionBy("account_id", "code", "key").orderBy("piece")))
    rows = rows.withColumn("counts", F.col("key").isNotNull() & ~F.col("again").eqNullSafe(F.col("piece")))
    comes = F.struct(F.col("piece").alias("at"), F.lit(0).alias("leaves"))
    leaves = [F.struct(F.least(F.col("again"), F.col("piece") + w * DAY).alias("at"), F.lit(i).alias("leaves")) for i, w in enumerate(windows, 1)]
    rows = rows.withColumn("m", F.explode(F.when(F.col("counts"), F.array(comes, *leaves)).otherwise(F.array(comes)))).select("*", "m.*")
    amount, here = F.col("amount_minor"), F.col("leaves") == 0
    hold = F.least(F.coalesce(F.col("ts") - F.col("credit_ts"), F.lit(HOLD_CAP)), F.lit(HOLD_CAP))
    came, out, moves = F.col("code") == CREDIT, F.col("code").isin(DEBIT, ATM), F.col("code").isin(CREDIT, DEBIT, ATM)
    money = {
        "a_in": (came, amount), "a_out": (out, amount), "n": (moves, F.lit(1)), "held": (out, amount.cast("double") * hold), "atm": (F.col("code") == ATM, amount),
        "night": (moves & is_night("ts"), F.lit(1)), "declined": (F.col("code") == DECLINED, F.lit(1)),
    }
    kinds = {"in": CREDIT, "out": DEBIT, "devices": DEVICE, "ips": IP}
    sums = [F.sum(F.when(here & cond, what).otherwise(0)).alias(name) for name, (cond, what) in money.items()]
    changes = [
        F.sum(F.when(F.col("counts") & (F.col("code") == kind), F.when(here, 1).when(F.col("leaves") == i, -1)).otherwise(0)).alias(f"{name}_{w}")
        for name, kind in kinds.items()
        for i, w in enumerate(windows, 1)
    ]
    pieces = rows.groupBy("account_id", "at").agg(*sums, F.max(F.when(here & moves, amount)).alias("largest"), *changes, F.max(here & (F.col("code") == CUTOFF)).alias("asked"))
    by_time = Window.partitionBy("account_id").orderBy("at")
    inside = {w: by_time.rangeBetween(1 - w * DAY, Window.currentRow) for w in windows}
    found = [F.sum(name).over(inside[w]).alias(f"{name}_{w}") for w in windows for name in money] + [F.max("largest").over(inside[w]).alias(f"largest_{w}") for w in windows]
    found += [F.sum(f"{name}_{w}").over(by_time.rangeBetween(whole, Window.currentRow)).alias(f"{name}_{w}") for w in windows for name in kinds]
    seen = pieces.select(F.col("account_id").alias("__account"), F.col("at").alias("__at"), "asked", *found).filter("asked").drop("asked")
    result = cutoffs.select("row_id", "account_id", "t").join(seen.hint("merge"), (F.col("account_id") == F.col("__account")) & (F.col("t") == F.col("__at")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = []
    for w in windows:
        a_in, a_out, n = F.col(f"a_in_{w}"), F.col(f"a_out_{w}"), F.col(f"n_{w}")
        both = zero(f"a_in_{w}") + zero(f"a_out_{w}")
        columns += [
            both.alias(f"total_amount_{w}d"), zero(f"a_in_{w}").alias(f"total_amount_in_{w}d"), zero(f"a_out_{w}").alias(f"total_amount_out_{w}d"), zero(f"n_{w}").alias(f"txn_count_{w}d"),
            zero(f"in_{w}").alias(f"in_degree_{w}d"), zero(f"out_{w}").alias(f"out_degree_{w}d"),
            F.when(a_out > 0, F.col(f"held_{w}") / a_out / HOUR).otherwise(F.lit(HOLD_CAP / HOUR)).alias(f"avg_holding_time_{w}d"), zero(f"largest_{w}").alias(f"max_amount_{w}d"),
            F.when(both > 0, F.abs(F.coalesce(a_in, F.lit(0)) - F.coalesce(a_out, F.lit(0))) / both).otherwise(F.lit(1.0)).alias(f"net_flow_ratio_{w}d"),
            F.when(a_out > 0, F.col(f"atm_{w}") / a_out).otherwise(F.lit(0.0)).alias(f"atm_share_{w}d"), F.when(n > 0, F.col(f"night_{w}") / n).otherwise(F.lit(0.0)).alias(f"night_share_{w}d"),
            zero(f"declined_{w}").alias(f"declined_count_{w}d"), zero(f"devices_{w}").alias(f"distinct_devices_{w}d"), zero(f"ips_{w}").alias(f"distinct_ips_{w}d"),
        ]
    return result.select("row_id", *columns)


def balance_at(cutoffs: DataFrame, transactions: DataFrame, accounts: DataFrame) -> DataFrame:
    """(row_id, balance, account_age_days): the last balance recorded by t on either side, whatever its status, else the initial one.

    Found in two steps, the last balance of each earlier day carried forward and the last one within t's own day.
    """
    own = sides(transactions).join(cutoffs.select("account_id").distinct(), "account_id", "left_semi").withColumn("e_day", day_of("ts"))
    order = order_number()
    closing = own.groupBy("account_id", "e_day").agg(F.max_by("after", order).alias("closing"))
    asked = cutoffs.select("row_id", "account_id", "t", day_of("t").alias("t_day"))
    marks = closing.select("account_id", F.col("e_day").alias("day"), "closing", F.lit(None).cast(cutoffs.schema["row_id"].dataType).alias("row_id")).unionByName(asked.select("account_id", F.col("t_day").alias("day"), F.lit(None).cast("bigint").alias("closing"), "row_id"))
    earlier = Window.partitionBy("account_id").orderBy("day").rangeBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("carried", F.last("closing", ignorenulls=True).over(earlier)).filter("row_id IS NOT NULL").select("row_id", "carried")
    today = asked.join(own.select(F.col("account_id").alias("e_account"), "e_day", "ts", "event_id", "is_credit", "after"), (F.col("account_id") == F.col("e_account")) & (F.col("t_day") == F.col("e_day")) & (F.col("ts") <= F.col("t")))
    today = today.groupBy("row_id").agg(F.max_by("after", order).alias("today"))
    known = accounts.select("account_id", "opened_at", "initial_balance_minor")
    return asked.join(carried, "row_id", "left").join(today, "row_id", "left").join(known, "account_id").select("row_id", F.coalesce("today", "carried", "initial_balance_minor").alias("balance"), ((F.col("t") - F.col("opened_at")) / DAY).alias("account_age_days"))


def temporal_order(cutoffs: DataFrame, transactions: DataFrame, window_days: int) -> DataFrame:
    """(row_id, burstiness, median_gap_h, credit_to_debit_h) over the settled sides in (t - window, t].

    burstiness is (σ-μ)/(σ+μ) of the gaps, 0 below three events or where σ+μ is 0; median_gap_h needs two events;
    credit_to_debit_h is the time from the first credit to the first strictly later debit. Without them the window's
    hours stand.
    """
    own = sides(transactions.filter(F.col("status") == SETTLED))
    hit = in_windows(cutoffs, own, window_days)
    order = Window.partitionBy("row_id").orderBy("ts", "event_id", "is_credit")
    gaps = hit.withColumns({"gap": F.col("ts") - F.lag("ts").over(order), "first_credit": F.min(F.when(F.col("is_credit"), F.col("ts"))).over(Window.partitionBy("row_id"))})
    later = F.min(F.when(~F.col("is_credit") & (F.col("ts") > F.col("first_credit")), F.col("ts")))
    g = gaps.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"), F.median("gap").alias("median"), (later - F.min("first_credit")).alias("turn"))
    whole = F.lit(window_days * 24.0)
    spread = F.col("sd") + F.col("mean")
    return cutoffs.select("row_id").join(g, "row_id", "left").select(
        "row_id",
        F.when((F.col("n") >= 3) & (spread > 0), (F.col("sd") - F.col("mean")) / spread).otherwise(F.lit(0.0)).alias("burstiness"),
        F.when(F.col("n") >= 2, F.col("median") / HOUR).otherwise(whole).alias("median_gap_h"),
        F.coalesce(F.col("turn") / HOUR, whole).alias("credit_to_debit_h"),
    )


def neighbours(points: DataFrame, transactions: DataFrame, accounts: DataFrame, window_days: int) -> DataFrame:
    """(row_id, account_id): distinct internal counterparties of settled transfers in the window of each point (row_id, account_id, t)."""
    own = sides(transactions.filter((F.col("status") == SETTLED) & (F.col("txn_type") == "TRANSFER")))
    met = in_windows(points, own, window_days).select("row_id", F.col("counterparty_id").alias("account_id")).distinct()
    return met.join(accounts.filter("account_kind = 'internal'").select("account_id"), "account_id", "left_semi")


def neighbour_means(points: DataFrame, transactions: DataFrame, accounts: DataFrame, grid: DataFrame, features: Sequence[str], window_days: int = 30) -> DataFrame:
    """(row_id, nbr_mean_<feature>): mean of the neighbours' own snapshots of the point's day; 0 without neighbours. points has row_id, account_id, day and t."""
    met = neighbours(points, transactions, accounts, window_days).join(points.select("row_id", "day"), "row_id")
    means = met.join(grid.select("account_id", "day", *features), ["account_id", "day"]).groupBy("row_id").agg(*(F.avg(f).alias(f) for f in features))
    return points.select("row_id").join(means, "row_id", "left").select("row_id", *(F.coalesce(F.col(f), F.lit(0.0)).alias(f"nbr_mean_{f}") for f in features))
