"""Descriptive tables of a dataset, and a report of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timebase import DAY, HOUR, hour_of, is_night, is_weekend
from tidemark.operators.frequencies import rank_values
from tidemark.session import Scratch


def counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def nearest_quantiles(df: DataFrame, groups: Sequence[str], value: str, shares: Mapping[str, float], scratch: Scratch) -> DataFrame:
    """(groups, one column per share): the value at rank round-half-even(q (n-1)) from 0, by counting equal values first."""
    g = list(groups) or ["all"]
    rows = df.select(*groups, F.col(value).alias("value")) if groups else df.select(F.lit(0).alias("all"), F.col(value).alias("value"))
    freq = scratch.table(rows.filter("value IS NOT NULL").groupBy(*g, "value").agg(F.count(F.lit(1)).alias("n")), "quantile_freq")
    n = freq.groupBy(*g).agg(F.sum("n").alias("n"))
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), (F.bround((F.col("n") - 1) * F.lit(q)) + 1).cast("bigint").alias("rank")) for i, q in enumerate(shares.values()))))
    targets = n.select(*g, ranks.alias("r")).select(*g, "r.*")
    found = rank_values(freq, g, targets, scratch).groupBy(*g).agg(*(F.min(F.when(F.col("q") == i, F.col("rank_value"))).alias(c) for i, c in enumerate(shares)))
    return found if groups else found.drop("all")


def medians(df: DataFrame, group: str, value: str, scratch: Scratch) -> DataFrame:
    """(group, median): the mean of the two values in the middle, by counting equal values first, so no group is gathered."""
    freq = scratch.table(df.select(group, F.col(value).alias("value")).filter("value IS NOT NULL").groupBy(group, "value").agg(F.count(F.lit(1)).alias("n")), "median_freq")
    n = freq.groupBy(group).agg(F.sum("n").alias("n"))
    ranks = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), F.floor((F.col("n") + 1 + i) / 2).alias("rank")) for i in (0, 1))))
    return rank_values(freq, [group], n.select(group, ranks.alias("r")).select(group, "r.*"), scratch).groupBy(group).agg((F.sum("rank_value") / 2).alias("median"))


def activity(transactions: DataFrame, owners: DataFrame, days: int, scratch: Scratch) -> DataFrame:
    """Per archetype: accounts, outgoing events per account and 30 days, median and shares of outgoing amounts, and counterparties per account.

    Counterparties are counted after equal pairs became one row; the medians of accounts are over their counts, of
    which few differ.
    """
    out = transactions.join(owners, F.col("src_account_id") == F.col("account_id")).select("archetype", "account_id", "dst_account_id", "amount_minor", "status", "channel", "ts")
    into = transactions.join(owners, F.col("dst_account_id") == F.col("account_id")).select("archetype", "account_id", "src_account_id")
    size = owners.groupBy("archetype").agg(F.count(F.lit(1)).alias("accounts"))
    shape = out.groupBy("archetype").agg(F.count(F.lit(1)).alias("n_out"), share(F.col("status") == "DECLINED").alias("declined_share_out"), share(F.col("channel").isin("APP", "WEB")).alias("digital_share_out"), share(is_night("ts")).alias("night_share_out"))
    pairs_out = out.select("archetype", "account_id", "dst_account_id").distinct().groupBy("archetype", "account_id").agg(F.count(F.lit(1)).alias("n"))
    pairs_in = into.distinct().groupBy("archetype", "account_id").agg(F.count(F.lit(1)).alias("n"))
    n_in = into.groupBy("archetype", "account_id").agg(F.count(F.lit(1)).alias("n"))
    amounts = medians(out, "archetype", "amount_minor", scratch).withColumnRenamed("median", "median_out_amount_minor")
    result = size.join(shape, "archetype", "left").join(amounts, "archetype", "left")
    result = result.join(n_in.groupBy("archetype").agg(F.median("n").alias("median_in_events_per_acct")), "archetype", "left")
    result = result.join(pairs_out.groupBy("archetype").agg(F.median("n").alias("median_distinct_out_cp")), "archetype", "left")
    result = result.join(pairs_in.groupBy("archetype").agg(F.median("n").alias("median_distinct_in_cp"), F.max("n").alias("max_distinct_in_cp")), "archetype", "left")
    return result.withColumn("out_events_per_acct_per_30d", F.coalesce("n_out", F.lit(0)) / days * 30 / F.col("accounts")).drop("n_out")


def timing(transactions: DataFrame, owners: DataFrame) -> DataFrame:
    """Per archetype: mean and sample sd of the hour of outgoing events, and their weekend share."""
    out = transactions.join(owners, F.col("src_account_id") == F.col("account_id")).select("archetype", hour_of("ts").cast("double").alias("hour"), is_weekend("ts").alias("weekend"))
    return out.groupBy("archetype").agg(F.avg("hour").alias("mean_hour"), F.stddev_samp("hour").alias("sd_hour"), share(F.col("weekend")).alias("weekend_share"))


def families(networks: DataFrame) -> DataFrame:
    x = F.col("amount_scale_minor").cast("double")
    return networks.groupBy("family", "is_ood_family").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("n_members").alias("members"), F.sum("n_created_accounts").alias("created_accounts"), F.count("terminal_ts").alias("terminated"), F.count_if("censored").alias("censored"),
        F.count_if("detected").alias("detected"), F.median("amount_scale_minor").alias("median_amount_scale_minor"), (F.stddev_samp(x) / F.avg(x)).alias("amount_scale_cv"), F.min("fan_degree").alias("fan_min"), F.max("fan_degree").alias("fan_max"),
        F.median((F.col("end_ts") - F.col("start_ts")) / HOUR).alias("median_duration_h"),
    )


def label_phases(labels: DataFrame) -> DataFrame:
    return labels.groupBy("phase").agg(F.count(F.lit(1)).alias("rows"), F.median((F.col("valid_to") - F.col("valid_from")) / HOUR).alias("median_interval_h"))


def latency(networks: DataFrame) -> DataFrame:
    """One row: how many days after their end detected networks became known, at 5, 50 and 95 %."""
    days = (F.col("known_at") - F.coalesce("terminal_ts", "end_ts")) / DAY
    d = networks.filter("detected").select(days.alias("days"))
    return d.agg(F.count("days").alias("n"), *(F.percentile("days", q).alias(name) for name, q in (("p5", 0.05), ("p50", 0.5), ("p95", 0.95))))


def shared_keys(logins: DataFrame, key: str) -> DataFrame:
    """One row: how many keys were used by two or more accounts, and the most accounts of one key. Equal pairs are counted once before."""
    per_key = logins.select(key, "account_id").distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.count_if(F.col("n") > 1).alias("used_by_2plus"), F.max("n").alias("most_accounts"))


def shares_of_total(df: DataFrame, key: str) -> DataFrame:
    """(key, n, share): a row per key, of a vocabulary."""
    c = counts(df, key)
    return c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A section with a table, for reports. Where there are more than `limit` rows, the first are shown and the last line says so."""
    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]

    def cell(x) -> str:
        return "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")

    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in rows]
    return "\n".join([*lines, *(["", f"Only the first {limit} rows are shown."] if more else []), ""])


def write_report(path: str | Path, sections: Mapping[str, DataFrame], heading: str) -> None:
    Path(path).write_text(f"# {heading}\n\n" + "\n".join(markdown(df, title) for title, df in sections.items()), encoding="utf-8")
