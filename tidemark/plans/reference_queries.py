"""Queries over the test tables for the operators of the library, and the SQL they are held against."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids
from tidemark.functions.keyed import GAMMA, MULTIPLY_1, MULTIPLY_2, stable_key, with_keyed_uniform
from tidemark.functions.timebase import DAY, TimeBase, hour_of, is_night, is_weekend
from tidemark.operators import checks, describe, metrics, splits
from tidemark.operators.grid import snapshot_features
from tidemark.operators.pit import temporal_order, window_features
from tidemark.operators.settle import settle
from tidemark.operators.sides import SETTLED, last_before, running_total, sides
from tidemark.operators.store import ALL_TABLES, AsOfView, TemporalStore
from tidemark.operators.truth import OracleLabels
from tidemark.plans import tables as T
from tidemark.plans.tables import HORIZON, HORIZON_DAYS, sql
from tidemark.session import Scratch
from tidemark.sources.digest import multiset_digest
from tidemark.sources import files
from tidemark.sources.schema import conform, spec
from tidemark.synth.generate import suppressed

CUTOFF = 45 * DAY
QUERIES, SQL = {}, {}


def query(text: str | None = None):
    """Register the function as a query of its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if text:
            SQL[f.__name__] = text
        return f

    return add


def ledger(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"transactions": T.transactions(spark, d), "logins": T.logins(spark, d), "accounts": T.accounts(spark, d), "labels": T.labels(spark, d), "ground_truth_networks": T.networks(spark, d), "merchants": T.raw(spark, d, "merchants")}


def label_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    """A cutoff per internal account and start of one of its labels, where the account was open by then."""
    starts = T.labels(spark, d).filter("entity_type = 'account'").select(F.col("entity_id").alias("account_id"), F.col("valid_from").alias("t")).distinct()
    open_by = T.accounts(spark, d).filter("account_kind = 'internal'").select("account_id", "opened_at")
    known = starts.join(open_by, "account_id").filter("opened_at <= t").drop("opened_at")
    return known.withColumn("row_id", F.concat_ws("/", "account_id", "t"))


_CUTOFFS = "c AS (SELECT DISTINCT entity_id AS account_id, valid_from AS t, concat(entity_id, '/', valid_from) AS row_id FROM b JOIN a ON a.account_id = entity_id WHERE entity_type = 'account' AND account_kind = 'internal' AND opened_at <= valid_from)"


def store(spark: SparkSession, d: str) -> TemporalStore:
    """The sealed store over the test tables; those that are not there are empty, and account owners are relations."""
    here = ledger(spark, d)
    owned = here["accounts"].filter("owner_person_id IS NOT NULL")
    none = {n: spark.createDataFrame([], spec(n).schema) for n in ALL_TABLES}
    relations = owned.select(F.lit("OWNS_ACCOUNT").alias("relation_type"), F.col("owner_person_id").alias("src_id"), F.col("account_id").alias("dst_id"), F.col("opened_at").alias("valid_from"), F.coalesce("closed_at", F.lit(HORIZON)).cast("bigint").alias("valid_to"))
    return TemporalStore(none | {n: here[n] for n in ("accounts", "logins", "merchants", "transactions")} | {"relations": relations}, HORIZON, here["labels"])


def at_cutoff(spark: SparkSession, d: str) -> AsOfView:
    return store(spark, d).as_of(CUTOFF)


# Scans


@query("SELECT network_id, scenario_id, family, instance_idx, is_ood_family, start_ts, end_ts, terminal_ts, censored, n_members, n_created_accounts, n_rounds, detected, known_at, amount_scale_minor, fan_degree, hops, holding_seconds, retention_permille, forward_permille FROM scenario_networks")
def scan_conform(spark, d):
    return conform("ground_truth_networks", T.networks(spark, d))


_REGISTERED = ("accounts", "labels", "logins", "merchants", "network_members", "transactions")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, CAST(sum({spec(n).primary_key[0] if n != 'labels' else 'entity_id'}) AS DECIMAL(38, 0)) AS keys FROM {n}" for n in _REGISTERED))
def read_tables(spark, d):
    """Every registered table that is there, read and conformed: its rows, and the sum of a key of it."""
    out = None
    for name in _REGISTERED:
        key = spec(name).primary_key[0] if name != "labels" else "entity_id"
        one = files.read_table(spark, name, d).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(key).cast("decimal(20,0)")).cast("decimal(38,0)").alias("keys")).select(F.lit(name).alias("name"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT person_id, archetype, origin FROM person_archetypes")
def conform_renamed(spark, d):
    """A table under its registered name, with the columns out of order and of wider types."""
    return conform("person_truth", T.raw(spark, d, "person_archetypes").select("origin", F.col("person_id").cast("decimal(20,0)").alias("person_id"), "archetype"))


@query("SELECT event_id, ts, amount_minor FROM transactions WHERE ts <= 3888000")
def pruned_scan(spark, d):
    return files.read_columns(spark, "transactions", d, ["event_id", "ts", "amount_minor"]).filter(F.col("ts") <= CUTOFF)


@query("SELECT channel, count(*) AS n FROM logins JOIN accounts USING (account_id) GROUP BY channel")
def view_query(spark, d):
    """SQL over the views of a folder's tables."""
    files.create_views(spark, d)
    return spark.sql("SELECT channel, count(*) AS n FROM logins JOIN accounts USING (account_id) GROUP BY channel")


@query("SELECT merchant_id, merchant_category, region FROM merchants")
def csv_round_trip(spark, d):
    """A table exported as CSV and read again."""
    out = Scratch(spark, "csv").path("out")
    return spark.read.option("header", True).schema(spec("merchants").schema).csv(files.export_csv(spark, "merchants", d, out))


@query("SELECT account_id, account_id >> 48 AS kind, account_id & 281474976710655 AS payload FROM (SELECT DISTINCT account_id FROM accounts)")
def packed_ids(spark, d):
    a = T.accounts(spark, d).select("account_id")
    return a.select("account_id", ids.kind_of(F.col("account_id")).alias("kind"), ids.payload_of(F.col("account_id")).alias("payload"))


@query(sql("l", "SELECT event_id, ts // 86400 AS day, ts % 86400 // 3600 AS hour, ts // 86400 % 7 >= 5 AS weekend, ts % 86400 < 18000 AS night FROM l"))
def clock_parts(spark, d):
    return T.logins(spark, d).select("event_id", F.floor(F.col("ts") / DAY).alias("day"), hour_of("ts").alias("hour"), is_weekend("ts").alias("weekend"), is_night("ts").alias("night"))


@query("SELECT dom, CAST(date_diff('day', DATE '2024-01-01', d) AS BIGINT) AS day FROM (SELECT unnest(range(1, 32)) AS dom), (SELECT unnest(range(DATE '2024-01-01', DATE '2025-01-01', INTERVAL 1 DAY)) AS d) WHERE least(dom, date_part('day', last_day(d))) = date_part('day', d)")
def month_days(spark, d):
    """Which days of a year each day of the month falls on; short months have their last day for it."""
    base = TimeBase(date(2024, 1, 1), 366)
    return spark.createDataFrame([(dom, day) for dom in range(1, 32) for day in base.monthly_days([dom])], "dom bigint, day bigint")


@query()
def table_digest(spark, d):
    return multiset_digest(T.transactions(spark, d))


# As-of views


@query(sql("t", "SELECT event_id, ts, status FROM t WHERE ts <= 3888000"))
def asof_events(spark, d):
    return at_cutoff(spark, d).transactions().select("event_id", "ts", "status")


@query(sql("t", "SELECT event_id, ts FROM t WHERE ts >= 2592000 AND ts <= 3000000"))
def asof_window(spark, d):
    return at_cutoff(spark, d).transactions(30 * DAY, 3_000_000).select("event_id", "ts")


@query(sql("l", "").rstrip() + ", tie AS (SELECT ts AS t, min(event_id) AS e FROM l GROUP BY ts HAVING count(*) > 1 ORDER BY ts DESC LIMIT 1) SELECT event_id, ts FROM l, tie WHERE ts < t OR (ts = t AND event_id <= e)")
def asof_tie_event_id(spark, d):
    """Up to the first of the logins that share the last second that several share; the others of that second are not visible."""
    tie = T.logins(spark, d).groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("e")).filter("n > 1").orderBy(F.desc("ts")).first()
    return store(spark, d).as_of(tie["ts"], tie["e"]).logins().select("event_id", "ts")


@query(sql("a", "SELECT account_id, opened_at FROM a WHERE opened_at <= 3888000"))
def asof_accounts(spark, d):
    return at_cutoff(spark, d).accounts().select("account_id", "opened_at")


@query(sql("a", "SELECT owner_person_id AS src_id, account_id AS dst_id, opened_at AS valid_from, CASE WHEN coalesce(closed_at, 7776000) <= 3888000 THEN closed_at END AS valid_to FROM a WHERE owner_person_id IS NOT NULL AND opened_at <= 3888000"))
def asof_relations(spark, d):
    return at_cutoff(spark, d).relations("OWNS_ACCOUNT").select("src_id", "dst_id", "valid_from", "valid_to")


@query(sql("b", "SELECT entity_type, entity_id, scenario_id, valid_from, CASE WHEN valid_to <= 3888000 THEN valid_to END AS valid_to FROM b WHERE valid_from <= 3888000"))
def relations_masked(spark, d):
    from tidemark.operators.store import masked_relations

    return masked_relations(T.labels(spark, d), CUTOFF).select("entity_type", "entity_id", "scenario_id", "valid_from", "valid_to")


@query(sql("b", "SELECT entity_type, entity_id, scenario_id, valid_from FROM b WHERE known_at <= 3888000 AND NOT is_ood_family"))
def known_labels(spark, d):
    return at_cutoff(spark, d).known_labels().select("entity_type", "entity_id", "scenario_id", "valid_from")


@query(sql("t a s", f"SELECT a.account_id, coalesce(arg_max(s.after, (s.ts, s.event_id, s.is_credit)), any_value(a.initial_balance_minor)) AS balance FROM a LEFT JOIN s ON s.account_id = a.account_id AND s.ts <= {CUTOFF} WHERE a.account_kind = 'internal' AND a.opened_at <= {CUTOFF} GROUP BY a.account_id"))
def asof_balance(spark, d):
    return at_cutoff(spark, d).balances(T.accounts(spark, d).filter("account_kind = 'internal'"))


# Point-in-time features

_HOLD = """k AS (SELECT *, max(CASE WHEN is_credit AND status = 'SETTLED' THEN ts END) OVER (PARTITION BY account_id ORDER BY ts, event_id, is_credit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS credit_ts FROM s
WHERE account_id IN (SELECT account_id FROM a WHERE account_kind = 'internal')),
h AS (SELECT *, least(coalesce(ts - credit_ts, 2592000), 2592000) AS hold, ts // 86400 AS day FROM k)"""


def _features_sql(rows: str, key: str, event_join: str, login_join: str, windows=(7, 30)) -> str:
    """Features of `rows` by joining each row with the events of its windows; {w} in the joins is the window."""
    out, joins = [], []
    for w in windows:
        joins.append(f"""LEFT JOIN (SELECT {key},
 sum(CASE WHEN status = 'SETTLED' AND is_credit THEN amount_minor ELSE 0 END) AS a_in, sum(CASE WHEN status = 'SETTLED' AND NOT is_credit THEN amount_minor ELSE 0 END) AS a_out,
 count(*) FILTER (status = 'SETTLED') AS n, max(amount_minor) FILTER (status = 'SETTLED') AS largest, sum(CASE WHEN status = 'SETTLED' AND NOT is_credit THEN CAST(amount_minor AS DOUBLE) * hold ELSE 0 END) AS held,
 sum(CASE WHEN status = 'SETTLED' AND NOT is_credit AND txn_type = 'ATM_WITHDRAWAL' THEN amount_minor ELSE 0 END) AS atm, count(*) FILTER (status = 'SETTLED' AND ts % 86400 < 18000) AS night,
 count(*) FILTER (status != 'SETTLED' AND NOT is_credit) AS declined, count(DISTINCT counterparty_id) FILTER (status = 'SETTLED' AND is_credit AND txn_type = 'TRANSFER') AS ind,
 count(DISTINCT counterparty_id) FILTER (status = 'SETTLED' AND NOT is_credit AND txn_type = 'TRANSFER') AS outd FROM {event_join.format(w=w)} GROUP BY {key}) e{w} USING ({key})
LEFT JOIN (SELECT {key}, count(DISTINCT device_id) AS devices, count(DISTINCT ip_id) AS ips FROM {login_join.format(w=w)} GROUP BY {key}) g{w} USING ({key})""")
        both = f"(coalesce(e{w}.a_in, 0) + coalesce(e{w}.a_out, 0))"
        out += [
            f"CAST({both} AS BIGINT) AS total_amount_{w}d", f"CAST(coalesce(e{w}.a_in, 0) AS BIGINT) AS total_amount_in_{w}d", f"CAST(coalesce(e{w}.a_out, 0) AS BIGINT) AS total_amount_out_{w}d", f"coalesce(e{w}.n, 0) AS txn_count_{w}d",
            f"coalesce(e{w}.ind, 0) AS in_degree_{w}d", f"coalesce(e{w}.outd, 0) AS out_degree_{w}d", f"CASE WHEN e{w}.a_out > 0 THEN e{w}.held / e{w}.a_out / 3600 ELSE 720.0 END AS avg_holding_time_{w}d", f"coalesce(e{w}.largest, 0) AS max_amount_{w}d",
            f"CASE WHEN {both} > 0 THEN abs(coalesce(e{w}.a_in, 0) - coalesce(e{w}.a_out, 0)) / {both} ELSE 1.0 END AS net_flow_ratio_{w}d", f"CASE WHEN e{w}.a_out > 0 THEN e{w}.atm / e{w}.a_out ELSE 0.0 END AS atm_share_{w}d",
            f"CASE WHEN e{w}.n > 0 THEN e{w}.night / e{w}.n ELSE 0.0 END AS night_share_{w}d", f"coalesce(e{w}.declined, 0) AS declined_count_{w}d", f"coalesce(g{w}.devices, 0) AS distinct_devices_{w}d", f"coalesce(g{w}.ips, 0) AS distinct_ips_{w}d",
        ]
    return f"SELECT {key}, {', '.join(out)} FROM {rows} " + " ".join(joins)


_GRID_ROWS = f"r AS (SELECT account_id, day, opened_at, initial_balance_minor FROM a, (SELECT unnest(range(1, {HORIZON_DAYS + 1})) AS day) WHERE account_kind = 'internal' AND opened_at <= day * 86400 - 1)"
_GRID_SQL = sql("t l a s", "").rstrip() + f", {_HOLD}, {_GRID_ROWS}, f AS (" + _features_sql(
    "r",
    "account_id, day",
    "(SELECT r.account_id, r.day, h.* EXCLUDE (account_id, day) FROM r JOIN h ON h.account_id = r.account_id AND h.day >= r.day - {w} AND h.day < r.day)",
    "(SELECT r.account_id, r.day, l.device_id, l.ip_id FROM r JOIN l ON l.account_id = r.account_id AND l.outcome = 'SUCCESS' AND l.ts // 86400 >= r.day - {w} AND l.ts // 86400 < r.day)",
) + ")"
_BALANCE = "bal AS (SELECT r.account_id, r.day, arg_max(h.after, (h.ts, h.event_id, h.is_credit)) AS after FROM r JOIN h ON h.account_id = r.account_id AND h.day < r.day GROUP BY ALL)"


def grid(spark, d, **more) -> DataFrame:
    return store(spark, d).snapshot_grid(1, HORIZON_DAYS, **more)


def _grid_part(spark, d, names):
    return grid(spark, d, only=names)


_AMOUNTS = [f"{f}_{w}d" for w in (7, 30) for f in ("total_amount", "total_amount_in", "total_amount_out", "txn_count", "max_amount")]
_RATIOS = [f"{f}_{w}d" for w in (7, 30) for f in ("net_flow_ratio", "atm_share", "night_share", "declined_count")]
_DISTINCT = [f"{f}_{w}d" for w in (7, 30) for f in ("in_degree", "out_degree", "distinct_devices", "distinct_ips")]


@query(_GRID_SQL + f" SELECT account_id, day, {', '.join(_AMOUNTS)} FROM f")
def grid_amounts(spark, d):
    return _grid_part(spark, d, _AMOUNTS)


@query(_GRID_SQL + f" SELECT account_id, day, {', '.join(_RATIOS)} FROM f")
def grid_ratios(spark, d):
    return _grid_part(spark, d, _RATIOS)


@query(_GRID_SQL + f" SELECT account_id, day, {', '.join(_DISTINCT)} FROM f")
def rolling_distinct(spark, d):
    return _grid_part(spark, d, _DISTINCT)


@query(_GRID_SQL + " SELECT account_id, day, avg_holding_time_7d, avg_holding_time_30d FROM f")
def grid_holding_time(spark, d):
    return _grid_part(spark, d, ["avg_holding_time_7d", "avg_holding_time_30d"])


@query(_GRID_SQL + f", {_BALANCE} SELECT account_id, day, coalesce(bal.after, initial_balance_minor) AS balance, (day * 86400 - 1 - opened_at) / 86400 AS account_age_days FROM r LEFT JOIN bal USING (account_id, day)")
def balance_locf(spark, d):
    return _grid_part(spark, d, ["balance", "account_age_days"])


_LISTED = (1, 7, 30, 31, 60, 90)
_ALL_ROWS = f"r AS (SELECT account_id, day, opened_at FROM a, (SELECT unnest({list(_LISTED)}) AS day) WHERE opened_at <= day * 86400 - 1)"


@query(
    sql("t a s", "").rstrip()
    + f", {_ALL_ROWS} SELECT r.account_id, r.day, coalesce(count(s.event_id) FILTER (status = 'SETTLED'), 0) AS txn_count_7d, CAST(coalesce(sum(amount_minor) FILTER (status = 'SETTLED' AND is_credit), 0) AS BIGINT) AS total_amount_in_7d, "
    "count(DISTINCT counterparty_id) FILTER (status = 'SETTLED' AND is_credit AND txn_type = 'TRANSFER') AS in_degree_7d FROM r LEFT JOIN s ON s.account_id = r.account_id AND s.ts // 86400 >= r.day - 7 AND s.ts // 86400 < r.day GROUP BY ALL"
)
def grid_all_listed(spark, d):
    """External accounts too, on some days only."""
    return grid(spark, d, days=_LISTED, internal_only=False, only=["txn_count_7d", "total_amount_in_7d", "in_degree_7d"])


@query(sql("t a s", "").rstrip() + f", {_HOLD} SELECT account_id, event_id, is_credit, credit_ts FROM h")
def holding_time(spark, d):
    own = sides(T.transactions(spark, d)).join(T.accounts(spark, d).filter("account_kind = 'internal'").select("account_id"), "account_id", "left_semi")
    return last_before(own, F.when((F.col("status") == SETTLED) & F.col("is_credit"), F.col("ts")), "credit_ts").select("account_id", "event_id", "is_credit", "credit_ts")


@query(
    sql("t l a b s", "").rstrip()
    + f", {_CUTOFFS}, {_HOLD} "
    + _features_sql(
        "c",
        "row_id",
        "(SELECT c.row_id, h.* FROM c JOIN h ON h.account_id = c.account_id AND h.ts > c.t - {w} * 86400 AND h.ts <= c.t)",
        "(SELECT c.row_id, l.device_id, l.ip_id FROM c JOIN l ON l.account_id = c.account_id AND l.outcome = 'SUCCESS' AND l.ts > c.t - {w} * 86400 AND l.ts <= c.t)",
    )
)
def pit_range_join(spark, d):
    cutoffs = Scratch(spark, "pit").table(label_cutoffs(spark, d), "cutoffs")
    found = store(spark, d).point_in_time(cutoffs)
    return found.drop("balance", "account_age_days")


_WEEKLY = "c AS (SELECT account_id, w * 604800 + 302400 AS t, concat(account_id, '/', w) AS row_id FROM a, (SELECT unnest(range(13)) AS w) WHERE account_kind = 'internal' AND opened_at <= w * 604800 + 302400 AND w * 604800 + 302400 < 7776000)"


@query(
    sql("t l a s", "").rstrip()
    + f", {_WEEKLY}, {_HOLD} "
    + _features_sql(
        "c",
        "row_id",
        "(SELECT c.row_id, h.* FROM c JOIN h ON h.account_id = c.account_id AND h.ts > c.t - {w} * 86400 AND h.ts <= c.t)",
        "(SELECT c.row_id, l.device_id, l.ip_id FROM c JOIN l ON l.account_id = c.account_id AND l.outcome = 'SUCCESS' AND l.ts > c.t - {w} * 86400 AND l.ts <= c.t)",
    )
)
def pit_every_account(spark, d):
    """A cutoff in each week of every internal account."""
    a = T.accounts(spark, d).filter("account_kind = 'internal'").withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(12))))
    a = a.withColumn("t", (F.col("w") * 7 * DAY + 302_400).cast("bigint")).filter(f"opened_at <= t AND t < {HORIZON}")
    cutoffs = Scratch(spark, "pit").table(a.select("account_id", "t", F.concat_ws("/", "account_id", "w").alias("row_id")), "cutoffs")
    return window_features(cutoffs, T.transactions(spark, d), T.logins(spark, d))


@query(sql("t a b s", "").rstrip() + f", {_CUTOFFS} SELECT c.row_id, coalesce(arg_max(s.after, (s.ts, s.event_id, s.is_credit)), any_value(initial_balance_minor)) AS balance, any_value((c.t - opened_at) / 86400) AS account_age_days FROM c JOIN a USING (account_id) LEFT JOIN s ON s.account_id = c.account_id AND s.ts <= c.t GROUP BY c.row_id")
def pit_balance(spark, d):
    found = store(spark, d).point_in_time(Scratch(spark, "pit").table(label_cutoffs(spark, d), "cutoffs"))
    return found.select("row_id", "balance", "account_age_days")


@query(
    sql("t a b s", "").rstrip()
    + f""", {_CUTOFFS}, e AS (SELECT c.row_id, s.ts, s.event_id, s.is_credit FROM c JOIN s ON s.account_id = c.account_id AND s.status = 'SETTLED' AND s.ts > c.t - 2592000 AND s.ts <= c.t),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY row_id ORDER BY ts, event_id, is_credit) AS gap, min(CASE WHEN is_credit THEN ts END) OVER (PARTITION BY row_id) AS first_credit FROM e),
x AS (SELECT row_id, count(*) AS n, avg(gap) AS mu, stddev_pop(gap) AS sd, median(gap) AS med, min(CASE WHEN NOT is_credit AND ts > first_credit THEN ts END) - min(first_credit) AS turn FROM g GROUP BY row_id)
SELECT row_id, CASE WHEN n >= 3 AND sd + mu > 0 THEN (sd - mu) / (sd + mu) ELSE 0.0 END AS burstiness, CASE WHEN n >= 2 THEN med / 3600 ELSE 720.0 END AS median_gap_h, coalesce(turn / 3600, 720.0) AS credit_to_debit_h FROM c LEFT JOIN x USING (row_id)"""
)
def temporal_order_features(spark, d):
    return temporal_order(Scratch(spark, "order").table(label_cutoffs(spark, d), "cutoffs"), T.transactions(spark, d), 30)


_NBR = ("txn_count_30d", "in_degree_30d", "out_degree_30d", "account_age_days")


@query(
    _GRID_SQL
    + f""", {T.SQL["b"]}, q AS (SELECT DISTINCT entity_id AS account_id, valid_from // 86400 AS day FROM b JOIN a ON a.account_id = entity_id WHERE entity_type = 'account' AND account_kind = 'internal' AND valid_from // 86400 >= 1 AND opened_at <= (valid_from // 86400) * 86400 - 1),
n AS (SELECT DISTINCT q.account_id, q.day, h.counterparty_id FROM q JOIN h ON h.account_id = q.account_id AND h.status = 'SETTLED' AND h.txn_type = 'TRANSFER' AND h.day >= q.day - 30 AND h.day < q.day),
y AS (SELECT n.account_id, n.day, {", ".join(f"avg(z.{f}) AS {f}" for f in _NBR)} FROM n JOIN (SELECT f.*, (r.day * 86400 - 1 - r.opened_at) / 86400 AS account_age_days FROM f JOIN r USING (account_id, day)) z ON z.account_id = n.counterparty_id AND z.day = n.day GROUP BY ALL)
SELECT q.account_id, q.day, {", ".join(f"coalesce({f}, 0.0) AS nbr_mean_{f}" for f in _NBR)} FROM q LEFT JOIN y USING (account_id, day)"""
)
def neighbour_context(spark, d):
    days = label_cutoffs(spark, d).select("account_id", F.floor(F.col("t") / DAY).alias("day")).distinct().filter("day >= 1")
    a = T.accounts(spark, d)
    points = days.withColumn("t", F.col("day") * DAY - 1).join(a.select("account_id", "opened_at"), "account_id").filter("opened_at <= t").drop("opened_at").withColumn("row_id", F.concat_ws("/", "account_id", "day"))
    points = Scratch(spark, "context").table(points, "points")
    means = store(spark, d).context(points, grid(spark, d, only=_NBR), _NBR)
    return points.join(means, "row_id").select("account_id", "day", *(f"nbr_mean_{f}" for f in _NBR))


@query(
    sql("t b s", "")
    + f" SELECT s.account_id, count(DISTINCT counterparty_id) AS flagged FROM s WHERE ts > {CUTOFF} - 2592000 AND ts <= {CUTOFF} AND counterparty_id IN (SELECT entity_id FROM b WHERE entity_type = 'account' AND risk_label = 1 AND known_at <= {CUTOFF} AND NOT is_ood_family) GROUP BY s.account_id"
)
def flagged_counterparties(spark, d):
    return at_cutoff(spark, d).flagged_counterparties(30 * DAY).groupBy("account_id").agg(F.count(F.lit(1)).alias("flagged"))


# Targets and splits

PLAN = splits.SplitPlan(60 * DAY, 75 * DAY, HORIZON, 7 * DAY)
_POINTS = "r AS (SELECT account_id, day, day * 86400 - 1 AS t FROM a, (SELECT unnest(range(1, 91)) AS day) WHERE account_kind = 'internal' AND opened_at <= day * 86400 - 1)"


def oracle(spark, d) -> OracleLabels:
    """High-risk events are transactions of an account in a MOVEMENT or EXIT interval of its own."""
    lab = T.labels(spark, d)
    hot = lab.filter("entity_type = 'account' AND phase IN ('MOVEMENT', 'EXIT')").select(F.col("entity_id").alias("account_id"), "valid_from", "valid_to", "known_at", "is_ood_family")
    out = T.transactions(spark, d).select(F.col("src_account_id").alias("account_id"), "ts")
    events = out.join(hot, "account_id").filter("ts >= valid_from AND ts < valid_to").select("account_id", "ts", "known_at", "is_ood_family")
    return OracleLabels(lab, events, T.members(spark, d), T.networks(spark, d))


def all_points(spark, d) -> DataFrame:
    return splits.points(T.accounts(spark, d), range(1, HORIZON_DAYS + 1))


@query(sql("a b", "").rstrip() + f", {_POINTS} SELECT account_id, t, day, EXISTS (SELECT 1 FROM b WHERE entity_type = 'account' AND entity_id = r.account_id AND valid_from <= t AND t < valid_to) AS y FROM r")
def target_active(spark, d):
    return oracle(spark, d).targets("active_phase", all_points(spark, d)).df


_HIGH = "hr AS (SELECT src_account_id AS account_id, ts, b.known_at, b.is_ood_family FROM t JOIN b ON entity_type = 'account' AND entity_id = src_account_id AND phase IN ('MOVEMENT', 'EXIT') AND ts >= valid_from AND ts < valid_to)"


@query(sql("t a b", "").rstrip() + f", {_POINTS}, {_HIGH} SELECT account_id, t, day, EXISTS (SELECT 1 FROM hr WHERE hr.account_id = r.account_id AND hr.ts > t AND hr.ts <= t + 604800) AS y FROM r")
def target_horizon(spark, d):
    return oracle(spark, d).targets("high_risk_within", all_points(spark, d), 7 * DAY).df


@query(sql("a b", "").rstrip() + f", {_POINTS} SELECT account_id, t, day, EXISTS (SELECT 1 FROM b WHERE entity_type = 'account' AND entity_id = r.account_id AND valid_from <= t AND t < valid_to AND known_at <= 5184000 AND NOT is_ood_family) AS y FROM r")
def target_known(spark, d):
    return oracle(spark, d).training_targets("active_phase", all_points(spark, d), PLAN.train_end).df


def split_index(spark, d) -> splits.SplitIndex:
    a = T.accounts(spark, d)
    ood = oracle(spark, d).ood_entities().filter("entity_type = 'account'").select(F.col("entity_id").alias("account_id"))
    ref = with_keyed_uniform(splits.normal_accounts(a), stable_key("reference"), F.col("account_id")).filter("u < 0.1").select("account_id")
    return splits.example_index(a, ood, ref, PLAN, 7 * DAY, 14 * DAY)


def _mask(x: str) -> str:
    return f"(({x}) & 18446744073709551615::UHUGEINT)"


def _mix(x: str) -> str:
    """splitmix64 of an UHUGEINT below 2^64, as nested SQL."""
    z = _mask(f"{x} + {GAMMA}::UHUGEINT")
    z = _mask(f"xor({z}, {z} >> 30) * {MULTIPLY_1}::UHUGEINT")
    z = _mask(f"xor({z}, {z} >> 27) * {MULTIPLY_2}::UHUGEINT")
    return f"xor({z}, {z} >> 31)"


def _uniform_steps(source: str, id_column: str, key: int | str) -> str:
    """Expressions u1 … u9 that end with (id, u); written as steps, since nested they would double at each xor."""
    steps, last = [f"u0 AS (SELECT *, xor({id_column}::UHUGEINT, {key}::UHUGEINT) AS z FROM {source})"], "u0"
    n = 1
    for _ in range(2):
        for expression in (_mask(f"z + {GAMMA}::UHUGEINT"), _mask(f"xor(z, z >> 30) * {MULTIPLY_1}::UHUGEINT"), _mask(f"xor(z, z >> 27) * {MULTIPLY_2}::UHUGEINT"), "xor(z, z >> 31)"):
            steps.append(f"u{n} AS (SELECT * REPLACE ({expression} AS z) FROM {last})")
            last, n = f"u{n}", n + 1
    steps.append(f"uu AS (SELECT * EXCLUDE (z), ((z >> 11)::DOUBLE + 0.5) / 9007199254740992.0 AS u FROM {last})")
    return ", ".join(steps)


_NORMAL = "na AS (SELECT * FROM a WHERE account_id >> 48 = 1)"
_UNIFORM = _uniform_steps("na", "account_id", stable_key("reference"))
_SPLIT = sql("a b m", "").rstrip() + f""", {_NORMAL}, {_UNIFORM}, held AS (SELECT DISTINCT entity_id AS account_id FROM m WHERE entity_type = 'account' AND network_id IN (SELECT network_id FROM scenario_networks WHERE is_ood_family) UNION SELECT account_id FROM uu WHERE u < 0.1), {_POINTS},
bl AS (SELECT *, CASE WHEN t <= 60 * 86400 - 604800 THEN 'TRAIN' WHEN t >= 60 * 86400 AND t <= 75 * 86400 - 604800 THEN 'VAL' WHEN t >= 75 * 86400 AND t <= 7776000 - 1 - 604800 THEN 'TEST' END AS block FROM r)"""


@query(_SPLIT + " SELECT account_id, day, t, block FROM bl WHERE block IS NOT NULL AND account_id NOT IN (FROM held)")
def split_points(spark, d):
    i = split_index(spark, d)
    parts = [df.select("account_id", "day", "t", F.lit(name).alias("block")) for name, df in (("TRAIN", i.train_all), ("VAL", i.val), ("TEST", i.test))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_SPLIT + " SELECT account_id, day, t, block FROM bl WHERE block IS NOT NULL AND account_id IN (FROM held)")
def split_ood(spark, d):
    return split_index(spark, d).ood.select("account_id", "day", "t", "block")


@query(_SPLIT + " SELECT account_id, t, 5184000 - (t + 604800) >= 14 * 86400 AS is_mature FROM bl WHERE block = 'TRAIN' AND account_id NOT IN (FROM held)")
def maturity(spark, d):
    return split_index(spark, d).train_all.select("account_id", "t", "is_mature")


@query(sql("a", "").rstrip() + f", {_NORMAL}, {_UNIFORM} SELECT account_id, u FROM uu")
def keyed_hash(spark, d):
    return with_keyed_uniform(splits.normal_accounts(T.accounts(spark, d)), stable_key("reference"), F.col("account_id")).select("account_id", "u")


def stratified(spark, d) -> DataFrame:
    everyone = splits.normal_accounts(T.owners(spark, d))
    return splits.reference_pool(everyone, everyone, 0.1, "reference", "stratified_archetype")


_STRATIFIED = sql("a o", "").rstrip() + f""", na AS (SELECT * FROM o WHERE account_id >> 48 = 1), {_UNIFORM},
goal AS (SELECT archetype, CAST(round_even(count(*) * 0.1, 0) AS BIGINT) AS goal FROM na GROUP BY archetype), pool AS (SELECT account_id, archetype FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY u, account_id) AS no FROM uu) JOIN goal USING (archetype) WHERE no <= goal)"""


@query(_STRATIFIED + " SELECT account_id FROM pool")
def stratified_pool(spark, d):
    return stratified(spark, d)


@query(_STRATIFIED + ", x AS (SELECT archetype, count(*) AS n_pool FROM pool GROUP BY archetype), y AS (SELECT archetype, count(*) AS n FROM na GROUP BY archetype) SELECT archetype, coalesce(n_pool, 0) AS n_pool, coalesce(n_pool, 0) / (SELECT sum(n_pool) FROM x) AS share_pool, n / (SELECT sum(n) FROM y) AS share_population, 100 * (coalesce(n_pool, 0) / (SELECT sum(n_pool) FROM x) - n / (SELECT sum(n) FROM y)) AS diff_pp FROM y LEFT JOIN x USING (archetype)")
def pool_composition(spark, d):
    return splits.pool_composition(stratified(spark, d), splits.normal_accounts(T.owners(spark, d)))


_CELLS = [f"fan_in/{i}" for i in range(20)]
_KEYED = ", ".join(f"({i}, {k}::UHUGEINT)" for i, k in enumerate(splits.cell_keys(_CELLS, "recruit/1")))


@query(
    sql("a", "").rstrip()
    + f", {_NORMAL}, nc AS (SELECT account_id, c, k FROM na, (VALUES {_KEYED}) v(c, k)), {_uniform_steps('nc', 'account_id', 'k')} "
    "SELECT account_id, CAST(CASE WHEN c = 20 THEN -1 ELSE c END AS INT) AS cell FROM (SELECT account_id, arg_max(c, (-(CASE WHEN c = 20 THEN 20.0 ELSE 1.0 END) / ln(u), -c)) AS c FROM uu GROUP BY account_id)"
)
def rendezvous_partition(spark, d):
    return splits.rendezvous_partition(splits.normal_accounts(T.accounts(spark, d)), _CELLS, 0.5, "recruit/1")


@query(sql("a o", "").rstrip() + f", na AS (SELECT * FROM o WHERE account_id >> 48 = 1), {_UNIFORM} SELECT account_id FROM uu WHERE archetype != 'student' AND u * (SELECT count(*) FROM na WHERE archetype != 'student') < 0.1 * (SELECT count(*) FROM na)")
def none_cell_pool(spark, d):
    """A tenth of everyone, drawn from those that are no students."""
    everyone = splits.normal_accounts(T.owners(spark, d))
    return splits.reference_pool(everyone.filter("archetype != 'student'"), everyone, 0.1, "reference", "none_cell_hash")


# Ledger checks


@query(sql("t a s", f"SELECT account_id, event_id, is_credit, CAST(initial_balance_minor + sum(delta) OVER (PARTITION BY account_id ORDER BY ts, event_id, is_credit) AS BIGINT) AS recomputed FROM s JOIN a USING (account_id)"))
def ledger_running(spark, d):
    led = sides(T.transactions(spark, d)).join(T.accounts(spark, d).select("account_id", "initial_balance_minor"), "account_id")
    return running_total(led, "delta", "total").select("account_id", "event_id", "is_credit", (F.col("initial_balance_minor") + F.col("total")).alias("recomputed"))


_LED = """led AS (SELECT s.*, initial_balance_minor, overdraft_limit_minor, account_kind, lag(after) OVER w AS prev, initial_balance_minor + sum(delta) OVER w AS recomputed FROM s JOIN a USING (account_id) WINDOW w AS (PARTITION BY account_id ORDER BY ts, event_id, is_credit))"""


@query(
    sql("t a s", "").rstrip()
    + f""", {_LED} SELECT problem, event_id, account_id FROM (SELECT 'after is not before and what moved' AS problem, event_id, account_id FROM led WHERE after != before + delta
UNION ALL SELECT 'differs from the recomputed balance', event_id, account_id FROM led WHERE after != recomputed UNION ALL SELECT 'breaks the chain', event_id, account_id FROM led WHERE before != coalesce(prev, initial_balance_minor)
UNION ALL SELECT 'below the overdraft limit', event_id, account_id FROM led WHERE account_kind = 'internal' AND after < -overdraft_limit_minor)"""
)
def balance_chain(spark, d):
    return checks.balances(ledger(spark, d))


@query(
    sql("t a s", "").rstrip()
    + """, led AS (SELECT ts // 86400 AS day, after - coalesce(lag(after) OVER (PARTITION BY account_id ORDER BY ts, event_id, is_credit), initial_balance_minor) AS step FROM s JOIN a USING (account_id)),
g AS (SELECT day, sum(step) AS step FROM led GROUP BY day) SELECT day, CAST(coalesce(sum(step) OVER (ORDER BY day), 0) AS BIGINT) AS drift FROM (SELECT unnest(range(90)) AS day) LEFT JOIN g USING (day)"""
)
def conservation_daily(spark, d):
    return checks.daily_drift(ledger(spark, d), HORIZON_DAYS)


@query(
    sql("t l", "").rstrip()
    + """, g AS (SELECT channel IN ('APP', 'WEB') AS digital, * FROM t) SELECT 'reference on other channel' AS problem, event_id FROM g WHERE NOT digital AND coalesce(login_event_id, device_id, ip_id) IS NOT NULL
UNION ALL SELECT 'digital without reference', event_id FROM g WHERE digital AND (login_event_id IS NULL OR device_id IS NULL OR ip_id IS NULL)
UNION ALL SELECT 'no matching login', g.event_id FROM g LEFT JOIN l ON l.event_id = g.login_event_id WHERE digital AND login_event_id IS NOT NULL AND (l.ts IS NULL OR outcome != 'SUCCESS' OR l.account_id != src_account_id OR l.device_id != g.device_id OR l.ip_id != g.ip_id OR l.channel != g.channel OR l.ts > g.ts OR g.ts - l.ts > 1800)"""
)
def login_window_check(spark, d):
    return checks.login_references(ledger(spark, d), 1_800)


@query(
    sql("t", "")
    + """ SELECT unnest(list_filter([CASE WHEN amount_minor <= 0 THEN 'amount not positive' END, CASE WHEN src_account_id = dst_account_id THEN 'to itself' END,
CASE WHEN (txn_type = 'TRANSFER' AND channel NOT IN ('APP', 'WEB', 'SCHEDULED')) OR (txn_type = 'CARD_PAYMENT' AND channel != 'POS') OR (txn_type = 'ATM_WITHDRAWAL' AND channel != 'ATM') OR (txn_type = 'INBOUND_CREDIT' AND channel != 'INBOUND_EXTERNAL') OR (txn_type = 'OUTBOUND_PAYMENT' AND channel NOT IN ('SCHEDULED', 'APP', 'WEB')) THEN 'channel not allowed' END,
CASE WHEN status NOT IN ('SETTLED', 'DECLINED') THEN 'unknown status' END, CASE WHEN txn_type = 'CARD_PAYMENT' AND merchant_id IS NULL THEN 'CARD_PAYMENT without merchant_id' END, CASE WHEN txn_type = 'ATM_WITHDRAWAL' AND atm_id IS NULL THEN 'ATM_WITHDRAWAL without atm_id' END], lambda x: x IS NOT NULL)) AS problem, event_id FROM t"""
)
def amounts_and_channels(spark, d):
    return checks.amounts_and_channels(ledger(spark, d))


@query(sql("t a", "").rstrip() + ", z AS (SELECT account_id, opened_at + CASE WHEN account_kind = 'internal' THEN 15552000 ELSE 0 END AS opened_at FROM a WHERE region IS NOT NULL OR account_kind = 'external'), e AS (SELECT event_id, ts, src_account_id AS account_id FROM t UNION ALL SELECT event_id, ts, dst_account_id FROM t) SELECT CASE WHEN opened_at IS NULL THEN 'unknown account' ELSE 'before the account was opened' END AS problem, event_id FROM e LEFT JOIN z USING (account_id) WHERE opened_at IS NULL OR ts < opened_at")
def fk_accounts(spark, d):
    """With violations planted: accounts without a region are missing, internal ones opened half a year later."""
    t = ledger(spark, d)
    a = t["accounts"].filter("region IS NOT NULL OR account_kind = 'external'")
    return checks.accounts_open(t | {"accounts": a.withColumn("opened_at", F.col("opened_at") + F.when(F.col("account_kind") == "internal", 180 * DAY).otherwise(0))})


@query(sql("t", "SELECT 'unknown merchant' AS problem, event_id AS id FROM t WHERE channel = 'POS' AND merchant_id NOT IN (SELECT merchant_id FROM merchants WHERE region > 0)"))
def fk_merchants(spark, d):
    """With merchants of one region missing."""
    t = ledger(spark, d)
    return checks.unknown_merchants(t | {"merchants": t["merchants"].filter("region > 0")})


@query(
    sql("t l a", "").rstrip()
    + " SELECT 'no ownership relation' AS problem, account_id AS id FROM a WHERE owner_person_id IS NOT NULL AND region IS NULL UNION ALL SELECT 'unknown device', event_id FROM l WHERE device_id NOT IN (SELECT device_id FROM t WHERE device_id IS NOT NULL)"
    " UNION ALL SELECT 'unknown merchant', event_id FROM t WHERE channel = 'POS' AND merchant_id NOT IN (SELECT merchant_id FROM merchants WHERE region > 0)"
)
def relations_check(spark, d):
    """With violations planted: no relation for accounts without a region, only devices of transactions, merchants of one region missing."""
    t = ledger(spark, d)
    edges = t["accounts"].filter("region IS NOT NULL AND owner_person_id IS NOT NULL").select(F.lit("OWNS_ACCOUNT").alias("relation_type"), F.col("owner_person_id").alias("src_id"), F.col("account_id").alias("dst_id"))
    devices = t["transactions"].filter("device_id IS NOT NULL").select("device_id").distinct()
    return checks.relations(t | {"relations": edges, "devices": devices, "merchants": t["merchants"].filter("region > 0")})


_TERMINAL = "ev AS (SELECT event_id, network_id, phase, ts, phase = 'EXIT' OR event_id % 5 = 0 AS is_high_risk, phase = 'EXIT' AND event_id % 3 = 0 AS is_terminal FROM (SELECT DISTINCT t.event_id, t.ts, b.network_id, b.phase FROM t JOIN b ON entity_type = 'account' AND entity_id = src_account_id AND t.ts >= valid_from AND t.ts < valid_to))"


@query(
    sql("t b", "").rstrip()
    + f""", {_TERMINAL} SELECT 'labelled event is missing' AS problem, event_id AS id FROM ev WHERE event_id % 7 = 0 UNION ALL SELECT 'several terminal events', network_id FROM ev WHERE is_terminal GROUP BY network_id HAVING count(*) > 1
UNION ALL SELECT 'terminal_ts differs', network_id FROM scenario_networks n LEFT JOIN (SELECT network_id, ts FROM ev WHERE is_terminal AND event_id % 7 != 0) e USING (network_id) WHERE terminal_ts IS DISTINCT FROM ts
UNION ALL SELECT 'high risk differs within a phase', NULL FROM ev GROUP BY phase HAVING count(DISTINCT is_high_risk) > 1"""
)
def event_labels_check(spark, d):
    """Events labelled by the intervals of their source account, with violations planted: every seventh event is missing,
    a third of the exits are terminal, and risk differs within phases."""
    t = ledger(spark, d)
    b = t["labels"].filter("entity_type = 'account'").select("entity_id", "valid_from", "valid_to", "network_id", "phase")
    of = t["transactions"].select("event_id", "ts", "src_account_id").join(b, F.col("entity_id") == F.col("src_account_id")).filter("ts >= valid_from AND ts < valid_to").select("event_id", "network_id", "phase").distinct()
    labelled = of.select(F.lit("transactions").alias("event_table"), "event_id", "network_id", "phase", (F.col("phase").eqNullSafe("EXIT") | (F.col("event_id") % 5 == 0)).alias("is_high_risk"), ((F.col("phase") == "EXIT") & (F.col("event_id") % 3 == 0)).alias("is_terminal"))
    return checks.event_labels(t | {"event_labels": labelled, "transactions": t["transactions"].filter("event_id % 7 != 0")})


@query(sql("t", "").rstrip() + ", e AS (SELECT event_id, ts, 1 AS o FROM t UNION ALL SELECT event_id, ts, 2 FROM logins) SELECT 'ts outside of the horizon' AS problem, event_id FROM e WHERE ts < 0 OR ts >= 3888000 UNION ALL SELECT CASE WHEN count(DISTINCT o) > 1 THEN 'event id in both tables' ELSE 'event id used twice' END, event_id FROM e GROUP BY event_id HAVING count(*) > 1")
def timestamp_check(spark, d):
    """With violations: the horizon ends early, and logins come with their copies."""
    return checks.timestamps(ledger(spark, d) | {"logins": T.raw(spark, d, "logins")}, CUTOFF)


@query(
    sql("b", "").rstrip()
    + """, ov AS (SELECT *, lag(valid_to) OVER (PARTITION BY entity_id ORDER BY valid_from, valid_to, scenario_id) AS before FROM b WHERE entity_type = 'account')
SELECT 'empty interval' AS problem, entity_id AS id FROM b WHERE valid_to <= valid_from UNION ALL SELECT 'several networks', entity_id FROM b WHERE entity_type = 'account' GROUP BY entity_id HAVING count(DISTINCT network_id) > 1
UNION ALL SELECT 'overlap', entity_id FROM ov WHERE valid_from < before UNION ALL SELECT 'known_at differs', network_id FROM b GROUP BY network_id HAVING count(DISTINCT known_at) + max(CASE WHEN known_at IS NULL THEN 1 ELSE 0 END) > 1
UNION ALL SELECT 'detected without known_at or the reverse', network_id FROM scenario_networks WHERE detected != (known_at IS NOT NULL)"""
)
def label_intervals(spark, d):
    return checks.labels(ledger(spark, d))


_OF = "ev AS (SELECT DISTINCT t.event_id, b.network_id, b.phase FROM t JOIN b ON entity_type = 'account' AND entity_id = src_account_id AND ts >= valid_from AND ts < valid_to)"


@query(sql("t b", "").rstrip() + f", {_OF}, z AS (SELECT ev.network_id, ev.phase, t.* FROM ev JOIN t USING (event_id) WHERE status = 'SETTLED'), i AS (SELECT network_id, dst_account_id AS src_account_id, min(ts) AS first_in FROM z GROUP BY ALL) SELECT 'outflow without earlier inflow' AS problem, event_id FROM z LEFT JOIN i USING (network_id, src_account_id) WHERE phase IN ('MOVEMENT', 'EXIT') AND (first_in IS NULL OR first_in >= ts)")
def causality(spark, d):
    """Events are labelled by the intervals of their source account."""
    t, b = T.transactions(spark, d), T.labels(spark, d).filter("entity_type = 'account'").select("entity_id", "valid_from", "valid_to", "network_id", "phase")
    of = t.select("event_id", "ts", "src_account_id").join(b, F.col("entity_id") == F.col("src_account_id")).filter("ts >= valid_from AND ts < valid_to").select(F.lit("transactions").alias("event_table"), "event_id", "network_id", "phase").distinct()
    return checks.causality({"transactions": t, "event_labels": of})


@query("SELECT 'amounts vary too little' AS problem, family, stddev_samp(amount_scale_minor::DOUBLE) / avg(amount_scale_minor::DOUBLE) AS cv FROM scenario_networks GROUP BY family HAVING count(*) >= 2 AND NOT stddev_samp(amount_scale_minor::DOUBLE) / avg(amount_scale_minor::DOUBLE) >= 0.5")
def diversity_cv(spark, d):
    return checks.diversity(ledger(spark, d), 0.5, 2)


@query(
    sql("t b", "").rstrip()
    + f", {_uniform_steps('t', 'event_id', stable_key('suppress'))}, w AS (SELECT entity_id, valid_from, valid_to FROM b WHERE entity_type = 'account') SELECT event_id FROM uu WHERE NOT (u >= 0.5 AND EXISTS (SELECT 1 FROM w WHERE (entity_id = src_account_id OR entity_id = dst_account_id) AND ts >= valid_from AND ts < valid_to))"
)
def suppression(spark, d):
    """Events in a label interval of an account of theirs are kept only with a keyed number below one half."""
    windows = T.labels(spark, d).filter("entity_type = 'account'").select(F.col("entity_id").alias("account_id"), F.col("valid_from").alias("start"), F.col("valid_to").alias("end"), F.lit(0.5).alias("retention"))
    return suppressed(T.transactions(spark, d), windows, "suppress").select("event_id")


@query()
def settlement(spark, d):
    """The transactions settled anew from the initial balances, none depending on another."""
    plan = T.transactions(spark, d).select("event_id", "ts", "src_account_id", "dst_account_id", "amount_minor", F.lit(None).cast("bigint").alias("depends_on"))
    return settle(plan, T.accounts(spark, d), Scratch(spark, "settle"))


@query(sql("t", "SELECT 'events' AS what, count(*) AS n FROM t UNION ALL SELECT unnest(['settled without funds', 'declined with funds', 'balances differ']), 0"))
def settlement_checks(spark, d):
    """(what, n): that the settlement is the right one. Balances are recomputed from its statuses; a status is right if it
    is what the balance before it allows, and as each follows from earlier ones, all are right if none is wrong."""
    scratch = Scratch(spark, "settle")
    done = scratch.table(settlement(spark, d), "done")
    shape = done.select("*", F.col("src_before").alias("src_balance_before_minor"), F.col("src_after").alias("src_balance_after_minor"), F.col("dst_before").alias("dst_balance_before_minor"), F.col("dst_after").alias("dst_balance_after_minor"))
    led = running_total(sides(shape), "delta", "total").join(T.accounts(spark, d).select("account_id", "initial_balance_minor", "overdraft_limit_minor"), "account_id")
    after = F.col("initial_balance_minor") + F.col("total")
    fits = F.col("overdraft_limit_minor").isNull() | (after - F.col("delta") - F.col("amount_minor") >= -F.col("overdraft_limit_minor"))
    settled, debit = F.col("status") == SETTLED, ~F.col("is_credit")
    row = led.agg(
        F.count_if(debit).alias("events"), F.count_if(debit & settled & ~fits).alias("settled without funds"), F.count_if(debit & ~settled & fits).alias("declined with funds"),
        F.count_if((after != F.col("after")) | (after - F.col("delta") != F.col("before"))).alias("balances differ"),
    )
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.col(f"`{c}`").alias("n")) for c in row.columns))).alias("x")).select("x.*")


# Descriptive tables


@query(
    sql("t a o", "").rstrip()
    + """, x AS (SELECT archetype, o.account_id, dst_account_id, amount_minor, status, channel, ts FROM t JOIN o ON o.account_id = src_account_id), i AS (SELECT archetype, o.account_id, src_account_id FROM t JOIN o ON o.account_id = dst_account_id),
g AS (SELECT archetype, count(*) AS n_out, median(amount_minor) AS median_out_amount_minor, avg((status = 'DECLINED')::INT) AS declined_share_out, avg((channel IN ('APP', 'WEB'))::INT) AS digital_share_out, avg((ts % 86400 < 18000)::INT) AS night_share_out FROM x GROUP BY archetype)
SELECT archetype, accounts, median_out_amount_minor, declined_share_out, digital_share_out, night_share_out, median_in_events_per_acct, median_distinct_out_cp, median_distinct_in_cp, max_distinct_in_cp, coalesce(n_out, 0) / 90 * 30 / accounts AS out_events_per_acct_per_30d
FROM (SELECT archetype, count(*) AS accounts FROM o GROUP BY archetype) LEFT JOIN g USING (archetype) LEFT JOIN (SELECT archetype, median(n) AS median_in_events_per_acct FROM (SELECT archetype, account_id, count(*) AS n FROM i GROUP BY ALL) GROUP BY archetype) USING (archetype)
LEFT JOIN (SELECT archetype, median(n) AS median_distinct_out_cp FROM (SELECT archetype, account_id, count(DISTINCT dst_account_id) AS n FROM x GROUP BY ALL) GROUP BY archetype) USING (archetype)
LEFT JOIN (SELECT archetype, median(n) AS median_distinct_in_cp, max(n) AS max_distinct_in_cp FROM (SELECT archetype, account_id, count(DISTINCT src_account_id) AS n FROM i GROUP BY ALL) GROUP BY archetype) USING (archetype)"""
)
def sanity_activity(spark, d):
    return describe.activity(T.transactions(spark, d), T.owners(spark, d), HORIZON_DAYS, Scratch(spark, "activity"))


@query(sql("t", "").rstrip() + ", n AS (SELECT row_number() OVER (ORDER BY amount_minor) - 1 AS no, amount_minor FROM t), c AS (SELECT count(*) AS n FROM t) SELECT " + ", ".join(f"(SELECT amount_minor FROM n WHERE no = round_even((SELECT n - 1 FROM c) * {q}, 0)) AS {name}" for name, q in (("q10", 0.1), ("q50", 0.5), ("q90", 0.9), ("q99", 0.99))))
def sanity_quantiles(spark, d):
    return describe.nearest_quantiles(T.transactions(spark, d), [], "amount_minor", {"q10": 0.1, "q50": 0.5, "q90": 0.9, "q99": 0.99}, Scratch(spark, "quantiles"))


@query(sql("t", "SELECT txn_type, channel, count(*) AS n FROM t GROUP BY ALL"))
def sanity_counts(spark, d):
    return describe.counts(T.transactions(spark, d), "txn_type", "channel")


@query(sql("t a o", "SELECT archetype, avg(ts % 86400 // 3600) AS mean_hour, stddev_samp(ts % 86400 // 3600) AS sd_hour, avg((ts // 86400 % 7 >= 5)::INT) AS weekend_share FROM t JOIN o ON o.account_id = src_account_id GROUP BY archetype"))
def timing_by_group(spark, d):
    return describe.timing(T.transactions(spark, d), T.owners(spark, d))


@query(
    "SELECT family, is_ood_family, count(*) AS instances, CAST(sum(n_members) AS BIGINT) AS members, CAST(sum(n_created_accounts) AS BIGINT) AS created_accounts, count(terminal_ts) AS terminated, count(*) FILTER (censored) AS censored, count(*) FILTER (detected) AS detected, median(amount_scale_minor) AS median_amount_scale_minor, "
    "stddev_samp(amount_scale_minor) / avg(amount_scale_minor) AS amount_scale_cv, min(fan_degree) AS fan_min, max(fan_degree) AS fan_max, median((end_ts - start_ts) / 3600) AS median_duration_h FROM scenario_networks GROUP BY ALL"
)
def family_diversity(spark, d):
    return describe.families(T.networks(spark, d))


@query(sql("b", "SELECT phase, count(*) AS rows, median((valid_to - valid_from) / 3600) AS median_interval_h FROM b GROUP BY phase"))
def label_phases(spark, d):
    return describe.label_phases(T.labels(spark, d))


@query("SELECT count(*) AS n, quantile_cont(x, 0.05) AS p5, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.95) AS p95 FROM (SELECT (known_at - coalesce(terminal_ts, end_ts)) / 86400 AS x FROM scenario_networks WHERE detected AND known_at IS NOT NULL)")
def latency(spark, d):
    return describe.latency(T.networks(spark, d))


@query(sql("l", "SELECT count(*) FILTER (n > 1) AS used_by_2plus, max(n) AS most_accounts FROM (SELECT ip_id, count(DISTINCT account_id) AS n FROM l GROUP BY ip_id)"))
def shared_keys(spark, d):
    return describe.shared_keys(T.logins(spark, d), "ip_id")


@query(sql("b", "SELECT role_label, count(*) AS n, count(*) / (SELECT count(*) FROM b) AS share FROM b GROUP BY role_label"))
def role_shares(spark, d):
    return describe.shares_of_total(T.labels(spark, d), "role_label")


# Metrics


def scored_accounts(spark, d) -> DataFrame:
    """(account_id, y, n, total): whether an internal account is ever labelled risky, and what it sent."""
    risky = T.labels(spark, d).filter("entity_type = 'account' AND risk_label = 1").select(F.col("entity_id").alias("account_id")).distinct().withColumn("y", F.lit(True))
    sent = T.transactions(spark, d).groupBy(F.col("src_account_id").alias("account_id")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_minor").alias("total"))
    a = T.accounts(spark, d).filter("account_kind = 'internal'").select("account_id")
    return a.join(risky, "account_id", "left").join(sent, "account_id", "left").select("account_id", F.coalesce("y", F.lit(False)).alias("y"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


_SCORED = "sc AS (SELECT account_id, account_id IN (SELECT entity_id FROM b WHERE entity_type = 'account' AND risk_label = 1) AS y, coalesce(n, 0) AS n, CAST(coalesce(total, 0) AS BIGINT) AS total FROM a LEFT JOIN (SELECT src_account_id AS account_id, count(*) AS n, sum(amount_minor) AS total FROM t GROUP BY ALL) USING (account_id) WHERE account_kind = 'internal')"


def _ap_sql(source: str) -> str:
    return f"SELECT feature, direction, sum(pos / p * (hits / seen)) AS ap FROM (SELECT *, sum(n) OVER w AS seen, sum(pos) OVER w AS hits, sum(pos) OVER (PARTITION BY feature, direction) AS p FROM (SELECT feature, direction, score, count(*) AS n, count(*) FILTER (y) AS pos FROM {source} GROUP BY ALL) WINDOW w AS (PARTITION BY feature, direction ORDER BY score DESC)) GROUP BY feature, direction"


_LONG = "lo AS (SELECT y, 'n' AS feature, d AS direction, n * d AS score FROM sc, (VALUES (1), (-1)) v(d) UNION ALL SELECT y, 'total', d, total * d FROM sc, (VALUES (1), (-1)) v(d))"


@query(sql("t a b", "").rstrip() + f", {_SCORED}, {_LONG}, ap AS ({_ap_sql('lo')}) SELECT ap, (SELECT count(*) FROM sc WHERE y) AS positives FROM ap WHERE feature = 'total' AND direction = 1")
def average_precision(spark, d):
    return metrics.average_precision_by(scored_accounts(spark, d), [], score="total")


@query(sql("t a b", "").rstrip() + f", {_SCORED}, {_LONG}, ap AS ({_ap_sql('lo')}) SELECT feature, max(ap) AS ap, CAST(arg_max(direction, (ap, direction)) AS INT) AS direction FROM ap GROUP BY feature")
def single_feature_ap(spark, d):
    return metrics.single_feature_ap(scored_accounts(spark, d), ["n", "total"])


@query(sql("t a b", "").rstrip() + f", {_SCORED} SELECT account_id, y, total FROM sc ORDER BY total DESC, account_id LIMIT 100")
def top_scores(spark, d):
    """A top-k report: the hundred highest totals."""
    return metrics.top_k(scored_accounts(spark, d).select("account_id", "y", "total"), 100, "total", ["account_id"])


@query(
    sql("a b", "").rstrip()
    + f", {_POINTS}, y AS (SELECT account_id, t, day, EXISTS (SELECT 1 FROM b WHERE entity_type = 'account' AND entity_id = r.account_id AND valid_from <= t AND t < valid_to) AS y FROM r), k AS (SELECT y FROM y ORDER BY day * 7 % 31 DESC, account_id, t LIMIT 500) SELECT (SELECT count(*) FROM k WHERE y) / (SELECT count(*) FROM y WHERE y) AS recall"
)
def recall_at_k(spark, d):
    """Share of the positives among the 500 highest of a made score."""
    y = oracle(spark, d).targets("active_phase", all_points(spark, d))
    scores = all_points(spark, d).select("account_id", "t", (F.col("day") * 7 % 31).cast("double").alias("score"))
    return spark.createDataFrame([(metrics.recall_at_k(y, scores, 500),)], "recall double")


_RESULTS = [(0.1, 0.4, 0.2, 0.01), (0.25, 0.55, 0.1, 0.02), (0.31, 0.5, 0.3, 0.01), (0.2, 0.02, 0.59, 0.01), (0.3, 0.6, 0.1, 0.02)]
_HOLDS = {"no feature alone": "best_ap <= 0.30", "not too easy": "greatest(ap_lr, ap_tree) <= 0.60", "better than chance": "greatest(ap_lr, ap_tree) >= 3 * prevalence"}


@query(
    f"WITH r AS (SELECT * FROM (VALUES {', '.join(map(str, _RESULTS))}) v(best_ap, ap_lr, ap_tree, prevalence)), m AS (SELECT avg(best_ap) AS best_ap, avg(ap_lr) AS ap_lr, avg(ap_tree) AS ap_tree, avg(prevalence) AS prevalence FROM r), x AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS criterion, (SELECT {test} FROM m) AND (SELECT count(*) FROM r WHERE {test}) >= (SELECT count(*) - 1 FROM r) AS holds" for name, test in _HOLDS.items())
    + ") SELECT criterion, holds FROM x UNION ALL SELECT 'passed', bool_and(holds) FROM x"
)
def rule(spark, d):
    """The rule over made results of five seeds."""
    found = metrics.gate_rule([dict(zip(("best_ap", "ap_lr", "ap_tree", "prevalence"), r, strict=True)) for r in _RESULTS])
    return spark.createDataFrame(list(found.items()), "criterion string, holds boolean")


@query(sql("t a b", "").rstrip() + f", {_SCORED}, f AS (SELECT avg(ln(1 + n)) AS m, stddev_pop(ln(1 + n)) AS s FROM sc) SELECT account_id, round((ln(1 + n) - m) / s, 6) AS n FROM sc, f")
def standardised(spark, d):
    """Values brought to mean 0 and deviation 1 by what was fitted."""
    rows = Scratch(spark, "scaling").table(scored_accounts(spark, d), "scored")
    return metrics.scaled(rows, metrics.fit_scaling(rows, ["n"])).select("account_id", F.round("n", 6).alias("n"))


@query(sql("t a b", "").rstrip() + f", {_SCORED} SELECT avg(ln(1 + n)) AS mean_n, stddev_pop(ln(1 + n)) AS sd_n, avg(ln(1 + total)) AS mean_total, stddev_pop(ln(1 + total)) AS sd_total FROM sc")
def standardise_stats(spark, d):
    s = metrics.fit_scaling(Scratch(spark, "scaling").table(scored_accounts(spark, d), "scored"), ["n", "total"])
    return spark.createDataFrame([(s["n"][1], s["n"][2], s["total"][1], s["total"][2])], "mean_n double, sd_n double, mean_total double, sd_total double")


def _probe(spark, d, fit):
    rows = Scratch(spark, "probe").table(scored_accounts(spark, d), "scored")
    rows = metrics.scaled(rows, metrics.fit_scaling(rows, ["n", "total"]))
    scored = metrics.probe_scores(fit(rows, ["n", "total"]), rows, ["n", "total"])
    return metrics.average_precision_by(scored, [])


@query()
def lr_probe(spark, d):
    return _probe(spark, d, metrics.logistic_probe)


@query()
def tree_probe(spark, d):
    return _probe(spark, d, metrics.tree_probe)


@query()
def cluster_bootstrap(spark, d):
    """Confidence interval of the difference between two scores' AP, on a sample of the size that the operator takes."""
    rows = metrics.exact_sample(scored_accounts(spark, d), 200_000, "bootstrap", "account_id")
    found = metrics.cluster_bootstrap(rows, "account_id", "y", "n", "total")
    return spark.createDataFrame([(found["delta"], found["low"], found["high"])], "delta double, low double, high double")


