"""Queries p1, p2, p3, p6 and p7 over the test tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import TXN_TYPES, code_of
from tidemark.operators.frequencies import key_profiles, value_frequencies
from tidemark.operators.known import attributes_as_known
from tidemark.operators.rolling import trailing_totals
from tidemark.operators.sessions import sessions
from tidemark.session import Scratch
from tidemark.streaming.entity_features import batch_bytes, by_type, read_entity_cells, read_entity_features, update_entity_features

DAY = 86_400
HORIZON_DAYS = 90
HORIZON = HORIZON_DAYS * DAY
SESSION_GAP = 1_800
HEAVY_PERCENT = 4
QUANTILES = {"p50": (50, 100), "p90": (90, 100), "p99": (99, 100)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def internal_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "accounts").filter("account_kind = 'internal'").select("account_id").distinct()


def p1_trailing(spark: SparkSession, sf_dir: str, entities: DataFrame | None = None) -> DataFrame:
    return trailing_totals(table(spark, sf_dir, "transactions"), "src_account_id", "ts", "amount_minor", key="event_id", first_day=0, last_day=HORIZON_DAYS - 1, windows=(7, 30), entities=entities)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = p1_trailing(spark, sf_dir, internal_accounts(spark, sf_dir))
    raised = (F.col("day") >= 29) & (15 * F.col("total_7d") >= 14 * F.col("total_30d")) & (F.col("total_30d") > 0)
    return totals.filter(raised).select("src_account_id", F.col("day").alias("day_no"))


def p2_profiles(spark: SparkSession, sf_dir: str, quantiles=QUANTILES) -> DataFrame:
    frequencies = value_frequencies(table(spark, sf_dir, "transactions"), ["dst_account_id", "merchant_id"], "amount_minor", key="event_id")
    return key_profiles(frequencies, Scratch(spark, "p2"), quantiles)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the keys' weights; percentiles, which nothing here reads, are not asked for."""
    profiles = Scratch(spark, "p2").table(p2_profiles(spark, sf_dir, None), "all")
    everything = profiles.filter("field_name = 'dst_account_id'").agg(F.sum("n")).first()[0] or 0
    return profiles.filter(F.col("key_id").isNotNull() & (100 * F.col("n") >= F.lit(HEAVY_PERCENT * everything))).select("field_name", "key_id")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "logins"), ["account_id", "device_id"], "ts", SESSION_GAP, Scratch(spark, "p3"), event_key="event_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).filter("n_events >= 5").select("account_id", "device_id", "start_ts", "end_ts")


def _p6_table(spark: SparkSession, sf_dir: str) -> str:
    """The feature table brought up to date with all transactions, in a few batches; returns its path."""
    scratch, source = Scratch(spark, "p6"), f"{sf_dir}/transactions.parquet"
    update_entity_features(
        spark,
        source,
        spark.read.parquet(source).schema,
        scratch.path("features"),
        scratch.path("state"),
        entity="src_account_id",
        kind=code_of(F.col("txn_type"), TXN_TYPES, upper=True),
        n_types=len(TXN_TYPES),
        ts="ts",
        amount="amount_minor",
        key="event_id",
        max_bytes_per_batch=batch_bytes(spark, source),
    )
    return scratch.path("features")


def p6_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One wide row per source account: number, total and time since the last transaction for each type."""
    rows = read_entity_features(spark, _p6_table(spark, sf_dir), len(TXN_TYPES))
    named = [F.col("entity").alias("src_account_id")]
    for i, t in enumerate((*TXN_TYPES, "OTHER")):
        named += [F.col(f"count_{i}").alias(f"n_{t.lower()}"), F.col(f"total_{i}").alias(f"total_{t.lower()}"), (HORIZON - F.col(f"last_{i}")).alias(f"since_{t.lower()}")]
    return rows.select(*named)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = by_type(read_entity_cells(spark, _p6_table(spark, sf_dir)), TXN_TYPES, HORIZON)
    quiet = cells.filter(f"n >= 4 AND since_last >= {30 * DAY}").select(F.col("entity").alias("src_account_id"), F.col("kind").alias("txn_type"))
    internal = internal_accounts(spark, sf_dir).withColumnRenamed("account_id", "src_account_id").hint("merge")  # as many as there are accounts
    return quiet.join(internal, "src_account_id", "left_semi")


def p7_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transaction with the label of its source account known and in force at its ts."""
    labels = table(spark, sf_dir, "labels").filter("entity_type = 'account'")
    return attributes_as_known(
        table(spark, sf_dir, "transactions"),
        labels,
        Scratch(spark, "p7"),
        event_key="event_id",
        event_entity="src_account_id",
        event_ts="ts",
        entity="entity_id",
        valid_from="valid_from",
        valid_to="valid_to",
        known_at="known_at",
        tie=["scenario_id"],
        state_key=["scenario_id", "valid_from"],
        payload=["risk_label", "scenario_id", "valid_from", "known_at", "phase"],
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_labels(spark, sf_dir).filter("risk_label = 1").select("event_id", "scenario_id", "valid_from")


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_profiles, p3_found, p3_sessions, p6_found, p6_features, p7_found, p7_labels)} | {"p1_trailing": p1_trailing}

_TXN = """t AS (SELECT event_id, min(ts) AS ts, min(src_account_id) AS src_account_id, min(dst_account_id) AS dst_account_id, min(merchant_id) AS merchant_id,
  min(amount_minor) AS amount_minor, min(regexp_replace(upper(trim(txn_type, ' ' || chr(9))), '[ -]', '_', 'g')) AS txn_type FROM transactions GROUP BY event_id)"""
_INTERNAL = "i AS (SELECT DISTINCT account_id FROM accounts WHERE account_kind = 'internal')"
_TRAILING = """c AS (SELECT src_account_id, ts // 86400 AS day, sum(amount_minor) AS total, count(*) AS n FROM t GROUP BY ALL),
s AS (SELECT src_account_id, day FROM (SELECT DISTINCT src_account_id FROM t), (SELECT unnest(range(90)) AS day)),
r AS (SELECT s.src_account_id, s.day, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (src_account_id, day)),
w AS (SELECT src_account_id, day, CAST(sum(total) OVER a AS BIGINT) AS total_7d, CAST(sum(n) OVER a AS BIGINT) AS count_7d, CAST(sum(total) OVER b AS BIGINT) AS total_30d, CAST(sum(n) OVER b AS BIGINT) AS count_30d
  FROM r WINDOW a AS (PARTITION BY src_account_id ORDER BY day ROWS 6 PRECEDING), b AS (PARTITION BY src_account_id ORDER BY day ROWS 29 PRECEDING))"""
_PROFILES = """p AS (SELECT 'dst_account_id' AS field_name, dst_account_id AS key_id, amount_minor AS v FROM t UNION ALL SELECT 'merchant_id', merchant_id, amount_minor FROM t),
f AS (SELECT field_name, key_id, v, count(*) AS n FROM p GROUP BY ALL)"""
_SESSIONS = """l AS (SELECT event_id, min(account_id) AS account_id, min(device_id) AS device_id, min(ts) AS ts FROM logins GROUP BY event_id),
g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY account_id, device_id ORDER BY ts, event_id) AS gap FROM l),
h AS (SELECT *, sum(CASE WHEN gap <= 1800 THEN 0 ELSE 1 END) OVER (PARTITION BY account_id, device_id ORDER BY ts, event_id) AS no FROM g),
s AS (SELECT account_id, device_id, min(ts) AS start_ts, max(ts) AS end_ts, max(ts) - min(ts) AS duration, count(*) AS n_events FROM h GROUP BY account_id, device_id, no)"""
_KNOWN = """l AS (SELECT DISTINCT entity_id, valid_from, valid_to, known_at, scenario_id, risk_label, phase FROM labels WHERE entity_type = 'account'),
k AS (SELECT t.event_id, t.src_account_id, t.ts, l.risk_label, l.scenario_id, l.valid_from, l.known_at, l.phase,
  row_number() OVER (PARTITION BY t.event_id ORDER BY l.valid_from DESC NULLS LAST, l.known_at DESC, l.scenario_id DESC) AS no
  FROM t LEFT JOIN l ON l.entity_id = t.src_account_id AND l.valid_from <= t.ts AND t.ts < l.valid_to AND l.known_at <= t.ts)"""
_FEATURES = ", ".join(
    f"count(*) FILTER (txn_type = '{t}') AS n_{t.lower()}, CAST(coalesce(sum(amount_minor) FILTER (txn_type = '{t}'), 0) AS BIGINT) AS total_{t.lower()}, 7776000 - max(ts) FILTER (txn_type = '{t}') AS since_{t.lower()}"
    for t in TXN_TYPES
) + ", 0 AS n_other, 0 AS total_other, CAST(NULL AS BIGINT) AS since_other"

SQL = {
    "p1_trailing": f"WITH {_TXN}, {_TRAILING} SELECT src_account_id, day, total_7d, count_7d, total_30d, count_30d, total_7d / 7 AS avg_day_7d, CASE WHEN count_7d > 0 THEN total_7d / count_7d END AS avg_event_7d, total_30d / 30 AS avg_day_30d, CASE WHEN count_30d > 0 THEN total_30d / count_30d END AS avg_event_30d FROM w",
    "p1_found": f"WITH {_TXN}, {_INTERNAL}, {_TRAILING} SELECT src_account_id, day AS day_no FROM w WHERE day >= 29 AND 15 * total_7d >= 14 * total_30d AND total_30d > 0 AND src_account_id IN (FROM i)",
    "p2_profiles": f"WITH {_TXN}, {_PROFILES} SELECT field_name, key_id, count(*) AS n, count(v) AS n_values, count(DISTINCT v) AS distinct_values, CAST(coalesce(sum(v), 0) AS BIGINT) AS total, min(v) AS min_value, max(v) AS max_value, "
    "(SELECT f.v FROM f WHERE f.field_name = p.field_name AND f.key_id IS NOT DISTINCT FROM p.key_id ORDER BY f.n DESC, f.v LIMIT 1) AS mode_value, "
    "quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.9) AS p90, quantile_disc(v, 0.99) AS p99 FROM p GROUP BY field_name, key_id",
    "p2_found": f"WITH {_TXN}, {_PROFILES} SELECT field_name, key_id FROM p WHERE key_id IS NOT NULL GROUP BY ALL HAVING 100 * count(*) >= 4 * (SELECT count(*) FROM t)",
    "p3_sessions": f"WITH {_SESSIONS} SELECT account_id, device_id, start_ts, end_ts, duration, n_events FROM s",
    "p3_found": f"WITH {_SESSIONS} SELECT account_id, device_id, start_ts, end_ts FROM s WHERE n_events >= 5",
    "p6_features": f"WITH {_TXN} SELECT src_account_id, {_FEATURES} FROM t GROUP BY src_account_id",
    "p6_found": f"WITH {_TXN}, {_INTERNAL} SELECT src_account_id, txn_type FROM t WHERE src_account_id IN (FROM i) GROUP BY ALL HAVING count(*) >= 4 AND max(ts) <= 7776000 - 2592000",
    "p7_labels": f"WITH {_TXN}, {_KNOWN} SELECT event_id, src_account_id, ts, risk_label, scenario_id, valid_from, known_at, phase FROM k WHERE no = 1",
    "p7_found": f"WITH {_TXN}, {_KNOWN} SELECT event_id, scenario_id, valid_from FROM k WHERE no = 1 AND risk_label = 1",
}
