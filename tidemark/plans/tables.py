"""The test tables as the operators want them: one row per key, vocabularies in canonical spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import ARCHETYPES, TXN_TYPES, code_of, value_of
from tidemark.operators.copies import one_per_key

# Channels, statuses and login outcomes.
CHANNELS = ("APP", "WEB", "ATM", "POS", "SCHEDULED", "INBOUND_EXTERNAL")
STATUSES = ("SETTLED", "DECLINED")
OUTCOMES = ("SUCCESS", "FAILURE")
HORIZON_DAYS = 90
HORIZON = HORIZON_DAYS * 86_400


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words travel as small numbers through the aggregation, which so stays a hash aggregation."""
    t = raw(spark, sf_dir, "transactions").withColumns({"txn_type": code_of(F.col("txn_type"), TXN_TYPES, upper=True), "channel": code_of(F.col("channel"), CHANNELS, upper=True), "status": code_of(F.col("status"), STATUSES, upper=True)})
    one = one_per_key(t, ["event_id"], [c for c in t.columns if c != "event_id"])
    return one.withColumns({"txn_type": value_of(F.col("txn_type"), TXN_TYPES), "channel": value_of(F.col("channel"), CHANNELS), "status": value_of(F.col("status"), STATUSES)})


def logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw(spark, sf_dir, "logins").withColumns({"channel": code_of(F.col("channel"), CHANNELS, upper=True), "outcome": code_of(F.col("outcome"), OUTCOMES, upper=True)})
    one = one_per_key(t, ["event_id"], [c for c in t.columns if c != "event_id"])
    return one.withColumns({"channel": value_of(F.col("channel"), CHANNELS), "outcome": value_of(F.col("outcome"), OUTCOMES)})


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = raw(spark, sf_dir, "accounts")
    return one_per_key(t, ["account_id"], [c for c in t.columns if c != "account_id"])


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, keys = raw(spark, sf_dir, "labels"), ["entity_type", "entity_id", "scenario_id", "valid_from"]
    return one_per_key(t, keys, [c for c in t.columns if c not in keys])


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return one_per_key(raw(spark, sf_dir, "network_members"), ["network_id", "entity_type", "entity_id"], ["first_role", "joined_ts"])


def networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "scenario_networks")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, archetype) of the internal accounts whose owner has one."""
    people = one_per_key(raw(spark, sf_dir, "person_archetypes").select("person_id", code_of(F.col("archetype"), ARCHETYPES, upper=False).alias("code")), ["person_id"], ["code"])
    a = accounts(spark, sf_dir).filter("account_kind = 'internal'").select("account_id", "owner_person_id")
    return a.join(people, F.col("owner_person_id") == F.col("person_id")).select("account_id", value_of(F.col("code"), ARCHETYPES).alias("archetype"))


_TXN = ("ts", "src_account_id", "dst_account_id", "merchant_id", "atm_id", "amount_minor", "region", "device_id", "ip_id", "login_event_id", "channel", "status", "src_balance_before_minor", "src_balance_after_minor", "dst_balance_before_minor", "dst_balance_after_minor")
_ACC = ("account_kind", "external_role", "owner_person_id", "opened_at", "closed_at", "overdraft_limit_minor", "initial_balance_minor", "region")
_LAB = ("valid_to", "risk_label", "role_label", "network_id", "family", "phase", "is_ood_family", "known_at")


def _least(columns: tuple[str, ...]) -> str:
    return ", ".join(f"min({c}) AS {c}" for c in columns)


# The same as common table expressions of SQL.
SQL = {
    "t": f"t AS (SELECT event_id, {_least(_TXN)}, min(regexp_replace(upper(trim(txn_type, ' ' || chr(9))), '[ -]', '_', 'g')) AS txn_type FROM transactions GROUP BY event_id)",
    "l": f"l AS (SELECT event_id, {_least(('ts', 'account_id', 'device_id', 'ip_id', 'channel', 'outcome'))} FROM logins GROUP BY event_id)",
    "a": f"a AS (SELECT account_id, {_least(_ACC)} FROM accounts GROUP BY account_id)",
    "b": f"b AS (SELECT entity_type, entity_id, scenario_id, valid_from, {_least(_LAB)} FROM labels GROUP BY ALL)",
    "m": "m AS (SELECT network_id, entity_type, entity_id, min(first_role) AS first_role, min(joined_ts) AS joined_ts FROM network_members GROUP BY ALL)",
    "s": "s AS (SELECT src_account_id AS account_id, dst_account_id AS counterparty_id, false AS is_credit, src_balance_before_minor AS before, src_balance_after_minor AS after, CASE WHEN status = 'SETTLED' THEN -amount_minor ELSE 0 END AS delta, * FROM t "
    "UNION ALL SELECT dst_account_id, src_account_id, true, dst_balance_before_minor, dst_balance_after_minor, CASE WHEN status = 'SETTLED' THEN amount_minor ELSE 0 END, * FROM t)",
    "o": "p AS (SELECT person_id, min(regexp_replace(lower(trim(archetype, ' ' || chr(9))), '[ -]', '_', 'g')) AS archetype FROM person_archetypes GROUP BY person_id), o AS (SELECT account_id, archetype FROM a JOIN p ON owner_person_id = person_id WHERE account_kind = 'internal')",
}


def sql(parts: str, body: str) -> str:
    """A statement with the named expressions, e.g. sql("t a", "SELECT ...")."""
    return "WITH " + ", ".join(SQL[p] if p in SQL else p for p in parts.split()) + " " + body
