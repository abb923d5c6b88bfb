"""Registry of table schemas, and strict conforming of data to them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from tidemark.errors import SchemaError
from tidemark.functions.canon import col

_TYPES: dict[str, DataType] = {"i8": ByteType(), "i16": ShortType(), "i32": IntegerType(), "i64": LongType(), "s": StringType(), "b": BooleanType()}


@dataclass(frozen=True)
class TableSpec:
    """Name, columns, primary key; `truth` marks tables that are ground truth and never a model's input."""

    name: str
    schema: StructType
    primary_key: tuple[str, ...]
    truth: bool = False


REGISTRY: dict[str, TableSpec] = {}


def register(name: str, columns: str, primary_key: Sequence[str], truth: bool = False) -> TableSpec:
    """Register a table. `columns` is text such as "id i64, name s?", with ? for nullable."""
    fields = []
    for part in columns.split(","):
        column, kind = part.split()
        if kind.rstrip("?") not in _TYPES:
            raise SchemaError(f"{name}.{column}: type {kind} is not allowed")
        fields.append(StructField(column, _TYPES[kind.rstrip("?")], kind.endswith("?")))
    names = [f.name for f in fields]
    if name in REGISTRY:
        raise SchemaError(f"{name} is registered already")
    if len(set(names)) < len(names):
        raise SchemaError(f"{name}: a column is named twice")
    if "currency" in names:
        raise SchemaError(f"{name}: money is in minor units of one currency per dataset; a currency column is refused")
    nullable = {f.name: f.nullable for f in fields}
    if not primary_key or any(nullable.get(k, True) for k in primary_key):
        raise SchemaError(f"{name}: primary key columns must be there and not nullable")
    REGISTRY[name] = TableSpec(name, StructType(fields), tuple(primary_key), truth)
    return REGISTRY[name]


def spec(name: str) -> TableSpec:
    if name not in REGISTRY:
        raise SchemaError(f"unknown table {name}")
    return REGISTRY[name]


def table_names() -> list[str]:
    return sorted(REGISTRY)


register("persons", "person_id i64, region i16, household_id i64, created_at i64", ["person_id"])
register(
    "accounts",
    "account_id i64, account_kind s, external_role s?, owner_person_id i64?, opened_at i64, closed_at i64?, overdraft_limit_minor i64?, initial_balance_minor i64, region i16?",
    ["account_id"],
)
register("devices", "device_id i64, device_kind s, first_seen_at i64", ["device_id"])
register("ips", "ip_id i64, ip_context s, region i16", ["ip_id"])
register("atms", "atm_id i64, region i16", ["atm_id"])
register("merchants", "merchant_id i64, merchant_category s, region i16", ["merchant_id"])
register("relations", "relation_type s, src_id i64, dst_id i64, valid_from i64, valid_to i64", ["relation_type", "src_id", "dst_id", "valid_from"])
register(
    "transactions",
    "event_id i64, ts i64, txn_type s, channel s, src_account_id i64, dst_account_id i64, merchant_id i64?, atm_id i64?, amount_minor i64, region i16, device_id i64?, ip_id i64?, "
    "login_event_id i64?, status s, src_balance_before_minor i64, src_balance_after_minor i64, dst_balance_before_minor i64, dst_balance_after_minor i64",
    ["event_id"],
)
register("logins", "event_id i64, ts i64, account_id i64, device_id i64, ip_id i64, channel s, outcome s", ["event_id"])
register("person_truth", "person_id i64, archetype s, origin s", ["person_id"], truth=True)
register(
    "labels",
    "entity_type s, entity_id i64, valid_from i64, valid_to i64, risk_label i8, role_label s, scenario_id s, network_id i64, family s, phase s, is_ood_family b, known_at i64?",
    ["entity_type", "entity_id", "scenario_id", "valid_from"],
    truth=True,
)
register(
    "event_labels",
    "event_table s, event_id i64, scenario_id s, network_id i64, family s, phase s, event_type s, is_high_risk b, is_terminal b, is_ood_family b, known_at i64?",
    ["event_table", "event_id"],
    truth=True,
)
register(
    "ground_truth_networks",
    "network_id i64, scenario_id s, family s, instance_idx i32, is_ood_family b, start_ts i64, end_ts i64, terminal_ts i64?, censored b, n_members i32, n_created_accounts i32, n_rounds i32, "
    "detected b, known_at i64?, amount_scale_minor i64, fan_degree i32, hops i32, holding_seconds i64, retention_permille i32, forward_permille i32",
    ["network_id"],
    truth=True,
)
register("network_members", "network_id i64, entity_type s, entity_id i64, first_role s, joined_ts i64, is_created b", ["network_id", "entity_type", "entity_id"], truth=True)


def cast_columns(df: DataFrame, name: str, columns: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """The columns cast to their registered types, after one pass that finds lossy casts and forbidden NULLs.

    Columns that have their type already are only counted, which files answer from their footers: `stored` is df as a
    source that can (stored_counts). Only the others are read for the check.
    """
    fields = {f.name: f for f in spec(name).schema}
    same = [c for c in columns if df.schema[c].dataType == fields[c].dataType]
    strict = [c for c in same if not fields[c].nullable]
    if strict:
        counted = (df if stored is None else stored).agg(F.count(F.lit(1)).alias("rows"), *(F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(strict))).first()
        for i, c in enumerate(strict):
            if counted["rows"] != counted[f"n_{i}"]:
                raise SchemaError(f"{name}.{c}: {counted['rows'] - counted[f'n_{i}']} values are NULL")
    checks = []
    for c in columns:
        if c in same:
            continue
        to = F.try_cast if hasattr(F, "try_cast") else None
        target = col(c).try_cast(fields[c].dataType) if to is None else to(col(c), fields[c].dataType)
        back = target.cast(df.schema[c].dataType)
        lossy = col(c).isNotNull() & (target.isNull() | ~back.eqNullSafe(col(c)))
        checks += [F.count_if(lossy).alias(f"lossy {c}"), F.count_if(col(c).isNull() & F.lit(not fields[c].nullable)).alias(f"null {c}")]
    row = df.agg(*checks).first().asDict() if checks else {}
    for what, n in row.items():
        if n:
            kind, c = what.split(" ", 1)
            raise SchemaError(f"{name}.{c}: {n} values " + ("do not fit the registered type" if kind == "lossy" else "are NULL"))
    return df.select(*(col(c).cast(fields[c].dataType).alias(c) for c in columns))


def conform(name: str, df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """df with exactly the registered columns in their order and types; raises SchemaError where that loses anything."""
    want = spec(name).schema.names
    if set(df.columns) != set(want) or len(df.columns) != len(want):
        raise SchemaError(f"{name}: missing {sorted(set(want) - set(df.columns))}, unknown {sorted(set(df.columns) - set(want))}")
    return cast_columns(df, name, want, stored)


def duplicate_keys(name: str, df: DataFrame) -> DataFrame:
    """Primary keys that occur more than once, with their counts."""
    return df.groupBy(*spec(name).primary_key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
