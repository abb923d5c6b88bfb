"""The whole synthetic dataset: population, behaviour, scenarios, settlement, labels, checks and files."""

from __future__ import annotations

import platform
import subprocess
from dataclasses import dataclass
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.ids import event_id, kind_of
from tidemark.functions.keyed import stable_key, with_keyed_uniform
from tidemark.functions.timebase import DAY
from tidemark.operators.checks import all_checks, run_checks
from tidemark.operators.settle import settle
from tidemark.session import Scratch
from tidemark.sources.digest import multiset_digest
from tidemark.sources.files import write_dataset
from tidemark.sources.schema import REGISTRY, conform
from tidemark.synth.config import GeneratorConfig
from tidemark.synth.draw import Draws
from tidemark.synth.normal import account_of, browsing, build_population, login_rows, normal_transactions, session_logins
from tidemark.synth.scenario import FAMILIES, SCENARIO_DEVICE, SCENARIO_IP, cell_names, plans


@dataclass(frozen=True)
class Dataset:
    tables: dict[str, DataFrame]
    metadata: dict


def suppressed(normal: DataFrame, windows: DataFrame, key: str) -> DataFrame:
    """normal events without those in a window (account_id, start, end, retention) of an account of theirs, of which the share `retention` stays."""
    drawn = with_keyed_uniform(normal, stable_key(key), F.col("event_id"))
    side = drawn.select("event_id", "ts", "u", F.explode(F.array("src_account_id", "dst_account_id")).alias("account_id"))
    hit = side.join(windows, "account_id").filter("ts >= start AND ts < end AND u >= retention").select("event_id").distinct()
    return drawn.drop("u").join(hit, "event_id", "left_anti")


def _provenance() -> dict:
    def git(*args: str) -> str:
        try:
            return subprocess.run(["git", *args], capture_output=True, text=True, cwd=Path(__file__).parent, timeout=10, check=True).stdout.strip()
        except (OSError, subprocess.SubprocessError):
            return ""

    return {"commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain")), "python": platform.python_version(), "pyspark": pyspark.__version__}


def generate(spark: SparkSession, cfg: GeneratorConfig, scratch: Scratch, settle_method: str = "fixpoint", check: bool = True) -> Dataset:
    """All 14 tables; with check the integrity checks run on them before they are returned."""
    draw = Draws(cfg.seed)
    pop = build_population(spark, cfg, draw)
    own = pop.people.select(account_of(F.col("person_id")).alias("account_id"))
    plan, made = plans(spark, cfg, own, draw)
    plan = scratch.table(plan, "plan")
    normal = scratch.table(normal_transactions(spark, cfg, pop, draw).filter(F.col("ts") < cfg.sim_end), "normal")
    net = spark.createDataFrame([(i["code"] << 16 | i["idx"], i["family"], i["idx"], i["ood"], i["start"], i["amount"], i["fan"], i["hops"], i["holding"], i["retention"], i["forward"], i["rounds"]) for i in made], "network_id bigint, family string, instance_idx int, is_ood_family boolean, start bigint, amount_scale_minor bigint, fan_degree int, hops int, holding_seconds bigint, retention_permille int, forward_permille int, n_rounds int")
    net = F.broadcast(net)  # a row per instance
    spans = plan.filter("what = 'interval'").groupBy("network_id", "account_id").agg(F.min("ts").alias("start"), F.max("valid_to").alias("end"))
    windows = spans.join(net.select("network_id", "family", "retention_permille"), "network_id").select("account_id", F.when(F.col("family") == "dormant_activation", F.col("start") - 30 * DAY).otherwise(F.col("start")).alias("start"), "end", F.when(F.col("family") == "dormant_activation", 0.0).otherwise(F.col("retention_permille") / 1_000).alias("retention"))
    kept = scratch.table(suppressed(normal, windows, f"suppress/{cfg.seed}"), "kept")

    code = F.element_at(F.create_map(*(F.lit(x) for pair in {f: i for i, f in enumerate(FAMILIES, 1)}.items() for x in pair)), F.col("family"))
    owner = (code * 65_536 + F.col("instance_idx")).cast("bigint")
    planned = plan.filter("what = 'event'").join(net.select("network_id", "family", "instance_idx"), "network_id")
    planned = planned.withColumns({"event_id": event_id(3, owner, F.col("no")), "depends_id": F.when(F.col("depends_on").isNotNull(), event_id(3, owner, F.col("depends_on"))), "atm_id": F.when(F.col("cash"), draw.integer(1, cfg["population"]["n_atms"], "atm/scenario", F.col("no"), F.col("network_id")))})
    planned = scratch.table(planned.withColumn("login_event_id", F.when(F.col("login_no").isNotNull(), event_id(4, owner, F.col("login_no")))), "planned")
    entries = plan.filter("what = 'login'").join(net.select("network_id", "family", "instance_idx"), "network_id").withColumn("event_id", event_id(4, owner, F.col("no")))
    entries = scratch.table(entries, "entries")

    created = plan.filter("what = 'member' AND is_created").select("account_id", F.col("ts").alias("opened_at")).distinct()
    new_accounts = created.select("account_id", F.lit("internal").alias("account_kind"), F.lit(None).cast("string").alias("external_role"), F.col("account_id").alias("owner_person_id"), (F.col("opened_at") - DAY).alias("opened_at"), F.lit(None).cast("bigint").alias("closed_at"), F.lit(0).cast("bigint").alias("overdraft_limit_minor"), F.lit(0).cast("bigint").alias("initial_balance_minor"), F.lit(0).cast("smallint").alias("region"))
    accounts = scratch.table(pop.tables["accounts"].unionByName(new_accounts), "accounts")

    columns = ["event_id", "ts", "txn_type", "channel", "src_account_id", "dst_account_id", "merchant_id", "atm_id", "amount_minor", "region"]
    none = F.lit(None).cast("bigint")
    # A login in the first second of all may be at the same time as its event, which is not too late.
    with_login = session_logins(kept.filter(F.col("channel").isin("APP", "WEB")), cfg, draw)
    rest = kept.filter(~F.col("channel").isin("APP", "WEB"))
    normal_rows = with_login.select(*columns, "device_id", "ip_id", "login_event_id").unionByName(rest.select(*columns, none.alias("device_id"), none.alias("ip_id"), none.alias("login_event_id")))
    scenario_rows = planned.select(*(F.col(c) if c not in ("merchant_id", "region") else F.lit(None if c == "merchant_id" else 0).cast("bigint" if c == "merchant_id" else "smallint").alias(c) for c in columns), "device_id", "ip_id", "login_event_id")
    all_rows = scratch.table(normal_rows.unionByName(scenario_rows), "rows")
    logins = login_rows(with_login.unionByName(browsing(spark, cfg, pop, draw).filter(F.col("ts") < cfg.sim_end)), cfg, draw)
    logins = logins.unionByName(entries.select("event_id", "ts", "account_id", "device_id", "ip_id", "channel", F.lit("SUCCESS").alias("outcome")))

    to_settle = all_rows.join(planned.select("event_id", "depends_id"), "event_id", "left").select("event_id", "ts", "src_account_id", "dst_account_id", "amount_minor", F.col("depends_id").alias("depends_on"))
    ledger = settle(to_settle, accounts, Scratch(spark, "ledger"), settle_method).select("event_id", "status", "src_before", "src_after", "dst_before", "dst_after")
    done = all_rows.join(ledger, "event_id")
    transactions = done.select(*columns, "device_id", "ip_id", "login_event_id", "status", F.col("src_before").alias("src_balance_before_minor"), F.col("src_after").alias("src_balance_after_minor"), F.col("dst_before").alias("dst_balance_before_minor"), F.col("dst_after").alias("dst_balance_after_minor"))
    transactions = scratch.table(transactions.repartition("event_id").sortWithinPartitions("ts", "event_id"), "transactions")
    truth = _truth(cfg, draw, plan, planned, entries, net, transactions)
    used = entries.groupBy("device_id").agg(F.min("ts").alias("first_seen_at")).filter(kind_of(F.col("device_id")) == SCENARIO_DEVICE)
    devices = pop.tables["devices"].unionByName(used.select("device_id", F.lit("mobile").alias("device_kind"), "first_seen_at"))
    places = entries.select("ip_id").distinct().filter(kind_of(F.col("ip_id")) == SCENARIO_IP)
    ips = pop.tables["ips"].unionByName(places.select("ip_id", F.lit("household").alias("ip_context"), draw.integer(0, cfg["population"]["n_regions"] - 1, "region/scenario", F.col("ip_id")).cast("smallint").alias("region")))
    more = {
        "persons": pop.tables["persons"].unionByName(created.select(F.col("account_id").alias("person_id"), F.lit(0).cast("smallint").alias("region"), F.lit(-1).cast("bigint").alias("household_id"), (F.col("opened_at") - DAY).alias("created_at"))),
        "person_truth": pop.tables["person_truth"].unionByName(created.select(F.col("account_id").alias("person_id"), F.lit("student").alias("archetype"), F.lit("scenario").alias("origin"))),
        "relations": pop.tables["relations"].unionByName(created.select(F.lit("OWNS_ACCOUNT").alias("relation_type"), F.col("account_id").alias("src_id"), F.col("account_id").alias("dst_id"), F.col("opened_at").alias("valid_from"), F.lit(cfg.sim_end).cast("bigint").alias("valid_to"))),
        "devices": devices,
        "ips": ips,
    }
    tables = pop.tables | more | truth | {"accounts": accounts, "transactions": transactions, "logins": logins}
    # Written first, so that conforming reads files and does not make each table twice.
    tables = {n: conform(n, scratch.table(tables[n], f"final_{n}")) for n in REGISTRY}
    if check:
        v = cfg["validation"]
        # A member belongs to one network, but the phases of a network with several rounds follow each other per account, so intervals are cut in _truth.
        run_checks(tables, all_checks(cfg.sim_end, cfg["infrastructure"]["session_window"], v["min_cv"], v["min_instances"]))
    digests = {n: [str(x) for x in multiset_digest(df).first()] for n, df in tables.items()}
    metadata = {"config": cfg.values, "config_hash": cfg.config_hash(), "seed": cfg.seed, "sim_end": cfg.sim_end, "digests": digests, "row_counts": {n: int(d[0]) for n, d in digests.items()}, "n_networks": len(made), "cells": cell_names(made)} | {"provenance": _provenance()}
    return Dataset(tables, metadata)


def _truth(cfg: GeneratorConfig, draw: Draws, plan: DataFrame, planned: DataFrame, entries: DataFrame, net: DataFrame, transactions: DataFrame) -> dict[str, DataFrame]:
    """Label tables from the plan and from what was settled."""
    settled = planned.join(transactions.select("event_id", "status"), "event_id")
    ends = settled.groupBy("network_id").agg(F.max("ts").alias("last_event"), F.max(F.when((F.col("phase") == "EXIT") & (F.col("status") == "SETTLED"), F.struct("ts", "event_id"))).alias("terminal"))
    first = settled.select("network_id", "ts", F.explode(F.array("src_account_id", "dst_account_id")).alias("account_id"))
    first = first.unionByName(entries.select("network_id", "ts", "account_id")).groupBy("network_id", "account_id").agg(F.min("ts").alias("first_own"))
    intervals = plan.filter("what = 'interval'").select("network_id", "account_id", "role", "phase", F.col("ts").alias("s"), "valid_to")
    intervals = intervals.join(first, ["network_id", "account_id"]).withColumn("valid_from", F.greatest("s", "first_own"))
    following = F.lead("valid_from").over(Window.partitionBy("network_id", "account_id").orderBy("valid_from", "valid_to"))
    intervals = intervals.withColumn("valid_to", F.least("valid_to", F.coalesce(following, "valid_to"))).filter("valid_from < valid_to")
    last_interval = intervals.groupBy("network_id").agg(F.max("valid_from").alias("last_interval"))
    delay = F.floor(draw.sample(cfg["labels"]["latency_days"], "latency", F.col("network_id")) * DAY)
    outcome = net.join(ends, "network_id").join(last_interval, "network_id", "left").withColumns({"terminal_ts": F.col("terminal.ts"), "known": (F.greatest("last_event", F.coalesce("last_interval", "last_event"), F.coalesce("terminal.ts", "last_event")) + delay).cast("bigint"), "never": draw.uniform("never", F.col("network_id")) < cfg["labels"]["never_known"]})
    outcome = outcome.withColumn("known_at", F.when(~F.col("never") & (F.col("known") < cfg.sim_end), F.col("known"))).withColumn("scenario_id", F.concat_ws(":", "family", "instance_idx"))
    outcome = outcome.join(intervals.select("network_id").distinct(), "network_id", "left_semi")
    facts = outcome.select("network_id", "scenario_id", "family", "is_ood_family", "known_at")
    risk = F.when(F.col("role") == "VICTIM_LIKE", 0).otherwise(1).cast("tinyint")
    labels = intervals.join(facts, "network_id").select(F.lit("account").alias("entity_type"), F.col("account_id").alias("entity_id"), "valid_from", "valid_to", risk.alias("risk_label"), F.col("role").alias("role_label"), "scenario_id", "network_id", "family", "phase", "is_ood_family", "known_at")
    terminal = outcome.select("network_id", F.col("terminal.event_id").alias("terminal_event"))
    high = F.col("phase").isin(*cfg["high_risk_phases"])
    event_labels = planned.join(facts.drop("family"), "network_id").join(terminal, "network_id").select(F.lit("transactions").alias("event_table"), "event_id", "scenario_id", "network_id", "family", "phase", "event_type", high.alias("is_high_risk"), F.coalesce(F.col("event_id") == F.col("terminal_event"), F.lit(False)).alias("is_terminal"), "is_ood_family", "known_at")
    of_logins = entries.join(facts.drop("family"), "network_id").select(F.lit("logins").alias("event_table"), "event_id", "scenario_id", "network_id", "family", "phase", "event_type", high.alias("is_high_risk"), F.lit(False).alias("is_terminal"), "is_ood_family", "known_at")
    event_labels = event_labels.unionByName(of_logins)
    members = plan.filter("what = 'member'").join(facts.select("network_id"), "network_id", "left_semi")
    sizes = members.groupBy("network_id").agg(F.count(F.lit(1)).cast("int").alias("n_members"), F.count_if("is_created").cast("int").alias("n_created_accounts"))
    networks = outcome.join(sizes, "network_id").select(
        "network_id", "scenario_id", "family", "instance_idx", "is_ood_family", F.col("start").alias("start_ts"), F.greatest("last_event", "last_interval").alias("end_ts"), "terminal_ts", (F.col("terminal_ts").isNull()).alias("censored"), "n_members", "n_created_accounts", "n_rounds",
        F.col("known_at").isNotNull().alias("detected"), "known_at", "amount_scale_minor", "fan_degree", "hops", "holding_seconds", "retention_permille", "forward_permille",
    )
    people = members.select("network_id", F.lit("account").alias("entity_type"), F.col("account_id").alias("entity_id"), F.col("role").alias("first_role"), F.col("ts").alias("joined_ts"), "is_created")
    return {"labels": labels, "event_labels": event_labels, "ground_truth_networks": networks, "network_members": people}


def write(dataset: Dataset, folder: str) -> None:
    write_dataset(dataset.tables, dataset.metadata, folder)
