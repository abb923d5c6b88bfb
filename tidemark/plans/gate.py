"""One dataset's evaluation from files to numbers: features, targets, probes and what they reach."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.timebase import DAY
from tidemark.operators import metrics, splits
from tidemark.operators.grid import feature_names
from tidemark.operators.store import TemporalStore
from tidemark.operators.truth import OracleLabels
from tidemark.session import Scratch
from tidemark.sources.files import read_table

NEIGHBOUR = ("txn_count_30d", "in_degree_30d", "out_degree_30d", "account_age_days")
GROUPS = {"business": ("small_business", "hf_merchant", "high_volume_business"), "irregular": ("traveler", "spending_surge")}
ORDER = ("burstiness", "median_gap_h", "credit_to_debit_h")


def metadata_of(folder: str) -> dict:
    return json.loads((Path(folder) / "metadata.json").read_text(encoding="utf-8"))


def oracle_from(spark: SparkSession, folder: str) -> OracleLabels:
    """High-risk events of source accounts, from the labelled transactions."""
    hot = read_table(spark, "event_labels", folder).filter("event_table = 'transactions' AND is_high_risk")
    ts = read_table(spark, "transactions", folder).select("event_id", "ts", F.col("src_account_id").alias("account_id"))
    events = hot.select("event_id", "known_at", "is_ood_family").join(ts, "event_id").select("account_id", "ts", "known_at", "is_ood_family")
    return OracleLabels(read_table(spark, "labels", folder), events, read_table(spark, "network_members", folder), read_table(spark, "ground_truth_networks", folder))


def owners_from(spark: SparkSession, folder: str) -> DataFrame:
    a = read_table(spark, "accounts", folder).filter("account_kind = 'internal'").select("account_id", "owner_person_id")
    return a.join(read_table(spark, "person_truth", folder), F.col("owner_person_id") == F.col("person_id")).select("account_id", "archetype")


def split_from(spark: SparkSession, folder: str, horizon_s: int) -> splits.SplitIndex:
    meta = metadata_of(folder)
    s, accounts = meta["config"]["splits"], read_table(spark, "accounts", folder)
    plan = splits.SplitPlan(s["train_end_day"] * DAY, s["val_end_day"] * DAY, meta["sim_end"], -(-max(s["horizons_hours"]) // 24) * DAY)
    everyone = splits.normal_accounts(owners_from(spark, folder))
    cells = splits.rendezvous_partition(everyone.select("account_id"), meta["cells"], 1 - meta["config"]["recruitment"]["eligible_share"], f"recruit/{meta['seed']}")
    eligible = everyone.join(cells.filter("cell < 0"), "account_id", "left_semi")
    ref = splits.reference_pool(eligible, everyone, s["ref_negative_fraction"], f"reference/{meta['seed']}", s["ref_pool_method"])
    ood = oracle_from(spark, folder).ood_entities().filter("entity_type = 'account'").select(F.col("entity_id").alias("account_id"))
    return splits.example_index(accounts, ood, ref, plan, horizon_s, meta["config"]["training"]["maturity_days"] * DAY)


def run_dataset(spark: SparkSession, folder: str, scratch: Scratch, horizon_s: int = 7 * DAY, sample: int = 200_000, resamples: int = 1_000) -> dict:
    """Prevalence, the best single feature, both probes, who the false positives are, and what context features add, on the validation block."""
    meta = metadata_of(folder)
    index, oracle = split_from(spark, folder, horizon_s), oracle_from(spark, folder)
    store = TemporalStore.from_dir(spark, folder, meta["sim_end"], views=False)
    grid = scratch.table(store.snapshot_grid(1, meta["sim_end"] // DAY), "grid")
    names = feature_names()

    def block(points: DataFrame, name: str) -> DataFrame:
        y = oracle.targets("high_risk_within", points.select("account_id", "day", "t"), horizon_s).df
        return scratch.table(y.join(grid, ["account_id", "day"]), name)

    train, val = block(index.train(meta["config"]["training"]["mode"]), "train"), block(index.val, "val")
    n, positives = val.agg(F.count(F.lit(1)), F.count_if("y")).first()
    if not positives or not train.filter("y").limit(1).count():
        return {"val_points": n, "val_positives": positives}
    single = metrics.single_feature_ap(val, names).orderBy(F.desc("ap")).first()
    scaling = metrics.fit_scaling(train, names)
    scaled_train, scaled_val = metrics.scaled(train, scaling), metrics.scaled(val, scaling)
    lr = scratch.table(metrics.probe_scores(metrics.logistic_probe(scaled_train, names), scaled_val, names).select("account_id", "day", "t", "y", "score"), "lr")
    tree = metrics.probe_scores(metrics.tree_probe(train, names, seed=meta["seed"]), val, names)
    result = {
        "val_points": n, "val_positives": positives, "prevalence": positives / n, "best_feature": single["feature"], "best_ap": single["ap"],
        "ap_lr": metrics.average_precision_by(lr, []).first()["ap"], "ap_tree": metrics.average_precision_by(tree, []).first()["ap"],
    }
    top = metrics.top_k(lr, max(1, round(0.01 * n)), "score", ["account_id", "day"]).filter("NOT y")
    confounders = top.join(owners_from(spark, folder), "account_id").groupBy("archetype").agg(F.count(F.lit(1)).alias("n")).collect()
    result["false_positives"] = {r["archetype"]: r["n"] for r in confounders}
    # How far the score and the best feature separate within groups of archetypes alone.
    owners = owners_from(spark, folder)
    for name, archetypes in GROUPS.items():
        mine = owners.filter(F.col("archetype").isin(*archetypes)).select("account_id")
        inside = val.join(mine, "account_id", "left_semi")
        points, hits = inside.agg(F.count(F.lit(1)), F.count_if("y")).first()
        result[f"group {name}"] = {"points": points, "positives": hits}
        if hits:
            result[f"group {name}"] |= {"ap_lr": metrics.average_precision_by(lr.join(mine, "account_id", "left_semi"), []).first()["ap"], "best_ap": metrics.single_feature_ap(inside, names).agg(F.max("ap")).first()[0]}
    # What neighbours and order add, on an exact sample.
    marked = lr.withColumn("row_id", F.concat_ws("/", "account_id", "day"))
    picked = scratch.table(metrics.exact_sample(marked, sample, f"g3/{meta['seed']}", "row_id"), "picked")
    context = store.context(picked, grid, NEIGHBOUR)
    both = scratch.table(picked.drop("score").join(context, "row_id").join(grid, ["account_id", "day"]).join(picked.select("row_id", "score"), "row_id"), "both")
    wide = [*names, *(f"nbr_mean_{f}" for f in NEIGHBOUR), *ORDER]
    halves = F.pmod(F.xxhash64("account_id"), F.lit(2)) == 0
    fit, rest = both.filter(halves).drop("score"), both.filter(~halves)
    if fit.filter("y").limit(1).count() and rest.filter("y").limit(1).count():
        own = metrics.fit_scaling(fit, wide)
        plain = metrics.probe_scores(metrics.logistic_probe(metrics.scaled(fit, own), names), metrics.scaled(rest.drop("score"), own), names).select("row_id", F.col("score").alias("a"))
        more = metrics.probe_scores(metrics.logistic_probe(metrics.scaled(fit, own), wide), metrics.scaled(rest.drop("score"), own), wide).select("row_id", "account_id", "y", F.col("score").alias("b"))
        result["context"] = metrics.cluster_bootstrap(more.join(plain, "row_id"), "account_id", "y", "a", "b", resamples=resamples, max_rows=sample)
    return result
