"""Configuration rules, and a small dataset from the command line to its evaluation."""

import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.cli import main
from tidemark.errors import ConfigError
from tidemark.session import Scratch
from tidemark.synth.config import load_config
from tidemark.synth.draw import Draws
from tidemark.synth.generate import generate
from tidemark.synth.scenario import FAMILIES, instances, plan_network, slots

INVALID = [
    {"simulation": {"anchor": "2024-01-02"}},
    {"simulation": {"days": 10}},
    {"simulation": {"unknown": 1}},
    {"unknown": {}},
    {"archetypes": {"student": {"share": 0.9}}},
    {"infrastructure": {"session_seconds": [1, 100]}},
    {"infrastructure": {"session_seconds": [20, 9_999]}},
    {"high_risk_phases": ["MOVEMENT"]},
    {"splits": {"train_end_day": 80}},
    {"splits": {"horizons_hours": [24 * 30]}},
    {"splits": {"ref_pool_method": "other"}},
    {"training": {"mode": "mature_only", "maturity_days": 60}},
    {"labels": {"latency_days": {"kind": "Constant", "value": 3}}},
    {"labels": {"latency_days": {"kind": "LogNormal", "median": 14, "sigma": 0}}},
    {"labels": {"never_known": 1.5}},
    {"amounts": {"card": {"kind": "Odd"}}},
    {"amounts": {"card": {"kind": "Uniform", "low": 5, "high": 1}}},
    {"families": {"cycle": {"min_instances": 9, "max_instances": 1}}},
]


@pytest.mark.parametrize("override", INVALID, ids=lambda o: json.dumps(o)[:40])
def test_invalid_configurations(override):
    with pytest.raises(ConfigError):
        load_config("dev", overrides=override)


def test_layers_and_hash(tmp_path):
    (tmp_path / "c.yaml").write_text("_anchors: {x: 1}\npopulation: {n_persons: 50}\nfamily_defaults: {max_instances: 3}\nfamilies: {cycle: {max_instances: 2}}\n")
    cfg = load_config("tiny", seed=7, path=tmp_path / "c.yaml")
    assert cfg["population"]["n_persons"] == 50 and cfg.days == 45 and cfg.seed == 7
    assert cfg["families"]["fan_in"]["max_instances"] == 3 and cfg["families"]["cycle"]["max_instances"] == 2
    assert cfg.config_hash() == load_config("tiny", seed=7, path=tmp_path / "c.yaml").config_hash() != load_config("tiny", seed=8).config_hash()
    with pytest.raises(ConfigError):
        load_config("none")


@pytest.mark.parametrize("family", FAMILIES)
def test_plans_of_each_family(family):
    i = {"family": family, "code": FAMILIES.index(family) + 1, "idx": 0, "fan": 3, "hops": 3, "rounds": 2, "exit": "atm", "start": 10 * 86_400, "amount": 50_000, "holding": 7_200, "retention": 500, "forward": 900}
    members = {name: 100 + n for n, (name, _, _) in enumerate(slots(family, 3, 3))}
    plan = plan_network(i, members, 1, 90 * 86_400)
    events = [r for r in plan if r["what"] == "event"]
    assert plan == plan_network(i, members, 1, 90 * 86_400)
    assert [r["no"] for r in events] == list(range(len(events))) and all(a["ts"] < b["ts"] for a, b in zip(events, events[1:]))
    assert all(r["depends_on"] is None or r["depends_on"] < r["no"] for r in events) and all(r["amount_minor"] > 0 and r["src_account_id"] != r["dst_account_id"] for r in events)
    assert {r["phase"] for r in events} >= {"INFLOW", "EXIT"} and sum(r["what"] == "member" for r in plan) == len(members)


def test_other_families_change_nothing_in_a_network():
    a = {(i["family"], i["idx"]): i for i in instances(load_config("tiny"))}
    b = {(i["family"], i["idx"]): i for i in instances(load_config("tiny", overrides={"families": {"cycle": {"min_instances": 0, "max_instances": 0}}}))}
    assert b.keys() < a.keys() and all(a[k] == b[k] for k in b)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A dataset of the tiny profile, written by the command line."""
    out = str(tmp_path_factory.mktemp("data"))
    assert main(["simulate", "--profile", "tiny", "--seed", "3", "--out", out], spark) == 0
    return out


def test_command_line(spark, folder, tmp_path, capsys):
    assert main(["validate", folder], spark) == 0
    assert main(["sanity", folder], spark) == 0
    assert '"Families"' in capsys.readouterr().out
    assert main(["eda", folder, "--out", str(tmp_path / "r.md")], spark) == 0
    assert "## Split points" in (tmp_path / "r.md").read_text()
    assert main(["export-csv", folder, "--out", str(tmp_path), "--tables", "atms"], spark) == 0
    assert main(["gate", folder, "--out", str(tmp_path / "g.json"), "--sample", "5000", "--resamples", "20"], spark) == 0
    result = json.loads((tmp_path / "g.json").read_text())
    assert result["val_points"] > 500  # two days of some 360 accounts
    if "ap_lr" in result:
        assert 0 < result["prevalence"] < 1 and 0 <= result["ap_lr"] <= 1
        assert main(["gate-combine", str(tmp_path / "g.json")]) in (0, 1)


def test_tampered_files_are_noticed(spark, folder, tmp_path, capsys):
    import shutil

    shutil.copytree(folder, tmp_path / "d")
    spark.read.parquet(f"{folder}/atms.parquet").limit(5).write.mode("overwrite").parquet(f"{tmp_path}/d/atms.parquet")
    assert main(["validate", str(tmp_path / "d")], spark) == 1
    assert "atms" in capsys.readouterr().out


def test_same_seed_same_data(spark):
    cfg = load_config("tiny", seed=3)
    a, b = (generate(spark, cfg, Scratch(spark, "same"), method, check=False) for method in ("sequential", "fixpoint"))
    assert a.metadata["digests"] == b.metadata["digests"]
    assert rows(a.tables["atms"]) == rows(b.tables["atms"])


def test_networks_raise_and_do_not_vanish(spark):
    with pytest.raises(ConfigError, match="too few accounts"):
        generate(spark, load_config("tiny", seed=3, overrides={"population": {"n_persons": 40}}), Scratch(spark, "few"), check=False)
    with pytest.raises(ConfigError, match="max_instances reached"):
        instances(load_config("tiny", overrides={"recruitment": {"target_prevalence": 0.5}}))


def test_draws_have_the_moments_of_their_distributions(spark):
    draw, k = Draws(5), F.col("id")
    df = spark.range(20_000)
    for mean in (0.3, 6.0, 45.0):
        m, v, most = df.select(draw.poisson(mean, "p", k).alias("x")).agg(F.avg("x"), F.var_pop("x"), F.max("x")).first()
        assert abs(m - mean) < 5 * (mean / 20_000) ** 0.5 and abs(v - mean) < 0.1 * mean and most > mean + 2.5 * mean**0.5
    for shape in (0.4, 1.0, 3.5):
        x = df.select(draw.gamma(shape, "g", k).alias("x"))
        m, v, low, missing = x.agg(F.avg("x"), F.var_pop("x"), F.min("x"), F.count_if(F.col("x").isNull())).first()
        assert abs(m - shape) < 5 * (shape / 20_000) ** 0.5 and abs(v - shape) < 0.15 * shape and low > 0 and missing == 0
    with pytest.raises(ConfigError):
        draw.poisson(1_000, "p", k)


def test_quota_of_each_family():
    cfg = load_config("dev")
    sizes = {f: [len(slots(f, i["fan"], i["hops"])) for i in instances(cfg) if i["family"] == f] for f in FAMILIES}
    quota = cfg["recruitment"]["target_prevalence"] * cfg["population"]["n_persons"] / sum(f["weight"] for f in cfg["families"].values())
    assert all(abs(sum(s) - quota * cfg["families"][f]["weight"]) <= max(s) or len(s) == cfg["families"][f]["min_instances"] for f, s in sizes.items())


def test_networks_log_in_before_they_pay(spark, folder):
    """Digital transfers of networks have logins of their own, which are labelled; shared infrastructure is shared."""
    t = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("event_labels", "logins", "transactions", "labels", "devices", "ips")}
    labelled = t["event_labels"].filter("event_table = 'logins'").join(t["logins"], "event_id")
    assert labelled.count() == t["event_labels"].filter("event_table = 'logins'").count() > 0
    setup = labelled.filter("phase = 'SETUP'")
    per_network = setup.groupBy("network_id").agg(F.countDistinct("account_id").alias("accounts"), F.countDistinct("device_id").alias("devices"), F.countDistinct("ip_id").alias("ips")).collect()
    assert per_network and all(r["accounts"] >= 2 and r["devices"] == r["ips"] == 1 for r in per_network)
    assert setup.join(t["devices"], "device_id").join(t["ips"], "ip_id").count() == setup.count()
    assert {r[0] for r in t["labels"].select("phase").distinct().collect()} >= {"SETUP", "INFLOW", "HOLD", "MOVEMENT", "EXIT"}
    paid = t["event_labels"].filter("event_table = 'transactions'").join(t["transactions"].filter("channel IN ('APP', 'WEB')"), "event_id")
    mine = t["event_labels"].filter("event_table = 'logins'").select(F.col("event_id").alias("login_event_id"))
    assert paid.count() == paid.join(mine, "login_event_id").count() > 0
