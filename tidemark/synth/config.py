"""Configuration of the synthetic data: a nested mapping with defaults, overlays and rules."""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Mapping
from datetime import date
from pathlib import Path

from tidemark.errors import ConfigError

ARCHETYPE = {"share": 0.1, "income": 1.0, "card_daily": 0.6, "p_night": 0.05, "atm_weekly": 0.4, "p2p_monthly": 3.0, "browse_daily": 0.4, "customers_daily": 0.0, "suppliers_daily": 0.0, "travel": 0.02, "surge": 0.0, "dormancy": 0.02}
FAMILY = {"weight": 1.0, "max_instances": 4, "min_instances": 1, "fan": {"kind": "ShiftedPoisson", "shift": 2, "mean": 1.5}, "hops": 3, "rounds": 2, "ood": False, "exit": "atm", "amount": {"kind": "LogNormal", "median": 60_000, "sigma": 0.6}, "start_day": {"kind": "Uniform", "low": 5, "high": 60}, "holding_hours": {"kind": "Gamma", "shape": 2.0, "scale": 12.0}}

# Days, split ends, horizons, label latency, shares never known and of the reference pool, and session
# lengths of the profiles, all below, are those that published results were made with.
BASE: dict = {
    "simulation": {"seed": 1, "days": 90, "anchor": "2024-01-01"},
    "population": {"n_persons": 2_500, "n_regions": 8, "household_size": 2.2, "n_merchants": 320, "n_atms": 60, "n_employers": 40, "n_billers": 30, "n_landlords": 20, "n_card_networks": 5},
    "infrastructure": {"session_seconds": [20, 1_200], "session_window": 1_800, "failed_login": 0.04, "personal_device": 0.8},
    "amounts": {
        "income": {"kind": "LogNormal", "median": 260_000, "sigma": 0.35},
        "rent": {"kind": "LogNormal", "median": 90_000, "sigma": 0.3},
        "bill": {"kind": "LogNormal", "median": 6_000, "sigma": 0.6},
        "card": {"kind": "LogNormal", "median": 2_800, "sigma": 0.9},
        "p2p": {"kind": "LogNormal", "median": 4_000, "sigma": 1.0},
        "business": {"kind": "LogNormal", "median": 9_000, "sigma": 1.0},
        "atm": {"step": 1_000, "most": 50_000, "median": 6_000, "sigma": 0.7},
        "opening": {"kind": "LogNormal", "median": 150_000, "sigma": 0.8},
    },
    "overdraft": {"share": 0.5, "limit_minor": 100_000},
    "archetypes": {
        "salary_worker": ARCHETYPE | {"share": 0.40},
        "student": ARCHETYPE | {"share": 0.14, "income": 0.3, "p_night": 0.15},
        "small_business": ARCHETYPE | {"share": 0.08, "customers_daily": 2.0, "suppliers_daily": 0.6},
        "hf_merchant": ARCHETYPE | {"share": 0.03, "customers_daily": 6.0, "suppliers_daily": 1.0},
        "traveler": ARCHETYPE | {"share": 0.10, "travel": 0.4},
        "family": ARCHETYPE | {"share": 0.13, "income": 1.4, "card_daily": 1.0},
        "spending_surge": ARCHETYPE | {"share": 0.11, "surge": 0.3},
        "high_volume_business": ARCHETYPE | {"share": 0.01, "customers_daily": 15.0, "suppliers_daily": 4.0},
    },
    "family_defaults": {},
    "families": {
        "fan_in": FAMILY | {},
        "fan_out": FAMILY | {"exit": "atm"},
        "pass_through": FAMILY | {"weight": 0.25, "exit": "external"},
        "burst": FAMILY | {},
        "dormant_activation": FAMILY | {"ood": True},
        "multi_hop": FAMILY | {},
        "cycle": FAMILY | {"ood": True, "exit": "external"},
        "structuring_like": FAMILY | {"weight": 0.25, },
        "shared_infrastructure": FAMILY | {"exit": "external"},
        "account_to_cash": FAMILY | {"weight": 0.25, },
    },
    "recruitment": {"eligible_share": 0.5, "target_prevalence": 0.02},
    "high_risk_phases": ["MOVEMENT", "EXIT"],
    "labels": {"latency_days": {"kind": "LogNormal", "median": 14.0, "sigma": 0.75}, "never_known": 0.1},
    "training": {"mode": "include_immature", "maturity_days": 14},
    "splits": {"train_end_day": 60, "val_end_day": 75, "horizons_hours": [24, 168], "ref_negative_fraction": 0.10, "ref_pool_method": "stratified_archetype"},
    "validation": {"min_cv": 0.05, "min_instances": 5},
}
PROFILES: dict[str, dict] = {
    "tiny": {"simulation": {"days": 45}, "population": {"n_persons": 400}, "family_defaults": {"max_instances": 2, "start_day": {"kind": "Uniform", "low": 2, "high": 25}}, "recruitment": {"target_prevalence": 0.14}, "splits": {"train_end_day": 28, "val_end_day": 37}},
    "dev": {},
    "research": {"population": {"n_persons": 100_000, "n_merchants": 4_000, "n_atms": 800}, "family_defaults": {"max_instances": 150}},
}
KINDS = {"LogNormal": ("median", "sigma"), "Gamma": ("shape", "scale"), "Uniform": ("low", "high"), "ShiftedPoisson": ("shift", "mean"), "Beta": ("a", "b"), "Constant": ("value",), "Empirical": ("values", "weights")}


def merged(base: Mapping, overlay: Mapping, path: str = "") -> dict:
    """base with overlay's values; a key that base lacks raises, except inside of a distribution, which is replaced whole."""
    out = copy.deepcopy(dict(base))
    for k, v in overlay.items():
        if k not in out and path not in ("", "family_defaults"):
            raise ConfigError(f"unknown key {path}.{k}")
        if k not in out and not path and k not in BASE:
            raise ConfigError(f"unknown key {k}")
        if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) and "kind" not in v:
            out[k] = merged(out[k], v, f"{path}.{k}" if path else k)
        else:
            out[k] = copy.deepcopy(v)
    return out


def check_distribution(d: Mapping, where: str) -> None:
    if d.get("kind") not in KINDS or set(d) != {"kind", *KINDS[d["kind"]]}:
        raise ConfigError(f"{where}: not a distribution: {dict(d)}")
    positive = {"LogNormal": ("median",), "Gamma": ("shape", "scale"), "Beta": ("a", "b")}.get(d["kind"], ())
    if any(d[k] <= 0 for k in positive) or d.get("sigma", 0) < 0 or d.get("mean", 0) < 0:
        raise ConfigError(f"{where}: parameters out of range")
    if d["kind"] == "Uniform" and d["low"] > d["high"]:
        raise ConfigError(f"{where}: low is above high")
    if d["kind"] == "Empirical" and (not d["values"] or len(d["values"]) != len(d["weights"]) or min(d["weights"]) < 0 or sum(d["weights"]) <= 0):
        raise ConfigError(f"{where}: values and weights do not match")


class GeneratorConfig:
    """A checked configuration; `values` is the whole mapping."""

    def __init__(self, values: Mapping) -> None:
        v = self.values = copy.deepcopy(dict(values))
        rules = {
            "the anchor must be a Monday": date.fromisoformat(v["simulation"]["anchor"]).weekday() == 0,
            "at least 14 days": v["simulation"]["days"] >= 14,
            "archetype shares must add up to 1": abs(sum(a["share"] for a in v["archetypes"].values()) - 1) < 1e-9,
            "all archetypes and families must be there": set(v["archetypes"]) == set(BASE["archetypes"]) and set(v["families"]) == set(BASE["families"]),
            "sessions last from 5 seconds to the session window": 5 <= v["infrastructure"]["session_seconds"][0] <= v["infrastructure"]["session_seconds"][1] <= v["infrastructure"]["session_window"],
            "EXIT must be a high-risk phase": "EXIT" in v["high_risk_phases"],
            "instances must be in order": all(0 <= f["min_instances"] <= f["max_instances"] for f in v["families"].values()),
            "splits must be in order": 0 < v["splits"]["train_end_day"] < v["splits"]["val_end_day"] < v["simulation"]["days"],
            "each period must be longer than the longest horizon": self.h_max_days < min(v["splits"]["train_end_day"], v["splits"]["val_end_day"] - v["splits"]["train_end_day"], v["simulation"]["days"] - v["splits"]["val_end_day"]),
            "unknown pool method": v["splits"]["ref_pool_method"] in ("none_cell_hash", "stratified_archetype"),
            "unknown training mode": v["training"]["mode"] in ("include_immature", "mature_only"),
            "mature_only needs a maturity below the training period": v["training"]["mode"] != "mature_only" or v["training"]["maturity_days"] < v["splits"]["train_end_day"] - self.h_max_days,
            "the label latency must vary": v["labels"]["latency_days"].get("sigma", 1) > 0 and v["labels"]["latency_days"]["kind"] != "Constant",
            "shares must lie in [0, 1]": all(0 <= x <= 1 for x in (v["labels"]["never_known"], v["overdraft"]["share"], v["infrastructure"]["failed_login"], v["splits"]["ref_negative_fraction"])) and 0 < v["recruitment"]["eligible_share"] < 1,
        }
        for rule, holds in rules.items():
            if not holds:
                raise ConfigError(rule)
        for name, d in v["amounts"].items():
            if name != "atm":
                check_distribution(d, f"amounts.{name}")
        for name, f in v["families"].items():
            for k in ("fan", "amount", "start_day", "holding_hours"):
                check_distribution(f[k], f"families.{name}.{k}")
        check_distribution(v["labels"]["latency_days"], "labels.latency_days")

    def __getitem__(self, key: str):
        return self.values[key]

    @property
    def h_max_days(self) -> int:
        return -(-max(self.values["splits"]["horizons_hours"]) // 24)

    @property
    def days(self) -> int:
        return self.values["simulation"]["days"]

    @property
    def sim_end(self) -> int:
        return self.days * 86_400

    @property
    def seed(self) -> int:
        return self.values["simulation"]["seed"]

    def canonical_json(self) -> str:
        return json.dumps(self.values, sort_keys=True, separators=(",", ":"))

    def config_hash(self) -> str:
        return hashlib.sha256(self.canonical_json().encode()).hexdigest()


def load_config(profile: str = "dev", seed: int | None = None, overrides: Mapping | None = None, path: str | Path | None = None) -> GeneratorConfig:
    """Defaults, the profile, a YAML file and overrides, each over the one before; family_defaults apply to every family, then the families' own."""
    if profile not in PROFILES:
        raise ConfigError(f"unknown profile {profile}")
    layers = [PROFILES[profile]]
    if path is not None:
        import yaml

        read = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
        if not isinstance(read, Mapping):
            raise ConfigError(f"{path} is not a mapping")
        layers.append({k: v for k, v in read.items() if k != "_anchors"})
    layers += [dict(overrides or {}), {} if seed is None else {"simulation": {"seed": seed}}]
    values: dict = copy.deepcopy(BASE)
    for layer in layers:
        values = merged(values, layer)
    common = values.pop("family_defaults")
    own: dict = {}
    for layer in layers:
        for name, f in layer.get("families", {}).items():
            own.setdefault(name, {}).update(f)
    values["families"] = {n: merged(merged(f, common, "families"), own.get(n, {}), "families") for n, f in values["families"].items()}
    return GeneratorConfig(values)
