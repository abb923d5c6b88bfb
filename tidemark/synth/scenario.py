"""Planned activity of abstract pattern families, for labelled data: recruitment, plans and their labels."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.ids import pack, scenario_payload
from tidemark.functions.ids import network_id as network_of
from tidemark.functions.timebase import DAY, HOUR
from tidemark.operators.splits import rendezvous_partition
from tidemark.synth.config import GeneratorConfig
from tidemark.synth.draw import Draws
from tidemark.synth.normal import CASH, WORLD

# The numbers of the families in ids, from 1.
FAMILIES = ("fan_in", "fan_out", "pass_through", "burst", "dormant_activation", "multi_hop", "cycle", "structuring_like", "shared_infrastructure", "account_to_cash")
PHASES = ("SETUP", "INFLOW", "HOLD", "MOVEMENT", "EXIT", "INACTIVE")


def rng_of(seed: int, *path) -> np.random.Generator:
    """A generator of its own for each named thing."""
    key = hashlib.blake2b("/".join(map(str, (seed, *path))).encode(), digest_size=16).digest()
    return np.random.default_rng(int.from_bytes(key, "big"))


def value_of(d: Mapping, rng: np.random.Generator) -> float:
    kind = d["kind"]
    if kind == "LogNormal":
        return d["median"] * math.exp(d["sigma"] * rng.standard_normal())
    if kind == "Gamma":
        return rng.gamma(d["shape"], d["scale"])
    if kind == "Uniform":
        return rng.uniform(d["low"], d["high"])
    if kind == "ShiftedPoisson":
        return d["shift"] + rng.poisson(d["mean"])
    if kind == "Beta":
        return rng.beta(d["a"], d["b"])
    if kind == "Constant":
        return d["value"]
    return rng.choice(d["values"], p=np.asarray(d["weights"]) / sum(d["weights"]))


def slots(family: str, fan: int, hops: int) -> list[tuple[str, str, bool]]:
    """(slot, role, created) of a network's members; created ones have accounts of the scenario's own."""
    receiver = ("FUND_RECEIVER", False)
    out = {
        "fan_in": [("aggregator", "AGGREGATOR", False), ("cashout", "CASH_OUT_RISK", True)] + [(f"victim{i}", "VICTIM_LIKE", False) for i in range(fan)],
        "fan_out": [("distributor", "DISTRIBUTOR", False)] + [(f"receiver{i}", *receiver) for i in range(fan)],
        "burst": [("distributor", "DISTRIBUTOR", False)] + [(f"receiver{i}", *receiver) for i in range(fan)],
        "pass_through": [("relay", "RELAY", False)],
        "dormant_activation": [("dormant", "FUND_RECEIVER", False)] + [(f"receiver{i}", *receiver) for i in range(min(2, fan))],
        "multi_hop": [(f"relay{i}", "RELAY", i % 2 == 1) for i in range(max(2, hops))] + [("cashout", "CASH_OUT_RISK", True)],
        "cycle": [(f"ring{i}", "RELAY", False) for i in range(max(3, fan))],
        "structuring_like": [("aggregator", "AGGREGATOR", False)],
        "shared_infrastructure": [("aggregator", "AGGREGATOR", True)] + [(f"member{i}", "SUSPICIOUS_UNKNOWN", False) for i in range(fan)],
        "account_to_cash": [("receiver", "FUND_RECEIVER", False)],
    }
    return out[family]


def instances(cfg: GeneratorConfig) -> list[dict]:
    """The networks to plan, in a fixed order of families and numbers.

    Each family has a quota of members, its weight's share of the target prevalence; families with max_instances 0 have
    none. Its instances are taken as long as they are fewer than min_instances or bring it closer to its quota. A family
    that reaches max_instances and is still further below its quota than half an instance raises ConfigError.
    """
    quota = cfg["recruitment"]["target_prevalence"] * cfg["population"]["n_persons"] / sum(f["weight"] for f in cfg["families"].values())
    made = []
    for code, family in enumerate(FAMILIES, 1):
        f = cfg["families"][family]
        total = last = 0
        for i in range(f["max_instances"]):
            rng = rng_of(cfg.seed, "instance", family, i)
            fan, hops = max(1, int(value_of(f["fan"], rng))), int(f["hops"])
            last = len(slots(family, fan, hops))
            if i >= f["min_instances"] and total + last / 2 > quota * f["weight"]:
                break
            total += last
            start = int(min(max(value_of(f["start_day"], rng), 1), cfg.days - 10) * DAY + rng.integers(8 * HOUR, 18 * HOUR))
            made.append({"regions": cfg["population"]["n_regions"], "family": family, "code": code, "idx": i, "fan": fan, "hops": hops, "rounds": int(f["rounds"]), "ood": bool(f["ood"]), "exit": f["exit"], "start": start, "amount": int(value_of(f["amount"], rng)) + 100, "holding": int(value_of(f["holding_hours"], rng) * HOUR) + HOUR, "retention": int(rng.integers(200, 800)), "forward": int(rng.integers(700, 980))})
        else:
            if f["max_instances"] and quota * f["weight"] - total > max(1, last) / 2:
                raise ConfigError(f"{family}: max_instances reached with {total} members of a quota of {quota * f['weight']:.1f}")
    return made


PLAN = (
    "what string, network_id bigint, no int, ts bigint, txn_type string, channel string, src_account_id bigint, dst_account_id bigint, amount_minor bigint, depends_on int, phase string, event_type string, "
    "account_id bigint, role string, valid_to bigint, is_created boolean, cash boolean, login_no int, device_id bigint, ip_id bigint"
)
SCENARIO_DEVICE, SCENARIO_IP, PERSONAL_DEVICE, MOBILE_IP = 3, 5, 1, 4  # kinds in ids


def plan_network(i: Mapping, members: Mapping[str, int], seed: int, sim_end: int) -> list[dict]:
    """Events, logins, intervals and members of one network; `members` gives each slot's account.

    About half of the transfers are digital and follow a login of their account within the session window, the others
    are scheduled. In shared_infrastructure all members first log in from one device and one IP of the network's own,
    in a SETUP phase, and all of their transfers come from there.
    """
    rng, net, family = rng_of(seed, "plan", i["family"], i["idx"]), network_of(i["code"], i["idx"]), i["family"]
    world, cash = pack(2, WORLD), pack(2, CASH)
    rows: list[dict] = []
    roles = {name: role for name, role, _ in slots(family, i["fan"], i["hops"])}
    fresh = {name: created for name, _, created in slots(family, i["fan"], i["hops"])}
    created = {account for name, account in members.items() if fresh[name]}
    funded: dict[int, int] = {}
    t = i["start"]

    own_device, own_ip = pack(SCENARIO_DEVICE, scenario_payload(i["code"], i["idx"], 0xFFFF)), pack(SCENARIO_IP, scenario_payload(i["code"], i["idx"], 0xFFFF))
    shared = family == "shared_infrastructure"

    def login(phase: str, ts: int, account: int, channel: str, what: str) -> dict:
        """A planned login; created accounts and shared ones use the network's device, others that of their person."""
        own = shared or account in created
        device = own_device if own else pack(PERSONAL_DEVICE, account & (1 << 48) - 1)
        ip = own_ip if own else pack(MOBILE_IP, account % i.get("regions", 1))
        rows.append({"what": "login", "no": sum(r["what"] == "login" for r in rows), "ts": ts, "account_id": account, "channel": channel, "phase": phase, "event_type": what, "device_id": device, "ip_id": ip})
        return rows[-1]

    def event(phase: str, kind: str, channel: str, src: int, dst: int, amount: float, what: str, is_cash: bool = False) -> None:
        """A planned transaction; one of a member depends on the last money that came to it."""
        nonlocal t
        t += int(rng.integers(1_800, 6 * HOUR))
        if t >= sim_end or src == dst:
            return
        entry = {}
        if channel in ("APP", "WEB"):
            entry = login(phase, t - int(rng.integers(20, 1_200)), src, channel, "LOGIN")
        no = sum(r["what"] == "event" for r in rows)
        rows.append({"what": "event", "login_no": entry.get("no"), "device_id": entry.get("device_id"), "ip_id": entry.get("ip_id"), "no": no, "ts": t, "txn_type": kind, "channel": channel, "src_account_id": src, "dst_account_id": dst, "amount_minor": max(1, int(amount)), "depends_on": funded.get(src), "phase": phase, "event_type": what, "cash": is_cash})
        funded[dst] = no

    def interval(phase: str, start: int, end: int) -> None:
        for name, account in members.items():
            if start < min(end, sim_end):
                rows.append({"what": "interval", "account_id": account, "role": roles[name], "phase": phase, "ts": start, "valid_to": min(end, sim_end)})

    def transfer(phase: str, src: str, dst: str, amount: float, what: str = "TRANSFER_FUNDS") -> None:
        draw = rng.random()
        channel = "APP" if shared or draw < 0.35 else "WEB" if draw < 0.5 else "SCHEDULED"
        event(phase, "TRANSFER", channel, members[src], members[dst], amount, what)

    names = list(members)
    victims = [n for n in names if n.startswith("victim")]
    main = next(n for n in names if n not in victims)
    begin = t
    if shared:
        took = int(rng.integers(2 * HOUR, 12 * HOUR))
        for account, ts in zip(members.values(), sorted(int(x) for x in rng.integers(t, t + took, len(members))), strict=True):
            if ts < sim_end:
                login("SETUP", ts, account, "APP", "NEW_DEVICE_LOGIN")
        interval("SETUP", t, t + took)
        t += took
    for _ in range(i["rounds"]):
        inflow = t
        for n in range(i["fan"] if family in ("fan_in", "fan_out", "burst", "shared_infrastructure") else 1):
            amount = i["amount"] * (rng.uniform(0.8, 1.0) if family == "structuring_like" else rng.uniform(0.85, 1.15))
            if victims:
                transfer("INFLOW", victims[int(rng.integers(len(victims)))], main, amount, "RECEIVE_FUNDS")
            elif family == "shared_infrastructure":
                event("INFLOW", "INBOUND_CREDIT", "INBOUND_EXTERNAL", world, members[names[1 + n % (len(names) - 1)]], amount, "RECEIVE_FUNDS")
            else:
                event("INFLOW", "INBOUND_CREDIT", "INBOUND_EXTERNAL", world, members[main], amount, "RECEIVE_FUNDS")
        interval("INFLOW", inflow, t + 1)
        held = t + 1
        t += i["holding"] // i["rounds"]
        interval("HOLD", held, t + 1)
    moving, part = t, i["amount"] * i["forward"] / 1_000
    if family == "fan_in":
        transfer("MOVEMENT", "aggregator", "cashout", part)
    elif family in ("fan_out", "burst", "dormant_activation"):
        receivers = [n for n in names if n.startswith("receiver")]
        for r in receivers:
            transfer("MOVEMENT", main, r, part / len(receivers) * rng.uniform(0.85, 1.15), "MULTI_TRANSFER")
    elif family == "multi_hop":
        for a, b in zip(names, names[1:], strict=False):
            transfer("MOVEMENT", a, b, part)
            part *= i["forward"] / 1_000
    elif family == "cycle":
        for step in range(max(1, i["hops"]) * len(names)):
            transfer("MOVEMENT", names[step % len(names)], names[(step + 1) % len(names)], part * 0.98**step)
    elif family == "shared_infrastructure":
        for m in names[1:]:
            transfer("MOVEMENT", m, "aggregator", part / max(1, len(names) - 1))
    interval("MOVEMENT", moving, t + 1)
    leaving = t
    holders = [n for n in names if n in ("cashout", "aggregator") or n.startswith("receiver")] or [names[-1]]
    last = "cashout" if "cashout" in names else None
    for n in [last] if last else holders:
        out = part / (1 if last else len(holders)) * 0.95
        if i["exit"] == "atm":
            event("EXIT", "ATM_WITHDRAWAL", "ATM", members[n], cash, max(1_000, out // 1_000 * 1_000), "ATM_WITHDRAWAL", True)
        else:
            event("EXIT", "OUTBOUND_PAYMENT", "SCHEDULED", members[n], world, out, "OTHER")
    interval("EXIT", leaving, t + 1)
    for name, account in members.items():
        rows.append({"what": "member", "account_id": account, "role": roles[name], "ts": begin, "is_created": fresh[name]})
    for r in rows:
        r["network_id"] = net
    return rows


def recruits(i: Mapping) -> int:
    """How many accounts an instance takes from its cell."""
    return sum(not created for _, _, created in slots(i["family"], i["fan"], i["hops"]))


def cell_names(made: list[dict]) -> list[str]:
    """The names of the instances' cells of accounts."""
    return [f"{i['family']}/{i['idx']}" for i in made]


def plans(spark: SparkSession, cfg: GeneratorConfig, accounts: DataFrame, draw: Draws) -> tuple[DataFrame, list[dict]]:
    """All plan rows, and the instances. Accounts fall into one cell per instance or none; a network recruits from its own cell only, so another network changes nothing in it."""
    made = instances(cfg)
    cells = rendezvous_partition(accounts, cell_names(made), 1 - cfg["recruitment"]["eligible_share"], f"recruit/{cfg.seed}")
    order = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(cfg.seed), "account_id"), "account_id")
    needed = F.element_at(F.array(*(F.lit(recruits(i)) for i in made)), F.col("cell") + 1)
    ranked = cells.filter("cell >= 0").withColumn("no", F.row_number().over(order) - 1).filter(F.col("no") < needed)
    seed, end = cfg.seed, cfg.sim_end

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(PLAN))

    def run(candidates: pa.Table) -> pa.Table:
        d = candidates.sort_by("no").to_pydict()
        i = made[d["cell"][0]]
        pool, members, created = iter(d["account_id"]), {}, 0
        for name, _, fresh in slots(i["family"], i["fan"], i["hops"]):
            if fresh:
                members[name] = pack(3, scenario_payload(i["code"], i["idx"], created))
                created += 1
            else:
                members[name] = next(pool)
        return pa.Table.from_pylist(plan_network(i, members, seed, end), schema=shape)

    found = {r[0]: r[1] for r in ranked.groupBy("cell").agg(F.count(F.lit(1))).collect()}  # a row per instance
    if lacking := [name for c, (name, i) in enumerate(zip(cell_names(made), made, strict=True)) if found.get(c, 0) < recruits(i)]:
        raise ConfigError(f"too few accounts for {lacking[:5]}; more persons or fewer instances are needed")
    return ranked.groupBy("cell").applyInArrow(lambda t: run(t), PLAN), made
