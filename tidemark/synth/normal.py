"""Population and normal behaviour: everything a column expression over persons and days, so any number of tasks can make it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.ids import event_id, packed
from tidemark.functions.timebase import DAY, HOUR, TimeBase
from tidemark.synth.config import GeneratorConfig
from tidemark.synth.draw import Draws

WORLD, CASH = 1, 2  # payloads of the external accounts that stand for all others and for cash
YEAR = 365 * DAY
EVENT = "event_id, person_id, ts, txn_type, channel, src_account_id, dst_account_id, merchant_id, atm_id, amount_minor, region, day, counter".split(", ")


@dataclass(frozen=True)
class Population:
    persons: DataFrame
    people: DataFrame  # persons with what behaviour needs
    tables: dict[str, DataFrame]
    externals: dict[str, tuple[int, int]]  # role: first payload and how many


def account_of(person: Column) -> Column:
    return packed(1, person)


def external(payload: Column | int) -> Column:
    return packed(2, payload if isinstance(payload, Column) else F.lit(payload).cast("bigint"))


def build_population(spark: SparkSession, cfg: GeneratorConfig, draw: Draws) -> Population:
    p, n = cfg["population"], cfg["population"]["n_persons"]
    if cfg.days > 128:
        raise ConfigError("event ids hold at most 128 days")
    mix, pid = cfg["archetypes"], F.col("person_id")
    people = spark.range(n).select(F.col("id").alias("person_id")).withColumns(
        {
            "archetype": draw.choice(list(mix), [a["share"] for a in mix.values()], "archetype", pid),
            "region": draw.integer(0, p["n_regions"] - 1, "region", pid).cast("smallint"),
            "household_id": draw.integer(0, max(0, round(n / p["household_size"]) - 1), "household", pid),
            "created_at": -draw.integer(1, 5 * YEAR, "created", pid),
        }
    )
    rate = {k: F.coalesce(*(F.when(F.col("archetype") == a, F.lit(float(v[k]))) for a, v in mix.items())) for k in next(iter(mix.values())) if k != "share"}
    people = people.withColumns(rate)
    limit = F.when(draw.uniform("overdraft", pid) < cfg["overdraft"]["share"], F.lit(cfg["overdraft"]["limit_minor"])).otherwise(0).cast("bigint")
    none = F.lit(None)
    own = people.select(
        account_of(pid).alias("account_id"), F.lit("internal").alias("account_kind"), none.cast("string").alias("external_role"), pid.alias("owner_person_id"), F.col("created_at").alias("opened_at"),
        none.cast("bigint").alias("closed_at"), limit.alias("overdraft_limit_minor"), F.round(draw.sample(cfg["amounts"]["opening"], "opening", pid)).cast("bigint").alias("initial_balance_minor"), "region",
    )
    roles = {"external_world": (WORLD, 1), "cash": (CASH, 1)}
    at = 10
    for role, key in (("employer", "n_employers"), ("biller", "n_billers"), ("landlord", "n_landlords"), ("card_network", "n_card_networks")):
        roles[role] = (at, p[key])
        at += p[key]
    outside = spark.createDataFrame([(first + i, role) for role, (first, k) in roles.items() for i in range(k)], "payload bigint, role string")
    others = outside.select(external(F.col("payload")).alias("account_id"), F.lit("external").alias("account_kind"), F.col("role").alias("external_role"), none.cast("bigint").alias("owner_person_id"), F.lit(-6 * YEAR).cast("bigint").alias("opened_at"), none.cast("bigint").alias("closed_at"), none.cast("bigint").alias("overdraft_limit_minor"), F.lit(0).cast("bigint").alias("initial_balance_minor"), none.cast("smallint").alias("region"))
    homes = people.groupBy("household_id").agg(F.min("region").alias("region"))
    devices = people.select(packed(1, pid).alias("device_id"), F.when(draw.uniform("tablet", pid) < 0.15, "tablet").otherwise("mobile").alias("device_kind"), F.col("created_at").alias("first_seen_at"))
    shared = homes.select(packed(2, F.col("household_id")).alias("device_id"), F.lit("desktop").alias("device_kind"), F.lit(-5 * YEAR).cast("bigint").alias("first_seen_at"))
    regions = spark.range(p["n_regions"]).select(F.col("id").alias("r"))
    ips = homes.select(packed(1, F.col("household_id")).alias("ip_id"), F.lit("household").alias("ip_context"), "region")
    for kind, context in ((2, "public_wifi"), (3, "corporate_nat"), (4, "mobile_cgnat")):
        ips = ips.unionByName(regions.select(packed(kind, F.col("r")).alias("ip_id"), F.lit(context).alias("ip_context"), F.col("r").cast("smallint").alias("region")))
    merchants = spark.range(p["n_merchants"]).select((F.col("id") * 7 + 10_007).alias("merchant_id"), draw.choice(["grocery", "fuel", "travel", "dining", "retail", "online"], [3, 1, 1, 2, 2, 1], "category", F.col("id")).alias("merchant_category"), (F.col("id") % p["n_regions"]).cast("smallint").alias("region"))
    atms = spark.range(p["n_atms"]).select((F.col("id") + 1).alias("atm_id"), (F.col("id") % p["n_regions"]).cast("smallint").alias("region"))
    edge = lambda kind, src, dst: people.select(F.lit(kind).alias("relation_type"), src.alias("src_id"), dst.alias("dst_id"), F.col("created_at").alias("valid_from"), F.lit(cfg.sim_end).cast("bigint").alias("valid_to"))
    relations = edge("OWNS_ACCOUNT", pid, account_of(pid)).unionByName(edge("CONTROLS", pid, packed(1, pid))).unionByName(edge("USES_IP", pid, packed(1, F.col("household_id"))))
    persons = people.select("person_id", "region", "household_id", "created_at")
    truth = people.select("person_id", "archetype", F.lit("normal").alias("origin"))
    tables = {"persons": persons, "accounts": own.unionByName(others), "devices": devices.unionByName(shared), "ips": ips, "atms": atms, "merchants": merchants, "relations": relations, "person_truth": truth}
    return Population(persons, people, tables, roles)


def _events(df: DataFrame, stream: int, seconds: Column, amount: Column, kind: str, channel: Column | str, src: Column, dst: Column, draw: Draws, k: Column | None = None, merchant: Column | None = None, atm: Column | None = None) -> DataFrame:
    """Rows of one stream. A person's counter holds stream, day and number, so ids do not depend on other streams."""
    none = F.lit(None).cast("bigint")
    counter = F.shiftleft(F.lit(stream), 19).bitwiseOR(F.shiftleft(F.col("day").cast("int"), 12)).bitwiseOR((k if k is not None else F.lit(0)).cast("int"))
    d = df.withColumn("counter", counter)
    return d.select(
        event_id(1, F.col("person_id"), F.col("counter")).alias("event_id"), "person_id", (F.col("day") * DAY + seconds).cast("bigint").alias("ts"), F.lit(kind).alias("txn_type"),
        (F.lit(channel) if isinstance(channel, str) else channel).alias("channel"), src.alias("src_account_id"), dst.alias("dst_account_id"), (merchant if merchant is not None else none).alias("merchant_id"),
        (atm if atm is not None else none).alias("atm_id"), F.greatest(F.round(amount).cast("bigint"), F.lit(1)).alias("amount_minor"), "region", F.col("day").cast("int").alias("day"), "counter",
    )


def trip(cfg: GeneratorConfig, draw: Draws, person: Column, day: Column) -> tuple[Column, Column]:
    """Whether a person is away on a day, and the region of their trip; both follow from the person's id."""
    mix, share = cfg["archetypes"], F.lit(0.0)
    archetype = draw.choice(list(mix), [a["share"] for a in mix.values()], "archetype", person)
    for name, v in mix.items():
        share = F.when(archetype == name, F.lit(float(v["travel"]))).otherwise(share)
    first = draw.integer(0, cfg.days - 1, "trip/from", person)
    away = (draw.uniform("trip", person) < share) & day.between(first, first + draw.integer(2, 8, "trip/days", person))
    return away, draw.integer(0, cfg["population"]["n_regions"] - 1, "trip/region", person).cast("smallint")


def normal_transactions(spark: SparkSession, cfg: GeneratorConfig, pop: Population, draw: Draws) -> DataFrame:
    """All streams of all persons, without what a dormant spell takes out."""
    a, p = cfg["amounts"], cfg["population"]
    pid, day, u = F.col("person_id"), F.col("day"), draw.uniform
    mine = account_of(pid)
    base = TimeBase(date.fromisoformat(cfg["simulation"]["anchor"]), cfg.days)
    calendar = F.broadcast(spark.createDataFrame([(d, dom) for dom in range(1, 29) for d in base.monthly_days([dom])], "day bigint, dom int"))  # at most 128 days
    spine = pop.people.withColumn("day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.days - 1).cast("bigint"))))
    away, there = trip(cfg, draw, pid, day)
    spine = spine.withColumn("away", away).withColumn("region", F.when(F.col("away"), there).otherwise(F.col("region")))

    def monthly(name: str, people: DataFrame, *ids: Column) -> DataFrame:
        return people.withColumn("dom", draw.integer(1, 28, f"{name}/dom", pid, *ids).cast("int")).join(calendar, "dom")

    def of(role: str, name: str, *ids: Column) -> Column:
        first, n = pop.externals[role]
        return external(draw.integer(first, first + n - 1, name, *ids))

    def at(low: float, high: float, name: str, *ids: Column) -> Column:
        return F.floor((low + u(name, pid, day, *ids) * (high - low)) * HOUR)

    def count(rate: str, name: str, times: float = 1.0) -> Column:
        return draw.poisson_by(F.col("archetype"), {a: v[rate] * times for a, v in cfg["archetypes"].items()}, name, pid, day)

    def several(df: DataFrame, n: Column) -> DataFrame:
        return df.withColumn("n", n).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))

    k = F.col("k")
    paid = monthly("income", pop.people).filter(F.col("income") > 0)
    base_pay = draw.sample(a["income"], "income/base", pid) * F.col("income")
    employer_person = draw.integer(0, p["n_persons"] - 1, "employer/person", pid)
    inside = (u("employer/inside", pid) < 0.1) & (employer_person != pid)
    pay = base_pay * (0.97 + 0.06 * u("income/wobble", pid, day))
    streams = [
        _events(paid.filter(~inside), 1, at(6, 8, "income/at"), pay, "INBOUND_CREDIT", "INBOUND_EXTERNAL", of("employer", "employer", pid), mine, draw),
        _events(paid.filter(inside), 1, at(6, 8, "income/at"), pay, "TRANSFER", "SCHEDULED", account_of(employer_person), mine, draw),
        _events(monthly("rent", pop.people.filter(u("rents", pid) < 0.4)), 2, at(5, 7, "rent/at"), draw.sample(a["rent"], "rent", pid), "OUTBOUND_PAYMENT", "SCHEDULED", mine, of("landlord", "landlord", pid), draw),
    ]
    bills = pop.people.withColumn("k", F.explode(F.sequence(F.lit(1), draw.integer(1, 3, "bills", pid).cast("int"))))
    streams.append(_events(monthly("bill", bills, k), 3, at(3, 6, "bill/at", k), draw.sample(a["bill"], "bill", pid, k) * (0.9 + 0.2 * u("bill/wobble", pid, day, k)), "OUTBOUND_PAYMENT", "SCHEDULED", mine, of("biller", "biller", pid, k), draw, k))
    burst_from = draw.integer(0, cfg.days - 1, "surge/from", pid)
    surging = (u("surge", pid) < F.col("surge")) & day.between(burst_from, burst_from + 9)
    cards = several(spine, F.when(surging, count("card_daily", "card", 4.0)).otherwise(count("card_daily", "card")))
    hour = F.when(u("card/night", pid, day, k) < F.col("p_night"), 5 * u("card/at", pid, day, k)).otherwise(8 + 14 * u("card/at", pid, day, k))
    favourite = u("card/favourite", pid, day, k) < 0.5
    local = F.floor(u("merchant/local", pid, day, k) * (p["n_merchants"] // p["n_regions"])) * p["n_regions"] + F.col("region")
    usual = draw.integer(0, p["n_merchants"] - 1, "favourite", pid, draw.integer(0, 3, "which", pid, day, k))
    merchant = F.when(F.col("away"), local).when(favourite, usual).otherwise(F.floor(F.pow(u("merchant", pid, day, k), 3) * p["n_merchants"])) * 7 + 10_007
    streams.append(_events(cards, 4, F.floor(hour * HOUR), draw.sample(a["card"], "card/amount", pid, day, k), "CARD_PAYMENT", "POS", mine, of("card_network", "network", pid, day, k), draw, k, merchant=merchant.cast("bigint")))
    atm = a["atm"]
    notes = F.least(F.lit(atm["most"]), F.greatest(F.lit(atm["step"]), F.round(atm["median"] * F.exp(draw.normal("atm/amount", pid, day, k) * atm["sigma"]) / atm["step"]) * atm["step"]))
    streams.append(_events(several(spine, count("atm_weekly", "atm", 1 / 7)), 5, at(7, 23, "atm/at", k), notes, "ATM_WITHDRAWAL", "ATM", mine, external(CASH), draw, k, atm=draw.integer(1, p["n_atms"], "atm/which", pid, day, k)))
    digital = F.when(u("channel", pid, day, k) < 0.7, "APP").otherwise("WEB")
    friend = draw.integer(0, p["n_persons"] - 1, "contact", pid, draw.integer(0, 4, "friend", pid, day, k))
    p2p = several(spine, count("p2p_monthly", "p2p", 1 / 30)).filter(friend != pid)
    streams.append(_events(p2p, 6, at(8, 23, "p2p/at", k), draw.sample(a["p2p"], "p2p/amount", pid, day, k), "TRANSFER", digital, mine, account_of(friend), draw, k))
    trade = spine.filter(F.col("customers_daily") > 0).withColumn("n", count("customers_daily", "customers")).filter("n > 0")
    streams.append(_events(trade, 7, at(23, 23.5, "batch/at"), draw.sample(a["business"], "batch", pid, day) * F.col("n") * 0.9, "INBOUND_CREDIT", "INBOUND_EXTERNAL", external(WORLD), mine, draw))
    customers = several(spine.filter(F.col("customers_daily") > 0), count("customers_daily", "customer", 0.1))
    customers = customers.withColumn("business", mine).withColumn("person_id", draw.integer(0, p["n_persons"] - 1, "customer/who", pid, day, k)).filter(F.col("business") != account_of(F.col("person_id")))
    # The customer's counter must not meet another business's, so the business is hashed into the number.
    number = F.pmod(F.xxhash64("business", "day", "k"), F.lit(2_048)).cast("int")
    sold = _events(customers, 8, F.floor((8 + 13 * u("customer/at", F.col("business"), day, k)) * HOUR), draw.sample(a["business"], "customer/amount", F.col("business"), day, k), "TRANSFER", F.when(u("customer/channel", F.col("business"), day, k) < 0.7, "APP").otherwise("WEB"), account_of(F.col("person_id")), F.col("business"), draw, number)
    streams.append(sold.dropDuplicates(["event_id"]))
    suppliers = several(spine.filter(F.col("suppliers_daily") > 0), count("suppliers_daily", "supplier"))
    streams.append(_events(suppliers, 9, at(9, 18, "supplier/at", k), draw.sample(a["business"], "supplier/amount", pid, day, k) * 2, "OUTBOUND_PAYMENT", "WEB", mine, external(WORLD), draw, k))
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return awake(out, cfg, pop, draw)


def dormant_days(cfg: GeneratorConfig, draw: Draws, person: Column) -> tuple[Column, Column, Column]:
    """Whether a person has a dormant spell, and its first and last day."""
    start = draw.integer(0, cfg.days - 1, "dormant/from", person)
    return draw.uniform("dormant", person), start, start + draw.integer(10, 30, "dormant/days", person)


def awake(events: DataFrame, cfg: GeneratorConfig, pop: Population, draw: Draws) -> DataFrame:
    """events without those of a dormant spell; the spell follows from the person's id, so nothing but the archetype's share is looked up."""
    pid = F.col("person_id")
    mix = cfg["archetypes"]
    share = F.lit(0.0)
    archetype = draw.choice(list(mix), [a["share"] for a in mix.values()], "archetype", pid)
    for name, v in mix.items():
        share = F.when(archetype == name, F.lit(float(v["dormancy"]))).otherwise(share)
    u, first, last = dormant_days(cfg, draw, pid)
    return events.filter(~((u < share) & F.col("day").between(first, last)))


def session_logins(digital: DataFrame, cfg: GeneratorConfig, draw: Draws, namespace: int = 2) -> DataFrame:
    """Digital events with the login they follow: login_event_id, login_ts, device_id and ip_id."""
    i = cfg["infrastructure"]
    pid, e = F.col("person_id"), F.col("event_id")
    household = draw.integer(0, max(0, round(cfg["population"]["n_persons"] / cfg["population"]["household_size"]) - 1), "household", pid)
    personal = draw.uniform("device", e) < i["personal_device"]
    hour = F.floor(F.pmod(F.col("ts"), F.lit(DAY)) / HOUR)
    office = (F.pmod(F.col("day"), F.lit(7)) < 5) & hour.between(9, 16)
    away, there = trip(cfg, draw, pid, F.col("day"))
    region = F.when(away, there).otherwise(F.col("region")).cast("bigint")
    ip = F.when(away, F.when(draw.uniform("ip", e) < 0.6, packed(2, region)).otherwise(packed(4, region))).when(personal & (draw.uniform("ip", e) < 0.4), packed(4, region)).when(~personal & office & (draw.uniform("ip", e) < 0.5), packed(3, region)).when(draw.uniform("ip/wifi", e) < 0.05, packed(2, region)).otherwise(packed(1, household))
    return digital.withColumns(
        {
            "login_event_id": event_id(namespace, pid, F.col("counter")),
            "login_ts": F.greatest(F.col("ts") - draw.integer(*i["session_seconds"], "session", e), F.lit(0).cast("bigint")),
            "device_id": F.when(personal | away, packed(1, pid)).otherwise(packed(2, household)),
            "ip_id": ip,
        }
    )


def login_rows(with_logins: DataFrame, cfg: GeneratorConfig, draw: Draws) -> DataFrame:
    """Rows of the logins table for session_logins: the successful one, and sometimes a failure just before."""
    e = F.col("login_event_id")
    ok = with_logins.select(e.alias("event_id"), F.col("login_ts").alias("ts"), account_of(F.col("person_id")).alias("account_id"), "device_id", "ip_id", "channel", F.lit("SUCCESS").alias("outcome"))
    failed = with_logins.filter((draw.uniform("failed", e) < cfg["infrastructure"]["failed_login"]) & (F.col("login_ts") >= 60))
    # Numbers of a stream stay below 2 048, so this bit marks the failure.
    bad = failed.select(e.bitwiseOR(F.lit(2_048).cast("bigint")).alias("event_id"), (F.col("login_ts") - draw.integer(5, 59, "failed/before", e)).alias("ts"), account_of(F.col("person_id")).alias("account_id"), "device_id", "ip_id", "channel", F.lit("FAILURE").alias("outcome"))
    return ok.unionByName(bad)


def browsing(spark: SparkSession, cfg: GeneratorConfig, pop: Population, draw: Draws) -> DataFrame:
    """Logins without a transaction, in the form of session_logins."""
    pid, day = F.col("person_id"), F.col("day")
    spine = pop.people.withColumn("day", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(cfg.days - 1).cast("bigint"))))
    count = draw.poisson_by(F.col("archetype"), {a: v["browse_daily"] for a, v in cfg["archetypes"].items()}, "browse", pid, day)
    n = spine.withColumn("n", count).filter("n > 0").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    seconds = F.floor((7 + 16.5 * draw.uniform("browse/at", pid, day, F.col("k"))) * HOUR)
    rows = _events(n, 10, seconds, F.lit(1), "TRANSFER", F.when(draw.uniform("browse/channel", pid, day, F.col("k")) < 0.7, "APP").otherwise("WEB"), account_of(pid), account_of(pid), draw, F.col("k"))
    return session_logins(awake(rows, cfg, pop, draw), cfg, draw)
