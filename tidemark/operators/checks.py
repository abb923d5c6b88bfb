"""Data-quality checks. Each gives its violations as rows (problem, and what identifies the row); run_checks raises."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvariantViolation
from tidemark.functions.timebase import day_of
from tidemark.operators.sides import SETTLED, along, order_number, sides

Tables = Mapping[str, DataFrame]

# Channels that each transaction type may use, those that need a login, and columns that a type needs.
ALLOWED = {
    "TRANSFER": ("APP", "WEB", "SCHEDULED"),
    "CARD_PAYMENT": ("POS",),
    "ATM_WITHDRAWAL": ("ATM",),
    "INBOUND_CREDIT": ("INBOUND_EXTERNAL",),
    "OUTBOUND_PAYMENT": ("SCHEDULED", "APP", "WEB"),
}
DIGITAL = ("APP", "WEB")
NEEDED = {"CARD_PAYMENT": "merchant_id", "ATM_WITHDRAWAL": "atm_id"}


def _problems(df: DataFrame, key: list[str], cases: Mapping[str, Column]) -> DataFrame:
    """A row per case that holds for a row of df; one pass."""
    found = F.filter(F.array(*(F.when(c, F.lit(name)) for name, c in cases.items())), lambda x: x.isNotNull())
    return df.select(F.explode(found).alias("problem"), *key)


def schema_no_currency(t: Tables) -> DataFrame:
    bad = [(name,) for name, df in t.items() if "currency" in df.columns]
    spark = next(iter(t.values())).sparkSession
    return spark.createDataFrame(bad, "table string").select(F.lit("currency column").alias("problem"), "table")


def timestamps(t: Tables, sim_end: int) -> DataFrame:
    """ts in [0, sim_end), event ids used once, and not in both event tables."""
    both = t["transactions"].select("event_id", "ts", F.lit("transactions").alias("of")).unionByName(t["logins"].select("event_id", "ts", F.lit("logins").alias("of")))
    outside = both.filter((F.col("ts") < 0) | (F.col("ts") >= sim_end)).select(F.lit("ts outside of the horizon").alias("problem"), "event_id")
    used = both.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("of").alias("tables"))
    return outside.unionByName(used.filter("n > 1 AND tables = 1").select(F.lit("event id used twice").alias("problem"), "event_id")).unionByName(used.filter("tables > 1").select(F.lit("event id in both tables").alias("problem"), "event_id"))


def amounts_and_channels(t: Tables) -> DataFrame:
    c, kind = F.col, F.col("txn_type")
    channel = F.lit(False)
    for name, channels in ALLOWED.items():
        channel = channel | ((kind == name) & ~c("channel").isin(*channels))
    cases = {"amount not positive": c("amount_minor") <= 0, "to itself": c("src_account_id") == c("dst_account_id"), "channel not allowed": channel, "unknown status": ~c("status").isin("SETTLED", "DECLINED"), "unknown type": ~kind.isin(*ALLOWED)}
    cases |= {f"{name} without {needed}": (kind == name) & c(needed).isNull() for name, needed in NEEDED.items()}
    return _problems(t["transactions"], ["event_id"], cases)


def login_references(t: Tables, session_window: int) -> DataFrame:
    """Digital transactions follow a successful login of the same account, device, IP and channel within the window; others have none."""
    logins = t["logins"].select(*(F.col(x).alias(f"l_{x}") for x in ("event_id", "ts", "account_id", "device_id", "ip_id", "channel", "outcome")))
    c = F.col
    digital = c("channel").isin(*DIGITAL)
    refs = [c("login_event_id"), c("device_id"), c("ip_id")]
    # Only rows with a reference are sent to the logins; the many others have nothing to look up.
    looked = t["transactions"].filter(digital & c("login_event_id").isNotNull()).join(logins, c("login_event_id") == c("l_event_id"), "left")
    mismatch = c("l_ts").isNull() | (c("l_outcome") != "SUCCESS") | (c("l_account_id") != c("src_account_id")) | (c("l_device_id") != c("device_id")) | (c("l_ip_id") != c("ip_id")) | (c("l_channel") != c("channel")) | (c("l_ts") > c("ts")) | (c("ts") - c("l_ts") > session_window)
    own = _problems(t["transactions"], ["event_id"], {"reference on other channel": ~digital & F.coalesce(*refs).isNotNull(), "digital without reference": digital & (refs[0].isNull() | refs[1].isNull() | refs[2].isNull())})
    return own.unionByName(looked.filter(mismatch).select(F.lit("no matching login").alias("problem"), "event_id"))


def accounts_open(t: Tables) -> DataFrame:
    ends = t["transactions"].select("event_id", "ts", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src_account_id").alias("account_id")), F.struct(F.lit("dst").alias("side"), F.col("dst_account_id").alias("account_id")))).alias("e"))
    j = ends.select("event_id", "ts", "e.*").join(t["accounts"].select("account_id", "opened_at"), "account_id", "left")
    return _problems(j, ["event_id"], {"unknown account": F.col("opened_at").isNull(), "before the account was opened": F.col("ts") < F.col("opened_at")})


def _ledger(t: Tables, kinds: tuple[str, ...]) -> DataFrame:
    known = t["accounts"].filter(F.col("account_kind").isin(*kinds)).select("account_id", "account_kind", "initial_balance_minor", "overdraft_limit_minor")
    return sides(t["transactions"]).join(known, "account_id")


def balances(t: Tables, kinds: tuple[str, ...] = ("internal", "external")) -> DataFrame:
    """Arithmetic of each side, the chain from one event to the next, a recomputation from the initial balance, and overdraft limits."""
    led = along(_ledger(t, kinds), sums={"total": "delta"}, lasts={"prev": F.col("after")})
    prev = F.coalesce("prev", "initial_balance_minor")
    c = F.col
    return _problems(
        led,
        ["event_id", "account_id"],
        {
            "after is not before and what moved": c("after") != c("before") + c("delta"),
            "differs from the recomputed balance": c("after") != c("initial_balance_minor") + c("total"),
            "breaks the chain": c("before") != prev,
            "below the overdraft limit": (c("account_kind") == "internal") & (c("after") < -c("overdraft_limit_minor")),
        },
    )


def daily_drift(t: Tables, days: int, kinds: tuple[str, ...] = ("internal", "external")) -> DataFrame:
    """(day, drift): how far the recorded balances of all accounts together are from their initial total after each day."""
    led = _ledger(t, kinds).withColumn("day", day_of("ts"))
    closing = led.groupBy("account_id", "day", "initial_balance_minor").agg(F.max_by("after", order_number()).alias("closing"))
    step = F.col("closing") - F.coalesce(F.lag("closing").over(Window.partitionBy("account_id").orderBy("day")), F.col("initial_balance_minor"))
    per_day = closing.withColumn("step", step).groupBy("day").agg(F.sum("step").alias("step"))
    spine = t["accounts"].sparkSession.range(days).select(F.col("id").alias("day"))
    running = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per day
    return spine.join(per_day, "day", "left").select("day", F.coalesce(F.sum("step").over(running), F.lit(0)).alias("drift"))


def conservation(t: Tables, days: int) -> DataFrame:
    return daily_drift(t, days).filter("drift != 0").select(F.lit("total drifts").alias("problem"), "day")


def labels(t: Tables) -> DataFrame:
    """Intervals are not empty, of one network per account, without overlap, with one known_at per network that is set exactly for detected networks."""
    lab = t["labels"]
    mine = lab.filter("entity_type = 'account'")
    empty = lab.filter("valid_to <= valid_from").select(F.lit("empty interval").alias("problem"), F.col("entity_id").alias("id"))
    many = mine.groupBy("entity_id").agg(F.countDistinct("network_id").alias("n")).filter("n > 1").select(F.lit("several networks").alias("problem"), F.col("entity_id").alias("id"))
    before = F.lag("valid_to").over(Window.partitionBy("entity_id").orderBy("valid_from", "valid_to", "scenario_id"))
    overlap = mine.withColumn("before", before).filter("valid_from < before").select(F.lit("overlap").alias("problem"), F.col("entity_id").alias("id"))
    known = lab.groupBy("network_id").agg((F.countDistinct("known_at") + F.max(F.col("known_at").isNull().cast("int"))).alias("n"), F.max("known_at").alias("known_at"))
    uneven = known.filter("n > 1").select(F.lit("known_at differs").alias("problem"), F.col("network_id").alias("id"))
    detected = t["ground_truth_networks"].filter("detected != (known_at IS NOT NULL)").select(F.lit("detected without known_at or the reverse").alias("problem"), F.col("network_id").alias("id"))
    return empty.unionByName(many).unionByName(overlap).unionByName(uneven).unionByName(detected)


def event_labels(t: Tables) -> DataFrame:
    """Labelled events exist, a network has at most one terminal event and it is at terminal_ts, and high risk is a matter of phase."""
    ev = t["event_labels"]
    events = t["transactions"].select(F.lit("transactions").alias("event_table"), "event_id", "ts").unionByName(t["logins"].select(F.lit("logins").alias("event_table"), "event_id", "ts"))
    missing = ev.join(events, ["event_table", "event_id"], "left_anti").select(F.lit("labelled event is missing").alias("problem"), F.col("event_id").alias("id"))
    last = ev.filter("is_terminal")
    many = last.groupBy("network_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("several terminal events").alias("problem"), F.col("network_id").alias("id"))
    at = last.join(events, ["event_table", "event_id"]).select("network_id", "ts")
    other = t["ground_truth_networks"].select("network_id", "terminal_ts").join(at, "network_id", "left").filter("NOT (terminal_ts <=> ts)").select(F.lit("terminal_ts differs").alias("problem"), F.col("network_id").alias("id"))
    phases = ev.groupBy("phase").agg(F.countDistinct("is_high_risk").alias("n")).filter("n > 1").select(F.lit("high risk differs within a phase").alias("problem"), F.lit(None).cast("bigint").alias("id"))
    return missing.unionByName(many).unionByName(other).unionByName(phases)


def causality(t: Tables, phases: tuple[str, ...] = ("MOVEMENT", "EXIT")) -> DataFrame:
    """A settled outflow of these phases has a settled inflow to its source in the same network strictly before.

    The least time of an inflow per network and account says it all, so no pairs are made.
    """
    settled = t["transactions"].filter(F.col("status") == SETTLED).select("event_id", "ts", "src_account_id", "dst_account_id")
    of = t["event_labels"].filter("event_table = 'transactions'").select("event_id", "network_id", "phase").join(settled, "event_id")
    first = of.groupBy("network_id", F.col("dst_account_id").alias("src_account_id")).agg(F.min("ts").alias("first_in"))
    out = of.filter(F.col("phase").isin(*phases)).join(first, ["network_id", "src_account_id"], "left")
    return out.filter("first_in IS NULL OR first_in >= ts").select(F.lit("outflow without earlier inflow").alias("problem"), "event_id")


def relations(t: Tables) -> DataFrame:
    """Owned accounts have an ownership relation; devices and the merchants of card payments exist."""
    edge = t["relations"].filter("relation_type = 'OWNS_ACCOUNT'").select(F.col("src_id").alias("owner_person_id"), F.col("dst_id").alias("account_id"))
    owned = t["accounts"].filter("owner_person_id IS NOT NULL").join(edge, ["owner_person_id", "account_id"], "left_anti").select(F.lit("no ownership relation").alias("problem"), F.col("account_id").alias("id"))
    device = t["logins"].join(t["devices"], "device_id", "left_anti").select(F.lit("unknown device").alias("problem"), F.col("event_id").alias("id"))
    return owned.unionByName(device).unionByName(unknown_merchants(t))


def unknown_merchants(t: Tables) -> DataFrame:
    return t["transactions"].filter("channel = 'POS' AND merchant_id IS NOT NULL").join(t["merchants"].select("merchant_id").distinct(), "merchant_id", "left_anti").select(F.lit("unknown merchant").alias("problem"), F.col("event_id").alias("id"))


def diversity(t: Tables, min_cv: float, min_instances: int) -> DataFrame:
    """Families with at least min_instances whose amount scale varies by less than min_cv."""
    x = F.col("amount_scale_minor").cast("double")
    g = t["ground_truth_networks"].groupBy("family").agg(F.count(F.lit(1)).alias("n"), (F.stddev_samp(x) / F.avg(x)).alias("cv"))
    return g.filter((F.col("n") >= min_instances) & ~(F.col("cv") >= min_cv)).select(F.lit("amounts vary too little").alias("problem"), "family", "cv")


def all_checks(sim_end: int, session_window: int = 1_800, min_cv: float = 0.1, min_instances: int = 5) -> dict[str, Callable[[Tables], DataFrame]]:
    """The checks in their fixed order."""
    return {
        "schema_no_currency": schema_no_currency,
        "timestamps": lambda t: timestamps(t, sim_end),
        "amounts_and_channels": amounts_and_channels,
        "login_references": lambda t: login_references(t, session_window),
        "accounts_open": accounts_open,
        "balances": balances,
        "conservation": lambda t: conservation(t, sim_end // 86_400),
        "labels": labels,
        "event_labels": event_labels,
        "causality": causality,
        "relations": relations,
        "diversity": lambda t: diversity(t, min_cv, min_instances),
    }


def run_checks(t: Tables, checks: Mapping[str, Callable[[Tables], DataFrame]]) -> list[str]:
    """Run in order; the first with violations raises InvariantViolation with five of them. Nothing is repaired."""
    passed = []
    for name, check in checks.items():
        sample = check(t).limit(5).collect()
        if sample:
            raise InvariantViolation(f"[{name}] {sample[0]['problem']}\n" + "\n".join(str(r.asDict()) for r in sample))
        passed.append(name)
    return passed
