"""Features of cutoffs whose windows overlap, against a plain count, and what of their tables is sent to the driver."""

import random

from pyspark.sql import functions as F

from tidemark.functions.timebase import DAY
from tidemark.operators.pit import window_features

TXN = "event_id bigint, ts bigint, txn_type string, status string, amount_minor bigint, src_account_id bigint, dst_account_id bigint, src_balance_before_minor bigint, src_balance_after_minor bigint, dst_balance_before_minor bigint, dst_balance_after_minor bigint"
CAP = 30 * DAY


def made(seed):
    """Few accounts, keys and times, so that times lie on bounds, keys come again, and several cutoffs agree."""
    rng = random.Random(seed)
    times = [d * DAY + s for d in range(45) for s in (0, 1, 17_999, 18_000)]
    moved = []
    for i in range(400):
        src, dst = rng.sample(range(1, 7), 2)
        moved.append((i, rng.choice(times), rng.choice(["TRANSFER", "TRANSFER", "ATM_WITHDRAWAL", None]), rng.choice(["SETTLED", "SETTLED", "DECLINED", None]), rng.randrange(1, 90), src, dst, 0, 0, 0, 0))
    entered = [(i, rng.choice(times), rng.randrange(1, 7), rng.choice([None, 1, 2, 3]), rng.randrange(40), rng.choice(["SUCCESS", "FAILURE"])) for i in range(200)]
    cutoffs = [(f"c{i}", rng.choice([1, 2, 3, 4, 99, None]), rng.choice([*times, None])) for i in range(60)]
    return moved, entered, [*cutoffs, ("same", *cutoffs[0][1:])]


def plain(moved, entered, account, t, w):
    own = sorted((ts, i, credit, kind, status, amount, other) for i, ts, kind, status, amount, src, dst, *_ in moved for own, other, credit in ((src, dst, False), (dst, src, True)) if own == account)
    got = {"in": 0, "out": 0, "n": 0, "atm": 0, "night": 0, "declined": 0, "largest": 0, "held": 0.0, "sent": set(), "received": set()}
    credited = None
    for ts, _, credit, kind, status, amount, other in own:
        if t is not None and t - w * DAY < ts <= t:
            if status == "SETTLED":
                got["n"] += 1
                got["night"] += ts % DAY < 18_000
                got["largest"] = max(got["largest"], amount)
                got["in" if credit else "out"] += amount
                if not credit:
                    got["held"] += amount * min(CAP, CAP if credited is None else ts - credited)
                    got["atm"] += amount * (kind == "ATM_WITHDRAWAL")
                if kind == "TRANSFER":
                    got["received" if credit else "sent"].add(other)
            got["declined"] += status == "DECLINED" and not credit
        if status == "SETTLED" and credit:
            credited = ts
    used = [(device, ip) for _, ts, of, device, ip, outcome in entered if of == account and t is not None and t - w * DAY < ts <= t and outcome == "SUCCESS"]
    both = got["in"] + got["out"]
    return [
        both, got["in"], got["out"], got["n"], len(got["received"]), len(got["sent"]), got["held"] / got["out"] / 3600 if got["out"] else 720.0, got["largest"], abs(got["in"] - got["out"]) / both if both else 1.0,
        got["atm"] / got["out"] if got["out"] else 0.0, got["night"] / got["n"] if got["n"] else 0.0, got["declined"], len({d for d, _ in used} - {None}), len({ip for _, ip in used}),
    ]


def test_overlapping_windows_equal_a_plain_count(spark):
    for seed in range(2):
        moved, entered, cutoffs = made(seed)
        of = spark.createDataFrame(cutoffs, "row_id string, account_id bigint, t bigint"), spark.createDataFrame(moved, TXN), spark.createDataFrame(entered, "event_id bigint, ts bigint, account_id bigint, device_id bigint, ip_id bigint, outcome string")
        found = {r[0]: list(r[1:]) for r in window_features(*of).collect()}
        assert found.keys() == {c[0] for c in cutoffs}
        for name, account, t in cutoffs:
            want = plain(moved, entered, account, t, 7) + plain(moved, entered, account, t, 30)
            assert all(abs(x - y) < 1e-9 for x, y in zip(found[name], want, strict=True)), (name, found[name], want)


def test_cutoffs_are_not_broadcast_by_the_day(spark, scratch):
    """A small file of cutoffs, each of which meets a month of days: Spark takes the days for as small as the file."""
    cutoffs = scratch.table(spark.range(5_000).select(F.concat_ws("/", "id").alias("row_id"), (F.col("id") % 500).alias("account_id"), (F.col("id") % 13 * 7 * DAY + 40 * DAY).alias("t")), "cutoffs")
    moved, entered, _ = made(9)
    moved = scratch.table(spark.createDataFrame(moved, TXN), "moved")
    entered = scratch.table(spark.createDataFrame(entered, "event_id bigint, ts bigint, account_id bigint, device_id bigint, ip_id bigint, outcome string"), "entered")
    found = window_features(cutoffs, moved, entered)
    assert len(found.collect()) == 5_000
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
