"""Settlement, integrity checks and what tampering does to them."""

import random

import pytest
from pyspark.sql import functions as F

from tests import world as w
from tests.conftest import rows
from tidemark.errors import InvariantViolation
from tidemark.operators import checks
from tidemark.operators.settle import settle
from tidemark.operators.sides import last_before, running_total, sides

EVENTS = "event_id bigint, ts bigint, src_account_id bigint, dst_account_id bigint, amount_minor bigint, depends_on bigint"
ACCOUNTS = "account_id bigint, initial_balance_minor bigint, overdraft_limit_minor bigint"
METHODS = ["sequential", "fixpoint"]


def run(spark, scratch, events, accounts, method):
    found = settle(spark.createDataFrame(events, EVENTS), spark.createDataFrame(accounts, ACCOUNTS), scratch, method)
    return [tuple(r) for r in found.orderBy("ts", "event_id").select("status", "src_before", "src_after", "dst_after").collect()]


@pytest.mark.parametrize("method", METHODS)
def test_limits(spark, scratch, method):
    got = run(spark, scratch, [(1, 1, 1, 2, 60, None), (2, 2, 1, 2, 60, None), (3, 3, 1, 2, 30, None)], [(1, 100, 0), (2, 0, 0)], method)
    assert got == [("SETTLED", 100, 40, 60), ("DECLINED", 40, 40, 60), ("SETTLED", 40, 10, 90)]


@pytest.mark.parametrize("method", METHODS)
def test_external_dependency_and_ties(spark, scratch, method):
    assert run(spark, scratch, [(1, 1, 9, 2, 10**9, None)], [(9, 0, None), (2, 0, 0)], method) == [("SETTLED", 0, -(10**9), 10**9)]
    got = run(spark, scratch, [(1, 1, 1, 2, 200, None), (2, 2, 1, 2, 5, 1), (3, 3, 1, 2, 5, None)], [(1, 100, 0), (2, 0, 0)], method)
    assert [g[0] for g in got] == ["DECLINED", "DECLINED", "SETTLED"]
    got = run(spark, scratch, [(2, 1, 1, 2, 100, None), (1, 1, 1, 2, 100, None)], [(1, 100, 0), (2, 0, 0)], method)
    assert [g[0] for g in got] == ["SETTLED", "DECLINED"]


def test_bad_plans(spark, scratch):
    for events in ([(1, 1, 1, 2, 1, None), (1, 2, 1, 2, 1, None)], [(1, 1, 1, 7, 1, None)], [(1, 5, 1, 2, 1, 2), (2, 6, 1, 2, 1, None)], [(1, 5, 1, 2, 1, 44)]):
        with pytest.raises(InvariantViolation):
            run(spark, scratch, events, [(1, 100, 0), (2, 0, 0)], "sequential")


def test_both_methods_agree(spark, scratch):
    rng = random.Random(3)
    events = [(i, rng.randrange(4 * w.DAY), *rng.sample(range(8), 2), rng.randrange(1, 90), None) for i in range(120)]
    accounts = [(a, 100, None if a == 0 else rng.choice([0, 50])) for a in range(8)]
    a, b = (run(spark, scratch, events, accounts, m) for m in METHODS)
    assert a == b and {x[0] for x in a} == {"SETTLED", "DECLINED"}


def test_along_accounts(spark):
    """The two-level running sum and last value against a plain walk."""
    rng = random.Random(4)
    data = [(i, 0, *rng.sample([10, 11, 12], 2), rng.randrange(100)) for i in range(80)]
    t = w.transactions(spark, [(i, rng.randrange(6), "TRANSFER", "SCHEDULED", s, d, a, 0, 0) for i, _, s, d, a in data])
    own = sides(t)
    found = last_before(running_total(own, "delta", "total"), F.when(F.col("is_credit"), F.col("ts")), "credit_ts").collect()
    total, credit = {}, {}
    for r in sorted(found, key=lambda r: (r["ts"], r["event_id"], r["is_credit"])):
        a = r["account_id"]
        total[a] = total.get(a, 0) + r["delta"]
        assert r["total"] == total[a] and r["credit_ts"] == credit.get(a)
        if r["is_credit"]:
            credit[a] = r["ts"]


def test_the_world_is_sound(spark):
    t = w.tables(spark)
    passed = checks.run_checks(t, {n: c for n, c in checks.all_checks(w.SIM_END).items() if n not in ("relations", "labels")})
    assert len(passed) == 10


def tamper(df, where, **columns):
    return df.withColumns({c: F.when(F.expr(where), F.expr(str(v)).cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in columns.items()})


@pytest.mark.parametrize(
    ("check", "table", "where", "columns", "problem"),
    [
        ("timestamps", "transactions", "event_id = 1", {"ts": -5}, "ts outside of the horizon"),
        ("timestamps", "transactions", "event_id = 2", {"event_id": 1}, "event id used twice"),
        ("amounts_and_channels", "transactions", "event_id = 1", {"amount_minor": 0}, "amount not positive"),
        ("amounts_and_channels", "transactions", "event_id = 2", {"dst_account_id": 12}, "to itself"),
        ("amounts_and_channels", "transactions", "event_id = 2", {"channel": "'POS'"}, "channel not allowed"),
        ("amounts_and_channels", "transactions", "event_id = 2", {"txn_type": "'CARD_PAYMENT'", "channel": "'POS'"}, "CARD_PAYMENT without merchant_id"),
        ("amounts_and_channels", "transactions", "event_id = 2", {"status": "'ODD'"}, "unknown status"),
        ("login_references", "transactions", "event_id = 2", {"device_id": 5}, "reference on other channel"),
        ("login_references", "transactions", "event_id = 2", {"channel": "'APP'"}, "digital without reference"),
        ("login_references", "transactions", "event_id = 2", {"channel": "'APP'", "device_id": 1, "ip_id": 1, "login_event_id": 9}, "no matching login"),
        ("accounts_open", "transactions", "event_id = 2", {"src_account_id": 77}, "unknown account"),
        ("accounts_open", "accounts", "account_id = 12", {"opened_at": 10 * w.DAY}, "before the account was opened"),
        ("balances", "transactions", "event_id = 2", {"src_balance_after_minor": 1101}, "after is not before and what moved"),
        ("balances", "transactions", "event_id = 4", {"src_balance_before_minor": 1800, "src_balance_after_minor": 1000}, "breaks the chain"),
        ("balances", "accounts", "account_id = 12", {"initial_balance_minor": 999}, "differs from the recomputed balance"),
        ("balances", "accounts", "account_id = 12", {"overdraft_limit_minor": -1_200}, "below the overdraft limit"),
        ("conservation", "transactions", "event_id = 5", {"dst_balance_after_minor": 1_101}, "total drifts"),
        ("labels", "labels", "entity_id = 10", {"valid_to": 10 * w.DAY}, "empty interval"),
        ("labels", "labels", "entity_id = 13", {"entity_id": 10, "valid_from": 11 * w.DAY}, "several networks"),
        ("labels", "labels", "entity_id = 13", {"network_id": 1}, "known_at differs"),
        ("labels", "ground_truth_networks", "network_id = 1", {"detected": "false"}, "detected without known_at or the reverse"),
        ("diversity", "ground_truth_networks", "true", {"amount_scale_minor": 5, "family": "'x'"}, "amounts vary too little"),
    ],
)
def test_tampering_is_found(spark, check, table, where, columns, problem):
    t = w.tables(spark)
    run_one = checks.all_checks(w.SIM_END, min_instances=2)[check]
    assert problem not in {r["problem"] for r in run_one(t).collect()}
    t[table] = tamper(t[table], where, **columns)
    assert problem in {r["problem"] for r in run_one(t).collect()}
    with pytest.raises(InvariantViolation, match=check):
        checks.run_checks(t, {check: run_one})


def test_causality(spark):
    t = w.tables(spark)
    of = [("transactions", e, "s", 1, "f", p, "X", True, False, False, None) for e, p in ((3, "INFLOW"), (4, "MOVEMENT"))]
    t["event_labels"] = w.frame(spark, "event_labels", of)
    assert checks.causality(t).count() == 0
    t["transactions"] = tamper(t["transactions"], "event_id = 3", ts=20 * w.DAY + 100)  # at the same moment is not before
    assert rows(checks.causality(t), "event_id") == [(4,)]


def test_event_labels_and_relations(spark):
    t = w.tables(spark)
    t["event_labels"] = w.frame(spark, "event_labels", [("transactions", e, "s", 1, "f", "EXIT", "X", h, True, False, None) for e, h in ((4, True), (50, False))])
    problems = {r["problem"] for r in checks.event_labels(t).collect()}
    assert problems == {"labelled event is missing", "several terminal events", "terminal_ts differs", "high risk differs within a phase"}
    assert {r["problem"] for r in checks.relations(t).collect()} == {"no ownership relation"}
    assert checks.schema_no_currency({"a": spark.createDataFrame([], "currency string")}).count() == 1


@pytest.mark.parametrize("unit_rows", [1, 7, 1_000])
def test_units_of_an_account_and_dependencies(spark, scratch, unit_rows):
    """Accounts walked in many units, events that depend on others of limited and unlimited accounts: as in one sequence."""
    rng = random.Random(unit_rows)
    events = []
    for i in range(160):
        src, dst = rng.sample(range(5), 2)
        events.append((i, 100 * i + rng.randrange(50), src, dst, rng.randrange(1, 120), rng.choice([None, None, rng.randrange(i)]) if i else None))
    accounts = [(a, 100, None if a == 0 else rng.choice([0, 50])) for a in range(5)]
    e, a = spark.createDataFrame(events, EVENTS), spark.createDataFrame(accounts, ACCOUNTS)
    found = [rows(settle(e, a, scratch, method, unit_rows=unit_rows)) for method in METHODS]
    assert found[0] == found[1] and {r[6] for r in found[0]} == {"SETTLED", "DECLINED"}
