"""Settlement of planned transfers in the global order (ts, event_id)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError, InvariantViolation
from tidemark.operators.ranking import rank_in_groups
from tidemark.operators.sides import SETTLED, SLICE, running_total
from tidemark.session import Scratch

_OUT = "event_id bigint, ts bigint, src_account_id bigint, dst_account_id bigint, amount_minor bigint, depends_on bigint, status string, src_before bigint, src_after bigint, dst_before bigint, dst_after bigint"
_IN = ("event_id", "ts", "src_account_id", "dst_account_id", "amount_minor", "depends_on")


def check_plan(events: DataFrame, accounts: DataFrame) -> None:
    """Raise on repeated ids, unknown accounts, and dependencies on an event that is missing or not strictly earlier."""
    repeated = events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    if repeated:
        raise InvariantViolation("[settle] an event id is used twice")
    used = events.select(F.explode(F.array("src_account_id", "dst_account_id")).alias("account_id")).distinct()
    if not used.join(accounts, "account_id", "left_anti").isEmpty():
        raise InvariantViolation("[settle] an account is unknown")
    first = events.select(F.col("event_id").alias("depends_on"), F.col("ts").alias("d_ts"))
    late = events.filter("depends_on IS NOT NULL").join(first, "depends_on", "left").filter("d_ts IS NULL OR d_ts > ts OR (d_ts = ts AND depends_on >= event_id)")
    if not late.isEmpty():
        raise InvariantViolation("[settle] an event depends on one that is not earlier")


def settle(events: DataFrame, accounts: DataFrame, scratch: Scratch, method: str = "fixpoint", max_rounds: int = 1_000, unit_rows: int = 1_000_000) -> DataFrame:
    """events with status and the balances of both sides before and after.

    An event is DECLINED if the one that it depends on is not SETTLED, or if an account with a limit would fall below
    minus its limit; accounts without a limit pay without bound. Declined events move nothing. accounts is
    (account_id, initial_balance_minor, overdraft_limit_minor).

    `fixpoint` is distributed. The events of each account with a limit are walked in order with the decisions of the
    round before on what comes in and on what is depended on; accounts for which one of these changed are walked
    again, until nothing changes. The result is exact, since a status depends on strictly earlier events only, and takes
    as many rounds as decisions of different accounts follow from each other; rounds after the first touch few
    accounts. An account is walked in units of unit_rows events, each from the balance that the round before left it
    with, so that none fills a task. Balances of all accounts are then running totals.

    `sequential` streams the sorted events through one task that holds only the balances: exact, for as many events as
    one machine can read.
    """
    accounts = accounts.select("account_id", "initial_balance_minor", "overdraft_limit_minor")
    events = scratch.table(events.select(*_IN), "events")
    check_plan(events, accounts)
    if method == "sequential":
        return _sequential(events, accounts)
    if method != "fixpoint":
        raise ConfigError(f"unknown method {method}")
    return _fixpoint(events, accounts, scratch, max_rounds, unit_rows)


def _sequential(events: DataFrame, accounts: DataFrame) -> DataFrame:
    def known(prefix: str) -> DataFrame:
        return accounts.select(F.col("account_id").alias(f"{prefix}_account_id"), F.col("initial_balance_minor").alias(f"{prefix}_initial"), F.col("overdraft_limit_minor").alias(f"{prefix}_limit"))

    # Facts of the accounts come with the rows, so the task needs no table of all accounts.
    rows = events.join(known("src"), "src_account_id").join(known("dst").drop("dst_limit"), "dst_account_id")
    ordered = rows.select(*_IN, "src_initial", "src_limit", "dst_initial").repartition(1).sortWithinPartitions("ts", "event_id")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balance: dict[int, int] = {}
        settled: set[int] = set()
        for b in batches:
            d = b.to_pydict()
            out: list[tuple] = []
            for event, src, dst, amount, needs, initial, limit, dst_initial in zip(d["event_id"], d["src_account_id"], d["dst_account_id"], d["amount_minor"], d["depends_on"], d["src_initial"], d["src_limit"], d["dst_initial"], strict=True):
                before = balance.setdefault(src, initial)
                ok = (needs is None or needs in settled) and (limit is None or before - amount >= -limit)
                if ok:
                    settled.add(event)
                    balance[src] = before - amount
                to = balance.setdefault(dst, dst_initial)
                if ok:
                    balance[dst] = to + amount
                out.append(("SETTLED" if ok else "DECLINED", before, balance[src] if src != dst else before - amount * ok, to, balance[dst]))
            columns = [b[c] for c in _IN] + [pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[*_IN, "status", "src_before", "src_after", "dst_before", "dst_after"])

    return ordered.mapInArrow(run, _OUT)


def _walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The debits that do not settle. Rows come by unit and in order; only the balance of the unit at hand is held."""
    unit, balance = None, 0
    for b in batches:
        d = b.to_pydict()
        declined, accounts = [], []
        for account, chunk, event, credit, amount, limit, entering, gone, needs in zip(d["account_id"], d["chunk"], d["event_id"], d["is_credit"], d["amount_minor"], d["overdraft_limit_minor"], d["entering"], d["gone"], d["needs_gone"], strict=True):
            if (account, chunk) != unit:
                unit, balance = (account, chunk), entering
            if credit:
                balance += 0 if gone else amount
            elif needs or balance - amount < -limit:
                declined.append(event)
                accounts.append(account)
            else:
                balance -= amount
        yield pa.RecordBatch.from_arrays([pa.array(declined, pa.int64()), pa.array(accounts, pa.int64())], names=["event_id", "src_account_id"])


def _fixpoint(events: DataFrame, accounts: DataFrame, scratch: Scratch, max_rounds: int, unit_rows: int) -> DataFrame:
    limited = accounts.filter("overdraft_limit_minor IS NOT NULL")
    debit = F.struct(F.col("src_account_id").alias("account_id"), F.lit(False).alias("is_credit"), F.col("depends_on").alias("needs"))
    credit = F.struct(F.col("dst_account_id").alias("account_id"), F.lit(True).alias("is_credit"), F.lit(None).cast("bigint").alias("needs"))
    rows = scratch.table(events.select("event_id", "ts", "amount_minor", F.explode(F.array(debit, credit)).alias("s")).select("event_id", "ts", "amount_minor", "s.*").join(limited, "account_id"), "limited")
    ranked = rank_in_groups(rows, ["account_id"], F.floor(F.col("ts") / SLICE), [F.col("ts"), F.col("event_id"), F.col("is_credit")])
    ledger = scratch.table(ranked.withColumn("chunk", F.floor((F.col("rank") - 1) / unit_rows)).drop("rank"), "ledger")
    chunked = scratch.table(ledger.filter("chunk > 0").select("account_id").distinct(), "chunked")
    several = not chunked.isEmpty()
    free = events.filter("depends_on IS NOT NULL").join(limited, F.col("src_account_id") == F.col("account_id"), "left_anti").select("event_id", F.col("depends_on").alias("needs"), "src_account_id")
    declined, affected = events.select("event_id", "src_account_id").limit(0), None
    for turn in range(max_rounds):
        gone = declined.select(F.col("event_id").alias("gone_id"))
        mine = ledger if affected is None else ledger.join(affected, "account_id", "left_semi")
        mine = mine.join(gone, mine["event_id"] == gone["gone_id"], "left").withColumn("gone", F.col("gone_id").isNotNull()).drop("gone_id")
        needed = declined.select(F.col("event_id").alias("needs_id"))
        mine = mine.join(needed, mine["needs"] == needed["needs_id"], "left").withColumn("needs_gone", F.col("needs_id").isNotNull()).drop("needs_id")
        if several:
            moved = F.sum(F.when(F.col("gone"), 0).when(F.col("is_credit"), F.col("amount_minor")).otherwise(-F.col("amount_minor")))
            sums = mine.join(chunked, "account_id", "left_semi").groupBy("account_id", "chunk").agg(moved.alias("moved"))
            before = F.coalesce(F.sum("moved").over(Window.partitionBy("account_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            mine = mine.join(sums.select("account_id", "chunk", before.alias("before")), ["account_id", "chunk"], "left")
            mine = mine.withColumn("entering", F.col("initial_balance_minor") + F.coalesce("before", F.lit(0)))
        else:
            mine = mine.withColumn("entering", F.col("initial_balance_minor"))
        ordered = mine.select("account_id", "chunk", "ts", "event_id", "is_credit", "amount_minor", "overdraft_limit_minor", "entering", "gone", "needs_gone")
        ordered = ordered.repartition("account_id", "chunk").sortWithinPartitions("account_id", "chunk", "ts", "event_id", "is_credit")
        now = ordered.mapInArrow(_walk, "event_id bigint, src_account_id bigint")
        if affected is not None:
            kept = declined.join(affected.select(F.col("account_id").alias("src_account_id")), "src_account_id", "left_anti")
            now = now.unionByName(kept.join(free.select("event_id"), "event_id", "left_anti"))
        now = now.unionByName(free.join(needed, F.col("needs") == F.col("needs_id"), "left_semi").select("event_id", "src_account_id"))
        now = scratch.table(now.select("event_id", "src_account_id"), "declined")
        flips = now.join(declined.select("event_id"), "event_id", "left_anti").unionByName(declined.join(now.select("event_id"), "event_id", "left_anti"))
        flips = scratch.table(flips.select("event_id"), "flips")
        declined = now
        if flips.isEmpty():
            return _balances(events, accounts, declined)
        touched = events.join(flips, "event_id", "left_semi").select(F.col("dst_account_id").alias("account_id"))
        touched = touched.unionByName(events.join(flips.withColumnRenamed("event_id", "depends_on"), "depends_on", "left_semi").select(F.col("src_account_id").alias("account_id")))
        if several:
            touched = touched.unionByName(events.join(flips, "event_id", "left_semi").select(F.col("src_account_id").alias("account_id")).join(chunked, "account_id", "left_semi"))
        affected = scratch.table(touched.join(limited, "account_id", "left_semi").distinct(), "affected")
    raise InvariantViolation("[settle] no fixed point within the allowed rounds")


def _balances(events: DataFrame, accounts: DataFrame, declined: DataFrame) -> DataFrame:
    """events with status and balances, once it is known which are declined."""
    gone = declined.select(F.col("event_id").alias("gone_id"))
    e = events.join(gone, events["event_id"] == gone["gone_id"], "left").withColumn("status", F.when(F.col("gone_id").isNull(), SETTLED).otherwise("DECLINED")).drop("gone_id")
    amount = F.when(F.col("status") == SETTLED, F.col("amount_minor")).otherwise(F.lit(0).cast("bigint"))
    two = F.explode(F.array(F.struct(F.col("src_account_id").alias("account_id"), F.lit(False).alias("is_credit"), (-amount).alias("delta")), F.struct(F.col("dst_account_id").alias("account_id"), F.lit(True).alias("is_credit"), amount.alias("delta"))))
    total = running_total(e.select(*_IN, "status", two.alias("side")).select(*_IN, "status", "side.*"), "delta", "total").join(accounts.select("account_id", "initial_balance_minor"), "account_id")
    after = F.col("initial_balance_minor") + F.col("total")
    # Both sides of an event meet in one row by an aggregation; what they share is the same in both.
    sides_of = [F.max(F.when(F.col("is_credit") == c, x)).alias(f"{side}_{name}") for c, side in ((False, "src"), (True, "dst")) for name, x in (("before", after - F.col("delta")), ("after", after))]
    return total.groupBy(*_IN, "status").agg(*sides_of).select(*_IN, "status", "src_before", "src_after", "dst_before", "dst_after")
