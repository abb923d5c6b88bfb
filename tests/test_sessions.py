"""Sessions against brute force."""

import random

import pytest

from tests.conftest import most_rows_of_a_task, rows
from tidemark.errors import ConfigError
from tidemark.operators.sessions import sessions

SHAPE = "event_id bigint, a bigint, d bigint, ts bigint, slice string, n bigint"


def brute(data, gap):
    seen, keys = set(), {}
    for e, a, d, ts in data:
        if ts is None or e in seen:
            continue
        seen.add(e)
        keys.setdefault((a, d), []).append(ts)
    out = []
    for (a, d), times in keys.items():
        times.sort()
        start = last = times[0]
        n = 0
        for ts in times:
            if ts - last > gap:
                out.append((a, d, start, last, last - start, n))
                start, n = ts, 0
            last, n = ts, n + 1
        out.append((a, d, start, last, last - start, n))
    return sorted(out, key=lambda r: tuple((x is not None, x or 0) for x in r))


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, scratch, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 1, 1, 2, None]), rng.randrange(2), rng.randrange(-2_000, 4_000)) for i in range(400)]
    data += rng.sample(data, 40)
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SHAPE)
    found = sessions(df, ["a", "d"], "ts", 20, scratch, event_key="event_id")
    got = sorted((tuple(r) for r in found.collect()), key=lambda r: tuple((x is not None, x or 0) for x in r))
    assert got == brute(data, 20)


def test_long_chain_and_exact_gap(spark, scratch):
    data = [(i, 1, 1, 20 * i) for i in range(700)] + [(900, 1, 1, 20 * 699 + 21)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], SHAPE)
    assert rows(sessions(df, ["a", "d"], "ts", 20, scratch, event_key="event_id"), "start_ts", "end_ts", "n_events") == [(0, 20 * 699, 700), (20 * 699 + 21, 20 * 699 + 21, 1)]


def test_ties_nulls_and_empty(spark, scratch):
    df = spark.createDataFrame([(1, 1, 1, 5, "x", 1), (2, 1, 1, 5, "x", 1), (3, 1, 1, None, "x", 1)], SHAPE)
    assert rows(sessions(df, ["a", "d"], "ts", 20, scratch), "start_ts", "end_ts", "n_events") == [(5, 5, 2)]
    assert sessions(df.limit(0), ["a", "d"], "ts", 20, scratch).count() == 0
    with pytest.raises(ConfigError):
        sessions(df, ["a"], "ts", 0, scratch)


def test_a_key_with_a_third_of_all_rows_does_not_fill_a_task(spark, scratch):
    """20,000 rows, a third of them of a NULL key within few seconds, which are one row per second and task when sent."""
    rng = random.Random(2)
    data = [(i, None if i % 3 == 0 else i, 1, rng.randrange(50) if i % 3 == 0 else rng.randrange(10_000), "x", 1) for i in range(20_000)]
    df = spark.createDataFrame(data, SHAPE).repartition(4)
    df.write.mode("overwrite").parquet(scratch.path("hot"))
    df = spark.read.parquet(scratch.path("hot"))
    found = []
    assert most_rows_of_a_task(spark, lambda: found.extend(sessions(df, ["a", "d"], "ts", 20, scratch).collect())) < 5_000
    assert max(r["n_events"] for r in found) == 6_667
