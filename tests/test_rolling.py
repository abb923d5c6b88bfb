"""Trailing totals against brute force, and their defined cases."""

import random

import pytest

from tests.conftest import rows
from tidemark.errors import ConfigError
from tidemark.operators.rolling import trailing_totals

DAY = 86_400
SHAPE = "e bigint, src bigint, ts bigint, amount bigint, day string, total bigint"


def frame(spark, data):
    """Columns with names that the operator uses itself must not disturb it."""
    return spark.createDataFrame([(*r, "x", 7) for r in data], SHAPE)


def brute(data, first, last, windows):
    seen, cells = set(), {}
    for e, s, ts, a in data:
        if s is None or ts is None or (e is not None and e in seen):
            continue
        seen.add(e)
        cells.setdefault(s, []).append((ts // DAY, a or 0))
    out = []
    for s, mine in cells.items():
        if min(d for d, _ in mine) > last:
            continue
        for day in range(first, last + 1):
            row = [s, day]
            for w in windows:
                hit = [a for d, a in mine if day - w < d <= day]
                row += [sum(hit), len(hit)]
            out.append(tuple(row))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    data = [(i, rng.choice([1, 1, 1, 2, 3]), rng.randrange(-3 * DAY, 14 * DAY), rng.randrange(-5, 50)) for i in range(60)]
    data += rng.sample(data, 10)  # copies
    found = trailing_totals(frame(spark, data), "src", "ts", "amount", key="e", first_day=0, last_day=11, windows=(2, 5))
    assert rows(found, "src", "day", "total_2d", "count_2d", "total_5d", "count_5d") == brute(data, 0, 11, (2, 5))


def test_nulls_and_ties(spark):
    data = [(1, 1, 0, None), (2, None, 0, 5), (3, 1, None, 5), (None, 1, 0, 4), (None, 1, 0, 4), (None, 1, 0, 6)]
    found = trailing_totals(frame(spark, data), "src", "ts", "amount", key="e", first_day=0, last_day=0, windows=(7,))
    # A NULL amount counts as an event of 0; rows without a key are copies only if all agrees.
    assert rows(found, "src", "day", "total_7d", "count_7d", "avg_day_7d") == [(1, 0, 10, 3, 10 / 7)]


def test_average_without_events_is_null(spark):
    found = trailing_totals(frame(spark, [(1, 1, 0, 7)]), "src", "ts", "amount", key="e", first_day=0, last_day=2, windows=(1,))
    assert rows(found, "day", "total_1d", "avg_event_1d") == [(0, 7, 7.0), (1, 0, None), (2, 0, None)]


def test_empty_and_restricted(spark):
    assert trailing_totals(frame(spark, []), "src", "ts", "amount", first_day=0, last_day=3).count() == 0
    only = spark.createDataFrame([(2,), (2,), (None,)], "account_id bigint")
    found = trailing_totals(frame(spark, [(1, 1, 0, 7), (2, 2, 0, 8)]), "src", "ts", "amount", first_day=0, last_day=0, windows=(1,), entities=only)
    assert rows(found, "src", "total_1d") == [(2, 8)]


def test_bad_parameters(spark):
    with pytest.raises(ConfigError):
        trailing_totals(frame(spark, []), "src", "ts", "amount", first_day=0, last_day=0, windows=(0,))
