"""Attributes as known at event time, against brute force."""

import random

import pytest

from tests.conftest import rows
from tidemark.operators.known import attributes_as_known, versions

EVENTS = "event_id bigint, acc bigint, ts bigint, valid_from string"
STATES = "ent bigint, valid_from bigint, valid_to bigint, known_at bigint, sid string, risk int, event_id string"


def brute(events, states):
    seen, out = set(), []
    for e, a, ts, _ in events:
        if e in seen:
            continue
        seen.add(e)
        best = None
        for ent, vf, vt, known, sid, risk, _ in states:
            if ts is None or a is None or None in (ent, vf, vt, known) or ent != a:
                continue
            if vf <= ts < vt and known <= ts:
                key = (vf, known, sid is not None, sid or "")
                if best is None or key > best[0]:
                    best = (key, sid, risk, vf)
        out.append((e, a, ts, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=lambda r: r[0])


def run(spark, scratch, events, states, **more):
    return attributes_as_known(
        spark.createDataFrame(events, EVENTS), spark.createDataFrame(states, STATES), scratch, event_key="event_id", event_entity="acc", event_ts="ts", entity="ent",
        valid_from="valid_from", valid_to="valid_to", known_at="known_at", tie=["sid"], state_key=["sid", "valid_from"], payload=["sid", "risk", "valid_from"], prefix="l_", **more,
    )


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("bucket", [10_000, 7])
def test_against_brute_force(spark, scratch, seed, bucket):
    rng = random.Random(seed)
    events = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([*range(100), None]), "x") for i in range(150)]
    events += rng.sample(events, 15)
    states = [(rng.choice([1, 1, 2, None]), rng.randrange(90), 0, rng.choice([*range(100), None]), rng.choice(["a", "b", "c"]) + str(i), rng.randrange(2), "z") for i in range(40)]
    states = [(e, f, f + rng.randrange(-2, 40), k, s, r, z) for e, f, _, k, s, r, z in states]
    states += states[:5]
    got = sorted((tuple(r) for r in run(spark, scratch, events, states, rows_per_bucket=bucket, slice_seconds=30).collect()), key=lambda r: r[0])
    assert got == brute(events, states)


def test_no_states_and_no_events(spark, scratch):
    assert rows(run(spark, scratch, [(1, 1, 5, "x")], []), "event_id", "l_sid") == [(1, None)]
    assert run(spark, scratch, [], [(1, 0, 9, 0, "a", 1, "z")]).count() == 0


def test_versions_sweep():
    unit, at, winner = versions([1, 1], [0, 5], [20, 10], [(0,), (1,)])
    assert list(zip(unit, at, winner, strict=True)) == [(1, 0, 0), (1, 5, 1), (1, 10, 0), (1, 20, None)]
