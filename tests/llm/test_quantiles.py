"""Sketches within their bound, combinable; exact percentiles against brute force."""

import math
import random
from collections import defaultdict

import pytest

from tidemark.errors import ConfigError
from tidemark.llm.quantiles import estimates, exact_percentiles, merge_sketches, rank_error, sketches

SHARES = {"p50": (1, 2), "p99": (99, 100), "p100": (1, 1)}


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "x") for r in data], "g string, day int, v bigint, q int, sketch string")


def made(rng, n):
    return [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(5), rng.choice([rng.randrange(100), rng.randrange(10**9), 7, None])) for _ in range(n)]


@pytest.mark.parametrize("k", [8, 1024])
def test_exact_against_brute_force(spark, scratch, k):
    """With k = 8 the brackets are wide and often miss at the ends; the result is exact all the same."""
    data = made(random.Random(k), 3_000)
    groups = defaultdict(list)
    for g, _, v in data:
        if v is not None:
            groups[g].append(v)
    want = {g: (len(vs), *(sorted(vs)[math.ceil(len(vs) * p / q) - 1] for p, q in SHARES.values())) for g, vs in groups.items()}
    df = frame(spark, data)
    merged = merge_sketches(sketches(df, ["g", "day"], "v", k), ["g"], k)
    found = {r["g"]: tuple(r)[1:] for r in exact_percentiles(df, ["g"], "v", SHARES, scratch, merged, k).collect()}
    assert found == want


def test_merged_days_stay_within_the_bound(spark):
    rng = random.Random(1)
    data = [("a", rng.randrange(30), rng.randrange(10**6)) for _ in range(20_000)]
    df = frame(spark, data)
    merged = merge_sketches(sketches(df, ["g", "day"], "v"), ["g"])
    row = estimates(merged, ["g"], SHARES).first()
    values = sorted(v for _, _, v in data)
    assert row["n"] == len(values)
    for name, (p, q) in SHARES.items():
        rank = sum(v <= row[name] for v in values) / len(values)
        assert abs(rank - p / q) <= 2 * rank_error(1024)


def test_empty_nulls_and_parameters(spark, scratch):
    for data in ([], [("a", 0, None)]):
        df = frame(spark, data)
        merged = merge_sketches(sketches(df, ["g"], "v"), ["g"])
        assert exact_percentiles(df, ["g"], "v", SHARES, scratch, merged).count() == 0
    with pytest.raises(ConfigError):
        exact_percentiles(frame(spark, []), ["g"], "v", {"p0": (0, 1)}, scratch, merged)
