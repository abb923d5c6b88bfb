"""Weighted values: counts, modes, distinct counts and percentiles against brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tests.conftest import rows
from tidemark.operators.frequencies import key_profiles, rank_values, value_bucket, value_frequencies
from tidemark.operators.ranking import rank_in_groups

SHARES = {"p1": (1, 100), "p50": (1, 2), "p99": (99, 100), "p100": (1, 1)}


def brute(data, field):
    groups = defaultdict(list)
    for r in data:
        groups[r[field]].append(r["v"])
    out = []
    for k, values in groups.items():
        known = sorted(v for v in values if v is not None)
        mode = min(known, key=lambda v, c=Counter(known): (-c[v], v)) if known else None
        at = [known[math.ceil(len(known) * p / q) - 1] if known else None for p, q in SHARES.values()]
        out.append((k, len(values), len(known), len(set(known)), sum(known), mode, *at))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("seed", range(3))
def test_profiles_against_brute_force(spark, scratch, seed):
    rng = random.Random(seed)
    pool = [-(10**6), -3, -1, 0, 1, 2, 3, 1000, 1001, 10**9, 10**9 + 1, None]
    data = [{"a": rng.choice([1, 1, 1, 2, None]), "b": rng.randrange(20), "v": rng.choice(pool)} for _ in range(300)]
    df = spark.createDataFrame([(r["a"], r["b"], r["v"], "clash") for r in data], "a bigint, b bigint, v bigint, value string")
    found = key_profiles(value_frequencies(df, ["a", "b"], "v"), scratch, SHARES)
    columns = ["key_id", "n", "n_values", "distinct_values", "total", "mode_value", *SHARES]
    for field in ("a", "b"):
        got = sorted((tuple(r) for r in found.filter(f"field_name = '{field}'").select(*columns).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert got == brute(data, field)


def test_copies_count_once(spark, scratch):
    df = spark.createDataFrame([(1, 5, 10)] * 9 + [(2, 5, 20), (None, 5, 1), (None, 5, 1)], "e bigint, k bigint, v bigint")
    found = key_profiles(value_frequencies(df, ["k"], "v", key="e"), scratch)
    assert rows(found, "key_id", "n", "total") == [(5, 3, 31)]


def test_empty(spark, scratch):
    df = spark.createDataFrame([], "k bigint, v bigint")
    assert key_profiles(value_frequencies(df, ["k"], "v"), scratch, SHARES).count() == 0


def test_bucket_never_falls(spark):
    values = sorted({0, *(s * (2**i + d) for i in range(60) for d in (-1, 0, 1) for s in (-1, 1))})
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(v,) for v in values], "v bigint").select("v", value_bucket(F.col("v")).alias("b"))
    found = [r["b"] for r in df.orderBy("v").collect()]
    assert found == sorted(found)


def test_rank_outside_has_no_row(spark, scratch):
    freq = spark.createDataFrame([(1, 10, 3)], "k bigint, value bigint, n bigint")
    targets = spark.createDataFrame([(1, 0, 3), (1, 1, 4), (1, 2, 0)], "k bigint, q int, rank bigint")
    assert rows(rank_values(freq, ["k"], targets, scratch)) == [(1, 0, 10)]


def test_ranks_over_buckets(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i % 2 or None, i) for i in range(50)], "g int, x int")
    found = rank_in_groups(df, ["g"], F.floor(F.col("x") / 7), [F.col("x")])
    for g in (1, None):
        mine = sorted((r["x"], r["rank"]) for r in found.collect() if r["g"] == g)
        assert [r for _, r in mine] == list(range(1, 26))
