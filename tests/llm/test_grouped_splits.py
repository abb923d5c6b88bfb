"""Components against a union-find; splits keep them together and meet their quotas."""

import itertools
import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from tests.conftest import rows
from tidemark.errors import ConfigError
from tidemark.llm.grouped_splits import allocate, components, flow_over, grouped_splits, linked_pairs, weight

SHAPE = "network_id bigint, entity_type string, entity_id bigint, component string"
SPLITS = {"train": 0.8, "validation": 0.1, "test": 0.1}


def brute(data):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for n, t, i, _ in data:
        if n is None:
            continue
        a = find(("n", n))
        if t is not None and i is not None:
            parent[find((t, i))] = a
    groups = defaultdict(list)
    for n in {r[0] for r in data if r[0] is not None}:
        groups[find(("n", n))].append(n)
    return sorted((n, min(g)) for g in groups.values() for n in g)


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, scratch, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(80), rng.choice(["account", "device"]), rng.randrange(150), "x") for _ in range(160)]
    data += [(None, "account", 1, "x"), (200, None, 1, "x"), (201, "device", None, "x")] + data[:10]
    df = spark.createDataFrame(data, SHAPE)
    assert rows(components(df, "network_id", ["entity_type", "entity_id"], scratch), "group_id", "component") == brute(data)


def test_long_chain(spark, scratch):
    data = [(n, "account", n + d, "x") for n in range(60) for d in (0, 1)]
    assert {r["component"] for r in components(spark.createDataFrame(data, SHAPE), "network_id", ["entity_type", "entity_id"], scratch).collect()} == {0}


def test_allocation_meets_quotas():
    shares = [Fraction(8, 10), Fraction(1, 10), Fraction(1, 10)]
    bundles = [(40, "a", 1), (5, "a", 7), (2, "b", 13), (1, "a", 95), (1, "b", 60)]
    parts = allocate(bundles, shares)
    assert [sum(p) for p in parts] == [n for _, _, n in bundles]
    total = sum(s * n for s, _, n in bundles)
    for k, share in enumerate(shares):
        assert abs(sum(b[0] * p[k] for b, p in zip(bundles, parts, strict=True)) - share * total) <= 1
    # A bundle is spread in its own proportion too.
    assert abs(parts[3][0] - 76) <= 1 and abs(parts[4][0] - 48) <= 2


def cost_of(flows, bundles, shares, goals):
    """The cost that the flow minimises, from its definition: distances in components and in groups, straight between whole steps."""
    widest = max(s for s, _ in bundles)

    def distance(flow, part, step):
        x, low = Fraction(flow, step), part.numerator // part.denominator
        if low < x < low + 1:
            a, b = abs(low - part), abs(low + 1 - part)
            return a + (b - a) * (x - low)
        return abs(x - part)

    own = sum(s * weight(s, widest) * distance(f, n * g, s) for row, (s, n) in zip(flows, bundles, strict=True) for f, g in zip(row, shares, strict=True))
    return own + 8 * len(goals) * weight(1, widest) * sum(distance(sum(row[k] for row in flows), g, 1) for k, g in enumerate(goals))


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_the_cheapest(seed):
    """Against all flows of small cases."""
    rng = random.Random(seed)
    bundles = [(rng.randrange(1, 4), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 4))]
    total = sum(s * n for s, n in bundles)
    shares = [Fraction(w, 10) for w in rng.choice([(8, 1, 1), (5, 3, 2), (6, 4)])]
    moved = Fraction(rng.choice([0, 0, 1, 3]), 4)  # goals need not be the shares of the whole
    goals = [s * total for s in shares]
    goals[0], goals[1] = goals[0] - min(moved, goals[0]), goals[1] + min(moved, goals[0])

    def ways(units, k):
        return [[units]] if k == 1 else [[x, *rest] for x in range(units + 1) for rest in ways(units - x, k - 1)]

    found = flow_over(bundles, shares, goals)
    assert [sum(row) for row in found] == [s * n for s, n in bundles]
    assert cost_of(found, bundles, shares, goals) == min(cost_of(f, bundles, shares, goals) for f in itertools.product(*(ways(s * n, len(goals)) for s, n in bundles)))


def test_more_bundles_than_the_bound_raise(spark, scratch):
    data = [(n, "account", n, "x") for n in range(6)]
    labels = spark.createDataFrame([(n, f"f{n}") for n in range(6)], "network_id bigint, family string")
    df = spark.createDataFrame(data, SHAPE)
    with pytest.raises(ConfigError):
        grouped_splits(df, "network_id", ["entity_id"], SPLITS, scratch, labels=labels, max_bundles=5)
    assert grouped_splits(df, "network_id", ["entity_id"], SPLITS, scratch, labels=labels, max_bundles=6).count() == 6


def test_pairs_of_a_large_component_come_in_chunks(spark):
    rows_ = [(n, 0, "train") for n in range(57)] + [(100, 100, "test"), (101, 100, "test"), (102, 102, "train")]
    found = rows(linked_pairs(spark.createDataFrame(rows_, "n bigint, component bigint, split string"), "n", chunk=10), "n_a", "n_b")
    assert found == sorted([(a, b) for a in range(57) for b in range(a + 1, 57)] + [(100, 101)])


def test_splits(spark, scratch):
    rng = random.Random(5)
    data = [(n, "account", rng.randrange(500) if rng.random() < 0.5 else 10_000 + n, "x") for n in range(300) for _ in range(2)]
    labels = spark.createDataFrame([(n, f"f{n % 3}") for n in range(250)], "network_id bigint, family string")
    found = grouped_splits(spark.createDataFrame(data, SHAPE), "network_id", ["entity_type", "entity_id"], SPLITS, scratch, labels=labels).collect()
    assert sorted(r["network_id"] for r in found) == list(range(300))
    assert all(len({r["split"] for r in found if r["component"] == c}) == 1 for c in {r["component"] for r in found})
    sizes = Counter(r["split"] for r in found)
    largest = max(Counter(r["component"] for r in found).values())
    assert all(abs(sizes[s] - p * 300) <= max(3, largest) for s, p in SPLITS.items())


def test_one_giant_empty_and_parameters(spark, scratch):
    giant = spark.createDataFrame([(n, "account", 1, "x") for n in range(50)], SHAPE)
    assert len({r["split"] for r in grouped_splits(giant, "network_id", ["entity_type", "entity_id"], SPLITS, scratch).collect()}) == 1
    assert grouped_splits(giant.limit(0), "network_id", ["entity_type", "entity_id"], SPLITS, scratch).count() == 0
    with pytest.raises(ConfigError):
        grouped_splits(giant, "network_id", ["entity_id"], {"a": 0.5}, scratch)
