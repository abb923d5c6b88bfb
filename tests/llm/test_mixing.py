"""Mixing: exact quotas of the splitting tree, shares within one document, repeats capped."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.llm.mixing import deal, mix_sources, node_draw

SHAPE = "doc_id bigint, text string, source string, block string, size int"
TARGETS = "source string, target_share double, max_repeats int"


def run(spark, scratch, docs, targets, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], SHAPE)
    return mix_sources(df, spark.createDataFrame(targets, TARGETS), scratch, doc_id="doc_id", source="source", size=F.octet_length("text"), block_tokens=200, shard_tokens=500, **more)


def test_tree_places_each_block_once():
    counts = [50, 3, 0, 21]
    source = np.repeat(np.arange(4), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    whole = deal(source, place, counts, 7, seed=3)
    sizes = Counter(whole.tolist())
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 2
    # Any part of the blocks, in any order, gets the same shards: tasks agree without talking.
    some = np.random.default_rng(0).permutation(len(source))[:30]
    assert (deal(source[some], place[some], counts, 7, seed=3) == whole[some]).all()
    left = node_draw(np.array(counts), 3, 7, 3, 0, 7)
    assert left.sum() == round(74 * 3 / 7) and (left <= counts).all()


def test_shares_repeats_and_report(spark, scratch):
    docs = [(i, "x" * (10 + i % 7), "big") for i in range(300)] + [(1000 + i, "y" * 9, "small") for i in range(20)] + [(2000, "z" * 40, None), (2001, "", "big"), (2002, None, "small"), (None, "q", "big"), (0, "x" * 10, "big")]
    mix = run(spark, scratch, docs, [("big", 0.7, 1), ("small", 0.25, 3), ("none", 0.05, 2)])
    report = {r["source"]: r for r in mix.report.collect()}
    total = sum(10 + i % 7 for i in range(300)) + 180 + 40
    assert report["big"]["target_tokens"] == 0.7 * total and report["small"]["available_tokens"] == 180
    assert 0 <= report["big"]["drawn_tokens"] - 0.7 * total <= 17
    assert report["small"]["drawn_tokens"] == 540 and report["small"]["repeats"] == 3 and report["small"]["cap_tokens"] == 540
    assert report["none"]["drawn_tokens"] == 0 and report["none"]["actual_share"] == 0
    assert abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    plan = mix.plan.collect()
    assert sum(r["size"] for r in plan) == sum(r["drawn_tokens"] for r in report.values())
    assert max(Counter((r["doc_id"], r["repeat_no"]) for r in plan).values()) == 1
    assert {r["repeat_no"] for r in plan if r["source"] == "big"} == {0}
    for shard in {r["shard"] for r in plan}:
        assert sorted(r["position"] for r in plan if r["shard"] == shard) == list(range(1, sum(r["shard"] == shard for r in plan) + 1))
    # The small source is one block, drawn three times; its repeats are spread over shards that hold the big source too.
    assert sum(len({r["source"] for r in plan if r["shard"] == s}) > 1 for s in {r["shard"] for r in plan}) >= 2


def test_same_on_every_run(spark, scratch):
    docs = [(i, "x" * (i % 50), "ab"[i % 2]) for i in range(200)]
    runs = [sorted((r["doc_id"], r["repeat_no"], r["shard"], r["position"]) for r in run(spark, scratch, d, [("a", 0.3, 2), ("b", 0.7, 2)]).plan.collect()) for d in (docs, docs[::-1])]
    assert runs[0] == runs[1]


def test_no_documents_and_bad_targets(spark, scratch):
    mix = run(spark, scratch, [], [("a", 1.0, 1)])
    assert mix.plan.count() == 0 and [(r["drawn_tokens"], r["actual_share"]) for r in mix.report.collect()] == [(0, 0.0)]
    for targets in ([("a", 0.5, 1), ("a", 0.5, 1)], [("a", -1.0, 1)], [("a", None, 1)]):
        with pytest.raises(ConfigError):
            run(spark, scratch, [(1, "x", "a")], targets)
