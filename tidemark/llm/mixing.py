"""A training run that mixes sources to target shares, drawn by a splitting tree of exact block quotas."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.ranking import rank_in_groups, sum_before
from tidemark.session import Scratch


MOST_BLOCKS = 1_000_000_000  # that the generator can draw from at once


def node_draw(counts: np.ndarray, shards_left: int, shards: int, seed: int, low: int, high: int) -> np.ndarray:
    """How many blocks of each source the left half of a node takes: multivariate hypergeometric, fixed by the node."""
    total = int(counts.sum())
    if total >= MOST_BLOCKS:
        raise ConfigError(f"{total} blocks are too many to draw from; block_tokens must be larger")
    take = (total * shards_left * 2 + shards) // (2 * shards)
    rng = np.random.Generator(np.random.Philox(key=[seed & (2**64 - 1), (low << 32) | high]))
    return rng.multivariate_hypergeometric(counts, take, method="marginals")


def deal(source: np.ndarray, place: np.ndarray, counts: Sequence[int], shards: int, seed: int) -> np.ndarray:
    """The shard of each block, given its source's number and its place in the source's permuted order.

    The tree halves the shards; at each node the blocks of every source are divided between the halves in exact numbers
    that add up to the halves' sizes, and the first places go left. Each call walks only the nodes its blocks are in, so
    tasks need nothing but counts and seed, and together they place every block exactly once.
    """
    shard = np.zeros(len(source), dtype=np.int64)
    stack = [(0, shards, np.asarray(counts, dtype=np.int64), np.arange(len(source)), np.asarray(place, dtype=np.int64))]
    while stack:
        low, high, quota, rows, at = stack.pop()
        if not len(rows):
            continue
        if high - low == 1:
            shard[rows] = low
            continue
        middle = (low + high) // 2
        left = node_draw(quota, middle - low, high - low, seed, low, high)
        mine = left[source[rows]]
        goes = at < mine
        stack.append((low, middle, left, rows[goes], at[goes]))
        stack.append((middle, high, quota - left, rows[~goes], (at - mine)[~goes]))
    return shard


class Mix:
    """A mixed run: `report` per source of the targets, `plan` with one row per drawn document and repeat."""

    def __init__(self, plan: DataFrame, report: DataFrame) -> None:
        self.plan, self.report = plan, report


def mix_sources(
    documents: DataFrame,
    targets: DataFrame,
    scratch: Scratch,
    *,
    doc_id: str,
    source: str,
    size: Column,
    run_tokens: int | None = None,
    block_tokens: int = 1 << 20,
    shard_tokens: int = 16 << 20,
    seed: int = 0,
    max_sources: int = 10_000,
) -> Mix:
    """Draw documents so that each source holds its share of a run of run_tokens (default: all documents together).

    targets is (source, target_share, max_repeats). A source gives target_share * run_tokens, but never more than
    max_repeats times itself; what is short is not made up by others, and the report says so. Documents are dealt by
    hash into blocks of about block_tokens, so blocks are random and disjoint; each repeat takes the blocks in an order
    of its own. The last block of a source is cut at the document that reaches the quota. The drawn blocks are
    numbered per source in permuted order and dealt to output shards by the splitting tree (deal), and rows are
    shuffled within their shard by hash.

    plan: (doc_id, source, repeat_no, size, shard, position). report: (source, target_share, max_repeats, target_tokens,
    available_tokens, cap_tokens, drawn_tokens, drawn_documents, repeats, actual_share); target_tokens is
    target_share * run_tokens as a double.

    Scale: documents are shuffled once as (id, source, size); a hot source is spread by its blocks, and the orders of
    its blocks and their running totals are found by buckets of a hash, so no source is sorted in one task. At most
    max_sources targets come to the driver, with two numbers each. A run has fewer than MOST_BLOCKS blocks, or
    ConfigError is raised: with blocks of the default size that is 10^15 tokens.

    Defined cases: a source without documents draws nothing; sources that are no target are not drawn; NULL sources
    are no target; a NULL or empty text has size 0 and is drawn with its block; the same document id counts once, with
    its greatest size; NULL ids are left out; no documents give an empty plan and zeros in the report.
    """
    if min(block_tokens, shard_tokens) < 1:
        raise ConfigError("block_tokens and shard_tokens must be positive")
    d = documents.select(col(doc_id).alias("doc_id"), col(source).alias("source"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("size")).filter("doc_id IS NOT NULL")
    d = scratch.table(d.groupBy("doc_id").agg(F.max(F.struct("size", "source")).alias("v")).select("doc_id", "v.source", "v.size"), "sized")
    t = targets.select(*(col(c).alias(a) for c, a in zip(targets.columns[:3], ("source", "target_share", "max_repeats"), strict=True))).filter("source IS NOT NULL")
    wanted = t.limit(max_sources + 1).collect()
    if len(wanted) > max_sources or len({r["source"] for r in wanted}) < len(wanted):
        raise ConfigError("targets must name each source once, and not more than max_sources")
    if any(r["target_share"] is None or r["max_repeats"] is None or r["target_share"] < 0 or r["max_repeats"] < 0 for r in wanted):
        raise ConfigError("shares and repeats must be set and not negative")
    have = {r["source"]: r["n"] for r in d.groupBy("source").agg(F.sum("size").alias("n")).join(F.broadcast(t.select("source")), "source", "left_semi").collect()}
    total = run_tokens if run_tokens is not None else (d.agg(F.sum("size")).first()[0] or 0)
    names = sorted(r["source"] for r in wanted)
    facts = []
    for r in sorted(wanted, key=lambda r: r["source"]):
        own, goal = have.get(r["source"], 0), r["target_share"] * total
        draw = min(math.ceil(goal), r["max_repeats"] * own)
        facts.append((r["source"], names.index(r["source"]), r["target_share"], r["max_repeats"], goal, own, r["max_repeats"] * own, draw, max(1, math.ceil(own / block_tokens)), math.ceil(draw / own) if own else 0))
    spark = documents.sparkSession
    shape = "source string, source_no int, target_share double, max_repeats int, target_tokens double, available_tokens bigint, cap_tokens bigint, quota bigint, n_blocks bigint, epochs bigint"
    f = F.broadcast(spark.createDataFrame(facts, shape))  # at most max_sources rows
    marked = d.join(f.select("source", "source_no", "n_blocks"), "source").select("doc_id", "source_no", "size", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), "n_blocks").alias("block"))
    marked = scratch.table(marked.repartition("source_no", "block"), "marked")
    blocks = marked.groupBy("source_no", "block").agg(F.sum("size").alias("tokens"))
    turns = blocks.join(f.select("source_no", "quota", "epochs"), "source_no").filter("epochs > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)))
    turns = scratch.table(turns, "turns")
    # Whole repeats one after the other, blocks in the order of a hash; a bucket is a repeat and the hash's first bits.
    order = F.xxhash64(F.lit(seed + 1), "repeat_no", "block")
    summed = sum_before(turns, ["source_no"], F.shiftleft("repeat_no", 12) + F.shiftrightunsigned(order, 52), [order, F.col("block")], "tokens", "before")
    drawn = scratch.table(summed.filter("before < quota").select("source_no", "block", "repeat_no", "tokens", (F.col("quota") - F.col("before")).alias("room")), "taken")
    shuffled = F.xxhash64(F.lit(seed + 2), "repeat_no", "block")
    drawn = rank_in_groups(drawn, ["source_no"], F.shiftrightunsigned(shuffled, 52), [shuffled, F.col("repeat_no"), F.col("block")])
    drawn = scratch.table(drawn.withColumn("place", F.col("rank") - 1).drop("rank"), "drawn")
    per_source = {r["source_no"]: (r["n"], r["tokens"]) for r in drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("tokens", "room")).alias("tokens")).collect()}
    counts = [per_source.get(i, (0, 0))[0] for i in range(len(names))]
    shards = max(1, min(sum(counts), math.ceil(sum(x[1] for x in per_source.values()) / shard_tokens)))

    def place(batches):
        for b in batches:
            shard = deal(b["source_no"].to_numpy(zero_copy_only=False), b["place"].to_numpy(zero_copy_only=False), counts, shards, seed)
            yield pa.RecordBatch.from_arrays([b["source_no"], b["block"], b["repeat_no"], b["tokens"], b["room"], pa.array(shard, pa.int64())], names=["source_no", "block", "repeat_no", "tokens", "room", "shard"])

    dealt = scratch.table(drawn.mapInArrow(place, "source_no int, block bigint, repeat_no bigint, tokens bigint, room bigint, shard bigint"), "dealt")
    rows = marked.join(dealt, ["source_no", "block"])
    within = Window.partitionBy("source_no", "block", "repeat_no").orderBy(F.xxhash64(F.lit(seed + 3), "repeat_no", "doc_id"), "doc_id")
    cut = rows.filter("tokens > room").withColumn("ahead", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("ahead < room").drop("ahead")
    rows = rows.filter("tokens <= room").unionByName(cut)
    local = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 4), "repeat_no", "doc_id"), "doc_id", "repeat_no")
    plan = rows.join(f.select("source_no", "source"), "source_no").select("doc_id", "source", "repeat_no", "size", "shard", F.row_number().over(local).alias("position"))
    plan = scratch.table(plan, "plan")
    reached = plan.groupBy("source").agg(F.sum("size").alias("drawn_tokens"), F.count(F.lit(1)).alias("drawn_documents"), (F.max("repeat_no") + 1).alias("repeats"))
    everything = plan.agg(F.sum("size")).first()[0] or 0
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    report = f.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "target_tokens", "available_tokens", "cap_tokens", zero("drawn_tokens"), zero("drawn_documents"), zero("repeats"),
        (F.coalesce(F.col("drawn_tokens"), F.lit(0)) / F.lit(max(1, everything))).alias("actual_share"),
    )
    return Mix(plan, report)
