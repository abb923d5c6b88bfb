"""Train, validation and test splits that keep related groups together."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.ranking import rank_in_groups
from tidemark.session import Scratch


def components(members: DataFrame, group: str, entity: Sequence[str], scratch: Scratch) -> DataFrame:
    """(group_id, component): the least group id that is reached over shared entities, directly or through others.

    Alternating large-star and small-star steps on a table of edges, written to the shared folder each round, until the
    edges no longer change; the rounds grow with the logarithm of the longest chain. An entity links its groups by a
    star around the least of them, so an entity in a third of all groups gives as many edges as it has groups, not
    pairs. No edge or component comes to the driver.

    NULL group ids are left out; a row with a NULL in its entity links nothing, but its group is kept.
    """
    rows = members.select(col(group).alias("group_id"), *(col(c).alias(f"e{i}") for i, c in enumerate(entity))).filter("group_id IS NOT NULL").distinct()
    rows = scratch.table(rows, "rows")
    e = [f"e{i}" for i in range(len(entity))]
    linked = rows.dropna(subset=e)
    least = linked.groupBy(*e).agg(F.min("group_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    edges = scratch.table(linked.join(least, e).filter("group_id > least").select(F.col("group_id").alias("u"), F.col("least").alias("v")).distinct(), "edges0")

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        lowest = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = near.join(lowest, "u")
        if large:
            moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        return moved.filter("u > v").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    turn, before = 0, state(edges)
    while before[0]:
        edges = scratch.table(stars(scratch.table(stars(edges, True), f"large{turn}"), False), f"edges{turn + 1}")
        scratch.drop(f"large{turn}")
        scratch.drop(f"edges{turn}")
        turn, now = turn + 1, state(edges)
        if now == before:
            break
        before = now
    # Now every edge leads from a group to the least of its component.
    return rows.select("group_id").distinct().join(edges.select(F.col("u").alias("group_id"), F.col("v").alias("least")), "group_id", "left").select("group_id", F.coalesce("least", "group_id").alias("component"))


def linked_pairs(splits: DataFrame, group: str, chunk: int = 1_000) -> DataFrame:
    """({group}_a, {group}_b), a < b: all pairs of groups that splits (group, component, split) holds together.

    The rows are as many as there are pairs. The groups of a component are dealt into chunks of about `chunk`, and each
    group meets one chunk in a task, so that the pairs of one large component come from many tasks.
    """
    s = splits.select(col(group).alias("g"), "component", "split")
    many = s.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    s = s.join(many, "component")
    left = s.select(F.col("g").alias(f"{group}_a"), "component", "split", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    right = s.select(F.col("g").alias(f"{group}_b"), "component", "split", F.pmod(F.xxhash64("g"), F.col("chunks")).cast("int").alias("chunk"))
    return left.join(right, ["component", "split", "chunk"]).filter(col(f"{group}_a") < col(f"{group}_b")).select(f"{group}_a", f"{group}_b")


def _on_simplex(wanted: Sequence[Fraction], total: int) -> list[Fraction]:
    """The non-negative numbers with this total that are nearest to those wanted."""
    open_ = list(range(len(wanted)))
    while True:
        shift = (sum(wanted[k] for k in open_) - total) / len(open_)
        low = [k for k in open_ if wanted[k] < shift]
        if not low:
            return [wanted[k] - shift if k in open_ else Fraction(0) for k in range(len(wanted))]
        open_ = [k for k in open_ if k not in low]


class _Arc:
    """An arc whose cost is the distance from `part` steps of `step` units, straight between whole steps: three segments."""

    __slots__ = ("flow", "middle", "most", "high", "low", "rise")

    def __init__(self, part: Fraction, step: int, rise: int, most: int) -> None:
        whole = part.numerator // part.denominator
        self.low, self.high, self.most, self.rise = whole * step, (whole + 1) * step, most, rise
        self.middle = rise - int(2 * rise * (part - whole))  # rise is a multiple of the denominators
        self.flow = 0

    def forth(self) -> tuple[int, int] | None:
        """Cost of one more unit, and how many more have that cost."""
        f = self.flow
        if f >= self.most:
            return None
        if f < self.low:
            return -self.rise, min(self.low, self.most) - f
        if f < self.high:
            return self.middle, min(self.high, self.most) - f
        return self.rise, self.most - f

    def back(self) -> tuple[int, int] | None:
        """Cost of one unit less, and how many have that cost."""
        f = self.flow
        if f <= 0:
            return None
        if f <= self.low:
            return self.rise, f
        if f <= self.high:
            return -self.middle, f - self.low
        return -self.rise, f - self.high


def weight(size: int, widest: int) -> int:
    """Of one group of a component of this size, against the largest."""
    return widest // size


def flow_over(bundles: Sequence[tuple[int, int]], shares: Sequence[Fraction], goals: Sequence[Fraction]) -> list[list[int]]:
    """The min-cost flow of groups from all bundles (size, count) over all splits to the sink, in groups.

    source -> bundle carries size * count groups; bundle -> split costs how far the number of its components is from
    the bundle's proportional part (by shares), straight between whole components, where a component of a large size
    costs no more than one of a small size (weight), so that large ones make good for each other first; split -> sink
    costs how far the split is from its goal, and weighs more than any detour through bundles. Successive shortest
    paths: what is below both a bundle's part and the goals is the cheapest there is and never in the way, so its whole
    components are sent at once; then each path takes as much as its tightest segment. Between splits a path may take
    groups of a bundle back, so that a path is found among the splits alone, with the best bundle of each step on a heap.
    """
    total, n, widest = sum(s * c for s, c in bundles), len(goals), max(s for s, _ in bundles)
    unit = math.lcm(*((count * share).denominator for _, count in bundles for share in shares), *(g.denominator for g in goals))
    arcs = [[_Arc(count * share, size, unit * weight(size, widest), size * count if share else 0) for share in shares] for size, count in bundles]
    sinks = [_Arc(g, 1, 8 * n * unit * weight(1, widest), total) for g in goals]
    for (size, count), row in zip(bundles, arcs, strict=True):
        for a, share, g in zip(row, shares, goals, strict=True):
            a.flow = int(count * min(share, g / total)) * size
    left = []
    for k, sink in enumerate(sinks):
        sink.flow = sum(row[k].flow for row in arcs)
    for (size, count), row in zip(bundles, arcs, strict=True):
        left.append(size * count - sum(a.flow for a in row))
    enter: list[list] = [[] for _ in range(n)]
    swap: list[list[list]] = [[[] for _ in range(n)] for _ in range(n)]

    def step(b: int, j: int, k: int) -> tuple[int, int] | None:
        """Cost and room of moving groups of bundle b from split j to split k; j = -1 is the source."""
        to = arcs[b][k].forth()
        if j < 0:
            return None if to is None or not left[b] else (to[0], min(to[1], left[b]))
        gone = arcs[b][j].back()
        return None if to is None or gone is None else (to[0] + gone[0], min(to[1], gone[1]))

    def offer(b: int) -> None:
        for k in range(n):
            if found := step(b, -1, k):
                heapq.heappush(enter[k], (found[0], b))
            for j in range(n):
                if j != k and (found := step(b, j, k)):
                    heapq.heappush(swap[j][k], (found[0], b))

    def best(heap: list, j: int, k: int) -> tuple[int, int, int] | None:
        """The cheapest step that still costs what it did when it was offered."""
        while heap:
            cost, b = heap[0]
            found = step(b, j, k)
            if found and found[0] == cost:
                return cost, b, found[1]
            heapq.heappop(heap)
        return None

    for b in range(len(bundles)):
        offer(b)
    waiting = sum(left)
    while waiting:
        reach: list = [None] * n
        for k in range(n):
            if found := best(enter[k], -1, k):
                reach[k] = (found[0], [(found[1], -1, k, found[2])])
        moves = [(j, k, found) for j in range(n) for k in range(n) if j != k and (found := best(swap[j][k], j, k))]
        for _ in range(n - 1):
            for j, k, (cost, b, room) in moves:
                if reach[j] and all(j2 != k and k2 != k for _, j2, k2, _ in reach[j][1]) and (reach[k] is None or reach[j][0] + cost < reach[k][0]):
                    reach[k] = (reach[j][0] + cost, [*reach[j][1], (b, j, k, room)])
        ends = [(reach[k][0] + out[0], k, out[1]) for k in range(n) if reach[k] and (out := sinks[k].forth())]
        if not ends:
            raise ConfigError("the flow has no room")
        _, k, room = min(ends)
        path = reach[k][1]
        units = min(room, *(r for *_, r in path))
        touched = set()
        for b, j, to, _ in path:
            arcs[b][to].flow += units
            if j < 0:
                left[b] -= units
            else:
                arcs[b][j].flow -= units
            touched.add(b)
        sinks[k].flow += units
        waiting -= units
        for b in touched:
            offer(b)
    return [[a.flow for a in row] for row in arcs]


def allocate(bundles: Sequence[tuple[int, str, int]], shares: Sequence[Fraction]) -> list[list[int]]:
    """How many components of each bundle (size, profile, count) go to each split; whole numbers that add up to count.

    One min-cost flow over all bundles and splits (flow_over), then rounding: the few bundles whose flow is no whole
    number of components have their remaining components placed, largest first, where most is lacking; with them and
    all of their size or larger fixed, the flow is solved again for the smaller ones towards what the splits still
    lack, so that smaller components make good for what larger ones had to leave.
    """
    parts: list[list[int]] = [[0] * len(shares) for _ in bundles]
    quota = [s * sum(size * n for size, _, n in bundles) for s in shares]
    open_ = [i for i, (size, _, n) in enumerate(bundles) if size * n]
    while open_:
        total = sum(bundles[i][0] * bundles[i][2] for i in open_)
        wanted = [k for k, s in enumerate(shares) if s]
        near = _on_simplex([quota[k] for k in wanted], total)
        goals = [Fraction(0)] * len(shares)
        for k, g in zip(wanted, near, strict=True):
            goals[k] = g
        flows = dict(zip(open_, flow_over([(bundles[i][0], bundles[i][2]) for i in open_], shares, goals), strict=True))
        broken = [i for i in open_ if any(f % bundles[i][0] for f in flows[i])]
        least = min((bundles[i][0] for i in broken), default=0)
        done = [i for i in open_ if bundles[i][0] >= least]
        for i in done:
            parts[i] = [f // bundles[i][0] for f in flows[i]]
        # What the splits lack once the bundles that came out whole have their flow.
        lack = [q - sum(flows[i][k] for i in open_ if i not in set(broken)) - sum(bundles[i][0] * parts[i][k] for i in broken) for k, q in enumerate(quota)]
        for i in sorted(broken, key=lambda i: (-bundles[i][0], i)):
            size, rest = bundles[i][0], [f % bundles[i][0] for f in flows[i]]
            for _ in range(bundles[i][2] - sum(parts[i])):
                k = max(wanted, key=lambda k: (lack[k], rest[k], -k))
                parts[i][k] += 1
                lack[k] -= size
                rest[k] -= size
        for i in done:
            for k in range(len(shares)):
                quota[k] -= bundles[i][0] * parts[i][k]
        gone = set(done)
        open_ = [i for i in open_ if i not in gone]
    return parts


def grouped_splits(
    members: DataFrame,
    group: str,
    entity: Sequence[str],
    proportions: Mapping[str, float],
    scratch: Scratch,
    *,
    labels: DataFrame | None = None,
    seed: int = 0,
    max_bundles: int = 100_000,
) -> DataFrame:
    """(group, component, split): every group once, groups with an entity in common in the same split.

    `labels` is (group, label); groups are the unit of the proportions, and each label is spread over the splits in the
    same proportions as far as whole components allow. Components are bundled by size (number of groups) and label
    profile (how many groups of each label), bundles get whole numbers of components for each split (allocate), and
    within a bundle components are taken in the order of a seeded hash.

    What comes to the driver are the bundles, not the components: at most max_bundles, and more raise ConfigError, as
    any coarser bundling would give other splits. A bundle is a size with a profile, so there are few where components
    are small or labels few.

    Defined cases: repeated rows change nothing; NULL group ids are left out; groups with a NULL label, or with none,
    form a label of their own; an empty table gives an empty result; a component larger than every quota still goes to one split.
    """
    shares = [Fraction(p).limit_denominator(10**6) for p in proportions.values()]
    if not shares or any(s < 0 for s in shares) or sum(shares) != 1:
        raise ConfigError("proportions must be non-negative and add up to 1")
    whole = scratch.table(components(members, group, entity, scratch), "components")
    named = whole.withColumn("label", F.lit(""))
    if labels is not None:
        one = labels.select(col(labels.columns[0]).alias("group_id"), col(labels.columns[1]).cast("string").alias("label")).groupBy("group_id").agg(F.min("label").alias("label"))
        named = whole.join(one, "group_id", "left").withColumn("label", F.coalesce("label", F.lit("")))
    counted = named.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    profile = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.col("n").cast("string"), "label"))), ",")  # one entry per label
    profiled = scratch.table(counted.groupBy("component").agg(F.sum("n").alias("size"), profile.alias("profile")), "profiled")
    found = profiled.groupBy("size", "profile").agg(F.count(F.lit(1)).alias("n")).limit(max_bundles + 1).collect()
    if len(found) > max_bundles:
        raise ConfigError(f"more than {max_bundles} bundles of size and label profile; name fewer labels or raise max_bundles")
    bundles = sorted((r["size"], r["profile"], r["n"]) for r in found)
    spark = members.sparkSession
    limits = []
    for (size, label, _), parts in zip(bundles, allocate(bundles, shares), strict=True):
        first = 0
        for split, n in zip(proportions, parts, strict=True):
            if n:
                limits.append((size, label, first, first + n, split))
            first += n
    table = scratch.table(spark.createDataFrame(limits, "l_size bigint, l_profile string, after bigint, upto bigint, split string"), "limits")
    order = F.xxhash64(F.lit(seed), "component")
    ranked = rank_in_groups(profiled, ["size", "profile"], F.shiftrightunsigned(order, 52), [order, F.col("component")])
    placed = ranked.join(table, (F.col("size") == F.col("l_size")) & (F.col("profile") == F.col("l_profile")) & (F.col("rank") > F.col("after")) & (F.col("rank") <= F.col("upto")))
    return whole.join(placed.select("component", "split"), "component").select(F.col("group_id").alias(group), "component", "split")
