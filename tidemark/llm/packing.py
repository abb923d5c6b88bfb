"""Texts into containers of fixed capacity by a grouping genetic algorithm on distributed islands."""

from __future__ import annotations

import random
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator, Mapping, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.operators.ranking import rank_in_groups
from tidemark.session import Scratch, arrow_batches

Bins = list[list[int]]
ISLANDS_AT_ONCE = 32


def best_fit(order: Sequence[int], sizes: Sequence[int], capacity: int, bins: Bins) -> Bins:
    """Put the items of `order` into bins, each into the fullest that still takes it, else into a new one."""
    free = sorted((capacity - sum(sizes[i] for i in b), n) for n, b in enumerate(bins))
    for i in order:
        size = sizes[i]
        at = bisect_left(free, (size, -1))
        if at < len(free):
            room, n = free.pop(at)
            bins[n].append(i)
        else:
            room, n = capacity, len(bins)
            bins.append([i])
        if room > size:
            insort(free, (room - size, n))
        elif not size:
            insort(free, (room, n))
    return bins


def fitness(bins: Bins, sizes: Sequence[int], capacity: int) -> float:
    """Mean square of the fill: rewards few bins, and full ones beside emptier ones."""
    return sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / len(bins) if bins else 0.0


def least_bins(sizes: Sequence[int], capacity: int) -> int:
    """A number of bins that no packing is below: by tokens, and by the items that cannot share a bin (Martello and Toth's L2)."""
    ordered = sorted(sizes)
    sums = [0, *accumulate(ordered)]
    best = -(-sums[-1] // capacity)
    first_large = bisect_right(ordered, capacity // 2)  # from here on larger than half
    for small in sorted({0, *ordered[:first_large]}):
        # Larger than capacity - small: alone. Larger than half: apart from each other. From small to half: beside the latter, else in bins of their own.
        alone = bisect_right(ordered, capacity - small, first_large)
        low = bisect_left(ordered, small)
        room = (alone - first_large) * capacity - (sums[alone] - sums[first_large])
        best = max(best, len(ordered) - first_large - (-max(0, sums[first_large] - sums[low] - room) // capacity))
    return best


def _drop(bins: Bins, gone: set[int]) -> tuple[Bins, list[int]]:
    """Bins without an item of `gone`, and the other items of the bins that had one."""
    kept, displaced = [], []
    for b in bins:
        if gone.isdisjoint(b):
            kept.append(b)
        else:
            displaced += [i for i in b if i not in gone]
    return kept, displaced


def crossover(base: Bins, donor: Bins, sizes: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Whole well-filled bins of the donor go into the base; base bins that share an item with them are dissolved, and
    what was displaced is placed by best fit, largest first."""
    fills = sorted(((sum(sizes[i] for i in b), n) for n, b in enumerate(donor)), reverse=True)
    good = [n for fill, n in fills[: max(1, len(fills) // 2)]]
    taken = [donor[n] for n in rng.sample(good, max(1, len(good) // 3))]
    kept, displaced = _drop(base, {i for b in taken for i in b})
    displaced.sort(key=sizes.__getitem__, reverse=True)
    return best_fit(displaced, sizes, capacity, [*map(list, kept), *map(list, taken)])


def mutate(bins: Bins, sizes: Sequence[int], capacity: int, rng: random.Random) -> Bins:
    """Dissolve the emptiest bins and a few at random; best fit in a slightly shaken order."""
    order = sorted(range(len(bins)), key=lambda n: sum(sizes[i] for i in bins[n]))
    out = set(order[: max(1, len(order) // 20)]) | set(rng.sample(order, max(1, len(order) // 20)))
    loose = [i for n in out for i in bins[n]]
    loose.sort(key=lambda i: sizes[i] * (1 + 0.2 * rng.random()), reverse=True)
    return best_fit(loose, sizes, capacity, [list(b) for n, b in enumerate(bins) if n not in out])


def evolve(sizes: Sequence[int], capacity: int, starts: Sequence[Bins], population: int, generations: int, rng: random.Random) -> Bins:
    """The best packing after `generations` on one island that starts from `starts`, best fit decreasing and shaken orders.

    It ends early once a packing needs no more bins than any must. The result is never worse than a start or best fit decreasing.
    """
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    floor = least_bins(sizes, capacity)
    people = [list(map(list, s)) for s in starts if s]
    people.append(best_fit(order, sizes, capacity, []))
    if min(map(len, people)) > floor:
        while len(people) < population:
            shaken = sorted(order, key=lambda i: sizes[i] * (1 + 0.5 * rng.random()), reverse=True)
            people.append(best_fit(shaken, sizes, capacity, []))
    scored = sorted(((len(p), -fitness(p, sizes, capacity), n, p) for n, p in enumerate(people)))
    for number in range(len(people), len(people) + generations):
        if scored[0][0] <= floor:
            break
        a, b = rng.sample(range(len(scored)), 2) if len(scored) > 1 else (0, 0)
        child = crossover(scored[min(a, b)][3], scored[max(a, b)][3], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        scored = sorted([*scored, (len(child), -fitness(child, sizes, capacity), number, child)])[:population]
    return scored[0][3]


_STATE = "spec_name string, shard int, island int, capacity int, sizes array<int>, bins array<int>, migrant array<int>, n_bins int, score double, proven boolean"


def _bins_of(numbers: Sequence[int] | None) -> Bins:
    """Bins from each item's bin number."""
    bins: dict[int, list[int]] = {}
    for i, n in enumerate(numbers or ()):
        bins.setdefault(n, []).append(i)
    return [bins[n] for n in sorted(bins)]


def _islands(population: int, generations: int, seed: int, turn: int):
    """One turn of each island in a batch, from its own elite and the one that migrated to it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                if r["proven"]:
                    continue
                sizes, capacity = r["sizes"], r["capacity"]
                rng = random.Random(f"{seed}/{r['spec_name']}/{r['shard']}/{r['island']}/{turn}")
                best = evolve(sizes, capacity, [_bins_of(r["bins"]), _bins_of(r["migrant"])], population, generations, rng)
                numbers = [0] * len(sizes)
                for n, items in enumerate(best):
                    for i in items:
                        numbers[i] = n
                r |= {"bins": numbers, "n_bins": len(best), "score": fitness(best, sizes, capacity), "proven": len(best) <= least_bins(sizes, capacity)}
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return run


def _dealt(items: DataFrame, shards: Mapping[str, int], seed: int) -> DataFrame:
    """items with the shard of each: by their rank in size, so that shards have sizes alike; equal sizes in the order of a hash."""
    order = F.xxhash64(F.lit(seed), "doc_id", "piece_no")
    bucket = F.shiftleft(F.col("size").cast("bigint"), 8) + F.shiftrightunsigned(order, 56)
    ranked = rank_in_groups(items, ["spec_name"], bucket, [order, F.col("doc_id"), F.col("piece_no")])
    many = F.element_at(F.create_map(*(F.lit(x) for pair in shards.items() for x in pair)), F.col("spec_name")) if shards else F.lit(1)
    return ranked.withColumn("shard", F.pmod(F.col("rank"), many).cast("int")).drop("rank")


def _evolved(items: DataFrame, scratch: Scratch, name: str, islands: int, turns: int, population: int, generations: int, seed: int) -> DataFrame:
    """items (spec_name, shard, capacity, doc_id, piece_no, size) with bin_no and the bin's tokens: each shard's best packing of all islands.

    An island is one row with its shard's sizes and its elite's bin numbers, so what moves between turns is one row for
    each island, whatever the documents are.
    """
    spark = items.sparkSession
    of = Window.partitionBy("spec_name", "shard")
    entries = F.sort_array(F.collect_list(F.struct("doc_id", "piece_no", "size")))  # a shard, of about shard_items
    shards = scratch.table(items.groupBy("spec_name", "shard").agg(F.first("capacity").alias("capacity"), entries.alias("items")), f"{name}_shards")
    none = F.lit(None).cast("array<int>")
    state = shards.select("spec_name", "shard", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "capacity", F.col("items.size").alias("sizes"), none.alias("bins"), none.alias("migrant"), F.lit(0).alias("n_bins"), F.lit(0.0).alias("score"), F.lit(False).alias("proven"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, so that few bytes are not gathered in few tasks
    with arrow_batches(spark, ISLANDS_AT_ONCE):
        for turn in range(turns):
            state = scratch.table(state.repartition(tasks, "spec_name", "shard", "island").mapInArrow(_islands(population, generations, seed, turn), _STATE), f"{name}_turn")
            if turn:
                scratch.drop_before(f"{name}_turn")
            if turn + 1 < turns:
                ring = of.orderBy("island")
                comes = F.coalesce(F.lag("bins").over(ring), F.last("bins").over(of.orderBy("island").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
                # Where an island's packing is proven to be the best there is, the others of its shard rest too.
                state = state.withColumns({"migrant": comes, "proven": F.max("proven").over(of)}).select(*state.columns)
    best = state.withColumn("no", F.row_number().over(of.orderBy("n_bins", F.desc("score"), "island"))).filter("no = 1 AND n_bins > 0").select("spec_name", "shard", "bins")
    rows = shards.join(best, ["spec_name", "shard"]).select("spec_name", "shard", "capacity", F.explode(F.arrays_zip("items", "bins")).alias("x"))
    rows = rows.select("spec_name", "shard", "capacity", "x.items.doc_id", "x.items.piece_no", "x.items.size", F.col("x.bins").alias("bin_no"))
    return scratch.table(rows, f"{name}_packed")


def pack(
    documents: DataFrame,
    specs: DataFrame,
    scratch: Scratch,
    *,
    doc_id: str = "doc_id",
    size: Column,
    shard_items: int = 20_000,
    islands: int = 8,
    turns: int = 4,
    population: int = 6,
    generations: int = 10,
    seed: int = 0,
) -> DataFrame:
    """(spec_name, container_id, doc_id, piece_no, piece_start, piece_size): every text in containers of every spec.

    `size` is a text's size in tokens, specs is (spec_name, capacity). A text larger than the capacity is cut into
    pieces of exactly the capacity and a rest; nothing else is cut. Pieces, rests and texts are packed by a grouping
    genetic algorithm: in the order of their sizes they are dealt into shards of about shard_items, so that each shard
    has the same mix of sizes as the whole, and each shard is worked on by several islands. An island keeps a population of packings, crosses them by injecting whole well-filled bins, dissolving bins
    that hold the same items and placing the displaced by best fit, and mutates some. After each turn an island's elite
    stays and also migrates to the next island of the shard, in a ring; after the last turn the shard takes its best
    (fewest bins, then the most uneven fill). An island rests once its packing has no more bins than any packing of the
    shard must have. Then the emptiest fiftieth of every shard's bins is dissolved, and what was in them is packed by the
    same algorithm in shards of its own, so that many shards do not leave many bins half empty. Random numbers depend on
    spec, shard, island and turn only, so that a task run again gives the same.

    Scale: only document ids and sizes are shuffled, a task's memory is one shard, all cost is in proportion to the
    documents. The pieces of one very large text are spread over shards like any other items, and equal sizes over
    256 buckets of the dealing.

    Defined cases: a NULL or empty text has size 0 and shares a container; rows with the same document id count once,
    with their greatest size; NULL ids are left out; specs with a capacity that is NULL or not positive raise; no documents give no rows.
    """
    wanted = [(r[0], r[1]) for r in specs.select(specs.columns[0], specs.columns[1]).distinct().collect()]
    if any(c is None or not 1 <= c < 1 << 31 for _, c in wanted) or min(shard_items, islands, turns) < 1 or population < 2:
        raise ConfigError("capacities, shards, islands and turns must be positive, a population at least 2")
    sized = documents.select(col(doc_id).alias("doc_id"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("size")).filter("doc_id IS NOT NULL")
    sized = scratch.table(sized.groupBy("doc_id").agg(F.max("size").alias("size")), "sized")
    pieces = [F.greatest(F.ceil(F.col("size") / c), F.lit(1)).cast("bigint") for _, c in wanted]
    counts = sized.agg(*(F.coalesce(F.sum(p), F.lit(0)) for p in pieces)).first() if wanted else ()
    spec = F.explode(F.array(*(F.struct(F.lit(n).alias("spec_name"), F.lit(c).cast("bigint").alias("capacity")) for n, c in wanted)))
    cut = sized.select("doc_id", "size", spec.alias("s")).select("s.*", "doc_id", "size")
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity")) - 1, F.lit(0)).cast("int")
    items = cut.withColumn("piece_no", F.explode(F.sequence(F.lit(0), last)))
    items = items.select("spec_name", F.col("capacity").cast("int").alias("capacity"), "doc_id", "piece_no", F.least(F.col("capacity"), F.col("size") - F.col("piece_no") * F.col("capacity")).cast("int").alias("size"))
    shards = {n: max(1, -(-count // shard_items)) for (n, _), count in zip(wanted, counts, strict=True)}
    packed = _evolved(_dealt(scratch.table(items, "items"), shards, seed), scratch, "first", islands, turns, population, generations, seed)
    bins = packed.groupBy("spec_name", "shard", "bin_no").agg(F.sum("size").alias("tokens"))
    of = Window.partitionBy("spec_name", "shard")
    emptiest = F.row_number().over(of.orderBy("tokens", "bin_no")) <= F.greatest(F.count(F.lit(1)).over(of) / 50, F.lit(1))  # a shard's bins
    emptiest = bins.withColumn("loose", emptiest).filter("loose").select("spec_name", "shard", "bin_no", "loose")
    marked = scratch.table(packed.join(emptiest, ["spec_name", "shard", "bin_no"], "left"), "marked")
    loose = scratch.table(marked.filter("loose").select("spec_name", "capacity", "doc_id", "piece_no", "size"), "loose")
    shards = {r["spec_name"]: max(1, -(-r["n"] // shard_items)) for r in loose.groupBy("spec_name").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per spec
    rest = _evolved(_dealt(loose, shards, seed + 1), scratch, "rest", islands, turns, population, generations, seed + 1)
    named = marked.filter("loose IS NULL").select("*", F.concat_ws("/", "spec_name", "shard", "bin_no").alias("container_id"))
    rest = rest.select("*", F.concat_ws("/", "spec_name", F.lit("rest"), "shard", "bin_no").alias("container_id"))
    both = named.drop("loose").unionByName(rest)
    return both.select("spec_name", "container_id", "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * F.col("capacity")).alias("piece_start"), F.col("size").cast("bigint").alias("piece_size"))


def fill_report(packed: DataFrame, capacities: Mapping[str, int]) -> DataFrame:
    """Per spec: containers, tokens, the least number of containers that could do, and the share that is filled."""
    capacity = F.element_at(F.create_map(*(F.lit(x) for pair in capacities.items() for x in pair)), F.col("spec_name")).cast("bigint")
    used = packed.groupBy("spec_name", "container_id").agg(F.sum("piece_size").alias("tokens"))
    found = used.groupBy("spec_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return found.select("spec_name", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / capacity).alias("containers_at_least"), (F.col("tokens") / (F.col("containers") * capacity)).alias("filled"))
