"""Queries p4, p5, p8, p9 and p10 over the test tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.canon import ARCHETYPES, code_of, value_of
from tidemark.llm.encodings import find_garbled, restore
from tidemark.llm.grouped_splits import grouped_splits, linked_pairs
from tidemark.llm.made_cases import made_cases
from tidemark.llm.mixing import Mix, mix_sources
from tidemark.llm.packing import fill_report, pack
from tidemark.llm.quantiles import K, estimates, exact_percentiles, merge_sketches, rank_error, sketches
from tidemark.operators.copies import one_per_key
from tidemark.session import Scratch

SHARES = {"p50": (50, 100), "p90": (90, 100), "p95": (95, 100), "p99": (99, 100)}
PROPORTIONS = {"train": 0.8, "validation": 0.1, "test": 0.1}
BATCH_SECONDS = 7 * 86_400


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_tokens(text: str = "text"):
    """Size of a text in the byte-level tokenization: its UTF-8 bytes."""
    return F.octet_length(text)


def owner_amounts(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """(event_id, archetype, batch, amount_minor) of the transactions whose source account has an owner with an archetype."""
    people = table(spark, sf_dir, "person_archetypes").select("person_id", code_of(F.col("archetype"), ARCHETYPES, upper=False).alias("code"))
    people = one_per_key(people, ["person_id"], ["code"])
    accounts = one_per_key(table(spark, sf_dir, "accounts"), ["account_id"], ["owner_person_id"])
    owners = accounts.join(people, F.col("owner_person_id") == F.col("person_id")).select("account_id", "code").filter("code IS NOT NULL")
    owners = scratch.table(owners, "owners").hint("merge")  # as many as there are accounts, so it is never broadcast
    sent = one_per_key(table(spark, sf_dir, "transactions"), ["event_id"], ["src_account_id", "amount_minor", "ts"])
    rows = sent.join(owners, F.col("src_account_id") == F.col("account_id")).select("event_id", value_of(F.col("code"), ARCHETYPES).alias("archetype"), F.floor(F.col("ts") / BATCH_SECONDS).alias("batch"), "amount_minor")
    return scratch.table(rows, "amounts")


def _percentiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The amounts, and per archetype the exact percentiles; sketches are made per week and merged."""
    scratch = Scratch(spark, "p4")
    amounts = owner_amounts(spark, sf_dir, scratch)
    merged = merge_sketches(sketches(amounts, ["archetype", "batch"], "amount_minor"), ["archetype"])
    return amounts, exact_percentiles(amounts, ["archetype"], "amount_minor", SHARES, scratch, merged)


def p4_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir)[1]


def p4_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The percentiles as the merged weekly sketches alone give them."""
    amounts = owner_amounts(spark, sf_dir, Scratch(spark, "p4"))
    return estimates(merge_sketches(sketches(amounts, ["archetype", "batch"], "amount_minor"), ["archetype"]), ["archetype"], SHARES)


def p4_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archetype, percentile, n, within): whether the merged sketches' estimate has a rank as near to the true one as promised.

    The share of amounts below the estimate may not exceed the percentile by more than twice the rank error, nor that
    of amounts at or below it fall short by more.
    """
    scratch = Scratch(spark, "p4")
    amounts = owner_amounts(spark, sf_dir, scratch)
    found = scratch.table(estimates(merge_sketches(sketches(amounts, ["archetype", "batch"], "amount_minor"), ["archetype"]), ["archetype"], SHARES), "estimates")
    e = found.select(F.col("archetype").alias("of"), *SHARES)
    joined = amounts.join(e, F.col("archetype") == F.col("of"))
    sums = [x for name in SHARES for x in (F.count_if(F.col("amount_minor") < F.col(name)).alias(f"below_{name}"), F.count_if(F.col("amount_minor") <= F.col(name)).alias(f"upto_{name}"))]
    ranks = joined.groupBy("archetype").agg(F.count(F.lit(1)).alias("n"), *sums)
    most = 2 * rank_error(K)
    cells = F.array(*(F.struct(F.lit(name).alias("percentile"), ((F.col(f"below_{name}") <= (p / q + most) * F.col("n")) & (F.col(f"upto_{name}") >= (p / q - most) * F.col("n"))).alias("within")) for name, (p, q) in SHARES.items()))
    return ranks.select("archetype", "n", F.explode(cells).alias("c")).select("archetype", "c.percentile", "n", "c.within")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts, percentiles = _percentiles(spark, sf_dir)
    limits = percentiles.select(F.col("archetype").alias("of"), "p99")
    return amounts.join(limits, F.col("archetype") == F.col("of")).filter("amount_minor > 20 * p99").select("event_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every network with its component and split; families are spread over the splits in proportion."""
    families = table(spark, sf_dir, "scenario_networks").select("network_id", "family")
    return grouped_splits(table(spark, sf_dir, "network_members"), "network_id", ["entity_type", "entity_id"], PROPORTIONS, Scratch(spark, "p5"), labels=families)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one component that the allocation put into the same split."""
    return linked_pairs(Scratch(spark, "p5").table(p5_splits(spark, sf_dir), "splits"), "network_id")


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(what, n): how many networks and components there are, and how many break a rule of the splits."""
    scratch = Scratch(spark, "p5")
    splits = scratch.table(p5_splits(spark, sf_dir), "splits")
    members = table(spark, sf_dir, "network_members").select("network_id", "entity_type", "entity_id").distinct()
    apart = members.join(splits, "network_id").groupBy("entity_type", "entity_id").agg(F.countDistinct("split").alias("n"))
    torn = splits.groupBy("component").agg(F.countDistinct("split").alias("n"))
    total, largest = splits.count(), splits.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    shares = F.element_at(F.create_map(*(F.lit(x) for pair in PROPORTIONS.items() for x in pair)), F.col("split"))
    off = splits.groupBy("split").agg(F.count(F.lit(1)).alias("n")).filter(F.abs(F.col("n") - shares * total) > largest)
    facts = {
        "networks": splits.select("network_id").distinct(),
        "components": splits.select("component").distinct(),
        "entities in several splits": apart.filter("n > 1"),
        "components in several splits": torn.filter("n > 1"),
        "networks without a split": members.select("network_id").distinct().join(splits, "network_id", "left_anti"),
        "splits off their quota by more than a component": off,
    }
    out = None
    for what, rows in facts.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"), Scratch(spark, "p8"), size=byte_tokens())


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the containers are filled, per spec."""
    capacities = {r["spec_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "container_specs").collect()}
    return fill_report(p8_containers(spark, sf_dir), capacities)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which a second piece lies in a container."""
    return p8_containers(spark, sf_dir).filter("piece_no = 1").select("spec_name", "doc_id")


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(spec_name, documents, pieces, tokens, overfull, torn, loose): what was packed, and how many rules are broken.

    loose is 1 where there are over 2 % (and one) more containers than there must be, by tokens or by the pieces over
    half a container, which cannot share one with each other.
    """
    capacity = table(spark, sf_dir, "container_specs").select("spec_name", F.col("capacity_tokens").cast("bigint").alias("capacity"))
    packed = Scratch(spark, "p8").table(p8_containers(spark, sf_dir).join(F.broadcast(capacity), "spec_name"), "packed")  # a row per spec
    loads = packed.groupBy("spec_name", "container_id", "capacity").agg(F.sum("piece_size").alias("load"))
    full = loads.groupBy("spec_name").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"), F.count(F.lit(1)).alias("containers"), (F.sum("load") / F.first("capacity")).alias("least"))
    texts = packed.groupBy("spec_name", "doc_id", "capacity").agg(F.count(F.lit(1)).alias("n"), F.max("piece_no").alias("last"), F.countDistinct("piece_no").alias("different"), F.sum("piece_size").alias("size"), F.count_if((F.col("piece_start") != F.col("piece_no") * F.col("capacity"))).alias("misplaced"))
    texts = texts.withColumn("torn", (F.col("n") != F.col("last") + 1) | (F.col("different") != F.col("n")) | (F.col("misplaced") > 0) | (F.col("n") != F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1))))
    whole = texts.groupBy("spec_name").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("pieces"), F.sum("size").alias("tokens"), F.count_if("torn").alias("torn"))
    large = packed.groupBy("spec_name").agg(F.count_if(2 * F.col("piece_size") > F.col("capacity")).alias("large"))
    many = F.col("containers") > 1.02 * F.greatest("large", "least") + 1
    return whole.join(full, "spec_name").join(large, "spec_name").select("spec_name", "documents", "pieces", "tokens", "overfull", "torn", many.cast("int").cast("bigint").alias("loose"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    targets = table(spark, sf_dir, "mix_targets").select("source", "target_share", "max_repeats")
    return mix_sources(table(spark, sf_dir, "documents"), targets, Scratch(spark, "p9"), doc_id="doc_id", source="source", size=byte_tokens())


def p9_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).plan


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir).report


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that gave all they could, as often as they may, and still fell short of their share."""
    return _mix(spark, sf_dir).report.filter("drawn_tokens < target_tokens").select("source")


def p9_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, tokens_short, broken): what is missing of each share, and how many rules the drawn plan breaks."""
    mix = _mix(spark, sf_dir)
    size = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("d"), byte_tokens().alias("whole"), F.col("source").alias("of"))
    drawn = mix.plan.join(size, F.col("doc_id") == F.col("d"), "left")
    wrong = drawn.groupBy("source").agg(F.count_if((F.col("size") != F.col("whole")) | (F.col("source") != F.col("of")) | F.col("whole").isNull()).alias("wrong"))
    twice = mix.plan.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repeat_no").alias("turns"))
    twice = twice.groupBy("source").agg(F.count_if(F.col("n") != F.col("turns")).alias("twice"), F.max("n").alias("most"))
    places = mix.plan.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("places"), F.max("position").alias("last"))
    gaps = places.filter("n != places OR n != last").count()  # a row per shard
    r = mix.report.join(wrong, "source", "left").join(twice, "source", "left")
    largest = size.groupBy("of").agg(F.max("whole").alias("largest")).withColumnRenamed("of", "source")
    over = F.col("drawn_tokens") > F.ceil("target_tokens") + F.coalesce("largest", F.lit(0))
    broken = F.coalesce("wrong", F.lit(0)) + F.coalesce("twice", F.lit(0)) + F.coalesce(F.col("most") > F.col("max_repeats"), F.lit(False)).cast("int") + over.cast("int")
    short = F.greatest(F.ceil("target_tokens") - F.col("drawn_tokens"), F.lit(0)).cast("bigint")
    return r.join(largest, "source", "left").select("source", short.alias("tokens_short"), (broken + F.lit(gaps)).cast("bigint").alias("broken"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_garbled(table(spark, sf_dir, "documents"), Scratch(spark, "p10")).documents.select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return restore(documents, find_garbled(documents, Scratch(spark, "p10")))


def p10_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looks wrongly decoded, but stands in markup that shows characters on purpose."""
    return find_garbled(table(spark, sf_dir, "documents"), Scratch(spark, "p10")).shown


def p10_made(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many made cases of each chain are found and restored among all documents."""
    return made_cases(table(spark, sf_dir, "documents"), Scratch(spark, "p10"))


QUERIES = {f.__name__: f for f in (p10_found, p10_restored, p10_shown, p10_made, p4_found, p4_percentiles, p4_estimates, p4_bounds, p5_found, p5_splits, p5_checks, p8_found, p8_fill, p8_containers, p8_checks, p9_found, p9_shares, p9_plan, p9_checks)}

_OWNED = """t AS (SELECT event_id, min(src_account_id) AS src_account_id, min(amount_minor) AS amount_minor FROM transactions GROUP BY event_id),
a AS (SELECT account_id, min(owner_person_id) AS owner_person_id FROM accounts GROUP BY account_id),
p AS (SELECT person_id, min(regexp_replace(lower(trim(archetype, ' ' || chr(9))), '[ -]', '_', 'g')) AS archetype FROM person_archetypes GROUP BY person_id),
o AS (SELECT event_id, amount_minor, archetype FROM t JOIN a ON account_id = src_account_id JOIN p ON person_id = owner_person_id)"""
_PERCENTILES = ", ".join(f"quantile_disc(amount_minor, {p / q}) AS {name}" for name, (p, q) in SHARES.items())

SQL = {
    "p4_percentiles": f"WITH {_OWNED} SELECT archetype, count(*) AS n, {_PERCENTILES} FROM o GROUP BY archetype",
    "p4_bounds": f"WITH {_OWNED} SELECT archetype, percentile, count(*) AS n, true AS within FROM o, (SELECT unnest({list(SHARES)}) AS percentile) GROUP BY ALL",
    "p4_found": f"WITH {_OWNED}, q AS (SELECT archetype, quantile_disc(amount_minor, 0.99) AS p99 FROM o GROUP BY archetype) SELECT event_id FROM o JOIN q USING (archetype) WHERE amount_minor > 20 * p99",
    "p5_found": """WITH RECURSIVE m AS (SELECT DISTINCT network_id, entity_type, entity_id FROM network_members),
e AS (SELECT DISTINCT x.network_id AS a, y.network_id AS b FROM m x JOIN m y USING (entity_type, entity_id)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b) SELECT DISTINCT a AS network_id_a, b AS network_id_b FROM r WHERE a < b""",
    "p5_checks": """WITH RECURSIVE m AS (SELECT DISTINCT network_id, entity_type, entity_id FROM network_members),
e AS (SELECT DISTINCT x.network_id AS a, y.network_id AS b FROM m x JOIN m y USING (entity_type, entity_id)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT 'networks' AS what, count(*) AS n FROM c UNION ALL SELECT 'components', count(DISTINCT least) FROM c
UNION ALL SELECT unnest(['entities in several splits', 'components in several splits', 'networks without a split', 'splits off their quota by more than a component']), 0""",
    "p8_checks": """WITH s AS (SELECT doc_id, max(coalesce(octet_length(encode(text)), 0)) AS size FROM documents GROUP BY doc_id)
SELECT spec_name, count(*) AS documents, CAST(sum(greatest(1, (size + capacity_tokens - 1) // capacity_tokens)) AS BIGINT) AS pieces, CAST(sum(size) AS BIGINT) AS tokens, 0 AS overfull, 0 AS torn, 0 AS loose FROM s, container_specs GROUP BY spec_name""",
    "p9_checks": """WITH s AS (SELECT source, sum(octet_length(encode(text))) AS n FROM documents GROUP BY source), a AS (SELECT source, coalesce(n, 0) AS n, max_repeats, target_share * (SELECT sum(n) FROM s) AS goal FROM mix_targets LEFT JOIN s USING (source))
SELECT source, CAST(greatest(ceil(goal) - least(ceil(goal), max_repeats * n), 0) AS BIGINT) AS tokens_short, 0 AS broken FROM a""",
    "p8_found": "SELECT spec_name, doc_id FROM documents, container_specs WHERE octet_length(encode(text)) > capacity_tokens",
    "p9_found": """WITH s AS (SELECT source, sum(octet_length(encode(text))) AS n FROM documents GROUP BY source)
SELECT m.source FROM mix_targets m LEFT JOIN s USING (source) WHERE max_repeats * coalesce(n, 0) < target_share * (SELECT sum(n) FROM s)""",
}
