"""A key with a third of all rows must not fill a task: the rows that the largest task reads, with partitions as they are."""

import random

from pyspark.sql import functions as F

from tests.conftest import most_rows_of_a_task, rows
from tidemark.operators import metrics, splits
from tidemark.operators.ranking import rank_in_groups, sum_before
from tidemark.operators.sides import along, sides

N = 24_000


def written(spark, scratch, data, shape):
    spark.createDataFrame(data, shape).repartition(4).write.mode("overwrite").parquet(scratch.path("hot"))
    return spark.read.parquet(scratch.path("hot"))


def test_ranks_and_sums(spark, scratch):
    df = written(spark, scratch, [(1 if i % 3 == 0 else i, i, i % 7) for i in range(N)], "k bigint, id bigint, v bigint")
    order, out = F.xxhash64("id"), []
    bucket = F.shiftrightunsigned(order, 52)
    assert most_rows_of_a_task(spark, lambda: out.extend(rank_in_groups(df, ["k"], bucket, [order, F.col("id")]).filter("k = 1").collect())) < N / 3
    assert sorted(r["rank"] for r in out) == list(range(1, N // 3 + 2))
    sums = []
    assert most_rows_of_a_task(spark, lambda: sums.extend(sum_before(df, ["k"], bucket, [order, F.col("id")], "v", "before").filter("k = 1").collect())) < N / 3
    ranked = sorted(out, key=lambda r: r["rank"])
    total, want = 0, {}
    for r in ranked:
        want[r["id"]] = total
        total += r["v"]
    assert {r["id"]: r["before"] for r in sums} == want


def test_running_values_of_an_account(spark, scratch):
    """One account on one side of a third of all transactions of a day."""
    rng = random.Random(1)
    data = [(i, rng.randrange(86_400), "SETTLED", 5, i % 40 + 100, 999 if i % 3 == 0 else i % 40 + 200, 0, 0, 0, 0) for i in range(N)]
    df = written(spark, scratch, data, "event_id bigint, ts bigint, status string, amount_minor bigint, src_account_id bigint, dst_account_id bigint, src_balance_before_minor bigint, src_balance_after_minor bigint, dst_balance_before_minor bigint, dst_balance_after_minor bigint")
    out = []

    def run():
        out.extend(along(sides(df), sums={"total": "delta"}, lasts={"last_id": F.col("event_id")}).filter("account_id = 999").collect())

    assert most_rows_of_a_task(spark, run, 16) < N / 3
    ordered = sorted(out, key=lambda r: (r["ts"], r["event_id"]))
    assert [r["total"] for r in ordered] == [5 * (i + 1) for i in range(N // 3)]
    assert [r["last_id"] for r in ordered] == [None, *(r["event_id"] for r in ordered[:-1])]


def test_average_precision_of_scores_that_are_all_small(spark, scratch):
    """Probabilities near 0, all of one group, each another."""
    rng = random.Random(2)
    data = [("a", rng.random() < 0.01, 1e-4 * rng.random() ** 3) for _ in range(N)]
    df = written(spark, scratch, data, "g string, y boolean, score double")
    out = []
    assert most_rows_of_a_task(spark, lambda: out.extend(metrics.average_precision_by(df, ["g"], per_doubling=64).collect())) < N / 2
    hits, ap, whole = 0, 0.0, sum(y for _, y, _ in data)
    for seen, (_, y, _) in enumerate(sorted(data, key=lambda r: -r[2]), 1):
        hits += y
        ap += y * hits / seen / whole
    assert abs(out[0]["ap"] - ap) < 1e-12


def test_buckets_of_scores_keep_their_order(spark):
    scores = sorted([0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 1e-300, 1e-5, 1.0000001e-5, 0.1, 0.9999, 0.99999, 1e308, float("inf"), float("-inf"), -1e-9, -3.0])
    found = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").orderBy("i").select(metrics.score_bucket(F.col("s"))).collect()]
    assert found == sorted(found) and len(set(found)) == len(scores) - 2  # 0 and -0, and two that agree in 23 bits


def test_stratified_pool_with_one_archetype(spark, scratch):
    df = written(spark, scratch, [(i, "a") for i in range(N)], "account_id bigint, archetype string")
    out = []
    assert most_rows_of_a_task(spark, lambda: out.extend(splits.reference_pool(df, df, 0.1, "k", "stratified_archetype").collect())) < N / 2
    assert len(out) == N // 10
    assert len(rows(splits.reference_pool(df.limit(0), df.limit(0), 0.1, "k", "stratified_archetype"))) == 0
