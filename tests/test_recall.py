"""Recall over points that are accounts repeated for each day, and what of them is sent to the driver."""

from pyspark.sql import functions as F

from tidemark.functions.timebase import DAY
from tidemark.operators import metrics, splits
from tidemark.operators.truth import OracleLabels


def planned(spark, action):
    """The plans of what ran in `action`."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    action()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = store.executionsList(before, 1_000)
    return [new.apply(i).physicalPlanDescription() for i in range(new.size())]


def test_points_are_not_broadcast_by_the_account(spark, scratch):
    """A small file of accounts, each of which has ninety points: Spark takes the points for as small as the file."""
    accounts = scratch.table(spark.range(200).select(F.col("id").alias("account_id"), F.lit("internal").alias("account_kind"), (F.col("id") % 40 * DAY).alias("opened_at")), "accounts")
    labels = scratch.table(spark.createDataFrame([("account", i, d * DAY, (d + 20) * DAY, d * DAY, False) for i in range(0, 200, 7) for d in (5, 30, 60)], "entity_type string, entity_id bigint, valid_from bigint, valid_to bigint, known_at bigint, is_ood_family boolean"), "labels")
    points = splits.points(accounts, range(1, 91))
    y = OracleLabels(labels, None, None, None).targets("active_phase", points)
    scores = points.select("account_id", "t", (F.col("day") * 7 % 31 + F.col("account_id") % 5).cast("double").alias("score"))
    found = []
    plans = planned(spark, lambda: found.append(metrics.recall_at_k(y, scores, 500)))
    assert plans and not any("BroadcastExchange" in p for p in plans)
    all_points = [(-(d * 7 % 31 + i % 5), i, d * DAY - 1) for i in range(200) for d in range(1, 91) if i % 40 * DAY <= d * DAY - 1]
    positive = [i % 7 == 0 and any(v * DAY <= t < (v + 20) * DAY for v in (5, 30, 60)) for _, i, t in sorted(all_points)]
    assert found == [sum(positive[:500]) / sum(positive)] and found[0] > 0
