"""Ranking metrics, simple probe models, and the rule that combines their results."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.canon import col
from tidemark.functions.keyed import stable_key, with_keyed_uniform
from tidemark.operators.truth import OracleTargets, require_oracle
from tidemark.session import Scratch


def score_bucket(score: Column, per_doubling: int = 1 << 16) -> Column:
    """A bucket number that never falls as the score rises, as fine near 0 as far from it: the exponent and the first 16
    bits of what follows, so that scores that are all small are told apart like any others. NULL for NULL and NaN."""
    size = F.abs(score)
    # The least double is above 2^-1075, so numbers of sizes are positive and those of opposite sign mirror each other.
    number = F.floor((F.log2(size) + 1_076.0) * per_doubling) + 1
    number = F.when(size == 0, 0).when(size == float("inf"), 2_200 * per_doubling).otherwise(number)
    return F.when(~F.isnan(score), F.signum(score) * number).cast("bigint")


def average_precision_by(df: DataFrame, groups: Sequence[str], y: str = "y", score: str = "score", per_doubling: int = 1 << 16) -> DataFrame:
    """(groups, positives, ap): Σ (R_n - R_{n-1}) P_n over the distinct scores from the highest down; groups without a positive have NULL.

    Equal scores are one threshold. Rows become one per distinct score first; running counts over scores are taken per
    bucket of scores and over the buckets' totals, so no group is sorted in one task, only one row for each of its
    buckets (score_bucket), of which there are some millions at most.
    """
    g = list(groups)
    rows = df.select(*map(col, g), col(y).cast("boolean").alias("y"), (col(score).cast("double") + 0.0).alias("score"))
    by_score = rows.groupBy(*map(col, g), "score").agg(F.count(F.lit(1)).alias("n"), F.count_if("y").alias("pos")).withColumn("bucket", score_bucket(F.col("score"), per_doubling))
    sums = by_score.groupBy(*map(col, g), "bucket").agg(F.sum("n").alias("bn"), F.sum("pos").alias("bpos"))
    down = Window.partitionBy(*map(col, g)).orderBy(F.desc("bucket")) if g else Window.orderBy(F.desc("bucket"))
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*map(col, g)) if g else Window.partitionBy()
    carried = sums.select(*(col(c).alias(f"__{c}") for c in g), F.col("bucket").alias("__bucket"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("n0"), F.coalesce(F.sum("bpos").over(above), F.lit(0)).alias("pos0"), F.sum("bpos").over(whole).alias("positives"))
    same = by_score["bucket"] == carried["__bucket"]
    for c in g:
        same = same & by_score[c].eqNullSafe(carried[f"__{c}"])
    within = Window.partitionBy(*map(col, g), "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = by_score.join(carried, same).select(*map(col, g), "pos", "positives", (F.col("n0") + F.sum("n").over(within)).alias("seen"), (F.col("pos0") + F.sum("pos").over(within)).alias("hits"))
    part = F.when(F.col("positives") > 0, F.col("pos") / F.col("positives") * (F.col("hits") / F.col("seen")))
    return ranked.groupBy(*map(col, g)).agg(F.max("positives").alias("positives"), F.sum(part).alias("ap"))


def _scored(targets: OracleTargets, scores: DataFrame) -> DataFrame:
    """Targets from full truth with their scores (account_id, t, score).

    Scores are as many as the points, which Spark takes for as few as the accounts that were repeated for each day, so
    they are never broadcast.
    """
    return require_oracle(targets).join(scores.hint("merge"), ["account_id", "t"])


def average_precision(targets: OracleTargets, scores: DataFrame) -> float:
    """AP of scores (account_id, t, score) on targets from full truth; raises without positives or with a score that is not finite."""
    rows = _scored(targets, scores)
    bad = rows.agg(F.count_if(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))).first()[0]
    if bad:
        raise ValueError(f"{bad} scores are not finite")
    found = average_precision_by(rows, []).first()
    if found is None or not found["positives"]:
        raise ValueError("no positives")
    return found["ap"]


def top_k(df: DataFrame, k: int, score: str, row_id: Sequence[str]) -> DataFrame:
    """The k rows with the highest score, ties by row_id. Each task sends at most k rows."""
    return df.orderBy(F.desc(col(score)), *map(col, row_id)).limit(k)


def recall_at_k(targets: OracleTargets, scores: DataFrame, k: int) -> float:
    """Share of the positives among the k highest scores; NaN without positives. The join is made once and written."""
    rows = _scored(targets, scores).select("account_id", "t", "y", "score")
    with Scratch(rows.sparkSession, "recall") as scratch:
        rows = scratch.table(rows, "scored")
        whole = rows.agg(F.count_if("y")).first()[0]
        return top_k(rows, k, "score", ["account_id", "t"]).agg(F.count_if("y")).first()[0] / whole if whole else math.nan


def single_feature_ap(df: DataFrame, features: Sequence[str], y: str = "y") -> DataFrame:
    """(feature, ap, direction): each feature alone as a score, in the better of both directions. One scan, one grouped AP."""
    cells = F.array(*(F.struct(F.lit(f).alias("feature"), F.lit(d).alias("direction"), (col(f).cast("double") * d).alias("score")) for f in features for d in (1, -1)))
    both = average_precision_by(df.select(col(y).alias("y"), F.explode(cells).alias("c")).select("y", "c.*"), ["feature", "direction"])
    return both.groupBy("feature").agg(F.max("ap").alias("ap"), F.max_by("direction", F.struct("ap", "direction")).alias("direction"))


def fit_scaling(train: DataFrame, features: Sequence[str]) -> dict[str, tuple[bool, float, float]]:
    """Per feature (log1p, mean, sd): log1p where the training values are never negative, population sd, a zero sd as 1."""
    row = train.agg(*(F.min(col(f)).alias(f) for f in features)).first().asDict()
    logs = {f: row[f] is not None and row[f] >= 0 for f in features}
    x = {f: F.log1p(col(f).cast("double")) if logs[f] else col(f).cast("double") for f in features}
    stats = train.agg(*(a for f in features for a in (F.avg(x[f]).alias(f"m_{f}"), F.stddev_pop(x[f]).alias(f"s_{f}")))).first()
    return {f: (logs[f], stats[f"m_{f}"] or 0.0, stats[f"s_{f}"] or 1.0) for f in features}


def scaled(df: DataFrame, scaling: Mapping[str, tuple[bool, float, float]]) -> DataFrame:
    return df.withColumns({f: ((F.log1p(col(f).cast("double")) if log else col(f).cast("double")) - mean) / sd for f, (log, mean, sd) in scaling.items()})


def _weighted(df: DataFrame, features: Sequence[str], y: str) -> tuple[DataFrame, float]:
    """df with a features vector and balanced class weights, and the sum of the weights."""
    from pyspark.ml.feature import VectorAssembler

    n, pos = df.agg(F.count(F.lit(1)), F.count_if(col(y))).first()
    if not 0 < pos < n:
        raise ConfigError("both classes are needed")
    weight = F.when(col(y), F.lit(n / (2 * pos))).otherwise(F.lit(n / (2 * (n - pos))))
    vector = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return vector.transform(df.withColumns({"weight": weight, "label": col(y).cast("double")})), float(n)


def logistic_probe(train: DataFrame, features: Sequence[str], y: str = "y"):
    """L2 logistic regression with C = 1 and balanced classes; features should be scaled."""
    from pyspark.ml.classification import LogisticRegression

    rows, weights = _weighted(train, features, y)
    return LogisticRegression(weightCol="weight", regParam=1 / weights, elasticNetParam=0.0, standardization=False, maxIter=1_000).fit(rows)


def tree_probe(train: DataFrame, features: Sequence[str], y: str = "y", seed: int = 0):
    """Decision tree of depth 3 with at least 50 rows in a leaf and balanced classes."""
    from pyspark.ml.classification import DecisionTreeClassifier

    rows, _ = _weighted(train, features, y)
    return DecisionTreeClassifier(weightCol="weight", maxDepth=3, minInstancesPerNode=50, seed=seed).fit(rows)


def probe_scores(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """df with `score`, the model's probability of the positive class."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def exact_sample(df: DataFrame, n: int, key: str, row_id: str) -> DataFrame:
    """n rows uniformly without replacement: those with the least keyed uniform, the same on every run."""
    return with_keyed_uniform(df, stable_key(key), F.xxhash64(col(row_id)), "__u").orderBy("__u", col(row_id)).limit(n).drop("__u")


def _weighted_ap(order: np.ndarray, ends: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    hits, seen = np.cumsum((y * w)[order])[ends], np.cumsum(w[order])[ends]
    if not len(hits) or hits[-1] == 0:
        return math.nan
    return float((np.diff(hits, prepend=0.0) / hits[-1] * np.divide(hits, seen, out=np.zeros_like(hits), where=seen > 0)).sum())


def cluster_bootstrap(df: DataFrame, cluster: str, y: str, score_a: str, score_b: str, resamples: int = 1_000, seed: int = 0, max_rows: int = 200_000) -> dict[str, float]:
    """Difference of two scores' AP (b - a) with a percentile interval; positive and negative clusters are resampled separately.

    The rows, at most max_rows (more raise; draw an exact_sample first), go to all tasks, and each task does some of the resamples.
    """
    rows = df.select(col(cluster).cast("string").alias("c"), col(y).cast("boolean").alias("y"), col(score_a).cast("double").alias("a"), col(score_b).cast("double").alias("b")).limit(max_rows + 1).toPandas()
    if len(rows) > max_rows:
        raise ConfigError(f"more than {max_rows} rows")
    positive = rows.groupby("c")["y"].transform("max").to_numpy(dtype=bool)
    codes = rows["c"].astype("category").cat.codes.to_numpy()
    target = rows["y"].to_numpy(dtype=float)
    pools = [np.unique(codes[positive]), np.unique(codes[~positive])]
    plans = []
    for s in ("a", "b"):
        values = rows[s].to_numpy()
        order = np.argsort(-values, kind="stable")
        ends = np.flatnonzero(np.append(np.diff(values[order]) != 0, True)) if len(values) else np.zeros(0, dtype=int)
        plans.append((order, ends))
    spark, n_codes = df.sparkSession, int(codes.max()) + 1 if len(codes) else 0
    shared = spark.sparkContext.broadcast((codes, target, pools, plans))  # at most max_rows rows

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, target, pools, plans = shared.value
        for b in batches:
            out = []
            for r in b["id"].to_pylist():
                rng, times = np.random.default_rng([seed, r]), np.zeros(n_codes)
                for pool in pools:
                    if len(pool):
                        times += np.bincount(rng.choice(pool, len(pool)), minlength=n_codes)
                one, two = (_weighted_ap(order, ends, target, times[codes]) for order, ends in plans)
                out.append(two - one)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["delta"])

    deltas = spark.range(resamples, numPartitions=min(resamples, spark.sparkContext.defaultParallelism)).mapInArrow(run, "delta double").filter(~F.isnan("delta"))
    low, high = deltas.agg(F.percentile("delta", F.array(F.lit(0.025), F.lit(0.975)))).first()[0] or (math.nan, math.nan)
    ones = np.ones(len(target))
    point = [_weighted_ap(order, ends, target, ones) for order, ends in plans]
    return {"delta": point[1] - point[0], "low": low, "high": high}


# Thresholds of the rule.
G1_MOST, G2A_MOST, G2B_TIMES = 0.30, 0.60, 3.0


def gate_rule(results: Sequence[Mapping[str, float]]) -> dict[str, bool]:
    """results has per seed best_ap, ap_lr, ap_tree and prevalence. A criterion holds if it does for the mean and for all seeds but at most one."""
    if not results:
        raise ConfigError("no results")

    def holds(test) -> bool:
        mean = {k: float(np.mean([r[k] for r in results])) for k in results[0]}
        return test(mean) and sum(map(test, results)) >= len(results) - 1

    rule = {
        "no feature alone": holds(lambda r: r["best_ap"] <= G1_MOST),
        "not too easy": holds(lambda r: max(r["ap_lr"], r["ap_tree"]) <= G2A_MOST),
        "better than chance": holds(lambda r: max(r["ap_lr"], r["ap_tree"]) >= G2B_TIMES * r["prevalence"]),
    }
    return rule | {"passed": all(rule.values())}
