"""Targets from ground truth, and what of it was known when a model was fitted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import ConfigError
from tidemark.functions.timebase import DAY

_TOKEN = object()
KINDS = ("active_phase", "high_risk_within")


class OracleTargets:
    """(points, y) from full truth. Only made by OracleLabels, and the only kind of target that metrics take."""

    __slots__ = ("df", "kind")

    def __init__(self, df: DataFrame, kind: str, token: object = None) -> None:
        if token is not _TOKEN:
            raise TypeError("targets from full truth come from OracleLabels only")
        self.df, self.kind = df, kind

    def n_positive(self) -> int:
        return self.df.agg(F.count_if("y")).first()[0]


class TrainingTargets:
    """(points, y) from what was known by fit_time: a negative may be an unknown positive."""

    __slots__ = ("df", "fit_time", "kind")

    def __init__(self, df: DataFrame, kind: str, fit_time: int) -> None:
        self.df, self.kind, self.fit_time = df, kind, fit_time


def overlapping(points: DataFrame, intervals: DataFrame, cond: Column, first: Column, last: Column, slice_seconds: int = 7 * DAY) -> DataFrame:
    """points with y: whether an interval of the same account meets cond. points has account_id and t.

    Points and intervals meet by account and slice of time, so the points of a busy account spread over its slices; an
    interval is given to the slices from first to last. Spark takes repeated rows for as few as those they came from, so
    neither the intervals' slices nor the points that are hit are ever broadcast.
    """
    i = intervals.withColumn("i_slice", F.explode(F.sequence(F.floor(first / slice_seconds), F.floor(last / slice_seconds)))).withColumnRenamed("account_id", "i_account")
    p = points.withColumn("p_slice", F.floor(F.col("t") / slice_seconds))
    same = (F.col("account_id") == F.col("i_account")) & (F.col("p_slice") == F.col("i_slice")) & cond
    hit = p.join(i.hint("merge"), same, "left_semi").select("account_id", "t").distinct().withColumn("y", F.lit(True))
    return points.join(hit.hint("merge"), ["account_id", "t"], "left").withColumn("y", F.coalesce("y", F.lit(False)))


class OracleLabels:
    """Ground truth: label intervals, and high-risk events (account_id, ts, known_at, is_ood_family) of source accounts."""

    def __init__(self, labels: DataFrame, high_risk: DataFrame, members: DataFrame, networks: DataFrame) -> None:
        self._intervals = labels.filter("entity_type = 'account'").select(F.col("entity_id").alias("account_id"), "valid_from", "valid_to", "known_at", "is_ood_family").filter("valid_from < valid_to")
        self._events, self._members, self._networks = high_risk, members, networks

    def ood_entities(self) -> DataFrame:
        """(entity_type, entity_id) of members of out-of-distribution networks."""
        ood = self._networks.filter("is_ood_family").select("network_id")
        return self._members.join(ood, "network_id", "left_semi").select("entity_type", "entity_id").distinct()

    def member_entities(self) -> DataFrame:
        return self._members.select("entity_type", "entity_id").distinct()

    def _compute(self, kind: str, points: DataFrame, horizon_s: int | None, known_by: int | None) -> DataFrame:
        if kind not in KINDS:
            raise ConfigError(f"unknown target {kind}")
        if kind == "high_risk_within" and (horizon_s is None or horizon_s <= 0):
            raise ConfigError("the horizon must be positive")
        source = self._intervals if kind == "active_phase" else self._events
        if known_by is not None:
            source = source.filter((F.col("known_at") <= known_by) & ~F.col("is_ood_family"))
        if kind == "active_phase":
            return overlapping(points, source.drop("known_at", "is_ood_family"), (F.col("valid_from") <= F.col("t")) & (F.col("t") < F.col("valid_to")), F.col("valid_from"), F.col("valid_to") - 1)
        events = source.select("account_id", F.col("ts").alias("e_ts"))
        return overlapping(points, events, (F.col("e_ts") > F.col("t")) & (F.col("e_ts") <= F.col("t") + horizon_s), F.col("e_ts") - horizon_s, F.col("e_ts") - 1)

    def targets(self, kind: str, points: DataFrame, horizon_s: int | None = None) -> OracleTargets:
        """active_phase: an interval with valid_from <= t < valid_to; high_risk_within: a high-risk event in (t, t + horizon]."""
        return OracleTargets(self._compute(kind, points, horizon_s, None), kind, _TOKEN)

    def training_targets(self, kind: str, points: DataFrame, fit_time: int, horizon_s: int | None = None) -> TrainingTargets:
        """The same from rows with known_at <= fit_time that are not out-of-distribution."""
        return TrainingTargets(self._compute(kind, points, horizon_s, fit_time), kind, fit_time)


def require_oracle(targets: OracleTargets) -> DataFrame:
    if not isinstance(targets, OracleTargets):
        raise TypeError("metrics are computed on targets from full truth only")
    return targets.df


def union_points(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
