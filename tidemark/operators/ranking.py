"""Row numbers and running sums over large groups without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.canon import col


def rank_in_groups(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """df with a row number from 1 within keys, by (bucket, order).

    `bucket` is a number; only the rows of one bucket are sorted together, and the buckets' sizes give each its first
    number. The caller chooses the bucket so that its rows fit a task. NULL keys are a group like any other. df is
    evaluated twice, so it should be a written table.
    """
    marked = df.withColumn("__bucket", bucket)
    numbered = marked.withColumn("__no", F.row_number().over(Window.partitionBy(*map(col, keys), "__bucket").orderBy(*order)))
    joined = _with_offsets(numbered, marked, keys, F.count(F.lit(1)))
    return joined.select(*map(col, df.columns), (F.col("__no") + F.col("__before")).cast("bigint").alias(name))


def sum_before(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with the sum of `value` over all earlier rows of the keys, in the order (bucket, order); 0 for the first.

    Only the rows of one bucket are sorted together, as in rank_in_groups. NULL values count as 0; NULL keys are a group
    like any other. df is evaluated twice, so it should be a written table.
    """
    marked = df.withColumn("__bucket", bucket)
    earlier = Window.partitionBy(*map(col, keys), "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = marked.withColumn("__own", F.coalesce(F.sum(col(value)).over(earlier), F.lit(0)))
    joined = _with_offsets(within, marked, keys, F.coalesce(F.sum(col(value)), F.lit(0)))
    return joined.select(*map(col, df.columns), (F.col("__own") + F.col("__before")).cast("bigint").alias(name))


def _with_offsets(rows: DataFrame, marked: DataFrame, keys: Sequence[str], size: Column) -> DataFrame:
    """rows with what all earlier buckets of their keys have in sum."""
    sizes = marked.groupBy(*map(col, keys), "__bucket").agg(size.alias("__size"))
    upward = Window.partitionBy(*map(col, keys)).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(col(c).alias(f"__o_{c}") for c in keys), F.col("__bucket").alias("__o_bucket"), F.coalesce(F.sum("__size").over(upward), F.lit(0)).alias("__before"))
    same = rows["__bucket"].eqNullSafe(offsets["__o_bucket"])
    for c in keys:
        same = same & rows[c].eqNullSafe(offsets[f"__o_{c}"])
    return rows.join(offsets, same)
