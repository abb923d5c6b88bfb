"""One row per key where rows are delivered more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.canon import col


def content_tag(keys: Sequence[str], keep: Sequence[str]) -> Column:
    """NULL where all keys are set, else a hash of the row: rows without a key are copies only if all of keep agrees."""
    unset = F.lit(False)
    for k in keys:
        unset = unset | col(k).isNull()
    return F.when(unset, F.xxhash64(*map(col, [*keys, *keep])))


def one_per_key(df: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns keys and keep, one row per key.

    Map-side aggregation collapses copies before the shuffle, so a key with a third of all rows stays harmless. Where
    copies differ, each kept column takes its least non-NULL value. Rows with a NULL in the key are told apart by
    their contents. An empty table gives an empty result.
    """
    tagged = df.select(*map(col, keys), *map(col, keep), content_tag(keys, keep).alias("__tag"))
    return tagged.groupBy(*map(col, keys), F.col("__tag")).agg(*(F.min(col(c)).alias(c) for c in keep)).drop("__tag")
