"""Uniform numbers that are a pure function of a key and an id: the same in every task and on every retry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The increment and multipliers of splitmix64.
GAMMA, MULTIPLY_1, MULTIPLY_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _long(x: int) -> Column:
    return F.lit(_signed(x & (1 << 64) - 1)).cast("bigint")


def stable_key(name: str) -> int:
    """64-bit key of a name: blake2b with 8 bytes, big-endian."""
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8"), digest_size=8).digest(), "big")


def splitmix64(x: Column) -> Column:
    """The mixed value as a signed bigint. Arithmetic must wrap, so it has to be analysed under wrapping()."""
    z = x + _long(GAMMA)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 30)) * _long(MULTIPLY_1)
    z = z.bitwiseXOR(F.shiftrightunsigned(z, 27)) * _long(MULTIPLY_2)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def unit_uniform(x: Column) -> Column:
    """The upper 53 bits as a double inside (0, 1)."""
    return (F.shiftrightunsigned(x, 11).cast("double") + 0.5) / float(1 << 53)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Integer arithmetic of data frames made inside wraps instead of raising; they keep that after."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_keyed_uniform(df: DataFrame, key: int | Column, ids: Column, name: str = "u") -> DataFrame:
    """df with a uniform number in (0, 1) for each id under a 64-bit key, which may be a column."""
    k = _long(key) if isinstance(key, int) else key
    with wrapping(df.sparkSession):
        return df.withColumn(name, unit_uniform(splitmix64(splitmix64(ids.cast("bigint").bitwiseXOR(k)))))


def hashed_uniform(name: str, *ids: Column) -> Column:
    """A uniform number in (0, 1) from a name and any number of ids, by xxHash64: one small expression, also for many ids."""
    return unit_uniform(F.xxhash64(_long(stable_key(name)), *(i.cast("bigint") for i in ids)))


def with_keyed_uniforms(df: DataFrame, keys: Sequence[int], ids: Column, name: str = "u") -> DataFrame:
    """df with an array of the uniform numbers that with_keyed_uniform gives for each key. Each step runs over the array,
    so that the expression has as many parts for a thousand keys as for one."""

    def mixed(z: Column) -> Column:
        z = F.transform(z, lambda x: x + _long(GAMMA))
        for shift, factor in ((30, MULTIPLY_1), (27, MULTIPLY_2)):
            z = _step(z, shift, factor)
        return F.transform(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, 31)))

    with wrapping(df.sparkSession):
        start = F.transform(F.array(*map(_long, keys)), lambda k: k.bitwiseXOR(ids.cast("bigint")))
        return df.withColumn(name, F.transform(mixed(mixed(start)), unit_uniform))


def _step(z: Column, shift: int, factor: int) -> Column:
    return F.transform(z, lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, shift)) * _long(factor))
