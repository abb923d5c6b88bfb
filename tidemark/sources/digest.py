"""Content digests: an exact one over sorted contents, and one that needs no order."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from tidemark.errors import SchemaError
from tidemark.functions.canon import col
from tidemark.sources.schema import conform, duplicate_keys, spec

_WIDTH = {"tinyint": "<b", "smallint": "<h", "int": "<i", "bigint": "<q"}


def value_bytes(value, kind: str) -> bytes:
    """A value as hashed: integers little-endian, booleans one byte, strings their length (8 bytes) and UTF-8; NULL as zero or empty."""
    if kind == "string":
        raw = (value or "").encode("utf-8")
        return struct.pack("<Q", len(raw)) + raw
    if kind == "boolean":
        return b"\1" if value else b"\0"
    return struct.pack(_WIDTH[kind], value or 0)


def exact_digest(name: str, df: DataFrame) -> str:
    """SHA-256 of the conformed table in the order of its primary key; NULL and empty text differ.

    Rows stream through the driver one partition at a time, so this is for validation of data that one machine can
    read; multiset_digest is the one for large tables. A repeated primary key raises.
    """
    t = conform(name, df)
    if not duplicate_keys(name, t).isEmpty():
        raise SchemaError(f"{name}: repeated primary key {spec(name).primary_key}")
    kinds = [f.dataType.simpleString() for f in t.schema]
    digest = hashlib.sha256(f"tidemark-table-1/{name}\0".encode())
    digest.update("".join(f"{f.name}:{k}:{int(f.nullable)};" for f, k in zip(spec(name).schema, kinds, strict=True)).encode())
    n = 0
    for row in t.orderBy(*spec(name).primary_key).toLocalIterator(prefetchPartitions=True):
        for value, kind in zip(row, kinds, strict=True):
            digest.update(b"\0" if value is None else b"\1")
            digest.update(value_bytes(value, kind))
        n += 1
    digest.update(struct.pack("<Q", n))
    return digest.hexdigest()


def dataset_digest(digests: Mapping[str, str]) -> str:
    """SHA-256 over the tables' digests in the order of their names."""
    digest = hashlib.sha256(b"tidemark-dataset-1\0")
    for name in sorted(digests):
        digest.update(name.encode() + b"\0" + bytes.fromhex(digests[name]))
    return digest.hexdigest()


def multiset_digest(df: DataFrame) -> DataFrame:
    """(n, sum_a, sum_b, xor_a): one row that is equal for equal multisets of rows, in whatever order and partitioning.

    One pass with map-side aggregation; no sort and no shuffle of rows. Columns are taken in the order of their names.
    """
    fields = sorted(df.schema.fields, key=lambda f: f.name)
    parts = []
    for f in fields:
        # NULL is skipped by the hash functions, so it is marked.
        parts += [col(f.name).isNull(), col(f.name) if isinstance(f.dataType, (StringType, BooleanType)) or f.dataType.typeName() in ("long", "integer", "short", "byte") else col(f.name).cast("string")]
    a, b = F.xxhash64(*parts), F.xxhash64(F.lit("b"), *parts)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(a.cast("decimal(20,0)")).alias("sum_a"), F.sum(b.cast("decimal(20,0)")).alias("sum_b"), F.bit_xor(a).alias("xor_a"))
