"""Reading and writing of registered tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import SchemaError
from tidemark.sources.schema import cast_columns, conform, spec, table_names


def _scan(spark: SparkSession, name: str, folder: str) -> DataFrame:
    spec(name)
    try:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as e:
        raise FileNotFoundError(f"{folder}/{name}.parquet: {e.getCondition()}") from e


@contextmanager
def stored_counts(spark: SparkSession, path: str) -> Iterator[DataFrame]:
    """The Parquet files at a path as a source that answers counts of its columns from the files' footers."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield spark.read.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """A registered table, conformed; a missing file raises FileNotFoundError."""
    df = _scan(spark, name, folder)
    with stored_counts(spark, f"{folder}/{name}.parquet") as stored:
        return conform(name, df, stored)


def from_arrow(spark: SparkSession, name: str, table: pa.Table) -> DataFrame:
    """An Arrow table as a conformed frame; anything else raises TypeError."""
    if not isinstance(table, pa.Table):
        raise TypeError(f"not an Arrow table: {type(table).__name__}")
    return conform(name, spark.createDataFrame(table))


def read_columns(spark: SparkSession, name: str, folder: str, columns: Sequence[str]) -> DataFrame:
    """Some columns of a registered table; only these are scanned. An unknown column raises."""
    unknown = [c for c in columns if c not in spec(name).schema.names]
    if unknown:
        raise SchemaError(f"{name} has no columns {unknown}")
    df = _scan(spark, name, folder)
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise SchemaError(f"{name}: the file has no columns {missing}")
    with stored_counts(spark, f"{folder}/{name}.parquet") as stored:
        return cast_columns(df.select(*columns), name, columns, stored)


def write_table(name: str, df: DataFrame, folder: str) -> None:
    """Conform and write as zstd Parquet, replacing what is there."""
    conform(name, df).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}.parquet")


def export_csv(spark: SparkSession, name: str, folder: str, out: str) -> str:
    """A CSV copy with header in out/<name>.csv (a folder of part files); returns its path."""
    path = f"{out}/{name}.csv"
    read_table(spark, name, folder).write.mode("overwrite").option("header", True).csv(path)
    return path


def file_sha256(path: str | Path) -> str:
    """Hex digest of a local file, read in blocks."""
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()


def write_dataset(tables: Mapping[str, DataFrame], metadata: Mapping, folder: str) -> None:
    """All tables and metadata.json."""
    for name in sorted(tables):
        write_table(name, tables[name], folder)
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "metadata.json").write_text(json.dumps(metadata, sort_keys=True, indent=1), encoding="utf-8")


def create_views(spark: SparkSession, folder: str) -> list[str]:
    """A temporary view for each registered table that is in the folder."""
    made = []
    for name in table_names():
        try:
            _scan(spark, name, folder).createOrReplaceTempView(name)
            made.append(name)
        except FileNotFoundError:
            continue
    return made
