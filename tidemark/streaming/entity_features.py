"""Per-entity feature rows kept up to date by a stateful stream."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.functions.canon import col
from tidemark.operators.copies import content_tag

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


@contextmanager
def _state_store(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _STORE}
    try:
        for k, v in _STORE.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_path(spark: SparkSession, path: str) -> str:
    """The path for a file stream: folders as they are, a single file as a pattern, as a stream takes no file path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    return f"{path[:-1]}[{path[-1]}]" if status.isFile() else path


MERGED = 8  # folders of one level that are merged into one of the next


def feature_columns(n_types: int) -> list[str]:
    """count_i, total_i, last_i for each type number i; the last number is for all other types."""
    return [f"{what}_{i}" for i in range(n_types + 1) for what in ("count", "total", "last")]


def batch_bytes(spark: SparkSession, source: str, batches: int = 4, least: int = 16 << 20, most: int = 1 << 30) -> int:
    """A batch size for a first call over `source`: a share of its bytes between `least` and `most`."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    size = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
    return max(least, min(most, -(-size // batches)))


def update_entity_features(
    spark: SparkSession,
    source: str,
    schema: StructType,
    table: str,
    checkpoint: str,
    *,
    entity: str,
    kind,
    n_types: int,
    ts: str,
    amount: str,
    key: str,
    max_bytes_per_batch: int = 1 << 30,
) -> None:
    """Bring the feature table up to date with all files in `source` that no earlier call has seen.

    `kind` is a column expression that gives a row's type number, 0 … n_types-1; all others count in one more type,
    n_types, so that the counts of an entity add up to its events. The stream drops rows whose key was seen before
    (state: all keys), keeps the counter, total and latest time of each entity and type (state: one row for each), and
    after each micro-batch upserts the cells that changed: those of batch b are in `table`/batch=b, and of an
    entity and type the row with the greatest batch holds (read_entity_cells, read_entity_features). When MERGED
    folders of a level are there, they are merged into one of the next level, so a read meets about
    MERGED * log(batches) folders, and a cell is written again once for each level. A batch that is run again
    overwrites its own folder, and a folder may be read beside the one that it was merged into, as cells are whole
    values and not increments: failures leave no double counts. State is in RocksDB with its changelog in `checkpoint`;
    both paths must be shared by all executors.

    Scale: rows of a batch are counted map-side before they are sent by entity and type, so a hot entity is a row per
    type and task, and the number of types changes no plan. `max_bytes_per_batch` bounds a batch.

    Defined cases: rows with NULL entity are left out; a NULL amount counts as 0; rows with NULL key are copies only if
    equal in all that is used here; a NULL ts counts, but is never the latest.
    """
    e = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(max_bytes_per_batch)).parquet(stream_path(spark, source))
    e = e.select(col(key).alias("key"), col(entity).alias("entity"), kind.cast("int").alias("kind"), col(ts).cast("bigint").alias("ts"), F.coalesce(col(amount), F.lit(0)).cast("bigint").alias("amount"))
    e = e.filter("entity IS NOT NULL").withColumn("kind", F.when(F.col("kind").between(0, n_types - 1), F.col("kind")).otherwise(n_types))
    e = e.withColumn("tag", content_tag(["key"], ["entity", "kind", "ts", "amount"])).dropDuplicates(["key", "tag"])
    cells = e.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"), F.max("ts").alias("last_ts"))

    def upsert(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        _merge(batch.sparkSession, table)

    with _state_store(spark):
        query = cells.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(upsert).start()
        query.awaitTermination()


def _folders(spark: SparkSession, table: str) -> list[tuple[int, int, str]]:
    """(level, last batch, path) of the folders that are complete."""
    found = []
    for pattern in (f"{table}/batch=*/_SUCCESS", f"{table}/level=*/batch=*/_SUCCESS"):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
        for status in target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target) or []:
            path = str(status.getPath().getParent().toString())
            level = int(path.rpartition("/level=")[2].partition("/")[0]) if "/level=" in path else 0
            found.append((level, int(path.rpartition("=")[2]), path))
    return sorted(found)


def _read(spark: SparkSession, paths: Sequence[tuple[int, int, str]]) -> DataFrame:
    """The latest cell of each entity and type. A merged folder keeps each cell's own batch in `of_batch`."""
    rows = None
    for level, number, path in paths:
        one = spark.read.parquet(path)
        one = one if level else one.withColumn("of_batch", F.lit(number).cast("bigint"))
        rows = one if rows is None else rows.unionByName(one)
    latest = F.max_by(F.struct("n", "total", "last_ts", "of_batch"), "of_batch")
    return rows.groupBy("entity", "kind").agg(latest.alias("v")).select("entity", "kind", "v.*")


def _merge(spark: SparkSession, table: str) -> None:
    """Merge full levels from the lowest up, and delete what was merged."""
    level = 0
    while True:
        mine = [f for f in _folders(spark, table) if f[0] == level]
        if len(mine) < MERGED:
            return
        _read(spark, mine).write.mode("overwrite").parquet(f"{table}/level={level + 1}/batch={mine[-1][1]}")
        jvm = spark.sparkContext._jvm
        for _, _, path in mine:
            gone = jvm.org.apache.hadoop.fs.Path(path)
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)
        level += 1


def read_entity_cells(spark: SparkSession, table: str) -> DataFrame:
    """(entity, kind, n, total, last_ts): the latest cell of each entity and type number; empty before the first batch."""
    folders = _folders(spark, table)
    if not folders:
        return spark.createDataFrame([], "entity bigint, kind int, n bigint, total bigint, last_ts bigint")
    return _read(spark, folders).drop("of_batch")


def read_entity_features(spark: SparkSession, table: str, n_types: int) -> DataFrame:
    """(entity, count_i, total_i, last_i …): one row per entity, for hundreds of types as well.

    An entity's cells, at most n_types + 1, are gathered as a map and read out of it, so that no aggregate has a column
    for each type.
    """
    cells = read_entity_cells(spark, table)
    rows = cells.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("kind", F.struct("n", "total", "last_ts").alias("v")))).alias("cells"))
    out = []
    for i in range(n_types + 1):
        cell = F.try_element_at("cells", F.lit(i))
        out += [F.coalesce(cell["n"], F.lit(0)).alias(f"count_{i}"), F.coalesce(cell["total"], F.lit(0)).alias(f"total_{i}"), cell["last_ts"].alias(f"last_{i}")]
    return rows.select("entity", *out)


def by_type(cells: DataFrame, types: Sequence[str], end_ts: int) -> DataFrame:
    """(entity, kind, n, total, last_ts, since_last): read_entity_cells of the named types, with their names."""
    named = cells.filter(F.col("kind") < len(types)).withColumn("kind", F.element_at(F.array(*map(F.lit, types)), F.col("kind") + 1))
    return named.withColumn("since_last", F.lit(end_ts) - F.col("last_ts")).select("entity", "kind", "n", "total", "last_ts", "since_last")
