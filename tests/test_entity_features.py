"""The feature stream: batches, restarts, copies across batches."""

import random

from pyspark.sql import functions as F

from tests.conftest import rows
from tidemark.functions.canon import TXN_TYPES, code_of
from tidemark.streaming.entity_features import by_type, read_entity_cells, read_entity_features, update_entity_features

SHAPE = "event_id bigint, src bigint, txn_type string, ts bigint, amount bigint, batch string"


def run(spark, tmp_path, **more):
    source = str(tmp_path / "in")
    update_entity_features(spark, source, spark.read.parquet(source).schema, f"file://{tmp_path}/table", f"file://{tmp_path}/state", entity="src", kind=code_of(F.col("txn_type"), TXN_TYPES, upper=True), n_types=5, ts="ts", amount="amount", key="event_id", **more)
    return by_type(read_entity_cells(spark, f"file://{tmp_path}/table"), TXN_TYPES, 100)


def test_batches_add_up(spark, tmp_path):
    first = [(1, 7, "TRANSFER", 10, 5, "x"), (2, 7, " transfer ", 30, 6, "x"), (3, 7, "Card-Payment", 20, None, "x"), (4, None, "TRANSFER", 1, 1, "x"), (5, 8, "other", 1, 1, "x"), (6, 9, "TRANSFER", None, 2, "x")]
    spark.createDataFrame(first, SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert rows(run(spark, tmp_path), "entity", "kind", "n", "total", "since_last") == [(7, "CARD_PAYMENT", 1, 0, 80), (7, "TRANSFER", 2, 11, 70), (9, "TRANSFER", 1, 2, None)]
    # A later call sees new files only; copies of seen events change nothing.
    later = [(1, 7, "TRANSFER", 10, 5, "x"), (7, 7, "TRANSFER", 5, 1, "x"), (8, 10, "ATM WITHDRAWAL", 90, 3, "x"), (None, 10, "TRANSFER", 1, 1, "x"), (None, 10, "TRANSFER", 1, 1, "x")]
    spark.createDataFrame(later, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = rows(run(spark, tmp_path), "entity", "kind", "n", "total", "since_last")
    assert found == [(7, "CARD_PAYMENT", 1, 0, 80), (7, "TRANSFER", 3, 12, 70), (9, "TRANSFER", 1, 2, None), (10, "ATM_WITHDRAWAL", 1, 3, 10), (10, "TRANSFER", 1, 1, 99)]


def test_small_batches_give_the_same(spark, tmp_path):
    data = [(i, i % 3, TXN_TYPES[i % 5], i, i, "x") for i in range(40)]
    for part in range(4):
        spark.createDataFrame(data[part * 10 : part * 10 + 12], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = {(r["entity"], r["kind"]): (r["n"], r["total"]) for r in run(spark, tmp_path, max_bytes_per_batch=1).collect()}
    assert sum(n for n, _ in found.values()) == 40 and sum(t for _, t in found.values()) == sum(range(40))
    assert len({p.name for p in (tmp_path / "table").iterdir() if p.name.startswith("batch=")}) == 4


def test_no_rows_and_no_files(spark, tmp_path):
    spark.createDataFrame([], SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    assert run(spark, tmp_path).count() == 0
    assert read_entity_features(spark, f"file://{tmp_path}/nothing", 5).count() == 0


def test_hundreds_of_types_many_batches_and_restarts(spark, tmp_path):
    """300 types in ten batches over two calls: merged folders, counts that add up with those of other types."""
    types, rng = 300, random.Random(1)
    data = [(i, rng.choice([7, 7, 7, rng.randrange(5)]), str(rng.randrange(320)), rng.randrange(1000), rng.randrange(50), "x") for i in range(2_000)]
    source, table = str(tmp_path / "in"), f"file://{tmp_path}/table"
    for half in (data[:1_000], data[1_000:]):
        for part in range(5):
            spark.createDataFrame(half[part * 200 : part * 200 + 220], SHAPE).coalesce(1).write.mode("append").parquet(source)
        update_entity_features(spark, source, spark.read.parquet(source).schema, table, f"file://{tmp_path}/state", entity="src", kind=F.col("txn_type").cast("int"), n_types=types, ts="ts", amount="amount", key="event_id", max_bytes_per_batch=1)
    want = {}
    for _, entity, kind, ts, amount, _ in data:
        n, total, last = want.get((entity, min(int(kind), types)), (0, 0, -1))
        want[entity, min(int(kind), types)] = (n + 1, total + amount, max(last, ts))
    assert {(r["entity"], r["kind"]): (r["n"], r["total"], r["last_ts"]) for r in read_entity_cells(spark, table).collect()} == want
    names = {p.relative_to(tmp_path / "table").parts[0] for p in (tmp_path / "table").rglob("_SUCCESS")}
    assert names == {"level=1", "batch=8", "batch=9"}
    wide = {r["entity"]: r for r in read_entity_features(spark, table, types).collect()}
    for entity, row in wide.items():
        mine = {k: v for (e, k), v in want.items() if e == entity}
        assert [(row[f"count_{k}"], row[f"total_{k}"], row[f"last_{k}"]) for k in range(types + 1)] == [mine.get(k, (0, 0, None)) for k in range(types + 1)]
