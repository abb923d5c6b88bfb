"""Registry, conforming, files, digests, ids, time and keyed numbers."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests import world as w
from tests.conftest import rows
from tidemark.errors import ConfigError, SchemaError
from tidemark.functions import ids
from tidemark.functions.keyed import stable_key, with_keyed_uniform
from tidemark.functions.timebase import TimeBase, day_of, hour_of, is_night, is_weekend
from tidemark.sources import digest, files, schema


def test_registry_refuses():
    for columns, key in (("a i64, a i64", ["a"]), ("a i64, currency s", ["a"]), ("a f64", ["a"]), ("a i64?", ["a"]), ("a i64", ["b"])):
        with pytest.raises(SchemaError):
            schema.register("new", columns, key)
    with pytest.raises(SchemaError):
        schema.register("accounts", "a i64", ["a"])
    with pytest.raises(SchemaError):
        schema.spec("nothing")
    assert len(schema.table_names()) == 14


def test_conform(spark):
    good = spark.createDataFrame([(1, 7, "x")], "atm_id int, region bigint, extra string")
    with pytest.raises(SchemaError, match="extra"):
        schema.conform("atms", good)
    out = schema.conform("atms", good.select("region", "atm_id"))
    assert out.columns == ["atm_id", "region"] and out.dtypes == [("atm_id", "bigint"), ("region", "smallint")]
    for value, kind in ((70_000, "bigint"), (1.5, "double"), (None, "int")):
        with pytest.raises(SchemaError):
            schema.conform("atms", spark.createDataFrame([(1, value)], f"atm_id bigint, region {kind}"))


def test_files(spark, tmp_path):
    folder = str(tmp_path)
    files.write_table("accounts", w.accounts(spark), folder)
    assert files.read_table(spark, "accounts", folder).count() == 5
    assert files.read_columns(spark, "accounts", folder, ["account_id"]).columns == ["account_id"]
    with pytest.raises(SchemaError):
        files.read_columns(spark, "accounts", folder, ["nothing"])
    with pytest.raises(FileNotFoundError):
        files.read_table(spark, "atms", folder)
    path = files.export_csv(spark, "accounts", folder, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(path).count() == 5
    files.write_dataset({"accounts": w.accounts(spark)}, {"seed": 1}, folder)
    assert files.create_views(spark, folder) == ["accounts"] and spark.sql("SELECT count(*) FROM accounts").first()[0] == 5
    import pyarrow as pa

    assert files.from_arrow(spark, "atms", pa.table({"region": [1], "atm_id": [5]})).dtypes == [("atm_id", "bigint"), ("region", "smallint")]
    with pytest.raises(TypeError):
        files.from_arrow(spark, "atms", [1])
    (tmp_path / "f").write_bytes(b"abc")
    assert files.file_sha256(tmp_path / "f") == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_digests(spark):
    a = w.accounts(spark)
    shuffled = a.orderBy(F.desc("account_id")).repartition(3)
    assert digest.exact_digest("accounts", a) == digest.exact_digest("accounts", shuffled)
    assert rows(digest.multiset_digest(a)) == rows(digest.multiset_digest(shuffled.select(*reversed(a.columns))))
    changed = a.withColumn("external_role", F.coalesce("external_role", F.lit("")))  # NULL is not the same as empty
    assert digest.exact_digest("accounts", a) != digest.exact_digest("accounts", changed)
    assert rows(digest.multiset_digest(a)) != rows(digest.multiset_digest(changed))
    with pytest.raises(SchemaError):
        digest.exact_digest("accounts", a.unionByName(a))
    one = {"accounts": digest.exact_digest("accounts", a)}
    assert digest.dataset_digest(one) != digest.dataset_digest({"atms": one["accounts"]})


def test_keyed_uniform_is_splitmix(spark):
    key = stable_key("reference")

    def mix(z):
        with np.errstate(over="ignore"):
            z = z + np.uint64(0x9E3779B97F4A7C15)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return z ^ (z >> np.uint64(31))

    values = np.array([0, 1, -5, 2**62, 281474976716264], dtype=np.int64)
    z = mix(mix(values.astype(np.uint64) ^ np.uint64(key)))
    want = ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53
    got = with_keyed_uniform(spark.createDataFrame([(int(v),) for v in values], "id bigint"), key, F.col("id"))
    assert {r["id"]: r["u"] for r in got.collect()} == dict(zip(values.tolist(), want.tolist(), strict=True))
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_ids(spark):
    assert ids.pack(1, 5) == 281474976710661 and ids.network_id(1, 0) == 65536
    with pytest.raises(ConfigError):
        ids.pack(200, 0)
    with pytest.raises(ConfigError):
        ids.scenario_payload(0, 0, 0)
    row = spark.range(1).select(ids.kind_of(F.lit(ids.pack(3, 9))).alias("k"), ids.payload_of(F.lit(ids.pack(3, 9))).alias("p"), ids.event_id(4, F.lit(12), F.lit(7)).alias("e")).first()
    assert (row["k"], row["p"]) == (3, 9)
    back = spark.createDataFrame([(row["e"],)], "e bigint").select(ids.event_namespace(F.col("e")), ids.event_owner(F.col("e"))).first()
    assert tuple(back) == (4, 12)


def test_time(spark):
    base = TimeBase(datetime.date(2024, 1, 1), 60)
    assert base.sim_end == 60 * 86_400 and base.monthly_days([31]) == [30, 59]
    for bad in ((datetime.date(2024, 1, 2), 5), (datetime.date(2024, 1, 1), 0)):
        with pytest.raises(ConfigError):
            TimeBase(*bad)
    df = spark.createDataFrame([(-1,), (5 * 86_400 + 4 * 3_600,)], "ts bigint").select(day_of("ts"), hour_of("ts"), is_weekend("ts"), is_night("ts"))
    assert rows(df) == [(-1, 23, True, False), (5, 4, True, True)]


def test_forbidden_nulls_are_seen_in_the_files(spark, tmp_path):
    spark.createDataFrame([(1, 2), (2, None)], "atm_id bigint, region smallint").write.parquet(f"{tmp_path}/atms.parquet")
    with pytest.raises(SchemaError, match="region"):
        files.read_table(spark, "atms", str(tmp_path))
    with pytest.raises(SchemaError, match="region"):
        files.read_columns(spark, "atms", str(tmp_path), ["region"])
    assert files.read_columns(spark, "atms", str(tmp_path), ["atm_id"]).count() == 2
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList") and spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"
