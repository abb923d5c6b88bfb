"""Daily totals as a stream, against the batch result."""

from tests.conftest import rows
from tidemark.streaming.daily_totals import daily_totals

DAY = 86_400
SHAPE = "e bigint, src bigint, ts bigint, amount bigint, day int"


def test_stream(spark, tmp_path):
    data = [(1, 7, 10, 5, 0), (1, 7, 10, 5, 0), (2, 7, DAY - 1, None, 0), (3, 7, DAY, 4, 0), (4, 8, 5, 1, 0), (5, None, 5, 1, 0), (6, 9, 9 * DAY, 1, 0), (7, 9, 12 * DAY, 1, 0)]
    spark.createDataFrame(data[:5], SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(data[5:], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = daily_totals(stream, entity="src", ts="ts", amount="amount", key="e", late_seconds=2 * DAY)
    q = out.writeStream.format("memory").queryName("daily").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    # Day 12 is not yet past its watermark, so it is not final.
    assert rows(spark.table("daily")) == [(7, 0, 5, 2), (7, 1, 4, 1), (8, 0, 1, 1), (9, 9, 1, 1)]
