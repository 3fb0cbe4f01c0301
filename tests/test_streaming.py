"""Streams give what the same rows give in a batch."""

import pytest
from pyspark.sql import functions as F

from leafwork.plans import queries as Q
from leafwork.plans import sessions as S
from leafwork.streaming import sessions as stream


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    to = str(tmp_path_factory.mktemp("changes"))
    Q.changes(spark, data).withColumn("updated_at", F.col("updated_at").cast("timestamp")).repartition(3).write.mode("overwrite").parquet(to)
    return to


def source(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_page_states(spark, folder):
    q = stream.page_states(source(spark, folder)).writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    batch = S.latest_pages(spark.read.parquet(folder), ["updated_at", "change_id"])
    key = ["session_id", "page_no", "status", "error"]
    assert sorted(map(str, spark.table("states").select(key).collect())) == sorted(map(str, batch.select(key).collect()))


def test_fold_into(spark, folder, tmp_path):
    q = source(spark, folder).writeStream.foreachBatch(stream.fold_into(str(tmp_path / "t"))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    last = spark.read.parquet(str(tmp_path / "t")).filter("batch = 2")
    batch = S.latest_pages(spark.read.parquet(folder), ["updated_at", "change_id"])
    assert last.count() == batch.count()


def test_feed_and_windows(spark, folder):
    q = stream.feed(source(spark, folder)).writeStream.format("memory").queryName("feed").start()
    w = stream.windowed_progress(source(spark, folder)).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    w.processAllAvailable()
    q.stop()
    w.stop()
    assert spark.table("feed").count() == spark.read.parquet(folder).count()
    assert spark.table("windows").count() > 0


def test_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "s")
    spark.sql("SELECT 'old' AS session_id, timestamp'2020-01-01 00:00:00' AS expires_at UNION ALL SELECT 'new', current_timestamp() + INTERVAL 2 HOURS").write.parquet(src)
    try:
        q = stream.expiry_events(spark.readStream.schema("session_id string, expires_at timestamp").parquet(src)).writeStream.outputMode("update").format("memory").queryName("expiry").option("checkpointLocation", str(tmp_path / "c")).start()
    except Exception as e:
        pytest.skip(f"this Spark cannot start it: {str(e)[:100]}")
    import time

    until = time.time() + 60
    while time.time() < until and q.isActive and spark.table("expiry").filter("event = 'session_expired'").count() == 0:
        time.sleep(1)
    error = q.exception()
    q.stop()
    assert error is None, str(error)[:500]
    got = [(r.session_id, r.event) for r in spark.table("expiry").collect()]
    assert got.count(("old", "session_expired")) == 1 and not [x for x in got if x[0] == "new"]
