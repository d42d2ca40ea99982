"""The bounded log: a stream in several turns and a restart equals the batch."""

import pytest
from pyspark.sql import functions as F

from arcwell.streaming import log


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in log.STORE}
    for k, v in log.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def events(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    return e.select(F.format_string("p%d", F.col("user_id") % 3).alias("project"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("id"))


def test_evictions_of_a_stream_equal_the_batch(spark, store, tmp_path):
    e = events(spark).cache()
    want = sorted(map(tuple, log.evicted(e, 20).collect()))
    assert len(want) == e.count() - 60
    got = []
    for turn in range(2):  # the second turn starts anew from the checkpoint, and brings older events too
        e.where(F.col("id") % 2 == turn).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        q = log.evicted(stream, 20).writeStream.foreachBatch(lambda d, n: got.extend(map(tuple, d.collect()))).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    assert sorted(got) == want


def test_periodic_goes_on_after_a_restart(spark, tmp_path):
    e = events(spark)
    seen = []
    for turn in range(3):
        if turn < 2:
            e.where(F.col("id") % 2 == turn).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
        q = log.periodic(stream, lambda d, n: seen.append(d.count()), str(tmp_path / "c"), availableNow=True)
        q.awaitTermination(120)
        assert q.exception() is None
    assert sum(seen) == e.count() and len(seen) == 2
