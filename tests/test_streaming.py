"""Streams give what the batch plans give."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import state
from cairn.streaming import state as streaming

DATA = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    spark.read.parquet(f"{DATA}/events.parquet").coalesce(1).write.mode("overwrite").parquet(str(folder / "e"))
    streaming.configure(spark)
    return str(folder / "e")


def run(spark, df, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_keyed_state_equals_batch(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    source = spark.readStream.schema(batch.schema).parquet(events)
    got = run(spark, streaming.run_keyed(source, "user_id", "ts", "event_id", streaming.TokenBucket(8 * HOUR, 3)), "bucket", tmp_path)
    want = {r.event_id: int(r.allowed) for r in state.token_bucket(batch, "user_id", "ts", "event_id", 8 * HOUR, 3).collect()}
    assert {r.id: r.result for r in got} == want
    errors = batch.filter("event_type = 'error'")
    got = run(spark, streaming.run_keyed(source.filter("event_type = 'error'"), "user_id", "ts", "event_id", streaming.HandoffCounter(72 * HOUR)), "handoff", tmp_path)
    want = {r.event_id: r["count"] for r in state.handoffs(errors, "user_id", "ts", "event_id", 72 * HOUR).collect()}
    assert {r.id: r.result for r in got} == want


def test_windows_on_a_stream(spark, events, tmp_path):
    batch = spark.read.parquet(events)
    source = spark.readStream.schema(batch.schema).parquet(events)
    got = run(spark, streaming.windowed_counts(source, "ts", "event_type", "1 day", "1 hour"), "days", tmp_path)
    want = batch.groupBy(F.window("ts", "1 day"), "event_type").count().count()
    assert 0 < len(got) <= want
