"""Forwarding through a data source: receipts, commits, aborts, and a receiver that is down."""

import os

import pytest
from pyspark.sql import functions as F

from logsift.session import new_folder
from logsift.sinks.forward import Breaker, forward, payloads_of, read_receipts, register_forward, send_all


def counter(folder, answer):
    """A receiver that leaves a file for each call, whichever process makes it."""
    os.makedirs(folder)

    def sender(body):
        import uuid
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        return answer(body)

    return sender


def test_a_dead_receiver_costs_one_cycle(tmp_path, spark):
    folder = str(tmp_path / "calls")
    register_forward(spark, "dead", counter(folder, lambda body: 503), batch_rows=5, retries=3, backoff=0)
    rows = payloads_of(spark.range(0, 60, numPartitions=2).select(F.col("id").cast("string").alias("event_id")))
    receipts = new_folder(spark, "receipts")
    rows.write.format("dead").mode("append").option("receipts", receipts).save()
    got = read_receipts(spark, receipts).collect()
    assert len(got) == 60 and not any(r.delivered for r in got)
    assert len(os.listdir(folder)) == 2 * (4 + 1)  # a cycle and one call more for each task
    assert sum(r.calls == 0 for r in got) == 50


def test_breaker_by_single_rows():
    calls = []

    def sender(body):
        calls.append(body)
        return 400 if isinstance(body, list) else 500 if body == "bad" else 200

    broken = Breaker(2)
    assert send_all(["ok", "bad", "ok", "bad", "ok"], sender, broken, 1, 0) == [(True, 1), (False, 2), (True, 1), (False, 2), (False, 0)]
    assert send_all(["ok"], sender, broken, 1, 0) == [(False, 0)]
    assert send_all(["bad", "ok"], sender, Breaker(None), 1, 0) == [(False, 2), (True, 1)]
    late = iter([500, 500, 200, 200, 200])  # the batch is too much for the receiver, its rows are not
    assert send_all(["a", "b"], lambda body: next(late), Breaker(1), 1, 0) == [(True, 1), (True, 1)]


def test_forward_with_a_breaker(spark):
    rows = spark.range(0, 40, numPartitions=1).select(F.col("id").cast("string").alias("event_id"))
    got = forward(rows, lambda body: 503, batch_rows=10, retries=2, backoff=0, breaker=1).collect()
    assert [r.calls for r in got] == [4] + [3] * 9 + [0] * 30


def test_nothing_is_left_of_a_failed_write(spark):
    register_forward(spark, "good", lambda body: 200, backoff=0)
    receipts = new_folder(spark, "receipts")
    rows = payloads_of(spark.range(0, 10, numPartitions=2).select(F.when(F.col("id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("event_id")))
    with pytest.raises(Exception, match="lost"):
        rows.write.format("good").mode("append").option("receipts", receipts).save()
    assert not os.path.exists(receipts.removeprefix("file:")) or not os.listdir(receipts.removeprefix("file:"))


def test_receipts_of_a_stream(spark):
    source, receipts = new_folder(spark, "in"), new_folder(spark, "receipts")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select(F.col("id").cast("string").alias("event_id"), F.lit("x").alias("body")).coalesce(1).write.mode("append").parquet(source)
    register_forward(spark, "streamed", lambda body: 200 if isinstance(body, list) else 400, backoff=0)
    stream = spark.readStream.schema("event_id string, body string").option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):  # the second run has nothing to do
        stream.writeStream.format("streamed").option("receipts", receipts).option("checkpointLocation", receipts + "-state").trigger(availableNow=True).start().awaitTermination()
    got = read_receipts(spark, receipts).collect()
    assert sorted(int(r.event_id) for r in got) == list(range(30)) and all(r.delivered and r.calls == 1 for r in got)
    assert len([n for n in os.listdir(receipts.removeprefix("file:")) if n.startswith("sent-")]) == 3


def test_events_with_analytics_are_forwarded_as_a_stream(spark):
    from logsift.fixed import FORWARD_EVENT_FIELDS
    from logsift.streaming.pipeline import with_analytics

    events, found, receipts = (new_folder(spark, n) for n in ("events", "analytics", "receipts"))
    for i in range(3):
        ids = spark.range(i * 10, i * 10 + 10).select(F.format_string("e%02d", "id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 60).alias("event_ts"))
        ids.select("event_ts", *[F.col(c) if c == "event_id" else F.lit(None).cast("string").alias(c) for c in FORWARD_EVENT_FIELDS]).coalesce(1).write.mode("append").parquet(events)
        ids.where("event_id LIKE '%5'").select("event_id", F.col("event_ts").alias("timestamp"), F.lit(True).alias("anomaly"), F.lit(0.5).alias("anomaly_score"), F.lit(60).alias("risk_score"),
                                               F.array(F.lit("rule")).alias("rule_matches"), F.array(F.lit("why")).alias("reasons")).coalesce(1).write.mode("append").parquet(found)
    read = lambda path: spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
    register_forward(spark, "siem", lambda body: 400 if isinstance(body, list) else 200 if '"risk_score":60' in body else 401, backoff=0)
    stream = payloads_of(with_analytics(read(events), read(found), "2 minutes")).writeStream.format("siem").option("receipts", receipts)
    stream.option("checkpointLocation", receipts + "-state").trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.delivered for r in read_receipts(spark, receipts).collect()}
    assert {i for i, good in got.items() if good} == {"e05", "e15", "e25"}
    # The others are given once the watermark has passed them: the last analytics at 25 minutes, less 2.
    assert {i for i, good in got.items() if not good} == {f"e{i:02d}" for i in range(24) if i % 10 != 5}
