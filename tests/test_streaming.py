import hashlib
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsift.operators.anomaly import AnomalySettings, rate_anomaly
from logsift.operators.rules import RuleSettings, with_rule_counts
from logsift.operators.integrity import chain_hash
from logsift.operators.late import flag_late
from logsift.streaming.pipeline import once
from logsift.streaming.keyed import TrailingCounts, streaming_rate_events, streaming_rules
from logsift.streaming.stateful import start_chain, start_rate_anomaly, start_rules, streaming_chain

SETTINGS = RuleSettings(failed_login_seconds=300, spike_seconds=120)
SCHEMA = ("event_id string, event_ts timestamp, source_ip string, action string, event_type string, severity string, raw_event string")


@pytest.fixture(scope="module")
def batches(spark, tmp_path_factory):
    """Events in time order, cut into five files that arrive one after the other."""
    rng, folder, rows = random.Random(2), tmp_path_factory.mktemp("in"), []
    for i, at in enumerate(sorted(rng.randint(0, 4000) for _ in range(600))):
        rows.append((f"e{i:04d}", datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at), rng.choice(["a", "a", "b", "c", None]),
                     rng.choice(["fail", "ok"]), None, None, f"raw {i}"))
    for part in range(5):
        spark.createDataFrame(rows[part * 120:(part + 1) * 120], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder)), spark.createDataFrame(rows, SCHEMA)


def collect(spark, stream, tmp_path):
    out = str(tmp_path / "out")
    stream.writeStream.format("parquet").outputMode("append").option("path", out).option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).collect()


def expected(table):
    return {r["event_id"]: (r["failed_count"] if r["auth_failed"] else 0, r["spike_count"])
            for r in with_rule_counts(table, SETTINGS).filter("source_ip IS NOT NULL").collect()}


def test_rules_by_state(spark, batches, tmp_path):
    stream, table = batches
    rows = collect(spark, streaming_rules(stream, SETTINGS), tmp_path)
    assert {r["event_id"]: (r["failed_count"], r["spike_count"]) for r in rows} == expected(table)


def test_rules_by_bucket(spark, batches, tmp_path, monkeypatch):
    """Many sources are few calls of the state processor, also when they share a bucket and times lie far apart."""
    stream, table = batches
    far = lambda df: df.withColumns({"source_ip": F.concat("source_ip", F.pmod(F.xxhash64("event_id"), F.lit(40)).cast("string")),
                                     "event_ts": F.when(F.col("event_id") == "e0000", F.timestamp_seconds(F.lit(1000))).otherwise(F.col("event_ts"))})
    keys, counts = str(tmp_path / "keys"), TrailingCounts.handleInputRows

    def counted(self, key, rows, timerValues):
        with open(keys, "a") as f:
            f.write(f"{key[0]}\n")
        return counts(self, key, rows, timerValues)

    monkeypatch.setattr(TrailingCounts, "handleInputRows", counted)
    rows = collect(spark, streaming_rules(far(stream), SETTINGS, buckets=2), tmp_path)
    assert {r["event_id"]: (r["failed_count"], r["spike_count"]) for r in rows} == expected(far(table))
    assert len({r["source_ip"] for r in rows}) > 100
    with open(keys) as f:
        assert 5 <= len(f.read().split()) <= 10


def test_rules_by_table(spark, batches, tmp_path):
    stream, table = batches
    out = str(tmp_path / "out")
    start_rules(stream, out, str(tmp_path / "state"), SETTINGS, available_now=True).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len({r["batch_id"] for r in rows}) == 5 and len(rows) == 600
    got = {r["event_id"]: (r["failed_count"] if r["auth_failed"] else 0, r["spike_count"]) for r in rows if r["source_ip"]}
    assert got == expected(table)


def test_chain_goes_on(spark, batches, tmp_path):
    stream, table = batches
    keyed = stream.withColumn("key", F.coalesce("source_ip", F.lit("none")))
    got = {r["event_id"]: r for r in collect(spark, streaming_chain(keyed, "key", ["event_ts", "event_id"]), tmp_path)}
    last = {}
    for r in sorted(table.collect(), key=lambda r: (r["event_ts"], r["event_id"])):
        key = r["source_ip"] or "none"
        assert got[r["event_id"]]["previous_hash"] == last.get(key)
        last[key] = hashlib.sha256((last.get(key, "") + r["raw_event"]).encode()).hexdigest()
        assert got[r["event_id"]]["chain_hash"] == last[key]


def test_rates(spark, batches, tmp_path):
    stream, table = batches
    settings = AnomalySettings(bucket_seconds=40, history=30, min_samples=10, zscore=1.5)
    out = str(tmp_path / "out")
    start_rate_anomaly(stream, out, str(tmp_path / "state"), settings, delay="1 minute", available_now=True).awaitTermination()
    closed = {r["bucket"]: (r["n"], r["anomaly"]) for r in spark.read.parquet(out).collect()}
    judged = rate_anomaly(table, settings).withColumn("bucket", F.floor(F.unix_seconds("event_ts") / 40))
    want = {r["bucket"]: (r["n"], r["hit"]) for r in judged.groupBy("bucket").agg(F.count("*").alias("n"), F.max("anomaly").alias("hit")).collect()}
    assert len(closed) > 60 and any(hit for _n, hit in closed.values())
    assert {b: want[b] for b in closed} == closed


def test_rates_per_event(spark, batches, tmp_path):
    stream, table = batches
    settings = AnomalySettings(bucket_seconds=40, history=30, min_samples=10, zscore=1.5)
    rows = collect(spark, streaming_rate_events(stream, settings), tmp_path)
    want = {r.event_id: (r.anomaly, r.anomaly_score, r.anomaly_reason) for r in rate_anomaly(table, settings).collect()}
    assert {r.event_id: (r.anomaly, r.anomaly_score, r.anomaly_reason) for r in rows} == want and len(rows) == 600
    assert len({a for a, _, _ in want.values()}) == 2


def test_chain_in_the_format_of_the_batch(spark, batches, tmp_path):
    stream, table = batches
    keyed = lambda df: df.withColumn("key", F.coalesce("source_ip", F.lit("none")))
    out = str(tmp_path / "out")
    start_chain(keyed(stream), out, str(tmp_path / "state"), "key", "event_ts", ["event_id"], segment_rows=7, slab_seconds=500, available_now=True).awaitTermination()
    columns = ["chain_key", "event_id", "chain_pos", "chain_segment", "previous_hash", "chain_hash"]
    want = chain_hash(keyed(table).withColumn("chain_key", F.col("key")), ["chain_key"], "event_ts", ["event_id"], segment_rows=7, slab_seconds=500)
    assert sorted(map(tuple, spark.read.parquet(out + "/chain").select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)


def test_events_without_a_time_count_at_their_time_of_storage(spark, batches, tmp_path):
    stream, table = batches
    late = lambda df: df.withColumn("created_at", F.col("event_ts")).withColumn("event_ts", F.when(F.xxhash64("event_id") % 2 == 0, F.col("event_ts")))
    rows = collect(spark, streaming_rules(late(stream), SETTINGS), tmp_path)
    assert {r["event_id"]: (r["failed_count"], r["spike_count"]) for r in rows} == expected(table)
    out = str(tmp_path / "table")
    start_rules(late(stream), out, str(tmp_path / "table-state"), SETTINGS, available_now=True).awaitTermination()
    got = {r["event_id"]: (r["failed_count"] if r["auth_failed"] else 0, r["spike_count"]) for r in spark.read.parquet(out).collect() if r["source_ip"]}
    assert got == expected(table)


def test_late_rows_are_those_a_stream_drops(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(300):
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=i * 10 - rng.choice([0, 0, 0, 700, 2500]), microseconds=rng.randrange(10**6))
        rows.append((f"e{i}", None if i == 77 else at, i // 60, i))
    schema = "event_id string, event_ts timestamp, part int, n int"
    table = spark.createDataFrame(rows, schema)
    for part in range(5):
        table.where(F.col("part") == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = {r.event_id for r in collect(spark, once(stream.where("event_ts IS NOT NULL"), "event_id", "event_ts", "10 minutes"), tmp_path)}
    late = {r.event_id for r in flag_late(table, 600, batch="part").where("late").collect()}
    assert late and {f"e{i}" for i in range(300) if i != 77} - kept == late
    latest, want = None, set()
    for name, at, _, _ in rows:
        if at is not None:
            mark = None if latest is None else latest - timedelta(microseconds=latest.microsecond % 1000) - timedelta(seconds=600)
            if mark is not None and at <= mark:
                want.add(name)
            latest = max(at, latest or at)
    got = flag_late(table.repartition(6), 600, order=["n"])
    assert {r.event_id for r in got.where("late").collect()} == want and got.count() == 300
    assert flag_late(table.where("false"), 600, order=["n"]).count() == 0
