"""Rules, rates and chains kept up to date over a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from logsift.operators.anomaly import AnomalySettings, bucket_baseline
from logsift.operators.integrity import chain_hash, latest_chain_hash
from logsift.operators.rules import RuleSettings, with_rule_counts
from logsift.sinks.tables import table_exists
from logsift.streaming.keyed import own_or_storage_time


def start_rules(events: DataFrame, path: str, checkpoint: str, settings: RuleSettings = RuleSettings(),
                time: str = "event_ts", available_now: bool = False) -> StreamingQuery:
    """The same counts for sources of any size: each micro-batch is counted by the batch rules,
    which split a busy source over many tasks, together with the stored events still in a window.

    The written table is the state: event_id, time, source_ip, action, event_type, severity,
    auth_failed, failed_count, spike_count by batch. Its time statistics let the reader skip what
    has left the windows. A late event is counted itself, counts already given stay. Events without a
    time of their own are counted, and written, at their time of storage.
    """
    longest = max(settings.failed_login_seconds, settings.spike_seconds)
    kept = ["event_id", time, "source_ip", "action", "event_type", "severity"]
    types = f"event_id string, {time} timestamp, source_ip string, action string, event_type string, severity string, batch_id int"

    def count(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn(time, own_or_storage_time(batch, time)).select(*kept).withColumn("fresh", F.lit(True)).persist()
        try:
            first = fresh.agg(F.min(time)).first()[0]
            rows = fresh
            if first is not None and table_exists(spark, path):
                since = F.lit(first) - F.expr(f"INTERVAL {longest} SECONDS")
                before = spark.read.schema(types).parquet(path).filter((F.col("batch_id") < number) & (F.col(time) >= since))
                rows = fresh.unionByName(before.select(*kept).withColumn("fresh", F.lit(False)))
            counted = with_rule_counts(rows, settings, time).filter("fresh").drop("fresh")
            counted.write.mode("overwrite").parquet(f"{path}/batch_id={number}")
        finally:
            fresh.unpersist()

    writer = events.writeStream.foreachBatch(count).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_rate_anomaly(events: DataFrame, path: str, checkpoint: str, settings: AnomalySettings = AnomalySettings(),
                       time: str = "event_ts", delay: str = "10 minutes", available_now: bool = False) -> StreamingQuery:
    """Judge each time bucket, once the watermark has closed it, against the buckets stored before.

    The stream holds one count per open bucket; the closed ones live in a table of their own.
    """
    window = F.window(F.col(time), f"{settings.bucket_seconds} seconds")
    counts = events.withWatermark(time, delay).groupBy(window).agg(F.count("*").alias("n")).select(
        (F.unix_seconds("window.start") / settings.bucket_seconds).cast("bigint").alias("bucket"), "n")

    def judge(batch: DataFrame, number: int) -> None:
        spark, batch = batch.sparkSession, batch.persist()
        try:
            judge_closed(spark, batch, number)
        finally:
            batch.unpersist()

    def judge_closed(spark, batch: DataFrame, number: int) -> None:
        schema = "bucket long, n long, samples long, mean double, sd double, zscore double, anomaly boolean, batch_id int"
        stored = spark.read.schema(schema).parquet(path) if table_exists(spark, path) else spark.createDataFrame([], schema)
        before = stored.filter(F.col("batch_id") < number).select("bucket", "n").orderBy(F.desc("bucket")).limit(settings.history)
        both = before.withColumn("fresh", F.lit(False)).unionByName(batch.withColumn("fresh", F.lit(True)))
        base = bucket_baseline(both.select("bucket", "n"), settings).join(both.select("bucket", "fresh"), "bucket")
        z = F.when((F.col("samples") >= settings.min_samples) & (F.col("sd") > 0), (F.col("n") - F.col("mean")) / F.col("sd"))
        judged = base.filter("fresh").drop("fresh").withColumn("zscore", z).withColumn(
            "anomaly", F.coalesce(F.col("zscore") >= settings.zscore, F.lit(False)))
        judged.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    writer = counts.writeStream.outputMode("append").foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_chain(events: DataFrame, path: str, checkpoint: str, key: str, time: str, order: list[str], raw: str = "raw_event",
                segment_rows: int = 10_000, slab_seconds: int = 3600, available_now: bool = False) -> StreamingQuery:
    """Chain a stream in the format of `chain_hash`: the same positions, segments and hashes as one batch of all rows, if they
    arrive in order.

    A micro-batch is numbered and cut into segments by position, so a busy key is as many tasks as it has segments. It
    goes on from where each key stood: one row per key, written anew below `path` with each batch. A batch that is run again starts
    from the same state and replaces its own folder. Columns: chain_key, the `order` columns, chain_pos, chain_segment,
    previous_hash, chain_hash.
    """
    state = "chain_key string, latest_chain_hash string, next_pos long"

    def link(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(state).parquet(f"{path}/state/batch_id={number - 1}") if number else spark.createDataFrame([], state)
        rows = batch.withColumn("chain_key", F.col(key).cast("string"))
        chain_hash(rows, ["chain_key"], time, order, raw, segment_rows, slab_seconds, before if number else None).write.mode("overwrite").parquet(f"{path}/chain/batch_id={number}")
        now = latest_chain_hash(spark.read.parquet(f"{path}/chain/batch_id={number}"), ["chain_key"]).withColumnsRenamed({"latest_chain_hash": "hash", "next_pos": "pos"})
        both = before.join(now, "chain_key", "full").select("chain_key", F.coalesce("hash", "latest_chain_hash").alias("latest_chain_hash"), F.coalesce("pos", "next_pos").alias("next_pos"))
        both.write.mode("overwrite").parquet(f"{path}/state/batch_id={number}")

    writer = events.writeStream.foreachBatch(link).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streaming_chain(events: DataFrame, key: str, order: list[str], raw: str = "raw_event") -> DataFrame:
    """(key, event_id, previous_hash, chain_hash): each key's chain goes on from batch to batch.

    One chain per key without segments. State per key: its last hash. Within a batch rows are taken by `order`. A key is one
    task of a micro-batch; `start_chain` splits a busy one, and gives the hashes of the batch.
    """
    def link(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        previous = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        before, after = [], []
        for text in rows["_raw"]:
            before.append(previous or None)
            previous = hashlib.sha256((previous + text).encode("utf-8", "surrogatepass")).hexdigest()
            after.append(previous)
        state.update((previous,))
        yield pd.DataFrame({"chain_key": group[0], "event_id": rows["event_id"].values,
                            "previous_hash": before, "chain_hash": after})

    columns = list(dict.fromkeys([*order, "event_id"]))
    rows = events.select(F.col(key).cast("string").alias("chain_key"), *columns, F.col(raw).alias("_raw"))
    return rows.groupBy("chain_key").applyInPandasWithState(
        link, "chain_key string, event_id string, previous_hash string, chain_hash string", "last string",
        "append", GroupStateTimeout.NoTimeout)
