"""The log pipeline as a stream."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logsift.fixed import FORWARD_EVENT_FIELDS
from logsift.operators.formats import FormatRegistry
from logsift.plans.pipeline import accepted, process_logs, rejected
from logsift.sinks.tables import DAY, dated, write_dead_letters


def start_pipeline(logs: DataFrame, events_path: str, dead_path: str, checkpoint: str,
                   registry: FormatRegistry | None = None, available_now: bool = False,
                   id_parts: list[str] | None = None) -> StreamingQuery:
    """Store what `process_logs` makes of the stream, one select from log to hashed event: the events by date, and the
    rejected logs.

    A batch writes its own folder of each date and replaces it when it is run again, and ids depend on the log
    alone, so a retry leaves no copies. Rejected logs are rejected again however often they are
    tried, hence go straight to the dead letters.
    """
    if "event_id" not in logs.columns and not id_parts:
        raise ValueError("name the columns an event id is made of: id_parts")

    def store(batch: DataFrame, number: int) -> None:
        done = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            events = dated(accepted(done)).withColumn("batch_id", F.lit(number))
            events.hint("rebalance", DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, "batch_id").parquet(events_path)
            write_dead_letters(rejected(done), f"{dead_path}/batch_id={number}", mode="overwrite")
        finally:
            done.unpersist()

    processed = process_logs(logs, registry, id_parts, ingest_time=F.current_timestamp())
    writer = processed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def once(messages: DataFrame, id: str = "request_id", time: str = "queued_at", delay: str = "10 minutes") -> DataFrame:
    """Each message of a queue once, however often it is delivered within `delay`. State: the ids of that time."""
    return messages.withWatermark(time, delay).dropDuplicatesWithinWatermark([id])


def with_analytics(events: DataFrame, analytics: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The payload to forward, of two streams: the event's public fields and what the analysis found, null where it found nothing
    by the time the watermark has passed the event.

    Both have the event's time: its own, else that of storage. An event is held until its analytics arrive or `delay` has passed.
    """
    at = F.coalesce("event_ts", "created_at") if "created_at" in events.columns else F.col("event_ts")
    left = events.select(*FORWARD_EVENT_FIELDS, at.alias("_at")).withWatermark("_at", delay)
    right = analytics.select(F.col("event_id").alias("_id"), F.col("timestamp").alias("_found"), "anomaly", "anomaly_score", "risk_score",
                             F.col("rule_matches").alias("detections"), "reasons").withWatermark("_found", delay)
    return left.join(right, (F.col("event_id") == F.col("_id")) & (F.col("_at") == F.col("_found")), "left_outer").drop("_id", "_found", "_at")
