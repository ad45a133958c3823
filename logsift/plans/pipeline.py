"""The whole way of a log: parse, normalise, validate, score, hash, chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.settle import settled
from logsift.functions.text import is_blank
from logsift.operators.classify import check_format, unknown_report
from logsift.operators.formats import FormatRegistry
from logsift.operators.integrity import add_hashes, chain_hash
from logsift.operators.anomaly import AnomalySettings
from logsift.operators.normalize import assign_event_id, check_events, event_time, normalize
from logsift.operators.parse import parse_logs
from logsift.operators.quality import quality
from logsift.operators.readings import with_readings
from logsift.operators.risk import analyze
from logsift.operators.rules import RuleSettings
from logsift.schema import EVENT_SCHEMA
from logsift.sinks.tables import replace_events, table_exists, write_events
from logsift.sources.tables import read_events

EMPTY_LOG = "Log cannot be empty"


def process_logs(logs: DataFrame, registry: FormatRegistry | None = None, id_parts: list[str] | None = None,
                 ingest_time: Column | None = None, intelligence: bool = True) -> DataFrame:
    """Events from raw logs, each with `reject_reason` (null when accepted). No shuffle.

    `logs` has `raw_event` and either `event_id` or the `id_parts` columns an id is made of: what
    tells two equal logs apart, such as file and line, topic, partition and offset, or request and
    position. `ingest_time` stands for the time of storage; without it, created_at is null.
    """
    if "event_id" not in logs.columns and not id_parts:
        raise ValueError("name the columns an event id is made of: id_parts")
    kept = [c for c in logs.columns if c not in EVENT_SCHEMA.names]
    out = logs if "event_id" in logs.columns else assign_event_id(logs, *(id_parts or []), "raw_event")
    created = ingest_time if ingest_time is not None else F.lit(None)
    out = out.withColumn("created_at", created.cast("timestamp")).withColumn("_empty", is_blank(F.col("raw_event")))
    out, _added = with_readings(out, "raw_event")
    out = parse_logs(out, registry)
    out = unknown_report(out, enabled=intelligence)
    out = check_format(out)
    out = normalize(out)
    out = check_events(out)
    out = quality(out)
    out = (
        out.withColumn("quality_score", F.col("quality.quality_score"))
        .withColumn("quality_status", F.col("quality.status"))
        .withColumn("format", F.col("format_result.format"))
        .withColumn("event_ts", event_time(F.col("timestamp"), F.col("created_at") if ingest_time is not None else None))
        .withColumn("reject_reason", settled(F.when(F.col("_empty"), EMPTY_LOG).otherwise(F.col("reject_reason"))))
    )
    out = add_hashes(out)
    stored = [f for f in EVENT_SCHEMA.fields if f.name in out.columns]
    return out.select(
        *kept, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in stored], "parse_error", "quality",
        "format_result", "classification", "reject_reason",
    )


def analyze_logs(logs: DataFrame, events_path: str, rules: RuleSettings = RuleSettings(), anomalies: AnomalySettings = AnomalySettings(),
                 registry: FormatRegistry | None = None, id_parts: list[str] | None = None, ingest_time: Column | None = None) -> DataFrame:
    """From raw logs to the analytics table. The accepted events are stored at `events_path` first, so
    each log is parsed once and the analysis reads the few columns it needs. Where there is a table already,
    the events replace those of the same ids: the same logs may be read again."""
    events = accepted(process_logs(logs, registry, id_parts, ingest_time if ingest_time is not None else F.current_timestamp()))
    if table_exists(logs.sparkSession, events_path):
        replace_events(events, events_path, ["created_at"])
    else:
        write_events(events, events_path)
    return analyze(read_events(logs.sparkSession, events_path), rules, anomalies)


def accepted(processed: DataFrame) -> DataFrame:
    return processed.filter("reject_reason IS NULL").drop("reject_reason")


def rejected(processed: DataFrame) -> DataFrame:
    return processed.filter("reject_reason IS NOT NULL")


def chain_events(events: DataFrame, key: str, time: str, order: list[str], segment_rows: int = 10_000,
                 slab_seconds: int = 3600, start: DataFrame | None = None) -> DataFrame:
    """Add the chain columns to accepted events with unique ids, best those of a stored table, which are
    read twice. Only id, order and text go through the chain; `start` is as in `chain_hash`."""
    links = chain_hash(events.withColumn("chain_key", F.col(key).cast("string")), ["chain_key"], time,
                       [*order, "event_id"] if "event_id" not in order else order,
                       segment_rows=segment_rows, slab_seconds=slab_seconds, start=start)
    links = links.select("event_id", "chain_key", "chain_segment", "chain_pos", "previous_hash", "chain_hash")
    return events.join(links, "event_id")
