"""Counts over events and analytics. All aggregate in the map side before they shuffle."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import is_blank
from logsift.operators.display import format_label


def count_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("total_events"))


def analytics_stats(analytics: DataFrame) -> DataFrame:
    """One row: total_analyzed, anomalies, detections."""
    return analytics.agg(
        F.count("*").alias("total_analyzed"), F.count_if("anomaly").alias("anomalies"),
        F.count_if("detected").alias("detections"),
    )


def severity_counts(analytics: DataFrame) -> DataFrame:
    return analytics.groupBy("severity").agg(F.count("*").alias("events"))


def format_facets(events: DataFrame) -> DataFrame:
    return events.groupBy(format_label().alias("format_label")).agg(F.count("*").alias("events"))


def parser_stats(parsed: DataFrame, time: str = "event_ts") -> DataFrame:
    """Rows, failures and latest error message per parser."""
    failed = F.col("parse_status") == "error"
    stamp = F.when(failed, F.struct(F.col(time), F.col("event_id"), F.col("parse_error").alias("message")))
    return parsed.groupBy("parser").agg(
        F.count("*").alias("events"), F.count_if(failed).alias("failures"),
        F.max(stamp)["message"].alias("last_error"),
    )


def ingest_report(events: DataFrame, source: str = "file", lines: str = "line_count") -> DataFrame:
    """Per file: its lines, and the events that were accepted and rejected."""
    good = F.col("reject_reason").isNull()
    return events.groupBy(source).agg(
        F.sum(lines).alias("total_lines"), F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"),
    )


def request_report(logs: DataFrame, request: str = "request_id", raw: str = "log") -> DataFrame:
    """Per bulk request: logs accepted and blank ones rejected."""
    blank = is_blank(F.col(raw))
    return logs.groupBy(request).agg(
        F.count_if(~blank).alias("accepted_count"), F.count_if(blank).alias("rejected_count"),
    )
