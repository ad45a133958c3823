"""Joining events with their analytics, and replacing stored events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.fixed import FORWARD_EVENT_FIELDS


def events_with_analytics(events: DataFrame, analytics: DataFrame) -> DataFrame:
    """The payload to forward: the event's public fields and what the analysis found.

    Both sides are unique by event_id; Spark chooses the join from their sizes.
    """
    found = analytics.select(
        "event_id", "anomaly", "anomaly_score", "risk_score", F.col("rule_matches").alias("detections"), "reasons")
    return events.select(*FORWARD_EVENT_FIELDS).join(found, "event_id", "left")


def upsert_events(events: DataFrame, order: list[str], key: str = "event_id") -> DataFrame:
    """The last version of each event, where `order` names the columns that tell which is last.

    Copies are reduced before the shuffle, so that an id with very many copies does not load one task.
    """
    rest = [c for c in events.columns if c != key]
    last = events.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return last.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*events.columns)
