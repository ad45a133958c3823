"""Fields as they are shown to an analyst."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTED = [
    "event_id", "timestamp", "source", "source_ip", "source_port", "destination", "destination_ip",
    "destination_port", "protocol", "event_type", "action", "severity", "parser", "format", "parse_status",
]


def _or_dash(value: Column) -> Column:
    return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("—"))


def format_label() -> Column:
    """Format, else parser, else UNKNOWN, in capitals."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.upper(F.coalesce(filled("format"), filled("parser"), F.lit("UNKNOWN")))


def _endpoint(ip: str, port: str, name: str) -> Column:
    shown_port = F.when(F.col(port) != 0, F.concat(F.lit(":"), F.col(port).cast("string"))).otherwise("")
    return F.when(F.coalesce(F.col(ip), F.lit("")) != "", F.concat(F.col(ip), shown_port)).otherwise(
        _or_dash(F.col(name)))


def display_fields(events: DataFrame) -> DataFrame:
    """Add display_source, display_destination, badge, confidence_percent, field_count, format_label."""
    c = F.col("confidence")
    percent = F.floor(F.when(c <= 1.0, c * 100).otherwise(c) + 0.5).cast("int")
    filled = F.lit(0)
    for field in COUNTED:
        filled = filled + F.when(F.col(field).cast("string") != "", 1).otherwise(0)
    count = F.when(F.col("extracted_data").isNotNull(), F.size("extracted_data")).otherwise(filled)
    return (
        events.withColumn("display_source", _endpoint("source_ip", "source_port", "source"))
        .withColumn("display_destination", _endpoint("destination_ip", "destination_port", "destination"))
        .withColumn("badge", F.when(F.coalesce(F.col("chain_hash"), F.lit("")) != "", "VERIFIED").otherwise("—"))
        .withColumn("confidence_percent", percent).withColumn("field_count", count)
        .withColumn("format_label", format_label())
    )
