"""Row types shared by batch and streaming."""

from pyspark.sql import types as T

_S = T.StringType()
_TEXT_MAP = T.MapType(_S, _S)

EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", _S, False),
    T.StructField("timestamp", _S),
    T.StructField("event_ts", T.TimestampType()),
    T.StructField("event_type", _S),
    T.StructField("source", _S),
    T.StructField("source_type", _S),
    T.StructField("source_ip", _S),
    T.StructField("source_port", T.IntegerType()),
    T.StructField("destination", _S),
    T.StructField("destination_ip", _S),
    T.StructField("destination_port", T.IntegerType()),
    T.StructField("protocol", _S),
    T.StructField("action", _S),
    T.StructField("severity", _S),
    T.StructField("user", _S),
    T.StructField("device", _S),
    T.StructField("hostname", _S),
    T.StructField("application", _S),
    T.StructField("vendor", _S),
    T.StructField("product", _S),
    T.StructField("category", _S),
    T.StructField("raw_event", _S, False),
    T.StructField("parser", _S),
    T.StructField("parser_version", _S),
    T.StructField("parse_status", _S),
    T.StructField("quality_score", T.DoubleType()),
    T.StructField("quality_status", _S),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("format", _S),
    T.StructField("extracted_data", _TEXT_MAP),
    T.StructField("extensions", _TEXT_MAP),
    T.StructField("metadata", _TEXT_MAP),
    T.StructField("plugin_data", _TEXT_MAP),
    T.StructField("raw_hash", _S),
    T.StructField("integrity_hash", _S),
    T.StructField("normalized_hash", _S),
    T.StructField("hash_version", T.IntegerType()),
    T.StructField("previous_hash", _S),
    T.StructField("chain_hash", _S),
    T.StructField("chain_key", _S),
    T.StructField("chain_segment", T.LongType()),
    T.StructField("chain_pos", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

ANALYTICS_SCHEMA = T.StructType([
    T.StructField("event_id", _S, False),
    T.StructField("detected", T.BooleanType()),
    T.StructField("anomaly", T.BooleanType()),
    T.StructField("anomaly_score", T.DoubleType()),
    T.StructField("risk_score", T.IntegerType()),
    T.StructField("severity", _S),
    T.StructField("detections", T.ArrayType(_S)),
    T.StructField("reasons", T.ArrayType(_S)),
    T.StructField("rule_matches", T.ArrayType(_S)),
    T.StructField("timestamp", T.TimestampType()),
])

ENVELOPE_SCHEMA = T.StructType([
    T.StructField("request_id", _S),
    T.StructField("log", _S),
    T.StructField("timestamp", T.DoubleType()),
    T.StructField("attempts", T.IntegerType()),
])

DEAD_LETTER_SCHEMA = T.StructType([
    T.StructField("payload", ENVELOPE_SCHEMA),
    T.StructField("error", _S),
    T.StructField("dlq_timestamp", T.DoubleType()),
])
