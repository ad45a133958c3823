"""Risk score of an event, and the whole analysis that leads to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift import fixed
from logsift.operators.anomaly import AnomalySettings, rate_anomaly
from logsift.operators.rules import RuleSettings, apply_rules, with_rule_counts


def risk_points() -> Column:
    severity = F.lower(F.col("severity"))
    base = F.lit(0)
    for word, points in fixed.SEVERITY_POINTS.items():
        base = base + F.when(severity == word, points).otherwise(0)
    rules = F.col("rule_matches")
    extra = lambda name, points: F.when(F.array_contains(rules, name), points).otherwise(0)
    anomaly = F.when(F.col("anomaly"), (F.col("anomaly_score") * fixed.ANOMALY_POINTS).cast("int")).otherwise(0)
    total = (
        base + F.size(rules) * fixed.RULE_POINTS + extra("repeated_failed_login", fixed.FAILED_LOGIN_POINTS)
        + extra("suspicious_command", fixed.COMMAND_POINTS) + anomaly
    )
    return F.least(F.greatest(total, F.lit(0)), F.lit(100)).cast("int")


def risk_band(score: Column) -> Column:
    band = None
    for limit, name in fixed.RISK_BANDS:
        band = F.when(score < limit, name) if band is None else band.when(score < limit, name)
    return band.otherwise(fixed.RISK_TOP_BAND)


def risk_score(df: DataFrame) -> DataFrame:
    """Add risk_score and risk_severity from severity, rule_matches, anomaly and anomaly_score."""
    return df.withColumn("risk_score", risk_points()).withColumn("risk_severity", risk_band(F.col("risk_score")))


def analyze(events: DataFrame, rules: RuleSettings = RuleSettings(), anomalies: AnomalySettings = AnomalySettings(),
            time: str = "event_ts", enabled: bool = True) -> DataFrame | None:
    """The analytics table: rules, rate anomaly and risk of every event; None when switched off.

    An event without a time of its own is judged by its time of storage, created_at, where the table
    has that. Only the columns the rules read are carried through the two shuffles. Events should
    come from a stored table: see `logsift.plans.pipeline.analyze_logs`.
    """
    if not enabled:
        return None
    at = F.coalesce(time, "created_at") if "created_at" in events.columns else F.col(time)
    narrow = events.select(
        "event_id", at.alias("event_ts"), "source_ip", "action", "event_type", "severity", "protocol",
        "destination_port", F.map_filter("extensions", lambda k, _v: k.isin("command", "process_command_line"))
        .alias("extensions"),
    )
    ruled = apply_rules(with_rule_counts(narrow, rules), rules).select(
        "event_id", "event_ts", "severity", "rule_matches", "rule_reasons", "detected")
    scored = risk_score(rate_anomaly(ruled, anomalies, counted=narrow))
    reasons = F.when(F.col("anomaly"), F.concat("rule_reasons", F.array("anomaly_reason"))).otherwise(
        F.col("rule_reasons"))
    return scored.select(
        "event_id", "detected", "anomaly", "anomaly_score", "risk_score", F.col("risk_severity").alias("severity"),
        F.col("rule_matches").alias("detections"), reasons.alias("reasons"), "rule_matches",
        F.col("event_ts").alias("timestamp"),
    )
