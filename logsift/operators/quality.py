"""How complete, valid and consistent an event is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.fixed import (
    IMPORTANT_FIELDS, QUALITY_FIELDS, QUALITY_WEIGHTS, REQUIRED_FIELDS, WARN_CONSISTENCY, WARN_MISSING, WARN_VALIDITY,
)
from logsift.functions.address import is_ip
from logsift.functions.arrays import kept, kept_strings
from logsift.functions.settle import settled
from logsift.functions.text import is_blank

PORTS = ("source_port", "destination_port")


def _present(field: str) -> Column:
    """A port of zero counts as missing, as does empty text."""
    value = F.col(field)
    return F.coalesce(value != (0 if field in PORTS else ""), F.lit(False))


def _missing(fields: list[str]) -> Column:
    return kept_strings([(~_present(f), f) for f in fields])


def _percent(part: Column, whole: Column) -> Column:
    # rint rounds halves to even, which the scores depend on.
    return F.rint(part / whole * 100)


def _count(checks: list[Column]) -> Column:
    total = F.lit(0)
    for check in checks:
        total = total + F.coalesce(check.cast("int"), F.lit(0))
    return total


def quality(df: DataFrame) -> DataFrame:
    """Add the struct `quality`: status, quality_score, its three parts, missing fields, warnings."""
    complete = _percent(_count([_present(f) for f in QUALITY_FIELDS]), F.lit(len(QUALITY_FIELDS)))

    valid = [~_present(f) | is_ip(F.col(f)) for f in ("source_ip", "destination_ip")]
    valid += [F.col(f).isNull() | F.col(f).between(1, 65535) for f in PORTS]
    validity = _percent(_count(valid), F.lit(len(valid)))

    both_ip = _present("source_ip") & _present("destination_ip")
    both_port = F.col("source_port").isNotNull() & F.col("destination_port").isNotNull()
    acted = F.col("action").isNotNull()
    applying = _count([both_ip, both_port, acted])
    passing = _count([
        both_ip & (F.col("source_ip") != F.col("destination_ip")),
        both_port & (F.col("source_port") != F.col("destination_port")),
        acted & ~is_blank(F.col("action")),
    ])
    consistency = F.when(applying == 0, F.lit(100.0)).otherwise(_percent(passing, F.nullif(applying, F.lit(0))))

    parts = df.withColumn("_q", settled(F.struct(
        complete.alias("completeness"), validity.alias("validity"), consistency.alias("consistency"),
        _missing(REQUIRED_FIELDS).alias("required"), _missing(IMPORTANT_FIELDS).alias("important"),
        _missing(QUALITY_FIELDS).alias("all"),
    )))
    q = lambda name: F.col(f"_q.{name}")
    w = QUALITY_WEIGHTS
    score = F.rint(q("completeness") * w["completeness"] + q("validity") * w["validity"]
                     + q("consistency") * w["consistency"])
    scored = parts.withColumn("_score", score)
    status = (
        F.when((F.size(q("required")) > 0) | (q("validity") < 50), "invalid")
        .when(F.col("_score") < 70, "partial").otherwise("complete")
    )
    warnings = kept([
        (F.size(q("important")) > 0, F.concat(F.lit(WARN_MISSING), F.array_join(q("important"), ", "))),
        (q("validity") < 100, F.lit(WARN_VALIDITY)),
        (q("consistency") < 100, F.lit(WARN_CONSISTENCY)),
    ])
    return scored.withColumn("quality", F.struct(
        status.alias("status"), F.col("_score").cast("double").alias("quality_score"),
        q("completeness").cast("double").alias("completeness"), q("validity").cast("double").alias("validity"),
        q("consistency").cast("double").alias("consistency"), q("required").alias("missing_required_fields"),
        q("important").alias("missing_important_fields"), q("all").alias("missing_fields"),
        warnings.alias("warnings"),
    )).drop("_q", "_score")


def quality_summary(events: DataFrame) -> DataFrame:
    """Events and mean score per parser, format and status."""
    return events.groupBy("parser", "format", "quality_status").agg(
        F.count("*").alias("events"), F.avg("quality_score").alias("mean_score"),
    )
