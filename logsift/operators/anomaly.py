"""Event-rate anomalies against the counts of the time buckets before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsift import fixed
from logsift.operators.numbering import micros


@dataclass(frozen=True)
class AnomalySettings:
    bucket_seconds: int = fixed.ANOMALY_BUCKET_SECONDS
    history: int = fixed.ANOMALY_HISTORY
    min_samples: int = fixed.ANOMALY_MIN_SAMPLES
    zscore: float = fixed.ANOMALY_ZSCORE
    splits: int = 100
    chunk: int = 10_000


def bucket_baseline(buckets: DataFrame, settings: AnomalySettings = AnomalySettings()) -> DataFrame:
    """Add `samples`, `mean`, `sd` of up to `history` earlier non-empty buckets to (bucket, n).

    Buckets are numbered through per-chunk counts and then handled in chunks that each also
    receive the last `history` buckets of the chunk before, so no window spans all of time.
    """
    span = settings.chunk
    near = buckets.withColumn("_span", F.floor(F.col("bucket") / span))
    sizes = near.groupBy("_span").agg(F.count("*").alias("_k"))
    # One row per `span` buckets of time: a thousand years of ten-second buckets is 316 000 rows.
    before = sizes.select("_span", F.coalesce(
        F.sum("_k").over(W.orderBy("_span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_span").orderBy("bucket")
    numbered = near.withColumn("_r", F.row_number().over(inside)).join(before, "_span").withColumn(
        "_i", F.col("_before") + F.col("_r") - 1)
    own = F.floor(F.col("_i") / span)
    late = F.pmod(F.col("_i"), F.lit(span)) >= span - settings.history
    copies = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    spread = numbered.withColumn("_own", own).withColumn("_chunk", F.explode(copies))
    frame = W.partitionBy("_chunk").orderBy("bucket").rowsBetween(-settings.history, -1)
    # Whole-number arithmetic: a flat baseline has a spread of exactly zero.
    n = F.col("n").cast("decimal(15,0)")
    sums = spread.select(
        "*", F.count("*").over(frame).alias("samples"), F.sum("n").over(frame).alias("_s"),
        F.sum(n * n).over(frame).alias("_ss"))
    total = F.col("_s").cast("decimal(17,0)")
    squares = F.col("samples").cast("decimal(5,0)") * F.col("_ss") - total * total
    count = F.nullif(F.col("samples"), F.lit(0)).cast("double")
    return sums.filter("_chunk = _own").select(
        "bucket", "n", "samples", (F.col("_s") / count).alias("mean"),
        F.sqrt(squares.cast("double") / (count * count)).alias("sd"),
    )


def rate_anomaly(events: DataFrame, settings: AnomalySettings = AnomalySettings(), time: str = "event_ts",
                 counted: DataFrame | None = None) -> DataFrame:
    """Add anomaly, anomaly_score and anomaly_reason to each event.

    `counted` may name a cheaper table with the same times to count the buckets on, for events that
    took much work to get: only its time column is read.

    An event is compared, as the n-th of its bucket so far, with the earlier buckets. A bucket is
    cut into `splits` parts of time; their counts, aggregated before the shuffle, give each part its
    starting number, so that a bucket with very many events is counted by many tasks.
    """
    width = settings.bucket_seconds * 1_000_000
    part_width = max(1, width // settings.splits)
    t = micros(F.col(time))
    bucket, part = F.floor(t / width).alias("bucket"), F.floor(t / part_width)
    rows = events.withColumn("_t", t).withColumn("bucket", bucket).withColumn(
        "part", F.coalesce(part, -1 - F.pmod(F.xxhash64("event_id"), F.lit(4096))))
    times = (events if counted is None else counted).filter(F.col(time).isNotNull())
    parts = times.groupBy(bucket, part.alias("part")).agg(F.count("*").alias("_n"))
    buckets = parts.groupBy("bucket").agg(F.sum("_n").alias("n"))
    earlier = W.partitionBy("bucket").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("bucket", "part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    known = offsets.join(bucket_baseline(buckets, settings).drop("n"), "bucket")
    inside = W.partitionBy("bucket", "part").orderBy("_t", "event_id")
    ranked = rows.withColumn("_r", F.row_number().over(inside)).join(known, ["bucket", "part"], "left")
    count = F.col("_before") + F.col("_r")
    scored = ranked.withColumn("_z", F.when(
        (F.col("samples") >= settings.min_samples) & (F.col("sd") > 0), (count - F.col("mean")) / F.col("sd")))
    return judged(scored, settings, "sd", "_z").select(*events.columns, "anomaly", "anomaly_score", "anomaly_reason")


def judged(scored: DataFrame, settings: AnomalySettings, sd: str, z: str) -> DataFrame:
    """Add anomaly, anomaly_score and anomaly_reason from bucket, samples, the spread and the z-score (null if there is none)."""
    hit = F.coalesce(F.col(z) >= settings.zscore, F.lit(False))
    score = F.bround(F.least(F.lit(1.0), F.lit(0.5) + (F.col(z) - settings.zscore) * F.lit(0.1)), 2)
    reason = (
        F.when(F.col("bucket").isNull(), F.lit(""))
        .when(F.col("samples") < settings.min_samples, fixed.REASON_NO_BASELINE)
        .when(F.col(sd) == 0, fixed.REASON_FLAT_BASELINE)
        .when(hit, F.format_string("Event rate is %.2f standard deviations above baseline", F.col(z)))
        .otherwise("")
    )
    return scored.select("*", hit.alias("anomaly"), F.when(hit, score).otherwise(0.0).alias("anomaly_score"), reason.alias("anomaly_reason"))
