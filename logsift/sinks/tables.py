"""Writing events, analytics and rejected logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.operators.combine import upsert_events
from logsift.schema import EVENT_SCHEMA
from logsift.session import stored

DAY = "event_date"
BLOCK_BYTES = 128 << 20


def dated(events: DataFrame) -> DataFrame:
    return events.withColumn(DAY, F.coalesce(F.to_date("event_ts"), F.to_date("created_at")))


def write_events(events: DataFrame, path: str, mode: str = "append", block_bytes: int = BLOCK_BYTES) -> None:
    """Parquet by event date. Rows are rebalanced by date: small dates share a task, a date with very
    many rows is split over several, so neither tiny files nor one huge task result.

    Within a date a file is ordered by source, and has Bloom filters of the two columns that events are
    looked up by: a search for one event or one source skips the row groups that can't have it.
    """
    _write(dated(events), path, mode, block_bytes)


def _write(rows: DataFrame, path: str, mode: str, block_bytes: int = BLOCK_BYTES, **options: str) -> None:
    ordered = rows.hint("rebalance", DAY).sortWithinPartitions(DAY, "source_ip", "event_id")
    writer = ordered.write.mode(mode).partitionBy(DAY).option("parquet.block.size", str(block_bytes))
    for column in ("event_id", "source_ip"):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.option("parquet.bloom.filter.adaptive.enabled", "true").options(**options).parquet(path)


def replace_events(events: DataFrame, path: str, order: list[str], key: str = "event_id") -> list:
    """Store the last version of each event: those of `events` replace stored ones of the same id, unless these are later.

    `order` names the columns that tell which version is last; at equal order the new one is. Only the dates that have
    an old or a new version of some event are written again, each one as a whole, and the dates' files change only when all
    of it is ready; all other files stay as they are. Writing the same events again changes no row, so a job can be
    repeated. The stored ids are found by reading two columns and the order. The driver gets the touched dates; they are returned.

    One writer at a time: two that touch one date must not run together.
    """
    spark = events.sparkSession
    rest = [f.name for f in EVENT_SCHEMA.fields if f.name in events.columns]
    latest = dated(upsert_events(events.select(*rest), order, key))
    if not table_exists(spark, path):
        _write(latest, path, "append")
        return sorted((r[0] for r in _stored_events(spark, path).select(DAY).distinct().collect()), key=str)
    fresh = stored(latest, "fresh")
    old = _stored_events(spark, path)
    when = F.struct(*[F.col(c) for c in order])
    there = old.select(F.col(key).alias("_key"), F.col(DAY).alias("_day"), when.alias("_when"))
    met = stored(fresh.select(key, when.alias("_new")).join(there, F.col(key) == F.col("_key")).select(
        key, "_day", (F.col("_when") > F.col("_new")).alias("later")), "met")
    winners, replaced = fresh, met
    if not met.where("later").isEmpty():
        outdated = met.where("later").select(key).distinct()
        winners, replaced = fresh.join(outdated, key, "left_anti"), met.join(outdated, key, "left_anti")
    gone = {r["_day"]: r["count"] for r in replaced.groupBy("_day").count().collect()}
    came = {r[0] for r in winners.select(DAY).distinct().collect()}
    touched = came | set(gone)
    # A date that keeps none of its stored rows is not read again.
    left = {r[DAY] for r in old.where(_on(touched)).groupBy(DAY).count().collect() if r["count"] > gone.get(r[DAY], 0)}
    kept = old.where(_on(left)).join(replaced.select(key), key, "left_anti")
    # Files of the dates that are read here change when the job is committed, after the last row was read.
    _write(kept.unionByName(winners, allowMissingColumns=True), path, "overwrite", partitionOverwriteMode="dynamic")
    for day in touched - came - left:  # all its events have another date now
        _delete(spark, f"{path}/{DAY}={'__HIVE_DEFAULT_PARTITION__' if day is None else day}")
    return sorted(touched, key=str)


def _on(days: set) -> Column:
    known = [d for d in days if d is not None]
    within = F.col(DAY).isin(known) if known else F.lit(False)
    return within | F.col(DAY).isNull() if None in days else within


def _stored_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField(DAY, T.DateType())])).parquet(path)


def table_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def write_analytics(analytics: DataFrame, path: str, mode: str = "append") -> None:
    dated = analytics.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", "event_date").write.mode(mode).partitionBy("event_date").parquet(path)


def dead_letters(rejected: DataFrame, attempts: int, time) -> DataFrame:
    """Rejected logs as (payload, error, dlq_timestamp)."""
    payload = F.struct(
        *[F.col(c).alias(c) for c in ("request_id",) if c in rejected.columns],
        F.col("raw_event").alias("log"), F.lit(attempts).alias("attempts"))
    return rejected.select(payload.alias("payload"), F.col("reject_reason").alias("error"), time.alias("dlq_timestamp"))


def write_dead_letters(rejected: DataFrame, path: str, attempts: int = 1, mode: str = "append") -> None:
    dead_letters(rejected, attempts, F.unix_micros(F.current_timestamp()) / 1e6).write.mode(mode).parquet(path)
