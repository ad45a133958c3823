"""Late events in a table, as a stream's watermark would find them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsift.operators.numbering import micros
from logsift.session import stored


def flag_late(events: DataFrame, delay_seconds: int, time: str = "event_ts", order: list[str] | None = None, batch: str | None = None) -> DataFrame:
    """Add `late`: whether an event's time is not after the watermark, the latest time of all that came before less the delay.

    What came before is told by `order`, row by row, or by `batch`, whose number grows: then exactly the rows are late that a stream
    of these micro-batches drops, which judges a batch by the watermark that the batch before it began with. Times are held to milliseconds where the watermark is made, as Spark does. An
    event without a time is never late and moves nothing; the first ones are never late.

    Two levels, so no task sees all rows: the rows are dealt out by ranges of the order, each range gives its latest time, and
    only these, a row for each range, are scanned in one go.
    """
    at = micros(F.col(time))
    if batch is not None:
        parts, inside = events.withColumn("_part", F.col(batch)), None
    else:
        ranged = events.repartitionByRange(*order)
        parts = stored(ranged.withColumn("_part", F.spark_partition_id()), "ranges")  # read twice; a range stays what it is
        inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ends = parts.groupBy("_part").agg(F.max(at).alias("_end"))
    scan = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1 if batch is None else -2)
    before = ends.select(F.col("_part").alias("_p"), F.max("_end").over(scan).alias("_before"))
    rows = parts.withColumn("_within", F.lit(None).cast("long") if inside is None else F.max(at).over(inside))
    rows = rows.join(before, F.col("_part") == F.col("_p"), "left")
    mark = F.floor(F.greatest("_before", "_within") / 1000) * 1000 - delay_seconds * 1_000_000
    return rows.select(*events.columns, F.coalesce(at <= mark, F.lit(False)).alias("late"))
