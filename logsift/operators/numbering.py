"""Positions within a key without ever sorting a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsift.session import stored


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def _key(keys: list[str]) -> Column:
    """The keys as a text that is never null, so that a null key is a key of its own in joins."""
    if len(keys) == 1:
        return F.coalesce(F.concat(F.lit("="), F.col(keys[0]).cast("string")), F.lit(""))
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def number_by_ranges(df: DataFrame, keys: list[str], time: str, order: list[str], out: str) -> DataFrame:
    """As `number_rows`, for any times: half of all rows may have one key and one moment.

    Spark deals the rows out by ranges of (key, time, order), which it cuts by a sample, so equal times are cut by the order. A
    row's place is read off its sorted range; the ranges' counts, a row for each range and key, give what comes before. The
    rows are stored in between, as they are read twice and must stay in their ranges; so this writes them once more than `number_rows`.
    """
    by = ["_key", time, *order]
    ranged = df.withColumn("_key", _key(keys)).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranged.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy("_key", "_range").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    earlier = W.partitionBy("_key").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = stored(counts.select("_key", "_range", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "offsets")
    return placed.join(offsets, ["_key", "_range"]).withColumn(
        out, (F.col("_before") + F.col("_row") - F.col("_first")).cast("bigint")).drop("_key", "_range", "_row", "_first", "_before")


def number_rows(df: DataFrame, keys: list[str], time: str, order: list[str], out: str,
                slab_seconds: int = 3600, part_rows: int = 100_000, part_chars: int = 6) -> DataFrame:
    """Add `out`: the 0-based position of a row within its key, by `time`, then `order`.

    Rows are sorted in (key, time slab) groups; the counts of the earlier slabs, which are
    aggregated before they are shuffled, give the offset. A key that holds a third of all rows is
    thus spread over as many tasks as it has slabs. Rows without a time come first; they are cut by
    the first of `order`: a whole number in steps of `part_rows`, a text by its first `part_chars`
    characters. `time` should be fine enough that one value has no large part of the rows; see
    `number_by_ranges` for rows stored at one moment.
    """
    width = slab_seconds * 1_000_000
    at = micros(F.col(time))
    kind = dict(df.dtypes)[order[0]] if order else None
    part = F.lit("")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        step = F.floor(F.col(order[0]) / part_rows)
        # As text in the order of the numbers: the sign, then 19 digits counted from the least.
        part = F.coalesce(F.concat(F.when(step < 0, "-").otherwise("0"), F.lpad(F.when(step < 0, step + F.lit(2**62)).otherwise(step).cast("string"), 19, "0")), F.lit(""))
    elif kind == "string":
        part = F.coalesce(F.substring(order[0], 1, part_chars), F.lit(""))
    rows = df.withColumn("_key", _key(keys)).withColumn("_slab", F.coalesce(F.floor(at / width), F.lit(-(2**62)))).withColumn("_part", F.when(at.isNull(), part).otherwise(""))
    counts = rows.groupBy("_key", "_slab", "_part").agg(F.count("*").alias("_n"))
    earlier = W.partitionBy("_key").orderBy("_slab", "_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_key", "_slab", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_key", "_slab", "_part").orderBy(time, *order)
    placed = rows.withColumn("_rank", F.row_number().over(inside))
    # The offsets table is far smaller than the rows, but grows with them: no broadcast hint.
    return placed.join(offsets, ["_key", "_slab", "_part"]).withColumn(
        out, (F.col("_before") + F.col("_rank") - 1).cast("bigint")).drop("_key", "_slab", "_part", "_before", "_rank")
