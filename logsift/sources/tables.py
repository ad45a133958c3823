"""The stored event and analytics tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.schema import ANALYTICS_SCHEMA, EVENT_SCHEMA


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The event table. Columns that older files lack are null; the hash version defaults to 1.

    Naming the schema spares reading every file's footer to merge them.
    """
    events = spark.read.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    return events.withColumn("hash_version", F.coalesce("hash_version", F.lit(1)))


def read_analytics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANALYTICS_SCHEMA).option("recursiveFileLookup", "true").parquet(path)


def spread(df: DataFrame, splits: int = 8) -> DataFrame:
    """A small table read as fewer tasks than there are cores is dealt out to all of them.

    Parsing is heavy per row, and a file of one row group is one task. A table of many files is left
    as it is, so no shuffle is added to a large job: at most `splits` splits of the reader are dealt
    out, 1 GB at the usual split size, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, splits) else df


def parts_of(df: DataFrame, part_bytes: int = 2 << 20) -> int:
    """How many tasks a table is dealt out to: one for each `part_bytes` of its files, and one for each core at least."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(size) // part_bytes))


def dealt(df: DataFrame, part_bytes: int = 2 << 20) -> DataFrame:
    """Rows that give many times their size, as logs do that are derived and parsed, dealt out evenly.

    How many splits the reader makes says nothing of that: a split holds all row groups that begin in it, or none. With as many
    tasks as the table has parts of `part_bytes`, the longest task stays as it is when the table grows.
    """
    return df.repartition(parts_of(df, part_bytes))
