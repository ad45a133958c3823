"""Hashes that show whether events were changed, removed or reordered."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from logsift.fixed import HASH_VERSION, PROTECTED_FIELDS
from logsift.operators.numbering import number_by_ranges, number_rows


def raw_hash(raw: Column) -> Column:
    """SHA-256 of the exact raw text."""
    return F.sha2(raw, 256)


def canonical_json(df: DataFrame) -> Column:
    """The protected fields as JSON: names in order, maps sorted by key, nulls written out."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def field(name: str) -> Column:
        if isinstance(types[name], T.MapType):
            return F.map_from_entries(F.sort_array(F.map_entries(F.col(name)))).alias(name)  # array_sort would call a lambda to compare
        return F.col(name)

    names = sorted(f for f in PROTECTED_FIELDS if f in types)
    return F.to_json(F.struct(*[field(n) for n in names]), {"ignoreNullFields": "false"})


def add_hashes(df: DataFrame) -> DataFrame:
    """Add raw_hash, integrity_hash, hash_version and normalized_hash. Score the event first."""
    return (
        df.withColumn("raw_hash", raw_hash(F.col("raw_event"))).withColumn("integrity_hash", F.col("raw_hash"))
        .withColumn("hash_version", F.lit(HASH_VERSION))
        .withColumn("normalized_hash", F.sha2(canonical_json(df), 256))
    )


def _fold(rows: pd.DataFrame) -> pd.DataFrame:
    """Chain one segment: each hash covers the previous hash and the raw text."""
    rows = rows.sort_values("chain_pos", kind="stable")
    start = rows["_start"].iloc[0] if "_start" in rows.columns else None
    previous, before, after = start if isinstance(start, str) else "", [], []
    for text in rows["_raw"]:
        before.append(previous or None)
        previous = hashlib.sha256((previous + text).encode("utf-8", "surrogatepass")).hexdigest()
        after.append(previous)
    return rows.drop(columns=[c for c in ("_raw", "_start") if c in rows.columns]).assign(previous_hash=before, chain_hash=after)


def chain_hash(df: DataFrame, keys: list[str], time: str, order: list[str], raw: str = "raw_event",
               segment_rows: int = 10_000, slab_seconds: int = 3600, start: DataFrame | None = None,
               by_ranges: bool = False) -> DataFrame:
    """Per row: its chain key columns, `order` columns, chain_pos, chain_segment, previous_hash, chain_hash.

    `start` is what `latest_chain_hash` gives for the stored events: each key then goes on at its next
    position, in its last segment from the last hash. Segments are part of the stored format: they go
    by position, so batches of any size make the same chain as one batch of all rows in their order.

    A chain is serial by nature, so a key's rows are cut by position into segments of at most
    `segment_rows`, each a chain of its own that starts from the empty hash; `seal_segments` then
    chains the segments. No task ever holds more than one segment, however many rows a key has. Rows are numbered by slabs of
    time; with `by_ranges` any number of them may have one key and one time.
    """
    kept = [c for c in dict.fromkeys([*keys, *order])]
    narrow = df.select(*kept, F.col(time).alias("_time"), F.col(raw).alias("_raw"))
    placed = number_by_ranges(narrow, keys, "_time", order, "chain_pos") if by_ranges else number_rows(narrow, keys, "_time", order, "chain_pos", slab_seconds)
    placed = placed.withColumn("_start", F.lit(None).cast("string"))
    if start is not None:
        known = start.select(*[F.col(k).alias(f"_s_{k}") for k in keys], F.col("next_pos").alias("_next"), F.col("latest_chain_hash").alias("_hash"))
        same = [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys]
        placed = placed.join(known, same, "left").withColumn("chain_pos", F.col("chain_pos") + F.coalesce("_next", F.lit(0)))
        goes_on = (F.floor(F.col("chain_pos") / segment_rows) == F.floor(F.col("_next") / segment_rows)) & (F.col("_next") % segment_rows > 0)
        placed = placed.withColumn("_start", F.when(goes_on, F.col("_hash"))).drop("_next", "_hash", *[f"_s_{k}" for k in keys])
    placed = placed.withColumn("chain_segment", F.floor(F.col("chain_pos") / segment_rows)).drop("_time")
    schema = T.StructType(
        [f for f in placed.schema.fields if f.name not in ("_raw", "_start")]
        + [T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())]
    )
    return placed.groupBy(*keys, "chain_segment").applyInPandas(_fold, schema)


def seal_segments(chained: DataFrame, keys: list[str], segment_rows: int = 10_000) -> DataFrame:
    """Chain the last hashes of the segments of each key, so that a lost segment shows."""
    heads = chained.groupBy(*keys, "chain_segment").agg(
        F.max_by("chain_hash", "chain_pos").alias("head"), F.count("*").alias("rows"),
    ).withColumnRenamed("chain_segment", "segment")
    parts = heads.withColumn("_raw", F.col("head")).withColumn("chain_pos", F.col("segment"))
    parts = parts.withColumn("seal_group", F.floor(F.col("segment") / segment_rows))
    schema = T.StructType(
        [f for f in parts.schema.fields if f.name != "_raw"]
        + [T.StructField("previous_hash", T.StringType()), T.StructField("chain_hash", T.StringType())]
    )
    sealed = parts.groupBy(*keys, "seal_group").applyInPandas(_fold, schema)
    return sealed.select(*keys, "segment", "rows", "head", "seal_group",
                         F.col("previous_hash").alias("previous_seal"), F.col("chain_hash").alias("seal"))


def latest_chain_hash(events: DataFrame, keys: list[str]) -> DataFrame:
    """The hash the next batch of each key continues from, and, where positions are stored, the position."""
    rows = events.filter("chain_hash IS NOT NULL").groupBy(*keys)
    if "chain_pos" in events.columns:
        return rows.agg(F.max_by("chain_hash", "chain_pos").alias("latest_chain_hash"), (F.max("chain_pos") + 1).alias("next_pos"))
    return rows.agg(F.max_by("chain_hash", F.struct("created_at", "event_id")).alias("latest_chain_hash"))


def verify_chain(chained: DataFrame, sealed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segment, rows, found, intact) for each segment of `seal_segments`: whether all its rows
    are there and its last hash is the sealed one. A lost row or tail shows as fewer rows, a lost
    segment as none."""
    there = chained.groupBy(*keys, F.col("chain_segment").alias("segment")).agg(
        F.count("*").alias("found"), F.max_by("chain_hash", "chain_pos").alias("last"))
    there = there.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("segment").alias("_segment"), "found", "last")
    same = [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in keys] + [F.col("segment") == F.col("_segment")]
    intact = (F.col("found") == F.col("rows")) & F.col("last").eqNullSafe(F.col("head"))
    return sealed.join(there, same, "left").select(*keys, "segment", "rows", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(intact, F.lit(False)).alias("intact"))


def verify(events: DataFrame) -> DataFrame:
    """Recompute the hashes of each stored event. Row-local, so it needs no shuffle.

    Events of version 1, or without a normalised hash, pass the normalised check.
    """
    chain = F.sha2(F.concat(F.coalesce(F.col("previous_hash"), F.lit("")), F.col("raw_event")), 256)
    version = F.coalesce(F.col("hash_version"), F.lit(1))
    covered = (version >= HASH_VERSION) & (F.coalesce(F.col("normalized_hash"), F.lit("")) != "")
    sure = lambda c: F.coalesce(c, F.lit(False))
    checks = events.select(
        "event_id", F.col("raw_hash").alias("integrity_hash"), "normalized_hash", version.alias("hash_version"),
        "previous_hash", "chain_hash",
        sure(raw_hash(F.col("raw_event")) == F.col("raw_hash")).alias("hash_verified"),
        F.when(covered, sure(F.sha2(canonical_json(events), 256) == F.col("normalized_hash")))
        .otherwise(F.lit(True)).alias("normalized_verified"),
        sure(chain == F.col("chain_hash")).alias("chain_verified"),
    )
    return checks.withColumn("tamper_detected", ~(
        F.col("hash_verified") & F.col("normalized_verified") & F.col("chain_verified")))


def verify_linkage(events: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each row's previous_hash is the chain_hash of the row before it in its segment.

    The window covers one segment, which is bounded, not one key.
    """
    segment = W.partitionBy(*keys, "chain_segment").orderBy("chain_pos")
    before = F.lag("chain_hash").over(segment)
    return events.withColumn("linked", F.col("previous_hash").eqNullSafe(before))
