"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes are cut into m segments; an index has every distinct code once per segment, by the segment's value. In round r each
open query probes every segment at all values that differ from its own in exactly r bits, and keeps the nearest of what it
has met so far. A code at distance d differs in at most d / m bits in one of the segments, so after round r all codes up to
distance m (r + 1) - 1 have been met. A query is done when its kth verified neighbour lies within that distance. Segments
are best of about log2 of the number of codes: 16 bits for a million, 32 for billions.

Equal codes are one entry with their k + 1 smallest ids, which is all that a result ordered by distance and id can need; tasks
keep no more before the shuffle, so a code that a third of the rows share is small. A bucket of many codes is joined by a join
that Spark can split, and only codes as near as the query's kth so far leave it. Queries of one code are searched once.

Rows with null ids or null codes, or with other than `bits` components, are left out, as queries too. A component counts as a
set bit if it is over 0; null and NaN are not. Rows of equal id and code are one. A query is not its own neighbour. With
fewer than k other rows all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logsift.session import stored

PROBES = 1 << 18


def sign_codes(vectors: DataFrame, id: str, vector: str, bits: int) -> DataFrame:
    """(id, code): the signs of `bits` components as 64-bit words, component 0 in the lowest bit."""
    width = -(-bits // 64) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("v")
            own = np.flatnonzero(np.array([len(v.values) == bits if v.is_valid else False for v in column], bool)) if batch.num_rows else np.zeros(0, np.int64)
            take = pa.array(own)
            values = column.take(take).flatten().to_numpy(zero_copy_only=False).reshape(len(own), bits)
            signs = np.zeros((len(own), width), bool)
            signs[:, :bits] = values > 0
            words = np.packbits(signs, axis=1, bitorder="little").view("<i8")
            offsets = np.arange(len(own) + 1, dtype=np.int32) * (width // 64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.ravel()))], ["id", "code"])

    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, code array<long>")


def distance(a: str, b: str, words: int) -> Column:
    bits = F.lit(0)
    for w in range(words):
        bits = bits + F.bit_count(F.col(a)[w].bitwiseXOR(F.col(b)[w]))
    return bits


def _probes(open_: DataFrame, words: int, segment: int, radii: list[int]) -> DataFrame:
    """(q, ub, segment, value): each open code's segments with every choice of so many bits flipped."""
    masks = np.array([sum(1 << b for b in chosen) for radius in radii for chosen in combinations(range(segment), radius)], np.int64)
    segments = words * 64 // segment

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("q").flatten().to_numpy().reshape(batch.num_rows, words)
            pieces = np.ascontiguousarray(codes).view(f"<u{segment // 8}").astype(np.int64)  # lowest bits first
            each = segments * len(masks)
            step = max(1, PROBES // each)
            for i in range(0, len(pieces), step):
                some = pieces[i:i + step]
                take = pa.array(np.repeat(np.arange(i, i + len(some)), each))
                number = np.tile(np.repeat(np.arange(segments, dtype=np.int32), len(masks)), len(some))
                value = (some[:, :, None] ^ masks).ravel()
                yield pa.RecordBatch.from_arrays([batch.column("q").take(take), batch.column("ub").take(take), pa.array(number), pa.array(value)], ["q", "ub", "segment", "value"])

    return open_.select("q", "ub").mapInArrow(run, "q array<long>, ub int, segment int, value long")


def nearest(codes: DataFrame, queries: DataFrame, k: int, bits: int, segment: int = 16) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest of `codes` to each of `queries`, both (id, code), by distance and then id.
    `segment` is 8, 16 or 32 bits."""
    words = -(-bits // 64)
    segments = words * 64 // segment
    first_ids = Window.partitionBy("code").orderBy("id")
    members = codes.distinct().withColumn("nth", F.row_number().over(first_ids)).where(F.col("nth") <= k + 1)
    entries = stored(members.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")), "codes")
    pieces = [F.struct(F.lit(s).alias("segment"), F.shiftrightunsigned(F.col("code")[s * segment // 64], s * segment % 64).bitwiseAND((1 << segment) - 1).alias("value"))
              for s in range(segments)]
    index = stored(entries.select("code", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), F.explode(F.array(*pieces)).alias("p")).select("p.segment", "p.value", "code", "least", "n"), "segments")
    queries = stored(queries.distinct(), "queries")
    open_ = queries.select(F.col("code").alias("q")).distinct().withColumn("ub", F.lit(words * 64))
    best = Window.partitionBy("q").orderBy("distance", "least")
    upto = best.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found, done = None, []
    for radius in range(1, segment + 1):  # the first round has no flip and one
        apart = distance("q", "code", words)
        probes = _probes(open_, words, segment, [radius] if radius > 1 else [0, 1])
        # Probes look small to Spark, which knows only the size of the codes they are made of: without a hint it sends them to all tasks.
        met = probes.hint("merge").join(index, ["segment", "value"]).where(apart <= F.col("ub"))
        met = met.select("q", "code", "least", "n", apart.alias("distance"))
        if found is not None:
            met = met.unionByName(found)
        met = met.distinct().withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
        met = stored(met.withColumn("upto", F.sum("n").over(upto)).drop("nth"), "met")
        bound = met.groupBy("q").agg(F.min(F.when(F.col("upto") > k, F.col("distance"))).alias("kth"))
        covered = segments * (radius + 1) - 1
        open_ = open_.join(bound, "q", "left").select("q", F.coalesce("kth", "ub").alias("ub"), "kth")
        last = radius == segment
        rest = open_.where("false") if last else open_.where(F.col("kth").isNull() | (F.col("kth") > covered)).select("q", "ub")
        rest = stored(rest, "open")
        met = met.drop("upto")
        done.append(met.join(rest.select("q"), "q", "left_anti"))
        if last or rest.isEmpty():
            break
        open_, found = rest, met.join(rest.select("q"), "q")
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("q", "code", "distance").join(entries, "code").select("q", "distance", F.explode("ids").alias("id"))
    lists = rows.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k + 1).alias("near"))  # (k + 1) squared at most
    own = queries.select(F.col("id").alias("query_id"), F.col("code").alias("q")).join(lists, "q")
    own = own.withColumn("near", F.slice(F.expr("filter(near, x -> x.id <> query_id)"), 1, k))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", F.col("x.id").alias("id"), F.col("x.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))
