"""What several operators need: sets of hashes as bitmaps, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.session import stored

BITMAP_BITS = 26
_BLOCK = 16


def arrow_batches(spark: SparkSession) -> None:
    """Batches of a few MB between Spark and Python, so that tasks on long texts need little memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def bitmap(df: DataFrame, value: str, log2: int = BITMAP_BITS) -> np.ndarray:
    """The values of a column of hashes as a bitmap of 2^log2 bits, 8 MB by default, whatever the number of rows.

    Tasks make the bits of a block of slots each; the driver gets 2^(log2-3) bytes at most. A test never misses a value that
    is in, and may take another one for it, so it may only spare work that an exact step would throw away.
    """
    slot = F.col(value).bitwiseAND((1 << log2) - 1)
    slots = df.select(F.shiftright(slot, _BLOCK).cast("int").alias("block"), slot.bitwiseAND((1 << _BLOCK) - 1).cast("int").alias("bit")).distinct()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            block, bit = (batch.column(c).to_numpy() for c in ("block", "bit"))
            for b in np.unique(block):
                blocks.setdefault(int(b), np.zeros(1 << _BLOCK, bool))[bit[block == b]] = True
        for b, bits in blocks.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    out = np.zeros(1 << (log2 - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for row in slots.repartition(64, "block").mapInArrow(pack, "block int, bits binary").collect():
        out[row.block * size:(row.block + 1) * size] = np.frombuffer(row.bits, np.uint8)
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    slot = values.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of (a, b): component is the smallest node reachable.

    Every round sends each node to its smallest neighbour, follows these pointers to their ends, and goes on with the edges
    between the ends. Rounds grow with the logarithm of the nodes. A node with very many edges is a partial minimum and a
    join that can be split, never a list.
    """
    edges = stored(_undirected(edges, F.col("a"), F.col("b")), "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), "parents")
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
            jumped = stored(parent.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), "parents")
            parent = jumped.select("node", "parent")
            if jumped.where("moved").isEmpty():
                break
        levels.append(parent)
        ends = edges.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
        ends = ends.join(parent.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
        edges = stored(_undirected(ends, F.col("pa"), F.col("pb")), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1].select("node", F.col("parent").alias("component"))
    for parent in reversed(levels[:-1]):
        found = parent.join(found.select(F.col("node").alias("parent"), "component"), "parent", "left").select("node", F.coalesce("component", "parent").alias("component"))
    return found


def _undirected(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()
