"""Line deduplication by overlapping windows of three lines.

The consecutive lines of each text are hashed three by three to 128 bits; windows that occur more than once anywhere are
found by counting, and all but the first occurrence, by document id and then line, are removed: the positions that later
occurrences cover are merged, and the lines at them go. Windows are judged on the input.

Lines are what stands between line feeds, compared byte by byte. A text of fewer than three lines has no window and stays.
Null text stays null, with 0 lines; the empty text has one empty line. Rows of one id and equal text are one document:
neither is later than the other. Null ids come first. Extra columns stay; n_lines and n_removed replace columns of the names.

Counts are partial before the shuffle, and the repeated windows are stored, so that Spark can split the join back to all
windows: a window that a third of the documents share is no large task. What is gathered per document is no longer than the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.spans import line_spans, sequences, slices, span_hashes, text_bytes
from logsift.session import stored

WINDOW = 3


def line_windows(docs: DataFrame, id: str, text: str, size: int = WINDOW) -> DataFrame:
    """(w1, w2, id, hash of the text, pos): each window's 128 bits and first line, from 0."""
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), rows.schema["id"],
                           T.StructField("text_hash", T.LongType()), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = line_spans(data, offsets)
            w1, w2 = (sequences(span_hashes(data, starts, ends, lane), size, lane).view(np.int64) for lane in (0, 1))
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            pos = np.arange(len(starts)) - first[row]
            whole = np.flatnonzero(pos[:len(w1)] + size <= np.diff(first)[row[:len(w1)]])
            row = pa.array(row[whole])
            yield pa.RecordBatch.from_arrays([pa.array(w1[whole]), pa.array(w2[whole]), batch.column("id").take(row),
                                              batch.column("text_hash").take(row), pa.array(pos[whole].astype(np.int32))], schema.names)

    return rows.mapInArrow(run, schema)


def remove_repeated_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The documents with what is left of `text`, and n_lines and n_removed."""
    windows = line_windows(docs, id, text, size)
    place = F.struct("id", "pos", "text_hash")
    repeated = stored(windows.groupBy("w1", "w2").agg(F.count("*").alias("times"), F.min(place).alias("first")).where("times > 1"), "windows")
    later = windows.join(repeated, ["w1", "w2"]).where(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("id", "text_hash").agg(F.collect_set("pos").alias("__pos")).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "__pos")
    docs = docs.drop("n_lines", "n_removed")
    joined = docs.withColumn("__text_hash", F.xxhash64(text))
    joined = joined.join(covered, joined[id].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").drop("__id", "__hash", "__text_hash")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            texts, total, removed = batch.column(text).to_pylist(), [], []
            for i, (kept, at) in enumerate(zip(texts, batch.column("__pos"))):
                lines = [] if kept is None else kept.split("\n")
                stays = np.ones(len(lines), bool)
                if at.is_valid:
                    at = at.values.to_numpy(zero_copy_only=False)
                    for j in range(size):
                        stays[at + j] = False
                    texts[i] = "\n".join([line for line, s in zip(lines, stays.tolist()) if s])
                total.append(len(lines))
                removed.append(len(lines) - int(stays.sum()))
            kept = [pa.array(texts, pa.string()) if c == text else batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], schema.names)

    return joined.mapInArrow(run, schema)
