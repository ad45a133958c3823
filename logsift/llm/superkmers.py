"""Substring deduplication: remove every word that lies in a window of 35 words whose sequence occurs elsewhere too.

A window's minimiser is the least hash of its runs of 8 words. Consecutive windows with the same minimiser form a super-k-mer
and travel as one packed string to the minimiser's bucket, where windows are sorted and counted. Equal windows have equal
minimisers, so no bucket needs another one.

1. Minimisers are counted. One that stands at a single place in all texts has no repeated window; those at two places or
   more are put in a bitmap of fixed size, which may only let too many pass.
2. Super-k-mers of these travel. Where a minimiser has over `hot` places, its bucket could grow without limit; its windows are
   counted one by one instead, by 128 bits and with partial sums, so that a passage in a third of all texts is no large task.
3. Repeated windows come back as ranges of words per document, and the covered words go.

Words are runs of characters other than space and \\t to \\r, unchanged. Windows are judged on the input and all occurrences
go, the first too. Rows of equal id and text are two documents, so all their windows are repeated. Null text has no words;
what is kept of it is the empty text. Extra columns stay; n_words, n_removed and kept replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.shared import bitmap, in_bitmap
from logsift.llm.spans import SLICE_BYTES, sequences, slices, span_hashes, text_bytes, word_spans
from logsift.session import stored

WINDOW, RUN, HOT = 35, 8, 256


def super_kmers(hashes: np.ndarray, first: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows, minimiser and number of the minimiser's places of each super-k-mer.

    `hashes` has the words of several texts, `first` the index of each text's first word (one more at the end).
    """
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    value = sequences(hashes, run)
    place = np.arange(len(value))
    width, size = window - run + 1, 1

    def least(shift: int) -> None:
        nonlocal value, place
        right = value[shift:] < value[:-shift]
        value, place = np.where(right, value[shift:], value[:-shift]), np.where(right, place[shift:], place[:-shift])

    while size * 2 <= width:
        least(size)
        size *= 2
    if size < width:
        least(width - size)
    whole = np.zeros(n + 1, np.int64)
    long = np.diff(first) >= window
    np.add.at(whole, first[:-1][long], 1)
    np.add.at(whole, first[1:][long] - window + 1, -1)
    whole = np.cumsum(whole)[:n] > 0
    begins, moves = whole.copy(), whole.copy()
    begins[1:] &= ~whole[:-1] | (value[1:] != value[:-1])
    moves[1:] &= begins[1:] | (place[1:] != place[:-1])
    ends = whole.copy()
    ends[:-1] &= ~whole[1:] | begins[1:]
    starts = np.flatnonzero(begins)
    places = np.add.reduceat(moves.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return starts, np.flatnonzero(ends) + 1 - starts, value[starts], places


def repeated(w1: np.ndarray, w2: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which windows, packed at `starts` to `ends` of `raw`, are there twice or more: sorted by their hashes, then compared as
    they are. Where equal hashes stand for different windows, the windows themselves are sorted."""
    order = np.lexsort((w2, w1))
    same = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
    left, right = order[:-1][same], order[1:][same]
    spans = zip(starts[left].tolist(), ends[left].tolist(), starts[right].tolist(), ends[right].tolist())
    if not all(raw[a:b] == raw[c:d] for a, b, c, d in spans):
        text = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        rank = {t: i for i, t in enumerate(sorted(set(text)))}
        w3 = np.array([rank[t] for t in text])
        order = np.argsort(w3, kind="stable")
        same = w3[order][1:] == w3[order][:-1]
        left, right = order[:-1][same], order[1:][same]
    again = np.zeros(len(w1), bool)
    again[left] = again[right] = True
    return again


def _rows(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def repeated_ranges(docs: DataFrame, id: str, text: str, window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """(id, text_hash, start, n): runs of n repeated windows from word `start` on."""
    rows = _rows(docs, id, text)
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            _, _, value, places = super_kmers(span_hashes(data, starts, ends), first, window, run)
            value, back = np.unique(value, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.bincount(back, places, len(value)).astype(np.int64))], ["mini", "places"])

    counted = rows.select("text").mapInArrow(count, "mini long, places long")
    several = stored(counted.groupBy("mini").agg(F.sum("places").alias("places")).where("places > 1"), "minimisers")
    shared = spark.sparkContext.broadcast((bitmap(several, "mini"), bitmap(several.where(F.col("places") > hot), "mini")))

    travel = T.StructType([T.StructField("mini", T.LongType()), rows.schema["id"], T.StructField("text_hash", T.LongType()),
                           T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           T.StructField("packed", T.BinaryType()), T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several, often = shared.value
        for batch in slices(batches, "text"):
            data, offsets = text_bytes(batch.column("text"))
            starts, ends, first = word_spans(data, offsets)
            hashes = span_hashes(data, starts, ends)
            at, n, value, _ = super_kmers(hashes, first, window, run)
            go = in_bitmap(several, value)
            at, n, value = at[go], n[go], value[go]
            alone = in_bitmap(often, value)
            row = np.searchsorted(first, at, side="right") - 1
            a, z = starts[at[~alone]], ends[at[~alone] + n[~alone] + window - 2]
            raw = data.tobytes()
            packed = [b" ".join(raw[i:j].split()) for i, j in zip(a.tolist(), z.tolist())]
            yield _travel(batch, travel, row[~alone], value[~alone], at[~alone] - first[row[~alone]], n[~alone], pa.array(packed, pa.binary()), None, None)
            if alone.any():
                each = np.repeat(np.flatnonzero(alone), n[alone])
                word = at[each] + np.arange(len(each)) - np.repeat(np.cumsum(n[alone]) - n[alone], n[alone])
                w1 = sequences(hashes, window)[word]
                w2 = sequences(span_hashes(data, starts, ends, 1), window, 1)[word]
                yield _travel(batch, travel, row[each], value[each], word - first[row[each]], np.ones(len(each), np.int64), None, w1, w2)

    moved = stored(rows.mapInArrow(send, travel), "superkmers")
    out = T.StructType([travel["id"], travel["text_hash"], travel["start"], travel["n"]])

    def sort_and_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, "mini"):
            data, offsets = text_bytes(table.column("packed"))
            starts, ends, first = word_spans(data, offsets)
            w1, w2 = (sequences(span_hashes(data, starts, ends, lane), window, lane) for lane in (0, 1))
            n = table.column("n").to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            word = first[row] + nth
            again = repeated(w1[word], w2[word], data.tobytes(), starts[word], ends[word + window - 1])
            begins = again.copy()
            begins[1:] &= ~again[:-1] | (row[1:] != row[:-1])
            stops = again.copy()
            stops[:-1] &= ~again[1:] | (row[1:] != row[:-1])
            b, e = np.flatnonzero(begins), np.flatnonzero(stops)
            take = pa.array(row[b])
            at = table.column("start").to_numpy()[row[b]] + nth[b]
            yield pa.RecordBatch.from_arrays([table.column("id").take(take), table.column("text_hash").take(take),
                                              pa.array(at.astype(np.int32)), pa.array((e - b + 1).astype(np.int32))], out.names)

    cold = moved.where("packed IS NOT NULL").select("mini", "id", "text_hash", "start", "n", "packed")
    cold = cold.repartition("mini").sortWithinPartitions("mini").mapInArrow(sort_and_count, out)
    often = moved.where("packed IS NULL").select("w1", "w2", "id", "text_hash", "start", "n")
    # Stored, so that Spark can split the join where one window has very many rows.
    twice = stored(often.groupBy("w1", "w2").agg(F.count("*").alias("times")).where("times > 1").select("w1", "w2"), "twice")
    return cold.unionByName(stored(often.join(twice, ["w1", "w2"]).select(*out.names), "windows"))


def _travel(batch, schema, row, value, start, n, packed, w1, w2) -> pa.RecordBatch:
    take = pa.array(row)
    number = lambda x, kind: pa.nulls(len(row), kind) if x is None else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x).cast(kind)
    return pa.RecordBatch.from_arrays([
        number(value, pa.int64()), batch.column("id").take(take), batch.column("text_hash").take(take), number(start, pa.int32()),
        number(n, pa.int32()), pa.nulls(len(row), pa.binary()) if packed is None else packed, number(w1, pa.int64()), number(w2, pa.int64())], schema.names)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Sorted batches put together so that no group of equal keys is cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "packed"):
        held.append(batch)
        size += batch.nbytes
        if size < limit:
            continue
        table = pa.concat_batches(held)
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        size = held[0].nbytes
    if held:
        yield pa.concat_batches(held)


def remove_repeated_windows(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, run: int = RUN, hot: int = HOT) -> DataFrame:
    """The documents with n_words, n_removed and kept, the words that stay joined by one space."""
    ranges = repeated_ranges(docs, id, text, window, run, hot).groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("__ranges"))
    ranges = ranges.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), "__ranges")
    docs = docs.drop("n_words", "n_removed", "kept")
    joined = docs.withColumn("__text_hash", F.xxhash64(text))
    joined = joined.join(ranges, joined[id].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left").drop("__id", "__hash", "__text_hash")
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            total, removed, kept = [], [], []
            for value, found in zip(batch.column(text).to_pylist(), batch.column("__ranges")):
                words = (value or "").encode().split()
                total.append(len(words))
                if found.is_valid:
                    start, n = (found.values.field(c).to_numpy().astype(np.int64) for c in ("start", "n"))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + window, -1)
                    stays = (np.cumsum(edge)[:-1] == 0).tolist()
                    words = [w for w, s in zip(words, stays) if s]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.binary()).cast(pa.string())], schema.names)

    return joined.mapInArrow(cut, schema)
