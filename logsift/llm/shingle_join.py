"""N-gram Jaccard join by T-occurrence search (DivideSkip) on the distinct word shingles of documents.

A document's inverted lists are those of its shingles. A pair must share T = ceil(t / (1 + t) * (n + m)) of them. Each
document's longest lists are set aside, all but the first n - ceil(t * n) + 1 in a fixed order that puts shingles of many
documents last; the short lists are merged, and shared entries counted, by sorting them together, which merges spilled runs
through a heap. A pair whose count, with all that was set aside on
the side that has more, falls short of T is dropped. The others are probed: the long lists are read from the other
document's sorted shingles by binary search, and the overlap is exact.

1. Equal shingle sets are one node; from there on nodes are joined, so copies are never paired.
2. Shingles in the short lists are counted; those of over `frequent` documents go to the end of the order. Any set would do,
   it only has to be the same everywhere; it is bounded to `max_frequent` values, the most frequent ones, and broadcast.
3. Short lists are built in buckets of hashes. Tasks send packed numbers and name a node once. Lists up to `long` nodes
   give their pairs of fitting sizes, counted.
4. Longer lists give no pairs. Their nodes are compared with one node of the list; what links is one component. What is left
   are the pairs of one list and two components. The entries of long lists that each pair shares are counted, in blocks of
   nodes without their texts; pairs that fall short of T are dropped, as in 3. The node of the smaller component visits the
   blocks of texts that hold such a partner, and only these partners are probed. So a group of near copies costs its size and
   not the square, boilerplate that many documents share sends no text, and no link between components is lost.

Shingles and sets are known by 64-bit hashes. Null and empty texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle. Rows of equal id with other texts are joined through their id only in that component_id
is the smallest id of all linked rows. Null ids are ignored as component_id unless there is no other. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.shared import bitmap, components, in_bitmap
from logsift.llm.spans import mix, sequences, slices, span_hashes, text_bytes, word_spans
from logsift.session import discard, stored

WORDS, PERCENT = 5, 75
FREQUENT, MAX_FREQUENT, LONG = 32, 1 << 20, 64
FLUSH = 1 << 20
_SHORT_HASH = np.uint64(24)  # short lists are counted by the upper 40 bits


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Words are runs of other characters than space and \\t to \\r; A-Z count as a-z."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends, fold=True)
    runs, out = sequences(hashes, words), []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= words:
            found = np.sort(runs[a:z - words + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            out.append(mix(sequences(hashes[a:z], z - a, z - a)) if z > a else np.zeros(0, np.uint64))
    return out


def short_lists(n: int, percent: int) -> int:
    """How many lists of a set of n are not set aside."""
    return n - (percent * n + 99) // 100 + 1 if n else 0


def set_hash(found: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        odd = np.arange(1, 2 * len(found) + 1, 2, dtype=np.uint64)
        return int(mix(np.array([len(found)], np.uint64) + np.sum(mix(found + odd))).view(np.int64)[0])


def _pack(parts: list[np.ndarray], buckets: int, *, low: bool) -> Iterator[tuple[int, bytes]]:
    """Records sorted into buckets by the first field's upper bits."""
    records = np.concatenate(parts)
    key = records if low else records["h"]
    bucket = ((key >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(bucket)]):
        piece = records[a:z]
        yield int(bucket[a]), (np.sort(piece >> _SHORT_HASH).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() if low else piece.tobytes())


ENTRY = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<u4")])


def _describe(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Two kinds of rows, by `bucket`: null for (id, text_hash, node, n) of each document; else the packed shingles of short lists."""
    schema = T.StructType([docs.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("node", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("packed", T.BinaryType())])
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held, id_type = 0, None

        def flush():
            pairs = list(_pack(parts, buckets, low=True))
            parts.clear()
            k = len(pairs)
            return pa.RecordBatch.from_arrays([pa.nulls(k, id_type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                                               pa.array([b for b, _ in pairs], pa.int32()), pa.array([p for _, p in pairs], pa.binary())], schema.names)

        for batch in slices(batches, "text"):
            id_type = batch.schema.field("id").type
            sets = shingle_sets(batch.column("text"), words)
            nodes = [set_hash(s) for s in sets]
            k = len(nodes)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], schema.names)
            for node, found in zip(nodes, sets):
                if len(found) and node not in seen:
                    seen.add(node)
                    parts.append(found[:short_lists(len(found), percent)].copy())
                    held += len(parts[-1])
            if held >= FLUSH:
                yield flush()
                held = 0
        if held:
            yield flush()

    return docs.mapInArrow(run, schema)


def _frequent(packed: DataFrame, frequent: int, most: int) -> np.ndarray:
    """The upper 40 bits of the shingles that are in over `frequent` short lists; at most `most`, the most frequent."""
    def count(key: tuple, table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(values), 8), np.uint8)
        wide[:, :5] = values
        values, times = np.unique(wide.view(np.uint64).ravel(), return_counts=True)
        often = times > frequent
        return pa.table({"h": pa.array(values[often].view(np.int64)), "times": pa.array(times[often], pa.int64())})

    found = stored(packed.groupBy("bucket").applyInArrow(count, "h long, times long"), "frequent")
    return np.sort(np.array([r.h for r in found.orderBy(F.desc("times"), "h").limit(most).collect()], np.uint64))


def _lists(docs: DataFrame, words: int, percent: int, buckets: int, often: np.ndarray, long: int) -> DataFrame:
    """Pairs (x, nx, y, ny, c) of list entries, c times; and entries of long lists as (x, nx, y, ny, c null, h), y the list's first node."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        seen: set[int] = set()
        parts: list[np.ndarray] = []
        held = 0

        def flush():
            pairs = list(_pack(parts, buckets, low=False))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([b for b, _ in pairs], pa.int32()), pa.array([p for _, p in pairs], pa.binary())], ["bucket", "packed"])

        for batch in slices(batches, "text"):
            for found in shingle_sets(batch.column("text"), words):
                if not len(found) or (node := set_hash(found)) in seen:
                    continue
                seen.add(node)
                n = len(found)
                if len(often):
                    upper = found >> _SHORT_HASH
                    last = often[np.minimum(np.searchsorted(often, upper), len(often) - 1)] == upper
                    found = np.concatenate([found[~last], found[last]])
                entry = np.zeros(short_lists(n, percent), ENTRY)
                entry["h"], entry["node"], entry["n"] = found[:len(entry)], node, n
                parts.append(entry)
                held += len(entry)
            if held >= FLUSH // 2:
                yield flush()
                held = 0
        if held:
            yield flush()

    schema = "x long, nx long, y long, ny long, c long, h long"

    def join(key: tuple, table: pa.Table) -> pa.Table:
        entries = np.frombuffer(b"".join(table.column("packed").to_pylist()), ENTRY)
        entries = entries[np.lexsort((entries["node"], entries["h"]))]
        same = (entries["h"][1:] == entries["h"][:-1])
        entries = entries[np.concatenate(([True], ~(same & (entries["node"][1:] == entries["node"][:-1]))))]
        h, node, n = entries["h"], entries["node"], entries["n"].astype(np.int64)
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.concatenate((begin, [len(h)])))
        where = np.repeat(begin, length)
        size = np.repeat(length, length)
        # Entries of short lists are paired with the next one, the one after that, and so on, all lists at once.
        xs, ys = [], []
        at = np.flatnonzero((size > 1) & (size <= long))
        for step in range(1, long):
            at = at[at + step < where[at] + size[at]]
            if not len(at):
                break
            fits = np.minimum(n[at], n[at + step]) * 100 >= percent * np.maximum(n[at], n[at + step])
            xs.append(at[fits])
            ys.append(at[fits] + step)
        out = [np.zeros(0, np.int64)] * 5
        if xs and sum(map(len, xs)):
            x, y = np.concatenate(xs), np.concatenate(ys)
            order = np.lexsort((node[y], node[x]))
            x, y = x[order], y[order]
            new = np.flatnonzero(np.concatenate(([True], (node[x][1:] != node[x][:-1]) | (node[y][1:] != node[y][:-1]))))
            out = [node[x[new]], n[x[new]], node[y[new]], n[y[new]], np.diff(np.concatenate((new, [len(x)])))]
        far = np.flatnonzero(size > long)
        head = where[far]
        columns = [np.concatenate(z) for z in zip(out[:4], [node[far], n[far], node[head], n[head]])]
        c = pa.array(np.concatenate((out[4], np.zeros(len(far), np.int64))), mask=np.arange(len(columns[0])) >= len(out[4]))
        return pa.table([pa.array(z) for z in columns] + [c, pa.array(np.concatenate((np.zeros(len(out[4]), np.int64), h[far].view(np.int64))))], ["x", "nx", "y", "ny", "c", "h"])

    return docs.mapInArrow(send, "bucket int, packed binary").groupBy("bucket").applyInArrow(join, schema)


def _fits(nx: str, ny: str, percent: int) -> Column:
    return F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent


def _may_reach(nx: Column, ny: Column, shared: Column, percent: int) -> Column:
    """Whether the count on short lists, and all the lists set aside on the side that has more, reach T."""
    aside = F.floor((F.greatest(nx, ny) * percent + 99) / 100) - 1
    return shared + aside >= F.floor(((nx + ny) * percent + 99 + percent) / (100 + percent))


def probe(pairs: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, spread: int = 256) -> DataFrame:
    """The pairs (x, y) that link. `texts` has (node, text). A node with many pairs is dealt over several groups of `spread`."""
    degree = pairs.groupBy("x").agg(F.count("*").alias("degree"))
    pairs = pairs.join(degree, "x").withColumn("salt", F.pmod(F.xxhash64("y"), F.ceil(F.col("degree") / spread)).cast("int"))
    hubs = pairs.select("x", "salt").distinct().join(texts.withColumnRenamed("node", "x"), "x").select("x", "salt", F.lit(None).cast("long").alias("y"), "text")
    others = pairs.select("x", "salt", "y").join(texts.withColumnRenamed("node", "y"), "y").select("x", "salt", "y", "text")
    rows = hubs.unionByName(others).repartition("x", "salt").sortWithinPartitions("x", "salt", F.col("y").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, np.uint64)
        for batch in slices(batches, "text"):
            xs, ys, found = batch.column("x").to_pylist(), batch.column("y").to_pylist(), []
            for x, y, other in zip(xs, ys, shingle_sets(batch.column("text"), words)):
                if y is None:
                    hub, own = x, other
                elif x == hub:
                    small, large = (own, other) if len(own) < len(other) else (other, own)
                    if not len(small):
                        continue
                    at = np.searchsorted(large, small)
                    both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if both * 100 >= percent * (len(own) + len(other) - both):
                        found.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


class _Members:
    """Nodes of a block by the long lists they are in, for counting what a node shares with each of them."""

    def __init__(self, rows: list[tuple], percent: int) -> None:
        self.n, self.size, self.component = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        self.percent = percent
        lists = [r[3] for r in rows]
        h, owner = np.concatenate(lists), np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        order = np.argsort(h, kind="stable")
        h, self.owner = h[order], owner[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        self.h, self.cuts = h[first], np.append(first, len(h))

    def partners(self, n: int, size: int, component: int, lists: np.ndarray) -> np.ndarray:
        """The members of larger components that share a list with the node, and with all that was set aside may reach T."""
        at = np.minimum(np.searchsorted(self.h, lists), len(self.h) - 1)
        at = at[self.h[at] == lists].tolist()
        if not at:
            return np.zeros(0, np.int64)
        shared = np.bincount(np.concatenate([self.owner[self.cuts[i]:self.cuts[i + 1]] for i in at]), minlength=len(self.n))
        some = np.flatnonzero((shared > 0) & ((self.size > size) | ((self.size == size) & (self.component > component))))
        m, p = self.n[some], self.percent
        less, more = np.minimum(m, n), np.maximum(m, n)
        reach = shared[some] + (more * p + 99) // 100 - 1 >= ((m + n) * p + 99 + p) // (100 + p)
        return some[reach & (less * 100 >= more * p)]


_NODE = ["node", "n", "size", "component", "lists"]


def _rows(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    """The values of each row, lists as arrays."""
    columns = [batch.column(c) for c in names]
    return zip(*[(x.values.to_numpy() for x in c) if pa.types.is_list(c.type) else c.to_pylist() for c in columns])


def candidate_blocks(nodes: DataFrame, percent: int = PERCENT, many: int = 8192) -> DataFrame:
    """(node, block): the blocks of texts in which a node has a partner to be probed.

    `nodes` is (node, n, size, component, lists, block). Counting needs no texts, so its blocks hold about `many` nodes, and each is
    met by the nodes in shares of half as many.
    """
    count = nodes.count()
    blocks, shares = -(-count // many) or 1, -(-2 * count // many) or 1
    home, share = F.pmod(F.xxhash64("block", F.lit("home")), F.lit(blocks)).cast("int"), F.pmod(F.xxhash64("node", F.lit("share")), F.lit(shares)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    held = nodes.withColumn("role", F.lit(0)).withColumn("home", home).withColumn("share", every(shares))
    asked = nodes.withColumn("role", F.lit(1)).withColumn("share", share).withColumn("home", every(blocks))
    rows = held.unionByName(asked).repartition(2 * blocks * shares, "home", "share").sortWithinPartitions("home", "share", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, found = None, [], []
        members = block = None

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["node", "block"])
            found.clear()
            return out

        for batch in batches:
            for *key, role, number, node, n, size, component, lists in _rows(batch, ["home", "share", "role", "block", *_NODE]):
                if key != at:
                    at, held, members, block = key, [], None, []
                if not role:
                    held.append((n, size, component, lists))
                    block.append(number)
                elif held:
                    if members is None:
                        members, block = _Members(held, percent), np.array(block, np.int64)
                    found += [(node, b) for b in np.unique(block[members.partners(n, size, component, lists)]).tolist()]
            yield flush()

    return rows.mapInArrow(run, "node long, block long")


def probe_blocks(nodes: DataFrame, asked: DataFrame, texts: DataFrame, words: int = WORDS, percent: int = PERCENT, many: int = 2048) -> DataFrame:
    """Links (a, b) between components, found by probing each node of `asked` (node, block) with its partners in that block of `nodes`.

    The nodes that visit a block come in shares of `many`. A component that a node links to is not tried again in a block.
    """
    visits = stored(asked.groupBy("block").agg(F.ceil(F.count("*") / many).cast("int").alias("shares")), "visits")
    held = nodes.join(visits, "block").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("role", F.lit(0))
    guests = asked.join(visits, "block").join(nodes.drop("block"), "node").withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")).withColumn("role", F.lit(1))
    rows = held.unionByName(guests).join(texts, "node").select("block", "share", "role", *_NODE, "text")
    # A number of tasks is named, as time goes with the pairs and not with the bytes that Spark would join partitions by.
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, "block", "share").sortWithinPartitions("block", "share", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sets, members = None, [], [], None
        for batch in slices(batches, "text"):
            found: list[tuple[int, int]] = []
            for own, (*key, role, n, size, component, lists) in zip(shingle_sets(batch.column("text"), words), _rows(batch, ["block", "share", "role", *_NODE[1:]])):
                if key != at:
                    at, held, sets, members = key, [], [], None
                if not role:
                    held.append((n, size, component, lists))
                    sets.append(own)
                elif held:
                    members = members or _Members(held, percent)
                    found += [(component, c) for c in _linked(own, members, sets, members.partners(n, size, component, lists), percent)]
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _linked(own: np.ndarray, members: _Members, sets: list[np.ndarray], partners: np.ndarray, percent: int, step: int = 128) -> list[int]:
    """The components of those partners that link; once one does, the others of its component are not probed."""
    out: list[int] = []
    while len(partners):
        some, partners = partners[:step], partners[step:]
        sizes = members.n[some]
        joined = np.concatenate([sets[i] for i in some.tolist()])
        place = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        both = np.bincount(np.repeat(np.arange(len(some)), sizes), own[place] == joined, len(some)).astype(np.int64)
        close = np.unique(members.component[some[both * 100 >= percent * (sizes + len(own) - both)]])
        if len(close):
            out += close.tolist()
            partners = partners[~np.isin(members.component[partners], close)]
    return out


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                       frequent: int = FREQUENT, long: int = LONG, max_frequent: int = MAX_FREQUENT) -> DataFrame:
    """The documents with n_shingles and component_id, the smallest id reachable by links."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    buckets = max(256, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    described = stored(_describe(rows, words, percent, buckets), "shingles")
    often = _frequent(described.where("bucket IS NOT NULL").select("bucket", "packed"), frequent, max_frequent)
    described_docs = stored(described.where("bucket IS NULL").select("id", "text_hash", "node", "n"), "described")
    discard(described)
    lists = stored(_lists(rows, words, percent, buckets, often, long), "lists")

    short = lists.where("c IS NOT NULL")
    far = lists.where("c IS NULL").select(F.col("x").alias("node"), F.col("nx").alias("n"), F.col("y").alias("head"), F.col("ny").alias("hn"), "h")
    slack = far.groupBy("node").agg(F.count("*").alias("slack"))
    counted = short.groupBy("x", "y").agg(F.first("nx").alias("nx"), F.first("ny").alias("ny"), F.sum("c").alias("c"))
    counted = stored(counted, "pairs")
    loose = counted.join(slack.select(F.col("node").alias("x"), F.col("slack").alias("sx")), "x", "left").join(slack.select(F.col("node").alias("y"), F.col("slack").alias("sy")), "y", "left")
    more = F.least(F.coalesce("sx", F.lit(0)), F.coalesce("sy", F.lit(0)))
    first = loose.where(_may_reach(F.col("nx"), F.col("ny"), F.col("c") + more, percent)).select("x", "y")
    star = far.where((F.col("node") != F.col("head")) & _fits("n", "hn", percent)).select(F.least("node", "head").alias("x"), F.greatest("node", "head").alias("y"))
    first = stored(first.unionByName(star).distinct(), "pairs")
    far = stored(far.groupBy("node", "n").agg(F.sort_array(F.collect_list("h")).alias("lists")), "far")
    discard(counted, lists)

    # Texts of the nodes that may be probed: one per node.
    ends = first.select("x").unionByName(first.select(F.col("y").alias("x"))).select(F.col("x").alias("node"), F.lit(False).alias("far"))
    wanted = ends.unionByName(far.select("node", F.lit(True).alias("far"))).groupBy("node").agg(F.max("far").alias("far"))
    single = stored(described_docs.groupBy("node").agg(F.min("text_hash").alias("text_hash")).join(wanted, "node"), "wanted")
    bits = spark.sparkContext.broadcast(bitmap(single, "text_hash"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column("text_hash").to_numpy()
            keep = in_bitmap(bits.value, hashes)
            for i in np.flatnonzero(keep).tolist():
                keep[i] = int(hashes[i]) not in seen
                seen.add(int(hashes[i]))
            yield batch.filter(pa.array(keep))

    picked = rows.where(F.col("text").isNotNull()).select("text_hash", "text").mapInArrow(pick, "text_hash long, text string")
    texts = stored(picked.join(single, "text_hash").groupBy("node").agg(F.first("text").alias("text"), F.first("far").alias("far")), "texts")

    known = components(stored(probe(first, texts.drop("far"), words, percent), "links"))
    discard(first, single)
    joined = described_docs.join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not far.isEmpty():
        # Pairs of one long list and two components. Both ends of such a pair are compared here once, so there is nothing left after it.
        placed = stored(far.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed")
        sized = placed.join(placed.groupBy("component").agg(F.count("*").alias("size")), "component")
        # A block of texts: nodes that begin with the same list, cut into blocks of about 1,024 nodes and a million shingles.
        begins = F.col("lists")[0].alias("begin")
        cut = placed.groupBy(begins).agg(F.greatest(F.ceil(F.count("*") / 1024), F.ceil(F.sum("n") / (1 << 20))).alias("blocks"))
        block = F.xxhash64("begin", F.pmod(F.xxhash64("node"), F.col("blocks")))
        nodes = stored(sized.withColumn("begin", begins).join(cut, "begin").withColumn("block", block).select(*_NODE, "block"), "nodes")
        asked = stored(candidate_blocks(nodes, percent), "asked")
        found = stored(probe_blocks(nodes, asked, texts.where("far").drop("far"), words, percent), "links")
        discard(placed, nodes, asked)
        if not found.isEmpty():
            merged = components(found).select(F.col("node").alias("component"), F.col("component").alias("__merged"))
            joined = joined.join(merged, "component", "left").withColumn("component", F.coalesce("__merged", "component")).drop("__merged")
    joined = joined.withColumn("component", F.when(F.col("n") > 0, F.col("component")))
    # Both stored, so that Spark can split the join where one component has very many documents.
    joined = stored(joined, "joined")
    discard(described_docs, texts, far)
    smallest = stored(joined.where("n > 0").groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    answer = joined.join(smallest, "component", "left").select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("n").alias("n_shingles"),
                                                              F.coalesce("component_id", "id").alias("component_id"))
    if {id, text} >= set(docs.columns):
        return answer.select(F.col("__id").alias(id), "n_shingles", "component_id")
    docs = docs.drop("n_shingles", "component_id").withColumn("__text_hash", F.xxhash64(text))
    answer = answer.dropDuplicates(["__id", "__hash"])
    return docs.join(answer, docs[id].eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash"))).drop("__id", "__hash", "__text_hash")
