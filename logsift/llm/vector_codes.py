"""Product quantisation of vectors: exact Lloyd rounds over metric trees of the vectors' parts.

A vector becomes whole numbers floor(scale * x) and is cut into equal consecutive parts; each part position has a codebook.

1. Tasks cut their rows into blocks and build, for each block and part position, a metric tree by the anchors hierarchy: about
   sqrt(n) anchors take their points from each other, trying only points that the triangle inequality leaves open; each anchor's
   points are treated the same way down to leaves, and the anchors are merged upwards, always the two whose common ball is
   smallest. Every ball keeps the sum and the number of its points. The trees are stored once and read in every round.
2. A round walks the trees level by level with a list of entries for each ball, inherited by its halves. An entry leaves the
   list if another one is nearer to every point of the ball. A ball with one entry left is wholly owned: its sum and number
   are added, and its points are not looked at. Leaves that stay undecided are compared point by point in whole numbers, ties
   to the lower index. Float arithmetic only decides what is clear by a margin, so the result is that of comparing everything.
3. Tasks add up what their blocks give to each entry; the driver gets one row per entry and component, whatever the rows.

Blocks bound memory, and copies are a ball of radius 0, so a vector with a third of all rows is cheap. The sum of errors by label
is aggregated, stored and joined back, so that Spark can split a label with very many rows.

Rows whose vector is null or empty, holds null or non-finite components, or has another length than the vector of the smallest
id, are dropped. Null ids come last. Rows of equal ids count as several vectors, by the vector where they are among the first.
With fewer rows than entries the codebooks are smaller. Parts of a length that can't be divided are the first ones one longer.
Components so large that squared distances would not fit in 64 bits (beyond 32,768 for 64 components) are held at that bound;
a sum of errors beyond 64 bits is null. An empty table gives no rows. Extra columns stay, the vector goes; code, error,
label_error and codebooks_sha256 replace columns of these names.
"""

from __future__ import annotations

import hashlib
import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.session import stored

PARTS, ENTRIES, ROUNDS, SCALE, BLOCK, LEAF = 8, 16, 6, 4096, 4096, 24


@dataclass(frozen=True)
class Tree:
    """Points in the order of the leaves, where each stood before, and by ball: halves (-1 in a leaf), range, sum and radius."""

    points: np.ndarray
    order: np.ndarray
    halves: np.ndarray
    ranges: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    def write(self, to: io.BytesIO) -> None:
        for a in (self.points, self.order, self.halves, self.ranges, self.sums, self.radius):
            np.save(to, a, allow_pickle=False)

    @staticmethod
    def read(source: io.BytesIO) -> Tree:
        return Tree(*[np.load(source, allow_pickle=False) for _ in range(6)])


def find_anchors(x: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """The anchor of each point, and how many anchors there are: at most k, fewer if all points lie on anchors."""
    d = np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    pivots, owner = [0], np.zeros(len(x), np.int64)
    while len(pivots) < k:
        new = int(d.argmax())
        if d[new] == 0:
            break
        # A point is nearer to the new anchor only if it is further from its own than half the way between the two.
        way = np.sqrt(((x[pivots] - x[new]) ** 2).sum(axis=1))
        open_ = np.flatnonzero(d * 2 >= way[owner])
        there = np.sqrt(((x[open_] - x[new]) ** 2).sum(axis=1))
        won = there < d[open_]
        owner[open_[won]], d[open_[won]] = len(pivots), there[won]
        pivots.append(new)
    return owner, len(pivots)


def build_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The metric tree of whole-number points (n x width), n at least 1."""
    x = points.astype(np.float64)
    halves: list[tuple[int, int]] = []
    leaves: dict[int, np.ndarray] = {}
    balls: list[tuple[np.ndarray, float, int]] = []  # centre, radius, number, while the tree grows

    def add(pair: tuple[int, int], centre: np.ndarray, radius: float, n: int) -> int:
        halves.append(pair)
        balls.append((centre, radius, n))
        return len(halves) - 1

    def grow(at: np.ndarray) -> int:
        own = x[at]
        centre = own.mean(axis=0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(axis=1).max()))
        owner, k = (np.zeros(len(at), np.int64), 1) if len(at) <= leaf else find_anchors(own, math.isqrt(len(at) - 1) + 1)
        if k == 1:
            node = add((-1, -1), centre, radius, len(at))
            leaves[node] = at
            return node
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(k + 1))
        return merge([grow(at[order[a:z]]) for a, z in zip(cuts[:-1], cuts[1:]) if z > a])

    def merge(nodes: list[int]) -> int:
        centre = np.array([balls[i][0] for i in nodes])
        radius, n = np.array([balls[i][1] for i in nodes]), np.array([balls[i][2] for i in nodes], np.float64)

        def common(i: int) -> np.ndarray:
            """Radius of a ball around the common mean that holds the ball i and each other one."""
            apart = np.sqrt(((centre - centre[i]) ** 2).sum(axis=1))
            return np.maximum(apart * n / (n + n[i]) + radius[i], apart * n[i] / (n + n[i]) + radius)

        cost = np.array([common(i) for i in range(len(nodes))])
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(nodes) - 1):
            i, j = divmod(int(cost.argmin()), len(nodes))
            radius[i] = cost[i, j]
            centre[i] = (centre[i] * n[i] + centre[j] * n[j]) / (n[i] + n[j])
            n[i] += n[j]
            nodes[i] = add((nodes[i], nodes[j]), centre[i].copy(), radius[i], int(n[i]))
            gone = np.isinf(cost[i]) & (np.arange(len(nodes)) != i)
            cost[i] = cost[:, i] = np.where(gone, np.inf, common(i))
            cost[j] = cost[:, j] = cost[i, i] = np.inf
        return nodes[i] if len(nodes) > 1 else nodes[0]

    root = grow(np.arange(len(x)))
    ranges, order, done, todo = np.zeros((len(halves), 2), np.int32), [], 0, [(root, False)]
    while todo:
        node, left = todo.pop()
        if node in leaves:
            ranges[node] = done, done + len(leaves[node])
            order.append(leaves[node])
            done += len(leaves[node])
        elif left:
            ranges[node] = ranges[halves[node][0], 0], done
        else:
            todo += [(node, True), (halves[node][1], False), (halves[node][0], False)]
    order = np.concatenate(order)
    points = points[order]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    sums = total[ranges[:, 1]] - total[ranges[:, 0]]
    radius = np.zeros(len(halves))
    for i, (a, z) in enumerate(ranges.tolist()):
        radius[i] = math.sqrt(((points[a:z] - sums[i] / (z - a)) ** 2).sum(axis=1).max()) if points.shape[1] else 0.0
    turn = np.array([root, *[i for i in range(len(halves)) if i != root]])  # the root first
    place = np.empty(len(turn), np.int32)
    place[turn] = np.arange(len(turn))
    pairs = np.array(halves, np.int32)[turn]
    return Tree(points, order.astype(np.int32), np.where(pairs < 0, -1, place[pairs]), ranges[turn], sums[turn], radius[turn])


def nearest(points: np.ndarray, entries: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
    """The nearest entry of each point by squared distance in whole numbers, ties to the lower index."""
    apart = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return (apart if alive is None else np.where(alive, apart, np.iinfo(np.int64).max)).argmin(axis=1)


def walk(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """First the wholly owned balls as (balls, their entries, None), level by level, then undecided points as (positions, entries, points)."""
    e = entries.astype(np.float64)
    between = np.sqrt(((e[:, None] - e[None]) ** 2).sum(axis=2))
    _, first = np.unique(entries, axis=0, return_index=True) if entries.shape[1] else (None, np.zeros(1, np.int64))
    alive = np.zeros((1, len(e)), bool)
    alive[0, first] = True  # an entry equal to an earlier one never wins
    balls = np.zeros(1, np.int64)
    while len(balls):
        n = np.diff(tree.ranges[balls], axis=1)
        centre, r = tree.sums[balls] / n, tree.radius[balls]
        apart = np.where(alive, ((centre[:, None] - e[None]) ** 2).sum(axis=2), np.inf)
        best = apart.argmin(axis=1)
        own = apart[np.arange(len(balls)), best][:, None]
        size = (centre ** 2).sum(axis=1)[:, None] + (e ** 2).sum(axis=1)[None] + r[:, None] ** 2 + 1
        # The difference of the squared distances to two entries is linear: over the ball it grows by 2 r times their distance.
        alive &= own - np.where(alive, apart, 0) + 2 * r[:, None] * between[best] >= -1e-9 * size
        alive[np.arange(len(balls)), best] = True
        sole = alive.sum(axis=1) == 1
        if sole.any():
            yield balls[sole], best[sole], None
        balls, alive = balls[~sole], alive[~sole]
        ends = tree.halves[balls, 0] < 0
        if ends.any():
            a, z = tree.ranges[balls[ends]].T.astype(np.int64)
            at = np.repeat(a - np.concatenate(([0], np.cumsum(z - a)[:-1])), z - a) + np.arange(int((z - a).sum()))
            yield at, nearest(tree.points[at], entries, np.repeat(alive[ends], z - a, axis=0)), tree.points[at]
        balls, alive = tree.halves[balls[~ends]].astype(np.int64).ravel(), np.repeat(alive[~ends], 2, axis=0)


def add_up(tree: Tree, entries: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add the sum and number of the points that each entry is nearest to."""
    for at, owner, points in walk(tree, entries):
        np.add.at(sums, owner, tree.sums[at] if points is None else points)
        np.add.at(counts, owner, np.diff(tree.ranges[at], axis=1)[:, 0] if points is None else 1)


def codes_of(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of each point and its squared distance, in the order the points had before."""
    code = np.zeros(len(tree.points), np.int64)
    for at, owner, points in walk(tree, entries):
        if points is None:
            for (a, z), c in zip(tree.ranges[at].tolist(), owner.tolist()):
                code[a:z] = c
        else:
            code[at] = owner
    error = ((tree.points - entries[code]) ** 2).sum(axis=1)
    codes, errors = np.empty_like(code), np.empty_like(error)
    codes[tree.order], errors[tree.order] = code, error
    return codes, errors


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), held where squared distances of whole vectors fit in 64 bits."""
    bound = math.isqrt((1 << 62) // max(1, values.shape[-1])) // 2
    return np.clip(np.floor(values.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def cut_points(d: int, parts: int) -> list[int]:
    """Where the parts begin, and the end."""
    return [i * (d // parts) + min(i, d % parts) for i in range(parts + 1)]


def usable(df: DataFrame, vector: str) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(vector) > 0) & ~bad)


@dataclass(frozen=True)
class Codes:
    """`rows` with code, error, label_error and codebooks_sha256, and the codebooks: entries x width whole numbers for each part."""

    rows: DataFrame
    codebooks: list[np.ndarray]


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS, scale: int = SCALE, block: int = BLOCK, leaf: int = LEAF) -> Codes:
    """Learn the codebooks from all rows and encode all rows."""
    spark = df.sparkSession
    df = df.drop(*[c for c in ("code", "error", "label_error", "codebooks_sha256") if c not in (id, vector, label)])
    good = usable(df, vector)
    first = [list(r[0]) for r in good.orderBy(F.col(id).asc_nulls_last(), vector).select(vector).limit(entries).collect()]
    d = len(first[0]) if first else parts
    cuts = cut_points(d, parts)
    start = whole_numbers(np.array([v for v in first if len(v) == d] or np.zeros((1, d))), scale)
    books = [start[:, a:z].copy() for a, z in zip(cuts[:-1], cuts[1:])]
    kept = [f for f in df.schema.fields if f.name != vector]
    blocks = stored(_blocks(good.where(F.size(vector) == d), vector, kept, d, cuts, scale, block, leaf), "trees")

    for _ in range(rounds):
        for part, entry, n, sums in _sums(blocks, books):
            books[part][entry] = [s // n for s in sums]
    names = T.StructType([*kept, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    scored = stored(_encode(blocks, books, names), "codes")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    by_label = stored(scored.groupBy(F.col(label).alias("__label")).agg(total.alias("t")).select("__label", F.expr("try_cast(t AS bigint)").alias("label_error")), "errors")
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b.tolist() for x in e).encode()).hexdigest()
    rows = scored.join(by_label, scored[label].eqNullSafe(by_label["__label"]), "left").drop("__label")
    return Codes(rows.withColumn("codebooks_sha256", F.lit(digest)), books)


def decode(codes: np.ndarray, codebooks: list[np.ndarray], scale: int = SCALE) -> np.ndarray:
    """The vectors that rows of entry numbers (n x parts) stand for."""
    return np.concatenate([b[codes[:, i]] for i, b in enumerate(codebooks)], axis=1) / scale


def _blocks(df: DataFrame, vector: str, kept: list, d: int, cuts: list[int], scale: int, block: int, leaf: int) -> DataFrame:
    """A row for each block: its rows without the vector, and the trees of the part positions."""
    schema = T.StructType([T.StructField("rows", T.ArrayType(T.StructType(kept))), T.StructField("trees", T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(batch: pa.RecordBatch) -> pa.RecordBatch:
            values = batch.column(vector).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x, out = whole_numbers(values, scale), io.BytesIO()
            for a, z in zip(cuts[:-1], cuts[1:]):
                build_tree(x[:, a:z], leaf).write(out)
            rows = pa.StructArray.from_arrays([batch.column(c) for c in names], names)
            rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([rows, pa.array([out.getvalue()], pa.binary())], ["rows", "trees"])

        for batch in batches:
            held.append(batch)
            while (n := sum(b.num_rows for b in held)) >= block:
                joined = pa.concat_batches(held)
                yield flush(joined.slice(0, block))
                held = [joined.slice(block)] if n > block else []
        if held and (joined := pa.concat_batches(held)).num_rows:
            yield flush(joined)

    return df.select(*names, vector).mapInArrow(run, schema)


def _sums(blocks: DataFrame, books: list[np.ndarray]) -> list[tuple[int, int, int, list[int]]]:
    """(part, entry, number, sums of components) of the entries that some point is nearest to."""
    shared = blocks.sparkSession.sparkContext.broadcast(books)  # entries x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for blob in batch.column("trees"):
                source = io.BytesIO(blob.as_py())
                for p, book in enumerate(books):
                    add_up(Tree.read(source), book, sums[p], counts[p])
        found = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p]).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([e for _, e in found], pa.int32()),
                                          pa.array([int(counts[p][e]) for p, e in found], pa.int64()),
                                          pa.array([sums[p][e].tolist() for p, e in found], pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    each = blocks.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = each.select("part", "entry", "n", F.posexplode_outer("sums").alias("at", "sum"))
    rows = each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum")).collect()
    out: dict[tuple[int, int], tuple[int, dict]] = {}
    for r in rows:
        out.setdefault((r.part, r.entry), (r.n, {}))[1][r.at] = r["sum"]
    return [(p, e, n, [by[i] for i in sorted(k for k in by if k is not None)]) for (p, e), (n, by) in out.items()]


def _encode(blocks: DataFrame, books: list[np.ndarray], schema: T.StructType) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, blob in zip(batch.column("rows"), batch.column("trees")):
                source, codes, error = io.BytesIO(blob.as_py()), [], 0
                for book in shared.value:
                    code, far = codes_of(Tree.read(source), book)
                    codes.append(code)
                    error = error + far
                text = [bytes(c).hex() for c in np.stack(codes, axis=1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([*rows.values.flatten(), pa.array(text), pa.array(error)], schema.names)

    return blocks.mapInArrow(run, schema)
