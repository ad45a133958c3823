"""Near-duplicate embeddings by a robust-pruned flat graph.

1. Equal vectors of one label are one node with a number of copies; they are never paired.
2. Nodes of a label are dealt over shards around centroids of k-means, each to its nearest `overlap` centroids. The centroids
   are fitted on a bounded sample of nodes; every node is indexed.
3. In each shard a graph is built by inserting nodes in growing batches: a greedy search from the medoid collects
   candidates, robust pruning keeps at most `degree` of them, and reverse edges are pruned alike.
4. The shards' adjacency lists are united. Every node then searches its shards in the united graph, from the medoid; where half
   of its beam is in range, the search expands through all nodes in range.
5. Pairs found are verified by their cosine in double precision. Recall is audited in each part (label and length) against
   brute force over a sample of queries; parts below `recall` are searched again with more overlap and wider beams.
6. Parts still below it after `tries` searches, such as dense groups of many shards, are compared whole, in blocks of `block`
   nodes: every pair is looked at, and counts and a spanning forest are kept instead of the pairs. That costs the square of
   the part's nodes in products, and (nodes / `block`) copies of each node in the shuffle.

A shard holds about `shard` nodes, more only if there would be over `centroids` shards; no group grows with copies of a
vector. Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with nothing;
vectors of different lengths are never compared. Vectors so large or small that their squares leave the range of doubles are
scaled by a power of two first. Rows with equal ids are separate vectors. The result has the id, n_links, component_id and kept; extra
columns are left out. A label of over `sample` shards has as many centroids as the sample has nodes, and larger shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.llm.shared import components
from logsift.session import stored


@dataclass(frozen=True)
class GraphSettings:
    least: float = 0.93
    shard: int = 1500
    centroids: int = 1 << 16
    sample: int = 20_000
    overlap: int = 2
    degree: int = 24
    beam: int = 64
    alpha: float = 1.1
    recall: float = 0.98
    queries: int = 2000
    tries: int = 3
    block: int = 4096
    seed: int = 5


# --- the graph of one shard, in numpy -----------------------------------------------------

def greedy(unit: np.ndarray, edges: np.ndarray, queries: np.ndarray, start: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest nodes that a greedy search from `start` finds for each query, and their similarities, best first; -1 where
    there are fewer. All queries take a step at a time."""
    n, q = len(unit), len(queries)
    ids = np.full((q, beam), -1, np.int32)
    near = np.full((q, beam), -np.inf, np.float32)
    done = np.zeros((q, beam), bool)
    seen = np.zeros((q, n), bool)
    ids[:, 0], near[:, 0], seen[:, start] = start, queries @ unit[start], True
    active = np.arange(q)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, near[active])
        pick = open_.argmax(axis=1)
        left = open_[np.arange(len(active)), pick] > -np.inf
        active, pick = active[left], pick[left]
        if not len(active):
            break
        done[active, pick] = True
        to = edges[ids[active, pick]]
        fresh = (to >= 0) & ~seen[active[:, None], to]
        row, col = np.nonzero(fresh)
        seen[active[row], to[row, col]] = True
        value = np.full(to.shape, -np.inf, np.float32)
        value[row, col] = np.einsum("id,id->i", queries[active[row]], unit[to[row, col]])
        all_near = np.concatenate([near[active], value], axis=1)
        top = np.argpartition(-all_near, beam - 1, axis=1)[:, :beam]
        at = np.arange(len(active))[:, None]
        near[active] = all_near[at, top]
        ids[active] = np.where(near[active] > -np.inf, np.concatenate([ids[active], to], axis=1)[at, top], -1)
        done[active] = np.concatenate([done[active], np.zeros(to.shape, bool)], axis=1)[at, top]
    order = np.argsort(-near, axis=1, kind="stable")
    at = np.arange(q)[:, None]
    return ids[at, order], near[at, order]


def prune(unit: np.ndarray, nodes: np.ndarray, ids: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning: of each node's candidates the nearest stays and takes away those that are `alpha` times nearer to it
    than to the node, and so on, up to `degree`."""
    own = unit[nodes]
    other = unit[np.maximum(ids, 0)]
    apart = np.maximum(2 - 2 * np.einsum("bd,bcd->bc", own, other), 0)
    alive = (ids >= 0) & (ids != nodes[:, None])
    out = np.full((len(nodes), degree), -1, np.int32)
    at = np.arange(len(nodes))
    for r in range(degree):
        pick = np.where(alive, apart, np.inf).argmin(axis=1)
        some = alive[at, pick]
        if not some.any():
            break
        out[some, r] = ids[at, pick][some]
        between = np.maximum(2 - 2 * np.einsum("bd,bcd->bc", other[at, pick], other), 0)
        alive &= ~(some[:, None] & (alpha * alpha * between <= apart))
        alive[at, pick] = False
    return out


def medoid(unit: np.ndarray) -> int:
    return int((unit @ unit.mean(axis=0)).argmax())


def build(unit: np.ndarray, degree: int, beam: int, alpha: float, seed: int) -> np.ndarray:
    """Adjacency lists of a graph over unit vectors, -1 where a list is shorter."""
    n = len(unit)
    edges = np.full((n, degree), -1, np.int32)
    start = medoid(unit)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate(([start], order[order != start])).astype(np.int32)
    at = 1
    while at < n:
        batch = order[at:min(n, max(at + 1, 2 * at), at + 512)]
        found, _ = greedy(unit, edges, unit[batch], start, beam)
        edges[batch] = prune(unit, batch, found, degree, alpha)
        source = np.repeat(batch, degree)
        target = edges[batch].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        ends, first, many = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(ends), int(many.max()) if len(many) else 0), -1, np.int32)
        back[np.repeat(np.arange(len(ends)), many), np.arange(len(target)) - np.repeat(first, many)] = source
        both = np.concatenate([edges[ends], back], axis=1)
        room = (both >= 0).sum(axis=1) <= degree
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), axis=1)[:, :degree]
        edges[ends[room]] = packed[room]
        for i in range(0, (~room).sum(), 512):
            full = np.flatnonzero(~room)[i:i + 512]
            edges[ends[full]] = prune(unit, ends[full], both[full], degree, alpha)
        at += len(batch)
    return connect(unit, edges, start, beam)


def connect(unit: np.ndarray, edges: np.ndarray, start: int, beam: int) -> np.ndarray:
    """Every node made reachable from `start`: what is not gets an edge from the nearest node that a search for it finds."""
    n = len(unit)
    reached = np.zeros(n, bool)

    def spread(front: np.ndarray) -> None:
        while len(front):
            reached[front] = True
            front = np.unique(edges[front])
            front = front[front >= 0]
            front = front[~reached[front]]

    spread(np.array([start]))
    while not reached.all():
        lost = np.flatnonzero(~reached)
        found, _ = greedy(unit, edges, unit[lost[:512]], start, beam)
        for node, ids in zip(lost[:512].tolist(), found):
            if reached[node]:
                continue
            free = [i for i in ids[ids >= 0].tolist() if edges[i, -1] < 0]
            if not free:  # all lists near it are full: one more place for all
                edges = np.concatenate([edges, np.full((n, 1), -1, np.int32)], axis=1)
                free = ids[:1].tolist()
            row = edges[free[0]]
            row[np.flatnonzero(row < 0)[0]] = node
            spread(np.array([node]))
    return edges


def in_range(unit: np.ndarray, edges: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node the others that a range-expanding search finds at `least` or nearer: pairs (node, other).

    A query of whose beam half or more is in range goes on from there: all nodes in range are followed, at once, as long as
    they lead to others in range.
    """
    n, start = len(unit), medoid(unit)
    left, right = [], []
    beam = min(beam, n)
    # Edges both ways, by node: a node that is in no near list may still have near ones in its own.
    a, b = np.nonzero(edges >= 0)
    b = edges[a, b].astype(np.int64)
    both = np.unique(np.concatenate([a * n + b, b * n + a]))
    first, ends = np.searchsorted(both, np.arange(n + 1) * n), both % n
    for i in range(0, n, 512):
        part = np.arange(i, min(n, i + 512))
        ids, near = greedy(unit, edges, unit[part], start, beam)
        row, col = np.nonzero(near >= least)
        node = ids[row, col].astype(np.int64)
        left.append(part[row])
        right.append(node)
        wider = np.bincount(row, minlength=len(part)) * 2 >= beam
        seen = np.zeros((len(part), n), bool)
        seen[row, node] = True
        row, node = row[wider[row]], node[wider[row]]
        while len(row):
            next_row, next_node = [], []
            for j in range(0, len(row), 16384):
                some = node[j:j + 16384]
                many = first[some + 1] - first[some]
                to = ends[np.repeat(first[some] - np.cumsum(many) + many, many) + np.arange(many.sum())]
                at = np.repeat(row[j:j + 16384], many)
                fresh = ~seen[at, to]
                pair = np.unique(at[fresh] * n + to[fresh])
                at, to = pair // n, pair % n
                seen[at, to] = True
                good = np.einsum("id,id->i", unit[part[at]], unit[to]) >= least
                next_row.append(at[good])
                next_node.append(to[good])
            row, node = np.concatenate(next_row), np.concatenate(next_node)
            left.append(part[row])
            right.append(node)
    left, right = np.concatenate(left), np.concatenate(right)
    return left[left != right], right[left != right]


# --- over all shards, in Spark ------------------------------------------------------------

def _vectors(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def vector_nodes(vectors: DataFrame, id: str, vector: str, label: str) -> DataFrame:
    """(id, node, part, v): `node` is a hash of label and vector, null if it cannot link; `part` of label and length."""
    rows = vectors.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    schema = T.StructType([rows.schema["id"], T.StructField("node", T.LongType()), T.StructField("part", T.LongType()), rows.schema["v"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, parts, scaled = [], [], {}
            for at, (v, label) in enumerate(zip(batch.column("v"), batch.column("label").to_pylist())):
                node = part = None
                if v.is_valid and label is not None and v.values.null_count == 0 and len(v.values):
                    x = v.values.to_numpy(zero_copy_only=False)
                    with np.errstate(over="ignore", invalid="ignore"):
                        size = np.dot(x, x)
                    if np.isfinite(x).all() and not 1e-200 < size < 1e200 and x.any():
                        size = 1.0
                        scaled[at] = np.ldexp(x, -int(np.frexp(np.abs(x).max())[1]))
                    if np.isfinite(size) and size > 0:
                        part = xxhash.xxh3_64_intdigest(f"{len(x)}|{label}") - (1 << 63)
                        node = xxhash.xxh3_64_intdigest(x.tobytes(), part & 0xFFFFFFFFFFFF) - (1 << 63)
                nodes.append(node)
                parts.append(part)
            column = batch.column("v")
            if scaled:
                column = pa.array([scaled[i].tolist() if i in scaled else v for i, v in enumerate(column.to_pylist())], column.type)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(nodes, pa.int64()), pa.array(parts, pa.int64()), column], schema.names)

    return rows.mapInArrow(run, schema)


def _centroids(nodes: DataFrame, settings: GraphSettings) -> tuple[dict[int, np.ndarray], int]:
    """Unit centroids of every part of more than a shard, from a bounded sample, and the nodes a shard is meant to have."""
    total = nodes.count()
    shard = max(settings.shard, settings.overlap * total // settings.centroids)
    large = {r.part: r.n for r in nodes.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > shard).collect()}  # total / shard at most
    if not large:
        return {}, shard
    share = min(1.0, settings.sample / total)
    chosen = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(share * 1_000_000)).where(F.col("part").isin(list(large)) if len(large) < 1000 else F.lit(True))
    by: dict[int, list] = {}
    for r in chosen.select("part", "v").limit(2 * settings.sample).collect():
        if r.part in large:
            by.setdefault(r.part, []).append(r.v)
    rng, out = np.random.default_rng(settings.seed), {}
    for part, rows in sorted(by.items()):
        x = np.array(sorted(rows))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = min(len(x), -(-settings.overlap * large[part] // shard))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            own = np.concatenate([(x[i:i + 1024] @ c.T).argmax(axis=1) for i in range(0, len(x), 1024)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(size > 0, sums / np.maximum(size, 1e-300), c)
        out[part] = c
    return out, shard


def _sharded(nodes: DataFrame, settings: GraphSettings) -> DataFrame:
    """(shard, node, v): each node in the shards of its nearest centroids."""
    centroids, _ = _centroids(nodes, settings)
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)
    overlap = settings.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_numpy()
            rows, shards = [], []
            for part in np.unique(parts):
                own = np.flatnonzero(parts == part)
                centers = shared.value.get(int(part))
                if centers is None:
                    rows.append(own)
                    shards.append(np.full(len(own), part))
                    continue
                near = _vectors(batch.take(pa.array(own)), "v") @ centers.T
                k = min(overlap, len(centers))
                top = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(centers) else np.tile(np.arange(k), (len(own), 1))
                rows.append(np.repeat(own, k))
                shards.append(part ^ (top.ravel().astype(np.int64) + 1))
            take = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shards) if shards else np.zeros(0, np.int64)), batch.column("node").take(take), batch.column("v").take(take)], ["shard", "node", "v"])

    return nodes.select("part", "node", "v").mapInArrow(run, "shard long, node long, v array<double>")


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def find_links(nodes: DataFrame, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """(a, b), a < b: pairs of nodes found and verified."""
    members = stored(_sharded(nodes, settings), "shards")
    degree, beam, alpha, seed, least = settings.degree, settings.beam, settings.alpha, settings.seed, settings.least

    def link(key: tuple, table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        edges = build(_unit(_vectors(table, "v")), degree, beam, alpha, seed)
        row, col = np.nonzero(edges >= 0)
        cuts = np.concatenate(([0], np.cumsum((edges >= 0).sum(axis=1)))).astype(np.int32)
        return pa.table({"node": pa.array(nodes), "near": pa.ListArray.from_arrays(pa.array(cuts), pa.array(nodes[edges[row, col]]))})

    lists = members.groupBy("shard").applyInArrow(link, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # overlap x degree at most

    def search(key: tuple, table: pa.Table) -> pa.Table:
        nodes, exact = table.column("node").to_numpy(), _vectors(table, "v")
        by = np.argsort(nodes)
        near = table.column("near").combine_chunks()
        to = near.flatten().to_numpy()
        row = np.repeat(np.arange(len(nodes)), np.diff(near.offsets.to_numpy()))
        at = by[np.minimum(np.searchsorted(nodes[by], to), len(nodes) - 1)]
        here = nodes[at] == to
        row, at = row[here], at[here]
        many = np.bincount(row, minlength=len(nodes))
        edges = np.full((len(nodes), max(1, int(many.max()))), -1, np.int32)
        edges[row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)] = at
        a, b = in_range(_unit(exact), edges, least - 1e-4, beam)
        size = np.linalg.norm(exact, axis=1)
        good = np.concatenate([np.einsum("id,id->i", exact[a[i:i + 65536]], exact[b[i:i + 65536]]) / (size[a[i:i + 65536]] * size[b[i:i + 65536]]) >= least
                               for i in range(0, len(a), 65536)]) if len(a) else np.zeros(0, bool)
        a, b = nodes[a[good]], nodes[b[good]]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    ready = members.join(united, "node").select("shard", "node", "v", "near")
    return ready.groupBy("shard").applyInArrow(search, "a long, b long").distinct()


def audit(nodes: DataFrame, links: DataFrame, settings: GraphSettings = GraphSettings()) -> dict[int, tuple[int, int]]:
    """By part, true links of a sample of at most `queries` nodes by brute force over all nodes in blocks, and how many are in `links`."""
    spark = nodes.sparkSession
    picked = nodes.select("node", "part", "v").orderBy(F.xxhash64("node", F.lit(settings.seed))).limit(settings.queries).collect()
    by: dict[int, tuple] = {}
    for r in picked:
        by.setdefault(r.part, ([], []))
        by[r.part][0].append(r.node)
        by[r.part][1].append(r.v)
    shared = spark.sparkContext.broadcast({p: (np.array(n), np.array(v)) for p, (n, v) in by.items()})
    least = settings.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, found = batch.column("part").to_numpy(), [np.zeros((0, 3), np.int64)]
            for part in np.unique(parts):
                if int(part) not in shared.value:
                    continue
                own = batch.filter(pa.array(parts == part))
                ids, q = shared.value[int(part)]
                nodes, v = own.column("node").to_numpy(), _vectors(own, "v")
                i, j = np.nonzero((v @ q.T) / (np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)) >= least)
                other = nodes[i] != ids[j]
                a, b = nodes[i][other], ids[j][other]
                found.append(np.stack([np.full(len(a), part), np.minimum(a, b), np.maximum(a, b)], axis=1))
            pairs = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], ["part", "a", "b"])

    true = nodes.select("part", "node", "v").mapInArrow(run, "part long, a long, b long").distinct()
    counted = true.join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").groupBy("part").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return {r.part: (r.n, r.hits) for r in counted.collect()}  # a part for each query at most


def short_of(found: dict[int, tuple[int, int]], recall: float) -> Column | None:
    """Which parts are to be done again: those below `recall`, and if all together are, also those without a true link in the
    sample. None if there are none."""
    short = [part for part, (n, hits) in found.items() if hits < recall * n]
    if not short:
        return None
    if sum(hits for _, hits in found.values()) < recall * sum(n for n, _ in found.values()):
        return ~F.col("part").isin([part for part in found if part not in set(short)])
    return F.col("part").isin(short)


def exact_links(nodes: DataFrame, settings: GraphSettings = GraphSettings()) -> DataFrame:
    """(a, b, others) by comparing every two nodes of a part: rows without b have a share of the copies linked with a, to be
    summed up; rows with b are links that join the same components as all links do."""
    least, block = settings.least, settings.block
    large = nodes.groupBy("part").agg(F.ceil(F.count("*") / block).alias("blocks")).where("blocks > 1")
    dealt = nodes.join(F.broadcast(large), "part", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))  # nodes / block parts at most
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(settings.seed)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("part", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "v", "copies")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        low, same = key[1].as_py(), key[1] == key[2]
        nodes, v, own = table.column("node").to_numpy(), _vectors(table, "v"), table.column("own").to_numpy()
        copies, size = table.column("copies").to_numpy().astype(np.float64), np.linalg.norm(v, axis=1)
        rows = np.flatnonzero(own == low)
        cols = rows if same else np.flatnonzero(own != low)
        others, group, a, b = np.zeros(len(nodes)), np.arange(len(cols)), [], []
        for i in range(0, len(rows) if len(cols) else 0, 512):
            part = rows[i:i + 512]
            hit = (v[part] @ v[cols].T) / (size[part][:, None] * size[cols]) >= least
            if same:
                hit[np.arange(len(part)), np.arange(i, i + len(part))] = False
            others[part] += hit @ copies[cols]
            if not same:
                others[cols] += copies[part] @ hit
            for k in np.flatnonzero(hit.any(axis=1)).tolist():
                to = np.flatnonzero(hit[k])
                joined, one = np.unique(group[to], return_index=True)
                if same:
                    one = one[joined != group[i + k]]
                    joined = np.union1d(joined, group[i + k])
                a.extend([nodes[part[k]]] * len(one))
                b.extend(nodes[cols[to[one]]].tolist())
                if len(joined) > 1:
                    group[np.isin(group, joined)] = joined[0]
        some = np.flatnonzero(others)
        return pa.table({"a": pa.array(np.concatenate([nodes[some], np.array(a, np.int64)])), "b": pa.array([None] * len(some) + b, pa.int64()),
                         "others": pa.array(np.concatenate([others[some].astype(np.int64), np.zeros(len(a), np.int64)]))})

    return dealt.groupBy("part", "low", "high").applyInArrow(compare, "a long, b long, others long")


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", settings: GraphSettings = GraphSettings()) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    rows = stored(vector_nodes(vectors, id, vector, label), "vectors")
    good = rows.where("node IS NOT NULL")
    nodes = stored(good.groupBy("node").agg(F.first("part").alias("part"), F.first("v").alias("v"), F.count("*").alias("copies")), "nodes")
    links, left = None, F.lit(True)
    for _ in range(settings.tries):
        found = find_links(nodes.where(left), settings)
        links = stored(found if links is None else links.unionByName(found).distinct(), "links")
        short = short_of(audit(nodes.where(left), links, settings), settings.recall)
        left = F.lit(False) if short is None else left & short
        if short is None:
            break
        settings = replace(settings, overlap=settings.overlap + 1, beam=2 * settings.beam, degree=settings.degree + 8)
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(nodes.where(~left).select(F.col("node").alias("b"), "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    if short is not None:
        exact = stored(exact_links(nodes.where(left), settings), "exact")
        others = others.unionByName(exact.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("others").alias("others")))
        links = links.unionByName(exact.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
    known = nodes.select("node", "copies").join(others, "node", "left").join(components(links), "node", "left")
    known = known.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    # Both stored, so that Spark can split the join where one component has very many vectors.
    placed = stored(rows.select("id", "node").join(known, "node", "left"), "placed")
    smallest = stored(placed.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    out = placed.join(smallest, "component", "left").select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
