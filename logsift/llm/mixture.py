"""Mix documents of several, possibly overlapping sources to target weights.

1. Documents are aggregated by membership pattern, the set of sources that have them: words per pattern.
2. A min-cost flow routes the words of the patterns to the sources' targets. A pattern offers its words once for each
   permitted repetition, each one dearer than the one before, so repetition starts only where it must and is spread evenly.
3. A pattern's flow is whole copies of all its documents and a rest, filled by documents in the order of a seeded hash.

Step 3 sorts no pattern: words are summed by the first and then the second half of a 24-bit hash, and a document is in the
rest if its hash is at most the pattern's cut. So a source with most of the rows is no large task. The driver gets one row
per pattern, and all patterns are routed; over 100,000 of them, or of sources, are an error. More than `max_patterns` are not
broadcast to the documents but joined as Spark sees fit.

A null source is a source, the last one. Null and empty texts have size 0 and are taken like others of their hash, at 0 words.
Repeated rows are taken alike. An empty table gives no rows. New columns replace columns of the same names.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...], share: float, repeats: int) -> dict[str | None, float]:
    """The words wanted of each source: `share` of all words by weight, none over `repeats` times its size; what is too much
    goes to the others by weight. Weights go round the sources in the order of code points, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    wanted, left, open_ = {}, share * sum(sizes.values()), list(order)
    while open_:
        unit = left / max(1, sum(weight[s] for s in open_))
        full = [s for s in open_ if unit * weight[s] > repeats * sizes[s]]
        if not full:
            return wanted | {s: unit * weight[s] for s in open_}
        for s in full:
            wanted[s] = float(repeats * sizes[s])
            left -= wanted[s]
        open_ = [s for s in open_ if s not in wanted]
    return wanted


def route(patterns: list[tuple[tuple, int]], wanted: dict, repeats: int) -> list[dict]:
    """For each pattern, the words that go to each of its sources, at the least cost of repetition.

    Successive shortest paths. A path leads from a pattern's next repetition over patterns, whose words move from one source
    to another, to a source that wants more; repetition r costs r - 1.
    """
    flow = [dict.fromkeys(members, 0) for members, _ in patterns]
    need = {s: round(w) for s, w in wanted.items()}
    holders: dict = {}
    for p, (members, _) in enumerate(patterns):
        for s in members:
            holders.setdefault(s, []).append(p)
    used = [0] * len(patterns)
    heap = [(0, p) for p, (_, n) in enumerate(patterns) if n and repeats > 0]
    while True:
        # The cheapest pattern with words left from which a source in need can be reached; all moves cost nothing. A pattern
        # from which none can be reached leaves for good: no later path passes what it reaches, as none would come out again.
        seen: dict = {}
        end = None
        while heap and end is None:
            _, start = heapq.heappop(heap)
            queue = [("p", start, None)]
            while queue and end is None:
                kind, at, came = queue.pop(0)
                if (kind, at) in seen:
                    continue
                seen[kind, at] = came
                if kind == "s":
                    if need[at] > 0:
                        end = (kind, at)
                        break
                    queue += [("p", p, (kind, at)) for p in holders[at] if flow[p][at] > 0]
                else:
                    queue += [("s", s, (kind, at)) for s in patterns[at][0]]
        if end is None:
            return flow
        path, end = [end], end[1]
        while seen[path[-1]] is not None:
            path.append(seen[path[-1]])
        path.reverse()
        first = path[0][1]
        n = patterns[first][1]
        amount = min(need[end], n - used[first] % n, *[flow[p][s] for (_, s), (_, p) in zip(path[1::2], path[2::2])])
        for (_, p), (_, s) in zip(path[::2], path[1::2]):
            flow[p][s] += amount
        for (_, s), (_, p) in zip(path[1::2], path[2::2]):
            flow[p][s] -= amount
        used[first] += amount
        need[end] -= amount
        if used[first] < repeats * n:
            heapq.heappush(heap, (used[first] // n, first))


@dataclass(frozen=True)
class Mix:
    """`documents`: all columns and size, source_size, target, copies, taken. `flow`: pattern, source, words routed."""

    documents: DataFrame
    flow: DataFrame


def mix(docs: DataFrame, id: str = "doc_id", source: str = "source", size: str = "size", weights: tuple[int, ...] = (5, 2, 1),
        share: float = 1.0, repeats: int = 3, seed: int = 17, max_patterns: int = 2000) -> Mix:
    """`source` is a string or an array of strings; `size` a number of words, see `size_of`. source_size and target are those
    of a document's first source. `docs` is read four times, so it should be a stored table, or narrow."""
    spark = docs.sparkSession
    several = dict(docs.dtypes)[source].startswith("array")
    members = F.coalesce(F.array_sort(F.array_distinct(source)), F.array(F.lit(None).cast("string"))) if several else F.array(F.col(source).cast("string"))
    members = F.when(F.size(members) == 0, F.array(F.lit(None).cast("string"))).otherwise(members)
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id).cast("string"), F.lit("null"))))
    marked = docs.withColumns({"__key": F.to_json(members), "__members": members, "__cell": F.conv(F.substring(digest, 1, 6), 16, 10).cast("int")})
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")

    sums = marked.groupBy("__key").agg(F.first("__members").alias("members"), F.sum(words).alias("n")).limit(100_001).collect() if several else []
    if len(sums) > 100_000:
        raise ValueError("more than 100,000 patterns of sources; group the sources first")
    ones = (marked.where(F.size("__members") > 1).select(F.explode("__members").alias("s"), words.alias("n")).unionByName(
        marked.where(F.size("__members") == 1).select(F.col("__members")[0].alias("s"), words.alias("n"))) if several
        else marked.select(F.col("__members")[0].alias("s"), words.alias("n"))).groupBy("s").agg(F.sum("n").alias("n")).limit(100_001).collect()
    if len(ones) > 100_000:
        raise ValueError("more than 100,000 sources; group them first")
    sizes = {r.s: r.n or 0 for r in ones}
    wanted = targets(sizes, weights, share, repeats)
    if several:
        rows = [(r["__key"], tuple(r.members), r.n or 0) for r in sums]
    else:
        rows = [(r.k, (r.s,), sizes[r.s]) for r in spark.createDataFrame([(s,) for s in sizes], "s string").select(F.to_json(F.array("s")).alias("k"), "s").collect()]
    rows.sort(key=lambda r: r[0])
    flow = route([(m, n) for _, m, n in rows], wanted, repeats)

    plan = spark.createDataFrame([(k, (t := sum(f.values())) // n if n else 0, t % n if n else 0, sizes[m[0]], float(wanted[m[0]]))
                                  for (k, m, n), f in zip(rows, flow)], "__key string, copies long, rest long, source_size long, target double")
    cuts = _cuts(marked.select("__key", "__cell", words.alias("n")), plan)
    plan = plan.join(cuts, "__key", "left")  # a row per pattern
    if not several or len(rows) <= max_patterns:
        plan = F.broadcast(plan)
    extra = F.col("__cell") <= F.coalesce("__cut", F.lit(-1))
    out = marked.drop("copies", "source_size", "target", "taken").join(plan, "__key")
    out = out.withColumn("copies", F.col("copies") + extra.cast("long")).withColumn("taken", F.col("copies") * words)
    parts = [(k, s, x) for (k, _, _), f in zip(rows, flow) for s, x in f.items()]
    return Mix(out.drop("__key", "__members", "__cell", "__cut", "rest"), spark.createDataFrame(parts, "pattern string, source string, words long"))


def _cuts(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """The largest hash that belongs to each pattern's rest: cells are taken in order while more than half of one is wanted."""
    wanted = F.broadcast(plan.where("rest > 0").select("__key", "rest"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = cells.groupBy("__key", F.shiftright("__cell", 12).alias("at")).agg(F.sum("n").alias("n")).join(wanted, "__key")
    crossed = bins.select("__key", "at", "rest", before.alias("done")).where("done < rest").groupBy("__key").agg(
        F.max_by(F.struct("at", "done", "rest"), "at").alias("x")).select("__key", F.col("x.at").alias("bin"), "x.done", "x.rest")
    inside = cells.join(F.broadcast(crossed), (cells["__key"] == crossed["__key"]) & (F.shiftright("__cell", 12) == crossed["bin"])).drop(crossed["__key"])
    fine = inside.groupBy("__key", F.col("__cell").alias("at")).agg(F.sum("n").alias("n"), F.first("done").alias("done"), F.first("rest").alias("rest"))
    taken = fine.select("__key", "at", (2 * (F.col("done") + before) + F.col("n") < 2 * F.col("rest")).alias("taken"))
    last = taken.where("taken").groupBy("__key").agg(F.max("at").alias("cell"))
    return crossed.join(last, "__key", "left").select("__key", F.coalesce("cell", F.shiftleft("bin", 12) - 1).alias("__cut"))
