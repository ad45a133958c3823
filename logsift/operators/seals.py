"""A tree of seals over chains: what was lost or changed shows, however many segments and keys there are.

Each segment of a chain is a leaf: its number, its rows and its last hash. Nodes join `fan` neighbours, level by level, up to one top
for each key. The tops are the leaves of a second tree, whose branches are the digits of a hash of the key, up to one root. All
levels are aggregations of groups of at most `fan`, or 256, rows; a key with most of the segments is as many groups as any other rows.

Who keeps the root outside can tell that nothing of it has gone: a changed segment, a lost one, a lost last one, a lost
seal, a lost key. A tree grows by appending only: `appended` shows that an old top follows from the new tree, `included` that a segment is in it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.session import stored

FAN = 16
DIGITS = (8, 6, 4, 2, 0)  # of the hash of a key, by level


@dataclass(frozen=True)
class Seals:
    """`nodes`: (keys, level, index, rows, head, hash), leaves at level 0. `tops`: (keys, segments, hash). `root`: (keys, segments, hash), one row."""

    nodes: DataFrame
    tops: DataFrame
    root: DataFrame


def seal(chained: DataFrame, keys: list[str], fan: int = FAN) -> Seals:
    """The seals of chains as `chain_hash` gives them."""
    leaves = stored(_with_total(_leaves(chained, keys), keys), "leaves")
    return _sealed(leaves, keys, fan)


def _leaves(chained: DataFrame, keys: list[str]) -> DataFrame:
    heads = chained.groupBy(*keys, F.col("chain_segment").alias("index")).agg(F.count("*").alias("rows"), F.max_by("chain_hash", "chain_pos").alias("head"))
    return heads.withColumn("hash", F.sha2(F.concat_ws("|", F.lit("leaf"), "index", "rows", "head"), 256))


def _with_total(leaves: DataFrame, keys: list[str]) -> DataFrame:
    totals = leaves.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.max("index") + 1).alias("total"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return leaves.join(stored(totals, "totals"), same).drop(*[f"_{k}" for k in keys])


def _sealed(leaves: DataFrame, keys: list[str], fan: int) -> Seals:
    nodes = stored(_grow(leaves, keys, fan), "nodes")
    tops = nodes.where(F.col("level") == _height(F.col("total"), fan)).select(*keys, F.col("total").alias("segments"), "hash")
    return Seals(nodes.drop("total"), tops, _root(tops, keys))


def _height(total: Column, fan: int) -> Column:
    """The least level at which one node covers all leaves."""
    height, power = F.lit(0), 1
    while power < 1 << 62:
        height = height + (total > power).cast("int")
        power *= fan
    return height


def _joined(children: Column) -> Column:
    return F.sha2(F.concat_ws(",", F.lit("node"), F.transform(F.array_sort(children), lambda c: F.concat_ws(":", c["index"].cast("string"), c["hash"]))), 256)


def _grow(leaves: DataFrame, keys: list[str], fan: int) -> DataFrame:
    most = leaves.agg(F.max("total")).first()[0] or 1
    level, power, current = 0, 1, leaves.withColumn("level", F.lit(0))
    out = current
    while power < most:
        parents = current.where(F.col("total") > power).groupBy(*keys, "total", F.floor(F.col("index") / fan).alias("at")).agg(
            F.sum("rows").alias("rows"), F.collect_list(F.struct("index", "hash")).alias("children"))
        level, power = level + 1, power * fan
        current = parents.select(*keys, F.col("at").alias("index"), "rows", F.lit(None).cast("string").alias("head"), _joined(F.col("children")).alias("hash"), "total", F.lit(level).alias("level"))
        current = stored(current, "level")
        out = out.unionByName(current)
    return out


def _root(tops: DataFrame, keys: list[str]) -> DataFrame:
    name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    leaves = tops.select(F.sha2(name, 256).alias("place"), F.sha2(F.concat_ws("|", F.lit("key"), name, "segments", "hash"), 256).alias("hash"), F.lit(1).alias("keys"), "segments")
    for digits in DIGITS:
        grouped = leaves.groupBy(F.left("place", F.lit(digits)).alias("at")).agg(F.collect_list(F.struct(F.col("place").alias("index"), "hash")).alias("children"), F.sum("keys").alias("keys"), F.sum("segments").alias("segments"))
        leaves = grouped.select(F.col("at").alias("place"), _joined(F.col("children")).alias("hash"), "keys", "segments")
    return leaves.drop("place").select("keys", "segments", "hash")


def verify_seals(chained: DataFrame, seals: Seals, keys: list[str], fan: int = FAN) -> DataFrame:
    """(keys, segment, problem) of all that is not as it was sealed; nothing if all is well. `seals.root` is trusted, the rest is proved by it.

    changed: rows or last hash of a segment differ from its seal. lost segment, lost seal: one of the two is there. lost tail: the
    key had more segments, and neither these nor their seals are there. broken seal: a seal does not follow from those below it. lost key:
    nothing of the key but its top. root: the tops are not those of the root (keys and segment null).
    """
    names = lambda df, tag: df.select(*[F.col(k).alias(f"{tag}_{k}") for k in keys], *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in keys])
    same = lambda a, b, *more: [F.col(f"{a}_{k}").eqNullSafe(F.col(f"{b}_{k}")) for k in keys] + [F.col(f"{a}_{m}") == F.col(f"{b}_{m}") for m in more]
    key_of = lambda *tags: [F.coalesce(*[F.col(f"{t}_{k}") for t in tags]).alias(k) for k in keys]

    there = stored(_leaves(chained, keys), "there")
    sealed = stored(seals.nodes.where("level = 0"), "sealed")
    tops = stored(seals.tops, "tops")
    both = names(there, "r").join(names(sealed, "s"), same("r", "s", "index"), "full")
    problem = F.when(F.col("s_hash").isNull(), "lost seal").when(F.col("r_hash").isNull(), "lost segment").when(F.col("r_hash") != F.col("s_hash"), "changed")
    found = both.select(*key_of("r", "s"), F.coalesce("r_index", "s_index").alias("segment"), problem.alias("problem"))

    known = there.select(*keys, "index").unionByName(sealed.select(*keys, "index")).groupBy(*keys).agg((F.max("index") + 1).alias("found"))
    left = names(tops, "t").join(names(stored(known, "known"), "k"), same("t", "k"), "left")
    lost = F.when(F.col("k_found").isNull(), "lost key").when(F.col("k_found") < F.col("t_segments"), "lost tail")
    ends = left.select(*key_of("t"), F.coalesce("k_found", F.lit(0)).cast("long").alias("segment"), lost.alias("problem"))

    again = _grow(_with_total(sealed.drop("level"), keys), keys, fan)
    inner = names(seals.nodes.where("level > 0"), "s").join(names(again.where("level > 0").select(*keys, "level", "index", "hash"), "a"), same("s", "a", "level", "index"), "full")
    wrong = ~F.coalesce(F.col("s_hash") == F.col("a_hash"), F.lit(False))
    # A seal that can't be made again because seals below it are lost is reported by these.
    gone = found.where("problem = 'lost seal'").select(*[F.col(k).alias(f"g_{k}") for k in keys]).unionByName(ends.where("problem IS NOT NULL").select(*[F.col(k).alias(f"g_{k}") for k in keys])).distinct()
    broken = inner.where(wrong).select(*[c for k in keys for c in (F.coalesce(f"s_{k}", f"a_{k}").alias(f"x_{k}"),)], F.coalesce("s_index", "a_index").alias("x_index"), F.coalesce("s_level", "a_level").alias("x_level"))
    broken = broken.join(stored(gone, "gone"), same("x", "g"), "left_anti")
    broken = broken.select(*[F.col(f"x_{k}").alias(k) for k in keys], (F.col("x_index") * F.pow(F.lit(fan), F.col("x_level"))).cast("long").alias("segment"), F.lit("broken seal").alias("problem"))

    now = _root(tops, keys).select(F.col("hash").alias("now"))
    unlike = seals.root.join(now, F.lit(True), "left").where(~F.coalesce(F.col("hash") == F.col("now"), F.lit(False)))  # a row on either side
    root = unlike.select(*[F.lit(None).cast(tops.schema[k].dataType).alias(k) for k in keys], F.lit(None).cast("long").alias("segment"), F.lit("root").alias("problem"))
    return found.unionByName(ends).where("problem IS NOT NULL").unionByName(broken).unionByName(root)


def included(asked: DataFrame, seals: Seals, keys: list[str], fan: int = FAN) -> DataFrame:
    """(keys, segment, included): whether each asked segment, with its rows and head, is under its key's top.

    The proof of a segment is one group of at most `fan` seals for each level, of which each must give one of the next level's.
    """
    tops = stored(seals.tops.select(*[F.col(k).alias(f"t_{k}") for k in keys], F.col("segments").alias("total"), F.col("hash").alias("top")), "tops")
    nodes = stored(seals.nodes.select(*[F.col(k).alias(f"n_{k}") for k in keys], F.col("level").alias("n_level"), "index", "hash", F.floor(F.col("index") / fan).alias("group")), "nodes")
    rows = asked.select(*keys, "segment", F.sha2(F.concat_ws("|", F.lit("leaf"), "segment", "rows", "head"), 256).alias("value"))
    rows = rows.join(tops, [F.col(k).eqNullSafe(F.col(f"t_{k}")) for k in keys], "left").drop(*[f"t_{k}" for k in keys]).withColumn("good", F.col("top").isNotNull() & (F.col("segment") < F.col("total")))
    most, level, power = seals.tops.agg(F.max("segments")).first()[0] or 1, 0, 1
    while power < most:
        up = nodes.where(F.col("n_level") == level)
        at = F.floor(F.col("segment") / (power * fan))
        met = rows.where(F.col("total") > power).join(up, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys] + [at == F.col("group")], "left")
        met = met.groupBy(*keys, "segment", "value", "total", "top", "good").agg(F.collect_list(F.when(F.col("hash").isNotNull(), F.struct("index", "hash"))).alias("children"))
        has = F.exists("children", lambda c: (c["index"] == F.floor(F.col("segment") / power)) & (c["hash"] == F.col("value")))
        met = met.withColumn("good", F.col("good") & has).select(*keys, "segment", _joined(F.col("children")).alias("value"), "total", "top", "good")
        rows = stored(met.unionByName(rows.where(~F.coalesce(F.col("total") > power, F.lit(False)))), "proof")
        level, power = level + 1, power * fan
    return rows.select(*keys, "segment", (F.col("good") & (F.col("value") == F.col("top"))).alias("included"))


def appended(old_tops: DataFrame, seals: Seals, keys: list[str], fan: int = FAN) -> DataFrame:
    """(keys, segments, appended): whether each old top follows from the new tree, so that its segments are there unchanged.

    An old tree is made of whole nodes of the new one along its right edge: fewer than `fan` on each level.
    """
    old = old_tops.select(*keys, "segments", F.col("hash").alias("top"))
    nodes = seals.nodes.select(*[F.col(k).alias(f"n_{k}") for k in keys], "level", "index", "hash")
    whole = F.floor(F.col("segments") / F.pow(F.lit(fan), F.col("level")))
    edge = (F.col("index") < whole) & (F.col("index") >= F.floor(whole / fan) * fan)
    met = old.join(nodes, [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in keys], "left").groupBy(*keys, "segments", "top").agg(
        F.collect_list(F.when(edge, F.struct("level", "index", "hash"))).alias("edge"))

    @F.pandas_udf("boolean")
    def follows(segments: pd.Series, top: pd.Series, edge: pd.Series) -> pd.Series:
        return pd.Series([old_top(int(n), e, fan) == t for n, t, e in zip(segments, top, edge)], dtype=bool)

    return met.select(*keys, "segments", follows("segments", "top", "edge").alias("appended"))


def old_top(segments: int, edge, fan: int = FAN) -> str | None:
    """The top of the first `segments` leaves from the nodes (level, index, hash) on their right edge."""
    by: dict[int, dict[int, str]] = {}
    for node in edge:
        by.setdefault(node["level"], {})[node["index"]] = node["hash"]
    level, left, part = 0, segments, None  # whole nodes on this level, and the hash of what comes after them
    while left + (part is not None) > 1:
        first = left // fan * fan
        children = [(i, by.get(level, {}).get(i)) for i in range(first, left)]
        if any(h is None for _, h in children):
            return None
        children += [(left, part)] if part is not None else []
        part = hashlib.sha256(",".join(["node", *[f"{i}:{h}" for i, h in children]]).encode()).hexdigest() if children else None
        level, left = level + 1, left // fan
    return part if part is not None else by.get(level, {}).get(0)
