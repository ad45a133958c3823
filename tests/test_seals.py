"""The tree of seals: every loss shows, proofs hold, and only for what is there."""

import pytest
from pyspark.sql import functions as F

from logsift.operators import seals as s
from logsift.operators.integrity import chain_hash


@pytest.fixture(scope="module")
def chained(spark):
    rows = [(k, i, f"{k} {i}") for k, n in (("a", 95), ("b", 7), ("c", 3), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i long, raw_event string").withColumn("t", F.timestamp_seconds("i"))
    return chain_hash(df, ["k"], "t", ["i"], segment_rows=3).cache()


FAN = 3
KEYS = ["k"]


@pytest.fixture(scope="module")
def sealed(chained):
    return s.seal(chained, KEYS, FAN)


def problems(chained, seals):
    return sorted((r.k or "", -1 if r.segment is None else r.segment, r.problem) for r in s.verify_seals(chained, seals, KEYS, FAN).collect())


def test_all_is_well(chained, sealed):
    assert problems(chained, sealed) == []
    assert {(r.k, r.segments) for r in sealed.tops.collect()} == {("a", 32), ("b", 3), ("c", 1), (None, 14)}
    root = sealed.root.collect()
    assert len(root) == 1 and (root[0]["keys"], root[0].segments) == (4, 50)
    assert s.seal(chained.repartition(7), KEYS, FAN).root.collect() == root


def test_losses_show(chained, sealed):
    a = F.col("k").eqNullSafe("a")
    seg = F.col("chain_segment")
    forged = chained.withColumn("chain_hash", F.when(a & (F.col("chain_pos") == 14), "forged").otherwise(F.col("chain_hash")))
    assert problems(forged, sealed) == [("a", 4, "changed")]
    assert problems(chained.where(~(a & (F.col("chain_pos") == 13))), sealed) == [("a", 4, "changed")]
    assert problems(chained.where(~(a & (seg == 31))), sealed) == [("a", 31, "lost segment")]
    assert problems(chained.where("k IS NOT NULL"), sealed) == [("", i, "lost segment") for i in range(14)]
    cut = s.Seals(sealed.nodes.where(~(a & (F.col("level") == 0) & (F.col("index") == 5))), sealed.tops, sealed.root)
    assert problems(chained, cut) == [("a", 5, "lost seal")]
    cut = s.Seals(sealed.nodes.where(~(a & (F.col("level") == 0) & (F.col("index") == 31))), sealed.tops, sealed.root)
    assert problems(chained.where(~(a & (seg == 31))), cut) == [("a", 31, "lost tail")]
    cut = s.Seals(sealed.nodes.where("k <> 'b' OR k IS NULL"), sealed.tops, sealed.root)
    assert problems(chained.where("k <> 'b' OR k IS NULL"), cut) == [("b", 0, "lost key")]
    cut = s.Seals(sealed.nodes.where("k <> 'b' OR k IS NULL"), sealed.tops.where("k <> 'b' OR k IS NULL"), sealed.root)
    assert problems(chained.where("k <> 'b' OR k IS NULL"), cut) == [("", -1, "root")]
    inner = sealed.nodes.withColumn("hash", F.when(a & (F.col("level") == 2) & (F.col("index") == 1), "forged").otherwise(F.col("hash")))
    assert problems(chained, s.Seals(inner, sealed.tops, sealed.root)) == [("a", 9, "broken seal")]


def test_inclusion(spark, chained, sealed):
    leaves = sealed.nodes.where("level = 0").select("k", F.col("index").alias("segment"), "rows", "head")
    assert s.included(leaves, sealed, KEYS, FAN).where("included").count() == 50
    wrong = leaves.withColumn("head", F.lit("x")).unionByName(leaves.withColumn("segment", F.col("segment") + 100)).unionByName(leaves.withColumn("k", F.lit("none")))
    got = s.included(wrong, sealed, KEYS, FAN)
    assert got.count() == 150 and got.where("included").count() == 0
    forged = s.Seals(sealed.nodes.withColumn("hash", F.when((F.col("level") == 1) & (F.col("index") == 0), "x").otherwise(F.col("hash"))), sealed.tops, sealed.root)
    assert {(r.k, r.segment) for r in s.included(leaves, forged, KEYS, FAN).where("NOT included").collect()} >= {("a", 0), ("a", 2), ("a", 9), (None, 3)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 26, 27, 28, 31, 32])
def test_a_tree_that_has_grown(chained, sealed, n):
    old = s.seal(chained.where((F.col("k") == "a") & (F.col("chain_segment") < n)), KEYS, FAN).tops
    assert [(r.segments, r.appended) for r in s.appended(old, sealed, KEYS, FAN).collect()] == [(n, True)]
    rewritten = s.Seals(sealed.nodes.withColumn("hash", F.when(F.col("index") == 0, F.sha2("hash", 256)).otherwise(F.col("hash"))), sealed.tops, sealed.root)
    assert not s.appended(old, rewritten, KEYS, FAN).first().appended
