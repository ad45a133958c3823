"""Stored event tables: replacing by id, and point lookups that skip row groups."""

import os
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logsift.session import discard, new_folder, stored
from logsift.sinks import tables
from logsift.sinks.tables import replace_events, write_events
from logsift.sources.tables import read_events

SCHEMA = "event_id string, event_ts timestamp, created_at timestamp, severity string, raw_event string, source_ip string"


def at(day, second=0):
    return datetime(2024, 1, day, 12, 0, second, tzinfo=timezone.utc)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


@pytest.fixture
def table(spark):
    path = new_folder(spark, "events")
    rows = [(f"e{i}", at(1 + i % 3), at(9), "low", f"raw {i}", "1.1.1.1") for i in range(30)] + [("none", None, None, "low", "no time", None)]
    replace_events(spark.createDataFrame(rows, SCHEMA), path, ["created_at"])
    return path, rows


def content(spark, path):
    return sorted((r.event_id, r.severity, str(r.event_ts)) for r in read_events(spark, path).collect())


def test_the_same_rows_twice_change_nothing(spark, table):
    path, rows = table
    before = content(spark, path)
    assert len(before) == 31
    assert len(replace_events(spark.createDataFrame(rows + rows[:5], SCHEMA), path, ["created_at"])) == 4
    assert content(spark, path) == before


def test_only_touched_dates_are_written(spark, table):
    path, rows = table
    before = files(path)
    new = [("e0", at(1), at(10), "high", "raw 0", None), ("e3", at(1), at(8), "never", "older than what is stored", None), ("x", at(7), at(9), "new", "r", None)]
    touched = replace_events(spark.createDataFrame(new, SCHEMA), path, ["created_at"])
    assert [str(d) for d in touched] == ["2024-01-01", "2024-01-07"]
    after = files(path)
    same = lambda d: {f: t for f, t in d.items() if "2024-01-01" not in f and "2024-01-07" not in f}
    assert same(after) == same(before) and len(same(after)) >= 3
    got = {i: s for i, s, _ in content(spark, path)}
    assert len(got) == 32 and got["e0"] == "high" and got["e3"] == "low" and got["x"] == "new"


def test_an_event_may_move_to_another_date(spark, table):
    path, _ = table
    replace_events(spark.createDataFrame([("none", at(5), at(9), "dated", "r", None)], SCHEMA), path, ["created_at"])
    got = [(i, s) for i, s, _ in content(spark, path) if i == "none"]
    assert got == [("none", "dated")] and not any("HIVE_DEFAULT" in f for f in files(path))
    replace_events(spark.createDataFrame([(f"e{i}", at(20), at(11), "moved", "r", None) for i in range(0, 30, 3)], SCHEMA), path, ["created_at"])
    assert len(content(spark, path)) == 31 and not any("2024-01-01" in f for f in files(path))


def test_rows_are_stored_once_before_they_are_written(spark, table, monkeypatch):
    """Whole rows are written aside once, those of a new table not at all; ids are, to find the dates."""
    path, rows = table
    aside = []
    monkeypatch.setattr(tables, "stored", lambda df, name: aside.append(len(df.columns)) or stored(df, name))
    new = [("e0", at(1), at(10), "high", "raw 0", None), ("e3", at(1), at(8), "never", "older than what is stored", None), ("e1", at(1), at(9), "day", "raw 1", None),
           ("e4", at(2), None, "unknown", "no time of storage is earlier", None)]
    assert [str(d) for d in replace_events(spark.createDataFrame(new, SCHEMA), path, ["created_at"])] == ["2024-01-01", "2024-01-02"]
    assert [n for n in aside if n > 3] == [7]
    got = content(spark, path)
    assert len(got) == 31 and {i: s for i, s, _ in got if s != "low"} == {"e0": "high", "e1": "day"} and sum("2024-01-01" in t for _, _, t in got) == 11
    aside.clear()
    assert len(replace_events(spark.createDataFrame(rows, SCHEMA), new_folder(spark, "events"), ["created_at"])) == 4 and aside == []


def test_nothing_to_replace(spark, table):
    path, _ = table
    before = files(path)
    assert replace_events(spark.createDataFrame([], SCHEMA), path, ["created_at"]) == [] and files(path) == before


def rows_read(df):
    """Rows that the scan gave, by Spark's own metric."""
    df.collect()
    plan, todo = df._jdf.queryExecution().executedPlan(), []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            return node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    raise AssertionError("no scan")


def test_lookups_skip_row_groups(spark):
    path = new_folder(spark, "events")
    n = 60_000
    rows = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("event_id"), F.lit(at(1)).alias("event_ts"), F.lit(at(1)).alias("created_at"),
                                 F.lit("low").alias("severity"), F.repeat(F.md5(F.col("id").cast("string")), 20).alias("raw_event"), F.concat(F.lit("10.0.0."), (F.col("id") % 200).cast("string")).alias("source_ip"))
    write_events(rows.coalesce(2), path, block_bytes=1 << 20)
    events = read_events(spark, path)
    assert rows_read(events.where("severity = 'low'").select("event_id", "source_ip")) == n
    one = spark.range(1).select(F.sha2(F.lit("777"), 256)).first()[0]
    assert rows_read(events.where(F.col("event_id") == one).select("event_id", "severity")) < n / 4
    assert rows_read(events.where("source_ip = '10.0.0.77'").select("event_id", "source_ip")) < n / 4
    assert events.where(F.col("event_id") == one).count() == 1 and events.where("source_ip = '10.0.0.77'").count() == n // 200


def test_what_a_stored_table_shuffled_is_removed(spark):
    """Shuffle files stayed until the driver collected its garbage, and scratch tables for good."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (disk.getAllFiles().apply(i).getName() for i in range(disk.getAllFiles().size())) if f.startswith("shuffle_")}
    before = shuffled()
    table = stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "sums")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and table.count() == 10
    discard(table)
    assert not os.path.exists(table.scratch)
