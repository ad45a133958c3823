"""What grows with the tables: tasks and batches."""

import glob
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from logsift.functions import xmlmap
from logsift.functions.text import is_blank
from logsift.operators.integrity import canonical_json
from logsift.plans import catalog, derive
from logsift.plans.pipeline import process_logs
from logsift.session import checkpoint_root, new_folder
from logsift.sources.tables import parts_of


@pytest.fixture(scope="module")
def one_row_group(spark, tmp_path_factory):
    """A table whose reader makes many splits, one of which holds all rows."""
    folder = tmp_path_factory.mktemp("events")
    rows = spark.range(20_000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), (F.col("id") % 50).alias("user_id"), F.lit("error").alias("event_type"),
                                      F.rand(1).alias("value"), F.sha2(F.col("id").cast("string"), 256).alias("props"))
    pq.write_table(rows.toArrow(), folder / "events.parquet", row_group_size=1_000_000)
    return str(folder)


def test_logs_are_dealt_out_whatever_the_row_groups(spark, one_row_group):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert spark.read.parquet(f"{one_row_group}/events.parquet").rdd.getNumPartitions() > 8
        logs = derive.logs(spark, one_row_group, "xml").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sum(r["count"] for r in logs) == 20_000 and len(logs) >= 4 and max(r["count"] for r in logs) < 7_000


def test_tasks_grow_with_the_table(spark, one_row_group):
    events = spark.read.parquet(f"{one_row_group}/events.parquet")
    assert parts_of(events) == 4 and parts_of(events, 10_000) > 100


def test_xml_maps_are_arrow_arrays():
    texts = pa.array([None, "<e k='1'><src>10.0.0.1</src><n><p>tcp</p></n></e>", "<bad", "<e/>", None])
    got = xmlmap._maps(texts, xmlmap.flatten).to_pylist()
    assert [g is None for g in got] == [True, False, True, False, True]
    assert {"k": "1", "src": "10.0.0.1", "source_ip": "10.0.0.1", "p": "tcp", "n": '{"p": "tcp"}', "source_type": "xml"}.items() <= dict(got[1]).items()
    assert [len(g) for g in xmlmap._maps(pa.array(["<Event/>", "<bad"]), xmlmap.windows_event).to_pylist()] == [0, 0]
    assert xmlmap._maps(pa.array([], pa.string()), xmlmap.flatten).to_pylist() == []


def test_a_stream_is_dealt_out(spark, one_row_group):
    tasks = []
    running = catalog._stream(spark, one_row_group).writeStream.foreachBatch(
        lambda batch, _: tasks.append([r["count"] for r in batch.groupBy(F.spark_partition_id()).count().collect()])
    ).option("checkpointLocation", new_folder(spark, "dealt")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert len(tasks) == 1 and sum(tasks[0]) == 20_000 and len(tasks[0]) >= 4 and max(tasks[0]) < 7_000


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("f"), F.col("id") % 100).alias("file"), F.col("id").alias("line_no"), F.col("id").cast("string").alias("text"))
    catalog._write_files(rows, str(tmp_path / "files"), 16)
    written = glob.glob(str(tmp_path / "files/file=*/part-*.txt"))
    assert len(written) == 100 and len({f.rsplit("/part-")[1][:5] for f in written}) > 8
    for f in written:
        k = int(f.split("file=f")[1].split("/")[0])
        with open(f) as text:
            assert [int(line) for line in text] == list(range(k, 3000, 100))


def test_an_arriving_batch_is_many_files(spark):
    rows = spark.range(6000).select("id", F.timestamp_seconds(F.col("id") * 7 % 6000).alias("event_ts"))
    batches = []

    def seen(batch, _number):
        got = batch.agg(F.count("*").alias("n"), F.min("event_ts").alias("a"), F.max("event_ts").alias("z")).first()
        batches.append(got)

    files = lambda: set(glob.glob(checkpoint_root(spark) + "/arriving-*/*.parquet"))
    there = files()
    stream = catalog._arriving(spark, rows, file_rows=300)
    assert len(files() - there) in (12, 18)
    stream.writeStream.foreachBatch(seen).option("checkpointLocation", new_folder(spark, "seen")).trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 6 and sum(b.n for b in batches) == 6000
    assert all(a.z < b.a for a, b in zip(batches, batches[1:]))
    few = catalog._arriving(spark, rows.where("id < 3"), file_rows=300)
    assert few.isStreaming


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_log_is_cut_once_and_a_field_read_once(spark):
    """A header was cut again for each of its parts, a field's map searched again for each test of the field."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    logs = spark.createDataFrame([("1", "LEEF:1.0|Acme|Gate|3.1|x|src=1.1.1.1\tspt=7")], "event_id string, raw_event string")
    done = process_logs(logs)
    plan = _plan(done)
    assert plan.count("[|], -1)") == 1 and plan.count("[|], 8)") == 1
    assert len(re.findall(r"parsed#\d+\[_k#\d+\.source_port\]", plan)) == 1
    assert done.first().source_ip == "1.1.1.1"


def test_blank_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), (" \t",), ("\u2003\u00a0",), ("a",), (" \u00e9 ",), ("\u200b",)], "t string")
    assert [r[0] for r in rows.select(is_blank(F.col("t"))).collect()] == [True, True, True, True, False, False, False]


def test_two_searches_parse_the_logs_once(spark):
    """The two halves of a union each had the whole parse in them."""
    plan = _plan(catalog.QUERIES["filter_events"](spark, "/root/testdata/sf0.001"))
    assert plan.count("Relation [") == 2 and "xml_map" not in plan and "props" not in plan


def test_hashed_maps_are_sorted_without_a_lambda(spark):
    rows = spark.createDataFrame([("1", {"b": "2", "a": None, "ab": "1"}), ("2", {}), ("3", None)], "event_id string, extensions map<string,string>")
    out = rows.select("event_id", canonical_json(rows).alias("j"))
    assert "lambda" not in _plan(out)
    assert [r.j for r in out.orderBy("event_id").collect()] == [
        '{"event_id":"1","extensions":{"a":null,"ab":"1","b":"2"}}', '{"event_id":"2","extensions":{}}', '{"event_id":"3","extensions":null}']
