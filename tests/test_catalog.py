"""A sample of the registered queries against DuckDB; `check.py` runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, canonical
from logsift.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", [
    "process_logs", "analyze", "chain_hash", "assemble_events", "classify_documents", "detect_parser_documents",
    "suggest_mappings", "streaming_rules", "streaming_chain", "stream_events", "streaming_rate_anomaly", "read_csv_events",
    "analyze_logs", "chain_two_batches", "verify_chain", "read_log_files",
])
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toArrow().to_pandas(integer_object_nulls=True)
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas(integer_object_nulls=True)
    a, b = canonical(got), canonical(want)
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    assert a.fillna("\0").equals(b.fillna("\0"))


def test_every_query_is_checked():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
