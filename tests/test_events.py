import hashlib
import ipaddress
import itertools
import random

import pytest
from pyspark.sql import functions as F

from logsift.functions.address import is_ip
from logsift.operators import combine, integrity, normalize, quality, search
from logsift.operators.assemble import assemble_events
from logsift.plans.pipeline import accepted, chain_events, process_logs
from logsift.sources.files import read_log_files, split_lines


def run(spark, *logs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, raw_event string")
    return [r for r in process_logs(df, id_parts=["i"]).orderBy("i").collect()]


def test_aliases_and_values(spark):
    got = run(
        spark,
        '{"source_ip": null, "src": "1.1.1.1"}',
        '{"src": "-", "dport": 12.7, "sport": "x", "event_type": 0, "severity": true}',
        '{"userIdentity": {"principalId": "p", "arn": "a"}}', '{"user": {}}', '{"user": ["x"]}',
        '{"vendor": "", "device_vendor": "V", "device_product": "", "product": "P", "extra": {"k": 1}}',
        "CEF:0|V|P|1|9|Name|3|src=10.0.0.1 spt=99 dpt= 7 app=web",
    )
    assert got[0]["source_ip"] is None and got[0]["extensions"] == {}
    assert got[1]["source_ip"] is None and got[1]["destination_port"] == 12 and got[1]["source_port"] is None
    assert got[1]["event_type"] is None and got[1]["severity"] == "True"
    assert got[2]["user"] == "p" and got[3]["user"] is None and got[4]["user"] is None
    assert (got[5]["vendor"], got[5]["product"], got[5]["source"]) == ("V", "P", "P")
    assert got[5]["extensions"]["extra"] == '{"k":1}'
    assert got[6]["source_port"] is None and got[6]["extensions"]["spt"] == "99"
    assert got[6]["protocol"] == "web" and got[6]["application"] == "web"
    assert all(r["reject_reason"] is None for r in got)


@pytest.mark.parametrize("log, part", [
    ('{"src": "999.1.1.1"}', "source_ip"), ('{"dst": "10.0.0.01"}', "destination_ip"), ('{"dport": 70000}', "destination_port"),
    ('{"sport": "-1"}', "source_port"), ('{"dport": "99999999999999999999"}', "destination_port"), ('{"action": 5}', "action"),
    ('{"timestamp": 1700000000}', "timestamp"), ('{"confidence": 101}', "confidence"), ('{"confidence": "x"}', "confidence"),
    ("  ", "Log cannot be empty"),
])
def test_rejects(spark, log, part):
    assert run(spark, log)[0]["reject_reason"].startswith(part)


def test_addresses(spark):
    rng = random.Random(5)
    pieces = ["", "0", "1", "ffff", "12345", "g", "::", ":", ".", "1.2.3.4", "256", "01", "%eth0", "%", "255"]
    texts = {"::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::8", "::ffff:1.2.3.4", "1:2:3:4:5:6:1.2.3.4",
             "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7:8:9", "fe80::1%eth0", "fe80::1%", "1.2.3.4", "1.2.3", "1.2.3.256", " 1.2.3.4", "1.2.3.4\n"}
    for _ in range(1500):
        texts.add(rng.choice(["", ":"]).join(rng.choice(pieces) for _ in range(rng.randint(1, 9))))
        texts.add(":".join(rng.choice(["", "1", "ab", "1.2.3.4"]) for _ in range(rng.randint(2, 10))))

    def valid(t):
        try:
            ipaddress.ip_address(t)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("ok", is_ip(F.col("t"))).collect()
    assert [r["t"] for r in rows if r["ok"] != valid(r["t"])] == []


def test_quality_against_model(spark):
    ips, ports, acts = [None, "", "10.0.0.1", "10.0.0.2", "bad"], [None, 0, 80], [None, "", " ", "x"]
    cases = list(itertools.product(ips, ips, ports, ports, acts, [None, "t"]))
    cols = ["source_ip", "destination_ip", "source_port", "destination_port", "action", "timestamp"]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cases)],
        "i int, source_ip string, destination_ip string, source_port int, destination_port int, action string, timestamp string")
    for c in ("protocol", "event_type", "severity"):
        df = df.withColumn(c, F.lit(None).cast("string"))
    for c in ("event_id", "source_type", "raw_event"):
        df = df.withColumn(c, F.lit("x"))
    got = {r["i"]: r["quality"] for r in quality.quality(df).collect()}
    for i, case in enumerate(cases):
        e = dict(zip(cols, case))
        filled = sum(1 for c in cols if e[c])
        complete = round(filled / 9 * 100)
        ok = sum(e[c] != "bad" for c in cols[:2]) + sum(e[c] is None or e[c] > 0 for c in cols[2:4])
        checks = []
        if e["source_ip"] and e["destination_ip"]:
            checks.append(e["source_ip"] != e["destination_ip"])
        if e["source_port"] is not None and e["destination_port"] is not None:
            checks.append(e["source_port"] != e["destination_port"])
        if e["action"] is not None:
            checks.append(bool(e["action"].strip()))
        consistent = round(sum(checks) / len(checks) * 100) if checks else 100
        valid = round(ok / 4 * 100)
        score = round(complete * .5 + valid * .3 + consistent * .2)
        assert (got[i]["completeness"], got[i]["validity"], got[i]["consistency"], got[i]["quality_score"]) == (complete, valid, consistent, score)


ASSEMBLY = [
    ("LOG A\nLOG B\nLOG C", ["LOG A\n", "LOG B\n", "LOG C"]),
    ("2026-09-30T10:00:00Z sshd:\nFailed password\nfrom 10.20.15.44\n", ["2026-09-30T10:00:00Z sshd:\nFailed password\nfrom 10.20.15.44\n"]),
    ("2026-09-30T10:00 a\nb\n2026-09-30T10:05 c\nd\n", ["2026-09-30T10:00 a\nb\n", "2026-09-30T10:05 c\nd\n"]),
    ("LOG A\r\nLOG B\r\n", ["LOG A\r\n", "LOG B\r\n"]),
    ("LOG A\n\nLOG B\n", ["LOG A\n\n", "LOG B\n"]),
    ("LOG ENTRY\n" * 100, ["LOG ENTRY\n"] * 100),
    ('\n{\n  "key": "val"\n}\n{\n  "key2": "val2"\n}\n', ['{\n  "key": "val"\n}\n', '{\n  "key2": "val2"\n}\n']),
]


@pytest.mark.parametrize("slab", [2, 100_000])
def test_assembly(spark, slab):
    rng = random.Random(1)
    texts = [t for t, _ in ASSEMBLY]
    for _ in range(60):
        texts.append("".join(rng.choice(["  ", "x", " y z", "{a", "<b", "2024-01-01 q", "Sep 13 22:00:00 h", "[c"]) + rng.choice(["\n", "\r\n", "\x0b"])
                             for _ in range(rng.randint(1, 14))))

    def model(text):
        events, started = [], False
        for line in text.splitlines(keepends=True):
            body = line.strip()
            start = body.startswith(("{", "<", "[", "CEF:", "LEEF:", "2024-01-01", "2026-09-30", "Sep 13 22"))
            if body and (start or not started):
                events.append(line)
                started = started or start
            elif events:
                events[-1] += line
        return events

    assert [model(t) for t, _ in ASSEMBLY] == [e for _, e in ASSEMBLY]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file string, text string")
    got = {}
    for r in assemble_events(split_lines(files, "file", "text"), slab_lines=slab).orderBy("line_no").collect():
        got.setdefault(r["file"], []).append(r["raw_event"])
    assert [got.get(str(i), []) for i in range(len(texts))] == [model(t) for t in texts]


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\n\nlast")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    (tmp_path / "c.LOG").write_bytes(b" \n\t\n")
    (tmp_path / "d.log").write_bytes(b"x" * 200)
    (tmp_path / "e.csv").write_bytes(b"not read")
    lines, refused = read_log_files(spark, str(tmp_path), max_bytes=100)
    assert [r["line"] for r in lines.orderBy("line_no").collect()] == ["one\r\n", "two\n", "\n", "last"]
    assert {r["file"][-5:]: r["error"] for r in refused.collect()} == {
        "b.txt": "File must be UTF-8 encoded text", "c.LOG": "Uploaded file is empty", "d.log": "File too large"}


@pytest.fixture(scope="module")
def stored(spark):
    logs = [f"CEF:0|V|P|1|9|Name|3|src=10.0.0.{i % 9} dpt=80 act=x n={i}" for i in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(logs)], "i int, raw_event string")
    done = accepted(process_logs(df, id_parts=["i"], ingest_time=F.timestamp_seconds(F.col("i") * 1000)))
    done = done.withColumn("source_key", F.when(F.col("i") % 3 == 0, "b").otherwise("a"))
    chained = chain_events(done, "source_key", "created_at", ["i"], segment_rows=7, slab_seconds=5000)
    return chained.cache()


def test_chain_and_tampering(stored):
    rows = sorted(stored.collect(), key=lambda r: (r["chain_key"], r["chain_pos"]))
    for key in ("a", "b"):
        mine = [r for r in rows if r["chain_key"] == key]
        assert [r["i"] for r in mine] == sorted(r["i"] for r in mine)
        previous = ""
        for at, r in enumerate(mine):
            previous = "" if at % 7 == 0 else previous
            assert (r["previous_hash"] or "") == previous and r["chain_segment"] == at // 7
            previous = hashlib.sha256((previous + r["raw_event"]).encode()).hexdigest()
            assert r["chain_hash"] == previous
    clean = integrity.verify(stored)
    assert clean.filter("tamper_detected").count() == 0
    assert integrity.verify(stored.withColumn("severity", F.lit("9"))).filter("normalized_verified").count() == 0
    raw = integrity.verify(stored.withColumn("raw_event", F.lit("z")))
    assert raw.filter("hash_verified OR chain_verified").count() == 0 and raw.filter("normalized_verified").count() == 60
    old = stored.withColumn("normalized_hash", F.lit(None).cast("string")).withColumn("hash_version", F.lit(1))
    assert integrity.verify(old).filter("tamper_detected").count() == 0
    assert integrity.verify_linkage(stored, ["chain_key"]).filter("NOT linked").count() == 0
    gap = stored.filter("chain_pos != 3")
    assert integrity.verify_linkage(gap, ["chain_key"]).filter("NOT linked").count() == 2
    heads = integrity.seal_segments(stored, ["chain_key"], 3).orderBy("chain_key", "segment").collect()
    assert len(heads) == 9 and heads[0]["seal"] == hashlib.sha256(heads[0]["head"].encode()).hexdigest()
    assert heads[1]["seal"] == hashlib.sha256((heads[0]["seal"] + heads[1]["head"]).encode()).hexdigest()


def test_search_and_upsert(stored):
    found = search.search_events(stored, q="10.0.0.3", page=1, page_size=4, parser="cef")
    assert found.total.first()["total"] == 7 and found.items.count() == 4
    words = search.search_events(stored.withColumn("event_type", F.lit("Name")), q="Name", page=2, page_size=25)
    assert words.total.first()["total"] == 60 and words.items.count() == 25
    twice = stored.unionByName(stored.withColumn("created_at", F.lit("2030-01-01").cast("timestamp")).withColumn("action", F.lit("new")))
    kept = combine.upsert_events(twice, ["created_at"])
    assert kept.count() == 60 and kept.filter("action = 'new'").count() == 60


def test_ids_repeat(spark):
    df = spark.createDataFrame([("f", 1, "x"), ("f", 2, "x")], "file string, pos int, raw_event string")
    a, b = [[r["event_id"] for r in normalize.assign_event_id(df, "file", "pos", "raw_event").collect()] for _ in range(2)]
    assert a == b and a[0] != a[1] and a[0].startswith("EVT-")


def test_large_file_in_many_splits(spark, tmp_path):
    """Over 5 MB, cut into splits, with every kind of line end and none at the end of the file."""
    ends = ["\n", "\r\n", "\r", "\x0b", "\x1c", "\u2028"]
    text = "".join(f"line {i} é{'x' * (i % 90)}{ends[i % 7 % 6]}" for i in range(90_000)) + "last"
    assert len(text.encode()) > 5 << 20
    (tmp_path / "big.log").write_bytes(text.encode())
    (tmp_path / "small.txt").write_bytes(b"one\r\n\r\ntwo\r")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500k")
    try:
        lines, refused = read_log_files(spark, str(tmp_path))
        got = {}
        for r in lines.collect():
            got.setdefault(r.file.rsplit("/", 1)[1], []).append((r.line_no, r.line))
        assert refused.count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x for _, x in sorted(got["big.log"])] == text.splitlines(keepends=True)
    assert [n for n, _ in sorted(got["big.log"])] == list(range(1, len(got["big.log"]) + 1))
    assert sorted(got["small.txt"]) == [(1, "one\r\n"), (2, "\r\n"), (3, "two\r")]


def test_storage_time_stands_in_for_a_missing_time(spark):
    rows = [(f"e{i}", f"<42>Feb  3 04:05:{i:02d} barn7 src=198.51.100.9 act=login_failed") for i in range(8)]
    logs = spark.createDataFrame([*rows, ("c", "CEF:0|Orchard|Lantern|4.2|77|Door|3|src=198.51.100.7"), ("j", '{"src": "198.51.100.7", "time": "2030-01-01T00:00:00Z"}')], "event_id string, raw_event string")
    done = process_logs(logs, ingest_time=F.to_timestamp(F.lit("2031-01-15 00:00:00")))
    got = {r.event_id: r.event_ts for r in done.collect()}
    assert str(got["e3"]) == "2030-02-03 04:05:03" and got["c"] is None and str(got["j"]) == "2030-01-01 00:00:00"
    from logsift.operators.risk import analyze
    from logsift.session import new_folder
    path = new_folder(spark, "events")
    accepted(done).write.parquet(path)
    found = {r.event_id: r for r in analyze(spark.read.parquet(path)).collect()}
    assert "repeated_failed_login" in found["e7"].detections and str(found["c"].timestamp) == "2031-01-15 00:00:00"


def test_ids_need_something_that_tells_logs_apart(spark):
    with pytest.raises(ValueError):
        process_logs(spark.createDataFrame([("x",)], "raw_event string"))


def test_long_events_are_put_together_from_pieces(spark):
    rows, want = [], []
    for f, n in (("a", 1), ("b", 700), ("c", 33)):
        lines = [f"{{ {f}\n"] + [f"  at {i}\n" if i % 50 else " \n" for i in range(n)] + ["[second\r\n", "  end"]
        rows += [(f, i + 1, line) for i, line in enumerate(lines)]
        want += [(f, 1, n + 1, "".join(lines[:-2])), (f, n + 2, 2, "[second\r\n  end")]
    lines = spark.createDataFrame(rows, "file string, line_no int, line string").repartition(5)
    for slab, piece in ((40, 7), (100, 1000), (13, 1)):
        got = assemble_events(lines, slab_lines=slab, piece_lines=piece)
        assert sorted((r.file, r.line_no, r.line_count, r.raw_event) for r in got.collect()) == sorted(want)


def test_batches_are_split_into_accepted_and_blank(spark):
    from logsift.operators.parse import split_batch

    rows = [("r1", "log a"), ("r1", " \t"), ("r1", None), ("r2", ""), ("r2", "　"), ("r3", "x"), ("r3", "x")]
    kept, blank = split_batch(spark.createDataFrame(rows, "request_id string, raw_event string"))
    assert sorted(map(tuple, kept.select("request_id", "raw_event").collect())) == [("r1", "log a"), ("r3", "x"), ("r3", "x")]
    assert blank.count() == 4 and kept.count() + blank.count() == len(rows)
