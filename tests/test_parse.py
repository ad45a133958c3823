import pytest

from logsift.operators.classify import check_format, classify_format, detect_format, suggest_mappings
from logsift.operators.formats import FormatRegistry, FormatSpec, default_registry, parsed, python_format
from logsift.operators.parse import parse_as, parse_logs
from pyspark.sql import functions as F

LOGS = {
    "json": '{"src": "198.51.100.7", "dst": "203.0.113.9", "act": "permit", "sev": "major"}',
    "list": "[7, 8]",
    "json_tail": '{"q": 4} rest',
    "json_two": '{"q": 4},{"r": 5}',
    "json_same": '{"a": 1, "a": 2}',
    "json_deep": '{"a": {"b": 1, "b": 2}, "src": "198.51.100.8"}',
    "cef": "CEF:0|Orchard|Lantern|4.2|77|Door left open|3|src=198.51.100.20 dst=203.0.113.5 spt=4021 dpt=8443 act=held",
    "cef_bad": "CEF:0|Orchard",
    "leef": "LEEF:2.0|Orchard|Fence|2.6|gate-9|src=198.51.100.31\tdst=203.0.113.6\tsport=40100\tdport=990\tproto=UDP\tact=pass\tsev=minor",
    "leef_tab": "LEEF:1.0|Orchard|Fence|2.5|Knock\tsrc=198.51.100.32\tdst=203.0.113.7\tact=pass",
    "leef_caret": 'LEEF:2.0|V|P|1|7|^|a=1^b="2"^c = 3',
    "leef_hex": "LEEF:2.0|V|P|1|7|0x7c|a=1|b=2",
    "leef_bad": "LEEF:only one part",
    "syslog": "<42>Feb  3 04:05:06 barn7 src=198.51.100.40 dst=203.0.113.8 sport=7001 dport=7002 action=pass",
    "xml": "<note><src>198.51.100.50</src><dst>203.0.113.10</dst><action>hold</action></note>",
    "xml_win": '<Event><System><EventID>8101</EventID><TimeCreated SystemTime="2031-02-03T04:05:06Z"/></System><EventData><Data Name="TargetUserName">mira</Data><Data Name="IpAddress">198.51.100.51</Data></EventData></Event>',
    "xml_bad": "<open><in>x</open>",
    "csv": 'timestamp,src,msg\n"2031-02-03T04:05:06Z","198.51.100.60","Hatch closed, lamp lit"',
    "csv_order": "action,destination_ip,source_ip,destination_port\npass,203.0.113.11,198.51.100.61,6514",
    "csv_pairs": "a=1,b=2, c = x=y",
    "csv_numbers": "5,6\n7,8",
    "asa": '%ASA-5-304001: Deny udp src yard:198.51.100.70/6000 dst cellar:203.0.113.12/6001 by access-group "hedge"',
    "windows": '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Cellar" /><EventID>8102</EventID><TimeCreated SystemTime="2031-02-03T04:05:07Z" /><Computer>ATTIC3</Computer></System><EventData><Data Name="TargetUserName">mira</Data><Data Name="IpAddress">198.51.100.80</Data><Data Name="IpPort">6100</Data></EventData></Event>',
    "windows_bad": '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System>',
    "unknown": "nothing to see at the mill",
    "blank": " \t ",
}


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(list(LOGS.items()), "name string, raw_event string")


@pytest.fixture(scope="module")
def rows(logs):
    return {r["name"]: r for r in parse_logs(logs).collect()}


def test_format_and_status(rows):
    want = {
        "json": "json", "list": None, "json_tail": None, "json_two": None, "json_same": "json", "json_deep": "json", "cef": "cef",
        "cef_bad": "cef", "leef": "leef", "leef_tab": "leef", "leef_caret": "leef", "leef_hex": "leef",
        "leef_bad": "leef", "syslog": "syslog", "xml": "xml", "xml_win": "xml", "xml_bad": None, "csv": "csv",
        "csv_order": "csv", "csv_pairs": "csv", "csv_numbers": None, "asa": "cisco_asa",
        "windows": "windows_event", "windows_bad": "windows_event", "unknown": None, "blank": None,
    }
    assert {k: r["parser"] for k, r in rows.items()} == want
    for name, row in rows.items():
        status = "error" if name in ("cef_bad", "leef_bad") else "unknown" if want[name] is None else "success"
        assert row["parse_status"] == status, name
        assert row["raw_event"] == LOGS[name]


@pytest.mark.parametrize("name, fields", [
    ("json", {"src": "198.51.100.7", "sev": "major", "source_type": "json"}),
    ("json_same", {"a": "2"}),
    ("json_deep", {"a": '{"b":2}', "src": "198.51.100.8"}),
    ("cef", {"event_name": "Door left open", "severity": "3", "spt": "4021", "act": "held"}),
    ("cef_bad", {"error": "Invalid CEF format", "source_type": "unknown"}),
    ("leef", {"vendor": "Orchard", "product": "Fence", "event_id": "gate-9", "src": "198.51.100.31", "sev": "minor"}),
    ("leef_tab", {"event_id": "Knock", "src": "198.51.100.32", "act": "pass"}),
    ("leef_caret", {"a": "1", "b": "2", "c": "3"}),
    ("leef_hex", {"a": "1", "b": "2"}),
    ("syslog", {"priority": "42", "timestamp": "Feb  3 04:05:06", "source": "barn7", "dport": "7002"}),
    ("xml", {"source_ip": "198.51.100.50", "destination_ip": "203.0.113.10", "action": "hold"}),
    ("xml_win", {"EventID": "8101", "SystemTime": "2031-02-03T04:05:06Z", "TargetUserName": "mira", "source_ip": "198.51.100.51"}),
    ("csv", {"msg": "Hatch closed, lamp lit", "source_ip": "198.51.100.60"}),
    ("csv_order", {"destination_port": "6514", "source_ip": "198.51.100.61"}),
    ("csv_pairs", {"a": "1", "c": "x=y"}),
    ("asa", {"severity": "5", "event_type": "304001", "action": "Deny", "source_port": "6000", "destination_ip": "203.0.113.12"}),
    ("windows", {"event_type": "8102", "source_port": "6100", "user": "mira", "hostname": "ATTIC3"}),
    ("windows_bad", {"source_type": "windows:eventlog", "vendor": "Microsoft"}),
])
def test_fields(rows, name, fields):
    got = rows[name]["parsed"]
    assert {k: got.get(k) for k in fields} == fields


def test_registry_order_and_switches(spark, logs):
    names = ["json", "aws_cloudtrail", "cisco_asa", "windows_event", "cef", "leef", "syslog", "xml", "csv"]
    registry = default_registry()
    assert registry.names() == names
    with pytest.raises(ValueError):
        registry.register(registry.get("json"))
    with pytest.raises(KeyError):
        registry.disable("none")
    registry.disable("windows_event")
    got = {r["name"]: r["parser"] for r in parse_logs(logs, registry).select("name", "parser").collect()}
    assert got["windows"] == "xml" and got["windows_bad"] is None
    assert "windows_event" in registry.enable("windows_event").names()
    assert parse_as(logs, "cef").filter("parser IS NOT NULL").count() == 2


def test_own_formats(logs):
    def broken(_text):
        raise RuntimeError("no")

    registry = FormatRegistry([
        python_format("breaks", 1, broken, dict),
        python_format("fails", 2, lambda t: t.startswith("nothing"), broken),
        python_format("mine", 3, lambda t: t.startswith("[7"), lambda t: {"first": t[1]}, "2.0"),
        FormatSpec("column", 4, lambda v: F.contains(v.text, F.lit("ASA")), lambda v: parsed(F.create_map(F.lit("k"), F.lit("v")))),
    ])
    got = {r["name"]: r for r in parse_logs(logs, registry).filter("parser IS NOT NULL").collect()}
    assert set(got) == {"unknown", "list", "asa"}
    assert got["unknown"]["parse_status"] == "error" and got["unknown"]["parse_error"] == "no"
    assert got["list"]["parsed"] == {"first": "7"} and got["list"]["parser_version"] == "2.0"
    assert got["asa"]["parsed"] == {"k": "v"}


def test_native_formats_need_no_python(logs):
    registry = default_registry().disable("xml").disable("windows_event")
    plan = parse_logs(logs, registry)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


@pytest.mark.parametrize("log, fmt, low", [
    ('{"src_ip": "198.51.100.7", "action": "pass"}', "json", .95),
    ('{"Records": [{"eventVersion": "9.1"}]}', "aws_cloudtrail", .95),
    ("<42>Feb 03 04:05:06 barn7 door: mira could not open /hatch", "syslog", .8),
    ("CEF:0|Orchard|Lantern|4.2|77|Door|3|src=198.51.100.7 dst=203.0.113.5", "cef", .9),
    ("LEEF:1.0|Orchard|Fence|2.5|9|src=198.51.100.7", "leef", .9),
    ('<Event><System><Provider Name="Q"/></System></Event>', "xml", .8),
    ("2031-02-03,198.51.100.7,203.0.113.5,6514,pass", "csv", .7),
    ("The miller counts sacks at noon", "unknown", 0.0),
    ("<42>z %ASA-5-3: w", "cisco_asa", .95),
])
def test_classify(spark, log, fmt, low):
    got = classify_format(spark.createDataFrame([(log,)], "raw_event string")).first()["classification"]
    assert got["format"] == fmt and got["confidence"] >= low
    off = classify_format(spark.createDataFrame([(log,)], "raw_event string"), enabled=False).first()["classification"]
    assert off["format"] == "unknown" and "disabled" in off["reasons"][0]


def test_checks_and_mappings(spark, logs):
    guess = {r["name"]: r["format_result"] for r in detect_format(logs).collect()}
    assert guess["leef"]["suggested_format"] == "vendor-key-value" and guess["blank"]["status"] == "invalid"
    known = {r["name"]: r["format_result"] for r in check_format(parse_logs(logs)).collect()}
    assert known["cef"]["format"] == "cef" and known["leef"]["format"] == "unknown"
    one = spark.createDataFrame([("src_ip=10.0.0.1 dst_port=443 act=blocked",)], "raw_event string")
    found = {s["target_field"]: s["source_field"] for s in suggest_mappings(one).first()["suggestions"]}
    assert found == {"source_ip": "src_ip", "destination_ip": "dst_port", "destination_port": "dst_port", "action": "act"} or (
        found["source_ip"] == "src_ip" and found["destination_port"] == "dst_port" and found["action"] == "act")
