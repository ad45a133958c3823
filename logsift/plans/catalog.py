"""The registered queries: each reads the given tables through the library's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from logsift import fixed
from logsift.operators import aggregates, assemble, classify, combine, display, integrity, normalize, parse, quality
from logsift.operators import risk, rules, seals, search
from logsift.operators.anomaly import AnomalySettings, rate_anomaly
from logsift.operators.formats import default_registry
from logsift.operators.late import flag_late
from logsift.plans import checks, derive
from logsift.plans.pipeline import accepted, analyze_logs, chain_events, process_logs
from logsift.session import configure, new_folder, quick_checkpoints, stored
from logsift.sinks.forward import forward, payloads_of, read_receipts, register_forward
from logsift.sinks.tables import replace_events, write_analytics, write_events
from logsift.sources import files
from logsift.sources.envelope_log import append_envelopes
from logsift.sources.queue import stream_logs
from logsift.sources.tables import parts_of, read_analytics, read_events, spread
from logsift.streaming.keyed import streaming_rate_events, streaming_rules
from logsift.streaming.pipeline import once, start_pipeline, with_analytics
from logsift.streaming.stateful import start_chain, start_rate_anomaly, start_rules, streaming_chain

# Thresholds under which the sparse events table has rows on both sides.
LOGIN, LOGIN_S, SPIKE, SPIKE_S, BUCKET, Z = 3, 3 * 86400, 12, 3 * 86400, 3600, 2.5
RULES = rules.RuleSettings(LOGIN, LOGIN_S, SPIKE, SPIKE_S, slab_seconds=3600)
ANOMALY = AnomalySettings(bucket_seconds=BUCKET, zscore=Z)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under `name`, with the SQL that gives the same rows."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def joined(c: str | Column, sep: str = ",") -> Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


# --- detection ----------------------------------------------------------------------------

@query("detect_parser", f"WITH {checks.typed('mixed')} SELECT event_id, parser FROM typed")
def detect_parser(spark, d):
    return parse.detect_parser(derive.logs(spark, d)).select("event_id", "parser")


def _text_table(name: str, key: str, raw: str) -> str:
    return f"WITH {checks.texts(name, key, raw)}, csv AS ({checks.CSV_PREP})"


@query("detect_parser_documents", f"{_text_table('documents', 'doc_id', 'text')} SELECT event_id AS doc_id, {checks.DETECT} AS parser FROM csv")
def detect_parser_documents(spark, d):
    return parse.detect_parser(table(spark, d, "documents"), raw="text").select("doc_id", "parser")


@query("detect_parser_registry", f"WITH {checks.typed('mixed')} SELECT event_id, CASE WHEN parser = 'json' THEN CASE WHEN contains(coalesce(t->>'$.Records[0].eventSource', ''), 'amazonaws.com') THEN 'aws_cloudtrail' END WHEN parser = 'cisco_asa' THEN NULL WHEN parser = 'csv' THEN NULL ELSE parser END AS parser FROM typed")
def detect_parser_registry(spark, d):
    """Formats switched off by configuration; CloudTrail is no longer hidden by JSON."""
    registry = default_registry().disable("json").disable("cisco_asa").unregister("csv")
    return parse.detect_parser(derive.logs(spark, d), registry).select("event_id", "parser")


def _check_out(df: DataFrame, key: str) -> DataFrame:
    r = lambda f: F.col(f"format_result.{f}").alias(f)
    return df.select(key, *[r(f) for f in ("status", "supported", "format", "confidence", "suggested_format", "reason")],
                     joined(F.col("format_result.candidates.format")).alias("candidates"))


for _name, _key, _raw in (("documents", "doc_id", "text"), ("pages", "page_id", "html")):
    @query(f"detect_format_{_name}", f"WITH {checks.texts(_name, _key, _raw)}, {checks.check_sql()} SELECT event_id AS {_key}, {checks.CHECK_OUT} FROM guess")
    def detect_format_text(spark, d, _name=_name, _key=_key, _raw=_raw):
        return _check_out(classify.detect_format(table(spark, d, _name), _raw), _key)


@query("detect_format", f"WITH {checks.logs('mixed')}, {checks.check_sql()} SELECT event_id, {checks.CHECK_OUT} FROM guess")
def detect_format(spark, d):
    return _check_out(classify.detect_format(derive.logs(spark, d)), "event_id")


@query("check_format", f"""WITH {checks.typed('mixed')}, {checks.check_sql().replace('FROM texts', 'FROM typed')}, out AS (SELECT event_id, parser, {checks.CHECK_OUT} FROM guess)
  SELECT event_id, CASE WHEN parser IN ('syslog', 'json', 'cef') THEN 'supported' ELSE status END AS status, CASE WHEN parser IN ('syslog', 'json', 'cef') THEN true ELSE supported END AS supported,
  CASE WHEN parser IN ('syslog', 'json', 'cef') THEN parser ELSE format END AS format, CASE WHEN parser IN ('syslog', 'json', 'cef') THEN 1.0::DOUBLE ELSE confidence END AS confidence,
  CASE WHEN parser IN ('syslog', 'json', 'cef') THEN NULL ELSE suggested_format END AS suggested_format, CASE WHEN parser IN ('syslog', 'json', 'cef') THEN {checks.q(fixed.REASON_PARSER_KNOWN)} ELSE reason END AS reason,
  CASE WHEN parser IN ('syslog', 'json', 'cef') THEN parser ELSE candidates END AS candidates FROM out""")
def check_format(spark, d):
    return _check_out(classify.check_format(parse.detect_parser(derive.logs(spark, d))), "event_id")


def _class_out(df: DataFrame, *keys: str) -> DataFrame:
    c = lambda f: F.col(f"classification.{f}")
    return df.select(*keys, c("format").alias("format"), F.round(c("confidence"), 6).alias("confidence"),
                     joined(c("reasons"), "; ").alias("reasons"), joined(c("matched_patterns")).alias("patterns"),
                     c("suggested_parser").alias("suggested_parser"))


@query("classify_format", f"WITH {checks.logs('mixed')}, {checks.classify_sql()} SELECT event_id, {checks.CLASS_OUT} FROM classed")
def classify_format(spark, d):
    return _class_out(classify.classify_format(derive.logs(spark, d)), "event_id")


for _name, _key, _raw in (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text")):
    _more, _keys = (", turn", [_key, "turn"]) if _name == "conversations" else ("", [_key])

    @query(f"classify_{_name}", f"WITH {checks.texts(_name, _key, _raw, _more)}, {checks.classify_sql()} SELECT event_id AS {_key}{_more}, {checks.CLASS_OUT} FROM classed")
    def classify_text(spark, d, _name=_name, _keys=_keys, _raw=_raw):
        return _class_out(classify.classify_format(table(spark, d, _name), _raw), *_keys)


@query("unknown_report", f"WITH {checks.typed('mixed')}, unknown AS (SELECT * FROM typed WHERE parser IS NULL), {checks.classify_sql('unknown')} SELECT event_id, {checks.CLASS_OUT} FROM classed")
def unknown_report(spark, d):
    out = classify.unknown_report(parse.parse_logs(derive.logs(spark, d)))
    return _class_out(out.filter("parser IS NULL"), "event_id")


# --- parsing ------------------------------------------------------------------------------

def _parsed(spark, d, kind: str, fields: dict[str, str], spec: str | None = None) -> DataFrame:
    out = parse.parse_as(derive.logs(spark, d, kind), spec or kind)
    return out.select("event_id", "parser", "parse_status",
                      *[F.col("parsed")[key].alias(name) for name, key in fields.items()])


def _parse_sql(kind: str, prep: str, ok: str, match: str, fields: dict[str, str]) -> str:
    cols = ", ".join(f"CASE WHEN {match} AND {ok} THEN {sql} END AS {name}" for name, sql in fields.items())
    return (f"WITH {checks.logs(kind)}, typed AS (SELECT *, '{kind}' AS parser FROM csv) SELECT event_id, CASE WHEN {match} THEN '{kind}' END AS parser, "
            f"CASE WHEN NOT ({match}) THEN 'unknown' WHEN {ok} THEN 'success' ELSE 'error' END AS parse_status, {cols} FROM ({prep})")


def _pairs_sql(text: str, source: str) -> str:
    kv = checks.q(checks.KV)
    return (f"SELECT *, regexp_extract_all({text}, {kv}, 1) AS k, list_transform(regexp_extract_all({text}, {kv}, 2), "
            f"lambda x: trim(x, '\"')) AS v FROM ({source})")


_CEF = {"cef_version": "a[1]", "device_vendor": "a[2]", "device_product": "a[3]", "device_version": "a[4]",
        "signature_id": "a[5]", "event_name": "a[6]", "severity": "a[7]", **{k: checks.last(k) for k in ("src", "dst", "spt", "dpt", "act", "msg", "duser")}}


@query("parse_cef", _parse_sql(
    "cef", _pairs_sql("array_to_string(a[8:], '|')", "SELECT *, string_split(substr(t, 5), '|') AS a FROM typed"),
    "len(a) >= 8", "starts_with(t, 'CEF:')", _CEF))
def parse_cef(spark, d):
    return _parsed(spark, d, "cef", {k: k for k in _CEF})


_LEEF = {"leef_version": "a[1]", "vendor": "a[2]", "device_product": "a[3]", "version": "a[4]",
         "leef_event": "split_part(a[5], chr(9), 1)", **{k: checks.last(k) for k in ("src", "dst", "sport", "dport", "act")}}
_LEEF_PREP = checks.parse_parts()["leef"].split(" FROM (", 1)[1].rsplit(") WHERE true", 1)[0]


@query("parse_leef", _parse_sql("leef", _LEEF_PREP, "len(a) >= 5", "starts_with(t, 'LEEF:')", _LEEF))
def parse_leef(spark, d):
    return _parsed(spark, d, "leef", {k: ("event_id" if k == "leef_event" else k) for k in _LEEF})


_ST = checks.SYSLOG_TIME
_SYSLOG = {
    "priority": f"CAST(CAST(regexp_extract(t, '^<(\\d+)>', 1) AS INT) AS VARCHAR)",
    "log_time": f"nullif(regexp_extract(t, {checks.q('^<' + checks.DIGIT + '+>(' + _ST + ')')}, 1), '')",
    "log_source": f"nullif(regexp_extract(t, {checks.q('^<' + checks.DIGIT + '+>' + _ST + '[' + checks.SPACE + ']+([^' + checks.SPACE + ']+)')}, 1), '')",
    **{k: checks.last(k) for k in ("src", "dst", "dport", "act", "user")},
}


@query("parse_syslog", _parse_sql("syslog", _pairs_sql("t", "SELECT * FROM typed"), "true", checks.IS_SYSLOG, _SYSLOG).replace(
    checks.last("user") + " END AS user", checks.last("user") + " END AS user_name"))
def parse_syslog(spark, d):
    names = {"log_time": "timestamp", "log_source": "source"}
    out = _parsed(spark, d, "syslog", {k: names.get(k, k) for k in _SYSLOG})
    return out.withColumnRenamed("user", "user_name")


_JSON = {"src": "t->>'$.src'", "source_ip": "t->>'$.source_ip'", "dst": "t->>'$.dst'", "dport": "t->>'$.dport'",
         "sport": "t->>'$.sport'", "event_name": "t->>'$.eventName'", "action": "t->>'$.action'", "ok": "t->>'$.ok'",
         "user_id_name": "t->>'$.userIdentity.userName'", "k": "t->>'$.k'", "vendor": "t->>'$.vendor'"}


@query("parse_json", _parse_sql("json", "SELECT * FROM typed", "true", checks.IS_JSON, _JSON))
def parse_json(spark, d):
    out = parse.parse_as(derive.logs(spark, d, "json"), "json")
    p = F.col("parsed")
    named = {"event_name": p["eventName"], "user_id_name": F.get_json_object(p["userIdentity"], "$.userName")}
    return out.select("event_id", "parser", "parse_status", *[named.get(k, p[k]).alias(k) for k in _JSON])


_CSV = {k: checks.last(k) for k in ("timestamp", "src", "dst", "dport", "msg", "act")}
_CSV["source_ip"] = f"coalesce({checks.last('source_ip')}, {checks.last('src')})"
_CSV["action"] = checks.last("act")
_CSV_KV = checks.parse_parts()["csv"].split(" FROM (", 1)[1].rsplit(") WHERE true", 1)[0]


@query("parse_csv", _parse_sql("csv", _CSV_KV, "true", checks.IS_CSV, _CSV).replace(" AS timestamp,", " AS log_time,"))
def parse_csv(spark, d):
    return _parsed(spark, d, "csv", {("log_time" if k == "timestamp" else k): k for k in _CSV})


_ASA_FIELDS = ["severity", "event_type", "action", "source_ip", "source_port", "destination_ip", "destination_port"]


@query("parse_cisco_asa", f"WITH {checks.typed('cisco_asa')}, p AS ({checks.parse_parts()['cisco_asa']}) SELECT event_id, parser, parse_status, {', '.join(_ASA_FIELDS)}, "
       f"trim(regexp_extract(t, '%ASA-\\d-\\d+:([^\\n]*)', 1)) AS message FROM p")
def parse_cisco_asa(spark, d):
    out = parse.parse_as(derive.logs(spark, d, "cisco_asa"), "cisco_asa")
    return out.select("event_id", "parser", "parse_status", *[F.col("parsed")[k].alias(k) for k in _ASA_FIELDS],
                      F.col("plugin_data")["cisco_message"].alias("message"))


_R = "t->>'$.Records[0]."
_TRAIL = {
    "log_time": _R + "eventTime'", "event_type": _R + "eventName'", "action": "'API_CALL'", "source_ip": _R + "sourceIPAddress'",
    "user_name": f"coalesce(nullif({_R}userIdentity.principalId', ''), {_R}userIdentity.userName')", "application": _R + "userAgent'",
    "severity": f"CASE WHEN nullif({_R}errorCode', '') IS NULL THEN 'INFO' ELSE 'ERROR' END", "region": _R + "awsRegion'", "request": _R + "requestID'",
}


@query("parse_cloudtrail", _parse_sql("aws_cloudtrail", "SELECT * FROM typed", "true", f"contains({_R}eventSource', 'amazonaws.com')", _TRAIL))
def parse_cloudtrail(spark, d):
    out = parse.parse_as(derive.logs(spark, d, "aws_cloudtrail"), "aws_cloudtrail")
    p, x = F.col("parsed"), F.col("plugin_data")
    named = {"log_time": p["timestamp"], "user_name": p["user"], "region": x["awsRegion"], "request": x["requestID"]}
    return out.select("event_id", "parser", "parse_status", *[named.get(k, p[k]).alias(k) for k in _TRAIL])


@query("cloudtrail_all_records", f"""WITH {checks.logs('aws_cloudtrail')} SELECT event_id, CAST(i AS INT) AS record_pos, t->>('$.Records[' || i || '].eventName') AS event_type,
  t->>('$.Records[' || i || '].sourceIPAddress') AS source_ip FROM texts, unnest(range(CAST(json_array_length(t, '$.Records') AS BIGINT))) AS u(i)""")
def cloudtrail_all_records(spark, d):
    out = parse.explode_cloudtrail(derive.logs(spark, d, "aws_cloudtrail"))
    return out.select("event_id", "record_pos", F.col("parsed")["event_type"].alias("event_type"),
                      F.col("parsed")["source_ip"].alias("source_ip"))


for _kind in ("windows_event", "xml"):
    @query(f"parse_{_kind}", f"WITH {checks.typed(_kind)}, p AS ({checks.parse_parts()[_kind]} UNION ALL {checks.parse_parts()['']}) SELECT event_id, parser, parse_status, timestamp AS log_time, event_type, source_ip, source_port, hostname, application, action, destination_port FROM p")
    def parse_markup(spark, d, _kind=_kind):
        out = parse.parse_as(derive.logs(spark, d, _kind), _kind)
        p = F.col("parsed")
        port = p["destination_port"] if _kind == "windows_event" else F.coalesce(p["destination_port"], p["dport"])
        return out.select("event_id", "parser", "parse_status", p["timestamp"].alias("log_time"),
                          *[p[k].alias(k) for k in ("event_type", "source_ip", "source_port", "hostname", "application", "action")],
                          port.alias("destination_port"))


@query("extract_kv", f"""WITH {checks.logs('mixed')}, p AS (SELECT event_id, regexp_extract_all(t, {checks.q(checks.IDENT)}, 1) AS k, list_transform(regexp_extract_all(t, {checks.q(checks.IDENT)}, 2), lambda x: trim(x, '"''')) AS v FROM texts)
  SELECT event_id, CAST(len(list_distinct(k)) AS INT) AS pairs, {checks.last('src_ip')} AS src_ip, {checks.last('lvl')} AS lvl, {checks.last('tag')} AS tag, {checks.last('act')} AS act, {checks.last('user')} AS user_name FROM p""")
def extract_kv(spark, d):
    m = parse.extract_pairs_map(F.col("raw_event"))
    out = derive.logs(spark, d).withColumn("m", m)
    return out.select("event_id", F.size("m").alias("pairs"), *[F.col("m")[k].alias(k) for k in ("src_ip", "lvl", "tag", "act")],
                      F.col("m")["user"].alias("user_name"))


@query("extract_kv_documents", f"""WITH {checks.texts('documents', 'doc_id', 'text')}, p AS (SELECT event_id, regexp_extract_all(t, {checks.q(checks.IDENT)}, 1) AS k, list_transform(regexp_extract_all(t, {checks.q(checks.IDENT)}, 2), lambda x: trim(x, '"''')) AS v FROM texts)
  SELECT event_id AS doc_id, CAST(len(list_distinct(k)) AS INT) AS pairs, array_to_string(list_sort(list_distinct(k)), ',') AS names FROM p""")
def extract_kv_documents(spark, d):
    out = table(spark, d, "documents").withColumn("m", parse.extract_pairs_map(F.col("text")))
    return out.select("doc_id", F.size("m").alias("pairs"), joined(F.array_sort(F.map_keys("m"))).alias("names"))


@query("parse_logs", f"WITH {checks.parsed('mixed')} SELECT event_id, parser, parse_status, CASE WHEN parser IN ('cisco_asa', 'windows_event') THEN '1.0.0' END AS parser_version FROM events1")
def parse_logs(spark, d):
    return parse.parse_logs(derive.logs(spark, d)).select("event_id", "parser", "parse_status", "parser_version")


@query("batch_from_table", f"WITH {checks.logs('mixed')} SELECT user_id, CAST(count(*) FILTER (t <> '') AS BIGINT) AS accepted_count, CAST(count(*) FILTER (t = '') AS BIGINT) AS rejected_count FROM texts GROUP BY user_id")
def batch_from_table(spark, d):
    return aggregates.request_report(derive.logs(spark, d), "user_id", "raw_event")


# --- normalisation, validation, quality ---------------------------------------------------

def _events(spark, d, kind: str = "mixed") -> DataFrame:
    logs = derive.logs(spark, d, kind).select("event_id", "raw_event", F.col("event_ts").alias("stored_at"))
    return process_logs(logs, ingest_time=F.col("stored_at"))


_SHOWN = [c.strip() for c in checks.SHOWN.split(",")]


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*[F.col("user").alias("user_name") if c == "user_name" else c for c in _SHOWN])


@query("normalize_events", f"WITH {checks.parsed('mixed')} SELECT {checks.SHOWN} FROM events1")
def normalize_events(spark, d):
    return _shown(_events(spark, d))


for _kind in ("json", "cef", "leef", "syslog", "csv", "cisco_asa", "windows_event", "xml"):
    @query(f"normalize_{_kind}", f"WITH {checks.parsed(_kind)} SELECT {checks.SHOWN} FROM events1")
    def normalize_kind(spark, d, _kind=_kind):
        return _shown(_events(spark, d, _kind))


@query("validate_rejects", f"WITH {checks.parsed('mixed')} SELECT coalesce(parser, 'none') AS parser, split_part(reject_reason, ':', 1) AS reason, count(*) AS events FROM events1 WHERE reject_reason IS NOT NULL GROUP BY ALL")
def validate_rejects(spark, d):
    bad = _events(spark, d).filter("reject_reason IS NOT NULL")
    return bad.groupBy(F.coalesce("parser", F.lit("none")).alias("parser"),
                       F.substring_index("reject_reason", ":", 1).alias("reason")).agg(F.count("*").alias("events"))


@query("validate_table", f"WITH {checks.SEC} SELECT event_id, CASE WHEN NOT {checks.is_ip('source_ip')} THEN 'source_ip: Invalid IP address: ' || source_ip WHEN NOT {checks.is_ip('destination_ip')} THEN 'destination_ip: Invalid IP address: ' || destination_ip WHEN destination_port > 65535 THEN 'destination_port: out of range' END AS reject_reason FROM ev")
def validate_table(spark, d):
    return normalize.check_events(derive.security_events(spark, d)).select("event_id", "reject_reason")


@query("assign_event_id", f"WITH {checks.BASE} SELECT n, 'EVT-' || upper(left(sha256(user_id || '|' || n || '|' || kind), 32)) AS event_id FROM base")
def assign_event_id(spark, d):
    return normalize.assign_event_id(derive.base(spark, d), "user_id", "n", "kind").select("n", "event_id")


_Q = "completeness, validity, consistency, quality_score, quality_status, required, important, missing"
_WARN = ("array_to_string(list_filter([CASE WHEN important <> '' THEN " + checks.q(fixed.WARN_MISSING) + " || important END, CASE WHEN validity < 100 THEN "
         + checks.q(fixed.WARN_VALIDITY) + " END, CASE WHEN consistency < 100 THEN " + checks.q(fixed.WARN_CONSISTENCY) + " END], lambda x: x IS NOT NULL), ' ')")


def _quality_out(df: DataFrame) -> DataFrame:
    g = lambda f: F.col(f"quality.{f}")
    return df.select(
        "event_id", *[g(f).alias(f) for f in ("completeness", "validity", "consistency", "quality_score")],
        g("status").alias("quality_status"), joined(g("missing_required_fields"), ", ").alias("required"),
        joined(g("missing_important_fields"), ", ").alias("important"),
        joined(g("missing_fields"), ", ").alias("missing"), joined(g("warnings"), " ").alias("warnings"))


@query("quality", f"WITH {checks.SEC}, full_ev AS (SELECT *, 'x' AS source_type, 'x' AS raw_event FROM ev), {checks.scored('full_ev')} SELECT event_id, {_Q}, {_WARN} AS warnings FROM scored")
def quality_of_events(spark, d):
    ev = derive.security_events(spark, d).withColumn("source_type", F.lit("x")).withColumn("raw_event", F.lit("x"))
    return _quality_out(quality.quality(ev))


@query("quality_of_logs", f"WITH {checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL), {checks.scored('good')} SELECT event_id, {_Q}, {_WARN} AS warnings FROM scored")
def quality_of_logs(spark, d):
    return _quality_out(accepted(_events(spark, d)))


_FORMAT = "CASE WHEN parser IN ('syslog', 'json', 'cef') THEN parser ELSE 'unknown' END"


@query("quality_summary", f"WITH {checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL), {checks.scored('good')} SELECT coalesce(parser, 'none') AS parser, {_FORMAT} AS format, quality_status, count(*) AS events, round(avg(quality_score), 6) AS mean_score FROM scored GROUP BY ALL")
def quality_summary(spark, d):
    out = quality.quality_summary(accepted(_events(spark, d)))
    return out.withColumn("parser", F.coalesce("parser", F.lit("none"))).withColumn("mean_score", F.round("mean_score", 6))


@query("display_fields", f"""WITH {checks.parsed('mixed')}, e AS (SELECT *, {_FORMAT} AS format FROM events1 WHERE reject_reason IS NULL) SELECT event_id,
  CASE WHEN source_ip IS NOT NULL THEN source_ip || CASE WHEN coalesce(source_port, 0) <> 0 THEN ':' || source_port ELSE '' END ELSE coalesce(nullif(source, ''), '—') END AS display_source,
  CASE WHEN destination_ip IS NOT NULL THEN destination_ip || CASE WHEN coalesce(destination_port, 0) <> 0 THEN ':' || destination_port ELSE '' END ELSE '—' END AS display_destination,
  upper(format) AS format_label, CAST(len(list_distinct(regexp_extract_all(t, {checks.q(checks.IDENT)}, 1))) AS INT) AS field_count FROM e""")
def display_fields(spark, d):
    out = display.display_fields(accepted(_events(spark, d)).withColumn("chain_hash", F.lit(None).cast("string")))
    return out.select("event_id", "display_source", "display_destination", "format_label", "field_count")


@query("event_confidence", f"""WITH {checks.parsed('mixed')}, {checks.classify_sql('(SELECT * FROM typed WHERE parser IS NULL)')}, o AS (SELECT event_id, {checks.CLASS_OUT} FROM classed),
  c AS (SELECT e.event_id, CASE parse_status WHEN 'success' THEN 1.0::DOUBLE WHEN 'error' THEN 0.0::DOUBLE ELSE o.confidence END AS confidence, substr(e.event_id, 13) IN ('1', '2') AS chained FROM events1 e LEFT JOIN o USING (event_id) WHERE reject_reason IS NULL)
  SELECT event_id, confidence, CAST(floor(round(confidence * 100, 6) + 0.5) AS INT) AS confidence_percent, CASE WHEN chained THEN 'VERIFIED' ELSE '—' END AS badge FROM c""")
def event_confidence(spark, d):
    """The confidence that a format took the log, or of the guess where none did."""
    ev = accepted(_events(spark, d)).withColumn("confidence", F.round("confidence", 6)).withColumn(
        "chain_hash", F.when(F.substring("event_id", 13, 1).isin("1", "2"), F.col("raw_hash")))
    return display.display_fields(ev).select("event_id", "confidence", "confidence_percent", "badge")


# --- aggregates ---------------------------------------------------------------------------

@query("count_events", "SELECT count(*) AS total_events FROM events")
def count_events(spark, d):
    return aggregates.count_events(spark.read.parquet(f"{d}/events.parquet"))


@query("format_facets", f"WITH {checks.typed('mixed')} SELECT upper({_FORMAT}) AS format_label, count(*) AS events FROM typed GROUP BY 1")
def format_facets(spark, d):
    return aggregates.format_facets(_events(spark, d))


@query("parser_stats", f"""WITH {checks.parsed('mixed')} SELECT coalesce(parser, 'none') AS parser, count(*) AS events, count(*) FILTER (parse_status = 'error') AS failures,
  CASE WHEN count(*) FILTER (parse_status = 'error') > 0 THEN CASE parser WHEN 'cef' THEN 'Invalid CEF format' ELSE 'Invalid LEEF format: Header requires at least 5 pipe-separated fields' END END AS last_error FROM events1 GROUP BY parser""")
def parser_stats(spark, d):
    out = aggregates.parser_stats(parse.parse_logs(derive.logs(spark, d)))
    return out.withColumn("parser", F.coalesce("parser", F.lit("none")))


# --- detection rules ----------------------------------------------------------------------

@query("rule_failed_login", f"WITH {checks.SEC}, failures AS (SELECT * FROM ev WHERE {checks.FAILED}) SELECT event_id, c AS failed_count FROM {checks.trailing('failures', LOGIN_S)} WHERE c >= {LOGIN}")
def rule_failed_login(spark, d):
    return rules.rule_failed_login(derive.security_events(spark, d), RULES).select("event_id", "failed_count")


@query("rule_ip_spike", f"WITH {checks.SEC} SELECT event_id, c AS spike_count FROM {checks.trailing('ev', SPIKE_S)} WHERE c >= {SPIKE}")
def rule_ip_spike(spark, d):
    return rules.rule_ip_spike(derive.security_events(spark, d), RULES).select("event_id", "spike_count")


@query("rule_abnormal_port", f"WITH {checks.SEC} SELECT event_id, destination_port, protocol FROM ev WHERE {checks.ABNORMAL}")
def rule_abnormal_port(spark, d):
    return rules.rule_abnormal_port(derive.security_events(spark, d)).select("event_id", "destination_port", "protocol")


@query("rule_suspicious_command", f"WITH {checks.SEC} SELECT event_id, {checks.COMMAND} AS command_text FROM ev WHERE {checks.RISKY}")
def rule_suspicious_command(spark, d):
    out = rules.rule_suspicious_command(derive.security_events(spark, d))
    return out.select("event_id", rules.command_text().alias("command_text"))


@query("apply_rules", f"WITH {checks.SEC}, {checks.ruled(LOGIN, LOGIN_S, SPIKE, SPIKE_S)} SELECT event_id, len(names) > 0 AS detected, array_to_string(names, ',') AS rule_matches, array_to_string(why, '; ') AS rule_reasons FROM hits")
def apply_rules(spark, d):
    out = rules.apply_rules(rules.with_rule_counts(derive.security_events(spark, d), RULES), RULES)
    return out.select("event_id", "detected", joined("rule_matches").alias("rule_matches"), joined("rule_reasons", "; ").alias("rule_reasons"))


@query("rate_anomaly", f"WITH {checks.SEC}, {checks.anomaly_sql(BUCKET, Z)} SELECT event_id, anomaly, anomaly_score, anomaly_reason FROM anom")
def rate_anomaly_query(spark, d):
    return rate_anomaly(derive.security_events(spark, d), ANOMALY).select("event_id", "anomaly", "anomaly_score", "anomaly_reason")


def _analytics(spark, d) -> DataFrame:
    return risk.analyze(derive.security_events(spark, d), RULES, ANOMALY)


_ANALYZED = checks.analyzed(LOGIN, LOGIN_S, SPIKE, SPIKE_S, BUCKET, Z)


@query("analyze", f"WITH {_ANALYZED} SELECT event_id, detected, anomaly, anomaly_score, risk_score, severity, array_to_string(names, ',') AS rule_matches, array_to_string(why, '; ') AS reasons FROM analytics")
def analyze(spark, d):
    return _analytics(spark, d).withColumn("rule_matches", joined("rule_matches")).withColumn(
        "reasons", joined("reasons", "; ")).drop("detections", "timestamp")


@query("risk_score", f"WITH {_ANALYZED} SELECT event_id, risk_score, severity AS risk_severity FROM analytics")
def risk_score(spark, d):
    return _analytics(spark, d).select("event_id", "risk_score", F.col("severity").alias("risk_severity"))


@query("analytics_stats", f"WITH {_ANALYZED} SELECT count(*) AS total_analyzed, count(*) FILTER (anomaly) AS anomalies, count(*) FILTER (detected) AS detections FROM analytics")
def analytics_stats(spark, d):
    return aggregates.analytics_stats(_analytics(spark, d))


@query("severity_counts", f"WITH {_ANALYZED} SELECT severity, count(*) AS events FROM analytics GROUP BY severity")
def severity_counts(spark, d):
    return aggregates.severity_counts(_analytics(spark, d))


@query("risk_matrix", f"""WITH s AS (SELECT unnest(['critical','HIGH','medium','low',NULL]) AS severity), ev AS (SELECT event_id, event_type, value FROM events) SELECT event_id, severity,
  CAST(least(100, CASE lower(severity) WHEN 'critical' THEN 50 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 0 END + CASE WHEN event_type = 'error' THEN 55 WHEN event_type = 'view' THEN 60 ELSE 0 END
  + CASE WHEN value > 20 THEN CAST(trunc(least(1.0::DOUBLE, value / 100.0::DOUBLE) * 30) AS INT) ELSE 0 END) AS INT) AS risk_score FROM ev, s""")
def risk_matrix(spark, d):
    ev = table(spark, d, "events").withColumn("severity", F.explode(F.array(*[F.lit(s) for s in ("critical", "HIGH", "medium", "low", None)])))
    matches = F.when(F.col("event_type") == "error", F.array(F.lit("repeated_failed_login"), F.lit("source_ip_spike"))).when(
        F.col("event_type") == "view", F.array(F.lit("suspicious_command"))).otherwise(F.array().cast("array<string>"))
    ev = ev.withColumn("rule_matches", matches).withColumn("anomaly", F.col("value") > 20).withColumn(
        "anomaly_score", F.least(F.lit(1.0), F.col("value") / 100.0))
    return risk.risk_score(ev).select("event_id", "severity", "risk_score")


# --- search -------------------------------------------------------------------------------

_TOKENS = rf"[{checks.WORD}]+(?:[.''][{checks.WORD}]+)*"


def _search_sql(q: str) -> str:
    words = lambda text: f"list_distinct(regexp_extract_all(lower({text}), '{_TOKENS}'))"
    return f"""(coalesce(len(list_intersect({words('raw_event')}, {words(checks.q(q))})) > 0, false) OR event_type IS NOT DISTINCT FROM {checks.q(q)} OR user_name IS NOT DISTINCT FROM {checks.q(q)} OR hostname IS NOT DISTINCT FROM {checks.q(q)})"""


_GOOD = f"WITH {checks.parsed('mixed')}, good AS (SELECT e.*, l.event_ts AS stored_ts FROM events1 e JOIN logs l USING (event_id) WHERE reject_reason IS NULL)"
_TS = """coalesce(try_cast(CASE WHEN regexp_matches(timestamp, '^\\d{4}-\\d{2}-\\d{2}') THEN timestamp END AS TIMESTAMP),
  try_strptime(CASE WHEN regexp_matches(timestamp, '^[A-Z][a-z]{2} +\\d{1,2} \\d{2}:\\d{2}:\\d{2}$') THEN CAST(year(stored_ts) AS VARCHAR) || ' ' || timestamp END, '%Y %b %d %H:%M:%S'))"""


@query("search_events", f"{_GOOD} SELECT event_id, parser, source_ip FROM good WHERE parser = 'json' AND action = 'login_failed' ORDER BY {_TS} DESC NULLS LAST, event_id LIMIT 20 OFFSET 20")
def search_events(spark, d):
    page = search.search_events(accepted(_events(spark, d)), page=2, parser="json", action="login_failed")
    return page.items.select("event_id", "parser", "source_ip")


@query("search_events_total", f"{_GOOD} SELECT count(*) AS total FROM good WHERE {_search_sql('10.0.0.17 u23')}")
def search_events_total(spark, d):
    return search.search_events(accepted(_events(spark, d)), q="10.0.0.17 u23").total


@query("match_text", f"{_GOOD} SELECT event_id FROM good WHERE {_search_sql('u16 host3')} UNION SELECT event_id FROM good WHERE {_search_sql('4612')}")
def match_text(spark, d):
    good = accepted(_events(spark, d))
    return good.filter(search.match_text("u16 host3") | search.match_text("4612")).select("event_id")


@query("match_text_documents", f"SELECT doc_id FROM documents WHERE len(list_intersect(list_distinct(regexp_extract_all(lower(text), '{_TOKENS}')), ['the', 'der', '10.0.0.1'])) > 0")
def match_text_documents(spark, d):
    none = F.lit(None).cast("string")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("raw_event"), none.alias("event_type"),
                                                none.alias("user"), none.alias("hostname"))
    return search.find_events(docs, q="The der 10.0.0.1").select("doc_id")


@query("search_alerts", f"WITH {_ANALYZED}, a AS (SELECT analytics.*, event_ts FROM analytics JOIN ev USING (event_id)) SELECT event_id, risk_score, severity FROM a WHERE detected AND risk_score BETWEEN 40 AND 90 ORDER BY event_ts DESC, event_id LIMIT 50")
def search_alerts(spark, d):
    page = search.search_alerts(_analytics(spark, d), page_size=50, detected=True, risk_min=40, risk_max=90)
    return page.items.select("event_id", "risk_score", "severity")


@query("find_alerts", f"WITH {_ANALYZED} SELECT event_id, risk_score FROM analytics WHERE severity = 'high' AND NOT anomaly AND risk_score <= 70")
def find_alerts(spark, d):
    return search.find_alerts(_analytics(spark, d), severity="high", anomaly=False, risk_max=70).select("event_id", "risk_score")


@query("get_event", f"WITH {checks.SEC} SELECT event_id, source_ip, action FROM ev WHERE event_id = 'E000000000123'")
def get_event(spark, d):
    return search.get_event(derive.security_events(spark, d), "E000000000123").select("event_id", "source_ip", "action")


@query("get_analytics", f"WITH {_ANALYZED} SELECT event_id, risk_score, detected FROM analytics WHERE event_id = 'E000000000123'")
def get_analytics(spark, d):
    return search.get_analytics(_analytics(spark, d), "E000000000123").select("event_id", "risk_score", "detected")


@query("list_events", f"WITH {checks.SEC} SELECT event_id, row_number() OVER (ORDER BY event_ts DESC, event_id) - 1 AS n FROM ev")
def list_events(spark, d):
    """The order is checked too: each row's place is read off the sorted partitions."""
    ev = derive.security_events(spark, d).withColumn("created_at", F.col("event_ts"))
    return _in_order(search.list_events(ev), "event_id")


_LINE = "lower(event_id || ' ' || coalesce(nullif(source, ''), '—') || ' ' || coalesce(source_ip, '—') || ' — ' || coalesce(destination_ip, '—') || ' ' || coalesce(nullif(action, ''), '—') || ' ' || coalesce(nullif(severity, ''), '—') || ' ' || coalesce(parser, '—') || ' ' || " + _FORMAT + " || ' ' || raw_event)"


@query("filter_events", f"{_GOOD} SELECT event_id FROM good WHERE contains({_LINE}, 'gate 10.0.0.1') AND upper({_FORMAT}) = 'CEF' UNION ALL SELECT event_id FROM good WHERE contains({_LINE}, '— view')")
def filter_events(spark, d):
    """What is shown of the events is stored, so that two searches read each log once."""
    good = stored(accepted(_events(spark, d)).select(*search.SHOWN), "shown")
    return search.filter_events(good, " GATE 10.0.0.1 ", "CEF").select("event_id").unionAll(
        search.filter_events(good, "— View").select("event_id"))


# --- from raw logs to alerts --------------------------------------------------------------

_LOGGED = f"""{checks.parsed('mixed')}, good AS (SELECT e.*, l.event_ts AS stored_ts FROM events1 e JOIN logs l USING (event_id) WHERE reject_reason IS NULL),
  ev AS (SELECT event_id, coalesce({_TS}, stored_ts) AS event_ts, source_ip, action, event_type, severity, protocol, destination_port, CAST(NULL AS VARCHAR) AS command, CAST(NULL AS VARCHAR) AS process_command FROM good)"""


@query("analyze_logs", f"WITH {checks.analyzed(LOGIN, LOGIN_S, SPIKE, SPIKE_S, BUCKET, Z, _LOGGED)} SELECT event_id, detected, anomaly, anomaly_score, risk_score, severity, array_to_string(names, ',') AS rule_matches, array_to_string(why, '; ') AS reasons FROM analytics")
def analyze_logs_query(spark, d):
    """All formats, half of them without a time of their own: these are judged by the time of storage."""
    logs = derive.logs(spark, d).select("event_id", "raw_event", F.col("event_ts").alias("stored_at"))
    found = analyze_logs(logs, _folder(spark, "events"), RULES, ANOMALY, ingest_time=F.col("stored_at"))
    return found.withColumn("rule_matches", joined("rule_matches")).withColumn("reasons", joined("reasons", "; ")).drop("detections", "timestamp")


@query("write_read_analytics", f"WITH {_ANALYZED} SELECT event_id, risk_score, severity, array_to_string(names, ',') AS rule_matches FROM analytics")
def write_read_analytics(spark, d):
    path = _folder(spark, "analytics")
    write_analytics(_analytics(spark, d), path)
    return read_analytics(spark, path).select("event_id", "risk_score", "severity", joined("rule_matches").alias("rule_matches"))


# --- integrity ----------------------------------------------------------------------------

@query("raw_hash", "SELECT doc_id, sha256(text) AS raw_hash FROM documents")
def raw_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", integrity.raw_hash(F.col("text")).alias("raw_hash"))


_HASHED = ["action", "destination_ip", "destination_port", "event_id", "event_type", "extensions", "hostname", "protocol", "severity", "source_ip", "source_port", "timestamp", "user"]
_EXT_SQL = "'{' || array_to_string(list_filter([CASE WHEN command IS NOT NULL THEN '\"command\":' || to_json(command) END, CASE WHEN process_command IS NOT NULL THEN '\"process_command_line\":' || to_json(process_command) END], lambda x: x IS NOT NULL), ',') || '}'"
_CANON = "'{' || " + " || ',' || ".join(
    f"'\"{c}\":' || " + (_EXT_SQL if c == "extensions" else f"coalesce(CAST(to_json({'user_name' if c == 'user' else c}) AS VARCHAR), 'null')") for c in _HASHED) + " || '}'"


@query("normalized_hash", f"WITH {checks.SEC} SELECT event_id, sha256({_CANON}) AS normalized_hash FROM ev")
def normalized_hash(spark, d):
    ev = derive.security_events(spark, d).withColumn("raw_event", F.col("props"))
    return integrity.add_hashes(ev).select("event_id", "normalized_hash")


SEGMENT = 500


def _chained(spark, d) -> DataFrame:
    docs = derive.base(spark, d).select(F.col("kind").alias("chain_key"), "event_ts", F.col("id").alias("event_id"),
                                        F.concat_ws("|", "props", "iso").alias("raw_event"))
    return integrity.chain_hash(docs, ["chain_key"], "event_ts", ["event_id"], segment_rows=SEGMENT, slab_seconds=86400)


_CHAIN = f"""WITH RECURSIVE {checks.BASE}, placed AS (SELECT kind AS chain_key, id AS event_id, props || '|' || iso AS raw, row_number() OVER (PARTITION BY kind ORDER BY event_ts, id) - 1 AS pos FROM base),
  parts AS (SELECT *, pos // {SEGMENT} AS seg FROM placed),
  chain AS (SELECT chain_key, seg, pos, event_id, CAST(NULL AS VARCHAR) AS prev, sha256(raw) AS h FROM parts WHERE pos % {SEGMENT} = 0
    UNION ALL SELECT p.chain_key, p.seg, p.pos, p.event_id, c.h, sha256(c.h || p.raw) FROM chain c JOIN parts p ON p.chain_key = c.chain_key AND p.seg = c.seg AND p.pos = c.pos + 1)"""


@query("chain_hash", f"{_CHAIN} SELECT chain_key, event_id, CAST(pos AS BIGINT) AS chain_pos, CAST(seg AS BIGINT) AS chain_segment, prev AS previous_hash, h AS chain_hash FROM chain")
def chain_hash(spark, d):
    return _chained(spark, d)


@query("chain_one_moment", f"""WITH RECURSIVE {checks.BASE}, placed AS (SELECT id AS event_id, props || '|' || iso AS raw, CASE WHEN n % 2 = 0 THEN 'hot' ELSE kind END AS chain_key, row_number() OVER (PARTITION BY CASE WHEN n % 2 = 0 THEN 'hot' ELSE kind END ORDER BY CASE WHEN n % 2 = 0 THEN NULL ELSE event_ts END, id) - 1 AS pos FROM base),
  chain AS (SELECT chain_key, pos, event_id, CAST(NULL AS VARCHAR) AS prev, sha256(raw) AS h FROM placed WHERE pos % {SEGMENT} = 0
    UNION ALL SELECT p.chain_key, p.pos, p.event_id, c.h, sha256(c.h || p.raw) FROM chain c JOIN placed p ON p.chain_key = c.chain_key AND p.pos = c.pos + 1 AND p.pos % {SEGMENT} <> 0)
  SELECT chain_key, event_id, CAST(pos AS BIGINT) AS chain_pos, prev AS previous_hash, h AS chain_hash FROM chain""")
def chain_one_moment(spark, d):
    """Half of all rows have one key and one time."""
    hot = F.col("n") % 2 == 0
    rows = derive.base(spark, d).select(F.when(hot, "hot").otherwise(F.col("kind")).alias("chain_key"), F.when(hot, F.timestamp_seconds(F.lit(1_700_000_000))).otherwise(F.col("event_ts")).alias("event_ts"),
                                        F.col("id").alias("event_id"), F.concat_ws("|", "props", "iso").alias("raw_event"))
    return integrity.chain_hash(rows, ["chain_key"], "event_ts", ["event_id"], segment_rows=SEGMENT, by_ranges=True).select(
        "chain_key", "event_id", "chain_pos", "previous_hash", "chain_hash")


@query("chain_two_batches", f"{_CHAIN} SELECT chain_key, event_id, CAST(pos AS BIGINT) AS chain_pos, CAST(seg AS BIGINT) AS chain_segment, prev AS previous_hash, h AS chain_hash FROM chain")
def chain_two_batches(spark, d):
    """The second half in time goes on from the stored chain of the first: the same chain as in one batch."""
    rows = derive.base(spark, d).select(F.col("kind").alias("chain_key"), "event_ts", F.col("id").alias("event_id"),
                                        F.concat_ws("|", "props", "iso").alias("raw_event"))
    middle = rows.agg(F.expr("percentile_approx(event_ts, 0.5)")).first()[0]
    add = lambda part, start: integrity.chain_hash(part, ["chain_key"], "event_ts", ["event_id"], segment_rows=SEGMENT, slab_seconds=86400, start=start)
    first = stored(add(rows.where(F.col("event_ts") < middle), None), "chain")
    return first.unionByName(add(rows.where(F.col("event_ts") >= middle), integrity.latest_chain_hash(first, ["chain_key"])))


@query("verify_chain", f"""{_CHAIN}, n AS (SELECT chain_key, seg, count(*) AS n, count(*) FILTER (NOT ((seg % 4 = 0 AND pos % {SEGMENT} = 7) OR (seg % 4 = 1 AND pos % {SEGMENT} >= 90) OR seg % 4 = 2)) AS found FROM chain GROUP BY ALL)
  SELECT chain_key, CAST(seg AS BIGINT) AS segment, n AS "rows", found, found = n AS intact FROM n""")
def verify_chain(spark, d):
    """Of every four segments one has lost a row, one its tail, one is gone."""
    whole, pos, turn = _chained(spark, d), F.col("chain_pos") % SEGMENT, F.col("chain_segment") % 4
    lost = ((turn == 0) & (pos == 7)) | ((turn == 1) & (pos >= 90)) | (turn == 2)
    return integrity.verify_chain(whole.where(~lost), integrity.seal_segments(whole, ["chain_key"], SEGMENT), ["chain_key"])


@query("chain_events", f"{_CHAIN} SELECT chain_key, event_id, CAST(pos AS BIGINT) AS chain_pos, prev AS previous_hash, h AS chain_hash FROM chain")
def chain_events_query(spark, d):
    rows = derive.base(spark, d).select("kind", "event_ts", F.col("id").alias("event_id"), F.concat_ws("|", "props", "iso").alias("raw_event"))
    return chain_events(rows, "kind", "event_ts", ["event_id"], segment_rows=SEGMENT, slab_seconds=86400).select(
        "chain_key", "event_id", "chain_pos", "previous_hash", "chain_hash")


@query("seal_segments", f"""{_CHAIN}, heads AS (SELECT chain_key, seg, h AS head FROM chain QUALIFY row_number() OVER (PARTITION BY chain_key, seg ORDER BY pos DESC) = 1),
  seals AS (SELECT chain_key, seg, head, sha256(head) AS seal FROM heads WHERE seg % {SEGMENT} = 0 UNION ALL SELECT p.chain_key, p.seg, p.head, sha256(s.seal || p.head) FROM seals s JOIN heads p ON p.chain_key = s.chain_key AND p.seg = s.seg + 1 AND p.seg % {SEGMENT} <> 0)
  SELECT chain_key, CAST(seg AS BIGINT) AS segment, head, seal FROM seals""")
def seal_segments(spark, d):
    return integrity.seal_segments(_chained(spark, d), ["chain_key"], SEGMENT).select("chain_key", "segment", "head", "seal")


@query("verify_seals", f"""{_CHAIN}, g AS (SELECT chain_key, seg, max(pos) AS last FROM chain GROUP BY ALL), k AS (SELECT chain_key, max(seg) AS top FROM g GROUP BY 1)
  SELECT chain_key, CAST(seg AS BIGINT) AS segment, 'changed' AS problem FROM g WHERE chain_key = 'click' AND seg % 3 = 0
  UNION ALL SELECT chain_key, seg, 'lost seal' FROM g JOIN k USING (chain_key) WHERE chain_key = 'view' AND seg % 3 = 0
  UNION ALL SELECT chain_key, seg, 'lost segment' FROM g WHERE chain_key = 'signup' AND seg % 3 = 1
  UNION ALL SELECT chain_key, CASE WHEN top = 0 THEN 0 ELSE top END, CASE WHEN top = 0 THEN 'lost key' ELSE 'lost tail' END FROM k WHERE chain_key = 'purchase'
  UNION ALL SELECT chain_key, 0, 'lost key' FROM k WHERE chain_key = 'error'""")
def verify_seals(spark, d):
    """Every third segment of one kind has another last hash, of another it has lost its seal, of a third it is gone; one kind has lost its
    last segment with its seal, one all but its top."""
    chained = stored(_chained(spark, d), "chained")
    sealed = seals.seal(chained, ["chain_key"], fan=4)
    key, seg, third = F.col("chain_key"), F.col("chain_segment"), F.col("chain_segment") % 3
    last = chained.where(key == "purchase").agg(F.max("chain_segment")).first()[0]
    gone = (key == "error") | ((key == "signup") & (third == 1)) | ((key == "purchase") & (seg == last))
    rest = chained.where(~gone).withColumn("chain_hash", F.when((key == "click") & (third == 0), F.sha2("chain_hash", 256)).otherwise(F.col("chain_hash")))
    leaf = F.col("level") == 0
    cut = (key == "error") | ((key == "purchase") & (F.col("index") * F.pow(F.lit(4), "level") + F.pow(F.lit(4), "level") > last)) | (leaf & (key == "view") & (F.col("index") % 3 == 0))
    return seals.verify_seals(rest, seals.Seals(sealed.nodes.where(~cut), sealed.tops, sealed.root), ["chain_key"], fan=4)


@query("seals_appended", f"{_CHAIN}, k AS (SELECT chain_key, max(seg) AS top FROM chain GROUP BY 1) SELECT chain_key, CAST(greatest(top, 1) AS BIGINT) AS segments, true AS appended FROM k")
def seals_appended(spark, d):
    """The tops of the chains without their last segment follow from the tree of all."""
    chained = stored(_chained(spark, d), "chained")
    most = chained.groupBy("chain_key").agg(F.max("chain_segment").alias("top"))
    old = seals.seal(chained.join(most, "chain_key").where("chain_segment < greatest(top, 1)"), ["chain_key"], fan=4)
    return seals.appended(old.tops, seals.seal(chained, ["chain_key"], fan=4), ["chain_key"], fan=4)


@query("seals_included", f"{_CHAIN}, g AS (SELECT DISTINCT chain_key, seg FROM chain) SELECT chain_key, CAST(seg AS BIGINT) AS segment, seg % 2 = 0 AS included FROM g")
def seals_included(spark, d):
    """Every second segment is asked for with another last hash."""
    sealed = seals.seal(_chained(spark, d), ["chain_key"], fan=4)
    asked = sealed.nodes.where("level = 0").select("chain_key", F.col("index").alias("segment"), "rows", F.when(F.col("index") % 2 == 0, F.col("head")).otherwise("other").alias("head"))
    return seals.included(asked, sealed, ["chain_key"], fan=4)


_INGESTED = f"""{checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL),
  placed AS (SELECT e.event_id, e.raw_event AS raw, coalesce(e.parser, '') AS chain_key, row_number() OVER (PARTITION BY coalesce(e.parser, '') ORDER BY l.event_ts, e.event_id) - 1 AS pos FROM good e JOIN logs l USING (event_id)),
  chain AS (SELECT chain_key, pos, event_id, CAST(NULL AS VARCHAR) AS prev, sha256(raw) AS h FROM placed WHERE pos % 500 = 0
    UNION ALL SELECT p.chain_key, p.pos, p.event_id, c.h, sha256(c.h || p.raw) FROM chain c JOIN placed p ON p.chain_key = c.chain_key AND p.pos = c.pos + 1 AND p.pos % 500 <> 0)"""


@query("ingest_with_integrity", f"WITH RECURSIVE {_INGESTED} SELECT event_id, chain_key, CAST(pos AS BIGINT) AS chain_pos, h AS chain_hash, true AS hash_verified, CAST(substr(event_id, 13) AS INT) <> 7 AS normalized_verified, true AS chain_verified FROM chain")
def ingest_with_integrity(spark, d):
    """Raw logs through the pipeline to stored, hashed and chained events, which are verified; in a tenth the severity has been changed since."""
    path = _folder(spark, "events")
    logs = derive.logs(spark, d).select("event_id", "raw_event", F.col("event_ts").alias("stored_at"))
    write_events(accepted(process_logs(logs, ingest_time=F.col("stored_at"))), path)
    events = read_events(spark, path).withColumn("by", F.coalesce("parser", F.lit("")))
    chained = chain_events(events.drop("previous_hash", "chain_hash", "chain_key", "chain_segment", "chain_pos"), "by", "created_at", ["event_id"], segment_rows=500, slab_seconds=86400)
    changed = chained.withColumn("severity", F.when(F.col("event_id").endswith("7"), F.lit("forged")).otherwise(F.col("severity")))
    checked = integrity.verify(changed).select("event_id", "hash_verified", "normalized_verified", "chain_verified", "chain_hash")
    return checked.join(chained.select("event_id", "chain_key", "chain_pos"), "event_id")


def _stored(spark, d) -> DataFrame:
    """Events with hashes, some of them changed afterwards."""
    ev = derive.security_events(spark, d).withColumn("raw_event", F.col("props"))
    ev = integrity.add_hashes(ev).withColumn("previous_hash", F.when(F.col("n") > 0, F.sha2(F.col("n").cast("string"), 256)))
    chain = F.sha2(F.concat(F.coalesce("previous_hash", F.lit("")), F.col("raw_event")), 256)
    ev = ev.withColumn("chain_hash", F.when(F.col("n") % 10 != 9, chain))
    return (
        ev.withColumn("severity", F.when(F.col("n") % 10 == 1, F.lit("forged")).otherwise(F.col("severity")))
        .withColumn("raw_event", F.when(F.col("n") % 10 == 2, F.lit("forged")).otherwise(F.col("raw_event")))
        .withColumn("hash_version", F.when(F.col("n") % 20 == 1, 1).when(F.col("n") % 10 == 3, F.lit(None)).otherwise(F.col("hash_version")))
        .withColumn("previous_hash", F.when(F.col("n") % 10 == 4, F.lit("0")).otherwise(F.col("previous_hash")))
    )


@query("verify", f"""WITH {checks.BASE}, v AS (SELECT id AS event_id, n % 10 <> 2 AS hash_verified, NOT (n % 10 = 1 AND n % 20 <> 1) AS normalized_verified, n % 10 NOT IN (2, 4, 9) AS chain_verified,
  CASE WHEN n % 20 = 1 OR n % 10 = 3 THEN 1 ELSE 2 END AS hash_version FROM base) SELECT *, NOT (hash_verified AND normalized_verified AND chain_verified) AS tamper_detected FROM v""")
def verify(spark, d):
    return integrity.verify(_stored(spark, d)).select(
        "event_id", "hash_verified", "normalized_verified", "chain_verified", "hash_version", "tamper_detected")


@query("verify_linkage", f"""{_CHAIN}, kept AS (SELECT * FROM chain WHERE pos % 7 <> 3), l AS (SELECT *, lag(h) OVER (PARTITION BY chain_key, seg ORDER BY pos) AS before FROM kept)
  SELECT event_id, prev IS NOT DISTINCT FROM before AS linked FROM l""")
def verify_linkage(spark, d):
    """Rows have been removed from the chains; the row after each gap does not link."""
    kept = _chained(spark, d).filter("chain_pos % 7 != 3")
    return integrity.verify_linkage(kept, ["chain_key"]).select("event_id", "linked")


@query("latest_chain_hash", f"{_CHAIN} SELECT chain_key, h AS latest_chain_hash, CAST(pos + 1 AS BIGINT) AS next_pos FROM chain QUALIFY row_number() OVER (PARTITION BY chain_key ORDER BY pos DESC) = 1")
def latest_chain_hash(spark, d):
    times = derive.base(spark, d).select(F.col("id").alias("event_id"), F.col("event_ts").alias("created_at"))
    return integrity.latest_chain_hash(_chained(spark, d).join(times, "event_id"), ["chain_key"])


_ARRIVED = "(n % 1000) * 1000000 + n"


@query("late_events", f"""WITH {checks.SEC}, w AS (SELECT event_id, event_ts, max(event_ts) OVER (ORDER BY {_ARRIVED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev)
  SELECT event_id, coalesce(epoch_us(event_ts) <= 1000 * epoch_ms(before) - 864000000000, false) AS late FROM w""")
def late_events(spark, d):
    """Ten days late or more, among events that arrive in another order than that of their times."""
    ev = derive.base(spark, d).select(F.col("id").alias("event_id"), "event_ts", F.expr(_ARRIVED).alias("arrived"))
    return flag_late(ev, 10 * 86400, order=["arrived"]).select("event_id", "late")


# --- mapping ------------------------------------------------------------------------------

_KEYS = f"list_transform(regexp_extract_all(trim(raw_event, {checks._BLANKS}), {checks.q(checks.KEYED)}, 1), lambda x: lower(x))"
_JSON_KEYS = "CASE WHEN starts_with(raw_event, '{') AND json_valid(raw_event) THEN list_transform(json_keys(raw_event), lambda x: lower(x)) ELSE [] END"


def _suggest_sql(source: str, key: str, keys: str, more: str = "") -> str:
    rows = " UNION ALL ".join(
        f"SELECT {key}, '{t}' AS target_field, list_filter(ks, lambda x: regexp_matches(x, '{'|'.join(w)}'))[1] AS source_field, {[*w]} AS words FROM keyed" for t, w in fixed.MAPPING_TARGETS.items())
    return (f"keyed AS (SELECT {key}, {keys} AS ks FROM {source}), found AS ({rows}) SELECT {key}, target_field, source_field, CASE WHEN list_contains(words, source_field) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS confidence, "
            f"CASE WHEN list_contains(words, source_field) THEN 'Field ''' || source_field || ''' strongly matches Universal Schema field ''' || target_field || '''' ELSE 'Field ''' || source_field || ''' partially matches ''' || target_field || '''' END AS reason FROM found WHERE source_field IS NOT NULL")


@query("suggest_mappings", f"WITH {checks.logs('mixed')}, {_suggest_sql('logs', 'event_id', _KEYS)}")
def suggest_mappings(spark, d):
    out = classify.suggest_mappings(derive.logs(spark, d))
    return out.select("event_id", F.inline("suggestions")).select("event_id", "target_field", "source_field", "confidence", "reason")


@query("suggest_mappings_json", f"WITH {checks.logs('json')}, {_suggest_sql('logs', 'event_id', 'list_concat(' + _KEYS + ', ' + _JSON_KEYS + ')')}")
def suggest_mappings_json(spark, d):
    """With the format known to be JSON, the members' names count as keys too."""
    out = classify.suggest_mappings(derive.logs(spark, d, "json").withColumn("hint", F.lit("json")), hint="hint")
    return out.select("event_id", F.inline("suggestions")).select("event_id", "target_field", "source_field", "confidence", "reason")


@query("extract_pairs", f"WITH {checks.texts('documents', 'doc_id', 'text')}, k AS (SELECT event_id, {_KEYS} AS ks FROM texts) SELECT event_id AS doc_id, len(list_distinct(ks)) AS pairs, array_to_string(list_sort(list_distinct(ks)), ',') AS names FROM k")
def extract_pairs(spark, d):
    docs = table(spark, d, "documents").withColumn("ks", classify.mapping_keys(F.col("text")))
    return docs.select("doc_id", F.size("ks").cast("bigint").alias("pairs"), joined(F.array_sort("ks")).alias("names"))


_COUNTED = " + ".join(f"(len(list_filter(ks, lambda x: regexp_matches(x, '{'|'.join(w)}'))) > 0)::INT" for w in fixed.MAPPING_TARGETS.values())


@query("mapping_records", f"WITH {checks.logs('mixed')}, {checks.classify_sql()}, o AS (SELECT event_id, raw_event, {checks.CLASS_OUT} FROM classed), k AS (SELECT *, {_KEYS} AS ks FROM o) SELECT event_id AS approval_id, format AS format_prediction, CAST({_COUNTED} AS INT) AS suggestions, 'suggestion' AS status FROM k")
def mapping_records(spark, d):
    out = classify.mapping_records(derive.logs(spark, d), "event_id")
    return out.select("approval_id", "format_prediction", F.size("suggestions").alias("suggestions"), "status")


_DECISIONS = """dec AS (SELECT 'E' || lpad(CAST(n // 2 AS VARCHAR), 12, '0') AS approval_id, CASE WHEN kind = 'error' THEN 'rejected' ELSE 'approved' END AS decision, usr AS username, iso AS decided_at FROM base),
  decided AS (SELECT event_id AS approval_id, event_ts, coalesce(arg_max(decision, decided_at), 'suggestion') AS status, arg_max(username, decided_at) FILTER (decision = 'approved') AS approved_by, max(decided_at) FILTER (decision = 'approved') AS approved_at,
  arg_max(username, decided_at) FILTER (decision = 'rejected') AS rejected_by, max(decided_at) FILTER (decision = 'rejected') AS rejected_at FROM logs LEFT JOIN dec ON dec.approval_id = logs.event_id GROUP BY event_id, event_ts)"""


def _decided(spark, d) -> DataFrame:
    """The records of all logs; the first half of them is decided, twice each."""
    records = classify.mapping_records(derive.logs(spark, d).withColumn("created_at", F.col("event_ts")), "event_id")
    b = derive.base(spark, d)
    decisions = b.select(F.concat(F.lit("E"), F.lpad(F.floor(F.col("n") / 2).cast("string"), 12, "0")).alias("approval_id"),
                         F.when(F.col("kind") == "error", "rejected").otherwise("approved").alias("decision"),
                         F.col("usr").alias("username"), F.col("iso").alias("decided_at"))
    return classify.apply_decisions(records, decisions)


@query("apply_decisions", f"WITH {checks.logs('mixed')}, {_DECISIONS} SELECT approval_id, status, approved_by, approved_at, rejected_by, rejected_at FROM decided")
def apply_decisions(spark, d):
    return _decided(spark, d).select("approval_id", "status", "approved_by", "approved_at", "rejected_by", "rejected_at")


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    """The rows of a sorted result with their place, read off the sorted partitions: the partition, then the row within it."""
    placed = df.select(*columns, F.spark_partition_id().alias("_part")).withColumn("_row", F.monotonically_increasing_id())
    placed = stored(placed, "sorted")
    before = placed.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    at = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per partition
    before = before.select("_part", "_first", F.coalesce(F.sum("_rows").over(at), F.lit(0)).alias("_before"))
    return placed.join(before, "_part").withColumn("n", F.col("_before") + F.col("_row") - F.col("_first")).select(*columns, "n")


@query("list_records", f"WITH {checks.logs('mixed')}, {_DECISIONS} SELECT approval_id, status, row_number() OVER (ORDER BY event_ts DESC, approval_id) - 1 AS n FROM decided")
def list_records(spark, d):
    """Newest first, as the sorted result has them."""
    return _in_order(classify.list_records(_decided(spark, d)), "approval_id", "status")


@query("get_record", f"WITH {checks.logs('mixed')}, {_DECISIONS} SELECT approval_id, status, approved_by, rejected_by FROM decided WHERE approval_id = 'E000000000123'")
def get_record(spark, d):
    return classify.get_record(_decided(spark, d), "E000000000123").select("approval_id", "status", "approved_by", "rejected_by")


# --- joining and replacing ----------------------------------------------------------------

@query("events_with_analytics", f"WITH {_ANALYZED} SELECT event_id, ev.source_ip, ev.action, ev.severity, a.risk_score, a.anomaly, array_to_string(a.names, ',') AS detections FROM ev LEFT JOIN (SELECT * FROM analytics WHERE risk_score > 20) a USING (event_id)")
def events_with_analytics(spark, d):
    ev = derive.security_events(spark, d)
    for c in fixed.FORWARD_EVENT_FIELDS:
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast("string"))
    found = _analytics(spark, d).filter("risk_score > 20")
    return combine.events_with_analytics(ev, found).select(
        "event_id", "source_ip", "action", "severity", "risk_score", "anomaly", joined("detections").alias("detections"))


@query("upsert_events", f"WITH {checks.BASE} SELECT 'k' || CASE WHEN n % 3 = 0 THEN 0 ELSE user_id END AS event_id, arg_max(kind, n) AS kind, max(n) AS n, arg_max(value, n) AS value FROM base GROUP BY 1")
def upsert_events(spark, d):
    """A third of all rows are versions of one event."""
    b = derive.base(spark, d).withColumn("event_id", F.concat(F.lit("k"), F.when(F.col("n") % 3 == 0, 0).otherwise(F.col("user_id")).cast("string")))
    return combine.upsert_events(b.select("event_id", "kind", "n", "value", "event_ts"), ["event_ts", "n"]).drop("event_ts")


# --- assembly -----------------------------------------------------------------------------

_ASSEMBLE = f"""{checks.BASE}, lines AS ({derive.lines_sql()}), marked AS (SELECT *, regexp_matches(trim(line, {checks._BLANKS}), {checks.q(checks.EVENT_START)})::INT AS st, trim(line, {checks._BLANKS}) = '' AS blank FROM lines),
  opened AS (SELECT *, (NOT blank AND (st = 1 OR coalesce(max(st) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0))::INT AS op FROM marked),
  grouped AS (SELECT *, sum(op) OVER (PARTITION BY file ORDER BY line_no) AS grp FROM opened),
  assembled AS (SELECT file, CAST(grp AS BIGINT) AS event_no, CAST(min(line_no) AS INT) AS line_no, count(*) AS line_count, string_agg(line, '' ORDER BY line_no) AS raw_event FROM grouped WHERE grp > 0 GROUP BY file, grp)"""


@query("assemble_events", f"WITH {_ASSEMBLE} SELECT * FROM assembled")
def assemble_events(spark, d):
    return assemble.assemble_events(derive.lines(spark, d))


@query("ingest_report", f"WITH {_ASSEMBLE} SELECT file, CAST(sum(line_count) AS BIGINT) AS total_lines, count(*) FILTER (NOT starts_with(trim(raw_event, {checks._BLANKS}), '{{')) AS processed, count(*) FILTER (starts_with(trim(raw_event, {checks._BLANKS}), '{{')) AS failed FROM assembled GROUP BY file")
def ingest_report(spark, d):
    ev = assemble.assemble_events(derive.lines(spark, d))
    bad = F.when(F.ltrim(F.col("raw_event")).startswith("{"), F.lit("rejected"))
    return aggregates.ingest_report(ev.withColumn("reject_reason", bad))


# --- the whole pipeline -------------------------------------------------------------------

@query("process_logs", f"WITH {checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL), {checks.scored('good')} SELECT {checks.SHOWN.replace(', reject_reason', '')}, {_FORMAT} AS format, quality_score, quality_status, sha256(raw_event) AS raw_hash FROM scored")
def process_all(spark, d):
    out = accepted(_events(spark, d))
    shown = [F.col("user").alias("user_name") if c == "user_name" else c for c in _SHOWN if c != "reject_reason"]
    return out.select(*shown, "format", "quality_score", "quality_status", "raw_hash")


# --- sources, sinks and streams ------------------------------------------------------------
# What these write goes to a new folder below the shared folder the cluster names.

_folder = new_folder


@query("write_read_events", f"WITH {checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL), {checks.scored('good')} SELECT event_id, parser, source_ip, quality_score, CAST(2 AS INT) AS hash_version, sha256(raw_event) AS raw_hash FROM scored")
def write_read_events(spark, d):
    path = _folder(spark, "events")
    write_events(accepted(_events(spark, d)), path)
    return read_events(spark, path).select("event_id", "parser", "source_ip", "quality_score", "hash_version", "raw_hash")


@query("rewrite_events", f"""WITH {checks.SEC} SELECT event_id, CASE WHEN n % 10 = 1 THEN 'newer' ELSE severity END AS severity, epoch_us(event_ts + CASE WHEN n % 10 = 1 AND n % 3 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END) AS at,
  CAST(event_ts + CASE WHEN n % 10 = 1 AND n % 3 = 0 THEN INTERVAL 2 DAY ELSE INTERVAL 0 DAY END AS DATE) AS event_date FROM ev""")
def rewrite_events(spark, d):
    """Half of the events are stored, then all of them twice, then newer versions of a tenth, some on another day, and older
    ones of another tenth, which change nothing."""
    path = _folder(spark, "events")
    ev = derive.security_events(spark, d).withColumn("raw_event", F.col("props")).withColumn("created_at", F.col("event_ts"))
    hours = lambda n: F.expr(f"INTERVAL {n} HOURS")
    newer = ev.where("n % 10 = 1").withColumns({"severity": F.lit("newer"), "created_at": F.col("created_at") + hours(1),
                                                "event_ts": F.when(F.col("n") % 3 == 0, F.col("event_ts") + hours(48)).otherwise(F.col("event_ts"))})
    older = ev.where("n % 10 = 2").withColumns({"severity": F.lit("older"), "created_at": F.col("created_at") - hours(1)})
    for batch in (ev.where("n % 2 = 0"), ev, ev, newer.unionByName(older)):
        replace_events(batch, path, ["created_at"])
    return spark.read.parquet(path).select("event_id", "severity", F.unix_micros("event_ts").alias("at"), "event_date")


def _write_files(rows: DataFrame, path: str, tasks: int) -> None:
    """A text file for each `file`, in the order of the lines. Time goes with the files, not their bytes, so a number of tasks is named, which
    Spark does not make fewer; each moves its files to the new folder itself, so the driver does not move them one by one."""
    ordered = rows.repartition(tasks, "file").sortWithinPartitions("file", "line_no").select("file", "text")
    ordered.write.partitionBy("file").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(path)


@query("read_log_files", f"WITH {_ASSEMBLE} SELECT file, line_no, line_count, raw_event FROM assembled")
def read_log_files(spark, d):
    """Each user's lines are written as one file, read back line by line and put together into events."""
    path = _folder(spark, "files")
    rows = derive.lines(spark, d).select("file", "line_no", F.expr("left(line, length(line) - 1)").alias("text"))
    _write_files(rows, path, parts_of(spark.read.parquet(f"{d}/events.parquet")))
    lines, _refused = files.read_log_files(spark, path)
    name = F.regexp_extract("file", "file=([^/]+)/", 1)
    return assemble.assemble_events(lines.withColumn("file", name)).select(
        "file", F.col("line_no").cast("int").alias("line_no"), "line_count", "raw_event")


@query("read_csv_events", f"WITH {checks.BASE} SELECT iso AS timestamp, src AS source_ip, act AS action, CASE WHEN dport BETWEEN 0 AND 65535 THEN CAST(dport AS INT) END AS destination_port, CASE WHEN dport > 65535 THEN 'destination_port: out of range' END AS reject_reason, CAST(n AS VARCHAR) AS row_no FROM base")
def read_csv_events(spark, d):
    path = _folder(spark, "csv")
    derive.base(spark, d).select("n", F.col("iso").alias("time"), "src", "act", "dport").write.csv(path, header=True)
    out = files.read_csv_events(spark, path, ["n"])
    return out.select("timestamp", "source_ip", "action", "destination_port", "reject_reason", F.col("extensions")["n"].alias("row_no"))


@query("forward_events", f"WITH {checks.BASE} SELECT id AS event_id, kind NOT IN ('error', 'click') AS delivered, CAST(CASE kind WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END AS INT) AS calls FROM base")
def forward_events(spark, d):
    """The receiver takes no batches, refuses clicks, is always too busy for errors and answers
    signups at the second call."""
    busy: set[str] = set()

    def sender(body):
        if isinstance(body, list):
            return 400
        if '"signup"' in body and body not in busy:
            busy.add(body)
            return 429
        busy.discard(body)
        return 401 if '"click"' in body else 503 if '"error"' in body else 200

    payloads = derive.base(spark, d).select(F.col("id").alias("event_id"), "kind", "src")
    return forward(payloads, sender, retries=2, backoff=0)


def _receiver():
    """Takes no batches, refuses clicks and errors, and answers signups at the second call."""
    busy: set[str] = set()

    def sender(body):
        if isinstance(body, list):
            return 400
        if '"signup"' in body and body not in busy:
            busy.add(body)
            return 429
        busy.discard(body)
        return 401 if '"click"' in body else 404 if '"error"' in body else 200

    return sender


@query("forward_source", f"WITH {checks.BASE} SELECT id AS event_id, kind NOT IN ('error', 'click') AS delivered, CAST(CASE kind WHEN 'signup' THEN 2 ELSE 1 END AS INT) AS calls FROM base")
def forward_source(spark, d):
    """Sent by a data source, whose receipts are read back."""
    folder = _folder(spark, "receipts")
    register_forward(spark, "forward_query", _receiver(), retries=2, backoff=0)
    payloads = derive.base(spark, d).select(F.col("id").alias("event_id"), "kind", "src")
    payloads_of(payloads).write.format("forward_query").mode("append").option("receipts", folder).save()
    return read_receipts(spark, folder)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One micro-batch of the whole table, dealt out as in the batch."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).repartition(parts_of(events))


def _stream_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(derive.base_sql("spark", "{events}"), events=_stream(spark, sf_dir))


def _run(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what is there now, and read what it wrote."""
    path = _folder(spark, name)
    rows.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)


@query("stream_events", f"WITH {checks.parsed('mixed')}, good AS (SELECT * FROM events1 WHERE reject_reason IS NULL), {checks.scored('good')} SELECT {checks.SHOWN.replace(', reject_reason', '')}, quality_score, quality_status, sha256(raw_event) AS raw_hash FROM scored")
def stream_events(spark, d):
    path = _folder(spark, "stream")
    rows = spark.sql(derive.logs_sql("mixed").replace("{", "{{").replace("}", "}}").replace("FROM base", "FROM {base}"),
                     base=_stream_base(spark, d)).select("event_id", "raw_event")
    start_pipeline(rows, path, path + "-dead", path + "-state", available_now=True).awaitTermination()
    shown = [F.col("user").alias("user_name") if c == "user_name" else c for c in _SHOWN if c != "reject_reason"]
    return read_events(spark, path).select(*shown, "quality_score", "quality_status", "raw_hash")


@query("stream_dead_letters", f"WITH {checks.parsed('mixed')} SELECT raw_event AS log, reject_reason AS error FROM events1 WHERE reject_reason IS NOT NULL")
def stream_dead_letters(spark, d):
    path = _folder(spark, "stream")
    rows = spark.sql(derive.logs_sql("mixed").replace("{", "{{").replace("}", "}}").replace("FROM base", "FROM {base}"),
                     base=_stream_base(spark, d)).select("event_id", "raw_event")
    start_pipeline(rows, path, path + "-dead", path + "-state", available_now=True).awaitTermination()
    return spark.read.parquet(path + "-dead").select(F.col("payload.log").alias("log"), "error")


@query("stream_logs", f"WITH {checks.logs('mixed')} SELECT event_id AS request_id, raw_event, CAST(n % 3 AS INT) AS attempts FROM logs WHERE trim(raw_event, {checks._BLANKS}) <> ''")
def stream_logs_query(spark, d):
    """Half of the messages are queued and read, a thousand a batch; then the rest is, and the stream goes on from its checkpoint."""
    path = _folder(spark, "queue")
    out = path + "-out"
    logs = derive.logs(spark, d).select(F.col("event_id").alias("request_id"), F.col("raw_event").alias("log"), (F.unix_micros("event_ts") / 1e6).alias("timestamp"), (F.col("n") % 3).cast("int").alias("attempts"), "n")
    for part in (0, 1):
        append_envelopes(logs.where(F.col("n") % 2 == part), path)
        stream = stream_logs(spark, "envelope_log", path, per_trigger=1000).writeStream.format("parquet")
        with quick_checkpoints(spark, out):
            running = stream.option("path", out).option("checkpointLocation", out + "-state").start()
            try:
                running.processAllAvailable()
            finally:
                running.stop()
    return spark.read.parquet(out).select("request_id", "raw_event", "attempts")


_COUNTS_SQL = f"WITH {checks.SEC}, failures AS (SELECT * FROM ev WHERE {checks.FAILED}) SELECT event_id, coalesce(f.c, 0) AS failed_count, s.c AS spike_count FROM ev LEFT JOIN {checks.trailing('failures', LOGIN_S)} f USING (event_id) JOIN {checks.trailing('ev', SPIKE_S)} s USING (event_id)"


def _stream_events(spark: SparkSession, d: str) -> DataFrame:
    return _stream_base(spark, d).select(F.col("id").alias("event_id"), "event_ts", F.col("src").alias("source_ip"),
                                         F.col("act").alias("action"), F.col("kind").alias("event_type"), F.col("sev").alias("severity"))


@query("streaming_rules", _COUNTS_SQL)
def streaming_rules_query(spark, d):
    return _run(spark, streaming_rules(_stream_events(spark, d), RULES), "rules").select("event_id", "failed_count", "spike_count")


@query("streaming_rules_split", _COUNTS_SQL)
def streaming_rules_split(spark, d):
    path = _folder(spark, "rules")
    start_rules(_stream_events(spark, d), path, path + "-state", RULES, available_now=True).awaitTermination()
    failed = F.when(F.col("auth_failed"), F.col("failed_count")).otherwise(0)
    return spark.read.parquet(path).select("event_id", failed.alias("failed_count"), "spike_count")


@query("streaming_chain", f"""WITH RECURSIVE {checks.BASE}, placed AS (SELECT user_id AS k, id, props || '|' || iso AS raw, row_number() OVER (PARTITION BY user_id ORDER BY event_ts, id) AS pos FROM base),
  chain AS (SELECT k, pos, id, CAST(NULL AS VARCHAR) AS prev, sha256(raw) AS h FROM placed WHERE pos = 1 UNION ALL SELECT p.k, p.pos, p.id, c.h, sha256(c.h || p.raw) FROM chain c JOIN placed p ON p.k = c.k AND p.pos = c.pos + 1)
  SELECT CAST(k AS VARCHAR) AS chain_key, id AS event_id, prev AS previous_hash, h AS chain_hash FROM chain""")
def streaming_chain_query(spark, d):
    ev = _stream_base(spark, d).select("user_id", F.col("id").alias("event_id"), "event_ts", F.concat_ws("|", "props", "iso").alias("raw_event"))
    return _run(spark, streaming_chain(ev, "user_id", ["event_ts", "event_id"]), "chain")


@query("streaming_rate_anomaly", f"""WITH {checks.SEC}, b AS (SELECT CAST(floor(epoch_us(event_ts) / {BUCKET * 1000000}.0) AS BIGINT) AS bucket, count(*) AS n FROM ev GROUP BY 1),
  closed AS (SELECT * FROM b WHERE (bucket + 1) * {BUCKET} <= (SELECT floor(max(epoch_ms(event_ts)) - 600000) / 1000.0 FROM ev)),
  w AS (SELECT *, count(*) OVER x AS nb, avg(n) OVER x AS m, stddev_pop(n) OVER x AS sd FROM closed WINDOW x AS (ORDER BY bucket ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
  SELECT bucket, n, coalesce(CASE WHEN nb >= 50 AND sd > 0 THEN (n - m) / sd >= {Z} END, false) AS anomaly FROM w""")
def streaming_rate_anomaly(spark, d):
    path = _folder(spark, "rates")
    ev = _stream_base(spark, d).select("event_ts")
    start_rate_anomaly(ev, path, path + "-state", ANOMALY, available_now=True).awaitTermination()
    return spark.read.parquet(path).select("bucket", "n", "anomaly")


def _arriving(spark: SparkSession, rows: DataFrame, time: str = "event_ts", parts: int = 6, file_rows: int = 100_000) -> DataFrame:
    """The rows as a stream of as many micro-batches, in the order of their times. Each has as many files, of `file_rows` rows or more."""
    path, rows = _folder(spark, "arriving"), stored(rows, "rows")
    cuts = rows.agg(F.percentile_approx(time, [i / parts for i in range(1, parts)]).alias("c")).first()["c"] or []
    part = sum([(F.col(time) >= F.lit(c)).cast("int") for c in cuts], F.lit(0))
    counts = {r["part"]: r["count"] for r in rows.groupBy(part.alias("part")).count().collect()}
    many = max(1, min(counts.get(i, 0) for i in range(parts)) // file_rows)
    for i in range(parts):
        batch = rows.where(part == i)
        (batch.coalesce(1) if many == 1 else batch.repartition(many)).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", many).parquet(path)


_HOT = "CASE WHEN n % 3 = 0 THEN '10.9.9.9' ELSE source_ip END AS source_ip"


@query("streaming_rules_batches", f"WITH {checks.BASE}, raw AS ({derive.EVENTS}), ev AS (SELECT * REPLACE ({_HOT}) FROM raw), failures AS (SELECT * FROM ev WHERE {checks.FAILED}) SELECT event_id, coalesce(f.c, 0) AS failed_count, s.c AS spike_count FROM ev LEFT JOIN {checks.trailing('failures', LOGIN_S)} f USING (event_id) JOIN {checks.trailing('ev', SPIKE_S)} s USING (event_id)")
def streaming_rules_batches(spark, d):
    """Six micro-batches; one source has a third of all events, and half of them only a time of storage."""
    ev = derive.security_events(spark, d).select(
        "event_id", F.when(F.col("n") % 3 == 0, "10.9.9.9").otherwise(F.col("source_ip")).alias("source_ip"), "action", "event_type", "severity",
        F.when(F.col("n") % 2 == 0, F.col("event_ts")).alias("event_ts"), F.col("event_ts").alias("created_at"))
    counted = streaming_rules(_arriving(spark, ev, "created_at"), RULES)
    return _run(spark, counted, "rules").select("event_id", "failed_count", "spike_count")


@query("streaming_rate_events", f"WITH {checks.SEC}, {checks.anomaly_sql(BUCKET, Z)} SELECT event_id, anomaly, anomaly_score, anomaly_reason FROM anom")
def streaming_rate_events_query(spark, d):
    """Each event judged as it arrives, in six micro-batches."""
    ev = derive.base(spark, d).select(F.col("id").alias("event_id"), "event_ts")
    return _run(spark, streaming_rate_events(_arriving(spark, ev), ANOMALY), "rates").select("event_id", "anomaly", "anomaly_score", "anomaly_reason")


@query("streaming_chain_segments", f"{_CHAIN} SELECT chain_key, event_id, CAST(pos AS BIGINT) AS chain_pos, CAST(seg AS BIGINT) AS chain_segment, prev AS previous_hash, h AS chain_hash FROM chain")
def streaming_chain_segments(spark, d):
    """The chains of the batch, made in six micro-batches."""
    rows = derive.base(spark, d).select("kind", "event_ts", F.col("id").alias("event_id"), F.concat_ws("|", "props", "iso").alias("raw_event"))
    path = _folder(spark, "chain")
    start_chain(_arriving(spark, rows), path, path + "-state", "kind", "event_ts", ["event_id"], segment_rows=SEGMENT, slab_seconds=86400, available_now=True).awaitTermination()
    return spark.read.parquet(path + "/chain").select("chain_key", "event_id", "chain_pos", "chain_segment", "previous_hash", "chain_hash")


@query("stream_once", f"WITH {checks.BASE} SELECT id AS request_id, kind FROM base")
def stream_once(spark, d):
    """Every message is delivered three times, in three micro-batches."""
    rows = derive.base(spark, d).select(F.col("id").alias("request_id"), "kind", F.col("event_ts").alias("queued_at"))
    path, rows = _folder(spark, "arriving"), stored(rows, "rows")
    for _ in range(3):
        rows.write.mode("append").parquet(path)
    many = spark.read.parquet(path).rdd.getNumPartitions()
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, many // 3)).parquet(path)
    return _run(spark, once(stream, delay="60 days"), "once").select("request_id", "kind")


@query("stream_events_with_analytics", f"""WITH {_ANALYZED}, a AS (SELECT analytics.*, event_ts AS found FROM analytics JOIN ev USING (event_id) WHERE risk_score > 20),
  mark AS (SELECT 1000 * (least(epoch_ms((SELECT max(event_ts) FROM ev)), epoch_ms((SELECT max(found) FROM a))) - 600000) AS us)
  SELECT ev.event_id, ev.source_ip, ev.action, a.risk_score, array_to_string(a.names, ',') AS detections FROM ev LEFT JOIN a USING (event_id), mark WHERE a.event_id IS NOT NULL OR epoch_us(ev.event_ts) <= mark.us""")
def stream_events_with_analytics(spark, d):
    """Two streams of six micro-batches: events, and the analytics of those with some risk. Without them an event is given once it is closed."""
    ev = derive.security_events(spark, d)
    for c in fixed.FORWARD_EVENT_FIELDS:
        if c not in ev.columns:
            ev = ev.withColumn(c, F.lit(None).cast("string"))
    found = _arriving(spark, _analytics(spark, d).filter("risk_score > 20"), "timestamp")
    both = with_analytics(_arriving(spark, ev.select(*fixed.FORWARD_EVENT_FIELDS, "event_ts")), found)
    return _run(spark, both, "payloads").select("event_id", "source_ip", "action", "risk_score", joined("detections").alias("detections"))
