"""DuckDB SQL giving the expected answer of each query, from the same tables."""

from __future__ import annotations

from logsift import fixed
from logsift.plans import derive

# Own spellings of what the operators match: blanks as Python's str.strip knows them, digits and words by Unicode category.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
SPACE = "".join(rf"\x{{{ord(c):x}}}" for c in BLANKS)
DIGIT = r"[\p{Nd}]"
WORD = r"_\p{N}\p{L}"
EVENT_START = "|".join([
    r"^[\[{<]", "^(?:CE|LEE)F:", rf"^{DIGIT}{DIGIT}{DIGIT}{DIGIT}-{DIGIT}{DIGIT}-{DIGIT}{DIGIT}",
    rf"^[A-Z][a-z][a-z][{SPACE}]+{DIGIT}{DIGIT}?[{SPACE}]+{DIGIT}{DIGIT}:{DIGIT}{DIGIT}:{DIGIT}{DIGIT}"])

_BLANKS = "'" + BLANKS.replace("'", "''") + "'"
KV = rf'([{WORD}]+)=("[^"]*"|[^{SPACE}]+)'
IDENT = rf"(?:^|[|{SPACE}])([A-Za-z_][A-Za-z0-9_-]*)=([^|{SPACE}]+)"
KEYED = rf"(?:^|[|{SPACE},])([A-Za-z_][A-Za-z0-9_-]*)[=:]([^|{SPACE},]+)"
FIELD = r'(?:"(?:[^"]|"")*(?:"[^,\r\n]*)?|[^",\r\n][^,\r\n]*|)'
ROW = rf"{FIELD}(?:,{FIELD})*"
SYSLOG_TIME = rf"[A-Z][a-z]{{2}}[{SPACE}]+{DIGIT}{{1,2}}[{SPACE}]+{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def last(key: str) -> str:
    """The value of the last pair with this key, from the lists k and v."""
    return f"CASE WHEN list_contains(k, {q(key)}) THEN v[len(k) - list_position(list_reverse(k), {q(key)}) + 1] END"


BASE = "base AS (" + derive.base_sql("duckdb") + ")"
SEC = f"{BASE}, ev AS ({derive.EVENTS})"

IS_JSON = "(starts_with(t, '{') AND json_valid(t))"
IS_WINDOWS = f"(contains(t, '<Event xmlns=') AND contains(t, {q(fixed.WINDOWS_NAMESPACE)}))"
IS_SYSLOG = f"regexp_matches(t, '^<{DIGIT}+>')"
IS_XML = "(starts_with(lower(t), '<event') AND ends_with(lower(t), '</event>') AND NOT regexp_matches(t, '<act>[^<]*</event>$'))"
UNQUOTE = (
    "CASE WHEN starts_with(x, '\"') THEN replace(regexp_extract(x, '^\"((?:[^\"]|\"\")*)', 1), '\"\"', '\"')"
    " || regexp_extract(x, '^\"(?:[^\"]|\"\")*\"([^,\\r\\n]*)', 1) ELSE x END"
)
CSV_PREP = f"""SELECT *, list_transform(regexp_extract_all(',' || head, {q(',(' + FIELD + ')')}, 1), lambda x: {UNQUOTE}) AS h,
    CASE WHEN regexp_matches(rest, '^\\r*\\n') THEN list_transform(regexp_extract_all(',' || regexp_extract(regexp_replace(rest, '^\\r*\\n', ''), {q('^' + ROW)}, 0), {q(',(' + FIELD + ')')}, 1), lambda x: {UNQUOTE}) END AS r
  FROM (SELECT *, substr(t, length(head) + 1) AS rest FROM (SELECT *, regexp_extract(t, {q('^' + ROW)}, 0) AS head FROM texts))"""
IS_CSV = f"""(contains(t, ',') AND NOT starts_with(t, 'CEF:') AND NOT starts_with(t, 'LEEF:') AND NOT starts_with(t, '<') AND NOT starts_with(t, '{{')
  AND len(h) >= 2 AND CASE WHEN r IS NOT NULL THEN len(h) = len(r) AND len(list_filter(h, lambda x: trim(x, {_BLANKS}) <> '' AND NOT regexp_matches(trim(x, {_BLANKS}), '^{DIGIT}+$'))) > 0
       ELSE len(list_filter(h, lambda x: trim(x, {_BLANKS}) <> '' AND NOT contains(x, '='))) = 0 END)"""
DETECT = f"""CASE WHEN t = '' THEN NULL WHEN {IS_JSON} THEN 'json' WHEN contains(t, '%ASA-') THEN 'cisco_asa'
  WHEN {IS_WINDOWS} THEN 'windows_event' WHEN starts_with(t, 'CEF:') THEN 'cef' WHEN starts_with(t, 'LEEF:') THEN 'leef'
  WHEN {IS_SYSLOG} THEN 'syslog' WHEN {IS_XML} THEN 'xml' WHEN {IS_CSV} THEN 'csv' END"""


def texts(source: str, key: str, raw: str, more: str = "") -> str:
    return f"texts AS (SELECT {key} AS event_id{more}, {raw} AS raw_event, trim({raw}, {_BLANKS}) AS t FROM {source})"


def logs(kind: str, more: str = ", event_ts, user_id, n") -> str:
    """base, logs, texts and csv (texts with their CSV rows)."""
    return f"{BASE}, logs AS ({derive.logs_sql(kind)}), {texts('logs', 'event_id', 'raw_event', more)}, csv AS ({CSV_PREP})"


def typed(kind: str) -> str:
    return f"{logs(kind)}, typed AS (SELECT *, {DETECT} AS parser FROM csv)"


# --- parsing: each format gives the same columns --------------------------------------------

COLUMNS = [
    "timestamp", "event_type", "source", "source_type", "source_ip", "source_port", "destination_ip",
    "destination_port", "protocol", "action", "severity", "user_name", "hostname", "application", "vendor",
    "product", "parse_status", "wrong",
]


def _pick(prep: str, where: str, ok: str = "true", **fields: str) -> str:
    cols = []
    for c in COLUMNS:
        if c == "parse_status":
            cols.append(f"CASE WHEN {ok} THEN 'success' ELSE 'error' END AS parse_status")
        elif c == "source_type":
            cols.append(f"CASE WHEN {ok} THEN {fields[c]} ELSE 'unknown' END AS source_type")
        else:
            cols.append(f"CASE WHEN {ok} THEN {fields.get(c, 'NULL')} END AS {c}")
    return f"SELECT event_id, raw_event, t, parser, {', '.join(cols)} FROM ({prep}) WHERE {where}"


def _only(kind: str) -> str:
    return f"SELECT * FROM typed WHERE parser = '{kind}'"


def parse_parts() -> dict[str, str]:
    js = lambda *ks: "coalesce(" + ", ".join(f"t->>'$.{k}'" for k in ks) + ")"
    parts = {}
    parts["json"] = _pick(
        _only("json"), "true", source_type="'json'", timestamp=js("time", "eventTime"),
        source_ip=js("source_ip", "src"), source_port=js("sport", "source_port"), destination_ip=js("dst", "destination_ip"),
        destination_port=js("dport", "destination_port"), action=js("action", "act", "eventName"),
        severity="nullif(t->>'$.sev', '')", user_name=js("user", "userIdentity.userName"),
        vendor="coalesce(nullif(t->>'$.vendor', ''), t->>'$.device_vendor')",
        wrong="CASE WHEN json_type(t, '$.action') = 'UBIGINT' THEN 'action: not a string' END")
    cef = f"""SELECT *, regexp_extract_all(ext, {q(KV)}, 1) AS k, list_transform(regexp_extract_all(ext, {q(KV)}, 2), lambda x: trim(x, '"')) AS v
      FROM (SELECT *, array_to_string(a[8:], '|') AS ext FROM (SELECT *, string_split(substr(t, 5), '|') AS a FROM ({_only('cef')})))"""
    parts["cef"] = _pick(
        cef, "true", "len(a) >= 8", source_type="'cef'", source_ip=last("src"), destination_ip=last("dst"),
        destination_port=last("dpt"), action=last("act"), severity="nullif(a[7], '')", event_type="nullif(a[6], '')",
        user_name=last("duser"), vendor="a[2]", product="a[3]", source="a[3]")
    leef = f"""SELECT *, list_transform(items, lambda x: trim(split_part(x, '=', 1))) AS k, list_transform(items, lambda x: trim(trim(substr(x, strpos(x, '=') + 1)), '"')) AS v FROM (
      SELECT *, list_filter(string_split(replace(CASE WHEN len(a) < 6 THEN inl WHEN inl <> '' THEN inl || delim || more_ ELSE more_ END, delim, chr(9)), chr(9)), lambda x: contains(x, '=')) AS items FROM (
      SELECT *, CASE WHEN marked THEN CASE a[6] WHEN '0x7c' THEN '|' ELSE a[6] END ELSE chr(9) END AS delim, array_to_string(list_slice(a, CASE WHEN marked THEN 7 ELSE 6 END, len(a)), '|') AS more_,
        CASE WHEN contains(a[5], chr(9)) THEN substr(a[5], strpos(a[5], chr(9)) + 1) ELSE '' END AS inl FROM (
      SELECT *, coalesce(len(a) >= 7 AND length(a[6]) <= 4 AND (contains(a[6], 'x') OR length(a[6]) = 1), false) AS marked FROM (
      SELECT *, string_split(substr(t, 6), '|') AS a FROM ({_only('leef')})))))"""
    parts["leef"] = _pick(
        leef, "true", "len(a) >= 5", source_type="'leef'", source_ip=last("src"), destination_ip=last("dst"),
        source_port=last("sport"), destination_port=last("dport"), action=last("act"),
        event_type="split_part(a[5], chr(9), 1)", vendor="a[2]", product="a[3]", source="a[3]")
    pair = f"""regexp_extract_all(t, {q(KV)}, 1) AS k, list_transform(regexp_extract_all(t, {q(KV)}, 2), lambda x: trim(x, '"')) AS v"""
    parts["syslog"] = _pick(
        f"SELECT *, {pair} FROM ({_only('syslog')})", "true", source_type="'syslog'", source_ip=last("src"),
        destination_ip=last("dst"), destination_port=last("dport"), action=last("act"), user_name=last("user"),
        timestamp=f"nullif(regexp_extract(t, {q('^<' + DIGIT + '+>(' + SYSLOG_TIME + ')')}, 1), '')",
        source=f"nullif(regexp_extract(t, {q('^<' + DIGIT + '+>' + SYSLOG_TIME + '[' + SPACE + ']+([^' + SPACE + ']+)')}, 1), '')")
    csv = f"""SELECT *, CASE WHEN r IS NOT NULL THEN list_transform(h, lambda x: trim(x, {_BLANKS})) ELSE list_transform(list_filter(h, lambda x: contains(x, '=')), lambda x: trim(split_part(x, '=', 1), {_BLANKS})) END AS k,
      CASE WHEN r IS NOT NULL THEN list_transform(r, lambda x: trim(x, {_BLANKS})) ELSE list_transform(list_filter(h, lambda x: contains(x, '=')), lambda x: trim(substr(x, strpos(x, '=') + 1), {_BLANKS})) END AS v FROM ({_only('csv')})"""
    parts["csv"] = _pick(
        csv, "true", source_type="'csv'", source_ip=f"coalesce({last('source_ip')}, {last('src')})",
        destination_ip=last("dst"), destination_port=last("dport"), action=last("act"), timestamp=last("timestamp"))
    line = r"%ASA-(\p{Nd})-(\p{Nd}+):([^\n]*)"
    end = r" [a-zA-Z0-9_\-]+:(\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+)/(\p{Nd}+)"
    side = lambda s, g: f"CASE WHEN regexp_matches(m, 'Deny tcp|Deny udp|Teardown') THEN nullif(regexp_extract(m, {q(s + end)}, {g}), '') END"
    parts["cisco_asa"] = _pick(
        f"SELECT *, regexp_extract(t, {q(line)}, 3) AS m FROM ({_only('cisco_asa')})", "true",
        source_type="'cisco:asa'", vendor="'Cisco'", product="'ASA'", source="'ASA'",
        severity=f"nullif(regexp_extract(t, {q(line)}, 1), '')", event_type=f"nullif(regexp_extract(t, {q(line)}, 2), '')",
        action="CASE WHEN regexp_matches(m, 'Deny tcp|Deny udp|Teardown') THEN CASE WHEN contains(m, 'Deny') THEN 'Deny' ELSE 'Teardown' END END",
        source_ip=side("src", 1), source_port=side("src", 2), destination_ip=side("dst", 1), destination_port=side("dst", 2))
    sound = "ends_with(t, '</Event>')"
    tag = lambda p: f"CASE WHEN {sound} THEN nullif(regexp_extract(t, {q(p)}, 1), '') END"
    parts["windows_event"] = _pick(
        _only("windows_event"), "true", source_type="'windows:eventlog'", vendor="'Microsoft'", product="'Windows'",
        source="'Windows'", event_type=tag("<EventID>([^<]*)</EventID>"), timestamp=tag('SystemTime="([^"]*)"'),
        hostname=tag("<Computer>([^<]*)<"), application=tag('Provider Name="([^"]*)"'),
        source_ip=tag('"IpAddress">([^<]*)<'), source_port=tag('"IpPort">([^<]*)<'), user_name=tag('"TargetUserName">([^<]*)<'))
    el = lambda p: f"nullif(regexp_extract(t, {q(p)}, 1), '')"
    parts["xml"] = _pick(
        _only("xml"), "true", source_type="'xml'", source_ip=f"coalesce({el('<src>([^<]*)</src>')}, {el('IpAddress.>([^<]*)<')})",
        destination_ip=el("<dst>([^<]*)</dst>"), destination_port=el("<dport>([^<]*)</dport>"),
        protocol=el("<proto>([^<]*)</proto>"), action=el("<act>([^<]*)</act>"),
        event_type=el("<EventID>([^<]*)</EventID>"), timestamp=el('SystemTime="([^"]*)"'))
    parts[""] = _pick("SELECT * FROM typed", "parser IS NULL", source_type="'unknown'").replace(
        "CASE WHEN true THEN 'success' ELSE 'error' END AS parse_status", "'unknown' AS parse_status")
    return parts


def _is_v4(c: str) -> str:
    number = "regexp_matches(o, '^[0-9]{1,3}$') AND (o = '0' OR NOT starts_with(o, '0')) AND coalesce(TRY_CAST(o AS INT), 999) <= 255"
    return f"(len(string_split({c}, '.')) = 4 AND len(list_filter(string_split({c}, '.'), lambda o: {number})) = 4)"


def is_ip(c: str) -> str:
    """By counting: four numbers; or eight groups of hexadecimal digits, or fewer around one '::', of which numbers at the end count as two."""
    base = f"regexp_replace({c}, '%[^%]+$', '')"
    groups = lambda h: f"(CASE WHEN {h} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({h}, ':') END)"
    hexes = lambda g: f"len(list_filter({g}, lambda x: regexp_matches(x, '^[0-9A-Fa-f]{{1,4}}$')))"
    halves = f"string_split({base}, '::')"
    head = f"(CASE WHEN len({halves}) = 2 THEN {groups(halves + '[1]')} ELSE CAST([] AS VARCHAR[]) END)"
    tail = groups(f"{halves}[len({halves})]")
    numbers = f"({hexes(tail)} = len({tail}) - 1 AND coalesce({_is_v4(tail + '[len(' + tail + ')]')}, false))"
    size = f"len({head}) + len({tail}) + CASE WHEN {numbers} THEN 1 ELSE 0 END"
    v6 = f"(contains({c}, ':') AND {hexes(head)} = len({head}) AND ({hexes(tail)} = len({tail}) OR {numbers}) AND CASE len({halves}) WHEN 1 THEN {size} = 8 WHEN 2 THEN {size} <= 7 ELSE false END)"
    return f"({_is_v4(c)} OR {v6})"


def _port(c: str) -> str:
    return f"try_cast(trim({c}) AS BIGINT)"


# Types are settled, blank addresses dropped and the reason for a rejection found.
EVENTS_OF = f"""SELECT event_id, raw_event, t, parser, parse_status, timestamp, event_type, source, source_type, protocol, action, severity, user_name, hostname, application, vendor, product,
  CASE WHEN trim(source_ip, {_BLANKS}) NOT IN ('', '-') THEN source_ip END AS source_ip, CASE WHEN trim(destination_ip, {_BLANKS}) NOT IN ('', '-') THEN destination_ip END AS destination_ip,
  CAST(CASE WHEN {_port('source_port')} BETWEEN 0 AND 65535 THEN {_port('source_port')} END AS INT) AS source_port,
  CAST(CASE WHEN {_port('destination_port')} BETWEEN 0 AND 65535 THEN {_port('destination_port')} END AS INT) AS destination_port,
  CASE WHEN t = '' THEN 'Log cannot be empty' WHEN wrong IS NOT NULL THEN wrong
       WHEN {_port('source_port')} NOT BETWEEN 0 AND 65535 THEN 'source_port: out of range' WHEN {_port('destination_port')} NOT BETWEEN 0 AND 65535 THEN 'destination_port: out of range'
       WHEN source_ip NOT IN ('', '-') AND NOT {is_ip('source_ip')} THEN 'source_ip: Invalid IP address: ' || source_ip
       WHEN destination_ip NOT IN ('', '-') AND NOT {is_ip('destination_ip')} THEN 'destination_ip: Invalid IP address: ' || destination_ip END AS reject_reason FROM parsed"""


def parsed(kind: str, only: str | None = None) -> str:
    parts = parse_parts()
    chosen = parts.values() if only is None else [parts[only]]
    return f"{typed(kind)}, parsed AS ({' UNION ALL '.join(chosen)}), events1 AS ({EVENTS_OF})"


SHOWN = ("event_id, parser, parse_status, timestamp, event_type, source, source_type, source_ip, source_port, destination_ip, "
         "destination_port, protocol, action, severity, user_name, hostname, application, vendor, product, reject_reason")

# --- quality --------------------------------------------------------------------------------


def _have(c: str) -> str:
    return f"coalesce({c} <> {0 if c.endswith('port') else q('')}, false)"


def quality_cols(ip_ok=is_ip) -> str:
    comp = " + ".join(f"{_have(c)}::INT" for c in fixed.QUALITY_FIELDS)
    valid = " + ".join([f"(NOT {_have(c)} OR {ip_ok(c)})::INT" for c in ("source_ip", "destination_ip")]
                       + [f"({c} IS NULL OR {c} BETWEEN 1 AND 65535)::INT" for c in ("source_port", "destination_port")])
    bi = f"({_have('source_ip')} AND {_have('destination_ip')})"
    bp = "(source_port IS NOT NULL AND destination_port IS NOT NULL)"
    act = "(action IS NOT NULL)"
    n = f"({bi}::INT + {bp}::INT + {act}::INT)"
    return f"""round_even(({comp}) / 9.0::DOUBLE * 100, 0) AS completeness, round_even((coalesce(({valid}), 0)) / 4.0::DOUBLE * 100, 0) AS validity,
      CASE WHEN {n} = 0 THEN 100.0 ELSE round_even((coalesce((({bi} AND source_ip <> destination_ip)), false)::INT + coalesce(({bp} AND source_port <> destination_port), false)::INT + coalesce(({act} AND trim(action, {_BLANKS}) <> ''), false)::INT) / {n}::DOUBLE * 100, 0) END AS consistency"""


def scored(source: str) -> str:
    miss = lambda fs: "array_to_string(list_filter([" + ", ".join(
        f"CASE WHEN NOT {_have(f)} THEN '{f}' END" for f in fs) + "], lambda x: x IS NOT NULL), ', ')"
    return f"""scored AS (SELECT *, CASE WHEN required <> '' OR validity < 50 THEN 'invalid' WHEN quality_score < 70 THEN 'partial' ELSE 'complete' END AS quality_status
      FROM (SELECT *, round_even(completeness * 0.5::DOUBLE + validity * 0.3::DOUBLE + consistency * 0.2::DOUBLE, 0) AS quality_score
      FROM (SELECT *, {quality_cols()}, {miss(fixed.REQUIRED_FIELDS)} AS required, {miss(fixed.IMPORTANT_FIELDS)} AS important, {miss(fixed.QUALITY_FIELDS)} AS missing FROM {source})))"""


# --- format guesses -------------------------------------------------------------------------

def check_sql() -> str:
    tests = {
        "cef": "starts_with(t, 'CEF:')", "json": IS_JSON, "syslog": IS_SYSLOG,
        "vendor-key-value": f"regexp_matches(t, {q('(?:^|[^' + WORD + '])[A-Za-z_][A-Za-z0-9_-]*=[^' + SPACE + ']')})",
        "pipe-delimited": "contains(t, '|')",
        "xml": "(starts_with(t, '<') AND ends_with(t, '>') AND regexp_matches(t, '<[A-Za-z][^>]*>'))",
        "csv-like": "(NOT contains(t, '=') AND len(string_split(t, ',')) >= 3)",
    }
    rows = ", ".join(f"CASE WHEN {c} THEN {{'f': '{f}', 'c': {fixed.CHECK_CONFIDENCE[f]}::DOUBLE, 'r': {q(fixed.CHECK_REASONS[f])}}} END" for f, c in tests.items())
    return f"""guess AS (SELECT *, list_filter(cands, lambda x: x.f IN ('syslog', 'json', 'cef')) AS good, list_max(list_transform(cands, lambda x: x.c)) AS top
      FROM (SELECT *, list_filter([{rows}], lambda x: x IS NOT NULL) AS cands FROM texts))"""


CHECK_OUT = """CASE WHEN t = '' THEN 'invalid' WHEN len(good) > 0 THEN 'supported' ELSE 'unknown' END AS status, (t <> '' AND len(good) > 0) AS supported,
  CASE WHEN t <> '' AND len(good) > 0 THEN good[1].f ELSE 'unknown' END AS format, CASE WHEN t = '' THEN 0.0::DOUBLE WHEN len(good) > 0 THEN good[1].c WHEN len(cands) > 0 THEN top ELSE 0.0::DOUBLE END AS confidence,
  CASE WHEN t <> '' AND len(good) = 0 AND len(cands) > 0 THEN list_filter(cands, lambda x: x.c = top)[1].f END AS suggested_format,
  CASE WHEN t = '' THEN 'Log is empty' WHEN len(good) > 0 THEN good[1].r WHEN len(cands) > 0 THEN list_filter(cands, lambda x: x.c = top)[1].r ELSE """ + q(fixed.REASON_NO_SIGNATURE) + """ END AS reason,
  array_to_string(list_transform(cands, lambda x: x.f), ',') AS candidates"""


def classify_sql(source: str = "texts") -> str:
    def cand(test: str, key: str, name: str | None = None) -> str:
        c, r, p = fixed.CLASSIFIER[key]
        return f"CASE WHEN {test} THEN {{'f': '{name or key}', 'c': {c}::DOUBLE, 'r': {q(r)}, 'p': '{p}'}} END"

    tagged = "(starts_with(t, '<') AND ends_with(t, '>'))"
    windows = f"contains(t, {q('<Event xmlns=' + chr(34) + fixed.WINDOWS_NAMESPACE + chr(34) + '>')})"
    pieces = "len(string_split(t, '|')) >= 7"
    n = f"len(regexp_extract_all(t, {q(KEYED)}, 0))"
    parts = [
        cand(IS_JSON, "json"), cand(f"CASE WHEN {IS_JSON} THEN json_type(t, '$.Records') = 'ARRAY' END", "aws_cloudtrail"),
        cand(f"starts_with(t, 'CEF:') AND {pieces}", "cef"), cand(f"starts_with(t, 'CEF:') AND NOT ({pieces})", "cef_partial", "cef"),
        cand("starts_with(t, 'LEEF:')", "leef"), cand(IS_SYSLOG, "syslog"), cand(f"{IS_SYSLOG} AND contains(t, 'ASA-')", "cisco_asa"),
        cand(f"{tagged} AND {windows}", "windows_event"), cand(f"{tagged} AND NOT {windows}", "xml"),
        cand("NOT contains(t, '=') AND NOT contains(t, '{') AND len(string_split(t, ',')) > 3", "csv"),
        f"CASE WHEN nkv >= 3 AND NOT ({IS_JSON} OR starts_with(t, 'CEF:') OR starts_with(t, 'LEEF:') OR ({tagged} AND NOT {windows})) THEN "
        "{'f': 'unknown', 'c': least(0.8::DOUBLE, 0.2::DOUBLE + nkv * 0.1::DOUBLE), 'r': 'Detected generic key-value structure with ' || nkv || ' fields', 'p': 'generic_kv'} END",
    ]
    return f"""guessed AS (SELECT *, list_filter(cands, lambda x: x.c >= best.c - 0.1::DOUBLE AND x.f <> best.f) AS rivals FROM (
      SELECT *, list_filter(cands, lambda x: x.c = top)[1] AS best FROM (SELECT *, list_max(list_transform(cands, lambda x: x.c)) AS top FROM (
      SELECT *, list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL) AS cands FROM (SELECT *, {n} AS nkv FROM {source}))))),
    classed AS (SELECT *, coalesce(len(rivals), 0) > 0 AND best.c < 0.95 AS unsure FROM guessed)"""


CLASS_OUT = f"""CASE WHEN t = '' OR len(cands) = 0 OR unsure THEN 'unknown' ELSE best.f END AS format,
  round(CASE WHEN t = '' OR len(cands) = 0 THEN 0.0::DOUBLE WHEN unsure THEN best.c - 0.2::DOUBLE ELSE best.c END, 6) AS confidence,
  CASE WHEN t = '' THEN {q('; '.join(fixed.CLASSIFY_EMPTY))} WHEN len(cands) = 0 THEN {q('; '.join(fixed.CLASSIFY_NONE))}
    WHEN unsure THEN 'Ambiguous: Log resembles ' || best.f || ' and ' || array_to_string(list_transform(rivals, lambda x: x.f), ', ') || '; ' || best.r ELSE best.r END AS reasons,
  CASE WHEN t = '' OR len(cands) = 0 THEN '' ELSE best.p END AS patterns,
  CASE WHEN t = '' OR len(cands) = 0 OR unsure THEN NULL WHEN best.c >= 0.8 THEN best.f END AS suggested_parser"""

# --- rules ----------------------------------------------------------------------------------

FAILED = """(contains(lower(coalesce(action, '')), 'fail') OR contains(lower(coalesce(event_type, '')), 'fail')
  OR (lower(coalesce(severity, '')) = 'error' AND regexp_matches(lower(coalesce(event_type, '')), 'auth|login')))"""


def trailing(source: str, seconds: int) -> str:
    return f"""(SELECT event_id, count(*) OVER (PARTITION BY source_ip ORDER BY event_ts RANGE BETWEEN INTERVAL {seconds} SECONDS PRECEDING AND CURRENT ROW)
      - count(*) OVER (PARTITION BY source_ip, event_ts) + row_number() OVER (PARTITION BY source_ip, event_ts ORDER BY event_id) AS c FROM {source})"""


ABNORMAL = """coalesce(destination_port <> 0 AND ((lower(protocol) = 'http' AND destination_port NOT IN (80, 8080, 443, 8443)) OR (lower(protocol) = 'ssh' AND destination_port <> 22)), false)"""
COMMAND = "lower(coalesce(nullif(command, ''), process_command, ''))"
RISKY = "(" + " OR ".join(f"contains({COMMAND}, {q(c)})" for c in fixed.SUSPICIOUS_COMMANDS) + ")"


def anomaly_sql(bucket: int, z: float, history: int = 100, samples: int = 50) -> str:
    return f"""buckets AS (SELECT b, count(*) AS k FROM (SELECT CAST(floor(epoch_us(event_ts) / {bucket * 1000000}.0) AS BIGINT) AS b FROM ev) GROUP BY b),
    basel AS (SELECT b, count(*) OVER w AS nb, avg(k) OVER w AS m, stddev_pop(k) OVER w AS sd FROM buckets WINDOW w AS (ORDER BY b ROWS BETWEEN {history} PRECEDING AND 1 PRECEDING)),
    zs AS (SELECT *, CASE WHEN nb >= {samples} AND sd > 0 THEN (rc - m) / sd END AS z FROM (SELECT ev.*, nb, m, sd, row_number() OVER (PARTITION BY b ORDER BY event_ts, event_id) AS rc
      FROM (SELECT *, CAST(floor(epoch_us(event_ts) / {bucket * 1000000}.0) AS BIGINT) AS b FROM ev) ev JOIN basel USING (b))),
    anom AS (SELECT event_id, coalesce(z >= {z}, false) AS anomaly, CASE WHEN z >= {z} THEN round(least(1.0, 0.5 + (z - {z}) * 0.1::DOUBLE), 2) ELSE 0.0 END AS anomaly_score,
      CASE WHEN nb < {samples} THEN {q(fixed.REASON_NO_BASELINE)} WHEN sd = 0 THEN {q(fixed.REASON_FLAT_BASELINE)} WHEN z >= {z} THEN printf('Event rate is %.2f standard deviations above baseline', z) ELSE '' END AS anomaly_reason FROM zs)"""


def ruled(login: int, login_s: int, spike: int, spike_s: int) -> str:
    return f"""located AS (SELECT * FROM ev WHERE coalesce(source_ip, '') <> ''), failures AS (SELECT * FROM located WHERE {FAILED}),
    counted AS (SELECT ev.*, {FAILED} AS failed, f.c AS fc, s.c AS sc FROM ev LEFT JOIN {trailing('failures', login_s)} f USING (event_id) LEFT JOIN {trailing('located', spike_s)} s USING (event_id)),
    hits AS (SELECT event_id, severity, list_filter([
        CASE WHEN failed AND fc >= {login} THEN 'repeated_failed_login' END, CASE WHEN sc >= {spike} THEN 'source_ip_spike' END,
        CASE WHEN {ABNORMAL} THEN 'abnormal_destination_port' END, CASE WHEN {RISKY} THEN 'suspicious_command' END], lambda x: x IS NOT NULL) AS names,
      list_filter([
        CASE WHEN failed AND fc >= {login} THEN fc || ' failed login events from ' || source_ip || ' within {login_s}s' END,
        CASE WHEN sc >= {spike} THEN 'Excessive activity: ' || sc || ' events from ' || source_ip || ' within {spike_s}s' END,
        CASE WHEN {ABNORMAL} THEN 'Port ' || destination_port || ' is unusual for protocol ' || lower(protocol) END,
        CASE WHEN {RISKY} THEN 'Suspicious command execution detected: ' || left({COMMAND}, 50) END], lambda x: x IS NOT NULL) AS why FROM counted)"""


def analyzed(login: int, login_s: int, spike: int, spike_s: int, bucket: int, z: float, events: str = SEC) -> str:
    return f"""{events}, {ruled(login, login_s, spike, spike_s)}, {anomaly_sql(bucket, z)},
    risked AS (SELECT event_id, len(names) > 0 AS detected, anomaly, anomaly_score, names, CASE WHEN anomaly THEN list_append(why, anomaly_reason) ELSE why END AS why,
      CAST(greatest(0, least(100, CASE lower(severity) WHEN 'critical' THEN 50 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 WHEN 'low' THEN 5 ELSE 0 END + 20 * len(names)
        + CASE WHEN list_contains(names, 'repeated_failed_login') THEN 15 ELSE 0 END + CASE WHEN list_contains(names, 'suspicious_command') THEN 40 ELSE 0 END
        + CASE WHEN anomaly THEN CAST(trunc(anomaly_score * 30) AS INT) ELSE 0 END)) AS INT) AS risk_score FROM hits JOIN anom USING (event_id)),
    analytics AS (SELECT *, CASE WHEN risk_score < 25 THEN 'low' WHEN risk_score < 50 THEN 'medium' WHEN risk_score < 75 THEN 'high' ELSE 'critical' END AS severity FROM risked)"""
