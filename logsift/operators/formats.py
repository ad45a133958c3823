"""The log formats: how each is recognised and turned into a map of fields.

A format is a `FormatSpec`: two functions from a `LogView` to a column. `parse` gives the
struct built by `parsed()`. Both are plain expressions, so Spark plans the whole chain of
formats as one CASE in one stage.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.fixed import CSV_ALIASES, FORMAT_PRIORITY, VENDOR_FORMAT_VERSION, WINDOWS_NAMESPACE
from logsift.functions.jsonmap import json_texts, json_types
from logsift.functions.text import DIGIT, SPACE, entries, is_blank, matches, pairs, strip, to_map, with_value, word_pairs

TEXT_MAP = "map<string,string>"


class LogView(NamedTuple):
    """What a format may look at: the stripped text and the shared readings of it."""

    text: Column
    json: Column
    xml: Column
    windows: Column
    csv_head: Column
    csv_next: Column


@dataclass(frozen=True)
class FormatSpec:
    name: str
    priority: int
    match: Callable[[LogView], Column]
    parse: Callable[[LogView], Column]
    version: str | None = None
    enabled: bool = True


def parsed(fields: Column, error: Column | None = None, types: Column | None = None,
           extras: Column | None = None) -> Column:
    """The result of a parse; `error` non-null means it failed."""
    empty = F.lit(None)
    return F.struct(
        fields.cast(TEXT_MAP).alias("fields"),
        (types if types is not None else empty).cast(TEXT_MAP).alias("types"),
        (extras if extras is not None else empty).cast(TEXT_MAP).alias("plugin_data"),
        (error if error is not None else empty).cast("string").alias("error"),
    )


class FormatRegistry:
    """Formats in (priority, name) order. Plain configuration, read when a query is built."""

    def __init__(self, specs: list[FormatSpec] | None = None):
        self._specs: dict[str, FormatSpec] = {}
        for spec in specs or []:
            self.register(spec)

    def register(self, spec: FormatSpec) -> FormatRegistry:
        if not spec.name:
            raise ValueError("a format needs a name")
        if spec.name in self._specs:
            raise ValueError(f"format '{spec.name}' is already registered")
        self._specs[spec.name] = spec
        return self

    def unregister(self, name: str) -> FormatRegistry:
        del self._specs[name]
        return self

    def _switch(self, name: str, on: bool) -> FormatRegistry:
        self._specs[name] = replace(self._specs[name], enabled=on)
        return self

    def enable(self, name: str) -> FormatRegistry:
        return self._switch(name, True)

    def disable(self, name: str) -> FormatRegistry:
        return self._switch(name, False)

    def get(self, name: str) -> FormatSpec | None:
        return self._specs.get(name)

    def all(self) -> list[FormatSpec]:
        return sorted(self._specs.values(), key=lambda s: (s.priority, s.name))

    def active(self) -> list[FormatSpec]:
        return [s for s in self.all() if s.enabled]

    def names(self) -> list[str]:
        return [s.name for s in self.active()]


# --- JSON ---------------------------------------------------------------------------------

def _json_parse(v: LogView) -> Column:
    return parsed(
        F.map_concat(F.create_map(F.lit("source_type"), F.lit("json")), json_texts(v.json)),
        types=F.map_concat(F.create_map(F.lit("source_type"), F.lit("string")), json_types(v.json)),
    )


# --- CEF ----------------------------------------------------------------------------------

def _cef_parse(v: LogView) -> Column:
    return with_value(F.split(F.substr(v.text, F.lit(5)), "[|]", 8), _cef_parts)


def _cef_parts(part: Column) -> Column:
    at = lambda i: F.get(part, i)
    header = entries(
        source_type=F.lit("cef"), cef_version=at(0), device_vendor=at(1), device_product=at(2),
        device_version=at(3), signature_id=at(4), event_name=at(5), severity=at(6),
    )
    complete = F.size(part) == 8
    fields = F.when(complete, to_map(header, word_pairs(at(7))))
    return parsed(fields, F.when(~complete, "Invalid CEF format"))


# --- LEEF ---------------------------------------------------------------------------------

def _leef_parse(v: LogView) -> Column:
    return with_value(F.split(F.substr(v.text, F.lit(6)), "[|]"), _leef_parts)


def _leef_parts(part: Column) -> Column:
    count = F.size(part)
    at = lambda i: F.get(part, i)
    name = at(4)

    # Fields may follow the event id without a pipe: after a tab, or after a blank before `key=`.
    tab = F.instr(name, "\t")
    gap = rf"^(.*?)[{SPACE}]+([\p{{L}}\p{{N}}_]+=.*)$"
    spaced = name.rlike("(?s)" + gap)
    event_id = (
        F.when(tab > 0, F.substring_index(name, "\t", 1))
        .when(spaced, strip(F.regexp_extract(name, "(?s)" + gap, 1)))
        .otherwise(name)
    )
    inline = (
        F.when(tab > 0, F.substr(name, tab + 1))
        .when(spaced, strip(F.regexp_extract(name, "(?s)" + gap, 2)))
        .otherwise("")
    )

    mark = at(5)
    has_mark = (count >= 7) & (F.length(mark) <= 4) & (F.contains(mark, F.lit("x")) | (F.length(mark) == 1))
    hexed = mark.rlike("^0x_?[0-9A-Fa-f]{1,2}$")
    code = F.conv(F.replace(F.substr(mark, F.lit(3)), F.lit("_"), F.lit("")), 16, 10)
    delimiter = (
        F.when(has_mark & hexed, F.char(code.cast("bigint"))).when(has_mark, mark).otherwise("\t")
    )
    rest = F.array_join(F.slice(part, F.when(has_mark, 7).otherwise(6), F.greatest(count, F.lit(1))), "|")
    extension = (
        F.when(count < 6, inline)
        .when(inline != "", F.concat(inline, delimiter, rest))
        .otherwise(rest)
    )
    # Items are cut at the delimiter and again at tabs, so one cut at tabs does both.
    items = F.transform(F.split(F.replace(extension, delimiter, F.lit("\t")), "\t"), strip)
    found = F.transform(
        pairs(F.filter(items, lambda i: F.contains(i, F.lit("="))), ""),
        lambda p: F.struct(strip(p["key"]).alias("key"),
                           F.btrim(strip(p["value"]), F.lit('"')).alias("value")),
    )
    header = entries(
        source_type=F.lit("leef"), leef_version=at(0), vendor=at(1), device_vendor=at(1),
        product=at(2), device_product=at(2), version=at(3), device_version=at(3),
        event_id=event_id, signature_id=event_id,
    )
    complete = count >= 5
    fields = F.when(complete, to_map(header, found))
    message = "Invalid LEEF format: Header requires at least 5 pipe-separated fields"
    return parsed(fields, F.when(~complete, message))


# --- syslog -------------------------------------------------------------------------------

SYSLOG_START = rf"^<{DIGIT}+>"
SYSLOG_TIME = (
    rf"[A-Z][a-z]{{2}}[{SPACE}]+{DIGIT}{{1,2}}[{SPACE}]+{DIGIT}{{2}}:{DIGIT}{{2}}:{DIGIT}{{2}}"
)


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null where nothing matches."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _syslog_parse(v: LogView) -> Column:
    header = entries(
        source_type=F.lit("syslog"),
        priority=F.regexp_replace(_found(v.text, rf"^<({DIGIT}+)>"), "^0+(?=.)", ""),
        timestamp=_found(v.text, rf"{SYSLOG_START}({SYSLOG_TIME})"),
        source=_found(v.text, rf"{SYSLOG_START}{SYSLOG_TIME}[{SPACE}]+([^{SPACE}]+)"),
    )
    return parsed(to_map(header, word_pairs(v.text)))


# --- CSV ----------------------------------------------------------------------------------

# One field: quoted (doubled quotes inside, line breaks allowed, text may follow the closing
# quote, the closing quote may be missing at the end) or plain. Possessive, hence linear.
CSV_FIELD = r'(?:"(?:[^"]++|"")*+(?:"[^,\r\n]*+)?|(?!")[^,\r\n]*+)'
CSV_ROW = rf"{CSV_FIELD}(?:,{CSV_FIELD})*+"
CSV_WHOLE = rf"^{CSV_ROW}(?:\r*+\n{CSV_ROW})*+\r*$"


def csv_row(text: Column, number: int) -> Column:
    """The fields of the first or second row, unquoted; null where that row does not exist."""
    first = F.regexp_extract(text, f"^{CSV_ROW}", 0)
    if number == 1:
        row = first
    else:
        rest = F.substr(text, F.length(first) + 1)
        row = F.when(rest.rlike(r"^\r*\n"),
                     F.regexp_extract(F.regexp_replace(rest, r"^\r*\n", ""), f"^{CSV_ROW}", 0))

    def unquote(item: Column) -> Column:
        field = F.substr(item, F.lit(2))
        body = F.regexp_extract(field, r'^"((?:[^"]++|"")*+)', 1)
        tail = F.regexp_extract(field, r'^"(?:[^"]++|"")*+"([^,\r\n]*+)', 1)
        return F.when(F.startswith(field, F.lit('"')),
                      F.concat(F.replace(body, F.lit('""'), F.lit('"')), tail)).otherwise(field)

    return F.transform(matches(F.concat(F.lit(","), row), f",{CSV_FIELD}"), unquote)


def csv_candidate(text: Column) -> Column:
    """Text worth cutting into CSV rows: it has a comma, is no other format, and has no stray
    carriage return outside quotes."""
    usable = F.contains(text, F.lit(","))
    for start in ["CEF:", "LEEF:", "<", "{"]:
        usable = usable & ~F.startswith(text, F.lit(start))
    return F.when(usable, ~F.contains(text, F.lit("\r")) | text.rlike(CSV_WHOLE)).otherwise(F.lit(False))


def _csv_match(v: LogView) -> Column:
    head, row = v.csv_head, v.csv_next
    named = F.exists(head, lambda c: ~is_blank(c) & ~strip(c).rlike(rf"^{DIGIT}+$"))
    assignments = F.forall(head, lambda c: is_blank(c) | F.contains(c, F.lit("=")))
    return (F.size(head) >= 2) & F.when(
        row.isNotNull(), F.when(F.size(head) == F.size(row), named).otherwise(F.lit(False))).otherwise(assignments)


def _csv_parse(v: LogView) -> Column:
    head, row = v.csv_head, v.csv_next
    by_name = F.zip_with(head, row, lambda k, x: F.struct(strip(k).alias("key"), strip(x).alias("value")))
    by_sign = F.transform(
        pairs(F.filter(head, lambda c: F.contains(c, F.lit("="))), ""),
        lambda p: F.struct(strip(p["key"]).alias("key"), strip(p["value"]).alias("value")),
    )
    own = to_map(F.when(row.isNotNull(), by_name).otherwise(by_sign))
    # The full names come first, so that a field the log names itself replaces the copy.
    names = F.create_map(*[F.lit(x) for pair in CSV_ALIASES.items() for x in pair])
    copies = F.transform_keys(F.map_filter(own, lambda k, _v: F.map_contains_key(names, k)), lambda k, _v: names[k])
    return parsed(F.map_concat(F.create_map(F.lit("source_type"), F.lit("csv")), copies, own))


# --- XML ----------------------------------------------------------------------------------

def xml_candidate(text: Column) -> Column:
    """Text worth handing to the XML reader: it opens a tag and is not syslog."""
    return F.startswith(text, F.lit("<")) & ~text.rlike(SYSLOG_START)


# --- vendors ------------------------------------------------------------------------------

def _asa_parse(v: LogView) -> Column:
    line = r"%ASA-(\p{Nd})-(\p{Nd}+):([^\n]*)"
    hit = v.text.rlike(line)
    message = F.regexp_extract(v.text, line, 3)
    traffic = message.rlike("Deny tcp|Deny udp|Teardown")
    end = r" [a-zA-Z0-9_\-]+:(\p{Nd}+\.\p{Nd}+\.\p{Nd}+\.\p{Nd}+)/(\p{Nd}+)"
    side = lambda name, group: F.when(traffic, _found(message, name + end, group))
    fields = entries(
        source_type=F.lit("cisco:asa"), vendor=F.lit("Cisco"), product=F.lit("ASA"),
        severity=F.when(hit, F.regexp_extract(v.text, line, 1)),
        event_type=F.when(hit, F.regexp_extract(v.text, line, 2)),
        action=F.when(traffic, F.when(F.contains(message, F.lit("Deny")), "Deny").otherwise("Teardown")),
        source_ip=side("src", 1), source_port=side("src", 2),
        destination_ip=side("dst", 1), destination_port=side("dst", 2),
    )
    return parsed(to_map(fields), extras=to_map(entries(cisco_message=F.when(hit, strip(message)))))


CLOUDTRAIL_RECORD = (
    "eventTime string, eventName string, eventSource string, sourceIPAddress string, userAgent string, "
    "errorCode string, requestID string, eventID string, awsRegion string, "
    "userIdentity struct<principalId:string,userName:string>"
)


def cloudtrail_records(text: Column) -> Column:
    shape = f"struct<Records:array<struct<{CLOUDTRAIL_RECORD.replace(' string', ':string').replace('userIdentity struct', 'userIdentity:struct')}>>>"
    return F.from_json(text, shape)["Records"]


def _cloudtrail_match(v: LogView) -> Column:
    source = F.try_variant_get(v.json["Records"], "$[0].eventSource", "string")
    return v.json.isNotNull() & F.contains(F.coalesce(source, F.lit("")), F.lit("amazonaws.com"))


def cloudtrail_fields(record: Column) -> Column:
    """Fields of one record; members that are absent stay present with a null value."""
    truthy = lambda c: F.nullif(c, F.lit(""))
    values = {
        "source_type": F.lit("aws:cloudtrail"), "vendor": F.lit("AWS"), "product": F.lit("CloudTrail"),
        "timestamp": record["eventTime"], "event_type": record["eventName"], "action": F.lit("API_CALL"),
        "source_ip": record["sourceIPAddress"],
        "user": F.coalesce(truthy(record["userIdentity"]["principalId"]), record["userIdentity"]["userName"]),
        "application": record["userAgent"],
        "severity": F.when(truthy(record["errorCode"]).isNull(), "INFO").otherwise("ERROR"),
    }
    return F.create_map(*[c for k, x in values.items() for c in (F.lit(k), x)])


def cloudtrail_extras(record: Column) -> Column:
    return F.create_map(*[c for k in ["requestID", "eventID", "awsRegion"] for c in (F.lit(k), record[k])])


def _cloudtrail_parse(v: LogView) -> Column:
    record = F.get(cloudtrail_records(v.text), 0)
    return parsed(cloudtrail_fields(record), extras=cloudtrail_extras(record))


def windows_candidate(text: Column) -> Column:
    return F.contains(text, F.lit("<Event xmlns=")) & F.contains(text, F.lit(WINDOWS_NAMESPACE))


def _windows_parse(v: LogView) -> Column:
    """Text that is not sound XML still succeeds, with the fixed fields only."""
    is_item = lambda k: F.startswith(k, F.lit("@"))
    items = F.map_filter(v.windows, lambda k, _v: is_item(k))
    extras = F.transform_keys(items, lambda k, _v: F.substr(k, F.lit(2)))
    names = F.create_map(*[F.lit(x) for x in (
        "@IpAddress", "source_ip", "@IpPort", "source_port", "@TargetUserName", "user")])
    raised = F.transform_keys(F.map_filter(items, lambda k, _v: F.map_contains_key(names, k)), lambda k, _v: names[k])
    fixed = F.create_map(*[F.lit(x) for x in (
        "source_type", "windows:eventlog", "vendor", "Microsoft", "product", "Windows")])
    return parsed(F.map_concat(fixed, F.map_filter(v.windows, lambda k, _v: ~is_item(k)), raised), extras=extras)


def default_registry() -> FormatRegistry:
    """All built-in formats, in their usual order."""
    def spec(name: str, match, parse, version: str | None = None) -> FormatSpec:
        return FormatSpec(name, FORMAT_PRIORITY[name], match, parse, version)

    vendor = VENDOR_FORMAT_VERSION
    starts = lambda prefix: lambda v: F.startswith(v.text, F.lit(prefix))
    return FormatRegistry([
        spec("json", lambda v: v.json.isNotNull(), _json_parse),
        spec("aws_cloudtrail", _cloudtrail_match, _cloudtrail_parse, vendor),
        spec("cisco_asa", lambda v: F.contains(v.text, F.lit("%ASA-")), _asa_parse, vendor),
        spec("windows_event", lambda v: windows_candidate(v.text), _windows_parse, vendor),
        spec("cef", starts("CEF:"), _cef_parse),
        spec("leef", starts("LEEF:"), _leef_parse),
        spec("syslog", lambda v: v.text.rlike(SYSLOG_START), _syslog_parse),
        spec("xml", lambda v: v.xml.isNotNull(), lambda v: parsed(v.xml)),
        spec("csv", _csv_match, _csv_parse),
    ])


def python_format(name: str, priority: int, can_parse: Callable[[str], bool],
                  parse: Callable[[str], dict], version: str | None = None) -> FormatSpec:
    """A format given as two Python functions, run over Arrow batches.

    An exception in `can_parse` is no match; one in `parse` becomes a parse error.
    """
    @F.pandas_udf(T.BooleanType())
    def accepts(text: pd.Series) -> pd.Series:
        def one(t):
            try:
                return bool(t is not None and can_parse(t))
            except Exception:
                return False
        return text.map(one).astype(bool)

    @F.pandas_udf(T.StructType().add("fields", T.MapType(T.StringType(), T.StringType())).add("error", T.StringType()))
    def reads(text: pd.Series) -> pd.DataFrame:
        def one(t):
            if t is None:
                return None, None
            try:
                return {str(k): None if x is None else str(x) for k, x in parse(t).items()}, None
            except Exception as problem:
                return None, str(problem)
        rows = [one(t) for t in text]
        return pd.DataFrame({"fields": [r[0] for r in rows], "error": [r[1] for r in rows]}, dtype=object)

    def parse_column(v: LogView) -> Column:
        out = reads(F.when(accepts(v.text), v.text))
        return parsed(out["fields"], out["error"])

    return FormatSpec(name, priority, lambda v: accepts(v.text), parse_column, version)
