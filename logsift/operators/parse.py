"""Which format a log has, and its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.settle import settled
from logsift.functions.text import identifier_pairs, is_blank, strip, to_map
from logsift.functions.xmlmap import windows_map, xml_map
from logsift.operators.formats import (
    FormatRegistry, LogView, cloudtrail_extras, cloudtrail_fields, cloudtrail_records, csv_candidate, csv_row,
    default_registry, parsed, windows_candidate, xml_candidate,
)
from logsift.operators.readings import JSON, TEXT, with_readings

_XML, _WINDOWS, _CSV, _HEAD, _NEXT = "_log_xml", "_log_windows", "_log_csv", "_log_csv_head", "_log_csv_next"
_PARSED = "_log_parsed"


def _with_view(df: DataFrame, registry: FormatRegistry, raw: str) -> tuple[DataFrame, LogView, list[str]]:
    """Add the readings the enabled formats need, each made once and only where it may be used.

    Python is planned only if XML or Windows events are enabled; other logs go to it as nulls.
    """
    df, added = with_readings(df, raw)
    text, names = F.col(TEXT), registry.names()
    none = lambda t: F.lit(None).cast(t)
    windows, xml = windows_candidate(text), xml_candidate(text)
    if "windows_event" in names and "xml" in names and names.index("windows_event") < names.index("xml"):
        xml = xml & ~windows
    rows = F.when(csv_candidate(text), text) if "csv" in names else none("string")
    df = df.withColumns({
        _XML: xml_map(F.when(xml, text)) if "xml" in names else none("map<string,string>"),
        _WINDOWS: windows_map(F.when(windows, text)) if "windows_event" in names else none("map<string,string>"),
        _CSV: rows,
    }).withColumns({_HEAD: settled(csv_row(F.col(_CSV), 1)), _NEXT: settled(csv_row(F.col(_CSV), 2))})
    view = LogView(text, *[F.col(c) for c in (JSON, _XML, _WINDOWS, _HEAD, _NEXT)])
    return df, view, [*added, _XML, _WINDOWS, _CSV, _HEAD, _NEXT]


def _choose(registry: FormatRegistry, view: LogView) -> Column:
    chosen = F.when(F.coalesce(view.text == "", F.lit(True)), F.lit(None).cast("string"))
    for spec in registry.active():
        chosen = chosen.when(F.coalesce(spec.match(view), F.lit(False)), F.lit(spec.name))
    return chosen.otherwise(F.lit(None).cast("string"))


def detect_parser(df: DataFrame, registry: FormatRegistry | None = None, raw: str = "raw_event") -> DataFrame:
    """Add `parser`: the first enabled format, by (priority, name), that recognises the log."""
    registry = registry or default_registry()
    out, view, extra = _with_view(df, registry, raw)
    return out.withColumn("parser", settled(_choose(registry, view))).drop(*extra)


def extract_pairs_map(raw: Column) -> Column:
    """`key=value` pairs found in any log, whatever its format."""
    return to_map(identifier_pairs(strip(raw)))


def parse_logs(df: DataFrame, registry: FormatRegistry | None = None, raw: str = "raw_event") -> DataFrame:
    """Add parser, parser_version, parse_status, parse_error, parsed, parsed_types, plugin_data, confidence.

    A log that no format takes has status 'unknown'; one that its format cannot read has
    'error'. Either way the row stays.
    """
    registry = registry or default_registry()
    out, view, extra = _with_view(df, registry, raw)
    out = out.withColumn("parser", settled(_choose(registry, view)))

    text_map = "map<string,string>"
    result = None
    version = None
    for spec in registry.active():
        test = F.col("parser") == spec.name
        branch = spec.parse(view)
        result = F.when(test, branch) if result is None else result.when(test, branch)
        if spec.version:
            version = F.when(test, spec.version) if version is None else version.when(test, spec.version)
    nothing = parsed(F.lit(None), F.lit(None))
    result = nothing if result is None else result.otherwise(nothing)
    out = out.withColumn(_PARSED, settled(result))

    got = F.col(_PARSED)
    known, failed = F.col("parser").isNotNull(), got["error"].isNotNull()
    source = F.create_map(F.lit("source_type"), F.lit("unknown"))
    fields = (
        F.when(known & failed, F.create_map(F.lit("source_type"), F.lit("unknown"), F.lit("error"), got["error"]))
        .when(known, got["fields"]).otherwise(source)
    )
    ok = known & ~failed
    own_version = F.when(ok, got["fields"]["parser_version"])
    own_confidence = F.map_contains_key(got["fields"], "confidence")
    return (
        out.withColumn("parsed", fields.cast(text_map))
        .withColumn("parsed_types", F.when(ok, got["types"]))
        .withColumn("plugin_data", F.when(ok, got["plugin_data"]))
        .withColumn("parse_status",
                    F.when(~known, "unknown").when(failed, "error").otherwise("success"))
        .withColumn("parse_error", got["error"])
        .withColumn("parser_version",
                    F.coalesce(F.when(ok, version), own_version) if version is not None else own_version)
        .withColumn("confidence_text",
                    F.when(ok, F.when(own_confidence, got["fields"]["confidence"]).otherwise(F.lit("1.0")))
                    .otherwise(F.lit("0.0")))
        .drop(*extra, _PARSED)
    )


def parse_as(df: DataFrame, name: str, registry: FormatRegistry | None = None, raw: str = "raw_event") -> DataFrame:
    """Only one format: what a trial of that format on each log gives."""
    spec = (registry or default_registry()).get(name)
    return parse_logs(df, FormatRegistry([spec]), raw)


def explode_cloudtrail(df: DataFrame, raw: str = "raw_event") -> DataFrame:
    """One row per record of a CloudTrail log, where the usual parse takes the first record only."""
    out = df.select("*", F.posexplode(cloudtrail_records(strip(F.col(raw)))).alias("record_pos", "_record"))
    record = F.col("_record")
    return (
        out.withColumn("parsed", cloudtrail_fields(record))
        .withColumn("plugin_data", cloudtrail_extras(record)).drop("_record")
    )


def split_batch(df: DataFrame, raw: str = "raw_event") -> tuple[DataFrame, DataFrame]:
    """Logs of a bulk request as (accepted, rejected); blank logs are rejected."""
    blank = is_blank(F.col(raw))
    return df.filter(~blank), df.filter(blank)
