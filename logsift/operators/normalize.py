"""From a parsed record to an event: field mapping, coercion, event id and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.fixed import FALL_THROUGH_FIELDS, FIELD_ALIASES, RESERVED_KEYS
from logsift.functions.address import is_ip
from logsift.functions.settle import settled
from logsift.functions.text import is_blank, strip

KNOWN_KEYS = sorted({*RESERVED_KEYS, *(k for keys in FIELD_ALIASES.values() for k in keys)})
STRING_FIELDS = [
    "timestamp", "source", "vendor", "product", "category", "source_type", "destination", "protocol",
    "action", "hostname", "application", "source_ip", "destination_ip",
]


def assign_event_id(df: DataFrame, *parts: str, prefix: str = "EVT-") -> DataFrame:
    """Add `event_id`, a digest of the named columns, so that a retried job gives the same ids."""
    text = F.concat_ws("|", *[F.col(p).cast("string") for p in parts])
    return df.withColumn("event_id", F.concat(F.lit(prefix), F.upper(F.substring(F.sha2(text, 256), 1, 32))))


def _first_present(fields: Column, keys: list[str]) -> Column:
    """The first of `keys` that the record has, whatever its value."""
    chosen = F.when(F.map_contains_key(fields, keys[0]), F.lit(keys[0]))
    for key in keys[1:]:
        chosen = chosen.when(F.map_contains_key(fields, key), F.lit(key))
    return chosen


def _truthy(value: Column, kind: Column) -> Column:
    """Not null, not empty, and for typed JSON values not zero, false or an empty container."""
    zero = ~kind.isin("string") & value.isin("0", "0.0", "-0.0", "false", "[]", "{}")
    return value.isNotNull() & (value != "") & ~F.coalesce(zero, F.lit(False))


def coerce_port(value: Column, kind: Column) -> tuple[Column, Column]:
    """(port, out_of_range). Text must be a whole number; JSON numbers are truncated."""
    trimmed = strip(value)
    whole = trimmed.rlike(r"^[+-]?[0-9]+$")
    number = (
        F.when(kind == "boolean", F.when(value == "true", 1).otherwise(0).cast("bigint"))
        .when((kind == "number") & ~whole, value.try_cast("double").try_cast("bigint"))
        .when(whole, trimmed.try_cast("bigint"))
    )
    bad = (number.isNull() & whole) | ~number.between(0, 65535)
    bad = F.coalesce(bad, F.lit(False))
    return F.when(~bad, number).cast("int"), bad


def extract_user(value: Column, kind: Column) -> Column:
    """Text as it is; from an object its user name, else principal id, else ARN; else null."""
    part = lambda name: F.get_json_object(value, f"$.{name}")
    inner = F.coalesce(F.nullif(part("userName"), F.lit("")), F.nullif(part("principalId"), F.lit("")), part("arn"))
    plain = F.coalesce(kind, F.lit("string")) == "string"
    return F.when(plain, value).when(kind == "object", inner)


def normalize(df: DataFrame, extracted: str = "extracted_data") -> DataFrame:
    """Turn parsed logs into events with the fixed fields, `extensions` and `metadata`.

    Needs the columns of `parse_logs` plus `event_id`, `raw_event` and `extracted`. The keys a
    field is read from are settled in one projection, the values with their types in a second one and the
    event in a third one, so that a map is searched once for each field.
    """
    parsed, types = F.col("parsed"), F.col("parsed_types")
    keys = df.withColumn("_k", settled(F.struct(*[
        _first_present(parsed, names).alias(field) for field, names in FIELD_ALIASES.items()
    ])))

    def pick(field: str) -> tuple[Column, Column]:
        key = F.col(f"_k.{field}")
        return parsed[key], types[key]

    values: dict[str, Column] = {}
    kinds: dict[str, Column] = {}
    for field in FIELD_ALIASES:
        values[field], kinds[field] = pick(field)
    for field, names in FALL_THROUGH_FIELDS.items():
        value, kind = parsed[names[-1]], types[names[-1]]
        for name in reversed(names[:-1]):
            good = _truthy(parsed[name], types[name])
            value, kind = F.when(good, parsed[name]).otherwise(value), F.when(good, types[name]).otherwise(kind)
        values[field], kinds[field] = value, kind
    values["destination"], kinds["destination"] = parsed["destination"], types["destination"]
    typed = F.map_contains_key(parsed, "source_type")
    values["source_type"] = F.when(typed, parsed["source_type"]).otherwise(F.lit("unknown"))
    kinds["source_type"] = types["source_type"]
    read = keys.withColumn("_v", settled(F.struct(*[c.alias(f) for f, c in values.items()]))).withColumn(
        "_t", settled(F.when(types.isNotNull(), F.struct(*[c.alias(f) for f, c in kinds.items()]))))
    values = {f: F.col(f"_v.{f}") for f in values}
    kinds = {f: F.col(f"_t.{f}") for f in kinds}

    source_port, bad_sport = coerce_port(values["source_port"], kinds["source_port"])
    destination_port, bad_dport = coerce_port(values["destination_port"], kinds["destination_port"])
    as_text = lambda f: F.when(_truthy(values[f], kinds[f]), F.when(
        kinds[f] == "boolean", F.initcap(values[f])).otherwise(values[f]))
    wrong = F.coalesce(*[
        F.when(~F.coalesce(kinds[f], F.lit("string")).isin("string", "null"), F.lit(f"{f}: not a string"))
        for f in STRING_FIELDS
    ], F.when(bad_sport, F.lit("source_port: out of range")),
        F.when(bad_dport, F.lit("destination_port: out of range")))
    leftovers = F.map_filter(parsed, lambda k, _v: ~k.isin(*KNOWN_KEYS))
    address = lambda f: F.nullif(values[f], F.lit("-"))

    return read.select(
        *[c for c in df.columns if c not in _REPLACED],
        values["timestamp"].alias("timestamp"),
        as_text("event_type").alias("event_type"),
        values["source"].alias("source"),
        values["source_type"].alias("source_type"),
        address("source_ip").alias("source_ip"),
        source_port.alias("source_port"),
        values["destination"].alias("destination"),
        address("destination_ip").alias("destination_ip"),
        destination_port.alias("destination_port"),
        values["protocol"].alias("protocol"),
        values["action"].alias("action"),
        as_text("severity").alias("severity"),
        extract_user(values["user"], kinds["user"]).alias("user"),
        F.lit(None).cast("string").alias("device"),
        values["hostname"].alias("hostname"),
        values["application"].alias("application"),
        values["vendor"].alias("vendor"),
        values["product"].alias("product"),
        values["category"].alias("category"),
        F.map_concat(F.col(extracted), leftovers).alias("extensions"),
        F.create_map(F.lit("source_type"), values["source_type"]).alias("metadata"),
        wrong.alias("_wrong"),
    )


_REPLACED = {
    "timestamp", "event_type", "source", "source_type", "source_ip", "source_port", "destination",
    "destination_ip", "destination_port", "protocol", "action", "severity", "user", "device", "hostname",
    "application", "vendor", "product", "category", "extensions", "metadata", "_wrong",
}


def check_events(df: DataFrame) -> DataFrame:
    """Add `reject_reason` (null when valid) and settle blank addresses and the confidence.

    Works on the output of `normalize`, or on any table with source_ip and destination_ip.
    """
    reasons = [F.col("_wrong")] if "_wrong" in df.columns else []
    for field in ("source_ip", "destination_ip"):
        value = F.col(field)
        given = ~is_blank(value) & (value != "-")
        reasons.append(F.when(given & ~is_ip(value), F.concat(F.lit(f"{field}: Invalid IP address: "), value)))
    out = df
    for field in ("source_port", "destination_port"):
        if field in df.columns:
            reasons.append(F.when(~F.col(field).between(0, 65535), F.lit(f"{field}: out of range")))
    if "confidence_text" in df.columns:
        number = F.col("confidence_text").try_cast("double")
        wrong = F.col("confidence_text").isNotNull() & (number.isNull() | F.isnan(number) | ~number.between(0, 100))
        reasons.append(F.when(wrong, F.lit("confidence: not a number from 0 to 100")))
        out = out.withColumn("confidence", number)
    out = out.withColumn("reject_reason", settled(F.coalesce(*reasons)))
    for field in ("source_ip", "destination_ip"):
        out = out.withColumn(field, F.when(~is_blank(F.col(field)) & (F.col(field) != "-"), F.col(field)))
    return out.drop("_wrong", "confidence_text")


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) events; the rejected keep their `reject_reason`."""
    checked = check_events(df)
    return checked.filter("reject_reason IS NULL").drop("reject_reason"), checked.filter("reject_reason IS NOT NULL")


# Fixed value: the times of traditional syslog, which have no year.
BSD_TIME = r"^([A-Z][a-z]{2}) +(\d{1,2} \d{2}:\d{2}:\d{2})$"


def event_time(text: Column, stored: Column | None = None) -> Column:
    """The free-text time as a timestamp where it is an ISO time, or a BSD time and `stored`, the time
    of storage, is known; else null. A BSD time is of the year of storage, or of the year before if it
    would lie more than a day after it."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    if stored is None:
        return iso
    day = F.regexp_replace(text, BSD_TIME, "$1 $2")
    at = lambda year: F.try_to_timestamp(F.concat_ws(" ", year.cast("string"), day), F.lit("yyyy MMM d HH:mm:ss"))
    year = F.year(stored)
    late = F.coalesce(at(year) > stored + F.expr("INTERVAL 1 DAY"), F.lit(True))
    return F.coalesce(iso, F.when(text.rlike(BSD_TIME) & stored.isNotNull(), F.when(late, at(year - 1)).otherwise(at(year))))
