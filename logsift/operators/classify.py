"""Explainable guesses about the format of a log, and field-mapping suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.fixed import (
    CHECK_CONFIDENCE, CHECK_REASONS, CLASSIFIER, CLASSIFY_DISABLED, CLASSIFY_EMPTY, CLASSIFY_NONE,
    MAPPING_EXACT_CONFIDENCE, MAPPING_PARTIAL_CONFIDENCE, MAPPING_TARGETS, REASON_NO_SIGNATURE,
    REASON_PARSER_KNOWN, SUGGEST_THRESHOLD, SUPPORTED_FORMATS, WINDOWS_NAMESPACE,
)
from logsift.functions.arrays import kept
from logsift.functions.settle import settled
from logsift.functions.text import SPACE, WORD, matches, strip
from logsift.operators.formats import SYSLOG_START
from logsift.operators.parse import extract_pairs_map
from logsift.operators.readings import JSON, TEXT, with_readings


def _pieces(text: Column, mark: str) -> Column:
    """How many pieces cutting at `mark`, one byte, gives."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(mark), F.lit(""))) + 1


def _first_best(candidates: Column) -> Column:
    top = F.array_max(F.transform(candidates, lambda c: c["confidence"]))
    return F.get(F.filter(candidates, lambda c: c["confidence"] == top), 0)


def _check_candidates() -> Column:
    text = F.col(TEXT)
    tests = {
        "cef": F.startswith(text, F.lit("CEF:")),
        "json": F.col(JSON).isNotNull(),
        "syslog": text.rlike(SYSLOG_START),
        "vendor-key-value": text.rlike(rf"(?:^|[^{WORD}])[A-Za-z_][A-Za-z0-9_-]*+=[^{SPACE}]"),
        "pipe-delimited": F.contains(text, F.lit("|")),
        "xml": F.startswith(text, F.lit("<")) & F.endswith(text, F.lit(">")) & text.rlike("<[A-Za-z][^>]*>"),
        "csv-like": ~F.contains(text, F.lit("=")) & (_pieces(text, ",") >= 3),
    }
    return kept([
        (test, F.struct(F.lit(name).alias("format"), F.lit(CHECK_CONFIDENCE[name]).alias("confidence"),
                        F.lit(CHECK_REASONS[name]).alias("reason")))
        for name, test in tests.items()
    ])


def _check_struct(cands: Column, empty: Column, known: Column | None) -> Column:
    supported = F.filter(cands, lambda c: c["format"].isin(*SUPPORTED_FORMATS))
    good, best = _first_best(supported), _first_best(cands)
    is_good, is_any = F.size(supported) > 0, F.size(cands) > 0
    none = F.lit(None).cast("string")
    unknown = F.struct(
        F.when(empty, "invalid").when(is_good, "supported").otherwise("unknown").alias("status"),
        (~empty & is_good).alias("supported"),
        F.when(~empty & is_good, good["format"]).otherwise("unknown").alias("format"),
        F.when(empty, 0.0).when(is_good, good["confidence"]).when(is_any, best["confidence"])
        .otherwise(0.0).alias("confidence"),
        F.when(empty, "Log is empty").when(is_good, good["reason"]).when(is_any, best["reason"])
        .otherwise(REASON_NO_SIGNATURE).alias("reason"),
        F.when(~empty & ~is_good & is_any, best["format"]).otherwise(none).alias("suggested_format"),
        cands.alias("candidates"),
    )
    if known is None:
        return unknown
    short = F.struct(
        F.lit("supported").alias("status"), F.lit(True).alias("supported"), known.alias("format"),
        F.lit(1.0).alias("confidence"), F.lit(REASON_PARSER_KNOWN).alias("reason"),
        none.alias("suggested_format"),
        F.array(F.struct(known.alias("format"), F.lit(1.0).alias("confidence"),
                         F.lit(REASON_PARSER_KNOWN).alias("reason"))).alias("candidates"),
    )
    return F.when(known.isNotNull(), short).otherwise(unknown)


def detect_format(df: DataFrame, raw: str = "raw_event", out: str = "format_result") -> DataFrame:
    """Add the struct `format_result`: what the text itself says about its format."""
    prepared, added = with_readings(df, raw)
    empty = F.coalesce(F.col(TEXT) == "", F.lit(True))
    guessed = prepared.withColumn("_cands", settled(_check_candidates()))
    return guessed.withColumn(out, _check_struct(F.col("_cands"), empty, None)).drop(*added, "_cands")


def check_format(df: DataFrame, raw: str = "raw_event", out: str = "format_result") -> DataFrame:
    """As `detect_format`, but a log whose `parser` is a supported format needs no guess.

    Also adds `extracted_data`, the `key=value` pairs of the text.
    """
    prepared, added = with_readings(df, raw)
    empty = F.coalesce(F.col(TEXT) == "", F.lit(True))
    lower = F.lower(F.col("parser"))
    known = F.when(lower.isin(*SUPPORTED_FORMATS), lower)
    guessed = prepared.withColumn("_cands", settled(F.when(known.isNull(), _check_candidates())))
    return (
        guessed.withColumn(out, _check_struct(F.col("_cands"), empty, known))
        .withColumn("extracted_data", extract_pairs_map(F.col(TEXT))).drop(*added, "_cands")
    )


def classify_format(df: DataFrame, raw: str = "raw_event", out: str = "classification",
                    enabled: bool = True, only: Column | None = None) -> DataFrame:
    """Add the struct `classification`: format, confidence, reasons, matched_patterns, suggested_parser.

    `only` limits the work to the rows it is true for; the others get null.
    """
    none = F.lit(None).cast("string")

    def answer(name, confidence, reasons, patterns, suggested) -> Column:
        return F.struct(
            name.alias("format"), confidence.cast("double").alias("confidence"), reasons.alias("reasons"),
            patterns.alias("matched_patterns"), suggested.alias("suggested_parser"),
        )

    texts = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")
    fixed = lambda reasons: answer(F.lit("unknown"), F.lit(0.0), texts(reasons), texts([]), none)
    if not enabled:
        result = fixed(CLASSIFY_DISABLED)
        return df.withColumn(out, result if only is None else F.when(only, result))

    prepared, added = with_readings(df, raw)
    if only is not None:
        prepared = prepared.withColumn("_only", only)
    text, members = F.col(TEXT), F.col(JSON)

    def candidate(test: Column, key: str, name: str | None = None) -> tuple[Column, Column]:
        confidence, reason, pattern = CLASSIFIER[key]
        return test, F.struct(
            F.lit(name or key).alias("format"), F.lit(confidence).alias("confidence"),
            texts([reason]).alias("reasons"), texts([pattern]).alias("patterns"),
        )

    cef, syslog = F.startswith(text, F.lit("CEF:")), text.rlike(SYSLOG_START)
    tagged = F.startswith(text, F.lit("<")) & F.endswith(text, F.lit(">"))
    windows = F.contains(text, F.lit(f'<Event xmlns="{WINDOWS_NAMESPACE}">'))
    leef = F.startswith(text, F.lit("LEEF:"))
    records = F.coalesce(F.schema_of_variant(members["Records"]).startswith("ARRAY"), F.lit(False))
    full = _pieces(text, "|") >= 7
    keyed = F.regexp_count(text, F.lit(rf"(?<=^|[|{SPACE},])[A-Za-z_][A-Za-z0-9_-]*+[=:][^|{SPACE},]+"))
    structured = members.isNotNull() | cef | leef | (tagged & ~windows)
    count = F.col("_keyed")
    generic = (count >= 3) & ~structured, F.struct(
        F.lit("unknown").alias("format"),
        F.least(F.lit(0.8), F.lit(0.2) + count * F.lit(0.1)).alias("confidence"),
        F.array(F.concat(F.lit("Detected generic key-value structure with "), count.cast("string"),
                         F.lit(" fields"))).alias("reasons"),
        texts(["generic_kv"]).alias("patterns"),
    )
    cands = kept([
        candidate(members.isNotNull(), "json"),
        candidate(members.isNotNull() & records, "aws_cloudtrail"),
        candidate(cef & full, "cef"),
        candidate(cef & ~full, "cef_partial", "cef"),
        candidate(leef, "leef"),
        candidate(syslog, "syslog"),
        candidate(syslog & F.contains(text, F.lit("ASA-")), "cisco_asa"),
        candidate(tagged & windows, "windows_event"),
        candidate(tagged & ~windows, "xml"),
        candidate(~F.contains(text, F.lit("=")) & ~F.contains(text, F.lit("{")) & (_pieces(text, ",") > 3), "csv"),
        generic,
    ])
    if only is not None:
        keyed, cands = F.when(F.col("_only"), keyed), F.when(F.col("_only"), cands)
    ranked = prepared.withColumn("_keyed", settled(keyed)).withColumn("_cands", settled(cands)).withColumn(
        "_best", settled(_first_best(F.col("_cands"))))
    best, found = F.col("_best"), F.col("_cands")
    rivals = F.filter(found, lambda c: (c["confidence"] >= best["confidence"] - F.lit(0.1))
                      & (c["format"] != best["format"]))
    unsure = (F.size(rivals) > 0) & (best["confidence"] < 0.95)
    names = F.array_join(F.transform(rivals, lambda c: c["format"]), ", ")
    doubt = F.concat(F.lit("Ambiguous: Log resembles "), best["format"], F.lit(" and "), names)
    result = (
        F.when(F.coalesce(text == "", F.lit(True)), fixed(CLASSIFY_EMPTY))
        .when(F.size(found) == 0, fixed(CLASSIFY_NONE))
        .when(unsure, answer(F.lit("unknown"), best["confidence"] - F.lit(0.2),
                             F.concat(F.array(doubt), best["reasons"]), best["patterns"], none))
        .otherwise(answer(best["format"], best["confidence"], best["reasons"], best["patterns"],
                          F.when(best["confidence"] >= SUGGEST_THRESHOLD, best["format"])))
    )
    if only is not None:
        result = F.when(F.col("_only"), result)
    return ranked.withColumn(out, result).drop(*added, "_keyed", "_cands", "_best", "_only")


def unknown_report(df: DataFrame, raw: str = "raw_event", enabled: bool = True) -> DataFrame:
    """Classify the logs that no format took; the guess then sets their confidence."""
    guessed = classify_format(df, raw, enabled=enabled, only=F.col("parser").isNull())
    text = F.when(F.col("parser").isNull(), F.col("classification.confidence").cast("string"))
    return guessed.withColumn("confidence_text", F.coalesce(text, F.col("confidence_text")))


def mapping_keys(text: Column, hint: Column | None = None, members: Column | None = None) -> Column:
    """Lower-case keys of `key=value` and `key:value` pairs in log order, each once."""
    found = matches(strip(text), rf"(?<=^|[|{SPACE},])[A-Za-z_][A-Za-z0-9_-]*+[=:][^|{SPACE},]+")
    keys = F.transform(found, lambda p: F.lower(F.regexp_extract(p, "^[A-Za-z0-9_-]+", 0)))
    if members is not None:
        extra = F.transform(F.map_keys(members), F.lower)
        nothing = F.array().cast("array<string>")
        keys = F.concat(keys, F.when(F.coalesce(hint == "json", F.lit(False)),
                                     F.coalesce(extra, nothing)).otherwise(nothing))
    return F.array_distinct(keys)


def suggest_mappings(df: DataFrame, raw: str = "raw_event", hint: str | None = None) -> DataFrame:
    """Add `suggestions`: for each target the first key that equals or contains one of its words.

    All of it happens inside the row: keys are an array, words are constants.
    """
    prepared, added = with_readings(df, raw) if hint else (df, [])
    keys = mapping_keys(F.col(raw), F.col(hint), F.col(JSON)) if hint else mapping_keys(F.col(raw))
    keyed = prepared.withColumn("_keys", settled(keys))

    # Containing covers equality, so the first key with any word is the one to report.
    for target, words in MAPPING_TARGETS.items():
        hit = F.get(F.filter(F.col("_keys"), lambda k: k.rlike("|".join(words))), 0)  # noqa: B023
        keyed = keyed.withColumn(f"_first_{target}", hit)

    def suggestion(target: str, words: list[str]) -> tuple[Column, Column]:
        first = F.col(f"_first_{target}")
        exact = first.isin(*words)
        return first.isNotNull(), F.struct(
            first.alias("source_field"), F.lit(target).alias("target_field"),
            F.when(exact, MAPPING_EXACT_CONFIDENCE).otherwise(MAPPING_PARTIAL_CONFIDENCE).alias("confidence"),
            F.when(exact, F.concat(F.lit("Field '"), first, F.lit(f"' strongly matches Universal Schema field '{target}'")))
            .otherwise(F.concat(F.lit("Field '"), first, F.lit(f"' partially matches '{target}'"))).alias("reason"),
        )

    found = kept([suggestion(t, w) for t, w in MAPPING_TARGETS.items()])
    return keyed.withColumn("suggestions", found).drop("_keys", *[f"_first_{t}" for t in MAPPING_TARGETS], *added)


def mapping_records(df: DataFrame, key: str, raw: str = "raw_event", hint: str | None = None) -> DataFrame:
    """One reviewable record per log: its predicted format and suggestions, status 'suggestion'."""
    out = classify_format(suggest_mappings(df, raw, hint), raw)
    return out.select(
        F.col(key).alias("approval_id"), F.col(raw).alias("log"),
        F.col("classification.format").alias("format_prediction"), "suggestions",
        F.lit("suggestion").alias("status"),
        *[c for c in ("created_at",) if c in df.columns],
    )


def list_records(records: DataFrame) -> DataFrame:
    """Newest first."""
    return records.orderBy(F.desc("created_at"), "approval_id")


def get_record(records: DataFrame, approval_id: str) -> DataFrame:
    return records.filter(F.col("approval_id") == approval_id)


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Give each record its latest decision.

    `decisions` has approval_id, decision ('approved' or 'rejected'), username, decided_at. It is
    reduced to one row per record before the join, with partial aggregation, so a record that was
    decided very often costs no more than another. A later decision leaves the other's name in place.
    """
    def latest(kind: str) -> Column:
        row = F.when(F.col("decision") == kind, F.struct("decided_at", "username"))
        return F.max(row).alias(kind)

    last = decisions.groupBy("approval_id").agg(
        F.max(F.struct("decided_at", "decision")).alias("last"), latest("approved"), latest("rejected"),
    )
    joined = records.join(last, "approval_id", "left")
    return joined.withColumn("status", F.coalesce(F.col("last.decision"), F.col("status"))).select(
        *records.columns,
        F.col("approved.username").alias("approved_by"), F.col("approved.decided_at").alias("approved_at"),
        F.col("rejected.username").alias("rejected_by"), F.col("rejected.decided_at").alias("rejected_at"),
    )
