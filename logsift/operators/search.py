"""Search, paging and lookups over events and analytics."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.text import strip, tokens
from logsift.operators.display import format_label


class Page(NamedTuple):
    """`items` is one page; `total` has one row with the number of all hits."""

    items: DataFrame
    total: DataFrame


EXACT_FILTERS = [
    "event_id", "vendor", "product", "parser", "event_type", "source_ip", "destination_ip", "severity", "action",
]


def match_text(q: str) -> Column:
    """Any word of `q` in the raw text, or `q` equal to the type, user or host."""
    words, raw = tokens(F.lit(q)), F.col("raw_event")
    # A word of the text is also a part of it: texts without any are told apart before they are cut up.
    maybe = F.exists(words, lambda w: F.contains(F.lower(raw), w))
    in_raw = F.when(maybe, F.arrays_overlap(tokens(raw), words))
    same = F.col("event_type").eqNullSafe(q) | F.col("user").eqNullSafe(q) | F.col("hostname").eqNullSafe(q)
    return F.coalesce(in_raw, F.lit(False)) | same


def _page(hits: DataFrame, order: list[Column], page: int, page_size: int) -> Page:
    if page < 1 or page_size < 1:
        raise ValueError("page and page_size start at 1")
    # A sorted limit is a top-k per task, so no full sort happens for the first pages.
    items = hits.orderBy(*order).offset((page - 1) * page_size).limit(page_size)
    return Page(items, hits.agg(F.count("*").alias("total")))


def find_events(events: DataFrame, q: str | None = None, **filters: str) -> DataFrame:
    """All events that meet every given filter."""
    unknown = set(filters) - set(EXACT_FILTERS)
    if unknown:
        raise TypeError(f"no such filter: {sorted(unknown)}")
    hits = events
    for field, value in filters.items():
        if value:
            hits = hits.filter(F.col(field) == value)
    return hits.filter(match_text(q)) if q else hits


def search_events(events: DataFrame, q: str | None = None, page: int = 1, page_size: int = 20,
                  **filters: str) -> Page:
    """Newest first; events without a time come last."""
    return _page(find_events(events, q, **filters), [F.desc("event_ts"), F.col("event_id")], page, page_size)


def find_alerts(analytics: DataFrame, severity: str | None = None, risk_min: int | None = None,
                risk_max: int | None = None, anomaly: bool | None = None,
                detected: bool | None = None) -> DataFrame:
    hits = analytics
    for field, value in (("severity", severity or None), ("anomaly", anomaly), ("detected", detected)):
        if value is not None:
            hits = hits.filter(F.col(field) == value)
    if risk_min is not None:
        hits = hits.filter(F.col("risk_score") >= risk_min)
    if risk_max is not None:
        hits = hits.filter(F.col("risk_score") <= risk_max)
    return hits


def search_alerts(analytics: DataFrame, page: int = 1, page_size: int = 20, **filters) -> Page:
    return _page(find_alerts(analytics, **filters), [F.desc("timestamp"), F.col("event_id")], page, page_size)


def get_event(events: DataFrame, event_id: str) -> DataFrame:
    return events.filter(F.col("event_id") == event_id)


get_analytics = get_event


def list_events(events: DataFrame) -> DataFrame:
    """All events, newest stored first."""
    return events.orderBy(F.desc("created_at"), "event_id")


#: The columns `filter_events` reads: those an event is shown by.
SHOWN = [
    "event_id", "source", "source_ip", "destination", "destination_ip", "action", "severity", "parser",
    "format", "raw_event",
]


def filter_events(events: DataFrame, text: str = "", fmt: str = "ALL") -> DataFrame:
    """Events of a format whose displayed fields contain `text`, ignoring case."""
    hits = events if fmt == "ALL" else events.filter(format_label() == fmt)
    if not text.strip():
        return hits
    value = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("—"))
    line = F.lower(F.concat_ws(" ", *[value(c) for c in SHOWN]))
    return hits.filter(F.contains(line, F.lower(strip(F.lit(text)))))
