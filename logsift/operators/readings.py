"""The readings of a log that several operators share: its stripped text and its JSON members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.functions.jsonmap import with_json
from logsift.functions.text import strip

TEXT, JSON = "_log_text", "_log_json"


def with_readings(df: DataFrame, raw: str) -> tuple[DataFrame, list[str]]:
    """(df with the readings, the columns that were added). A pipeline adds them once, up front;
    an operator used by itself adds them and drops them again."""
    if TEXT in df.columns:
        return df, []
    return with_json(df.withColumn(TEXT, strip(F.col(raw))), TEXT, JSON), [TEXT, JSON]
