"""Strict JSON objects as maps, entirely on the JVM side."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.settle import settled

_END = "\x01end"


def with_json(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add `out`: the members of a JSON object as MAP<STRING, VARIANT>; null for any other text.

    Spark's reader stops after the first value, so the text is put into an array that is closed
    by a marker object: anything left over after the first value breaks the array. The array is a
    column of its own because it is read more than once.
    """
    value = F.col(text)
    shaped = F.startswith(value, F.lit("{")) & F.endswith(value, F.lit("}"))
    wrapped = F.concat(F.lit("["), value, F.lit(',{"\\u0001end":0}]'))
    pair = f"{out}_pair"
    parsed = F.when(shaped, F.from_json(wrapped, "array<map<string,variant>>", {"allowSingleQuotes": "false"}))
    first, last = F.get(F.col(pair), 0), F.get(F.col(pair), 1)
    whole = (F.size(F.col(pair)) == 2) & F.map_contains_key(last, _END)
    # Rebuilding from entries keeps the last of repeated members.
    members = F.when(whole, F.map_from_entries(F.map_entries(first)))
    return df.withColumn(pair, settled(parsed)).withColumn(out, members).drop(pair)


def json_types(members: Column) -> Column:
    """Name of the JSON type of each member: string, number, boolean, null, object or array."""
    def kind(_key: Column, value: Column) -> Column:
        t = F.coalesce(F.schema_of_variant(value), F.lit("VOID"))
        return (
            F.when(t == "STRING", "string").when(t == "VOID", "null").when(t == "BOOLEAN", "boolean")
            .when(F.startswith(t, F.lit("OBJECT")), "object").when(F.startswith(t, F.lit("ARRAY")), "array")
            .otherwise("number")
        )

    return F.transform_values(members, kind)


def json_texts(members: Column) -> Column:
    """Members as text: strings unquoted, nested values as JSON, 1.0 kept apart from 1."""
    def text(_key: Column, value: Column) -> Column:
        plain = value.cast("string")
        whole_float = F.schema_of_variant(value).rlike(r"^DECIMAL\(1?\d,0\)$")
        return F.when(whole_float, F.concat(plain, F.lit(".0"))).otherwise(plain)

    return F.transform_values(members, text)
