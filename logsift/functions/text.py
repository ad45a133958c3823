"""Text expressions with the whitespace and word rules the log formats are defined by."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that count as blank, and the same set as a regex class body.
BLANKS = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]))
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"


def strip(text: Column) -> Column:
    """Remove blank characters (Unicode ones too) from both ends. Linear, unlike an anchored regex."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    """True for null and for text of blanks only."""
    return F.coalesce(strip(text) == "", F.lit(True))


def with_value(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once for a row, however often `then` uses it.

    Below a lambda Spark shares no part of an expression, so a text that is cut for several of its parts would be cut as often.
    """
    return F.get(F.transform(F.array(value), then), 0)


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pairs(found: Column, quotes: str) -> Column:
    """`key=value` strings as an array of (key, value), surrounding quotes removed."""
    def split_once(item: Column) -> Column:
        key = F.substring_index(item, "=", 1)
        value = F.substr(item, F.length(key) + 2)
        return F.struct(key.alias("key"), F.btrim(value, F.lit(quotes)).alias("value"))

    return F.transform(found, split_once)


def word_pairs(text: Column) -> Column:
    """Pairs whose key is a run of word characters; a value may be quoted.

    The look-behind and the possessive key keep the match linear on long words without '='.
    """
    return pairs(matches(text, rf'(?<![{WORD}])[{WORD}]++=(?:"[^"]*"|[^{SPACE}]+)'), '"')


def identifier_pairs(text: Column) -> Column:
    """Pairs after a blank, a pipe or the start of the text, with an identifier as key."""
    found = matches(text, rf"(?<=^|[|{SPACE}])[A-Za-z_][A-Za-z0-9_-]*+=[^|{SPACE}]+")
    return pairs(found, "\"'")


def tokens(text: Column) -> Column:
    """Lower-case search terms; a dot or apostrophe inside a word or number does not split it."""
    return matches(F.lower(text), rf"[{WORD}]+(?:[.'][{WORD}]+)*+")


def entries(**fields: Column) -> Column:
    """Named columns as map entries, leaving out the null ones."""
    items = [F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in fields.items()]
    return F.filter(F.array(*items), lambda e: e["value"].isNotNull())


def to_map(*entry_arrays: Column) -> Column:
    """Entries in order as a map; a later entry replaces an earlier one with the same key."""
    return F.map_from_entries(F.concat(*entry_arrays) if len(entry_arrays) > 1 else entry_arrays[0])
