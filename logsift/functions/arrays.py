"""Lists of the values whose test holds, as generated code.

`filter(array(...), not null)` would do, but Spark interprets everything below a lambda, and these
lists are built for every row.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def kept_strings(tests: list[tuple[Column, str]]) -> Column:
    return F.array_remove(F.array(*[F.when(test, F.lit(value)).otherwise("") for test, value in tests]), "")


def kept(tests: list[tuple[Column, Column]]) -> Column:
    return F.concat(*[F.array_repeat(value, F.coalesce(test, F.lit(False)).cast("int")) for test, value in tests])
