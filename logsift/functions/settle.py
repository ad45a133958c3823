"""Columns that are worked out once."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def settled(value: Column) -> Column:
    """The same value, which Spark will not copy into the filters that use it.

    A filter on a computed column is moved below the projection by replacing the column with its
    expression, once per use; over several projections whose columns are each used several times the
    copies multiply until planning fails. An expression with a random part is never moved that way.
    The condition is always true. Columns nobody uses are still pruned.
    """
    return F.when(~F.isnan(F.rand(0)), value)
