"""The pair every converter returns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def converted(markdown: Column, error: Column) -> Column:
    """``struct(markdown, error)``; exactly one of the two is set."""
    return F.struct(
        F.when(error.isNull(), markdown).alias("markdown"),
        error.alias("error"),
    )


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row.

    Inside a lambda an expression is evaluated anew for every element; a bound
    value is a variable there, which keeps nested lambdas linear. It is the start
    of an aggregate over nothing, as elements of a transform are copied whole.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda start, _: start, use)
