"""Undefined values are NULL everywhere: NaN never leaves an operator."""

from pyspark.sql import Column, functions as F


def defined(c: Column) -> Column:
    """NULL instead of NaN."""
    return F.when(~F.isnan(c), c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def six(c: Column | str) -> Column:
    """Rounded for comparison."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
