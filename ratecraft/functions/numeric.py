"""Numeric column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def half_even(c: Column, digits: int) -> Column:
    """NumPy-style rounding: ``rint(x * 10^d) / 10^d`` (ties to even).

    This is what ``numpy.round`` computes; ``bround`` works on the decimal
    text of the double and differs on values such as 2.675.
    """
    scale = float(10 ** digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column, otherwise: Column | float) -> Column:
    """``num / den`` when ``den > 0`` else ``otherwise`` (null den -> otherwise)."""
    other = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return F.when(den > 0, num / den).otherwise(other)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column to ``digits`` (keeps names and order)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (DoubleType, FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
