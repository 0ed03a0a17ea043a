"""Missing-value and arithmetic expressions.

Missing means NULL everywhere after ingest: NaN and the infinities are turned
into NULL by :func:`finite`, because Spark's aggregates treat NaN as a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INFINITY = float("inf")
HASH_SPAN = float(1 << 52)
_FRACTIONAL = (T.DoubleType, T.FloatType)
_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType) + _FRACTIONAL


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NUMERIC)


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, _FRACTIONAL)


def is_infinite(column: Column) -> Column:
    return F.abs(column) == F.lit(INFINITY)


def is_missing(column: Column, dtype: T.DataType) -> Column:
    """NULL, or NaN where the type can hold one."""
    if is_fractional(dtype):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def finite(column: Column) -> Column:
    """The value as double, or NULL if it is NaN, infinite or missing."""
    value = column.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(INFINITY)), value)


def coerce_number(column: Column) -> Column:
    """Numeric value of text or numbers; what cannot be read as a number becomes NULL."""
    return column.try_cast("double")


def ieee_divide(numerator: Column, denominator: Column) -> Column:
    """Division with floating-point rules: x/0 is ±Inf and 0/0 is NaN, never an error."""
    top, bottom = numerator.cast("double"), denominator.cast("double")
    by_zero = (
        F.when(top > 0, F.lit(INFINITY))
        .when(top < 0, F.lit(-INFINITY))
        .when(top.isNotNull(), F.lit(float("nan")))
    )
    return F.when(bottom == 0, by_zero).otherwise(F.try_divide(top, bottom))


def ratio(numerator: Column, denominator: Column, undefined: float | None = None) -> Column:
    """``numerator / denominator``; ``undefined`` (default NULL) where the denominator is zero."""
    value = F.try_divide(numerator.cast("double"), denominator.cast("double"))
    return value if undefined is None else F.coalesce(value, F.lit(undefined))


def percent_shift(value: Column, reference: Column) -> Column:
    """``(value - reference) / |reference| * 100``; NULL where the reference is zero or missing."""
    return F.try_divide(value - reference, F.abs(reference)) * F.lit(100.0)


def order_hash(columns, seed: int = 0) -> Column:
    """A 52-bit hash of ``columns``: an order that is random-looking, repeatable and
    exactly representable as a double."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit(int(HASH_SPAN) - 1))
