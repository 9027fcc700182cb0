"""Double arithmetic that follows IEEE-754 where Spark SQL would raise or return NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ieee_div(numerator: Column, denominator: Column) -> Column:
    """``n / d`` with x/0 -> signed infinity and 0/0 -> NaN.

    ANSI division raises on zero and ``try_divide`` gives NULL, which would lose
    results such as 1/(1/0) = 0.  ``pow(d, -1)`` keeps the sign of a zero.
    """
    at_zero = numerator * F.pow(denominator, F.lit(-1.0))
    return F.when(denominator == 0.0, at_zero).otherwise(F.try_divide(numerator, denominator))


def ieee_div_sql(numerator: str, denominator: str) -> str:
    """The same division as SQL text; both operands are evaluated more than once."""
    return (
        f"(CASE WHEN {denominator} = 0D THEN {numerator} * power({denominator}, -1D) "
        f"ELSE try_divide({numerator}, {denominator}) END)"
    )


def is_finite(value: Column) -> Column:
    """True for ordinary numbers; false for NaN, both infinities and NULL."""
    return F.coalesce(F.abs(value) < F.lit(float("inf")), F.lit(False))


def finite_or_null(value: Column) -> Column:
    """The value when finite, else NULL, so that every Spark aggregate skips it."""
    return F.when(is_finite(value), value)


def paired_delta(plus: Column, minus: Column) -> Column:
    """``plus - minus`` for rows where both branches are finite, else NULL."""
    return F.when(is_finite(plus) & is_finite(minus), plus - minus)
