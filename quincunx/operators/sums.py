"""Sums and moments with the same bits for every partitioning.

A double becomes an integer of 60 bits below the largest size in its column, by a floor that
drops the rest row by row, and three sums take 20 bits of it each.  Integers add up alike in
any order, in partial sums or not, so a sum is a function of the rows alone; 10^12 rows fit.
Only the last step, from three integers to a double, rounds, and always in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.operators.moments import STATE, finite_sql, fold_correlations

WIDTH = 20  # bits of a slice
SLICES = 3


def top_of(size: float) -> int:
    """The exponent of the smallest power of two above ``size``."""
    return math.frexp(size)[1] if size > 0 else 0


def _step(top: int) -> int:
    """The exponent of an integer's last bit; no smaller one has a double of its own."""
    return max(-1074, top - WIDTH * SLICES)


def integer_sql(value: str, top: int) -> str:
    """SQL of the integer for ``value``, smaller than 2^top in size; dividing by a power of two is exact."""
    return f"floor(({value}) / {2.0 ** _step(top)!r}D)"


def sum_sql(integer: str) -> str:
    """SQL of an aggregate: the array of the slices' sums, the upper one first."""
    mask = (1 << WIDTH) - 1
    return f"array(sum(shiftright({integer}, {2 * WIDTH})), sum(shiftright({integer}, {WIDTH}) & {mask}L), sum({integer} & {mask}L))"


def joined_sql(sums: str, top: int) -> str:
    """SQL of the double that an array of sums of slices stands for."""
    return "(" + " + ".join(f"coalesce({sums}[{k}], 0L) * {2.0 ** (_step(top) + (SLICES - 1 - k) * WIDTH)!r}D" for k in range(SLICES)) + ")"


def exact_sum(sums: list[int | None], top: int) -> Fraction:
    return sum((Fraction(s or 0) * Fraction(2) ** (_step(top) + (SLICES - 1 - k) * WIDTH) for k, s in enumerate(sums)), Fraction(0))


def _sums(df: DataFrame, terms: Mapping[str, tuple[str, int]]) -> dict[str, Fraction]:
    """Sum of each term, in one aggregation; ``terms`` are SQL and the top of their sizes."""
    integers = df.selectExpr(*[f"{integer_sql(sql, top)} AS {name}" for name, (sql, top) in terms.items()])
    row = integers.agg(*[F.expr(sum_sql(name)).alias(name) for name in terms]).first()
    return {name: exact_sum(row[name], top) for name, (_, top) in terms.items()}


def reproducible_moments(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """(id, moment state) per measure, as ``column_moments``, to the last bit the same however
    ``df`` is partitioned.

    Three passes over ``df``, which had better be a stored table: counts and extremes, then
    the mean, rounded once, then the squares of the differences from it.
    """
    finite = df.selectExpr(*[f"{finite_sql(sql)} AS {m}" for m, sql in measures.items()])
    row = finite.selectExpr("count(*) AS c", *[f"struct(count({m}) AS n, min({m}) AS low, max({m}) AS high) AS {m}" for m in measures]).first()
    own = {m: row[m] for m in measures}
    there = [m for m in measures if own[m]["n"]]
    sizes = {m: top_of(max(abs(own[m]["low"]), abs(own[m]["high"]))) for m in there}
    means = {m: float(s / own[m]["n"]) for m, s in _sums(finite, {m: (m, sizes[m]) for m in there}).items()} if there else {}
    squares = {}
    for m in there:
        far = max(own[m]["high"] - means[m], means[m] - own[m]["low"])
        if math.isfinite(far * far):
            squares[m] = (f"({m} - {means[m]!r}D) * ({m} - {means[m]!r}D)", top_of(far * far))
    m2 = {m: float(s) for m, s in _sums(finite, squares).items()} if squares else {}
    rows = [
        (m, row["c"], own[m]["n"], means.get(m, 0.0), m2.get(m, math.inf if m in means else 0.0), own[m]["low"], own[m]["high"]) for m in measures
    ]
    schema = "id string, candidates long, n long, mean double, m2 double, low double, high double"
    return df.sparkSession.createDataFrame(rows, schema).select("id", *STATE)


def reproducible_correlation(df: DataFrame, block: str, plus: str, minus: str, states: Mapping[str, Mapping]) -> DataFrame:
    """(correlation_plus_minus_mean, blocks), as ``block_correlation``, the same for every partitioning.

    ``states`` are the moment states of the columns ``plus`` and ``minus``; values enter as
    differences from these means.
    """
    sides = {}
    for name, column in (("x", plus), ("y", minus)):
        s = states[column]
        mean = s["mean"] or 0.0
        far = max((s["high"] or 0.0) - mean, mean - (s["low"] or 0.0), 0.0)
        sides[name] = (f"({column} - {mean!r}D)", top_of(far), far)
    terms = {n: (sql, top) for n, (sql, top, _) in sides.items()}
    for a, b in (("x", "x"), ("y", "y"), ("x", "y")):
        terms[a + b] = (f"{a} * {b}", top_of(sides[a][2] * sides[b][2]))
    both = f"abs({plus}) < double('infinity') AND abs({minus}) < double('infinity')"
    rows = df.where(both).selectExpr(f"{block} AS block", f"{terms['x'][0]} AS x", f"{terms['y'][0]} AS y")
    rows = rows.selectExpr("block", *[f"{integer_sql(n if len(n) == 1 else f'{n[0]} * {n[1]}', top)} AS {n}" for n, (_, top) in terms.items()])
    sums = rows.groupBy("block").agg(F.count("*").alias("n"), *[F.expr(sum_sql(n)).alias(n) for n in terms])
    sums = sums.selectExpr("block", "n", *[f"{joined_sql(n, top)} AS {n}" for n, (_, top) in terms.items()])
    spread = "sqrt(greatest(0D, xx - x * x / n)) * sqrt(greatest(0D, yy - y * y / n))"
    r = sums.selectExpr("block", f"if(n > 1, (xy - x * y / n) / nullif({spread}, 0D), NULL) AS r")
    return fold_correlations(r)
