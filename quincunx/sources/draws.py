"""Random draws attached to table rows: functions of seed, row key and variable alone."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quincunx.plans.program import Discrete, Distribution, Normal, Uniform

BITS = 52  # of a uniform, as 13 hexadecimal digits of a digest


def digest(key: str, seed: int | Column, stream: int | Column) -> Column:
    """128 bits of (seed, stream, key); a Column of seeds or streams has one for each row."""
    if isinstance(seed, int) and seed < 0:
        raise ValueError("seed must not be negative")
    text = lambda part: F.lit(str(part)) if isinstance(part, int) else part.cast("string")
    return F.md5(F.concat_ws(":", text(seed), text(stream), F.col(key).cast("string")))


def uniform_of(digest: Column, part: int = 0) -> Column:
    """One of the two uniforms in (0, 1) of a digest: the centre of one of 2^52 cells."""
    digits = F.substring(digest, 1 + BITS // 4 * part, BITS // 4)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) * 2.0**-BITS


def with_uniforms(df: DataFrame, key: str, seed: int, names: Mapping[str, int]) -> DataFrame:
    """Adds one uniform in (0, 1) per name, a function of the whole seed, the stream number and
    the whole key alone.

    ``key`` must identify a row: equal keys, and NULL ones, get equal draws.
    """
    return df.withColumns({n: uniform_of(digest(key, seed, stream)) for n, stream in names.items()})


def _number(parameter: float | str | Column) -> float | Column:
    return F.expr(parameter) if isinstance(parameter, str) else parameter


def with_draws(
    df: DataFrame, key: str | None, variables: Mapping[str, Distribution], seed: int
) -> DataFrame:
    """Adds one drawn column per variable to a table, inside generated JVM code.

    The variable in place k draws from stream k.  Normals use the Box-Muller transform of two
    uniforms; discrete values compare one uniform with the cumulative probabilities.
    Distribution parameters may be Columns or SQL.

    Without a ``key`` Spark's own generators draw, one stream for each partition and variable:
    several times faster, and the same in every pass over a range or a stored table, but
    another partitioning gives other numbers.
    """

    def drawn(k: int, distribution: Distribution) -> Column:
        if key is not None:
            bits = digest(key, seed, k)
            return value(distribution, uniform_of(bits), F.sqrt(-2.0 * F.ln(uniform_of(bits))) * F.cos(2.0 * math.pi * uniform_of(bits, 1)))
        own = int.from_bytes(hashlib.md5(f"{seed}:{k}".encode()).digest()[:7])
        return value(distribution, F.rand(own), F.randn(own))

    def value(distribution: Distribution, u: Column, normal: Column) -> Column:
        if isinstance(distribution, Uniform):
            low, high = _number(distribution.low), _number(distribution.high)
            return low + (high - low) * u
        if isinstance(distribution, Normal):
            return _number(distribution.mean) + _number(distribution.std) * normal
        # The uniform is named once: as a generator it would otherwise draw at every mention.
        cells = F.array(*[
            F.struct(F.lit(float(limit)).alias("limit"), F.lit(float(v)).alias("value"))
            for limit, v in zip([*list(accumulate(distribution.probabilities))[:-1], 2.0], distribution.values)
        ])
        held = F.transform(F.array(u), lambda x: F.filter(cells, lambda c: x < c["limit"])[0]["value"])
        return held[0]

    columns = {n: drawn(k, d).cast("double") for k, (n, d) in enumerate(variables.items())}
    return df.withColumns(columns)


__all__ = ["Discrete", "Normal", "Uniform", "digest", "uniform_of", "with_draws", "with_uniforms"]
