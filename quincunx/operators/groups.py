"""Exact quantiles and histograms of many groups at once, hot ones included.

Ranks come from prefix sums: distinct values are range-partitioned by group and value, so a
hot group lies over as many partitions as it needs; each partition's weight of each group is
one row, and running sums of those rows tell where a partition's own ranks begin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quincunx.operators.moments import finite_sql
from quincunx.operators.sketch import NAMES, PROBABILITIES
from quincunx.sources.stored import stored


def running_weights(df: DataFrame, group: str, value: str, weight: str = "1L") -> DataFrame:
    """(g, v, w, before, total): each distinct finite value of each group with its weight, the
    weight of the group's smaller values, and the group's weight.

    ``group``, ``value`` and ``weight`` are SQL over ``df``.  Equal values count together, on
    the map side; rows without a positive weight do not count.  Rows with a NULL group form
    one of their own.
    """
    points = df.selectExpr(f"{group} AS g", f"{finite_sql(value)} AS v", f"{weight} AS w").where("v IS NOT NULL AND w > 0")
    points = points.groupBy("g", "v").agg(F.sum("w").alias("w")).repartitionByRange("g", "v")
    points = stored(points.withColumn("part", F.spark_partition_id()), "points")
    parts = points.groupBy("g", "part").agg(F.sum("w").alias("own"))
    own, whole = Window.partitionBy("g").orderBy("part"), Window.partitionBy("g")
    parts = parts.withColumns({
        "start": F.coalesce(F.sum("own").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(parts.schema["own"].dataType)),
        "total": F.sum("own").over(whole),
    }).select(F.col("g").alias("_g"), F.col("part").alias("_part"), "start", "total")
    within = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    joined = points.join(parts, F.col("g").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_part")))
    return joined.withColumn("before", F.col("start") + F.sum("w").over(within) - F.col("w")).select("g", "v", "w", "before", "total")


def group_quantiles(
    df: DataFrame, group: str, value: str, probabilities: Sequence[float] = PROBABILITIES, names: Sequence[str] = NAMES
) -> DataFrame:
    """(g, n, quantiles...): linearly interpolated exact quantiles of each group's finite values.

    A group without a finite value has no row.
    """
    ranked = running_weights(df, group, value)
    sides = []
    for k, p in enumerate(probabilities):
        rank = f"floor({p!r}D * (total - 1))"
        for side, at in (("a", rank), ("b", f"least({rank} + 1, total - 1)")):
            sides.append(f"max(v) FILTER (WHERE before <= {at} AND {at} < before + w) AS {side}{k}")
    found = ranked.groupBy("g").agg(F.max("total").alias("n"), *[F.expr(s) for s in sides])
    return found.selectExpr("g", "n", *[
        f"if(a{k} = b{k}, a{k}, a{k} + (b{k} - a{k}) * ({p!r}D * (n - 1) - floor({p!r}D * (n - 1)))) AS {name}"
        for k, (p, name) in enumerate(zip(probabilities, names, strict=True))
    ])


def group_weighted_median(df: DataFrame, group: str, value: str, weight: str) -> DataFrame:
    """(g, median): the smallest value at which half of a group's weight is reached."""
    return running_weights(df, group, value, weight).groupBy("g").agg(F.expr("min(v) FILTER (WHERE 2 * (before + w) >= total)").alias("median"))


def group_histograms(df: DataFrame, group: str, value: str, bins: int = 30) -> DataFrame:
    """(g, bin, x0, x1, count): equal-width bins between each group's own extremes.

    Bins as in ``histogram``; only those with a value have a row.  Extremes and counts
    combine on the map side.
    """
    rows = df.selectExpr(f"{group} AS g", f"{finite_sql(value)} AS v").where("v IS NOT NULL")
    extremes = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    extremes = extremes.selectExpr("g AS _g", "lo", "hi", "if(lo = hi, greatest(abs(lo) * 0.01D, 0.5D), 0D) AS pad")
    extremes = extremes.selectExpr("_g", "lo - pad AS first", "hi + pad AS last", f"((hi + pad) - (lo - pad)) / {bins} AS width")
    placed = rows.join(extremes, F.col("g").eqNullSafe(F.col("_g")))
    placed = placed.selectExpr("g", "v", "first", "last", "width", f"least(floor((v - first) / width), {bins - 1}) AS k").selectExpr(
        "g", "first", "last", "width", f"""CASE WHEN v < k * width + first THEN k - 1
                WHEN k < {bins - 1} AND v >= (k + 1) * width + first THEN k + 1 ELSE k END AS bin"""
    )
    return placed.groupBy("g", "bin", "first", "last", "width").agg(F.count("*").alias("count")).selectExpr(
        "g", "bin", "bin * width + first AS x0", f"if(bin = {bins - 1}, last, (bin + 1) * width + first) AS x1", "count"
    )
