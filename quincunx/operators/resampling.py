"""Bootstrap intervals of a mean and a median, and how often an interval holds its target."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import exp, factorial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quincunx.functions import summary
from quincunx.operators.groups import group_quantiles
from quincunx.operators.moments import finite_sql
from quincunx.sources.draws import digest, uniform_of
from quincunx.sources.stored import stored

# Chances that a Poisson(1) count is at most 0, 1, ...; beyond the last lie 10^-14 of all draws.
POISSON = tuple(accumulate(exp(-1) / factorial(k) for k in range(16)))
PART_ROWS = 1 << 14  # rows of a range of values, as long as that makes at most MOST_PARTS of them
MOST_PARTS = 4096


def poisson_sql(u: str) -> str:
    """The Poisson(1) count at a uniform ``u``."""
    cases = " ".join(f"WHEN {u} < {p!r}D THEN {k}L" for k, p in enumerate(POISSON))
    return f"CASE {cases} ELSE {len(POISSON)}L END"


def replicate_weights(df: DataFrame, key: str, value: str, replicates: int, seed: int, *keep: str) -> DataFrame:
    """(r, v, w) and ``keep``: each row with a finite value in each replicate, ``w`` times.

    A weight is a function of (seed, key, replicate), so replicates need no draw of rows and
    no pass of their own; two of them share a digest.
    """
    rows = df.selectExpr(f"cast({key} AS bigint) AS _key", f"{finite_sql(value)} AS v", *keep).where("v IS NOT NULL")
    rows = rows.withColumn("pair", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 2))))
    rows = rows.withColumn("d", digest("_key", seed, F.col("pair"))).select("v", "pair", *keep, *[uniform_of(F.col("d"), k).alias(f"u{k}") for k in (0, 1)])
    cells = ", ".join(f"struct(2 * pair + {k} AS r, {poisson_sql(f'u{k}')} AS w)" for k in (0, 1))
    return rows.selectExpr("v", *keep, f"inline(array({cells}))").where(f"w > 0 AND r < {replicates}").select("r", "v", "w", *keep)


def bootstrap(df: DataFrame, key: str, value: str, replicates: int, seed: int) -> DataFrame:
    """(r, mean, median) of each replicate of a Poisson bootstrap.

    Rows lie in ranges of values, stored once; weights are drawn where they are needed and
    never stored.  Sums of each range and replicate combine on the map side and tell in which
    range a replicate reaches half of its weight; only that range's values are ranked.
    """
    points = df.selectExpr(f"cast({key} AS bigint) AS _key", f"{finite_sql(value)} AS v").where("v IS NOT NULL")
    parts = min(MOST_PARTS, 1 + points.count() // PART_ROWS)
    points = stored(points.repartitionByRange(parts, "v", "_key").withColumn("part", F.spark_partition_id()), "points")
    weighted = replicate_weights(points, "_key", "v", replicates, seed, "part")
    sums = stored(weighted.groupBy("r", "part").agg(F.sum("w").alias("own"), F.sum(F.col("v") * F.col("w")).alias("vw")), "sums")
    means = sums.groupBy("r").agg((F.sum("vw") / F.sum("own")).alias("mean"))
    ordered, whole = Window.partitionBy("r").orderBy("part"), Window.partitionBy("r")
    reached = sums.withColumns({"start": F.sum("own").over(ordered) - F.col("own"), "total": F.sum("own").over(whole)})
    reached = reached.where("2 * start < total AND 2 * (start + own) >= total").select("r", "part", "start", "total")  # one row for each replicate
    rows = points.join(F.broadcast(reached), "part")
    d = digest("_key", seed, F.expr("r div 2"))
    rows = rows.withColumn("u", F.when(F.expr("r % 2 = 0"), uniform_of(d, 0)).otherwise(uniform_of(d, 1)))
    rows = rows.selectExpr("r", "v", "start", "total", f"{poisson_sql('u')} AS w").where("w > 0")
    rows = rows.groupBy("r", "v", "start", "total").agg(F.sum("w").alias("w"))
    rows = rows.withColumn("upto", F.col("start") + F.sum("w").over(Window.partitionBy("r").orderBy("v")))
    medians = rows.groupBy("r").agg(F.expr("min(v) FILTER (WHERE 2 * upto >= total)").alias("median"))
    return means.join(medians, "r")


def bootstrap_intervals(df: DataFrame, key: str, value: str, replicates: int = 200, seed: int = 0, share: float = 0.95) -> DataFrame:
    """(statistic, low, high): percentile intervals of the mean and the median."""
    tail = (1 - share) / 2
    found = bootstrap(df, key, value, replicates, seed)
    stacked = found.selectExpr("inline(array(struct('mean' AS statistic, mean AS x), struct('median' AS statistic, median AS x)))")
    return group_quantiles(stacked, "statistic", "x", (tail, 1 - tail), ("low", "high")).selectExpr("g AS statistic", "low", "high")


def interval_coverage(df: DataFrame, key: str, value, seeds: Sequence[int], target: str) -> DataFrame:
    """(seed, n, mean, low, high, covered): for each seed a model's mean over the rows, its 95 %
    interval and whether that holds ``target``.

    ``value`` makes the model's Column from a uniform; all seeds are drawn in one pass, and
    states of seeds combine on the map side.
    """
    listed = F.array(*[F.lit(str(s)) for s in seeds])
    rows = df.withColumn("_key", F.expr(key).cast("long")).withColumn("seed", F.explode(listed))
    rows = rows.withColumn("_v", value(uniform_of(digest("_key", F.col("seed"), 0)))).select("seed", F.expr(finite_sql("_v")).alias("v"), F.expr(target).alias("t"))
    states = rows.groupBy("seed").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.expr("var_pop(v) * count(v)").alias("m2"), F.avg("t").alias("target")
    )
    error = summary.mcse("n", "m2")
    found = states.selectExpr("seed", "n", "mean", "target", f"{summary.mean_interval('mean', error)} AS ci")
    return found.selectExpr("seed", "n", "mean", "ci[0] AS low", "ci[1] AS high", "target BETWEEN ci[0] AND ci[1] AS covered")
