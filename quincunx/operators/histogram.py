"""Equal-width histograms between the observed extremes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.operators.moments import finite_sql


def _number(value: float | None) -> str:
    return "cast(NULL AS double)" if value is None else f"({value!r}D)"


def histogram(
    df: DataFrame, measures: Mapping[str, str], bins: int = 30, weight: str = "1L",
    ranges: Mapping[str, tuple[float | None, float | None]] | None = None,
) -> DataFrame:
    """One row per measure: ``histogram`` = {data_min, data_max, total_count, bins[{x0, x1, count}]}.

    Bins are half-open except the last.  A value goes to the bin guessed from its offset,
    then one bin down or up when the edge computed for that bin says so; a division alone
    misplaces values that lie on an edge.  A single observed value gets padded edges.  Known
    extremes in ``ranges`` save the pass that looks for them.
    """
    finite = {m: finite_sql(sql) for m, sql in measures.items()}
    edges = "lo - pad AS first", "hi + pad AS last"
    padded = "*", "if(lo = hi, greatest(abs(lo) * 0.01D, 0.5D), 0D) AS pad"
    if ranges is None:
        cells = ", ".join(f"struct('{m}' AS id, min({sql}) AS lo, max({sql}) AS hi)" for m, sql in finite.items())
        # One row per measure, so broadcasting it is always safe.
        extremes = df.agg(F.expr(f"array({cells})").alias("ranges")).selectExpr("inline(ranges)")
        values = ", ".join(f"struct('{m}' AS id, {sql} AS v, {weight} AS w)" for m, sql in finite.items())
        stacked = df.selectExpr(f"inline(array({values}))").where("v IS NOT NULL")
        extremes = extremes.selectExpr(*padded).selectExpr("id", "lo", "hi", *edges)
        extremes = extremes.selectExpr("*", f"(last - first) / {bins} AS width")
        stacked = stacked.join(F.broadcast(extremes), "id")
    else:
        known = ", ".join(f"struct('{m}' AS id, {_number(ranges[m][0])} AS lo, {_number(ranges[m][1])} AS hi)" for m in measures)
        extremes = df.sparkSession.range(1).selectExpr(f"inline(array({known}))")
        extremes = extremes.selectExpr(*padded).selectExpr("id", "lo", "hi", *edges)
        extremes = extremes.selectExpr("*", f"(last - first) / {bins} AS width")
        values = []
        for m, sql in finite.items():
            lo, hi = ranges[m]
            pad = max(abs(lo) * 0.01, 0.5) if lo is not None and lo == hi else 0.0
            first, width = (None, None) if lo is None else (lo - pad, (hi + pad - (lo - pad)) / bins)
            values.append(f"struct('{m}' AS id, {sql} AS v, {weight} AS w, {_number(first)} AS first, {_number(width)} AS width)")
        stacked = df.selectExpr(f"inline(array({', '.join(values)}))").where("v IS NOT NULL")
    counted = (
        stacked.selectExpr("id", "v", "w", "first", "width", f"least(floor((v - first) / nullif(width, 0D)), {bins - 1}) AS k")
        .selectExpr(
            "id",
            "w",
            f"""CASE WHEN v < k * width + first THEN k - 1
                WHEN k < {bins - 1} AND v >= (k + 1) * width + first THEN k + 1 ELSE k END AS k""",
        )
        .groupBy("id", "k")
        .agg(F.sum("w").alias("count"))
        .groupBy("id")
        .agg(F.expr("map_from_entries(collect_list(struct(k, count)))").alias("counts"))
    )
    shape = f"""transform(sequence(0L, {bins - 1}L), k -> struct(
        k * width + first AS x0,
        if(k = {bins - 1}, last, (k + 1) * width + first) AS x1,
        coalesce(try_element_at(counts, k), 0L) AS count))"""
    empty = "cast(array() AS array<struct<x0:double,x1:double,count:bigint>>)"
    return (
        extremes.join(F.broadcast(counted), "id", "left")
        .selectExpr("id", "lo", "hi", f"if(lo IS NULL, {empty}, {shape}) AS bins")
        .selectExpr(
            "id",
            """struct(lo AS data_min, hi AS data_max,
                aggregate(bins.count, 0L, (a, c) -> a + c) AS total_count, bins AS bins) AS histogram""",
        )
    )


def histogram_rows(histograms: DataFrame) -> DataFrame:
    """The same as (id, bin, x0, x1, count) rows."""
    return histograms.select("id", F.posexplode("histogram.bins").alias("bin", "cell")).select("id", "bin", "cell.*")
