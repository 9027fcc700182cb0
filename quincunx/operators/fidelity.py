"""How far one report is from another, and a digest that ignores how it was computed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram_distance(exact: DataFrame, other: DataFrame) -> DataFrame:
    """Total-variation distance in percent per id, from (id, bin, count) rows."""
    return (
        exact.select("id", "bin", F.col("count").alias("a"))
        .join(other.select("id", "bin", F.col("count").alias("b")), ["id", "bin"], "full")
        .groupBy("id")
        .agg(
            F.expr(
                "100D * sum(abs(coalesce(a, 0) - coalesce(b, 0))) / (2D * greatest(1, sum(coalesce(a, 0))))"
            ).alias("tv_distance_pct")
        )
    )


def quantile_error(exact: DataFrame, other: DataFrame, names=("p05", "p50", "p95")) -> DataFrame:
    """Largest relative quantile error in percent per id."""
    terms = ", ".join(f"100D * abs(b.{q} - a.{q}) / greatest(1e-12D, abs(a.{q}))" for q in names)
    largest = f"greatest({terms})" if len(names) > 1 else terms
    return exact.alias("a").join(other.alias("b"), "id").selectExpr("id", f"{largest} AS quantile_error_pct")


def result_digest(report: DataFrame) -> DataFrame:
    """SHA-256 over all rows as JSON in id order; equal reports have equal digests."""
    columns = sorted(report.columns)
    return report.select("id", F.to_json(F.struct(*columns)).alias("j")).agg(
        F.expr("sha2(concat_ws('\\n', transform(array_sort(collect_list(struct(id, j))), x -> x.j)), 256)").alias("sha256")
    )


def result_events(report: DataFrame, kind: str = "complete") -> DataFrame:
    """One JSON event per row, ready for ``write.text`` or a message sink."""
    return report.select(F.to_json(F.struct(F.lit(kind).alias("type"), *report.columns)).alias("value"))
