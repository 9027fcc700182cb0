"""Reports as flat tables and files."""

from __future__ import annotations

from pyspark.sql import DataFrame

_PAIRS = ("ci95_mean", "valid_rate_ci95_wilson", "discard_rate_ci95_wilson")
_REPEATED = ("n", "candidate_results", "valid_rate", "discard_rate")


def flat_report(report: DataFrame) -> DataFrame:
    """One plain column per number: identity, statistics, diagnostics; no histogram."""
    diagnostics = report.schema["diagnostics"].dataType.names
    plain = [d for d in diagnostics if d not in _PAIRS and d not in _REPEATED]
    return report.selectExpr(
        "id", "label", "candidate_results", "valid_results", "discarded_results",
        "correlation_plus_minus_mean",
        *[f"stats.{name} AS {name}" for name in report.schema["stats"].dataType.names],
        *[f"diagnostics.{name} AS {name}" for name in plain],
        *[f"diagnostics.{name}[{k}] AS {name}_{side}" for name in _PAIRS for k, side in enumerate(("low", "high"))],
    )


def write_report(report: DataFrame, path: str, format: str = "parquet") -> None:
    """Writes a report; formats without nested columns get the flat one."""
    if format == "csv":
        flat_report(report).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    else:
        report.coalesce(1).write.mode("overwrite").format(format).save(path)
