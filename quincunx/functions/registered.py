"""The derived statistics as temporary functions of a session's SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quincunx.functions import summary

_ERROR = summary.mcse("n", "m2")
FUNCTIONS = {  # name -> parameters, result, SQL over them
    "sample_variance": ("n BIGINT, m2 DOUBLE", "DOUBLE", summary.variance("n", "m2")),
    "mcse": ("n BIGINT, m2 DOUBLE", "DOUBLE", _ERROR),
    "mean_interval": ("n BIGINT, mean DOUBLE, m2 DOUBLE", "ARRAY<DOUBLE>", summary.mean_interval("mean", _ERROR)),
    "relative_mcse": ("n BIGINT, mean DOUBLE, m2 DOUBLE", "DOUBLE", summary.relative_mcse("mean", _ERROR)),
    "wilson_interval": ("successes BIGINT, trials BIGINT", "ARRAY<DOUBLE>", summary.wilson("successes", "trials")),
}


def register_functions(spark: SparkSession) -> None:
    """Makes ``FUNCTIONS`` known to ``spark.sql``; Spark puts their text in place of each call."""
    for name, (parameters, result, sql) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {sql}")
