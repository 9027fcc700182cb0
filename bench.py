"""Times the headline queries and prints one JSON line.

Each query runs once cold and then a few times warm; the reported number is the warm
median.  Table queries read whole tables.  The published models draw one iteration per row of
a range, in generated JVM code, in two ways: under their own names from one stream per
partition, with sketched quantiles and plain sums, as the published runs have streams, blocks
and sketches; and as ``keyed_...`` from row keys, with exact quantiles and reproducible sums,
as the registered queries run.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from quincunx.plans.catalog import QUERIES  # noqa: E402
from quincunx.plans.report import report  # noqa: E402

# The published models, under their published names.
MODELS = {
    "normal_mean": r"\model{y=x}\normal x{10,2}\iter{100000}"
    r"\response{avg,var,std,count,valid_rate,discard_rate,p05,p50,p95}",
    "linear_combination": r"\model{y=2x+3z}\normal x{10,2}\uniform z{0,6}\iter{100000}"
    r"\response{avg,var,std,count,valid_rate,discard_rate,p05,p50,p95}",
    "heavy_expression": r"\model{y=\sqrt{x^2+z^2}+\frac{x z}{2}+3x-2z}\normal x{0,1}\uniform z{-3,3}"
    r"\iter{1000000}\response{avg,var,std,count,valid_rate,discard_rate,p05,p50,p95}",
    "quadratic_pm": r"\model{resultado=\frac{-coef_b\pm\sqrt{coef_b^2-4coef_a coef_c}}{2coef_a}}"
    r"\normal coef_a{10,0.5}\distrib coef_b{{10,0.5},{15,0.3},{20,0.2}}\uniform coef_c{-20,30}"
    r"\iter{1000000}\response{avg,std,min,max,count,valid_rate,discard_rate,p05,p50,p95}",
}
MODEL_RUNS = {  # metric -> (model, iterations)
    "normal_mean_100k": ("normal_mean", 100_000),
    "normal_mean_1m": ("normal_mean", 1_000_000),
    "normal_mean_10m": ("normal_mean", 10_000_000),
    "linear_combination_1m": ("linear_combination", 1_000_000),
    "heavy_expression_1m": ("heavy_expression", 1_000_000),
    "quadratic_pm_1m": ("quadratic_pm", 1_000_000),
}
TABLE_QUERIES = (
    "moments", "branches_and_delta", "division_discards", "paired_correlation", "ordered_merge", "quantiles_exact",
    "quantiles_narrowed", "weighted_quantile_interpolated", "histogram_bins", "histogram_weighted", "block_sketches",
    "sketch_quantiles", "task_quantiles", "bootstrap_balance", "coverage_over_seeds", "row_level_simulation", "program_normal_mean", "program_retain_all", "stream_progress",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    runs = {name: (lambda q=QUERIES[name]: q(spark, folder)) for name in TABLE_QUERIES}
    runs |= {
        name: (lambda p=MODELS[model], n=rows: report(spark.range(n), "id", p, 101, quantiles="sketch", keyed=False))
        for name, (model, rows) in MODEL_RUNS.items()
    }
    runs |= {
        f"keyed_{name}": (lambda p=MODELS[model], n=rows: report(spark.range(n), "id", p, 101))
        for name, (model, rows) in MODEL_RUNS.items() if rows <= 1_000_000
    }
    wanted = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))

    warm, cold = {}, {}
    for name, run in runs.items():
        if wanted and name not in wanted:
            continue
        times = []
        for _ in range(1 + repeats):
            start = time.perf_counter()
            run().collect()
            times.append(time.perf_counter() - start)
        cold[name] = round(times[0], 4)
        warm[name] = round(statistics.median(times[1:]), 4)
        print(f"{name}: cold {cold[name]} warm {warm[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "total_warm_seconds", "value": round(sum(warm.values()), 4), "unit": "sec", "queries": warm,
        "cold": cold, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
