"""Whole reports of models over the given tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quincunx.operators.fidelity import result_events
from quincunx.operators.sketch import rank_error
from quincunx.plans.program import Normal, Uniform, read_program
from quincunx.plans.report import NoFiniteResult, branch_values, report
from quincunx.sources.reports import flat_report, write_report

FOLDER = "/root/testdata/sf0.01"
TAIL = r"\iter{1}\response{max,avg,p50}"


@pytest.fixture(scope="module")
def parts(spark):
    return spark.read.parquet(f"{FOLDER}/part.parquet")


@pytest.fixture(scope="module")
def customers(spark):
    return spark.read.parquet(f"{FOLDER}/customer.parquet")


def test_report_follows_the_values(parts):
    model = r"\model{y=x\pm3z}\normal x{0,1}\uniform z{1,2}" + TAIL
    bind = {"x": Normal("p_retailprice", "p_size")}
    values = branch_values(parts, "p_partkey", model, 9, bind).toPandas()
    rows = {r.id: r for r in report(parts, "p_partkey", model, 9, bind, bins=12, block_rows=300).collect()}
    assert list(rows) == ["plus", "minus", "plus_minus_delta"]
    for branch, row in rows.items():
        own = values[branch].to_numpy()
        assert list(row.stats.asDict()) == ["max", "avg", "p50"]
        assert row.stats.max == own.max() and row.stats.p50 == pytest.approx(np.quantile(own, 0.5), rel=1e-13)
        assert row.stats.avg == pytest.approx(own.mean(), rel=1e-12)
        assert row.diagnostics.sample_variance == pytest.approx(own.var(ddof=1), rel=1e-9)
        counts = np.histogram(own, np.linspace(own.min(), own.max(), 13))[0]
        assert [b["count"] for b in row.histogram.bins] == counts.tolist()
        assert row.candidate_results == row.valid_results == row.histogram.total_count == len(own)
    blocks = [g for _, g in values.groupby(values.key // 300) if len(g) > 1]
    want = np.mean([np.corrcoef(g.plus, g.minus)[0, 1] for g in blocks])
    assert rows["plus_minus_delta"].correlation_plus_minus_mean == pytest.approx(want, abs=1e-10)
    assert rows["plus"].correlation_plus_minus_mean is None


def test_sketched_quantiles_are_close(parts):
    model = r"\model{y=x z}\normal x{0,1}\uniform z{1,2}\iter{1}\response{p05,p50,p95,count}"
    own = np.sort(branch_values(parts, "p_partkey", model, 4, {"x": "p_retailprice"}).toPandas().main)
    stats = report(parts, "p_partkey", model, 4, {"x": "p_retailprice"}, quantiles="sketch").first().stats
    for p, q in zip((0.05, 0.5, 0.95), (stats.p05, stats.p50, stats.p95)):
        assert abs(np.searchsorted(own, q) / own.size - p) < 3 * rank_error()


def test_discards_are_counted_per_branch(customers):
    model = r"\model{y=\frac{1\pm\sqrt{x}}{z}}\normal x{0,1}\normal z{0,1}" + TAIL
    bind = {"x": "c_acctbal", "z": "c_custkey % 5"}
    rows = {r.id: r for r in report(customers, "c_custkey", model, 1, bind).collect()}
    n = customers.where("c_acctbal >= 0 AND c_custkey % 5 <> 0").count()
    assert {i: r.valid_results for i, r in rows.items()} == {"plus": n, "minus": n, "plus_minus_delta": n}
    assert rows["plus"].discarded_results == customers.count() - n


@pytest.mark.parametrize("column", ["id", "valid_results", "stats", "diagnostics", "histogram"])
def test_no_finite_result_is_an_error_whatever_is_read(customers, column):
    model = r"\model{y=\sqrt{x}}\normal x{0,1}" + TAIL
    with pytest.raises(NoFiniteResult):
        report(customers, "c_custkey", model, 1, {"x": "-1 - abs(c_acctbal)"}).select(column).collect()
    with pytest.raises(NoFiniteResult):
        report(customers.limit(0), "c_custkey", model, 1, {"x": "c_acctbal"}).select(column).collect()


def test_one_empty_branch_is_reported_with_nulls(customers):
    model = r"\model{y=\sqrt{1\pm x}}\normal x{0,1}" + TAIL
    rows = {r.id: r for r in report(customers, "c_custkey", model, 1, {"x": "2 + abs(c_acctbal)"}).collect()}
    assert rows["plus"].valid_results == customers.count() and rows["minus"].valid_results == 0
    assert (rows["minus"].stats.avg, rows["minus"].histogram.bins, rows["minus"].diagnostics.mcse_mean) == (None, [], None)
    assert rows["plus_minus_delta"].correlation_plus_minus_mean is None


def test_a_single_row_has_no_spread(customers):
    row = report(customers.where("c_custkey = 7"), "c_custkey", r"\model{y=x}\normal x{0,1}" + TAIL, 1, {"x": "c_acctbal"}).first()
    assert row.valid_results == 1 and row.diagnostics.sample_variance is None and row.diagnostics.ci95_mean is None
    assert sum(b["count"] for b in row.histogram.bins) == 1


def test_partitions_change_no_draw(customers):
    model = r"\model{y=x+z}\normal x{0,1}\uniform z{-2,2}" + TAIL
    a, b = (branch_values(customers.repartition(n), "c_custkey", model, 3) for n in (1, 7))
    assert a.exceptAll(b).count() == 0
    other = branch_values(customers, "c_custkey", model, 4)
    assert a.intersect(other).count() == 0 and other.count() == customers.count()


def test_clashing_columns_and_wrong_arguments(customers):
    df = customers.withColumns({n: F.lit(1) for n in ("main", "key", "plus", "v0", "x")})
    model = r"\model{y=x}\uniform x{2,3}" + TAIL
    assert 2 < report(df, "c_custkey", model, 1).first().stats.max < 3
    assert report(df, "c_custkey", model, 1, {"x": Uniform("c_acctbal", "c_acctbal + 1")}).first().valid_results == customers.count()
    with pytest.raises(KeyError):
        report(df, "c_custkey", model, 1, {"z": "c_acctbal"})
    with pytest.raises(ValueError):
        report(df, "c_custkey", model, 1, quantiles="best")


@pytest.mark.parametrize("format", ["csv", "json", "parquet"])
def test_reports_can_be_written(spark, parts, tmp_path, format):
    rows = report(parts, "p_partkey", read_program(r"\model{y=x\pm1}\normal x{0,1}" + TAIL), 3, {"x": "p_retailprice"})
    write_report(rows, str(tmp_path / format), format)
    reader = spark.read.option("header", True).option("inferSchema", True)
    back = {r.id: r for r in reader.format(format).load(str(tmp_path / format)).collect()}
    want = {r.id: r for r in rows.collect()}
    assert set(back) == set(want)
    for branch, row in want.items():
        got = back[branch]
        assert (got.avg if format == "csv" else got.stats.avg) == row.stats.avg


def test_flat_report_and_events(parts):
    rows = report(parts, "p_partkey", r"\model{y=x\pm1}\normal x{0,1}" + TAIL, 3, {"x": "p_retailprice"})
    flat = flat_report(rows)
    assert {"max", "avg", "ci95_mean_low", "valid_rate_ci95_wilson_high", "mcse_mean"} <= set(flat.columns)
    assert all("<" not in t for _, t in flat.dtypes)
    assert result_events(rows.select("id", "valid_results")).where("value LIKE '{\"type\":\"complete\",\"id\":%'").count() == 3
