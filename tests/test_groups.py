"""Reproducible sums, grouped quantiles and resampling against plain Python."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quincunx.functions.registered import FUNCTIONS, register_functions
from quincunx.operators import groups, resampling, sums
from quincunx.operators.moments import column_moments
from quincunx.plans.report import report
from quincunx.sources.draws import BITS

rng = np.random.default_rng(3)
VALUES = [*rng.normal(1e6, 1e-3, 4000), *rng.lognormal(0, 9, 3000), *rng.normal(0, 1, 3000), 1e-300, 0.0, -0.0, 7.5, math.nan, math.inf]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(k, k % 7, float(v)) for k, v in enumerate(VALUES)] + [(10**6, 3, None)], "k long, g long, v double")


def test_sums_have_one_result(spark, values):
    finite = [v for v in VALUES if math.isfinite(v)]
    states = {tuple(sums.reproducible_moments(values.repartition(n, by), {"v": "v", "none": "nullif(v, v)"}).collect()) for n, by in ((1, "k"), (3, "g"), (17, "v"))}
    assert len(states) == 1
    got, none = next(iter(states))
    assert (none.n, none.mean, none.m2, none.low, none.candidates) == (0, 0.0, 0.0, None, len(VALUES) + 1)
    assert (got.n, got.candidates, got.low, got.high) == (len(finite), len(VALUES) + 1, min(finite), max(finite))
    mean = sum(map(Fraction, finite)) / len(finite)
    assert got.mean == pytest.approx(float(mean), rel=1e-14)
    assert got.m2 == pytest.approx(float(sum((Fraction(v) - mean) ** 2 for v in finite)), rel=1e-13)
    plain = column_moments(values, {"v": "v"}).first()
    assert got.m2 == pytest.approx(plain.m2, rel=1e-9) and got.mean == pytest.approx(plain.mean, rel=1e-12)


@pytest.mark.parametrize("scale", [1e-310, 1e-290, 1.0, 1e300])
def test_sums_of_any_scale(spark, scale):
    own = [scale * k / 64 for k in range(-40, 100)]
    df = spark.createDataFrame([(v,) for v in own], "v double")
    got = sums.reproducible_moments(df, {"v": "v"}).first()
    assert got.mean == pytest.approx(float(sum(map(Fraction, own)) / len(own)), rel=1e-9, abs=1e-304)


def test_correlation_has_one_result(spark):
    df = spark.range(20_000).selectExpr("id", "rand(5) AS u", "randn(6) AS w").selectExpr("id", "u + 1e-3 * w AS plus", "u - w AS minus")
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/pairs")
    df = spark.read.parquet(path)
    states = {r.id: r.asDict() for r in sums.reproducible_moments(df, {"plus": "plus", "minus": "minus"}).collect()}
    found = {tuple(sums.reproducible_correlation(df.repartition(n), "id div 500", "plus", "minus", states).first()) for n in (2, 9)}
    assert len(found) == 1
    table = df.toPandas()
    want = np.mean([np.corrcoef(t.plus, t.minus)[0, 1] for _, t in table.groupby(table.id // 500)])
    (r, blocks), = found
    assert r == pytest.approx(want, rel=1e-9) and blocks == 40


def test_a_pass_draws_nothing(spark, monkeypatch):
    """A keyed report draws each variable once, into a table; later passes hold no digest."""
    seen = []
    from quincunx.plans import report as module

    for name in ("reproducible_moments", "exact_quantiles", "histogram", "reproducible_correlation"):
        whole = getattr(module, name)
        monkeypatch.setattr(module, name, lambda df, *a, _w=whole, **k: seen.append(df) or _w(df, *a, **k))
    report(spark.range(3000), "id", r"\model{y=x\pm z}\normal x{0,1}\uniform z{0,1}\iter{1}\response{avg,p50}", 5)
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in seen]
    assert len(plans) == 4 and not any("md5(" in p for p in plans)


def test_group_quantiles(spark, values):
    df = values.withColumn("g", F.when(F.col("k") % 11 == 0, None).when(F.col("k") % 3 > 0, F.lit("hot")).otherwise(F.col("g").cast("string")))
    df = df.withColumn("v", F.when(F.col("g") == "2", 4.0).when(F.col("g") == "5", F.lit(math.nan)).otherwise(F.col("v")))
    table = df.toPandas()
    got = {r.g: r for r in groups.group_quantiles(df.repartition(9), "g", "v").collect()}
    for g, own in table.groupby("g", dropna=False):
        v = own.v.to_numpy()
        v = v[np.isfinite(v)]
        name = g if isinstance(g, str) else None
        if not v.size:
            assert name not in got
            continue
        assert got[name].n == v.size
        assert [got[name][q] for q in ("p05", "p50", "p95")] == pytest.approx(np.quantile(v, (0.05, 0.5, 0.95)).tolist(), rel=1e-12)
    counted = {}
    for r in groups.group_histograms(df, "g", "v", 6).collect():
        counted.setdefault(r.g, np.zeros(6, int))[r.bin] = r["count"]
    for g, own in table.groupby("g", dropna=False):
        v = own.v.to_numpy()
        v = v[np.isfinite(v)]
        if v.size:
            assert counted[g if isinstance(g, str) else None].sum() == v.size
    assert groups.group_quantiles(df.limit(0), "g", "v").count() == 0


def test_weighted_median(spark):
    rows = [("a", 1.0, 1), ("a", 2.0, 5), ("a", 9.0, 1), ("b", 3.0, 0), ("b", 4.0, 2), ("b", 4.0, 2), ("b", 8.0, 4), ("c", 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    assert {r.g: r.median for r in groups.group_weighted_median(df, "g", "v", "w").collect()} == {"a": 2.0, "b": 4.0}


def test_poisson_weights(spark):
    df = spark.range(4000).selectExpr("id", "cast(id AS double) AS v")
    rows = resampling.replicate_weights(df, "id", "v", 5, 9).collect()
    held = {(r.r, int(r.v)): r.w for r in rows}
    for key in (0, 1, 77, 3999):
        for r in range(5):
            digits = hashlib.md5(f"9:{r // 2}:{key}".encode()).hexdigest()[13 * (r % 2):][:13]
            u = (int(digits, 16) + 0.5) * 2.0**-BITS
            assert held.get((r, key), 0) == sum(u >= p for p in resampling.POISSON)
    assert {r.r for r in rows} == set(range(5))
    assert sum(held.values()) / (5 * 4000) == pytest.approx(1, abs=0.03)


def test_bootstrap_ranks_one_range_of_each_replicate(spark, monkeypatch):
    """Medians as from all weights, ties over several ranges included, with no table of weights."""
    df = spark.range(3000).selectExpr("id", "if(id % 11 = 0, NULL, cast((id * 7919) % 3000 div 20 AS double)) AS v")
    df = df.unionByName(spark.range(3000, 4500).selectExpr("id", "70D AS v"))
    held = {}
    for r in resampling.replicate_weights(df, "id", "v", 7, 3).collect():
        held.setdefault(r.r, []).append((r.v, r.w))
    made, plain = [], resampling.stored

    def counting(table, label):
        out = plain(table, label)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(resampling, "stored", counting)
    monkeypatch.setattr(resampling, "PART_ROWS", 300, raising=False)
    got = {r.r: (r.mean, r.median) for r in resampling.bootstrap(df, "id", "v", 7, 3).collect()}
    assert set(got) == set(held)
    for r, rows in held.items():
        total, upto = sum(w for _, w in rows), 0
        for v, w in sorted(rows):
            upto += w
            if 2 * upto >= total:
                break
        assert got[r] == (pytest.approx(sum(v * w for v, w in rows) / total, rel=1e-12), v)
    assert max(n for _, n in made) <= df.count(), made


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 10 = 0, NULL, cast(id % 100 AS double)) AS v")
    own = [k % 100 for k in range(3000) if k % 10]
    low, high = next((r.low, r.high) for r in resampling.bootstrap_intervals(df, "id", "v", 60, 4).collect() if r.statistic == "mean")
    half = 1.96 * np.std(own) / math.sqrt(len(own))
    assert low < np.mean(own) < high and (high - low) / 2 == pytest.approx(half, rel=0.5)


def test_registered_functions(spark):
    register_functions(spark)
    register_functions(spark)
    row = spark.sql("SELECT wilson_interval(8L, 10L) AS w, wilson_interval(0L, 0L) AS none, mcse(4L, 12D) AS e, mean_interval(4L, 1D, 12D) AS ci, "
                    "sample_variance(1L, 0D) AS v, relative_mcse(4L, 2D, 12D) AS r").first()
    z, p, n = 1.96, 0.8, 10
    half = z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    want = [(p + z * z / (2 * n) + side * half) / (1 + z * z / n) for side in (-1, 1)]
    assert row.w == pytest.approx(want, rel=1e-12) and row.none is None and row.e == 1.0 and row.v is None
    assert row.ci == [1 - 1.96, 1 + 1.96] and row.r == 0.5 and len(FUNCTIONS) == 5
