import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quincunx.functions import summary
from quincunx.functions.arithmetic import ieee_div
from quincunx.operators.histogram import histogram
from quincunx.operators.moments import (
    block_correlation,
    block_moments,
    column_moments,
    fold_moments,
    report_moments,
)
from quincunx.operators.quantiles import exact_quantiles, weighted_quantiles
from quincunx.operators.sketch import bins_sql, block_sketches, merge_sketches, quantiles_sql, rank_error
from quincunx.sources.draws import Discrete, Normal, Uniform, with_draws, with_uniforms

PROBS = [0.05, 0.5, 0.95]
FOLDER = "/root/testdata/sf0.01"


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def given(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


def test_division_follows_ieee(spark):
    edge = [0.0, -0.0, 1.0, -1.0, 2.5, float("inf"), float("-inf"), float("nan")]
    pairs = [(a, b) for a in edge for b in edge]
    df = spark.createDataFrame(pairs, "n double, d double").select(ieee_div(F.col("n"), F.col("d")).alias("q"))
    got = np.array([r.q for r in df.collect()])
    with np.errstate(all="ignore"):
        want = np.array([np.float64(a) / np.float64(b) for a, b in pairs])
    np.testing.assert_array_equal(got, want)
    np.testing.assert_array_equal(np.signbit(got[~np.isnan(got)]), np.signbit(want[~np.isnan(want)]))


def test_non_finite_values_are_only_counted(spark):
    values = [1.0, float("nan"), float("inf"), float("-inf"), None, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = report_moments(column_moments(df, {"x": "x"})).first()
    assert (row.candidates, row["count"], row.discarded, row.avg, row["max"]) == (6, 2, 4, 2.0, 3.0)
    empty = report_moments(column_moments(df.where("x IS NULL"), {"x": "x"})).first()
    assert (empty["count"], empty.avg, empty["min"], empty["var"], empty.mcse, empty.ci95) == (0,) + (None,) * 5


@pytest.mark.parametrize("block", ["i", "i - 1700", "(i - 900) * 1000000000000001L", "if(i % 7 = 0, NULL, i * 65537)"])
def test_fold_tree_covers_every_block(spark, block):
    prices = given(spark, "orders").selectExpr("o_orderkey % 4000 AS i", "o_totalprice AS x")
    values = np.array([r.x for r in prices.collect()])
    row = report_moments(fold_moments(block_moments(prices, block, {"x": "x"}))).first()
    assert row["count"] == values.size and (row["min"], row["max"]) == (values.min(), values.max())
    assert row.avg == pytest.approx(values.mean(), rel=1e-12)
    assert row["var"] == pytest.approx(values.var(ddof=1), rel=1e-12)


def test_wilson(spark):
    df = spark.createDataFrame([(37, 60), (0, 10), (10, 10), (0, 0)], "k long, n long")
    rows = df.selectExpr(f"{summary.wilson('k', 'n')} AS w").collect()
    z, n, p = 1.96, 60, 37 / 60
    middle, half = p + z * z / 2 / n, z * np.sqrt(p * (1 - p) / n + z * z / 4 / n / n)
    assert rows[0].w == pytest.approx([(middle - half) / (1 + z * z / n), (middle + half) / (1 + z * z / n)], abs=1e-12)
    assert rows[1].w[0] == 0.0 and rows[2].w[1] == 1.0 and rows[3].w is None


def test_block_correlation_skips_blocks_without_one(spark):
    plus = np.array([1.0, 2.0, 3.0, 5.0, 5.0, 5.0, 1.0, 4.0, 2.0, np.nan])
    minus = np.array([2.0, 1.0, 4.0, 1.0, 2.0, 3.0, 3.0, 1.0, 9.0, 1.0])
    df = frame(spark, i=np.arange(10), p=plus, m=minus)
    r = [np.corrcoef(plus[a : a + 3], minus[a : a + 3])[0, 1] for a in (0, 6)]
    for block in ("i div 3", "(i div 3 - 1) * 1000000007L", "if(i < 3, NULL, i div 3)"):
        row = block_correlation(df, block, "p", "m").first()
        assert row.blocks == 2 and row.correlation_plus_minus_mean == pytest.approx(np.mean(r), abs=1e-14)


def adversarial():
    rng = np.random.default_rng(11)
    third = np.full(3_000, 7.25)
    return {
        "normal": rng.normal(50, 10, 9_000),
        "one_value_holds_a_third": np.concatenate([third, rng.normal(7, 2, 6_000)]),
        "three_values": rng.choice([1.0, 2.0, 3.0], 9_000),
        "constant": np.full(9_000, -4.0),
        "heavy_tail": np.concatenate([rng.standard_t(2, 8_990), np.geomspace(1e10, 1e300, 10)]),
        "tiny_range": 1.0 + np.arange(9_000) * 2.0**-52,
        "signed_zero": np.concatenate([np.full(4_500, -0.0), np.full(4_500, 0.0)]),
    }


@pytest.mark.parametrize("name", list(adversarial()))
def test_narrowed_quantiles_are_exact(spark, name):
    values = np.random.default_rng(1).permutation(adversarial()[name])
    df = frame(spark, x=values)
    narrowed, sorted_ = (exact_quantiles(df, {"x": "x"}, small=n).first() for n in (200, 65_536))
    np.testing.assert_allclose([narrowed.p05, narrowed.p50, narrowed.p95], np.quantile(values, PROBS), rtol=1e-14)
    assert narrowed == sorted_  # where the search stops changes no digit


def test_several_measures_narrow_together(spark):
    data = adversarial()
    df = frame(spark, a=data["normal"], b=data["three_values"], c=np.full(9_000, np.nan))
    rows = {r.id: r for r in exact_quantiles(df, {"a": "a", "b": "b", "c": "c"}, small=300).collect()}
    np.testing.assert_allclose([rows["a"].p05, rows["a"].p50, rows["a"].p95], np.quantile(data["normal"], PROBS))
    assert [rows["b"].p05, rows["b"].p50, rows["b"].p95] == np.quantile(data["three_values"], PROBS).tolist()
    assert rows["c"].p50 is None


def plain_weighted(centers, weights, method):
    """By expanding: the step where the cumulative weight is reached, or between mid-weights."""
    merged = pd.DataFrame({"c": centers, "w": weights})
    merged = merged[merged.w > 0].groupby("c").w.sum()
    reached = merged.cumsum()
    if method == "step":
        return [merged.index[(reached >= p * merged.sum()).argmax()] for p in PROBS]
    return np.interp([p * merged.sum() for p in PROBS], reached - merged / 2, merged.index).tolist()


@pytest.mark.parametrize("method", ["step", "linear"])
@pytest.mark.parametrize("points, small", [(20, 65_536), (20, 4), (900, 65_536), (3_000, 50)])
def test_weighted_quantiles_of_a_table(spark, points, small, method):
    rng = np.random.default_rng(points)
    centers = rng.normal(0, 5, points)
    weights = rng.integers(0, 40, points)
    weights[3] = weights.sum() // 2  # one point holds a third of the weight
    centers, weights = np.concatenate([centers, centers[:5]]), np.concatenate([weights, weights[:5]])
    df = frame(spark, c=centers, w=weights)
    got = [r.value for r in weighted_quantiles(df, "c", "w", method=method, small=small).orderBy("probability").collect()]
    np.testing.assert_allclose(got, plain_weighted(centers, weights, method), rtol=1e-12)


def test_weighted_quantiles_without_weight(spark):
    df = frame(spark, c=[1.0, 2.0], w=[0, 0])
    assert [r.value for r in weighted_quantiles(df, "c", "w").collect()] == [None] * 3
    with pytest.raises(ValueError):
        weighted_quantiles(df, "c", "w", method="nearest")


@pytest.mark.parametrize("known", [False, True])
@pytest.mark.parametrize("bins", [1, 7, 30])
def test_histogram_matches_numpy(spark, bins, known):
    values = np.concatenate([np.linspace(0, 3, 301), np.round(np.random.default_rng(2).normal(1.5, 0.4, 2_000), 1)])
    ranges = {"x": (float(values.min()), float(values.max()))} if known else None
    row = histogram(frame(spark, x=values), {"x": "x"}, bins, ranges=ranges).first().histogram
    counts, edges = np.histogram(values, np.linspace(values.min(), values.max(), bins + 1))
    assert [b["count"] for b in row.bins] == counts.tolist() and row.total_count == values.size
    np.testing.assert_allclose([b.x0 for b in row.bins] + [row.bins[-1].x1], edges, rtol=0, atol=1e-15)


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "x double, y double")
    for ranges in (None, {"x": (None, None), "y": (1.0, 1.0)}):
        rows = {r.id: r.histogram for r in histogram(df, {"x": "x", "y": "y"}, 4, ranges=ranges).collect()}
        assert (rows["x"].data_min, rows["x"].total_count, rows["x"].bins) == (None, 0, [])
        assert rows["y"].total_count == 2 and (rows["y"].bins[0].x0, rows["y"].bins[-1].x1) == (0.5, 1.5)


# --- sketches --------------------------------------------------------------------


@pytest.mark.parametrize("table, value", [("lineitem", "l_extendedprice"), ("lineitem", "l_discount"), ("events", "value"), ("orders", "exp(o_totalprice / 60000)")])
def test_sketch_ranks_are_within_the_bound(spark, table, value):
    df = given(spark, table).selectExpr(f"{value} AS v", "xxhash64(*) % 40 AS b")
    values = np.sort([r.v for r in df.collect()])
    row = merge_sketches(block_sketches(df, "b", {"v": "v"})).selectExpr("*", f"{quantiles_sql()} AS q").first()
    assert (row.candidates, row.n, row.low, row.high) == (values.size, values.size, values[0], values[-1])
    for p, q in zip(PROBS, row.q):
        low, high = np.searchsorted(values, q, "left") / values.size, np.searchsorted(values, q, "right") / values.size
        assert low <= p + 3 * rank_error() and high >= p - 3 * rank_error()


def test_sketches_keep_null_blocks_and_count_discards(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), (1, None), (1, 5.0), (2, float("inf"))], "b long, x double")
    states = block_sketches(df, "b", {"x": "x", "y": "2 * x"})
    assert {(r.block, r.id): (r.candidates, r.n) for r in states.collect()} == {
        (b, i): n for b, n in ((None, (2, 1)), (1, (2, 1)), (2, (1, 0))) for i in ("x", "y")
    }
    merged = {r.id: r for r in merge_sketches(states).selectExpr("*", f"{quantiles_sql((0.0, 1.0))} AS q", f"{bins_sql(4)} AS bins").collect()}
    assert (merged["x"].candidates, merged["x"].n, merged["x"].q) == (5, 2, [1.0, 5.0])
    assert sum(b["count"] for b in merged["y"].bins) == 2 and (merged["y"].bins[0].x0, merged["y"].bins[-1].x1) == (2.0, 10.0)
    nothing = merge_sketches(states.where("block = 2")).selectExpr(f"{quantiles_sql()} AS q", f"{bins_sql(4)} AS bins").first()
    assert (nothing.q, nothing.bins) == (None, [])


# --- draws -----------------------------------------------------------------------


def test_seeds_and_keys_give_different_draws(spark):
    keys = spark.range(0, 1 << 40, 1 << 22)  # a quarter of a million keys over 2^40
    means = []
    for seed in (0, 96, 97, 101, 103, 101 + 2**32, 101 + 2**64, 2**127 - 1):
        df = with_uniforms(keys, "id", seed, {"u": 0, "w": 1})
        row = df.agg(F.avg("u").alias("m"), F.var_samp("u").alias("v"), F.corr("u", "w").alias("c"), F.count_distinct("u").alias("n")).first()
        means.append(row.m)
        assert row.n == 1 << 18 and abs(row.m - 0.5) < 0.003 and abs(row.v - 1 / 12) < 0.001 and abs(row.c) < 0.01
    assert len(set(means)) == len(means)
    assert np.std(means) > 1e-4  # means of independent draws spread by about 0.00056
    near = with_uniforms(spark.range(1 << 16), "id", 5, {"u": 0})
    lagged = near.alias("a").join(near.alias("b"), F.expr("a.id = b.id + 1")).agg(F.corr("a.u", "b.u")).first()[0]
    assert abs(lagged) < 0.02
    with pytest.raises(ValueError):
        with_uniforms(keys, "id", -1, {"u": 0})


@pytest.mark.parametrize("key", ["id", None])
def test_distributions_of_draws(spark, key):
    variables = {"n": Normal(5.0, 2.0), "u": Uniform(-3.0, "3 + id * 0"), "d": Discrete((1.0, 4.0, 9.0), (0.2, 0.3, 0.5))}
    df = with_draws(spark.range(60_000), key, variables, 12)
    row = df.selectExpr("avg(n)", "stddev(n)", "min(u)", "max(u)", "avg(u)", "corr(n, u)", "avg(cast(d = 1 AS int))", "avg(cast(d = 4 AS int))", "avg(cast(d = 9 AS int))").first()
    assert [row[0], row[1], row[4], row[5]] == pytest.approx([5, 2, 0, 0], abs=0.04)
    assert -3 <= row[2] < -2.99 and 2.99 < row[3] <= 3
    assert list(row[6:]) == pytest.approx([0.2, 0.3, 0.5], abs=0.01)
    assert df.exceptAll(with_draws(spark.range(60_000), key, variables, 12)).count() == 0
