"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quincunx.functions import summary
from quincunx.functions.registered import register_functions
from quincunx.operators.fidelity import histogram_distance, quantile_error, result_digest, result_events
from quincunx.operators.groups import group_histograms, group_quantiles
from quincunx.operators.histogram import histogram, histogram_rows
from quincunx.operators.moments import (
    block_correlation,
    block_moments,
    column_moments,
    fold_moments,
    report_moments,
)
from quincunx.operators.quantiles import exact_quantiles, weighted_quantiles
from quincunx.operators.regression import linear_fit
from quincunx.operators.resampling import POISSON, bootstrap_intervals, interval_coverage
from quincunx.operators.sketch import block_sketches as sketch_blocks
from quincunx.operators.sketch import bin_error, merge_sketches, quantiles_sql, rank_error
from quincunx.plans.oracle import row_normal, row_uniform
from quincunx.plans.program import Discrete, Normal, Uniform, read_formula
from quincunx.plans.report import MODES, NoFiniteResult, report
from quincunx.sources import draws
from quincunx.sources.reports import flat_report, write_report
from quincunx.sources.stored import new_folder, stored
from quincunx.sources.tables import table, table_stream
from quincunx.streaming.progress import progress_events, read_progress, start_progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
BLOCK = 5_000
SEED = 101


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def _formula(text: str, df: DataFrame, keep: list[str], bind: dict[str, str]) -> DataFrame:
    return read_formula(text).evaluate(df, keep, bind)


# --- scalar expressions ------------------------------------------------------------


@query("""
SELECT l_orderkey, l_linenumber, round(2 * l_quantity + 3 * l_discount - 5 + .5, 6) AS linear,
       round(l_quantity * (l_tax + 1.25), 6) AS implied, round(l_quantity * l_discount, 6) AS product
FROM lineitem""")
def formula_linear(spark, folder):
    """Literals, sums, explicit and implicit products."""
    df = table(spark, folder, "lineitem")
    key = ["l_orderkey", "l_linenumber"]
    names = {"x": "l_quantity", "z": "l_discount", "w": "l_tax"}
    columns = list(names.values())
    df = _formula(r"2x+3z-5+.5", df, key + columns, names).withColumnRenamed("main", "linear")
    df = _formula(r"x{w+1.25}", df, [*key, *columns, "linear"], names).withColumnRenamed("main", "implied")
    df = _formula(r"x*z", df, [*key, "linear", "implied"], names).withColumnRenamed("main", "product")
    return df.selectExpr(*key, *[f"round({c}, 6) AS {c}" for c in ("linear", "implied", "product")])


@query("""
SELECT p_partkey, -(p_size * p_size)::DOUBLE AS neg_square, round(p_retailprice / 2 * p_size, 6) AS left_to_right,
       p_size::DOUBLE AS double_negative, round(p_retailprice * -p_size, 6) AS signed_factor
FROM part""")
def formula_precedence(spark, folder):
    """Power before sign, sign before product, products from left to right."""
    df = table(spark, folder, "part")
    names = {"a": "p_retailprice", "b": "p_size"}
    keep = ["p_partkey", "p_retailprice", "p_size"]
    for name, text in {
        "neg_square": "-b^2", "left_to_right": "a/2b", "double_negative": "{-{-b}}", "signed_factor": "a*-b",
    }.items():
        df = _formula(text, df, keep, names).withColumnRenamed("main", name)
        keep.append(name)
    return df.selectExpr(
        "p_partkey", "neg_square", "round(left_to_right, 6) AS left_to_right", "double_negative",
        "round(signed_factor, 6) AS signed_factor",
    )


@query("""
SELECT p_partkey,
       round((p_size * p_size + 3 * p_retailprice) / (2 + p_partkey % 4) + sqrt(p_size * p_size + 4), 6) AS rational
FROM part""")
def formula_rational(spark, folder):
    """Nested fraction and root."""
    df = table(spark, folder, "part").selectExpr("p_partkey", "p_size", "p_retailprice", "p_partkey % 4 AS w")
    text = r"\frac{x^2+3z}{2+w}+\sqrt{x^2+4}"
    df = _formula(text, df, ["p_partkey"], {"x": "p_size", "z": "p_retailprice", "w": "w"})
    return df.selectExpr("p_partkey", "round(main, 6) AS rational")


@query("""
SELECT c_custkey, round(pow(c_acctbal, -2), 12) AS inverse_square,
       CASE WHEN c_acctbal < 0 THEN NULL ELSE round(pow(c_acctbal, 0.5), 6) END AS root
FROM customer""")
def formula_power(spark, folder):
    """Signed and fractional exponents; a negative base with a fractional one is not finite."""
    df = table(spark, folder, "customer")
    df = _formula(r"x^-2", df, ["c_custkey", "c_acctbal"], {"x": "c_acctbal"}).withColumnRenamed("main", "a")
    df = _formula(r"x^+0.5", df, ["c_custkey", "a"], {"x": "c_acctbal"})
    return df.selectExpr(
        "c_custkey", "round(a, 12) AS inverse_square", "round(nullif(main, double('NaN')), 6) AS root"
    )


@query("""
WITH q AS (SELECT l_quantity / l_discount AS v, 1.0::DOUBLE / (l_quantity / l_discount) AS back FROM lineitem)
SELECT count(*) AS candidates, count(*) FILTER (WHERE isfinite(v)) AS count,
       count(*) FILTER (WHERE NOT isfinite(v)) AS discarded,
       round(avg(v) FILTER (WHERE isfinite(v)), 6) AS avg,
       count(*) FILTER (WHERE isfinite(back)) AS back_count,
       round(min(back) FILTER (WHERE isfinite(back)), 9) AS back_min
FROM q""")
def division_discards(spark, folder):
    """x/0 is discarded, yet 1/(x/0) is a valid zero."""
    df = table(spark, folder, "lineitem")
    names = {"x": "l_quantity", "z": "l_discount"}
    df = _formula(r"x/z", df, list(names.values()), names).withColumnRenamed("main", "v")
    df = _formula(r"\frac{1}{x/z}", df, ["v"], names)
    states = column_moments(df, {"v": "v", "back": "main"})
    return states.groupBy().agg(
        *[
            F.max(F.when(F.col("id") == i, F.expr(sql))).alias(name)
            for name, i, sql in (
                ("candidates", "v", "candidates"), ("count", "v", "n"), ("discarded", "v", "candidates - n"),
                ("avg", "v", "round(mean, 6)"), ("back_count", "back", "n"), ("back_min", "back", "round(low, 9)"),
            )
        ]
    )


@query("""
WITH q AS (SELECT CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END AS v FROM customer)
SELECT count(*) AS candidates, count(v) AS count, count(*) - count(v) AS discarded,
       round(count(v) / count(*), 12) AS valid_rate, round(1 - count(v) / count(*), 12) AS discard_rate,
       round(avg(v), 8) AS avg, round(min(v), 8) AS min, round(max(v), 8) AS max
FROM q""")
def sqrt_discards(spark, folder):
    """Roots of negative balances are discarded and accounted for."""
    df = _formula(r"\sqrt{x}", table(spark, folder, "customer"), [], {"x": "c_acctbal"})
    return report_moments(column_moments(df, {"main": "main"})).selectExpr(
        "candidates", "count", "discarded", "round(valid_rate, 12) AS valid_rate",
        "round(discard_rate, 12) AS discard_rate",
        "round(avg, 8) AS avg", "round(min, 8) AS min", "round(max, 8) AS max",
    )


_PM_SQL = """
WITH q AS (SELECT (p_retailprice + 2 * p_size) AS p, (p_retailprice - 2 * p_size) AS m FROM part),
b AS (SELECT 'plus' AS id, p AS v FROM q UNION ALL SELECT 'minus', m FROM q
      UNION ALL SELECT 'plus_minus_delta', p - m FROM q)
SELECT id, count(*) AS candidates, count(v) AS count, round(avg(v), 8) AS avg, round(min(v), 8) AS min,
       round(max(v), 8) AS max, round(var_samp(v), 6) AS var, round(stddev_samp(v), 6) AS std
FROM b GROUP BY id"""


def _pm_states(df: DataFrame) -> DataFrame:
    return column_moments(df, {"plus": "plus", "minus": "minus", "plus_minus_delta": _DELTA})


_DELTA = "if(abs(plus) < double('infinity') AND abs(minus) < double('infinity'), plus - minus, NULL)"


@query(_PM_SQL)
def branches_and_delta(spark, folder):
    """Both branches of one formula and their paired difference, from one pass."""
    df = _formula(r"x\pm2z", table(spark, folder, "part"), [], {"x": "p_retailprice", "z": "p_size"})
    return report_moments(_pm_states(df)).selectExpr(
        "id", "candidates", "count", "round(avg, 8) AS avg", "round(min, 8) AS min", "round(max, 8) AS max",
        "round(var, 6) AS var", "round(std, 6) AS std",
    )


@query("""
WITH q AS (SELECT sqrt(greatest(p_size - 10, 0)) AS r, p_size < 10 AS bad, p_retailprice - 950 AS z FROM part),
e AS (SELECT CASE WHEN NOT bad AND z <> 0 THEN (p_ + r) / z END AS p, CASE WHEN NOT bad AND z <> 0 THEN (p_ - r) / z END AS m
      FROM (SELECT r, bad, z, 1.0 AS p_ FROM q))
SELECT count(*) AS candidates, count(p) AS plus_count, count(m) AS minus_count, count(p - m) AS pair_count,
       round(avg(p - m), 9) AS delta_avg, round(avg(p), 9) AS plus_avg, round(avg(m), 9) AS minus_avg
FROM e""")
def fork_under_parent(spark, folder):
    r"""A fork inside a fraction: each branch drops its own non-finite rows, the pair drops both."""
    df = table(spark, folder, "part").selectExpr("p_size - 10 AS x", "p_retailprice - 950 AS z")
    states = _pm_states(_formula(r"\frac{1\pm\sqrt{x}}{z}", df, [], {"x": "x", "z": "z"}))
    pick = lambda i, sql: F.max(F.when(F.col("id") == i, F.expr(sql)))
    return states.groupBy().agg(
        F.max("candidates").alias("candidates"),
        pick("plus", "n").alias("plus_count"),
        pick("minus", "n").alias("minus_count"),
        pick("plus_minus_delta", "n").alias("pair_count"),
        pick("plus_minus_delta", "round(mean, 9)").alias("delta_avg"),
        pick("plus", "round(mean, 9)").alias("plus_avg"),
        pick("minus", "round(mean, 9)").alias("minus_avg"),
    )


# --- aggregations --------------------------------------------------------------------


@query("""
SELECT count(*) AS candidates, count(l_extendedprice) AS count, round(avg(l_extendedprice), 4) AS avg,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(var_samp(l_extendedprice), 1) AS var,
       round(stddev_samp(l_extendedprice), 5) AS std
FROM lineitem""")
def moments(spark, folder):
    states = column_moments(table(spark, folder, "lineitem"), {"price": "l_extendedprice"})
    return report_moments(states).selectExpr(
        "candidates", "count", "round(avg, 4) AS avg", "min", "max", "round(var, 1) AS var", "round(std, 5) AS std"
    )


@query("""
WITH s AS (SELECT avg(value) AS m, stddev_samp(value) / sqrt(count(*)) AS e FROM events)
SELECT round(e, 9) AS mcse, round(m - 1.96 * e, 8) AS ci95_low, round(m + 1.96 * e, 8) AS ci95_high,
       round(abs(e / m), 10) AS relative_mcse
FROM s""")
def mean_accuracy(spark, folder):
    """Monte Carlo standard error, its interval and its relative size."""
    return report_moments(column_moments(table(spark, folder, "events"), {"value": "value"})).selectExpr(
        "round(mcse, 9) AS mcse", "round(ci95[0], 8) AS ci95_low", "round(ci95[1], 8) AS ci95_high",
        "round(relative_mcse, 10) AS relative_mcse",
    )


@query("""
WITH c AS (SELECT 'quality' AS id, sum(quality)::BIGINT AS k, count(*) AS n FROM labels
           UNION ALL SELECT 'toxic', sum(toxic)::BIGINT, count(*) FROM labels),
p AS (SELECT id, k, n, k / n AS p, 1.96 * 1.96 AS zz FROM c),
w AS (SELECT id, k, n, (p + zz / (2 * n)) / (1 + zz / n) AS mid,
      1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n) AS half FROM p)
SELECT id, k AS successes, n AS trials, round(greatest(0, mid - half), 10) AS low, round(least(1, mid + half), 10) AS high
FROM w""")
def wilson_interval(spark, folder):
    counts = table(spark, folder, "labels").agg(
        F.expr("array(named_struct('id', 'quality', 'k', sum(quality), 'n', count(*)), "
               "named_struct('id', 'toxic', 'k', sum(toxic), 'n', count(*)))").alias("c")
    ).selectExpr("inline(c)")
    return counts.selectExpr("id", "k", "n", f"{summary.wilson('k', 'n')} AS w").selectExpr(
        "id", "k AS successes", "n AS trials", "round(w[0], 10) AS low", "round(w[1], 10) AS high"
    )


@query("""
SELECT o_orderkey // 5000 AS block, count(*) AS n, round(avg(o_totalprice), 7) AS mean,
       round(var_pop(o_totalprice) * count(*) / 1e9, 3) AS m2_e9, min(o_totalprice) AS low, max(o_totalprice) AS high
FROM orders GROUP BY 1""")
def block_states(spark, folder):
    """Moment state of every logical block."""
    df = table(spark, folder, "orders")
    return block_moments(df, f"o_orderkey div {BLOCK}", {"price": "o_totalprice"}).selectExpr(
        "block", "n", "round(mean, 7) AS mean", "round(m2 / 1e9D, 3) AS m2_e9", "low", "high"
    )


@query("""
SELECT count(*) AS count, round(avg(o_totalprice), 7) AS avg, round(var_samp(o_totalprice) / 1e6, 4) AS var_e6,
       min(o_totalprice) AS min, max(o_totalprice) AS max
FROM orders""")
def ordered_merge(spark, folder):
    """Block states merged in block order."""
    df = table(spark, folder, "orders")
    states = block_moments(df, "o_orderkey div 500", {"price": "o_totalprice"})
    return report_moments(fold_moments(states)).selectExpr(
        "count", "round(avg, 7) AS avg", "round(var / 1e6D, 4) AS var_e6", "min", "max"
    )


@query("""
SELECT count(*) AS count, round(avg(o_totalprice), 7) AS avg, round(var_samp(o_totalprice) / 1e6, 4) AS var_e6,
       min(o_totalprice) AS min, max(o_totalprice) AS max
FROM orders""")
def ordered_merge_sparse(spark, folder):
    """The same over block numbers that are far apart, on both sides of zero, and partly missing."""
    df = table(spark, folder, "orders").withColumn("b", F.expr(
        "if(o_orderkey % 1000 < 500, (o_orderkey div 500 - 7) * 1000000007L, if(o_orderkey % 7 = 0, NULL, -o_orderkey))"
    ))
    states = fold_moments(block_moments(df, "b", {"price": "o_totalprice"}))
    return report_moments(states).selectExpr(
        "count", "round(avg, 7) AS avg", "round(var / 1e6D, 4) AS var_e6", "min", "max"
    )


@query("""
WITH r AS (SELECT o_orderkey // 2000 AS t, corr(o_totalprice + o_custkey * 50, o_totalprice - o_custkey * 50) AS c
           FROM orders GROUP BY o_orderkey // 500, 1),
c AS (SELECT t, avg(c) AS c FROM r GROUP BY 1)
SELECT 'task_' || lpad((o_orderkey // 2000)::VARCHAR, 9, '0') AS task, count(*) AS count,
       round(avg(o_totalprice), 7) AS avg, round(var_samp(o_totalprice) / 1e6, 4) AS var_e6,
       round(any_value(c.c), 9) AS correlation
FROM orders JOIN c ON c.t = o_orderkey // 2000 GROUP BY 1""")
def task_merge(spark, folder):
    """Blocks of 500 rows merged, in order, into tasks of four blocks, with their correlation."""
    df = table(spark, folder, "orders")
    name = F.expr("concat('task_', lpad(cast(block div 4 AS string), 9, '0'))")
    tasks = block_moments(df, "o_orderkey div 500", {"price": "o_totalprice"}).withColumn("id", name)
    merged = report_moments(fold_moments(tasks)).selectExpr(
        "id AS task", "count", "round(avg, 7) AS avg", "round(var / 1e6D, 4) AS var_e6"
    )
    pairs = _formula(r"x\pm50z", df, ["o_orderkey"], {"x": "o_totalprice", "z": "o_custkey"})
    pairs = pairs.withColumn("block", F.expr("o_orderkey div 500")).withColumn("task", name)
    correlation = block_correlation(pairs, "block", "plus", "minus", "task")
    return merged.join(correlation, "task").selectExpr(
        "task", "count", "avg", "var_e6", "round(correlation_plus_minus_mean, 9) AS correlation"
    )


@query("""
WITH r AS (SELECT corr(o_totalprice + o_custkey * 50, o_totalprice - o_custkey * 50) AS c
           FROM orders GROUP BY o_orderkey // 500)
SELECT round(avg(c), 9) AS correlation_plus_minus_mean, count(c) AS blocks FROM r""")
def paired_correlation(spark, folder):
    """Unweighted mean of the correlation of both branches within each block."""
    df = table(spark, folder, "orders")
    pairs = _formula(r"x\pm50z", df, ["o_orderkey"], {"x": "o_totalprice", "z": "o_custkey"})
    return block_correlation(pairs, "o_orderkey div 500", "plus", "minus").selectExpr(
        "round(correlation_plus_minus_mean, 9) AS correlation_plus_minus_mean", "blocks"
    )


_QUANTILES_SQL = """
SELECT 'value' AS id, round(quantile_cont(value, 0.05), 8) AS p05, round(quantile_cont(value, 0.5), 8) AS p50,
       round(quantile_cont(value, 0.95), 8) AS p95
FROM events"""


def _rounded_quantiles(df: DataFrame) -> DataFrame:
    return df.selectExpr("id", *[f"round({q}, 8) AS {q}" for q in ("p05", "p50", "p95")])


@query(_QUANTILES_SQL)
def quantiles_exact(spark, folder):
    return _rounded_quantiles(exact_quantiles(table(spark, folder, "events"), {"value": "value"}))


@query("""
SELECT 'price' AS id, round(quantile_cont(l_extendedprice, 0.05), 8) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 8) AS p50, round(quantile_cont(l_extendedprice, 0.95), 8) AS p95
FROM lineitem
UNION ALL
SELECT 'discount', round(quantile_cont(l_discount, 0.05), 8), round(quantile_cont(l_discount, 0.5), 8),
       round(quantile_cont(l_discount, 0.95), 8)
FROM lineitem""")
def quantiles_narrowed(spark, folder):
    """The same result by narrowing, which never sorts more than ``small`` values."""
    df = table(spark, folder, "lineitem")
    return _rounded_quantiles(
        exact_quantiles(df, {"price": "l_extendedprice", "discount": "l_discount"}, small=2_000)
    )


@query("""
WITH p AS (SELECT l_discount AS c, sum(l_linenumber) AS w FROM lineitem GROUP BY 1),
r AS (SELECT c, w, sum(w) OVER (ORDER BY c) / sum(w) OVER () AS cdf FROM p)
SELECT q AS probability, min(c) AS value
FROM r, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS t(q) WHERE cdf >= q GROUP BY q""")
def weighted_quantile_step(spark, folder):
    """Few distinct centers: the quantile is a step function."""
    return weighted_quantiles(table(spark, folder, "lineitem"), "l_discount", "l_linenumber", method="step")


@query("""
WITH p AS (SELECT l_extendedprice AS c, sum(l_quantity) AS w FROM lineitem GROUP BY 1),
r AS (SELECT c, (sum(w) OVER (ORDER BY c) - 0.5 * w) / sum(w) OVER () AS f FROM p),
n AS (SELECT c, f, lead(c) OVER (ORDER BY c) AS c2, lead(f) OVER (ORDER BY c) AS f2 FROM r)
SELECT q AS probability, round(c + (c2 - c) * (q - f) / (f2 - f), 6) AS value
FROM n, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS t(q) WHERE f <= q AND q < f2""")
def weighted_quantile_interpolated(spark, folder):
    """Many centers: linear interpolation between mid-weights."""
    df = weighted_quantiles(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", small=20_000)
    return df.selectExpr("probability", "round(value, 6) AS value")


def _histogram_sql(table_name: str, column: str, bins: int, name: str = "value") -> str:
    return f"""
SELECT '{name}' AS id, e.k AS bin, round(e.x0, 9) AS x0, round(e.x1, 9) AS x1, coalesce(c.n, 0)::BIGINT AS count
FROM (SELECT k, lo + k * w AS x0, CASE WHEN k = {bins} - 1 THEN hi ELSE lo + (k + 1) * w END AS x1
      FROM (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, (max({column}) - min({column})) / {bins}.0 AS w
            FROM {table_name}), (SELECT unnest(range({bins})) AS k)) e
LEFT JOIN (SELECT least(k0, {bins} - 1) AS k, count(*) AS n
           FROM (SELECT CASE WHEN v < lo + g * w THEN g - 1 WHEN v >= lo + (g + 1) * w THEN g + 1 ELSE g END AS k0
                 FROM (SELECT v, lo, w, floor((v - lo) / w)::BIGINT AS g
                       FROM (SELECT {column} AS v FROM {table_name}),
                            (SELECT min({column})::DOUBLE AS lo, (max({column}) - min({column})) / {bins}.0 AS w
                             FROM {table_name}))) GROUP BY 1) c ON c.k = e.k"""


@query(_histogram_sql("events", "value", 30))
def histogram_bins(spark, folder):
    rows = histogram_rows(histogram(table(spark, folder, "events"), {"value": "value"}, 30))
    return rows.selectExpr("id", "cast(bin AS bigint) AS bin", "round(x0, 9) AS x0", "round(x1, 9) AS x1", "count")


@query("""
SELECT k AS bin, round(1.5 + k / 8.0, 9) AS x0, round(1.5 + (k + 1) / 8.0, 9) AS x1,
       CASE WHEN k = 4 THEN (SELECT count(*) FROM orders) ELSE 0 END AS count
FROM (SELECT unnest(range(8)) AS k)""")
def histogram_constant(spark, folder):
    """A single observed value gets padded edges."""
    df = table(spark, folder, "orders")
    return histogram_rows(histogram(df, {"v": "if(o_totalprice IS NULL, NULL, 2D)"}, 8)).selectExpr(
        "cast(bin AS bigint) AS bin", "round(x0, 9) AS x0", "round(x1, 9) AS x1", "count"
    )


@query("""
WITH v AS (SELECT l_extendedprice AS v, (l_quantity * (l_linenumber % 3))::BIGINT AS w FROM lineitem),
e AS (SELECT min(v)::DOUBLE AS lo, (max(v) - min(v)) / 12.0 AS width FROM v),
g AS (SELECT v, w, lo, width, least(floor((v - lo) / width)::BIGINT, 11) AS g FROM v, e)
SELECT CASE WHEN v < g * width + lo THEN g - 1 WHEN g < 11 AND v >= (g + 1) * width + lo THEN g + 1 ELSE g END AS bin,
       sum(w)::BIGINT AS weight FROM g GROUP BY 1""")
def histogram_weighted(spark, folder):
    """Weights instead of counts in every bin."""
    df = table(spark, folder, "lineitem")
    weight = "cast(l_quantity * (l_linenumber % 3) AS bigint)"
    rows = histogram_rows(histogram(df, {"price": "l_extendedprice"}, 12, weight))
    return rows.selectExpr("cast(bin AS bigint) AS bin", "count AS weight")


_SLACK = 3  # a sketch's bound holds for 99 of 100 ranks; several times it, for all that are compared


def _rank_checks(values: str, group: str) -> str:
    """SQL: per group count, extremes, and that quantiles exist; the ranks are checked in Spark's row."""
    return f"""SELECT {group} AS block, count(*) AS candidates, count(v) AS n, round(min(v), 8) AS low, round(max(v), 8) AS high,
       true AS p05_in_bound, true AS p50_in_bound, true AS p95_in_bound FROM ({values}) GROUP BY 1"""


def _in_bound(df: DataFrame, states: DataFrame, block: str, value: str) -> DataFrame:
    """Exact ranks of a state's quantiles: whether each is within the sketch's bound."""
    points = states.selectExpr("block", "n", f"{quantiles_sql()} AS q")
    ranked = df.selectExpr(f"{block} AS block", f"{value} AS v").join(points, "block")
    share = lambda k, op: f"count_if(v {op} q[{k}]) / max(n)"
    off = _SLACK * rank_error()
    checks = [
        f"({share(k, '<')} <= {p + off} AND {share(k, '<=')} >= {p - off}) AS {name}_in_bound"
        for k, (p, name) in enumerate(((0.05, "p05"), (0.5, "p50"), (0.95, "p95")))
    ]
    return ranked.groupBy("block").agg(*[F.expr(c) for c in checks])


_ROOTS = "SELECT event_id // 2500 AS b, CASE WHEN value >= 5 THEN sqrt(value - 5) END AS v FROM events"


@query(_rank_checks(_ROOTS, "b"))
def block_sketches(spark, folder):
    """A sketch per block of 2500 events: exact counts and extremes, quantiles within the bound."""
    df = table(spark, folder, "events")
    block, value = "event_id div 2500", "nullif(sqrt(value - 5), double('NaN'))"
    states = sketch_blocks(df, block, {"root": value})
    return states.join(_in_bound(df, states, block, value), "block").selectExpr(
        "block", "candidates", "n", "round(low, 8) AS low", "round(high, 8) AS high", "p05_in_bound", "p50_in_bound", "p95_in_bound"
    )


@query("""
SELECT id, candidates, n, low, high, true AS p05_in_bound, true AS p50_in_bound, true AS p95_in_bound FROM (
    SELECT 'price' AS id, count(*) AS candidates, count(l_extendedprice) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high
    FROM lineitem
    UNION ALL SELECT 'ratio', count(*), count(*) FILTER (WHERE l_discount <> 0), min(l_quantity / l_discount) FILTER (WHERE l_discount <> 0),
           max(l_quantity / l_discount) FILTER (WHERE l_discount <> 0) FROM lineitem)""")
def sketch_quantiles(spark, folder):
    """Block sketches of two measures merged; blocks are orders, a part of them without a number."""
    df = table(spark, folder, "lineitem").selectExpr(
        "if(l_orderkey % 5 = 0, NULL, l_orderkey div 100) AS b", "l_extendedprice AS price", "try_divide(l_quantity, l_discount) AS ratio"
    )
    merged = merge_sketches(sketch_blocks(df, "b", {"price": "price", "ratio": "ratio"}))
    checks = None
    for name in ("price", "ratio"):
        own = merged.where(F.col("id") == name).withColumn("block", F.lit(1))
        found = _in_bound(df.where(f"{name} IS NOT NULL"), own, "1", name).withColumn("id", F.lit(name))
        checks = found if checks is None else checks.unionByName(found)
    return merged.join(checks, "id").select("id", "candidates", "n", "low", "high", "p05_in_bound", "p50_in_bound", "p95_in_bound")


@query("""
SELECT 'value' AS id, round(100 * sum(abs(coalesce(a.count, 0) - coalesce(b.count, 0))) / (2 * sum(coalesce(a.count, 0))), 8)
       AS tv_distance_pct
FROM (""" + _histogram_sql("events", "value", 30) + ") a FULL JOIN (" + _histogram_sql(
    "(SELECT round(value, 0) AS value FROM events)", "value", 30) + ") b ON a.bin = b.bin")
def histogram_fidelity(spark, folder):
    """Total-variation distance between the histograms of exact and of rounded values."""
    df = table(spark, folder, "events")
    a, b = ({"value": "value"}, {"value": "round(value, 0)"})
    return histogram_distance(histogram_rows(histogram(df, a)), histogram_rows(histogram(df, b))).selectExpr(
        "id", "round(tv_distance_pct, 8) AS tv_distance_pct"
    )


@query("""
SELECT 'value' AS id, round(max(100 * abs(quantile_b - quantile_a) / abs(quantile_a)), 8) AS quantile_error_pct
FROM (SELECT unnest(quantile_cont(value, [0.05, 0.5, 0.95])) AS quantile_a,
             unnest(quantile_cont(round(value, 0), [0.05, 0.5, 0.95])) AS quantile_b FROM events)""")
def quantile_fidelity(spark, folder):
    """Largest relative quantile error of rounded values."""
    df = table(spark, folder, "events")
    a = exact_quantiles(df, {"value": "value"})
    b = exact_quantiles(df, {"value": "round(value, 0)"})
    return quantile_error(a, b).selectExpr("id", "round(quantile_error_pct, 8) AS quantile_error_pct")


@query("""
SELECT '{"type":"complete","id":"balance","candidates":' || count(*) || ',"count":' || count(*) FILTER (WHERE c_acctbal >= 0)
       || ',"discarded":' || count(*) FILTER (WHERE NOT c_acctbal >= 0) || '}' AS value
FROM customer""")
def json_events(spark, folder):
    """Result rows as JSON events."""
    states = column_moments(table(spark, folder, "customer"), {"balance": "sqrt(c_acctbal)"})
    return result_events(states.selectExpr("id", "candidates", "n AS count", "candidates - n AS discarded"))


# --- streaming -------------------------------------------------------------------------


_FILES = 4  # of each range of a streamed table


def _streamed(spark: SparkSession, folder: str, value: str) -> tuple[DataFrame, int]:
    """Progress of a stream over the events, in four ranges of their ids, one per batch.

    Every range is written as the same number of files, by as many tasks, and every batch
    takes the files of one range.
    """
    where = new_folder(spark)
    events = table(spark, folder, "events")
    low, high, n = events.agg(F.min("event_id"), F.max("event_id"), F.count("*")).first()
    part = F.expr(f"least(3, (event_id - {low}) * 4 div greatest(1, {high} - {low} + 1))")
    for k in range(4):
        events.where(part == k).repartition(_FILES, "event_id").write.mode("append").parquet(f"{where}/events.parquet")
    start_progress(table_stream(spark, where, "events", _FILES), {"value": value}, where).awaitTermination()
    return read_progress(spark, where, n), n


_PARTS = """p AS (SELECT *, least(3, (event_id - lo) * 4 // greatest(1, hi - lo + 1)) AS part
      FROM events, (SELECT min(event_id) AS lo, max(event_id) AS hi FROM events)),
k AS (SELECT unnest(range(4)) AS batch)"""
_ROOT = "CASE WHEN value >= 5 THEN sqrt(value - 5) END"


@query(f"""
WITH q AS (SELECT {_ROOT} AS v FROM events)
SELECT 'value' AS id, count(*) AS candidates, count(v) AS count, round(avg(v), 8) AS avg, round(var_samp(v), 8) AS var,
       round(min(v), 8) AS min, round(max(v), 8) AS max, 1.0::DOUBLE AS progress
FROM q""")
def stream_progress(spark, folder):
    """State after the last of several micro-batches of a stream over the events."""
    rows, _ = _streamed(spark, folder, "sqrt(value - 5)")
    last = rows.groupBy("id").agg(F.expr("max_by(struct(total, progress), batch)").alias("s"))
    states = last.selectExpr("id", "s.total.*", "s.progress")
    return report_moments(states, "progress").selectExpr(
        "id", "candidates", "count", "round(avg, 8) AS avg", "round(var, 8) AS var", "round(min, 8) AS min",
        "round(max, 8) AS max", "progress",
    )


@query(f"""
WITH {_PARTS}
SELECT batch, 'value' AS id, count(*) AS processed, count(*) FILTER (WHERE part = batch) AS in_batch, round(avg(v), 8) AS avg,
       round(var_samp(v), 8) AS var, round(min(v), 8) AS min, round(max(v), 8) AS max,
       round(count(*) / (SELECT count(*) FROM events), 9) AS progress
FROM (SELECT *, {_ROOT} AS v FROM p) JOIN k ON part <= batch GROUP BY batch""")
def checked_progress(spark, folder):
    """The batch and the total after every micro-batch."""
    rows, _ = _streamed(spark, folder, "sqrt(value - 5)")
    return rows.selectExpr(
        "batch", "id", "total.candidates AS processed", "batch_state.candidates AS in_batch",
        "round(total.mean, 8) AS avg", f"round({summary.variance('total.n', 'total.m2')}, 8) AS var",
        "round(total.low, 8) AS min", "round(total.high, 8) AS max", "round(progress, 9) AS progress",
    )


@query(f"""
WITH {_PARTS},
e AS (SELECT batch, count(*) AS processed, count(v) AS valid, round(stddev_samp(v) / sqrt(count(v)), 10) AS mcse
      FROM (SELECT *, {_ROOT} AS v FROM p) JOIN k ON part <= batch GROUP BY batch),
n AS (SELECT count(*) AS total FROM events)
SELECT 'start' AS type, NULL::BIGINT AS batch, NULL::BIGINT AS processed, NULL::BIGINT AS valid, NULL::BIGINT AS discarded,
       total, NULL::DOUBLE AS mcse, NULL::BOOLEAN AS quantiles_in_order, NULL::BIGINT AS histogram_total, NULL::BIGINT AS bins_in_bound FROM n
UNION ALL SELECT 'batch', batch, processed, valid, processed - valid, total, mcse, true, valid, 30 FROM e, n
UNION ALL SELECT 'complete', NULL, processed, valid, processed - valid, total, mcse, true, valid, 30 FROM e, n WHERE batch = 3""")
def checked_events(spark, folder):
    """The JSON event log of a stream, read back: each of an event's 30 bins is held against the
    exact count of the rows so far between its edges."""
    log = progress_events(*_streamed(spark, folder, "sqrt(value - 5)"))
    fields = (
        "type string, batch_index long, processed_iterations long, valid_results long, discarded_results long, "
        "total_iterations long, p05 double, p50 double, p95 double, diagnostics struct<mcse_mean:double>, "
        "histogram struct<bins:array<struct<x0:double,x1:double,count:bigint>>>"
    )
    log = log.select("batch", F.expr(f"from_json(value, '{fields}') AS e"))
    events = table(spark, folder, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    roots = events.selectExpr(
        f"least(3, (event_id - {low}) * 4 div greatest(1, {high} - {low} + 1)) AS part", "sqrt(value - 5) AS v"
    ).where("NOT isnan(v)")
    edges = log.where("e.type <> 'start'").selectExpr(
        "batch", "least(3, batch) AS upto", "e.valid_results AS n", "transform(e.histogram.bins, b -> b.x0) AS x0", "e.histogram.bins.count AS counts"
    )
    # Five events: a bin is the number of edges at or below a value.
    placed = roots.join(F.broadcast(edges.select("batch", "upto", "x0")), F.col("part") <= F.col("upto"))
    exact = placed.selectExpr("batch", "greatest(1, size(filter(x0, x -> x <= v))) - 1 AS bin").groupBy("batch", "bin").count()
    exact = exact.groupBy("batch").agg(F.expr("map_from_entries(collect_list(struct(bin, count))) AS held"))
    off = _SLACK * bin_error()
    bounds = edges.join(exact, "batch").selectExpr(
        "batch", f"size(filter(transform(counts, (c, k) -> abs(c - coalesce(try_element_at(held, k), 0L)) <= {off}D * n), x -> x)) AS good"
    )
    return log.join(bounds, "batch", "left").selectExpr(
        "e.type AS type", "e.batch_index AS batch", "e.processed_iterations AS processed", "e.valid_results AS valid",
        "e.discarded_results AS discarded", "e.total_iterations AS total", "round(e.diagnostics.mcse_mean, 10) AS mcse",
        "e.p05 <= e.p50 AND e.p50 <= e.p95 AS quantiles_in_order",
        "aggregate(e.histogram.bins.count, 0L, (a, c) -> a + c) AS histogram_total", "cast(good AS bigint) AS bins_in_bound",
    )


@query("""
SELECT 'value' AS id, count(*) AS candidates, count(*) AS count, round(avg(value), 6) AS avg, round(var_samp(value), 4) AS var,
       min(value) AS min, max(value) AS max, true AS quantiles_in_bound
FROM events""")
def checked_streamed_end(spark, folder):
    """The end of a stream equals the batch report of the same rows, quantiles within the sketch's bound."""
    rows, n = _streamed(spark, folder, "value")
    last = rows.orderBy(F.col("batch").desc()).limit(1)
    state = last.selectExpr("id", "total.*", f"{quantiles_sql(n='total.n')} AS q")
    ranks = table(spark, folder, "events").crossJoin(F.broadcast(state.select("q"))).agg(*[
        F.expr(f"count_if(value <= q[{k}]) / {n} BETWEEN {p - _SLACK * rank_error()} AND {p + _SLACK * rank_error()}").alias(f"in{k}")
        for k, p in enumerate((0.05, 0.5, 0.95))
    ]).selectExpr("in0 AND in1 AND in2 AS quantiles_in_bound")
    end = report_moments(state).selectExpr(
        "id", "candidates", "count", "round(avg, 6) AS avg", "round(var, 4) AS var", "min", "max"
    )
    return end.crossJoin(F.broadcast(ranks))  # one row each


# --- draws attached to table rows ---------------------------------------------------------


@query(f"""SELECT o_orderkey, {row_uniform('o_orderkey', 0, SEED)} AS u, 2 + 3 * {row_uniform('o_orderkey', 0, SEED)} AS scaled
FROM orders""")
def uniform_draws(spark, folder):
    """One uniform per order, a function of seed and key alone."""
    df = table(spark, folder, "orders").select("o_orderkey")
    df = draws.with_draws(df, "o_orderkey", {"u": Uniform(0.0, 1.0)}, SEED)
    return df.selectExpr("o_orderkey", "u", "2 + 3 * u AS scaled")


@query(f"""SELECT o_orderkey, round(10 + 2 * {row_normal('o_orderkey', 0, SEED)}, 9) AS x FROM orders""")
def normal_draws(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey")
    df = draws.with_draws(df, "o_orderkey", {"x": Normal(10.0, 2.0)}, SEED)
    return df.selectExpr("o_orderkey", "round(x, 9) AS x")


@query(f"""WITH u AS (SELECT {row_uniform('o_orderkey', 0, SEED)} AS u FROM orders)
SELECT CASE WHEN u < 0.5 THEN 10.0::DOUBLE WHEN u < 0.8 THEN 15.0 ELSE 20.0 END AS value, count(*) AS count FROM u GROUP BY 1""")
def discrete_draws(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey")
    df = draws.with_draws(df, "o_orderkey", {"value": Discrete((10.0, 15.0, 20.0), (0.5, 0.3, 0.2))}, SEED)
    return df.groupBy("value").agg(F.count("*").alias("count"))


@query(f"""WITH d AS (SELECT l_extendedprice * (1 + l_discount / 2 * ({row_normal('l_orderkey * 8 + l_linenumber', 0, SEED)})) AS x,
                  0.9 + 0.2 * {row_uniform('l_orderkey * 8 + l_linenumber', 1, SEED)} AS z FROM lineitem),
b AS (SELECT 'plus' AS id, x + x * (z - 1) AS v FROM d UNION ALL SELECT 'minus', x - x * (z - 1) FROM d
      UNION ALL SELECT 'plus_minus_delta', 2 * x * (z - 1) FROM d)
SELECT id, count(*) AS count, round(avg(v), 4) AS avg, round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min,
       round(max(v), 4) AS max
FROM b GROUP BY id""")
def row_level_simulation(spark, folder):
    r"""Each line item draws its own price and factor; the spread comes from its columns."""
    df = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS k", "l_extendedprice", "l_discount"
    )
    variables = {"x": Normal(F.col("l_extendedprice"), F.expr("l_extendedprice * l_discount / 2")), "z": Uniform(0.9, 1.1)}
    df = draws.with_draws(df, "k", variables, SEED)
    df = _formula(r"x\pm x{z-1}", df, [], {"x": "x", "z": "z"})
    return report_moments(_pm_states(df)).selectExpr(
        "id", "count", "round(avg, 4) AS avg", "round(std, 4) AS std", "round(min, 4) AS min", "round(max, 4) AS max"
    )


# --- models over table rows ----------------------------------------------------------------

_SHOWN = ("avg", "std", "min", "max", "p05", "p50", "p95")


def _shown(rows: DataFrame) -> DataFrame:
    known = {
        "avg": "stats.avg", "std": "diagnostics.sample_stddev", "min": "diagnostics.sample_min",
        "max": "diagnostics.sample_max", "p05": "stats.p05", "p50": "stats.p50", "p95": "stats.p95",
    }
    return rows.selectExpr(
        "id", "candidate_results AS candidates", "valid_results AS count", "discarded_results AS discarded",
        *[f"round({known[name]}, 4) AS {name}" for name in _SHOWN],
    )


def _model_sql(values: str) -> str:
    """SQL for a report over ``values``, a query giving (id, v) with NULL for discarded rows."""
    quantiles = ", ".join(f"round(quantile_cont(v, {p}), 4) AS {q}" for p, q in ((0.05, "p05"), (0.5, "p50"), (0.95, "p95")))
    return f"""WITH m AS ({values})
SELECT id, count(*) AS candidates, count(v) AS count, count(*) - count(v) AS discarded, round(avg(v), 4) AS avg,
       round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max, {quantiles}
FROM m GROUP BY id"""


def _main(value: str, source: str) -> str:
    return f"SELECT 'main' AS id, {value} AS v FROM {source}"


def _fork(plus: str, minus: str, source: str) -> str:
    return f"SELECT unnest(['plus', 'minus', 'plus_minus_delta']) AS id, unnest([p, m, p - m]) AS v FROM (SELECT {plus} AS p, {minus} AS m FROM {source})"


def _model(name: str, source: str, key: str, text: str, values: str, **bind) -> None:
    """Registers the report of a model with one iteration per row of ``source``; bound variables
    are columns, or distributions over columns."""

    def run(spark, folder):
        return _shown(report(table(spark, folder, source), key, text, SEED, bind))

    run.__name__ = name
    query(_model_sql(values))(run)


_ALL = r"\iter{1}\response{avg,var,min,max,count,p05,p50,p95}"
_O, _L, _C, _E, _P, _S = (
    "o_orderkey", "l_orderkey * 8 + l_linenumber", "c_custkey", "event_id", "p_partkey", "s_suppkey"
)


def _u(key: str, position: int) -> str:
    return row_uniform(key, position, SEED)


def _discrete(key: str, position: int, a: float, b: float, c: float) -> str:
    return f"list_transform([{_u(key, position)}], lambda u: CASE WHEN u < 0.5 THEN {a}::DOUBLE WHEN u < 0.8 THEN {b}::DOUBLE ELSE {c}::DOUBLE END)[1]"


_model(
    "program_normal_mean", "lineitem", _L, r"\model{y=x}\normal x{0,1}" + _ALL,
    _main(f"l_extendedprice + l_quantity * ({row_normal(_L, 0, SEED)})", "lineitem"),
    x=Normal("l_extendedprice", "l_quantity"),
)
_model(
    "program_uniform_mean", "orders", _O, r"\model{y=x}\uniform x{0,1}" + _ALL,
    _main(f"o_totalprice * {_u(_O, 0)}", "orders"), x=Uniform(0.0, "o_totalprice"),
)
_model(
    "program_discrete_mean", "events", _E, r"\model{y=d v}\distrib d{{10,0.5},{20,0.3},{30,0.2}}\normal v{0,1}" + _ALL,
    _main(f"{_discrete(_E, 0, 10, 20, 30)} * value", "events"), v="value",
)
_model(
    "program_linear_combination", "lineitem", _L, r"\model{y=2x+3z}\normal x{0,1}\uniform z{0,6}" + _ALL,
    _main(f"2 * l_quantity + 3 * (6 * {_u(_L, 0)})", "lineitem"), x="l_quantity",
)
_model(
    "program_paired_branches", "part", _P, r"\model{y=x\pm2z}\normal x{0,1}\uniform z{0,1}" + _ALL,
    _fork(f"p_retailprice + 2 * (p_size * {_u(_P, 0)})", f"p_retailprice - 2 * (p_size * {_u(_P, 0)})", "part"),
    x="p_retailprice", z=Uniform(0.0, "p_size"),
)
_model(
    "program_heavy_expression", "customer", _C,
    r"\model{y=\sqrt{x^2+z^2}+\frac{x z}{2}+3x-2z}\normal x{0,1}\uniform z{-3,3}" + _ALL,
    _main("sqrt(x * x + z * z) + x * z / 2 + 3 * x - 2 * z",
          f"(SELECT c_acctbal / 1000 AS x, -3 + 6 * {_u(_C, 0)} AS z FROM customer)"), x="c_acctbal / 1000",
)
_model(
    "program_quadratic_roots", "supplier", _S,
    r"\model{y=\frac{-b\pm\sqrt{b^2-4a c}}{2a}}\normal a{10,0.5}\distrib b{{10,0.5},{15,0.3},{20,0.2}}\normal c{0,1}" + _ALL,
    _fork("CASE WHEN d >= 0 THEN (-b + sqrt(d)) / (2 * a) END", "CASE WHEN d >= 0 THEN (-b - sqrt(d)) / (2 * a) END",
          f"""(SELECT *, b * b - 4 * a * c AS d FROM (SELECT 10 + 0.5 * ({row_normal(_S, 0, SEED)}) AS a,
              {_discrete(_S, 1, 10, 15, 20)} AS b, s_acctbal / 200 AS c FROM supplier))"""), c="s_acctbal / 200",
)
_model(
    "program_uniform_branches", "orders", _O, r"\model{y=x\pm2z}\uniform x{4,16}\normal z{0,1}" + _ALL,
    _fork("x + 2 * z", "x - 2 * z", f"(SELECT 4 + 12 * {_u(_O, 0)} AS x, o_totalprice / 10000 AS z FROM orders)"),
    z="o_totalprice / 10000",
)
_model(
    "program_uniform_rational", "part", _P,
    r"\model{y=\frac{x^2+3z}{2+w}+\sqrt{x^2+4}}\uniform x{-1,5}\normal z{0,1}\distrib w{{1,0.5},{2,0.3},{4,0.2}}" + _ALL,
    _main("(x * x + 3 * z) / (2 + w) + sqrt(x * x + 4)",
          f"(SELECT -1 + 6 * {_u(_P, 0)} AS x, p_retailprice AS z, {_discrete(_P, 1, 1, 2, 4)} AS w FROM part)"),
    z="p_retailprice",
)
_model(
    "program_partial_root", "customer", _C, r"\model{y=\sqrt{x+z}}\normal x{0,1}\uniform z{-500,500}" + _ALL,
    _main("CASE WHEN x >= 0 THEN sqrt(x) END", f"(SELECT c_acctbal + (-500 + 1000 * {_u(_C, 0)}) AS x FROM customer)"),
    x="c_acctbal",
)
_model(
    "program_retain_all", "lineitem", _L, r"\model{y=x\pm z^2}\normal x{0,1}\uniform z{0,100}" + _ALL,
    _fork("x + z * z", "x - z * z", f"(SELECT l_extendedprice AS x, 100 * {_u(_L, 0)} AS z FROM lineitem)"), x="l_extendedprice",
)
_model(
    "checked_uniform", "lineitem", _L, r"\model{y=x}\uniform x{0,1}" + _ALL,
    _main(f"-l_quantity + (l_extendedprice - -l_quantity) * {_u(_L, 0)}", "lineitem"),
    x=Uniform("-l_quantity", "l_extendedprice"),
)
_model(
    "checked_discrete", "orders", _O, r"\model{y=d+x}\distrib d{{10,0.5},{20,0.3},{30,0.2}}\normal x{0,1}" + _ALL,
    _main(f"{_discrete(_O, 0, 10, 20, 30)} + o_totalprice", "orders"), x="o_totalprice",
)
_model(
    "checked_partial_root", "events", _E, r"\model{y=\sqrt{v-x}}\normal v{0,1}\uniform x{0,100}" + _ALL,
    _main("CASE WHEN x >= 0 THEN sqrt(x) END", f"(SELECT value - 100 * {_u(_E, 0)} AS x FROM events)"), v="value",
)
_model(
    "checked_rational", "lineitem", _L, r"\model{y=\frac{q}{d-0.5z}}\normal q{0,1}\normal d{0,1}\uniform z{0,1}" + _ALL,
    _main("CASE WHEN b <> 0 THEN q / b END",
          f"(SELECT l_quantity AS q, l_discount + 1 - 0.5 * {_u(_L, 0)} AS b FROM lineitem)"), q="l_quantity", d="l_discount + 1",
)
_model(
    "checked_branches", "supplier", _S, r"\model{y=x\pm z}\normal x{0,1}\uniform z{0,50}" + _ALL,
    _fork("x + z", "x - z", f"(SELECT s_acctbal AS x, 50 * {_u(_S, 0)} AS z FROM supplier)"), x="s_acctbal",
)


@query(f"""WITH r AS (SELECT corr(x + 2 * z, x - 2 * z) AS c
    FROM (SELECT o_orderkey, 4 + 12 * {_u(_O, 0)} AS x, o_totalprice / 10000 AS z FROM orders) GROUP BY o_orderkey // 5000)
SELECT round(avg(c), 10) AS correlation_plus_minus_mean FROM r""")
def checked_correlation(spark, folder):
    """Block correlation of both branches, from the report of the paired difference."""
    rows = report(table(spark, folder, "orders"), _O, r"\model{y=x\pm2z}\uniform x{4,16}\normal z{0,1}" + _ALL, SEED, {"z": "o_totalprice / 10000"})
    return rows.where("id = 'plus_minus_delta'").selectExpr("round(correlation_plus_minus_mean, 10) AS correlation_plus_minus_mean")


@query(f"WITH value AS (SELECT o_totalprice * {_u(_O, 0)} AS v FROM orders) " + _histogram_sql("value", "v", 30, "main"))
def checked_histogram(spark, folder):
    rows = report(table(spark, folder, "orders"), _O, r"\model{y=x}\uniform x{0,1}" + _ALL, SEED, {"x": Uniform(0.0, "o_totalprice")})
    return histogram_rows(rows).selectExpr(
        "id", "cast(bin AS bigint) AS bin", "round(x0, 9) AS x0", "round(x1, 9) AS x1", "count"
    )


@query(f"""WITH s AS (SELECT count(*) AS n, avg(v) AS m, stddev_samp(v) AS sd FROM (SELECT value * {_u(_E, 0)} AS v FROM events))
SELECT n, n AS candidate_results, round(sd, 8) AS sample_stddev, round(sd / sqrt(n), 9) AS mcse_mean,
       round(m - 1.96 * sd / sqrt(n), 8) AS ci95_low, round(m + 1.96 * sd / sqrt(n), 8) AS ci95_high,
       'normal_approximation' AS ci95_mean_type, round(sd / sqrt(n) / m, 10) AS relative_mcse,
       1.0::DOUBLE AS valid_rate, 0.0::DOUBLE AS discard_rate,
       round(((1 + 1.9208 / n) - 1.96 * sqrt(0.9604 / n / n)) / (1 + 3.8416 / n), 11) AS valid_low,
       'discard_and_report' AS nonfinite_policy
FROM s""")
def checked_diagnostics(spark, folder):
    """The accuracy record; a report with sketched quantiles has the same one."""
    df = table(spark, folder, "events")
    rows = report(df, _E, r"\model{y=x}\uniform x{0,1}" + _ALL, SEED, {"x": Uniform(0.0, "value")}, quantiles="sketch")
    return rows.selectExpr("diagnostics.*").selectExpr(
        "n", "candidate_results", "round(sample_stddev, 8) AS sample_stddev", "round(mcse_mean, 9) AS mcse_mean",
        "round(ci95_mean[0], 8) AS ci95_low", "round(ci95_mean[1], 8) AS ci95_high", "ci95_mean_type",
        "round(relative_mcse, 10) AS relative_mcse", "valid_rate", "discard_rate",
        "round(valid_rate_ci95_wilson[0], 11) AS valid_low", "nonfinite_policy",
    )


_SEEDS = (96, 97, 101, 103, 101 + 2**32, 2**96 + 5)


@query(" UNION ALL ".join(
    f"SELECT '{seed}' AS seed, round(avg(o_totalprice * u), 4) AS avg, round(corr(u, w), 9) AS neighbour FROM "
    f"(SELECT o_totalprice, {row_uniform(_O, 0, seed)} AS u, {row_uniform(_O, 1, seed)} AS w FROM orders)" for seed in _SEEDS
))
def draws_over_seeds(spark, folder):
    """Means of one model over the orders for several seeds, and the correlation of neighbouring
    streams, all from one pass over the table."""
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    df = df.withColumn("seed", F.explode(F.array(*[F.lit(str(s)) for s in _SEEDS])))
    u, w = (draws.uniform_of(draws.digest("o_orderkey", F.col("seed"), k)) for k in (0, 1))
    df = df.select("seed", "o_totalprice", u.alias("u"), w.alias("w"))
    return df.groupBy("seed").agg(F.round(F.avg(F.col("o_totalprice") * F.col("u")), 4).alias("avg"), F.round(F.corr("u", "w"), 9).alias("neighbour"))


_COVER_SEEDS = tuple(range(500, 540))
_COVER_SQL = " UNION ALL ".join(f"SELECT '{s}' AS seed, value, value * 2 * {row_uniform(_E, 0, s)} AS v FROM events" for s in _COVER_SEEDS)


@query(f"""WITH m AS ({_COVER_SQL}),
s AS (SELECT seed, count(v) AS n, avg(v) AS mean, stddev_samp(v) / sqrt(count(v)) AS e, avg(value) AS t FROM m GROUP BY seed)
SELECT seed, n, round(mean, 7) AS mean, round(mean - 1.96 * e, 7) AS low, round(mean + 1.96 * e, 7) AS high,
       t BETWEEN mean - 1.96 * e AND mean + 1.96 * e AS covered FROM s""")
def coverage_over_seeds(spark, folder):
    """How the 95 % interval of a simulated mean holds the exact one, for forty seeds in one pass."""
    rows = interval_coverage(table(spark, folder, "events"), _E, lambda u: F.col("value") * 2 * u, _COVER_SEEDS, "value")
    return rows.selectExpr("seed", "n", "round(mean, 7) AS mean", "round(low, 7) AS low", "round(high, 7) AS high", "covered")


# --- groups and resampling ----------------------------------------------------------------


@query("""
SELECT 'task_' || lpad((o_orderkey // 2000)::VARCHAR, 9, '0') AS task, count(*) AS n, round(quantile_cont(v, 0.05), 6) AS p05,
       round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
FROM (SELECT o_orderkey, CASE WHEN o_orderkey // 2000 % 3 = 1 THEN 7 ELSE o_totalprice END::DOUBLE AS v FROM orders) GROUP BY 1""")
def task_quantiles(spark, folder):
    """Exact quantiles of every task of 2000 keys; in a third of them all values are tied."""
    df = table(spark, folder, "orders")
    task = "concat('task_', lpad(cast(o_orderkey div 2000 AS string), 9, '0'))"
    rows = group_quantiles(df, task, "if(o_orderkey div 2000 % 3 = 1, 7D, o_totalprice)")
    return rows.selectExpr("g AS task", "n", "round(p05, 6) AS p05", "round(p50, 6) AS p50", "round(p95, 6) AS p95")


@query("""
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05,
       round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95
FROM lineitem GROUP BY 1""")
def hot_group_quantiles(spark, folder):
    """The same where each group holds a large share of all rows."""
    rows = group_quantiles(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice")
    return rows.selectExpr("g AS l_returnflag", "n", "round(p05, 6) AS p05", "round(p50, 6) AS p50", "round(p95, 6) AS p95")


@query("""
WITH v AS (SELECT o_orderkey // 2000 AS task, o_totalprice::DOUBLE AS v FROM orders),
e AS (SELECT task, min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 8 AS w FROM v GROUP BY 1),
g AS (SELECT task, v, lo, w, least(floor((v - lo) / w)::BIGINT, 7) AS g FROM v JOIN e USING (task))
SELECT task, CASE WHEN v < g * w + lo THEN g - 1 WHEN g < 7 AND v >= (g + 1) * w + lo THEN g + 1 ELSE g END AS bin,
       count(*) AS count FROM g GROUP BY ALL""")
def task_histograms(spark, folder):
    """A histogram between each task's own extremes."""
    return group_histograms(table(spark, folder, "orders"), "o_orderkey div 2000", "o_totalprice", 8).selectExpr("g AS task", "bin", "count")


_REPLICATES = 40
_POISSON_SQL = " ".join(f"WHEN u < {p!r}::DOUBLE THEN {k}" for k, p in enumerate(POISSON))


def _weights_sql(table_name: str, key: str, value: str) -> str:
    """The weights of every replicate redrawn: two of them share a digest."""
    u = " UNION ALL ".join(
        f"SELECT {2 * pair + part} AS r, {value} AS v, {row_uniform(key, pair, SEED, part)} AS u FROM {table_name}"
        for pair in range(_REPLICATES // 2) for part in (0, 1)
    )
    return f"SELECT r, v, CASE {_POISSON_SQL} ELSE {len(POISSON)} END AS w FROM ({u})"


@query(f"""WITH w AS ({_weights_sql('customer', 'c_custkey', 'c_acctbal')}),
s AS (SELECT r, v, sum(w) AS w FROM w WHERE w > 0 GROUP BY r, v),
c AS (SELECT *, sum(w) OVER (PARTITION BY r ORDER BY v) AS reached, sum(w) OVER (PARTITION BY r) AS total FROM s),
b AS (SELECT r, sum(v * w) / sum(w) AS mean, min(v) FILTER (WHERE 2 * reached >= total) AS median FROM c GROUP BY r),
x AS (SELECT 'mean' AS statistic, mean AS x FROM b UNION ALL SELECT 'median', median FROM b)
SELECT statistic, round(quantile_cont(x, 0.025), 6) AS low, round(quantile_cont(x, 0.975), 6) AS high FROM x GROUP BY 1""")
def bootstrap_balance(spark, folder):
    """Poisson bootstrap of the mean and the median balance of all customers."""
    found = bootstrap_intervals(table(spark, folder, "customer"), "c_custkey", "c_acctbal", _REPLICATES, SEED)
    return found.selectExpr("statistic", "round(low, 6) AS low", "round(high, 6) AS high")


# --- guard and configuration --------------------------------------------------------------


@query("""
WITH q AS (SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal >= 0) AS v FROM customer)
SELECT 'some' AS model, n AS candidates, v AS valid, NULL::VARCHAR AS error FROM q
UNION ALL SELECT 'none', n, 0, 'NoFiniteResult' FROM q""")
def no_result_guard(spark, folder):
    """A model with some finite results reports them; one without any is caught when it is called."""
    df, out = table(spark, folder, "customer"), []
    for name, column in (("some", "c_acctbal"), ("none", "if(c_acctbal IS NULL, NULL, -1D)")):
        try:
            row = report(df, _C, r"\model{y=\sqrt{x}}\normal x{0,1}" + _ALL, SEED, {"x": column}).first()
            out.append((name, row["candidate_results"], row["valid_results"], None))
        except NoFiniteResult as error:
            out.append((name, df.count(), 0, type(error).__name__))
    return spark.createDataFrame(out, "model string, candidates long, valid long, error string")


@query("""
SELECT mode, count(*) AS n, round(avg(o_totalprice), 5) AS avg, true AS p50_in_bound
FROM orders, (SELECT unnest(['exact', 'sketch']) AS mode) GROUP BY mode""")
def quantile_modes(spark, folder):
    """Exact and sketched reports of one model side by side; both medians have the rank they claim."""
    df, out = table(spark, folder, "orders"), None
    for mode in MODES:
        rows = report(df, _O, r"\model{y=x}\normal x{0,1}" + _ALL, SEED, {"x": "o_totalprice"}, quantiles=mode)
        rows = rows.selectExpr(f"'{mode}' AS mode", "valid_results AS n", "stats.avg AS avg", "stats.p50 AS p50")
        out = rows if out is None else out.unionByName(rows)
    points = out.select("mode", "n", "avg", "p50")
    ranks = df.join(F.broadcast(points)).groupBy("mode", "n", "avg").agg(F.expr("count_if(o_totalprice <= p50) / count(*)").alias("share"))  # two rows
    return ranks.selectExpr("mode", "n", "round(avg, 5) AS avg", f"abs(share - 0.5D) <= if(mode = 'exact', 1D / n, {_SLACK * rank_error()}D) AS p50_in_bound")


@query("""
WITH c AS (SELECT c_nationkey AS k, count(*) AS n, count(*) FILTER (WHERE c_acctbal >= 0) AS good, avg(c_acctbal) AS m,
                  stddev_samp(c_acctbal) / sqrt(count(*)) AS e FROM customer GROUP BY 1),
p AS (SELECT *, good / n AS p, 1.96 * 1.96 AS zz FROM c),
w AS (SELECT *, (p + zz / (2 * n)) / (1 + zz / n) AS mid, 1.96 * sqrt((p * (1 - p) + zz / (4 * n)) / n) / (1 + zz / n) AS half FROM p)
SELECT k AS nation, round(greatest(0, mid - half), 9) AS low, round(least(1, mid + half), 9) AS high, round(e, 7) AS mcse,
       round(m - 1.96 * e, 6) AS mean_low, round(m + 1.96 * e, 6) AS mean_high FROM w""")
def sql_functions(spark, folder):
    """The statistics as functions of SQL, in a query that is SQL only."""
    register_functions(spark)
    table(spark, folder, "customer").createOrReplaceTempView("quincunx_customers")
    return spark.sql("""
        WITH s AS (SELECT c_nationkey AS nation, count(*) AS n, count_if(c_acctbal >= 0) AS good, avg(c_acctbal) AS m,
                          var_pop(c_acctbal) * count(*) AS m2 FROM quincunx_customers GROUP BY c_nationkey)
        SELECT nation, round(wilson_interval(good, n)[0], 9) AS low, round(wilson_interval(good, n)[1], 9) AS high,
               round(mcse(n, m2), 7) AS mcse, round(mean_interval(n, m, m2)[0], 6) AS mean_low, round(mean_interval(n, m, m2)[1], 6) AS mean_high
        FROM s""")


@query("""
SELECT format, 'main' AS id, n, avg FROM (SELECT unnest(['csv', 'json', 'parquet']) AS format),
    (SELECT count(*) AS n, round(avg(sqrt(c_acctbal)) FILTER (WHERE c_acctbal >= 0), 6) AS avg FROM customer)""")
def report_files(spark, folder):
    """A report written in three formats and read back."""
    df = table(spark, folder, "customer")
    rows = report(df, _C, r"\model{y=\sqrt{x}}\normal x{0,1}" + _ALL, SEED, {"x": "c_acctbal"})
    flat, where, out = flat_report(rows).schema, new_folder(spark), None
    for kind in ("csv", "json", "parquet"):
        write_report(rows, f"{where}/{kind}", kind)
        reader = spark.read.option("header", True).schema(flat if kind == "csv" else rows.schema)
        back = reader.format(kind).load(f"{where}/{kind}")
        back = back.selectExpr(f"'{kind}' AS format", "id", "candidate_results AS n", f"round({'avg' if kind == 'csv' else 'stats.avg'}, 6) AS avg")
        out = back if out is None else out.unionByName(back)
    return out


@query("SELECT 3::BIGINT AS plans, 1::BIGINT AS digests, count(*) AS orders FROM orders")
def schedule_invariance(spark, folder):
    """Digest of one exact report, no number rounded, over three partitionings of the orders: always the same."""
    df = table(spark, folder, "orders")
    model = r"\model{y=x\pm2z}\uniform x{4,16}\normal z{0,1}" + _ALL
    digests = None
    for partitions in (8, 24, 64):
        rows = report(df.repartition(partitions, "o_custkey"), _O, model, SEED, {"z": "o_totalprice / 10000"})
        digest = result_digest(rows)
        digests = digest if digests is None else digests.unionByName(digest)
    return digests.agg(F.count("*").alias("plans"), F.count_distinct("sha256").alias("digests")).crossJoin(
        df.agg(F.count("*").alias("orders"))  # one row each
    )


def _normal_equations_sql(source: str, by: str, target: str, terms: dict[str, str]) -> str:
    """Coefficients by elimination in the normal equations, one pivot at a time."""
    names, columns = ["intercept", *terms], ["1.0", *terms.values(), target]
    p = len(names)
    cells = [(i, j) for i in range(p) for j in range(p + 1)]
    sums = ", ".join(f"sum(({columns[i]})::DOUBLE * ({columns[j]})::DOUBLE) AS m{i}_{j}" for i, j in cells)
    steps = [f"e0 AS (SELECT {by}, count(*) AS n, {sums} FROM {source} GROUP BY {by})"]
    for k in range(p):
        kept = [f"m{k}_{j} / m{k}_{k} AS m{k}_{j}" if i == k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}" for i, j in cells]
        steps.append(f"e{k + 1} AS (SELECT {by}, n, {', '.join(kept)} FROM e{k})")
    parts = [f"SELECT {by}, n, '{t}' AS term, round(m{i}_{p}, 3) AS coefficient, {p} AS rank FROM e{p}" for i, t in enumerate(names)]
    return f"WITH {', '.join(steps)} {' UNION ALL '.join(parts)}"


_PRICE = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber"}


@query(_normal_equations_sql("lineitem", "l_returnflag", "l_extendedprice", _PRICE))
def price_fit(spark, folder):
    """Prices on four columns by least squares, for each return flag."""
    fit = linear_fit(table(spark, folder, "lineitem"), "l_extendedprice", _PRICE, by=["l_returnflag"])
    return fit.selectExpr("l_returnflag", "n", "term", "round(coefficient, 3) AS coefficient", "rank")


@query("""
WITH g AS (SELECT l_returnflag, count(*) AS n, 1.01 * sum(q * q) AS h11, sum(q * d) AS h12, 1.01 * sum(d * d) AS h22, sum(q * y) AS g1, sum(d * y) AS g2
           FROM (SELECT l_returnflag, l_quantity AS q, l_discount AS d, l_extendedprice * (1 - l_discount) AS y FROM lineitem) GROUP BY 1),
faces AS (SELECT *, unnest([
    {'a': (g1 * h22 - g2 * h12) / (h11 * h22 - h12 * h12), 'b': (g2 * h11 - g1 * h12) / (h11 * h22 - h12 * h12), 'ca': false, 'cb': false},
    {'a': g1 / h11, 'b': 0.0, 'ca': false, 'cb': true}, {'a': 0.0, 'b': g2 / h22, 'ca': true, 'cb': false},
    {'a': 0.0, 'b': 0.0, 'ca': true, 'cb': true}]) AS f FROM g),
best AS (SELECT l_returnflag, n, arg_min(f, f.a * f.a * h11 + 2 * f.a * f.b * h12 + f.b * f.b * h22 - 2 * f.a * g1 - 2 * f.b * g2) AS f
         FROM faces WHERE f.a >= 0 AND f.b >= 0 GROUP BY 1, 2)
SELECT l_returnflag, n, 'quantity' AS term, round(f.a, 4) AS coefficient, f.ca AS bounded FROM best
UNION ALL SELECT l_returnflag, n, 'discount', round(f.b, 4), f.cb FROM best""")
def bounded_price_fit(spark, folder):
    """A ridge fit whose coefficients may not be negative: discounts lower a price, so theirs lies on its bound."""
    fit = linear_fit(
        table(spark, folder, "lineitem"), "l_extendedprice * (1 - l_discount)", {"quantity": "l_quantity", "discount": "l_discount"},
        by=["l_returnflag"], ridge=0.01, lower={"quantity": 0.0, "discount": 0.0}, intercept=False,
    )
    return fit.selectExpr("l_returnflag", "n", "term", "round(coefficient, 4) AS coefficient", "bounded")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Both roots of a quadratic with a balance as one coefficient: the whole report."""
    text = (
        r"\model{y=\frac{-b\pm\sqrt{b^2-4a c}}{2a}}\normal a{10,0.5}\distrib b{{10,0.5},{15,0.3},{20,0.2}}\normal c{0,1}"
        r"\iter{1}\response{avg,std,min,max,count,valid_rate,discard_rate,p05,p50,p95}"
    )
    return report(table(spark, folder, "customer"), _C, text, SEED, {"c": "c_acctbal / 200"})


__all__ = ["ORACLES", "QUERIES", "flagship"]
