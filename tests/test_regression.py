"""Linear fits against numpy's least squares and against every face of the bounds."""

import itertools

import numpy as np
import pytest

from quincunx.operators.regression import bounded_minimum, linear_fit


def faces(h, c, lower):
    """The best of the minima over all choices of entries on their bound."""
    best, at, p = np.inf, None, len(c)
    for on in itertools.product((False, True), repeat=p):
        on = np.array(on)
        if (on & ~np.isfinite(lower)).any():
            continue
        z = np.where(on, lower, 0.0)
        if (~on).any():
            z[~on] = np.linalg.solve(h[np.ix_(~on, ~on)], c[~on] - h[np.ix_(~on, on)] @ z[on])
        value = z @ h @ z / 2 - c @ z
        if (z >= lower - 1e-9).all() and value < best:
            best, at = value, z
    return at


def test_bounded_minimum_is_the_best_face():
    rng = np.random.default_rng(6)
    for _ in range(300):
        p = int(rng.integers(1, 6))
        x = rng.standard_normal((p + 3, p))
        h, c = x.T @ x, rng.standard_normal(p) * 3
        lower = np.where(rng.random(p) < 0.25, -np.inf, rng.standard_normal(p))
        z, bound = bounded_minimum(h, c, lower)
        assert np.allclose(z, faces(h, c, lower), atol=1e-7)
        assert (z >= lower).all() and (z[bound] == lower[bound]).all()


def rows_of(spark, x, y, group=None):
    data = [(g, *map(float, r), float(v)) for g, r, v in zip(group if group is not None else ["g"] * len(y), x, y)]
    return spark.createDataFrame(data, "g string, a double, b double, c double, y double").repartition(3)


TERMS = {"a": "a", "b": "b", "c": "c"}


@pytest.mark.parametrize("intercept", [True, False])
def test_groups_against_least_squares(spark, intercept):
    rng = np.random.default_rng(4)
    x, group = rng.standard_normal((600, 3)) * [1, 5, 0.1] + [100, 0, 3], rng.choice(["u", "v"], 600, p=[0.9, 0.1])
    y = x @ [2.0, -1.0, 7.0] + 4 + rng.standard_normal(600)
    got = linear_fit(rows_of(spark, x, y, group), "y", TERMS, by=["g"], intercept=intercept).collect()
    for g in "uv":
        own = group == g
        design = np.column_stack([np.ones(own.sum()), x[own]]) if intercept else x[own]
        want = np.linalg.lstsq(design, y[own], rcond=None)[0]
        fit = [r for r in got if r.g == g]
        assert [r.term for r in fit] == (["intercept"] if intercept else []) + list(TERMS)
        assert np.allclose([r.coefficient for r in fit], want, rtol=1e-6)
        assert fit[0].n == own.sum() and fit[0].rank == design.shape[1]
        assert np.isclose(fit[0].condition, np.linalg.cond(design), rtol=1e-4)
        standard = (x[own] - x[own].mean(axis=0)) / x[own].std(axis=0)
        assert np.isclose(fit[0].condition_standardized, np.linalg.cond(standard), rtol=1e-6)
        base = y[own] - y[own].mean() if intercept else y[own]
        assert np.isclose(fit[0].r2, 1 - ((y[own] - design @ want) ** 2).sum() / (base**2).sum(), rtol=1e-6)


def test_ridge_towards_a_prior_with_bounds(spark):
    rng = np.random.default_rng(7)
    x = rng.random((200, 3))
    y = x @ [5.0, -3.0, 0.1] + rng.standard_normal(200) * 0.1
    prior = np.array([2.0, 1.0, 4.0])
    got = linear_fit(rows_of(spark, x, y), "y", TERMS, ridge=0.01, prior=dict(zip("abc", prior)), lower=dict(zip("abc", prior / 4)), intercept=False).collect()
    scaled = x * prior
    h = scaled.T @ scaled
    h = h + 0.01 * np.trace(h) / 3 * np.eye(3)
    want = prior + prior * faces(h, scaled.T @ (y - x @ prior), np.full(3, -0.75))
    assert np.allclose([r.coefficient for r in got], want, rtol=1e-8)
    assert [r.bounded for r in got] == [False, True, True] and got[1].coefficient == 0.25


def test_odd_rows(spark):
    schema = "g string, a double, b double, c double, y double"
    data = [("x", 1.0, 2.0, 2.0, 3.0), ("x", 2.0, 4.0, 1.0, 6.0), ("x", 3.0, 6.0, 5.0, 9.0), ("x", None, 1.0, 1.0, 1.0), ("x", 1.0, 1.0, 1.0, float("inf")), ("y", None, None, None, 1.0)]
    got = linear_fit(spark.createDataFrame(data, schema), "y", {"a": "a", "b": "b"}, by=["g"], intercept=False).collect()
    a, b = (r for r in got if r.g == "x")
    assert (a.n, a.n_dropped, a.rank, a.condition) == (3, 2, 1, float("inf"))
    assert np.isclose(a.coefficient + 2 * b.coefficient, 3) and np.isclose(a.r2, 1)
    assert [(r.coefficient, r.n, r.n_dropped, r.rank) for r in got if r.g == "y"] == [(None, 0, 1, 0)] * 2
    assert linear_fit(spark.createDataFrame([], schema), "y", TERMS, by=["g"]).count() == 0
    with pytest.raises(ValueError):
        linear_fit(spark.createDataFrame([], schema), "y", TERMS, lower={"q": 0.0})
