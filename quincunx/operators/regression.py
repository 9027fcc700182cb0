"""Linear fits of a column on others, for each group, from one mergeable aggregate.

Counts, means and covariances of all pairs of columns combine on the map side; what is left
of a group is one row of the size of its Gram matrix, and its fit is found there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.operators.moments import finite_sql

SMALL = 1e-12  # of the largest eigenvalue: below it a direction counts as none
FIT = "term string, coefficient double, bounded boolean, n long, n_dropped long, rank int, condition double, condition_standardized double, r2 double"


def second_moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., n, n_dropped, means, products): means of the columns, and sums of products of their
    deviations for each pair i <= j, row by row.

    ``columns`` are SQL.  A row with a null or non-finite value in one of them is dropped and counted.
    """
    names = [f"_x{k}" for k in range(len(columns))]
    rows = df.selectExpr(*by, *[f"{finite_sql(f'cast({sql} AS double)')} AS {x}" for sql, x in zip(columns, names, strict=True)])
    whole = " AND ".join(f"{x} IS NOT NULL" for x in names)
    rows = rows.selectExpr(*by, *[f"if({whole}, {x}, NULL) AS {x}" for x in names])
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k:]]
    return rows.groupBy(*by).agg(
        F.count(names[0]).alias("n"), F.expr(f"count(*) - count({names[0]})").alias("n_dropped"),
        F.array(*[F.avg(x) for x in names]).alias("means"),
        F.array(*[F.covar_pop(a, b) * F.count(names[0]) for a, b in pairs]).alias("products"),
    )


def bounded_minimum(h: np.ndarray, c: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The z >= lower that minimises z'hz / 2 - c'z, and which of its entries lie on their bound.

    Active sets: entries leave their bound by the steepest gradient; where the free ones'
    minimum would cross a bound, the step ends at the first one crossed.  Entries without a
    bound (-inf) are always free.  Directions without curvature take the shortest solution.
    """
    held = np.isfinite(lower)
    z = np.where(held, lower, 0.0)
    free = ~held
    tolerance = 1e-10 * max(1.0, np.abs(c).max(initial=0.0))
    for turn in range(3 * len(z) + 1):
        if turn or not free.any():
            slope = np.where(free, -np.inf, c - h @ z)
            if not len(z) or slope.max() <= tolerance:
                break
            free[slope.argmax()] = True
        while free.any():
            aim = z.copy()
            aim[free] = np.linalg.lstsq(h[np.ix_(free, free)], c[free] - h[np.ix_(free, ~free)] @ z[~free], rcond=SMALL)[0]
            crossed = free & (aim < lower)
            if not crossed.any():
                z = aim
                break
            steps = (z[crossed] - lower[crossed]) / (z[crossed] - aim[crossed])
            z = z + steps.min() * (aim - z)
            end = np.flatnonzero(crossed)[steps <= steps.min()]
            z[end] = lower[end]
            free[end] = False
    return z, ~free


def condition(gram: np.ndarray) -> float:
    """The condition number of the columns with this Gram matrix."""
    values = np.linalg.eigvalsh(gram) if len(gram) else np.ones(1)
    return float(np.sqrt(values[-1] / values[0])) if values[0] > SMALL * values[-1] else float("inf")


def fit_of(n: int, means: np.ndarray, products: np.ndarray, ridge: float, prior: np.ndarray, lower: np.ndarray, intercept: bool):
    """(coefficients, on a bound, rank, condition, condition standardized, r2) of one group; the last column is the target."""
    p = len(means) - 1
    centred = np.zeros((p + 1, p + 1))
    centred[np.triu_indices(p + 1)] = products
    centred += np.triu(centred, 1).T
    raw = centred + n * np.outer(means, means)
    gram, g = (centred if intercept else raw)[:p, :p], (centred if intercept else raw)[:p, p]
    size = np.sqrt(np.maximum(np.diag(gram), 0) / n)
    scale = np.where(prior != 0, np.abs(prior), 1 / np.where(size > 0, size, 1))
    scaled = gram * np.outer(scale, scale)
    penalty = ridge * np.trace(scaled) / p
    d, bound = bounded_minimum(scaled + penalty * np.eye(p), (g - gram @ prior) * scale, (lower - prior) / scale)
    theta = prior + d * scale
    design = raw[:p, :p]
    if intercept:
        design = np.block([[np.array([[float(n)]]), n * means[None, :p]], [n * means[:p, None], raw[:p, :p]]])
    root = np.sqrt(np.where(np.diag(design) > 0, np.diag(design), 1))
    values = np.linalg.eigvalsh(design / np.outer(root, root))
    spread = np.diag(centred)[:p] > 0
    own = np.sqrt(np.diag(centred)[:p][spread])
    standard = centred[:p, :p][np.ix_(spread, spread)] / np.outer(own, own)
    total = (centred if intercept else raw)[p, p]
    rest = total - 2 * theta @ g + theta @ gram @ theta
    r2 = 1 - rest / total if total > 0 else float("nan")
    if intercept:
        theta, bound = np.append(means[p] - theta @ means[:p], theta), np.append(False, bound)
    return theta, bound, int((values > SMALL * values[-1]).sum()), condition(design), condition(standard), float(r2)


def linear_fit(
    df: DataFrame, target: str, terms: Mapping[str, str], *, by: Sequence[str] = (), ridge: float = 0.0,
    prior: Mapping[str, float] | None = None, lower: Mapping[str, float] | None = None, intercept: bool = True,
) -> DataFrame:
    """(by..., term, coefficient, bounded, n, n_dropped, rank, condition, condition_standardized, r2):
    one row for each group and term, ``intercept`` among them.

    ``target`` and the values of ``terms`` are SQL.  The fit minimises the squared residuals plus
    ``ridge`` times the mean square of the scaled columns times the squared distance of the
    coefficients from ``prior`` (0 unless given) in units of the prior, or of 1 / the column's root
    mean square where that is 0.  No coefficient falls below its ``lower`` bound, and ``bounded``
    tells which lie on it.  The intercept has neither penalty nor bound.  Columns that depend on
    each other share the shortest solution; ``rank`` and ``condition`` (infinite then) tell.
    A group without a complete row has null coefficients and rank 0.
    """
    if not terms:
        raise ValueError("a fit needs a term")
    prior, lower = prior or {}, lower or {}
    if unknown := (set(prior) | set(lower)) - set(terms):
        raise ValueError(f"no such terms: {sorted(unknown)}")
    start = np.array([float(prior.get(t, 0.0)) for t in terms])
    least = np.array([float(lower.get(t, -np.inf)) for t in terms])
    names = ["intercept", *terms] if intercept else list(terms)
    by = list(by)
    states = second_moments(df, [*terms.values(), target], by)

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fits = []
            for n, means, products in zip(frame["n"], frame["means"], frame["products"], strict=True):
                if n:
                    fits.append(fit_of(int(n), np.array(means, float), np.array(products, float), ridge, start, least, intercept))
                else:
                    fits.append(([None] * len(names), [None] * len(names), 0, None, None, None))
            many = frame.loc[frame.index.repeat(len(names)), [*by, "n", "n_dropped"]].reset_index(drop=True)
            many["term"] = names * len(frame)
            many["coefficient"] = pd.Series([x for f in fits for x in f[0]], dtype="float64")
            many["bounded"] = pd.Series([x if x is None else bool(x) for f in fits for x in f[1]], dtype="object")
            for k, name in enumerate(("rank", "condition", "condition_standardized", "r2"), 2):
                values = [f[k] for f in fits for _ in names]
                many[name] = pd.Series(values, dtype="int32" if name == "rank" else "float64")
            yield many[[*by, *[c.split()[0] for c in FIT.split(", ")]]]

    keys = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in states.schema.fields[: len(by)])
    return states.mapInPandas(run, keys + FIT)
