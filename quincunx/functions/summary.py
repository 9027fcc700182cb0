"""Derived statistics as SQL text over a moment state (n, mean, m2, low, high).

Text rather than Column objects: a report has hundreds of operators, and one expression
string crosses to the JVM in one call.  Arguments are column names or SQL fragments.
"""

from __future__ import annotations

# Fixed value: two-sided 95 % point of the normal approximation.
Z95 = 1.96


def variance(n: str, m2: str) -> str:
    """Sample variance (n - 1); NULL for fewer than two values, never negative."""
    return f"if({n} > 1, greatest(0D, {m2} / ({n} - 1)), NULL)"


def stddev(n: str, m2: str) -> str:
    return f"sqrt({variance(n, m2)})"


def mcse(n: str, m2: str) -> str:
    """Monte Carlo standard error of the mean, s / sqrt(n)."""
    return f"({stddev(n, m2)} / sqrt(nullif({n}, 0)))"


def mean_interval(mean: str, error: str) -> str:
    """Normal-approximation 95 % interval of the mean as a two-element array."""
    return f"if({error} IS NULL, NULL, array({mean} - {Z95}D * {error}, {mean} + {Z95}D * {error}))"


def relative_mcse(mean: str, error: str) -> str:
    return f"abs({error} / nullif({mean}, 0D))"


def rate(part: str, whole: str) -> str:
    return f"if({whole} > 0, {part} / {whole}, NULL)"


def wilson(successes: str, trials: str, z: float = Z95) -> str:
    """Wilson interval of a proportion, clamped to [0, 1]; NULL without trials."""
    n = f"cast({trials} AS double)"
    p = f"(({successes}) / {n})"
    z2 = z * z
    scale = f"(1D + {z2}D / {n})"
    centre = f"(({p} + {z2}D / (2D * {n})) / {scale})"
    half = f"({z}D * sqrt(({p} * (1D - {p}) + {z2}D / (4D * {n})) / {n}) / {scale})"
    return f"if({trials} > 0, array(greatest(0D, {centre} - {half}), least(1D, {centre} + {half})), NULL)"


def pair_correlation(a: str, b: str) -> str:
    """Pearson r of the rows where both are present; NULL if n <= 1 or either is constant.

    ``corr`` divides by zero under ANSI mode when one side is constant.
    """
    both = f"({a} IS NOT NULL AND {b} IS NOT NULL)"
    spread = f"(sqrt(var_pop({a}) FILTER (WHERE {both})) * sqrt(var_pop({b}) FILTER (WHERE {both})))"
    return f"(covar_pop({a}, {b}) FILTER (WHERE {both}) / nullif({spread}, 0D))"


def diagnostics(n: str, candidates: str, mean: str, m2: str, low: str, high: str) -> str:
    """Accuracy record of one branch; present whatever statistics were requested."""
    discarded = f"greatest(0, {candidates} - {n})"
    error = mcse(n, m2)
    return f"""named_struct(
        'n', {n},
        'candidate_results', {candidates},
        'sample_min', {low},
        'sample_max', {high},
        'sample_variance', {variance(n, m2)},
        'sample_stddev', {stddev(n, m2)},
        'mcse_mean', {error},
        'ci95_mean', {mean_interval(mean, error)},
        'ci95_mean_type', 'normal_approximation',
        'relative_mcse', {relative_mcse(mean, error)},
        'valid_rate', {rate(n, candidates)},
        'discard_rate', {rate(discarded, candidates)},
        'valid_rate_ci95_wilson', {wilson(n, candidates)},
        'discard_rate_ci95_wilson', {wilson(discarded, candidates)},
        'nonfinite_policy', 'discard_and_report')"""


def statistics(
    names: tuple[str, ...], n: str, candidates: str, mean: str, m2: str, low: str, high: str, quantiles: str
) -> str:
    """The requested statistics as one struct, in the order they were requested."""
    valid = rate(n, candidates)
    known = {
        "avg": f"if({n} > 0, {mean}, NULL)",
        "min": low,
        "max": high,
        "var": variance(n, m2),
        "std": stddev(n, m2),
        "count": n,
        "valid_rate": valid,
        "discard_rate": f"(1D - {valid})",
        "p05": f"{quantiles}[0]",
        "p50": f"{quantiles}[1]",
        "p95": f"{quantiles}[2]",
    }
    return "named_struct(" + ", ".join(f"'{name}', {known[name]}" for name in names) + ")"
