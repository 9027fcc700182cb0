"""Moment states {n, mean, m2, low, high} of table columns, per block and overall."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.functions import summary

NODE_BITS = 16  # a node of the fold tree takes the states of 2^16 neighbouring numbers
STATE = ("candidates", "n", "mean", "m2", "low", "high")


def finite_sql(value: str) -> str:
    """A measure with everything non-finite turned to NULL, which aggregates skip."""
    return f"if(abs({value}) < double('infinity'), cast({value} AS double), NULL)"


def _aggregates(measures: list[str]) -> list:
    cells = []
    for m in measures:
        cells.append(
            f"""named_struct('id', '{m}', 'candidates', count(*), 'n', count({m}),
            'mean', coalesce(avg({m}), 0D), 'm2', coalesce(var_pop({m}) * count({m}), 0D),
            'low', min({m}), 'high', max({m}))"""
        )
    return [F.expr(f"array({', '.join(cells)})").alias("states")]


def _measures(df: DataFrame, measures: Mapping[str, str], *keep: str) -> DataFrame:
    return df.selectExpr(*keep, *[f"{finite_sql(sql)} AS {m}" for m, sql in measures.items()])


def column_moments(df: DataFrame, measures: Mapping[str, str]) -> DataFrame:
    """(id, moment state) per measure in one partial and one final aggregation.

    ``measures`` maps an id to SQL over the columns of ``df``.
    """
    return _measures(df, measures).agg(*_aggregates(list(measures))).selectExpr("inline(states)")


def block_moments(df: DataFrame, block: str, measures: Mapping[str, str]) -> DataFrame:
    """(block, id, moment state).  Blocks combine on the map side, so a hot block costs
    one row per task like any other."""
    return (
        _measures(df, measures, f"{block} AS block")
        .groupBy("block")
        .agg(*_aggregates(list(measures)))
        .selectExpr("block", "inline(states)")
    )


EMPTY_STATE = _EMPTY = (
    "named_struct('candidates', 0L, 'n', 0L, 'mean', 0D, 'm2', 0D, "
    "'low', cast(NULL AS double), 'high', cast(NULL AS double))"
)
# Chan, Golub and LeVeque's pairwise update; least and greatest skip NULL.
MERGE_STATES = _MERGE = """named_struct(
    'candidates', a.candidates + b.candidates,
    'n', a.n + b.n,
    'mean', if(b.n = 0, a.mean, if(a.n = 0, b.mean, a.mean + (b.mean - a.mean) * b.n / nullif(a.n + b.n, 0))),
    'm2', if(b.n = 0, a.m2, if(a.n = 0, b.m2,
          a.m2 + b.m2 + (b.mean - a.mean) * (b.mean - a.mean) * a.n * b.n / nullif(a.n + b.n, 0))),
    'low', least(a.low, b.low),
    'high', greatest(a.high, b.high))"""


def _fold(states: DataFrame, order: str, keys: list[str], merged: str) -> DataFrame:
    """Folds states in ``order``, a BIGINT, through one fixed tree over all 64-bit numbers.

    Three levels of nodes and a root: no node has more than 2^16 children, however many
    blocks there are and however their numbers lie.  A NULL number is a node of its own.
    """
    for _ in range(64 // NODE_BITS - 1):
        node = F.shiftright(F.col(order).cast("long"), NODE_BITS).alias(order)
        states = states.groupBy(*keys, node).agg(F.expr(merged).alias("s")).select(*keys, order, "s.*")
    return states.groupBy(*keys).agg(F.expr(merged).alias("s")).select(*keys, "s.*")


def fold_moments(states: DataFrame, order: str = "block") -> DataFrame:
    """Merges the states of each id in the order of their numbers, whatever the partitioning."""
    ordered = f"array_sort(collect_list(struct({order}, {', '.join(STATE)})))"
    return _fold(states, order, ["id"], f"aggregate({ordered}, {_EMPTY}, (a, b) -> {_MERGE})")


def block_correlation(df: DataFrame, block: str, plus: str, minus: str, *groups: str) -> DataFrame:
    """(groups..., correlation_plus_minus_mean, blocks): unweighted mean over blocks of the
    plus/minus correlation, one row for each value of the ``groups`` columns.

    Blocks with fewer than two pairs or a constant side have no correlation and do not
    count.  The sum is compensated (Neumaier) and taken in block order.
    """
    both = f"abs({plus}) < double('infinity') AND abs({minus}) < double('infinity')"
    r = summary.pair_correlation("plus", "minus")
    return fold_correlations(
        df.selectExpr(
            *groups,
            f"{block} AS block",
            f"if({both}, cast({plus} AS double), NULL) AS plus",
            f"if({both}, cast({minus} AS double), NULL) AS minus",
        )
        .groupBy(*groups, "block")
        .agg(F.expr(r).alias("r")),
        *groups,
    )


def fold_correlations(blocks: DataFrame, *groups: str) -> DataFrame:
    """(groups..., correlation_plus_minus_mean, blocks) of (groups..., block, r), in block order."""
    states = blocks.selectExpr(*groups, "block", "r AS total", "0D AS comp", "1L AS n").where("total IS NOT NULL AND NOT isnan(total)")
    add = """named_struct(
        'total', a.total + b.total,
        'comp', a.comp + b.comp + if(abs(a.total) >= abs(b.total),
                (a.total - (a.total + b.total)) + b.total,
                (b.total - (a.total + b.total)) + a.total),
        'n', a.n + b.n)"""
    merged = (
        "aggregate(array_sort(collect_list(struct(block, total, comp, n))), "
        f"named_struct('total', 0D, 'comp', 0D, 'n', 0L), (a, b) -> {add})"
    )
    return _fold(states, "block", list(groups), merged).selectExpr(
        *groups, "(total + comp) / nullif(n, 0) AS correlation_plus_minus_mean", "n AS blocks"
    )


def report_moments(states: DataFrame, *keep: str) -> DataFrame:
    """The statistics that a moment state alone determines."""
    error = summary.mcse("n", "m2")
    return states.selectExpr(
        "id",
        *keep,
        "candidates",
        "n AS count",
        "candidates - n AS discarded",
        "if(n > 0, mean, NULL) AS avg",
        "low AS min",
        "high AS max",
        f"{summary.variance('n', 'm2')} AS var",
        f"{summary.stddev('n', 'm2')} AS std",
        f"{summary.rate('n', 'candidates')} AS valid_rate",
        f"1D - {summary.rate('n', 'candidates')} AS discard_rate",
        f"{error} AS mcse",
        f"{summary.mean_interval('mean', error)} AS ci95",
        f"{summary.relative_mcse('mean', error)} AS relative_mcse",
        f"{summary.wilson('n', 'candidates')} AS valid_wilson",
    )
