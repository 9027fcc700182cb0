"""The full report of a model over the rows of a table: one iteration per row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quincunx.functions import summary
from quincunx.functions.arithmetic import paired_delta
from quincunx.operators.histogram import histogram
from quincunx.operators.moments import STATE, block_correlation, column_moments
from quincunx.operators.quantiles import exact_quantiles
from quincunx.operators.sketch import block_sketches, merge_sketches, quantiles_sql
from quincunx.operators.sums import reproducible_correlation, reproducible_moments
from quincunx.plans.program import Distribution, Program, read_program
from quincunx.sources.draws import with_draws
from quincunx.sources.stored import stored

BRANCHES = {  # id -> label
    "main": "result",
    "plus": "plus branch",
    "minus": "minus branch",
    "plus_minus_delta": "paired difference, plus less minus",
}
MODES = ("exact", "sketch")


class NoFiniteResult(RuntimeError):
    """Every branch of a model discarded all its rows."""


def measure_ids(program: Program) -> tuple[str, ...]:
    """The branches; a fork adds the paired difference."""
    ids = program.formula.branch_ids
    return ids if len(ids) == 1 else (*ids, "plus_minus_delta")


def branch_values(
    df: DataFrame, key: str, program: Program | str, seed: int, bind: Mapping[str, str | Distribution] | None = None,
    keyed: bool = True,
) -> DataFrame:
    """(key, one raw value per branch) of every row of ``df``.

    ``key`` is SQL for a BIGINT that identifies a row.  ``bind`` puts SQL over ``df``, or a
    distribution whose parameters are columns, in the place of a variable's declaration; the
    other variables are drawn as declared, from the key unless ``keyed`` is false (see
    ``with_draws``).
    """
    program = read_program(program) if isinstance(program, str) else program
    bind = dict(bind or {})
    if unknown := set(bind) - set(program.variables):
        raise KeyError(f"not variables of the model: {sorted(unknown)}")
    drawn = {n: bind.get(n, d) for n, d in program.variables.items() if not isinstance(bind.get(n), str)}
    df = df.withColumn("_key", F.expr(key).cast("long"))
    df = df.withColumns({f"_c_{n}": F.expr(sql).cast("double") for n, sql in bind.items() if isinstance(sql, str)})
    df = with_draws(df, "_key" if keyed else None, {f"_d_{n}": d for n, d in drawn.items()}, seed)
    names = {n: f"_d_{n}" if n in drawn else f"_c_{n}" for n in program.formula.names}
    values = program.formula.evaluate(df, keep=["_key"], bind=names).withColumnRenamed("_key", "key")
    if len(program.formula.branches) > 1:
        values = values.withColumn("plus_minus_delta", paired_delta(F.col("plus"), F.col("minus")))
    return values


def report(
    df: DataFrame, key: str, program: Program | str, seed: int, bind: Mapping[str, str | Distribution] | None = None,
    *, quantiles: str = "exact", bins: int = 30, block_rows: int = 5_000, keyed: bool = True, reproducible: bool | None = None,
) -> DataFrame:
    """One row per branch: counts, requested statistics, diagnostics, correlation and histogram.

    Keyed values are drawn once, into a stored table of one column per branch, and all passes
    read that: moments, quantiles, the histogram and, for a fork, the block correlation, with
    blocks of ``block_rows`` neighbouring keys.  Streams (``keyed=False``) are cheap enough to
    draw anew in each pass.  ``exact`` quantiles take further narrowing passes; ``sketch``
    takes one, within the sketch's rank error.  ``reproducible`` sums, the default with keys,
    give the same bits for every partitioning in two more passes.
    What reaches the driver is one state per branch, and counts per bin and piece.
    A model without any finite result raises NoFiniteResult here and now.
    """
    if quantiles not in MODES:
        raise ValueError(f"quantiles must be one of {MODES}")
    program = read_program(program) if isinstance(program, str) else program
    spark, ids = df.sparkSession, measure_ids(program)
    reproducible = keyed if reproducible is None else reproducible
    values = branch_values(df, key, program, seed, bind, keyed)
    if keyed:
        values = stored(values if len(ids) > 1 else values.drop("key"), "values")
    measures = {i: i for i in ids}
    moments = reproducible_moments if reproducible else column_moments
    states = {r["id"]: r for r in moments(values, measures).collect()}
    if not any(s["n"] for s in states.values()):
        raise NoFiniteResult("the model produced no finite result")
    if quantiles == "exact":
        found = exact_quantiles(values, measures).selectExpr("id", "array(p05, p50, p95) AS q").collect()
    else:
        merged = merge_sketches(block_sketches(values, "1L", measures))
        found = merged.selectExpr("id", f"{quantiles_sql()} AS q").collect()
    points = {r["id"]: r["q"] for r in found}
    ranges = {i: (states[i]["low"], states[i]["high"]) for i in ids}
    shapes = {r["id"]: r["histogram"] for r in histogram(values, measures, bins, ranges=ranges).collect()}
    correlation = None
    if len(ids) > 1:
        block = f"floor(key / {block_rows})"
        if reproducible:
            pairs = reproducible_correlation(values, block, "plus", "minus", states).first()
        else:
            pairs = block_correlation(values, block, "plus", "minus").first()
        correlation = pairs["correlation_plus_minus_mean"] if pairs else None
    rows = [
        (i, *[states[i][c] for c in STATE], points[i], correlation if i == "plus_minus_delta" else None, shapes[i].asDict(True))
        for i in ids
    ]
    bin_type = "array<struct<x0:double,x1:double,count:bigint>>"
    schema = (
        "id string, candidates long, n long, mean double, m2 double, low double, high double, q array<double>, correlation double, "
        f"histogram struct<data_min:double,data_max:double,total_count:bigint,bins:{bin_type}>"
    )
    return _shown(spark.createDataFrame(rows, schema), program)


def _shown(states: DataFrame, program: Program) -> DataFrame:
    state = ("n", "candidates", "mean", "m2", "low", "high")
    labels = ", ".join(f"'{x}'" for pair in BRANCHES.items() for x in pair)
    return states.selectExpr(
        "id",
        f"map({labels})[id] AS label",
        "candidates AS candidate_results",
        "n AS valid_results",
        "candidates - n AS discarded_results",
        f"{summary.statistics(program.response, *state, 'q')} AS stats",
        f"{summary.diagnostics(*state)} AS diagnostics",
        "correlation AS correlation_plus_minus_mean",
        "histogram",
    )
