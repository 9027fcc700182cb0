"""Exact quantiles of unbounded columns by repeated narrowing.

Each round cuts the values still in question at a few approximate quantiles around the
wanted rank, counts every piece exactly, and keeps only the piece that holds the rank.
A piece is either one single value or an open interval, so heavy duplicates end the
search instead of slowing it down.  A round leaves about 1/2000 of the rows, and its
bounds are literals that reach the scan as filters.  Rows are never gathered: the driver
sees one row of counts per piece, and the last step sorts at most ``small`` values per
target.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quincunx.operators.moments import finite_sql
from quincunx.operators.sketch import PROBABILITIES

SMALL = 65_536  # values that the last step may sort; no result depends on it
ACCURACY = 10_000  # percentile_approx is off by at most rows / ACCURACY ranks
GRID = 255  # cuts per round where rank and row number differ, as with weights


@dataclass
class Target:
    """The point at which the cumulative weight of one measure first reaches ``mass``."""

    measure: str
    mass: float
    low: float = -math.inf  # open interval that holds the answer
    high: float = math.inf
    before: float = 0.0  # weight of everything at or below ``low``
    value: float | None = None
    weight: float = 0.0

    @property
    def interval(self) -> tuple[str, float, float]:
        return self.measure, self.low, self.high


def _literal(x: float) -> str:
    return f"double('{x}')" if math.isinf(x) else f"({x!r}D)"


def _piece_sql(points: list[float], a: int = 0, b: int | None = None) -> str:
    """Piece of a value: 2k for the gap below points[k], 2k+1 for points[k] itself."""
    b = len(points) if b is None else b
    if a == b:
        return str(2 * a)
    m = (a + b) // 2
    x = _literal(points[m])
    return (
        f"CASE WHEN v < {x} THEN {_piece_sql(points, a, m)} WHEN v = {x} THEN {2 * m + 1} "
        f"ELSE {_piece_sql(points, m + 1, b)} END"
    )


def _stack(df: DataFrame, measures: Mapping[str, str], weight: str = "1L") -> DataFrame:
    """(measure, v, w) rows of the finite values."""
    rows = [f"struct('{m}' AS measure, {finite_sql(sql)} AS v, {weight} AS w)" for m, sql in measures.items()]
    if len(rows) == 1:
        (m, sql), = measures.items()
        out = df.selectExpr(f"'{m}' AS measure", f"{finite_sql(sql)} AS v", f"{weight} AS w")
    else:
        out = df.selectExpr(f"inline(array({', '.join(rows)}))")
    return out.where("v IS NOT NULL")


def _tag(rows: DataFrame, intervals: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Keeps the rows inside one of the disjoint open intervals, tagged with its number."""
    cases = " ".join(
        f"WHEN measure = '{m}' AND v > {_literal(lo)} AND v < {_literal(hi)} THEN {k}"
        for k, (m, lo, hi) in enumerate(intervals)
    )
    return rows.withColumn("interval", F.expr(f"CASE {cases} END")).where(F.col("interval").isNotNull())


Rows = Callable[[Sequence[tuple[str, float, float]]], DataFrame]


def _table_rows(df: DataFrame, measures: Mapping[str, str]) -> Rows:
    """(measure, v, w, interval) rows of a table; the bounds also reach its scan."""

    def rows(intervals):
        inside = [f"({measures[m]} > {_literal(lo)} AND {measures[m]} < {_literal(hi)})" for m, lo, hi in intervals]
        used = {m: sql for m, sql in measures.items() if any(m == i[0] for i in intervals)}
        return _tag(_stack(df.where(" OR ".join(inside)), used), intervals)

    return rows


def _cuts(fractions: Sequence[float]) -> list[float]:
    """Percentages that enclose each rank fraction despite the approximation."""
    off = 2.0 / ACCURACY
    return sorted({min(1.0, max(0.0, f + d)) for f in fractions for d in (-off, 0.0, off)})


def _grids(rows: Rows, cuts: Mapping[tuple, list[float]]) -> dict[tuple, list[float]]:
    """Approximate quantiles of every interval, at the percentages asked for it."""
    intervals = list(cuts)
    cases = [f"WHEN interval = {k} THEN v" for k in range(len(intervals))]
    found = rows(intervals).selectExpr(*[
        f"percentile_approx(CASE {case} END, array({', '.join(f'{p!r}D' for p in cuts[i])}), {ACCURACY}) AS g{k}"
        for k, (i, case) in enumerate(zip(intervals, cases))
    ]).first()
    return {i: sorted(set(found[k])) for k, i in enumerate(intervals) if found[k]}


def locate(
    rows: Rows,
    targets: Sequence[Target],
    sizes: dict[tuple, int],
    small: int = SMALL,
    weighted: bool = False,
    grids: dict[tuple, list[float]] | None = None,
) -> None:
    """Fills in value, weight and before of every target from the (measure, v, w, interval)
    rows that ``rows`` gives for some intervals.

    ``sizes`` holds the number of rows of each interval, ``grids`` the cuts of the first
    round where they are known already.
    """
    while True:
        open_targets = [t for t in targets if t.value is None]
        if not open_targets:
            return
        wide = sorted({t.interval for t in open_targets if sizes[t.interval] > small})
        if not wide:
            _finish(rows, open_targets, sorted({t.interval for t in open_targets}))
            return
        if grids is None:
            uniform = [(k + 1) / (GRID + 1) for k in range(GRID)]
            cuts = {
                i: uniform if weighted else _cuts([
                    (t.mass - t.before) / sizes[i] for t in open_targets if t.interval == i
                ])
                for i in wide
            }
            grids = _grids(rows, cuts)
            if len(grids) < len(wide):
                raise RuntimeError("the input changed between passes")
        cases = " ".join(f"WHEN interval = {k} THEN {_piece_sql(grids[i])}" for k, i in enumerate(wide))
        pieces: dict[tuple, dict[int, tuple[int, float]]] = {i: {} for i in wide}
        for r in (
            rows(wide)
            .withColumn("piece", F.expr(f"CASE {cases} END"))
            .groupBy("interval", "piece")
            .agg(F.count("*").alias("rows"), F.sum("w").alias("w"))
            .collect()
        ):
            pieces[wide[r["interval"]]][r["piece"]] = (r["rows"], r["w"])
        for t in open_targets:
            if t.interval in grids:
                _narrow(t, grids[t.interval], pieces[t.interval], sizes)
        grids = None


def _narrow(t: Target, grid: list[float], pieces: dict[int, tuple[int, float]], sizes: dict) -> None:
    low, high, before = t.low, t.high, t.before
    for piece in sorted(pieces):
        rows, weight = pieces[piece]
        last = piece == max(pieces)
        if before + weight < t.mass and not last:
            before += weight
            continue
        t.before = before
        if piece % 2:
            t.value, t.weight = grid[piece // 2], weight
        else:
            t.low = grid[piece // 2 - 1] if piece else low
            t.high = grid[piece // 2] if piece // 2 < len(grid) else high
            sizes[t.interval] = rows
        return


def _finish(rows: Rows, targets: list[Target], intervals: list[tuple]) -> None:
    """Sorts the few values left per interval and reads the answers off."""
    running = Window.partitionBy("interval").orderBy("v")
    masses: dict[int, list[Target]] = {}
    for t in targets:
        masses.setdefault(intervals.index(t.interval), []).append(t)
    hits = " OR ".join(
        f"(interval = {k} AND reached - w < {_literal(t.mass - t.before)} AND (reached >= {_literal(t.mass - t.before)} OR next IS NULL))"
        for k, ts in masses.items()
        for t in ts
    )
    found = (
        rows(intervals)
        .groupBy("interval", "v")
        .agg(F.sum("w").alias("w"))
        .withColumn("reached", F.sum("w").over(running.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("next", F.lead("v").over(running))
        .where(F.expr(hits))
        .collect()
    )
    for r in found:
        for t in masses[r["interval"]]:
            wanted = t.mass - t.before
            if t.value is None and r["reached"] - r["w"] < wanted and (r["reached"] >= wanted or r["next"] is None):
                t.value, t.weight, t.before = r["v"], r["w"], t.before + r["reached"] - r["w"]
    for t in targets:
        if t.value is None:
            raise RuntimeError(f"rank {t.mass} of {t.measure} was not found; the input changed between passes")


def exact_quantiles(
    df: DataFrame,
    measures: Mapping[str, str],
    probabilities: Sequence[float] = PROBABILITIES,
    names: Sequence[str] = ("p05", "p50", "p95"),
    small: int = SMALL,
) -> DataFrame:
    """One row per measure with linearly interpolated quantiles of its finite values."""
    finite = {m: finite_sql(sql) for m, sql in measures.items()}
    cuts = _cuts(probabilities)
    points = ", ".join(f"{p!r}D" for p in cuts)
    head = df.selectExpr(*[
        f"struct(count({sql}) AS n, percentile_approx({sql}, array({points}), {ACCURACY}) AS grid) AS {m}"
        for m, sql in finite.items()
    ]).first()
    counted = {m: head[m]["n"] for m in measures}

    wanted: dict[tuple[str, int], Target] = {}
    for m, n in counted.items():
        for p in probabilities if n else ():
            k = math.floor(p * (n - 1))
            for rank in (k, min(k + 1, n - 1)):
                wanted.setdefault((m, rank), Target(m, rank + 0.5))
    whole = {m: (m, -math.inf, math.inf) for m, n in counted.items() if n}
    locate(
        _table_rows(df, measures),
        list(wanted.values()),
        {i: counted[m] for m, i in whole.items()},
        small,
        grids={i: sorted(set(head[m]["grid"])) for m, i in whole.items() if counted[m] > small},
    )

    out = []
    for m, n in counted.items():
        row: list = [m]
        for p in probabilities:
            place = p * (n - 1)
            k = math.floor(place)
            if not n:
                row.append(None)
                continue
            a, b = wanted[m, k].value, wanted[m, min(k + 1, n - 1)].value
            row.append(a if a == b else a + (b - a) * (place - k))
        out.append(row)
    schema = "id string, " + ", ".join(f"{name} double" for name in names)
    return df.sparkSession.createDataFrame(out, schema)


def weighted_quantiles(
    df: DataFrame, center: str, weight: str, probabilities: Sequence[float] = PROBABILITIES, *, method: str = "linear",
    small: int = SMALL,
) -> DataFrame:
    """(probability, value) of weighted points held in a table.

    Points with equal centers count together and those without positive weight not at all.
    ``step`` gives the first center at which the cumulative weight reaches the probability;
    ``linear`` interpolates between the mid-weights of neighbouring centers.
    """
    if method not in ("step", "linear"):
        raise ValueError("method must be step or linear")
    points = df.selectExpr("'points' AS measure", f"cast({center} AS double) AS v", f"cast({weight} AS double) AS w")
    values = _weighted_values(points.where("w > 0 AND v IS NOT NULL"), probabilities, method, small)
    return df.sparkSession.createDataFrame(
        [(float(p), v) for p, v in zip(probabilities, values)], "probability double, value double"
    )


def _weighted_values(points: DataFrame, probabilities: Sequence[float], method: str, small: int) -> list[float | None]:
    uniform = ", ".join(f"{(k + 1) / (GRID + 1)!r}D" for k in range(GRID))
    head = points.agg(
        F.count("*").alias("n"), F.sum("w").alias("total"),
        F.expr(f"percentile_approx(v, array({uniform}), {ACCURACY})").alias("grid"),
    ).first()
    if not head["n"]:
        return [None] * len(probabilities)
    targets = [Target("points", p * float(head["total"])) for p in probabilities]
    whole, n = targets[0].interval, head["n"]
    grids = {whole: sorted(set(head["grid"]))} if n > small else None
    locate(lambda intervals: _tag(points, intervals), targets, {whole: n}, small, weighted=True, grids=grids)
    return [t.value for t in targets] if method == "step" else _interpolate(points, targets)


def _interpolate(points: DataFrame, targets: list[Target]) -> list[float]:
    """Between the located point and the neighbour on the other side of the wanted mass."""
    sides = []
    for k, t in enumerate(targets):
        sides += [f"max(v) FILTER (WHERE v < {_literal(t.value)}) AS below{k}", f"min(v) FILTER (WHERE v > {_literal(t.value)}) AS above{k}"]
    row = points.selectExpr(*sides).first()
    near = sorted({x for x in row if x is not None})
    weights = {}
    if near:
        held = points.where(f"v IN ({', '.join(map(_literal, near))})").groupBy("v").agg(F.sum("w").alias("w"))
        weights = {r["v"]: r["w"] for r in held.collect()}
    out = []
    for k, t in enumerate(targets):
        middle = t.before + 0.5 * t.weight
        other = row[f"below{k}"] if t.mass < middle else row[f"above{k}"]
        if other is None or t.mass == middle:
            out.append(t.value)
        elif t.mass < middle:
            start = t.before - 0.5 * weights[other]
            out.append(other + (t.value - other) * (t.mass - start) / (middle - start))
        else:
            end = t.before + t.weight + 0.5 * weights[other]
            out.append(t.value + (other - t.value) * (t.mass - middle) / (end - middle))
    return out
