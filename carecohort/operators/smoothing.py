"""Smoothed calibration curves: penalised natural cubic splines in their cardinal form.

The spline is given by its values at knots; its second derivatives there, and so its
curvature penalty, follow from the values in closed form.  Inside an interval between
knots every basis function is a cubic in the place ``t`` within the interval, so the system
to solve is made of sums of powers of ``t``: one aggregation for all series gives a dozen
numbers per interval.  The sums are decimals, so they don't depend on the order of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import BY
from .ranking import bucket_edges, running_sums

KNOTS, POINTS = 10, 80


@dataclass(frozen=True)
class System:
    """Normal equations of one series: knots, cross-products, response, penalty, and sums."""

    knots: np.ndarray
    gram: np.ndarray
    response: np.ndarray
    penalty: np.ndarray
    n: int
    cases: float  # outcomes are 0 or 1, so this is also the sum of their squares


def exact_knots(rows: DataFrame, knots: int = KNOTS) -> dict[str, np.ndarray]:
    """Per series, points evenly placed among its distinct risks, ends included; exact ranks.

    A series of fewer distinct risks has each of them as a knot.
    """
    cells = rows.groupBy(BY, "risk").agg(F.lit(1).cast("bigint").alias("one"))
    ranked = running_sums(cells, "risk", ["one"], bucket_edges(rows, ["risk"])[0], [BY])
    size = cells.groupBy(BY).agg(F.count(F.lit(1)).alias("m"))
    last = F.least(F.col("m"), F.lit(knots)) - 1
    step = F.col("knot") * (F.col("m") - 1)
    wanted = (
        size.withColumn("knot", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        .withColumn("low", F.when(last > 0, F.floor(step / last)).otherwise(0).cast("bigint"))
        .withColumn("part", F.when(last > 0, (step - F.col("low") * last) / last).otherwise(0.0))
        # the risk at ``low`` and the next one, by their shares
        .select(BY, "knot", F.inline(F.array(
            F.struct(F.col("low").alias("before_one"), (1 - F.col("part")).alias("share")),
            F.struct((F.col("low") + 1).alias("before_one"), F.col("part").alias("share")),
        )))
        .where(F.col("share") > 0)
    )
    placed = (
        ranked.join(F.broadcast(wanted), [BY, "before_one"])  # twenty rows per series
        .groupBy(BY, "knot").agg(F.sum(F.col("risk") * F.col("share")).alias("risk"))
    )
    found: dict[str, list] = {}
    for r in placed.orderBy(BY, "knot").collect():
        found.setdefault(r[BY], []).append(r["risk"])
    return {s: np.array(v) for s, v in found.items()}


def _moments(rows: DataFrame, knots: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per series, one row per interval: sums of t**0 .. t**6, then of outcome * t**0 .. t**3."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(s, v.tolist()) for s, v in knots.items()], f"{BY} string, _knots array<double>")
    at, risk = F.col("_knots"), F.col("risk")
    inner = F.slice(at, F.lit(2), F.greatest(F.size(at) - 2, F.lit(0)))
    placed = (
        rows.groupBy(BY, "risk").agg(F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("y"))
        .join(F.broadcast(table), [BY])  # one row per series
        .withColumn("_i", F.size(F.filter(inner, lambda k: k <= risk)))
        .withColumn("_low", F.get(at, F.col("_i")))
        .withColumn("_width", F.coalesce(F.get(at, F.col("_i") + 1), F.col("_low")) - F.col("_low"))
        .withColumn("_t", F.when(F.col("_width") > 0, (risk - F.col("_low")) / F.col("_width")).otherwise(0.0))
    )
    power = lambda m: F.pow(F.col("_t"), F.lit(m)).cast("decimal(19,18)")
    total = lambda weight, m: F.sum((power(m) * F.col(weight).cast("decimal(19,0)")).cast("decimal(38,18)"))
    sums = placed.groupBy(BY, "_i").agg(
        *[total("n", m).alias(f"n{m}") for m in range(7)], *[total("y", m).alias(f"y{m}") for m in range(4)]
    )
    out = {s: np.zeros((max(len(v) - 1, 1), 11)) for s, v in knots.items()}
    for r in sums.collect():  # one row per series and interval
        out[r[BY]][r["_i"]] = [float(r[f"n{m}"]) for m in range(7)] + [float(r[f"y{m}"]) for m in range(4)]
    return out


def curvatures(knots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Second derivatives at the knots as a linear map of the values there, and the integral of their square."""
    k, h = len(knots), np.diff(knots)
    if k < 3:
        return np.zeros((k, k)), np.zeros((k, k))
    inner, across = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        inner[i, i : i + 3] = 1 / h[i], -1 / h[i] - 1 / h[i + 1], 1 / h[i + 1]
        across[i, i] = (h[i] + h[i + 1]) / 3
        if i:
            across[i, i - 1] = across[i - 1, i] = h[i] / 6
    second = np.zeros((k, k))
    second[1:-1] = np.linalg.solve(across, inner)
    return second, inner.T @ second[1:-1]


def _interval_map(knots: np.ndarray, second: np.ndarray, i: int) -> np.ndarray:
    """Coefficients of 1, t, t**2, t**3 (rows) of each cardinal basis function on interval ``i``."""
    h = knots[i + 1] - knots[i]
    low, high = np.eye(len(knots))[[i, i + 1]]
    bend = h * h / 6
    return np.array([
        low,
        high - low - bend * (2 * second[i] + second[i + 1]),
        3 * bend * second[i],
        bend * (second[i + 1] - second[i]),
    ])


def basis(knots: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Cardinal basis functions (columns) at points within the knots."""
    if len(knots) == 1:
        return np.ones((len(points), 1))
    second, _ = curvatures(knots)
    at = np.clip(np.searchsorted(knots, points, side="right") - 1, 0, len(knots) - 2)
    t = (points - knots[at]) / np.diff(knots)[at]
    return np.array([
        (u ** np.arange(4)) @ _interval_map(knots, second, i) for i, u in zip(at, t, strict=True)
    ])


def calibration_systems(rows: DataFrame, knots: int = KNOTS) -> dict[str, System]:
    """The system of every series; bounded by the square of the number of knots."""
    placed = exact_knots(rows, knots)
    out = {}
    for series, sums in _moments(rows, placed).items() if placed else ():
        at = placed[series]
        second, penalty = curvatures(at)
        gram, response = np.zeros((len(at), len(at))), np.zeros(len(at))
        for i, row in enumerate(sums):
            maps = _interval_map(at, second, i) if len(at) > 1 else np.eye(4, 1)
            powers = np.array([[row[a + b] for b in range(4)] for a in range(4)])
            gram += maps.T @ powers @ maps
            response += maps.T @ row[7:]
        out[series] = System(at, gram, response, penalty, round(sums[:, 0].sum()), float(sums[:, 7].sum()))
    return out


def _solved(system: System, strength: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, inverse of the penalised system, and residual variance."""
    inverse = np.linalg.pinv(system.gram + strength * system.penalty, hermitian=True)
    values = inverse @ system.response
    residual = system.cases - 2 * values @ system.response + values @ system.gram @ values
    free = system.n - np.trace(inverse @ system.gram)
    return values, inverse, max(residual, 0.0) / free if free > 1e-9 else 0.0


def likely_strength(system: System) -> float:
    """Penalty of the greatest restricted likelihood: a scan in steps of a twentieth, then thirds."""
    k = len(system.knots)
    if k < 3:
        return 0.0
    unit = np.trace(system.gram) / np.trace(system.penalty)

    def loss(power: float) -> float:
        whole = system.gram + unit * 10**power * system.penalty
        sign, log_det = np.linalg.slogdet(whole)
        left = system.cases - system.response @ np.linalg.solve(whole, system.response)
        if sign <= 0 or left <= 0:
            return np.inf
        return (system.n - 2) * np.log(left) + log_det - (k - 2) * power * np.log(10)

    scan = np.linspace(-8, 6, 281)
    at = int(np.argmin([loss(p) for p in scan]))
    low, high = scan[max(at - 1, 0)], scan[min(at + 1, len(scan) - 1)]
    for _ in range(60):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return unit * 10 ** ((low + high) / 2)


def smoothed_calibration(
    rows: DataFrame, knots: int = KNOTS, points: int = POINTS, strength: float | None = None
) -> DataFrame:
    """Smoothed observed rate over an even grid of risks, with a 95 % band, per series.

    ``strength`` weighs the integral of the squared second derivative against squared
    errors; without it the restricted likelihood chooses it.  A series of two distinct
    risks gets a line, of one risk a single point.
    """
    out = []
    for series, system in calibration_systems(rows, knots).items():
        at = system.knots
        values, inverse, variance = _solved(system, likely_strength(system) if strength is None else strength)
        grid = np.linspace(at[0], at[-1], points) if len(at) > 1 else at
        design = basis(at, grid)
        fit = design @ values
        half = 1.96 * np.sqrt(np.maximum(np.sum(design @ inverse * design, axis=1) * variance, 0.0))
        out += [
            (series, i + 1, float(g), float(f), float(f - e), float(f + e))
            for i, (g, f, e) in enumerate(zip(grid, fit, half, strict=True))
        ]
    return rows.sparkSession.createDataFrame(
        out, f"{BY} string, point int, risk double, observed double, low double, high double"
    )


def smoothed_calibration_system(rows: DataFrame, knots: int = KNOTS) -> DataFrame:
    """The systems as a table: (series, i, j, knot, product, response) for j from i on."""
    out = [
        (series, i + 1, j + 1, float(s.knots[i]), float(s.gram[i, j]), float(s.response[i]))
        for series, s in calibration_systems(rows, knots).items()
        for i in range(len(s.knots)) for j in range(i, len(s.knots))
    ]
    return rows.sparkSession.createDataFrame(
        out, f"{BY} string, i int, j int, knot double, product double, response double"
    )
