"""Calibration fits by Newton's method: logistic regression and Cox regression.

The fits of all series and of both kinds advance together: a step is one distributed
job over their evaluation rows, of which only a handful of sums per fit come back to
the driver.  Fits that are done take no further part.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma_step, log_gamma_step, trigamma_step
from ..sources.extracts import stacked
from .evaluation import BY, Z95, followed, with_predictor
from .ranking import bucket_edges, later_sums

TOLERANCE = 1e-7  # steps shrink quadratically: the estimate is far closer than this
NO_GAIN = 1e-9  # relative gain in likelihood that counts as none


def _with_series_values(rows: DataFrame, **values: dict[str, float]) -> DataFrame:
    """Attach one number per series and name; the joined table has a dozen rows."""
    names = sorted({s for v in values.values() for s in v})
    records = F.array(*[
        F.struct(
            F.lit(s).alias(BY),
            *[F.lit(float(v.get(s, 0.0))).alias(name) for name, v in values.items()],
        )
        for s in names
    ])
    table = rows.sparkSession.range(1).select(F.inline(records))
    return rows.join(F.broadcast(table), [BY])


def _newton(evaluate, start: dict) -> dict:
    """Maximise one small concave likelihood per key; damped Newton steps.

    ``evaluate(points)`` runs one distributed aggregation over the keys not yet done and
    returns, per key, the log-likelihood, score and information at the key's point.  A step that lowers
    the likelihood is halved.  Steps go on until they are shorter than the tolerance.
    A key has no finite estimate if its information is singular, or if its steps keep
    their length while the likelihood gains nothing (separated outcomes).  Every other
    evaluation gains likelihood or shortens the step, so the loop ends.  Returns
    (estimate, information) of the keys with an estimate.
    """
    point, kept, done = dict(start), {}, {}
    while len(done) < len(start):
        found = evaluate({k: p for k, p in point.items() if k not in done})
        for key in [k for k in start if k not in done]:
            if key not in found:
                done[key] = None
                continue
            loglik, score, info = found[key]
            here = point[key]
            best, at, last, known = kept.get(key, (None, None, None, None))
            if best is not None and not loglik >= best - NO_GAIN * abs(best):
                last = last / 2
                kept[key] = (best, at, last, known)
                point[key] = at + last
                if not np.max(np.abs(last)) >= TOLERANCE:  # nothing better can be told apart
                    done[key] = (at, known)
                continue
            try:
                step = np.linalg.solve(info, score)
            except np.linalg.LinAlgError:
                done[key] = None
                continue
            length = np.max(np.abs(step))
            if not np.isfinite(length):
                done[key] = None
            elif length < TOLERANCE:
                done[key] = (here + step, info)
            elif best is not None and loglik - best <= NO_GAIN * (1 + abs(best)) and length > np.max(np.abs(last)) / 2:
                done[key] = None
            kept[key] = (loglik, here, step, info)
            point[key] = here + step
    return {key: fit for key, fit in done.items() if fit is not None}


def _wald(fit, position: int) -> tuple:
    """Estimate and 95 % limits of one coefficient; unknown if it was not fitted."""
    if fit is None:
        return (None, None, None)
    estimate, info = fit
    se = math.sqrt(np.linalg.inv(info)[position, position])
    value = float(estimate[position])
    return (value, value - Z95 * se, value + Z95 * se)


def calibrations(
    logistic: DataFrame | None, cox: DataFrame | None, edges: list[float] | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Logistic and Cox calibration of two sets of rows, their fits advanced together.

    One job finds where the fits start, then each Newton step is one job for all of
    them.  ``edges`` are cuts of the follow-up times, worked out here if not given.
    Frames are as :func:`logistic_calibration` and :func:`cox_calibration` give them.
    """
    binary = None if logistic is None else with_predictor(logistic)
    survival = None if cox is None else with_predictor(followed(cox))
    kinds = {"logistic": binary, "cox": survival}
    summaries = [
        rows.groupBy(BY).agg(F.avg("outcome").alias("y"), F.avg("lp").alias("x")).withColumn("kind", F.lit(kind))
        for kind, rows in kinds.items() if rows is not None
    ]
    centre, start = {kind: {} for kind in kinds}, {}
    for r in stacked(summaries).collect():  # one row per series
        centre[r["kind"]][r[BY]] = r["x"]
        if r["kind"] == "cox":
            start[r[BY], "cox"] = np.zeros(1)
        elif 0 < r["y"] < 1:
            start[r[BY], "fixed"] = np.zeros(1)
            start[r[BY], "free"] = np.array([math.log(r["y"] / (1 - r["y"])), 0.0])
    if centre["cox"] and edges is None:
        edges = bucket_edges(survival, ["years"])[0]

    def evaluate(point):
        at = {kind: {s: v for (s, k), v in point.items() if k == kind} for kind in ("fixed", "free", "cox")}
        sums = []
        if at["fixed"] or at["free"]:
            sums.append(_logistic_sums(binary, centre["logistic"], at["fixed"], at["free"]))
        if at["cox"]:
            sums.append(_cox_sums(survival, centre["cox"], at["cox"], edges))
        out = {}
        for r in stacked(sums).collect():  # one row per fit
            key = (r[BY], r["kind"])
            if r["kind"] == "free":
                score, info = [r["u0"], r["u1"]], [[r["i0"], r["i1"]], [r["i1"], r["i2"]]]
            else:
                score, info = [r["u0"]], [[r["i0"]]]
            if key in point:
                out[key] = (r["loglik"], np.array(score), np.array(info))
        return out

    fits = _newton(evaluate, start)
    shapes = {"logistic": (("fixed", 0, "intercept"), ("free", 1, "slope")), "cox": (("cox", 0, "slope"),)}

    def frame(kind):
        rows, parts = kinds[kind], shapes[kind]
        if rows is None:
            return None
        schema = ", ".join(f"{name}{end} double" for *_, name in parts for end in ("", "_low", "_high"))
        return rows.sparkSession.createDataFrame(
            [(s, *[v for k, i, _ in parts for v in _wald(fits.get((s, k)), i)]) for s in centre[kind]],
            f"{BY} string, {schema}",
        )

    return frame("logistic"), frame("cox")


def logistic_calibration(rows: DataFrame) -> DataFrame:
    """Calibration intercept (slope fixed at 1) and slope, with Wald intervals, per series."""
    return calibrations(rows, None)[0]


def cox_calibration(rows: DataFrame) -> DataFrame:
    """Cox slope of the linear predictor with its Wald interval, Efron's ties, per series.

    Rows are reduced to one row per series and follow-up time, where risk-set sums
    are totals of later times and tied events enter in closed form.
    """
    return calibrations(None, rows)[1]


def _logistic_sums(rows: DataFrame, centre: dict, fixed: dict, free: dict) -> DataFrame:
    """Log-likelihood, score and information of both logistic fits, one row per fit."""
    y, x = F.col("outcome"), F.col("lp") - F.col("centre")  # centring leaves the slope alone
    wanted = {s: centre[s] for s in {*fixed, *free}}
    frame = _with_series_values(
        rows, centre=wanted, shift={s: v[0] for s, v in fixed.items()},
        a={s: v[0] for s, v in free.items()}, b={s: v[1] for s, v in free.items()},
    ).select(
        BY, y.alias("y"), x.alias("x"), (F.col("shift") + F.col("lp")).alias("eta_fixed"),
        (F.col("a") + F.col("b") * x).alias("eta_free"),
    )
    sums, fits = [], []
    for kind in ("fixed", "free"):
        eta, y, x = F.col(f"eta_{kind}"), F.col("y"), F.col("x")
        p = 1 / (1 + F.exp(-eta))
        softplus = F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta)))
        terms = {
            "loglik": y * eta - softplus, "u0": y - p, "u1": (y - p) * x,
            "i0": p * (1 - p), "i1": p * (1 - p) * x, "i2": p * (1 - p) * x * x,
        }
        sums += [F.sum(term).alias(f"{kind}_{name}") for name, term in terms.items()]
        fits.append(F.struct(F.lit(kind).alias("kind"), *[F.col(f"{kind}_{name}").alias(name) for name in terms]))
    return frame.groupBy(BY).agg(*sums).select(BY, F.inline(F.array(*fits)))


def _cox_sums(rows: DataFrame, centre: dict, point: dict, edges: list[float]) -> DataFrame:
    """Log-likelihood, score and information of the Cox fits, one row per fit."""
    placed = _with_series_values(
        rows, centre={s: centre[s] for s in point}, beta={s: v[0] for s, v in point.items()}
    ).select(BY, "years", "outcome", "beta", (F.col("lp") - F.col("centre")).alias("x"))
    return _efron_sums(placed, edges).select(
        BY, F.lit("cox").alias("kind"), "loglik", F.col("score").alias("u0"), F.col("info").alias("i0"),
        *[F.lit(None).cast("double").alias(name) for name in ("u1", "i1", "i2")],  # one coefficient only
    )


def fitted_direction(rows: DataFrame, edges: list[float] | None = None) -> DataFrame:
    """Sign of the Cox coefficient the risk itself would get, per series.

    The partial likelihood is concave, so the sign is that of its slope at zero:
    one pass, no fit.
    """
    rows = followed(rows)
    points = rows.select(BY, "years", "outcome", F.lit(0.0).alias("beta"), F.col("risk").alias("x"))
    edges = bucket_edges(rows, ["years"])[0] if edges is None else edges
    return _efron_sums(points, edges).select(
        BY, F.signum("score").alias("direction")
    )


def _efron_sums(points: DataFrame, edges: list[float]) -> DataFrame:
    """Partial log-likelihood, its score and information at the rows' ``beta``, per series.

    With ``d`` events at a time, whose weights sum to ``e0``, and ``s0`` the sum over all at
    risk, Efron's terms divide by ``s0 - l * e0 / d = (e0 / d) * (a - l)`` for ``l`` from 0 to
    ``d - 1``, where ``a = d * s0 / e0``.  Their sums are differences of the log-gamma,
    digamma and trigamma functions at ``a + 1`` and ``a - d + 1``.
    """
    x, event = F.col("x"), F.col("outcome") == 1
    moments = {"0": F.col("w"), "1": F.col("w") * x, "2": F.col("w") * x * x}
    by_time = points.withColumn("w", F.exp(F.col("beta") * x)).groupBy(BY, "years", "beta").agg(
        F.sum("outcome").cast("double").alias("d"),
        F.sum(F.when(event, x)).alias("sx"),
        *[F.sum(F.when(event, m).otherwise(0.0)).alias(f"e{k}") for k, m in moments.items()],
        *[F.sum(F.when(event, 0.0).otherwise(m)).alias(f"c{k}") for k, m in moments.items()],
    ).withColumns({f"t{k}": F.col(f"e{k}") + F.col(f"c{k}") for k in moments})
    placed = later_sums(by_time, "years", ["t0", "t1", "t2"], edges, [BY]).where(F.col("d") > 0)
    # others at risk: followed longer, or censored at this time
    others = {k: F.col(f"later_t{k}") + F.col(f"c{k}") for k in moments}
    d, e0 = F.col("d"), F.col("e0")
    terms = placed.select(
        BY, "beta", "sx", "d", "e0",
        (F.col("e1") / e0).alias("mean"), (F.col("e2") / e0).alias("square"),
        # what the risk set's moments exceed those of the events' by, in units of a - l
        ((others["1"] - F.col("e1") * others["0"] / e0) * d / e0).alias("more1"),
        ((others["2"] - F.col("e2") * others["0"] / e0) * d / e0).alias("more2"),
        (d * others["0"] / e0 + 1).alias("low"),
    )
    low = F.col("low")
    terms = terms.select(
        "*", log_gamma_step(low, d).alias("logs"), digamma_step(low, d).alias("inverses"),
        trigamma_step(low, d).alias("inverse_squares"),
    )
    mean, more = F.col("mean"), F.col("more1")
    return terms.groupBy(BY).agg(
        F.sum(F.col("beta") * F.col("sx") - d * F.ln(e0 / d) - F.col("logs")).alias("loglik"),
        F.sum(F.col("sx") - d * mean - more * F.col("inverses")).alias("score"),
        F.sum(
            d * F.col("square") + F.col("more2") * F.col("inverses")
            - d * mean * mean - 2 * mean * more * F.col("inverses") - more * more * F.col("inverse_squares")
        ).alias("info"),
    )
