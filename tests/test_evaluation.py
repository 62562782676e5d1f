import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from carecohort import api
from carecohort.functions import special
from carecohort.operators import calibration, discrimination, evaluation, fits, netbenefit, smoothing
from carecohort.operators.evaluation import BY

SCHEMA = "series string, pat_id int, outcome int, risk double, lp double, years double"


def make(n=240, seed=3, ties=True):
    rng = random.Random(seed)
    out = []
    for series in ("m1", "m2"):
        for i in range(n):
            lp = rng.gauss(-1.0, 1.0)
            risk = 1 / (1 + math.exp(-lp))
            if ties:
                risk = round(risk, 1)
            y = int(rng.random() < 1 / (1 + math.exp(-0.8 * lp)))
            out.append((series, i, y, risk, lp, round(rng.choice([1, 2, 3.5, 7, 9.99]) * rng.random(), 1)))
    return out


def daily(rows, seed=3):
    """The rows with follow-up in days, as years without rounding."""
    rng = random.Random(seed)
    return [(*r[:5], rng.randrange(-400, 3653) / 365.25) for r in rows]


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def of(rows, series):
    return [r for r in rows if r[0] == series]


def test_auc_matches_all_pairs(frame, rows):
    got = {r[BY]: r for r in discrimination.auc(frame).collect()}
    for s in ("m1", "m2"):
        part = of(rows, s)
        cases = [r[3] for r in part if r[2] == 1]
        controls = [r[3] for r in part if r[2] == 0]
        won = np.array([[(a > b) + 0.5 * (a == b) for b in controls] for a in cases])
        auc = won.mean()
        var = won.mean(axis=1).var(ddof=1) / len(cases) + won.mean(axis=0).var(ddof=1) / len(controls)
        r = got[s]
        assert r["auc"] == pytest.approx(auc)
        assert r["auc_high"] - r["auc"] == pytest.approx(evaluation.Z95 * math.sqrt(var))


def test_auc_direction_follows_the_medians(spark, rows):
    reversed_risk = [(s, i, y, -p, lp, t) for s, i, y, p, lp, t in rows]
    a = {r[BY]: r["auc"] for r in discrimination.auc(spark.createDataFrame(rows, SCHEMA)).collect()}
    b = {r[BY]: r["auc"] for r in discrimination.auc(spark.createDataFrame(reversed_risk, SCHEMA)).collect()}
    assert a == pytest.approx(b)


def test_auc_of_equal_scores_is_one_half(spark):
    df = spark.createDataFrame([("m", i, i % 2, 0.3, 0.0, 1.0) for i in range(20)], SCHEMA)
    assert discrimination.auc(df).first()["auc"] == 0.5


@pytest.mark.parametrize("times", [list, daily])
@pytest.mark.parametrize("ties", [True, False])
def test_concordance_matches_all_pairs(spark, ties, times):
    rows = times(make(150, 5, ties))
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {r[BY]: r for r in discrimination.concordance(frame, as_fitted=False).collect()}
    for s in ("m1", "m2"):
        part = of(rows, s)
        usable = concordant = tied = 0
        for a in part:
            for b in part:
                if a[2] == 1 and b[5] > a[5]:
                    usable += 1
                    concordant += a[3] > b[3]
                    tied += a[3] == b[3]
        r = got[s]
        assert (r["usable"], r["concordant"], r["tied"]) == (usable, concordant, tied)
        assert r["cindex"] == pytest.approx((concordant + tied / 2) / usable)


def test_concordance_ignores_monotone_changes(spark, rows):
    changed = [(s, i, y, math.exp(p) * 3, lp, t) for s, i, y, p, lp, t in rows]
    a = discrimination.concordance(spark.createDataFrame(rows, SCHEMA)).orderBy(BY).collect()
    b = discrimination.concordance(spark.createDataFrame(changed, SCHEMA)).orderBy(BY).collect()
    assert a == b


def test_concordance_turns_a_risk_that_predicts_backwards(spark, rows):
    backwards = [(s, i, y, -p, lp, t) for s, i, y, p, lp, t in rows]
    a = {r[BY]: r["cindex"] for r in discrimination.concordance(spark.createDataFrame(rows, SCHEMA)).collect()}
    b = {r[BY]: r["cindex"] for r in discrimination.concordance(spark.createDataFrame(backwards, SCHEMA)).collect()}
    assert a == pytest.approx(b)
    for s, sign in ((s, efron([(*r[:4], r[3], r[5]) for r in of(rows, s)], 0.0)[0]) for s in ("m1", "m2")):
        plain = discrimination.concordance(spark.createDataFrame(of(rows, s), SCHEMA), as_fitted=False).first()["cindex"]
        assert a[s] == pytest.approx(plain if sign >= 0 else 1 - plain)


def test_concordance_without_events(spark):
    df = spark.createDataFrame([("m", i, 0, 0.1 * i, 0.0, float(i)) for i in range(5)], SCHEMA)
    r = discrimination.concordance(df).first()
    assert r["usable"] == 0 and r["cindex"] is None


def test_logistic_scores_vanish(frame, rows):
    got = {r[BY]: r for r in fits.logistic_calibration(frame).collect()}
    for s in ("m1", "m2"):
        part = of(rows, s)
        y, x = np.array([r[2] for r in part]), np.array([r[4] for r in part])
        a = got[s]["intercept"]
        assert np.sum(y - 1 / (1 + np.exp(-(a + x)))) == pytest.approx(0, abs=1e-6)
        b = got[s]["slope"]
        lo, hi = -20.0, 20.0  # intercept belonging to the slope, by bisection
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if np.sum(y - 1 / (1 + np.exp(-(mid + b * x)))) > 0 else (lo, mid)
        assert np.sum((y - 1 / (1 + np.exp(-(mid + b * x)))) * x) == pytest.approx(0, abs=1e-5)
        assert got[s]["slope_low"] < b < got[s]["slope_high"]


def efron(part, beta):
    score = info = 0.0
    for t in sorted({r[5] for r in part if r[2] == 1}):
        risk = [r for r in part if r[5] >= t]
        dead = [r for r in part if r[5] == t and r[2] == 1]
        for l in range(len(dead)):
            f = l / len(dead)
            s = [
                sum(r[4] ** k * math.exp(beta * r[4]) for r in risk)
                - f * sum(r[4] ** k * math.exp(beta * r[4]) for r in dead)
                for k in range(3)
            ]
            score -= s[1] / s[0]
            info += s[2] / s[0] - (s[1] / s[0]) ** 2
        score += sum(r[4] for r in dead)
    return score, info


@pytest.mark.parametrize("times", [list, daily])
def test_cox_slope_with_ties(spark, times):
    rows = times(make(120, 9))
    got = {r[BY]: r for r in fits.cox_calibration(spark.createDataFrame(rows, SCHEMA)).collect()}
    for s in ("m1", "m2"):
        score, info = efron(of(rows, s), got[s]["slope"])
        assert score == pytest.approx(0, abs=1e-5)
        assert got[s]["slope_high"] - got[s]["slope"] == pytest.approx(evaluation.Z95 / math.sqrt(info), rel=1e-6)


def test_cox_slope_of_very_many_ties(spark):
    """Two times with 100,000 events each: the sums of Efron's terms against their explicit form."""
    n = 100_000
    x, z = 0.3, -0.2
    groups = [(1.0, 1, x, n), (1.0, 0, z, n), (2.0, 1, z, n), (2.0, 0, x, 2 * n), (3.0, 0, x, 5)]
    ids = spark.createDataFrame(groups, "years double, outcome int, lp double, n int")
    frame = ids.withColumn("pat_id", F.explode(F.sequence(F.lit(1), "n"))).withColumns({"series": F.lit("m"), "risk": F.lit(0.1)})
    got = fits.cox_calibration(frame).first()
    b, share, score, info = got["slope"], np.arange(n) / n, 0.0, 0.0
    for t in (1.0, 2.0):
        s = [sum(k * v**j * math.exp(b * v) for y, _, v, k in groups if y >= t) for j in range(3)]
        e = [sum(k * v**j * math.exp(b * v) for y, o, v, k in groups if y == t and o) for j in range(3)]
        left = [s[j] - share * e[j] for j in range(3)]
        score += sum(k * v for y, o, v, k in groups if y == t and o) - np.sum(left[1] / left[0])
        info += np.sum(left[2] / left[0] - (left[1] / left[0]) ** 2)
    assert abs(score / info) < 1e-6  # what another step would change
    assert got["slope_high"] - b == pytest.approx(evaluation.Z95 / math.sqrt(info), rel=1e-6)


@pytest.mark.parametrize("x, d", [(1.0, 1), (1.0, 40), (1.5, 7), (20.25, 3), (1e3, 900), (1e9, 2), (1e12, 5)])
def test_special_function_steps(spark, x, d):
    terms = [Fraction(x) + k for k in range(d)]
    step = lambda f: f(F.lit(x), F.lit(float(d)))
    got = spark.range(1).select(
        step(special.log_gamma_step).alias("l"), step(special.digamma_step).alias("p"), step(special.trigamma_step).alias("t")
    ).first()
    assert got["l"] == pytest.approx(math.fsum(math.log(t) for t in terms), rel=1e-12, abs=1e-13)
    assert got["p"] == pytest.approx(float(sum(1 / t for t in terms)), rel=1e-12)
    assert got["t"] == pytest.approx(float(sum(1 / t**2 for t in terms)), rel=1e-12)


def test_separated_outcomes_have_no_estimate(spark):
    df = spark.createDataFrame([("m", i, int(i > 5), 0.05 * i, 0.1 * i, float(12 - i)) for i in range(12)], SCHEMA)
    assert fits.logistic_calibration(df).first()["slope"] is None
    assert fits.cox_calibration(df).first()["slope"] is None


def test_fits_may_take_many_steps():
    calls = []

    def evaluate(points):  # -sqrt(1 + u^2): full steps from afar overshoot and are halved
        calls.append(points)
        u = {k: x[0] - 300 for k, x in points.items()}
        return {k: (-math.sqrt(1 + v * v), np.array([-v / math.sqrt(1 + v * v)]),
                    np.array([[(1 + v * v) ** -1.5]])) for k, v in u.items()}

    fit = fits._newton(evaluate, {"a": np.array([0.0])})["a"]
    assert len(calls) > 40 and fit[0][0] == pytest.approx(300, abs=1e-6)


def test_fits_advance_together(spark, frame, monkeypatch):
    """Both kinds at once: the estimates of separate runs, in as many jobs as the longest fit takes."""
    asked, newton = [], fits._newton

    def counted(evaluate, start):
        asked.append([])
        return newton(lambda points: (asked[-1].append(set(points)), evaluate(points))[1], start)

    monkeypatch.setattr(fits, "_newton", counted)
    # one series that has no fit beside those that do
    single = spark.createDataFrame([("alone", i, 1, 0.3, 0.1 * i, 1.0 + i) for i in range(9)], SCHEMA)
    logistic_rows, cox_rows = frame.unionByName(single), frame.where(F.col(BY) == "m1")
    together = fits.calibrations(logistic_rows, cox_rows)
    apart = fits.logistic_calibration(logistic_rows), fits.cox_calibration(cox_rows)
    for a, b in zip(together, apart, strict=True):
        assert a.columns == b.columns
        a, b = ({r[BY]: r for r in f.collect()} for f in (a, b))
        assert set(a) == set(b)
        for s in a:
            for x, y in zip(a[s][1:], b[s][1:], strict=True):
                assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9, abs=1e-12))
    steps = [len(calls) for calls in asked]
    assert steps[0] == max(steps[1:])
    # a fit that is done takes no further part
    assert all(later <= earlier for calls in asked for earlier, later in zip(calls, calls[1:]))


def test_cardinal_splines(spark):
    knots = np.array([0.0, 0.03, 0.1, 0.35, 0.4, 0.9])
    assert np.allclose(smoothing.basis(knots, knots), np.eye(6), atol=1e-12)
    second, penalty = smoothing.curvatures(knots)
    assert np.allclose(second[[0, -1]], 0)
    line = 0.3 + 2 * knots  # no curvature, and no penalty
    assert np.allclose(second @ line, 0, atol=1e-9) and np.allclose(penalty @ line, 0, atol=1e-9)
    values, step = np.random.default_rng(1).normal(size=6), 1e-4
    grid = np.arange(step, 0.9 - step, step)
    curve = [smoothing.basis(knots, grid + d) @ values for d in (-step / 4, 0, step / 4)]
    bent = (curve[0] - 2 * curve[1] + curve[2]) / (step / 4) ** 2
    assert np.sum(bent**2) * step == pytest.approx(values @ penalty @ values, rel=0.01)
    assert np.allclose(bent, np.interp(grid, knots, second @ values), atol=np.abs(bent).max() * 0.01)


@pytest.mark.parametrize("partitions", [1, 13])
def test_smoothing_system(spark, rows, partitions):
    """Against the basis row by row; the same to the last digit however rows are dealt."""
    df = spark.createDataFrame(make(400, 8, False), SCHEMA)
    got = smoothing.calibration_systems(df.repartition(partitions))
    again = smoothing.calibration_systems(df.repartition(5))
    for s in ("m1", "m2"):
        x, y = (np.array([r[k] for r in make(400, 8, False) if r[0] == s]) for k in (3, 2))
        knots = np.quantile(np.unique(x), np.linspace(0, 1, 10))
        design = smoothing.basis(knots, x)
        assert np.allclose(got[s].knots, knots, atol=1e-14) and got[s].n == 400 and got[s].cases == y.sum()
        assert np.allclose(got[s].gram, design.T @ design, atol=1e-10)
        assert np.allclose(got[s].response, design.T @ y, atol=1e-10)
        assert np.array_equal(got[s].gram, again[s].gram) and np.array_equal(got[s].response, again[s].response)


@pytest.mark.parametrize("waves", [0, 3])
def test_strength_of_the_greatest_restricted_likelihood(waves):
    rng = np.random.default_rng(7)
    x = rng.random(1500)
    y = (rng.random(1500) < 0.5 + 0.4 * np.sin(waves * x * math.pi)).astype(float)
    knots = np.quantile(x, np.linspace(0, 1, 10))
    design, penalty = smoothing.basis(knots, x), smoothing.curvatures(knots)[1]
    system = smoothing.System(knots, design.T @ design, design.T @ y, penalty, 1500, y.sum())
    best = smoothing.likely_strength(system)

    def loss(strength):
        whole = design.T @ design + strength * penalty
        fit = np.linalg.solve(whole, design.T @ y)
        left = np.sum((y - design @ fit) ** 2) + strength * fit @ penalty @ fit
        return 1498 * math.log(left) + np.linalg.slogdet(whole)[1] - 8 * math.log(strength)

    # without a wave a line is best, and the loss only levels off
    assert all(loss(best) <= loss(best * f) + (1e-9 if waves else 1e-2) for f in (0.01, 0.8, 1.25, 100))


@pytest.mark.parametrize("risks", [[0.2], [0.1, 0.3], [0.1, 0.2, 0.3]])
def test_smoothing_few_distinct_risks(spark, risks):
    rows = [("m", i, int(i % 4 == 0), risks[i % len(risks)], 0.0, 1.0) for i in range(120)]
    got = smoothing.smoothed_calibration(spark.createDataFrame(rows, SCHEMA)).collect()
    assert got and {min(r["risk"] for r in got), max(r["risk"] for r in got)} == {risks[0], risks[-1]}
    for risk in (risks[0], risks[-1]):
        of = [r[2] for r in rows if r[3] == risk]
        near = min(got, key=lambda r: abs(r["risk"] - risk))["observed"]
        assert near == pytest.approx(sum(of) / len(of), abs=0.3)


def test_fits_without_events_are_unknown(spark):
    df = spark.createDataFrame([("m", i, 0, 0.1, 0.1 * i, 1.0) for i in range(6)], SCHEMA)
    assert fits.cox_calibration(df).first()["slope"] is None
    assert fits.logistic_calibration(df).first()["slope"] is None


def test_bins_are_even_and_ordered(frame, rows):
    got = calibration.risk_bins(frame, 7).collect()
    assert len(got) == len(rows)
    for s in ("m1", "m2"):
        part = [r for r in got if r[BY] == s]
        sizes = [sum(r["bin"] == b for r in part) for b in range(1, 8)]
        assert sum(sizes) == 240 and max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
        for b in range(1, 7):
            assert max(r["risk"] for r in part if r["bin"] == b) <= min(r["risk"] for r in part if r["bin"] == b + 1)


def test_bins_with_fewer_rows_than_bins(spark):
    df = spark.createDataFrame([("m", i, 0, float(i), 0.0, 1.0) for i in range(3)], SCHEMA)
    assert sorted(r["bin"] for r in calibration.risk_bins(df, 10).collect()) == [1, 2, 3]


def test_histogram_closes_on_the_right(spark):
    df = spark.createDataFrame([("m", i, 0, p, 0.0, 1.0) for i, p in enumerate([0.0, 0.05, 0.0501, 0.1, 1.0])], SCHEMA)
    got = {r["bin"]: r["n"] for r in calibration.risk_histogram(df, 0.05).collect()}
    assert got == {1: 2, 2: 2, 20: 1}


def test_kaplan_meier_reaches_zero(spark):
    df = spark.createDataFrame(
        [("m", 1, 1, 0.1, 0.0, 1.0), ("m", 2, 0, 0.1, 0.0, 2.0), ("m", 3, 1, 0.1, 0.0, 3.0)], SCHEMA
    )
    got = [(r["years"], r["survival"]) for r in netbenefit.kaplan_meier(df).orderBy("years").collect()]
    assert got[0] == (1.0, pytest.approx(2 / 3)) and got[1][1] == pytest.approx(2 / 3) and got[2] == (3.0, 0.0)


def survival_at(part, horizon):
    """Kaplan-Meier by hand; (curve, survival at the horizon)."""
    s, curve, last = 1.0, {}, 1.0
    for t in sorted({r[5] for r in part}):
        risk = sum(r[5] >= t for r in part)
        s *= 1 - sum(r[5] == t and r[2] for r in part) / risk
        curve[t] = (risk, s)
        if t <= horizon:
            last = s
    return curve, last


@pytest.mark.parametrize("times", [list, daily])
def test_survival_measures_at_the_times_given(spark, times):
    rows = times(make(150, 11, False))
    df = spark.createDataFrame(rows, SCHEMA)
    curves = netbenefit.kaplan_meier(df).collect()
    benefits = netbenefit.survival_decision_curve(df, [5], [0.1, 0.4]).where("strategy = 'model'").collect()
    for s in ("m1", "m2"):
        curve, _ = survival_at(of(rows, s), 5)
        got = {r["years"]: (r["at_risk"], pytest.approx(r["survival"], abs=1e-12)) for r in curves if r[BY] == s}
        assert curve == got
        for r in (r for r in benefits if r[BY] == s):
            above = [p for p in of(rows, s) if p[3] >= r["threshold"]]
            event, share = 1 - survival_at(above, 5)[1], len(above) / 150
            odds = r["threshold"] / (1 - r["threshold"])
            assert r["net_benefit"] == pytest.approx(event * share - odds * (1 - event) * share)


def test_times_of_one_series_are_dealt_over_tasks(spark):
    """No window has a whole series, or a whole block of ranks, in one partition."""
    df = spark.createDataFrame(daily(make(60, 2, False)), SCHEMA)
    for measure in (netbenefit.kaplan_meier, discrimination.concordance):
        plan = measure(df)._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "_bucket" not in line:
                raise AssertionError(line)


def test_survival_net_benefit(spark):
    people = [("m", 1, 1, 0.30, 0.0, 1.0), ("m", 2, 0, 0.10, 0.0, 6.0), ("m", 3, 0, 0.02, 0.0, 6.0)]
    df = spark.createDataFrame(people, SCHEMA)
    got = {
        (r["threshold"], r["strategy"]): r["net_benefit"]
        for r in netbenefit.survival_decision_curve(df, [5], [0.05, 0.5]).collect()
    }
    odds = 0.05 / 0.95
    assert got[0.05, "all"] == pytest.approx(1 / 3 - odds * 2 / 3)
    assert got[0.05, "model"] == pytest.approx(1 / 2 * 2 / 3 - odds * 1 / 2 * 2 / 3)
    assert got[0.5, "model"] is None and got[0.5, "none"] == 0.0


def test_binary_net_benefit_threshold_rules(spark):
    people = [("m", 1, 1, 0.2, 0.0, 1.0), ("m", 2, 0, 0.2, 0.0, 1.0), ("m", 3, 0, 0.1, 0.0, 1.0)]
    df = spark.createDataFrame(people, SCHEMA)

    def model(strict):
        curve = netbenefit.binary_decision_curve(df, [0.2, 1.0], strict).where("strategy = 'model'")
        return {r["threshold"]: r["net_benefit"] for r in curve.collect()}

    assert model(False)[0.2] == pytest.approx(1 / 3 - 0.25 / 3)
    assert model(True)[0.2] == 0.0
    assert model(False)[1.0] is None


def test_misclassified_flips_the_exact_number(spark, rows):
    got = evaluation.misclassified(spark.createDataFrame(rows, SCHEMA), [0.005, 0.1])
    for s in ("m1", "m2"):
        controls = sum(r[2] == 0 for r in of(rows, s))
        cases = 240 - controls
        for share in (0.005, 0.1):
            part = got.where(F.col(BY) == f"{s}|{share}")
            assert part.count() == 240
            assert part.agg(F.sum("outcome")).first()[0] == cases + math.ceil(controls * share)


def test_smooth_curve_follows_the_rate(spark):
    rng = random.Random(4)
    people = []
    for i in range(4000):
        p = rng.random() * 0.8
        people.append(("m", i, int(rng.random() < p), p, 0.0, 1.0))
    got = smoothing.smoothed_calibration(spark.createDataFrame(people, SCHEMA)).collect()
    assert len(got) == 80
    for r in got[8:-8]:
        assert abs(r["observed"] - r["risk"]) < 0.06 and r["low"] < r["observed"] < r["high"]


def test_missing_risk_is_left_out(spark):
    people = spark.createDataFrame(
        [(1, 1, 0.3, -1.0), (2, 0, None, -1.0), (3, 0, float("nan"), -1.0), (4, 0, 0.1, -2.0)],
        "pat_id int, y int, p double, xb double",
    )
    rows = evaluation.rows_for(people, "m", "y", "p", "xb", F.lit(1.0))
    assert calibration.expected_observed(rows).first()["n_used"] == 2


def test_measures_of_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for measure in (
        discrimination.auc, discrimination.concordance, fits.logistic_calibration, fits.cox_calibration,
        calibration.expected_observed, calibration.binned_calibration, smoothing.smoothed_calibration,
        netbenefit.kaplan_meier, netbenefit.binary_decision_curve,
    ):
        assert measure(empty).count() == 0


def test_named_column_functions(spark, rows):
    data = spark.createDataFrame(of(rows, "m1"), SCHEMA).withColumnRenamed("pat_id", "who").withColumn(
        "mean_xb", F.lit(-1.0)
    )
    binary = {r["Metric"]: r["Value"] for r in api.binary_calibration_metrics(data, "outcome", "risk", "lp", "who").collect()}
    assert list(binary) == [
        "AUC", "Expected cases (risk)", "Observed cases (risk)", "Calibration-in-the-large", "Intercept", "Slope",
    ]
    assert binary["AUC"].count("(") == 1
    survival = api.survival_calibration_metrics(data, "outcome", "risk", "lp", "mean_xb", "years", "who")
    assert [r["Metric"] for r in survival.collect()][0] == "Harrell's c-index"
    flipped = api.misclassify_percentage_of_noncases(data, "outcome", 0.1, subject="who")
    assert flipped.columns == data.columns and flipped.count() == 240
    assert api.binned_calibration(data, "risk", "outcome", 5, "who").count() == 5
    assert api.binary_net_benefit(data, "outcome", "risk", [0.1], subject="who").count() == 3
    assert api.survival_net_benefit(data, "outcome", "years", "risk", 5, [0.1], subject="who").count() == 3


def test_unknown_follow_up_is_left_out(spark):
    from carecohort.operators import netbenefit

    schema = "series string, pat_id int, outcome int, risk double, lp double, years double"
    known = [("m", 1, 1, 0.9, 1.0, 1.0), ("m", 2, 0, 0.2, -1.0, 2.0), ("m", 3, 1, 0.4, 0.0, 3.0)]
    known += [("m", 6, 1, 0.7, 0.1, -1.0)]  # observation that ends before the index visit counts
    odd = [("m", 4, 1, 0.5, 0.3, None), ("m", 5, 1, 0.6, 0.2, float("nan"))]
    some, every = (spark.createDataFrame(r, schema) for r in (known, known + odd))
    curves = [sorted(map(tuple, netbenefit.kaplan_meier(r).collect())) for r in (some, every)]
    assert curves[0] == curves[1] and curves[0]
