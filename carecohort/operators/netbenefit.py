"""Kaplan-Meier curves and decision-curve net benefit on a threshold grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluation import BY, followed
from .ranking import bucket_edges, in_buckets, later_sums, running_sums


def kaplan_meier(rows: DataFrame, by=(BY,)) -> DataFrame:
    """Numbers at risk, events and survival after each distinct follow-up time, as given.

    ``by`` names few groups.
    """
    rows = followed(rows)
    times = rows.groupBy(*by, "years").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("events")
    )
    return _survival(times, bucket_edges(rows, ["years"])[0], by)


def _survival(times: DataFrame, edges: list[float], by) -> DataFrame:
    """Survival from one row per group and time; ``edges`` cut the times into even buckets."""
    risked = later_sums(times, "years", ["n"], edges, by).withColumn("at_risk", F.col("later_n") + F.col("n"))
    kept = F.col("at_risk") - F.col("events")
    # All at risk have the event only at a group's last time: the curve ends at 0 there.
    logs = risked.withColumn("_log", F.when(kept > 0, F.ln(kept / F.col("at_risk"))).otherwise(0.0))
    summed = running_sums(logs, "years", ["_log"], edges, by)
    survival = F.when(kept == 0, F.lit(0.0)).otherwise(F.exp(F.col("before__log") + F.col("_log")))
    return summed.withColumn("survival", survival).select(*by, "years", "n", "events", "at_risk", "survival")


def _thresholds(hundredths) -> list[float]:
    return [h / 100.0 for h in hundredths]


FULL_SURVIVAL = _thresholds(range(0, 100))  # 0, 0.01 .. 0.99
DETAIL_5YR = _thresholds(range(1, 21))
DETAIL_10YR = _thresholds(range(1, 26))
FULL_BINARY = _thresholds(range(0, 101))  # 0, 0.01 .. 1
DETAIL_ASCVD = [0.0, 0.10]
DETAIL_TOTAL_CVD = [0.0, 0.25]


def _reached(rows: DataFrame, thresholds, strict: bool = False) -> DataFrame:
    """Add ``reached``: how many thresholds (ascending) the risk reaches, or exceeds."""
    placed = in_buckets(rows, "risk", thresholds, "reached")
    count = F.col("reached").cast("int")
    if strict:
        count = count - F.col("risk").isin(*thresholds).cast("int")
    return placed.withColumn("reached", count)


def _with_grid(per_series: DataFrame, thresholds) -> DataFrame:
    """One row per series and threshold; ``step`` numbers the thresholds from 1."""
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(float(t)).alias("threshold"))
        for i, t in enumerate(thresholds)
    ])
    return per_series.withColumn("_t", F.explode(steps)).select("*", "_t.*").drop("_t")


def _benefit(treated_cases, treated_noncases):
    odds = F.when(F.col("threshold") < 1, F.col("threshold") / (1 - F.col("threshold")))
    return treated_cases - odds * treated_noncases


def survival_decision_curve(rows: DataFrame, horizons, thresholds=None) -> DataFrame:
    """Net benefit by horizon and threshold for the model, treating all and treating none.

    The event probability among patients at or above a threshold is 1 - S(horizon)
    of their Kaplan-Meier curve; if follow-up ends earlier the last value holds.
    With nobody above the threshold the model's net benefit is unknown.
    """
    rows = followed(rows)
    thresholds = sorted(thresholds or FULL_SURVIVAL)
    edges = bucket_edges(rows, ["years"])[0]
    cells = _reached(rows, thresholds).groupBy(BY, "reached", "years").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("events")
    )
    # step 0 is everybody, for "treat all"
    times = (
        cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("reached"))))
        .groupBy(BY, "step", "years").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    )

    def event_by(horizon):
        followed = F.when(F.col("years") <= horizon, F.col("years"))
        # nobody followed to any time before the horizon: no event seen
        return 1 - F.coalesce(F.max_by("survival", followed), F.lit(1.0))

    points = (
        _survival(times, edges, (BY, "step"))
        .groupBy(BY, "step")
        .agg(
            F.sum("n").alias("n"),
            F.array(*[
                F.struct(F.lit(h).alias("horizon"), event_by(h).alias("event")) for h in horizons
            ]).alias("_h"),
        )
        .select(BY, "step", "n", F.inline("_h"))
    )
    everyone = points.where(F.col("step") == 0).select(
        BY, "horizon", F.col("n").alias("total"), F.col("event").alias("overall")
    )
    # thresholds x horizons x series rows from here on
    joined = _with_grid(everyone, thresholds).join(points, [BY, "horizon", "step"], "left")
    positive = F.col("n") / F.col("total")
    model = _benefit(F.col("event") * positive, (1 - F.col("event")) * positive)
    treat_all = _benefit(F.col("overall"), 1 - F.col("overall"))
    return _long(joined, model, treat_all, ["horizon"])


def in_views(curve: DataFrame, views) -> DataFrame:
    """Repeat curve rows under each view showing them.

    ``views`` lists (name, thresholds) or (name, horizon, thresholds).
    """
    shown = []
    for name, *horizon, thresholds in views:
        inside = F.col("threshold").isin(*thresholds)
        if horizon:
            inside = inside & (F.col("horizon") == horizon[0])
        shown.append(F.when(inside, F.lit(name)))
    return curve.withColumn("view", F.explode(F.array_compact(F.array(*shown))))


def _long(frame: DataFrame, model, treat_all, keep=()) -> DataFrame:
    strategies = F.array(
        F.struct(F.lit("model").alias("strategy"), model.alias("net_benefit")),
        F.struct(F.lit("all").alias("strategy"), treat_all.alias("net_benefit")),
        F.struct(F.lit("none").alias("strategy"), F.lit(0.0).alias("net_benefit")),
    )
    return frame.withColumn("_s", F.explode(strategies)).select(BY, *keep, "threshold", "_s.*")


def binary_decision_curve(rows: DataFrame, thresholds=None, strict: bool = False) -> DataFrame:
    """Opt-in net benefit of a binary outcome; undefined at threshold 1.

    ``strict`` treats patients above the threshold instead of at or above it.
    """
    thresholds = sorted(thresholds or FULL_BINARY)
    cells = _reached(rows, thresholds, strict).groupBy(BY, "reached").agg(
        F.count(F.lit(1)).alias("n"), F.sum("outcome").alias("events")
    )
    # at most 102 cells per series
    steps = (
        cells.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("reached"))))
        .groupBy(BY, "step").agg(F.sum("n").alias("n"), F.sum("events").alias("events"))
    )
    everyone = steps.where(F.col("step") == 0).select(
        BY, F.col("n").alias("total"), F.col("events").alias("cases")
    )
    joined = _with_grid(everyone, thresholds).join(steps, [BY, "step"], "left").na.fill(0, ["n", "events"])
    total = F.col("total")
    model = _benefit(F.col("events") / total, (F.col("n") - F.col("events")) / total)
    treat_all = _benefit(F.col("cases") / total, (total - F.col("cases")) / total)
    return _long(joined, model, treat_all)
