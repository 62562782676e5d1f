"""SQL statement of every registered query, for comparison on small data."""

from __future__ import annotations

from .. import codes, coefficients
from ..operators.eligibility import ELIGIBLE_COLUMNS
from ..operators.evaluation import Z95
from ..operators.netbenefit import (
    DETAIL_5YR, DETAIL_10YR, DETAIL_ASCVD, DETAIL_TOTAL_CVD, FULL_BINARY, FULL_SURVIVAL,
)
from ..operators.tableone import CATEGORICAL, CONTINUOUS, LABELS, YES_NO
from ..plans.catalog import EXTRA_FIELD, FIXED_STRENGTH, PREVENT_TERMS, WRONG_VALUE
from ..plans.validation import ASCVD, METRICS, MODELS, PCE_5YR, PCE_10YR, SHARES, TOTAL_CVD
from .parts import _VALUE, PARTS, eligible, shown, six, statement

STATEMENTS: dict[str, str] = {}


def _add(name: str, final: str, **extra: str) -> None:
    STATEMENTS[name] = statement(final, extra)


def _table(name: str, part: str, columns, where: str = "") -> None:
    _add(name, f"select {shown(columns)} from {part} {where}")


def _rounded(*names: str) -> str:
    return ", ".join(f"{six(n)} as {n}" for n in names)


# --- sources and per-patient definitions ------------------------------------------

_add(
    "ingest_lowercase_distinct",
    """select distinct o_custkey as pat_id, o_orderkey as pat_enc_csn_id,
       strftime(o_orderdate, '%Y-%m-%d') as contact_date
from orders join lineitem on o_orderkey = l_orderkey""",
)
_table("ndi_match_cause", "ndi_cause_of_death", ["pat_id", "death_date", "death_cause"])
_table("death_index_files", "ndi_cause_of_death", ["pat_id", "death_date", "death_cause"])
_table(
    "delimited_scan", "encounters",
    ["pat_id", "pat_enc_csn_id", "contact_date", "department_name", "product_type_nm"],
)
_add(
    "lab_clean_cast",
    f"""select component_id, ord_value, count(*) as n_results, any_value({_VALUE}) as value
from labs group by component_id, ord_value""",
)
_table("first_statin", "statins", ["pat_id", "statin_first_date"])
_table("first_ascvd_dx", "ascvd_dx", ["pat_id", "ascvd_first_date"])
_table("first_total_cvd_dx", "total_cvd_dx", ["pat_id", "ascvd_first_date"])
_table("dyslipidemia_onset", "dyslipidemia", ["pat_id", "dyslipidemia_date"])
for _n in ("diabetes", "hypertension"):
    _table(f"{_n}_definition", _n, ["pat_id", f"{_n}_dx_date", f"{_n}_med_date", f"{_n}_date"])
_table("hypertension_second_order", "second_order", ["pat_id", "hypertension_med_date"])
_table("current_smoker", "smokers", ["pat_id", "smoking_status_date"])
_table(
    "demographics_recode", "people",
    ["pat_id", "pat_mrn_id", "birth_date", "death_date", "last_discharge_or_contact_date", "sex",
     "raceth", "language_primary", "relationship_status"],
)
_table(
    "pcmh_visits_insurance", "visits",
    ["pat_id", "pat_enc_csn_id", "contact_date", "department_name", "insurance"],
)
_table("ndi_first_death", "index_deaths", ["pat_id", "ndi_death_date"])
_table("cholesterol_pivot", "panels", ["pat_id", "chol_date", "hdl_chol", "ldl_chol", "total_chol"])
_table("systolic_bp", "pressures", ["pat_enc_csn_id", "systolic_bp_time", "systolic_bp"])
_table("egfr_results", "egfrs", ["pat_id", "result_time", "egfr_date", "egfr"])
_table("ascvd_outcome", "ascvd_outcome", ["pat_id", "ascvd_date"])
_table("total_cvd_outcome", "total_cvd_outcome", ["pat_id", "total_cvd_date"])

# --- cohort tables --------------------------------------------------------------------

for _o in ("ascvd", "total_cvd"):  # the published rows: one per smoking record
    _add(f"{_o}_eligible", f"select {shown(ELIGIBLE_COLUMNS)} from {_o}_eligible", **{f"{_o}_eligible": eligible(_o, "smokers")})
_BASE = ("patients", "encounters", "diagnoses", "labs", "medications", "social_history", "vitals", "ndi_cause_of_death")


def _hit(name: str, rule: dict) -> str:
    key, every, rest, *_ = rule[name]
    return f"{key} % {every} = {rest}"


_add(
    "registry_load",
    "\nunion all\n".join(
        [
            f"select '{t}' as table_name, 'rows' as kind, count(*) as n from {t} "
            + (f"where not ({_hit(t, EXTRA_FIELD)})" if t in EXTRA_FIELD else "")
            for t in _BASE if t != "ndi_cause_of_death"
        ]
        + [
            "select 'ndi_cause_of_death', 'rows', count(*) from ndi_cause_of_death d join patients using (pat_id) "
            f"where not ({_hit('patients', EXTRA_FIELD)})"
        ]
        + [f"select '{t}', 'fields', count(*) from {t} where {_hit(t, EXTRA_FIELD)} having count(*) > 0" for t in EXTRA_FIELD]
        + [
            f"select '{t}', 'type', count(*) from {t} where {_hit(t, WRONG_VALUE)} and not ({_hit(t, EXTRA_FIELD)}) having count(*) > 0"
            for t in WRONG_VALUE
        ]
    ),
)
_add(
    "created_tables",
    "\nunion all\n".join(
        f"select '{name}' as table_name, count(*) as n_rows, count(distinct {'pat_enc_csn_id' if part == 'vitals' else 'pat_id'}) as n_keys from {part}"
        for name, part in (
            *((t, t) for t in _BASE),
            ("ascvd_eligible_encounters", "ascvd_eligible"),
            ("total_cvd_eligible_encounters", "total_cvd_eligible"),
            ("pce_first_eligible_encounter_with_predictors", "ascvd_index"),
            ("prevents_first_ascvd_eligible_encounter_with_predictors", "prevent_ascvd_index"),
            ("prevents_first_total_cvd_eligible_encounter_with_predictors", "total_cvd_index"),
        )
    ),
)
_add(
    "eligible_distinct_patients",
    "\nunion all\n".join(
        f"select '{name}' as table_name, cast({n} as bigint) as n_rows, count(distinct pat_id) as patients from {part}"
        for name, part, n in (
            ("ascvd_eligible_encounters", "ascvd_eligible", "sum(published_rows)"),
            ("total_cvd_eligible_encounters", "total_cvd_eligible", "sum(published_rows)"),
            ("pce_first_eligible_encounter_with_predictors", "ascvd_index", "count(*)"),
            ("prevents_first_ascvd_eligible_encounter_with_predictors", "prevent_ascvd_index", "count(*)"),
            ("prevents_first_total_cvd_eligible_encounter_with_predictors", "total_cvd_index", "count(*)"),
        )
    ),
)

_NEAR = f"between 0 and {codes.LOOKBACK_DAYS}"
_CANDIDATE = [
    "pat_id", "contact_date", "pat_enc_csn_id", "systolic_bp", "chol_date", "hdl_chol", "ldl_chol",
    "total_chol", "smoking_status_date",
]
for _name, _outcome, _egfr in (
    ("pce_candidates", "ascvd", False), ("total_cvd_candidates", "total_cvd", True),
):
    _add(
        _name,
        f"""select {shown(_CANDIDATE + (['result_time', 'egfr_date', 'egfr'] if _egfr else []))} from (
  select *, row_number() over (partition by pat_id, contact_date order by pat_enc_csn_id, chol_date desc,
      {'result_time desc, egfr desc,' if _egfr else ''}
      coalesce(date_diff('day', smoking_status_date, contact_date) {_NEAR}, false) desc,
      smoking_status_date desc nulls last) as nth
  from {_outcome}_eligible join pressures using (pat_enc_csn_id) join panels using (pat_id)
  {'join egfrs using (pat_id)' if _egfr else ''}
  where date_diff('day', chol_date, contact_date) {_NEAR}
    {f"and date_diff('day', egfr_date, contact_date) {_NEAR}" if _egfr else ''}
    and hdl_chol is not null and ldl_chol is not null and total_chol is not null)
where nth = 1""",
    )


def _index_columns(outcome: str, egfr: bool) -> list[str]:
    return [
        *ELIGIBLE_COLUMNS, "systolic_bp_time", "systolic_bp", "chol_date", "hdl_chol", "ldl_chol",
        "total_chol", "patient_encounter_row_num", "current_hypertensive_med_start_date",
        "current_hypertensive_med_end_date", f"{outcome}_date", "diabetes_flag", "hypertension_flag",
        "dyslipidemia_flag", "current_smoker_flag", "current_hypertensive_med_flag",
        f"{outcome}_5yr_flag", f"{outcome}_10yr_flag", f"{outcome}_followup_end_date",
        f"{outcome}_followup_years", *(["result_time", "egfr_date", "egfr"] if egfr else []),
    ]


_table("pce_index", "ascvd_index", _index_columns("ascvd", False))
_table("prevent_ascvd_closest_egfr", "prevent_ascvd_index", _index_columns("ascvd", True))
_table("prevent_total_cvd_index", "total_cvd_index", _index_columns("total_cvd", True))
_table(
    "active_antihypertensive", "ascvd_treated",
    ["pat_id", "current_hypertensive_med_start_date", "current_hypertensive_med_end_date"],
)
_BOTH = (("ascvd", "ascvd_index"), ("total_cvd", "total_cvd_index"))
_add(
    "predictor_flags",
    " union all ".join(f"select '{o}' as outcome, pat_id, {shown(YES_NO)} from {t}" for o, t in _BOTH),
)
_add(
    "outcome_flags",
    " union all ".join(
        f"select '{o}' as outcome, pat_id, {o}_5yr_flag as flag_5yr, {o}_10yr_flag as flag_10yr from {t}"
        for o, t in _BOTH
    ),
)
_add(
    "followup_censoring",
    " union all ".join(
        f"select '{o}' as outcome, pat_id, strftime({o}_followup_end_date, '%Y-%m-%d') as end_date, "
        f"{six(f'{o}_followup_years')} as years from {t}"
        for o, t in _BOTH
    ),
)

# --- scored analysis sets ---------------------------------------------------------------

_KNOWN_SEX = "sex in ('female', 'male')"
_LN = {
    "ln_age": "ln(age_yrs)",
    "ln_age_squared": "pow(ln(age_yrs), 2)",
    "ln_tc": "ln(total_chol)",
    "ln_hdl": "ln(hdl_chol)",
    "ln_treated_sbp": "ln(systolic_bp) * current_hypertensive_med_flag",
    "ln_untreated_sbp": "ln(systolic_bp) * (1 - current_hypertensive_med_flag)",
    "ln_age_ln_tc": "ln_age * ln_tc",
    "ln_age_ln_hdl": "ln_age * ln_hdl",
    "ln_age_ln_treated_sbp": "ln_age * ln_treated_sbp",
    "ln_age_ln_untreated_sbp": "ln_age * ln_untreated_sbp",
    "ln_age_current_smoker_flag": "ln_age * current_smoker_flag",
}


def _strata(values: dict, text) -> str:
    arms = " ".join(
        f"when sex = '{s}' and raceth = '{r}' then {text(v)}" for (s, r), v in values.items()
    )
    return f"case {arms} end"


def _sum(weights: dict) -> str:
    return " + ".join(f"{w}::double" if n == "intercept" else f"{w}::double * {n}" for n, w in weights.items())


PARTS["pce"] = f"""
select *, round(1 - pow(so_t5, exp(xb - pce_mean_xb)), 4) as pce_risk_5yr,
       round(1 - pow(so_t10, exp(xb - pce_mean_xb)), 4) as pce_risk_10yr
from (
  select *, {', '.join(f'{e} as {n}' for n, e in _LN.items())},
    {_strata(coefficients.PCE, _sum)} as xb,
    {_strata(coefficients.PCE_BASELINE, lambda b: f'{b[0]}::double')} as so_t5,
    {_strata(coefficients.PCE_BASELINE, lambda b: f'{b[1]}::double')} as so_t10,
    {_strata(coefficients.PCE_BASELINE, lambda b: f'{b[2]}::double')} as pce_mean_xb
  from ascvd_index where {_KNOWN_SEX} and raceth in ('nh black', 'nh white'))"""

_X = {
    "x1": "(age_yrs - 55) / 10.0::double",
    "x2": "(total_chol - hdl_chol) * 0.02586::double - 3.5",
    "x3": "(hdl_chol * 0.02586::double - 1.3::double) / 0.3::double",
    "x4": "(least(systolic_bp, 110) - 110) / 20::double",
    "x5": "(greatest(systolic_bp, 110) - 130) / 20::double",
    "x6": "diabetes_flag",
    "x7": "current_smoker_flag",
    "x8": "(least(egfr, 60) - 60) / -15::double",
    "x9": "(greatest(egfr, 60) - 90) / -15::double",
    "x10": "current_hypertensive_med_flag",
    "x12": "x10 * x5",
    "x14": "x1 * x2",
    "x15": "x1 * x3",
    "x16": "x1 * x5",
    "x17": "x1 * x6",
    "x18": "x1 * x7",
    "x19": "x1 * x8",
}
for _outcome, _part, _weights in (
    ("ascvd", "prevent_ascvd_index", coefficients.PREVENT_ASCVD),
    ("total_cvd", "total_cvd_index", coefficients.PREVENT_TOTAL_CVD),
):
    _arms = " ".join(f"when '{s}' then {_sum(w)}" for s, w in _weights.items())
    PARTS[f"prevent_{_outcome}"] = f"""
select *, {', '.join(f'{e} as {n}' for n, e in _X.items())},
  case sex {_arms} end as log_odds_{_outcome},
  exp(log_odds_{_outcome}) / (1 + exp(log_odds_{_outcome})) as prevents_{_outcome}_risk_10yr
from {_part} where {_KNOWN_SEX}"""

_SETS = (("PCE", "pce", "ascvd_5yr_flag", "ASCVD"), (ASCVD, "prevent_ascvd", "ascvd_10yr_flag", "ASCVD"),
         (TOTAL_CVD, "prevent_total_cvd", "total_cvd_10yr_flag", "Total CVD"))
_add(
    "analysis_sets",
    " union all ".join(
        f"select '{m}' as model, sex, raceth, count(*) as patients from {t} group by sex, raceth"
        for m, t, *_ in _SETS
    ),
)
_table("pce_risk", "pce", ["pat_id", *_LN, "xb", "so_t5", "so_t10", "pce_mean_xb", "pce_risk_5yr", "pce_risk_10yr"])
for _outcome in ("ascvd", "total_cvd"):
    _add(
        f"prevent_{_outcome}_risk",
        f"select pat_id, {', '.join(f'{six(x)} as {x}' for x in PREVENT_TERMS)}, "
        f"{shown([f'log_odds_{_outcome}', f'prevents_{_outcome}_risk_10yr'])} from prevent_{_outcome}",
    )
_add(
    "risk_by_stratum",
    """select sex, raceth, count(*) as patients, cast(sum(ascvd_10yr_flag) as bigint) as events,
       round(avg(pce_risk_10yr), 6) as mean_risk_10yr from pce group by sex, raceth""",
)

# --- evaluation rows ------------------------------------------------------------------


def _rows(model: str, part: str, outcome: str, risk: str, lp: str, years: str) -> str:
    return (
        f"select '{model}' as series, pat_id, {outcome} as outcome, {risk} as risk, {lp} as lp, "
        f"{years} as years from {part} where {risk} is not null"
    )


PARTS["survival_rows"] = " union all ".join(
    _rows(m, "pce", f"ascvd_{y}yr_flag", f"pce_risk_{y}yr", "xb - pce_mean_xb", "ascvd_followup_years")
    for m, y in ((PCE_5YR, 5), (PCE_10YR, 10))
)
PARTS["binary_rows"] = " union all ".join(
    _rows(m, f"prevent_{o}", f"{o}_10yr_flag", f"prevents_{o}_risk_10yr", f"log_odds_{o}", f"{o}_followup_years")
    for m, o in ((ASCVD, "ascvd"), (TOTAL_CVD, "total_cvd"))
)
PARTS["all_rows"] = "select * from survival_rows union all select * from binary_rows"

_RANDOM = "md5(pat_id || '|0')"
PARTS["binned_rows"] = f"""
select *, ntile(10) over (partition by series order by risk, {_RANDOM}, pat_id) as bin from survival_rows"""
_add("global_ntile", "select series, pat_id, cast(bin as int) as bin from binned_rows")
for _model, _y in ((PCE_5YR, 5), (PCE_10YR, 10)):
    _add(
        f"binned_calibration_pce_{_y}yr",
        f"""select series, cast(bin as int) as bin, n, {_rounded('predicted', 'observed', 'se')},
  round(observed + 1.96 * se, 6) as high, round(greatest(observed - 1.96 * se, 0), 6) as low
from (select series, bin, count(*) as n, avg(risk) as predicted, avg(outcome) as observed,
             sqrt(avg(outcome) * (1 - avg(outcome)) / count(*)) as se
      from binned_rows where series = '{_model}' group by series, bin)""",
    )


def _histogram(part: str, width: float) -> str:
    return f"""select series, cast(greatest(ceil(risk / {width}::double - 1e-8), 1) as int) as bin, count(*) as n,
  sum(count(*)) over (partition by series) as total from {part} group by 1, 2"""


_add("risk_histogram_counts", f"select series, bin, n from ({_histogram('survival_rows', 0.0125)})")
_add(
    "risk_histogram_share",
    f"select series, bin, round(n::double / total, 6) as share from ({_histogram('binary_rows', 0.05)})",
)


def _significant(x: str, digits: int) -> str:
    return (
        f"case when {x} = 0 then 0 else round({x}, cast({digits - 1} - floor(log10(abs({x}))) as int)) end"
    )


def _expected_observed(part: str) -> str:
    return f"""
select series, n as n_used, expected_risk, observed_cases, observed_risk,
       cast(ceil(expected_risk * n) as bigint) as expected_cases,
       {_significant('(expected_risk / observed_risk)', 2)} as in_the_large
from (select series, count(*) as n, {_significant('avg(risk)', 2)} as expected_risk,
             cast(sum(outcome) as bigint) as observed_cases, {_significant('avg(outcome)', 2)} as observed_risk
      from {part} group by series)"""


def _auc(part: str) -> str:
    """Every case against every control; variance from the two sets of placements."""
    return f"""
with pairs as (
  select c.series, c.pat_id as case_id, k.pat_id as control_id,
         case when c.risk > k.risk then 1.0::double when c.risk = k.risk then 0.5::double else 0.0::double end as won
  from {part} c join {part} k on c.series = k.series and c.outcome = 1 and k.outcome = 0),
v1 as (select series, count(*) as cases, avg(v) as raw, var_samp(v) as s from
       (select series, case_id, avg(won) as v from pairs group by all) group by series),
v0 as (select series, count(*) as controls, var_samp(v) as s from
       (select series, control_id, avg(won) as v from pairs group by all) group by series),
middle as (select series, median(risk) filter (outcome = 1) as m1, median(risk) filter (outcome = 0) as m0
           from {part} group by series),
joined as (select series, cases, controls, case when m0 <= m1 then raw else 1 - raw end as auc,
                  {Z95} * sqrt(v1.s / cases + v0.s / controls) as spread
           from v1 join v0 using (series) join middle using (series))
select series, cases, controls, auc, greatest(auc - spread, 0) as auc_low, least(auc + spread, 1) as auc_high
from joined"""


def _concordance(part: str) -> str:
    """Every usable pair; risks count downwards where a Cox score at zero is negative."""
    return f"""
with slope as (
  select series, sum(case when l = 0 then sx else 0 end) - sum((s1 - l / d * e1) / (s0 - l / d * d)) as score
  from (select *, unnest(range(d::bigint))::double as l from (
    select series, years, d, e1, e1 as sx, sum(n) over later as s0, sum(x) over later as s1
    from (select series, years, count(*) as n, sum(risk) as x, sum(outcome)::double as d, sum(risk * outcome) as e1
          from {part} group by series, years)
    window later as (partition by series order by years desc)) where d > 0)
  group by series),
turned as (select r.*, risk * case when score < 0 then -1 else 1 end as mark from {part} r left join slope using (series))
select e.series, count(*)::double as usable, count(*) filter (e.mark > o.mark)::double as concordant,
       count(*) filter (e.mark = o.mark)::double as tied,
       (count(*) filter (e.mark > o.mark) + 0.5::double * count(*) filter (e.mark = o.mark)) / count(*) as cindex
from turned e join turned o on e.series = o.series and e.outcome = 1 and o.years > e.years group by e.series"""


def _logistic(part: str) -> str:
    """Newton steps as a recursive query: slope fixed at one, and free."""
    return f"""
with recursive fixed_step as (
  select 0 as i, series, 0.0::double as a, 1.0::double as info from {part} group by series
  union all
  select i + 1, series, a + u / w, w from (
    select i, series, a, sum(outcome - p) as u, sum(p * (1 - p)) as w from (
      select i, series, a, outcome, 1 / (1 + exp(-(a + lp))) as p from fixed_step join {part} using (series) where i < 15)
    group by all)),
free_step as (
  select 0 as i, series, ln(avg(outcome) / (1 - avg(outcome))) as a, 0.0::double as b,
         1.0::double as w, 1.0::double as wxx, 0.0::double as wx from {part} group by series
  union all
  select i + 1, series, a + (wxx * u - wx * ux) / (w * wxx - wx * wx), b + (w * ux - wx * u) / (w * wxx - wx * wx), w, wxx, wx from (
    select i, series, a, b, sum(outcome - p) as u, sum((outcome - p) * lp) as ux, sum(p * (1 - p)) as w,
           sum(p * (1 - p) * lp) as wx, sum(p * (1 - p) * lp * lp) as wxx from (
      select i, series, a, b, outcome, lp, 1 / (1 + exp(-(a + b * lp))) as p from free_step join {part} using (series) where i < 15)
    group by all))
select f.series, f.a as intercept, f.a - {Z95} / sqrt(f.info) as intercept_low, f.a + {Z95} / sqrt(f.info) as intercept_high,
       s.b as slope, s.b - {Z95} * sqrt(s.w / (s.w * s.wxx - s.wx * s.wx)) as slope_low,
       s.b + {Z95} * sqrt(s.w / (s.w * s.wxx - s.wx * s.wx)) as slope_high
from fixed_step f join free_step s using (series) where f.i = 15 and s.i = 15"""


def _cox(part: str) -> str:
    """Newton steps with Efron's ties; the risk set of a time is a window sum."""
    steps = 10
    return f"""
with recursive step as (
  select 0 as i, series, 0.0::double as b, 1.0::double as info from {part} group by series
  union all
  select i + 1, series, b + u / v, v from (
    select i, series, b, sum(case when l = 0 then sx else 0 end) - sum((s1 - l / d * e1) / (s0 - l / d * e0)) as u,
           sum((s2 - l / d * e2) / (s0 - l / d * e0) - pow((s1 - l / d * e1) / (s0 - l / d * e0), 2)) as v
    from (
      select i, series, b, d, sx, e0, e1, e2, s0, s1, s2, unnest(range(d::bigint))::double as l from (
        select i, series, b, years, d, sx, e0, e1, e2, sum(t0) over later as s0, sum(t1) over later as s1, sum(t2) over later as s2
        from (
          select i, series, b, years, sum(outcome)::double as d, sum(x * outcome) as sx,
                 sum(w) as t0, sum(w * x) as t1, sum(w * x * x) as t2,
                 sum(w * outcome) as e0, sum(w * x * outcome) as e1, sum(w * x * x * outcome) as e2
          from (select i, series, b, years, outcome, lp as x, exp(b * lp) as w from step join {part} using (series) where i < {steps})
          group by i, series, b, years)
        window later as (partition by i, series order by years desc))
      where d > 0)
    group by i, series, b))
select series, b as slope, b - {Z95} / sqrt(info) as slope_low, b + {Z95} / sqrt(info) as slope_high
from step where i = {steps}"""


_add(
    "expected_observed",
    f"select series, n_used, {_rounded('expected_risk', 'observed_risk', 'in_the_large')}, observed_cases, expected_cases from eo",
    eo=_expected_observed("all_rows"),
)
for _model, _o in ((ASCVD, "ascvd"), (TOTAL_CVD, "total_cvd")):
    _add(
        f"auc_delong_{_o}",
        f"select series, cases, controls, {_rounded('auc', 'auc_low', 'auc_high')} from measured where series = '{_model}'",
        measured=_auc("binary_rows"),
    )
_add(
    "calibration_intercept",
    f"select series, {_rounded('intercept', 'intercept_low', 'intercept_high')} from fitted",
    fitted=_logistic("binary_rows"),
)
_add(
    "calibration_slope_binary",
    f"select series, {_rounded('slope', 'slope_low', 'slope_high')} from fitted",
    fitted=_logistic("binary_rows"),
)
for _model, _y in ((PCE_5YR, 5), (PCE_10YR, 10)):
    _add(
        f"cindex_{_y}yr",
        f"select series, usable, concordant, tied, {_rounded('cindex')} from measured where series = '{_model}'",
        measured=_concordance("survival_rows"),
    )
    _add(
        f"cox_slope_{_y}yr",
        f"select series, {_rounded('slope', 'slope_low', 'slope_high')} from fitted where series = '{_model}'",
        fitted=_cox("survival_rows"),
    )

# --- smoothed calibration: ten knots, the basis row by row, elimination step by step ------


def _eliminated(name: str, size: int) -> dict[str, str]:
    """Gauss-Jordan steps on rows ``(series, i, v)``; the last one's left block is the identity."""
    steps = {}
    for p in range(1, size + 1):
        before = name if p == 1 else f"{name}_{p - 1}"
        steps[f"{name}_{p}"] = f"""
select a.series, a.i, case when a.i = {p} then list_transform(a.v, lambda z: z / a.v[{p}])
       else list_transform(list_zip(a.v, b.v), lambda z: z[1] - z[2] * a.v[{p}] / b.v[{p}]) end as v
from {before} a join {before} b on a.series = b.series and b.i = {p}"""
    return steps


def _spline_basis(source: str) -> str:
    """Cardinal basis functions ``c`` at the risks of ``source``, long."""
    return f"""
select s.*, f.c, case when f.c = q then 1 - t when f.c = q + 1 then t else 0 end
         + h * h / 6 * (((1 - t) ** 3 - (1 - t)) * f.f + (t ** 3 - t) * g.f) as v
from (select *, (risk - x[q]) / (x[q + 1] - x[q]) as t, x[q + 1] - x[q] as h from (
        select r.*, x, 1 + len(list_filter(x[2:9], lambda k: k <= risk)) as q from {source} r join knots using (series))) s
join second f on f.series = s.series and f.i = s.q
join second g on g.series = s.series and g.i = s.q + 1 and g.c = f.c"""


_SPLINE = {
    "knots": f"""
select series, quantile_cont(risk, [{', '.join(f'{k}/9.0' for k in range(10))}]) as x
from (select distinct series, risk from binary_rows) group by series""",
    "bends": """
select series, i, list_concat(
    list_transform(range(1, 9), lambda c: case when c = i then (x[i + 2] - x[i]) / 3
      when c = i + 1 then (x[i + 2] - x[i + 1]) / 6 when c = i - 1 then (x[i + 1] - x[i]) / 6 else 0 end),
    list_transform(range(1, 11), lambda c: case when c = i then 1 / (x[i + 1] - x[i])
      when c = i + 1 then -1 / (x[i + 1] - x[i]) - 1 / (x[i + 2] - x[i + 1])
      when c = i + 2 then 1 / (x[i + 2] - x[i + 1]) else 0 end)) as v
from knots, range(1, 9) n(i)""",
    **_eliminated("bends", 8),
    "second": """
select series, e.i, c, coalesce(v[8 + c], 0) as f
from (select series, n.i from knots, range(1, 11) n(i)) e left join (select series, i + 1 as i, v from bends_8) b using (series, i),
     range(1, 11) m(c)""",
    "numbered": "select row_number() over () as id, series, risk, outcome from binary_rows",
    "at_rows": _spline_basis("numbered"),
    "gram": "select a.series, a.c as i, b.c as j, sum(a.v * b.v) as g from at_rows a join at_rows b using (id) group by all",
    "response": "select series, c as i, sum(v * outcome) as r from at_rows group by all",
    "penalty": """
select b.series, m.i as i, f.j as j, sum(b.v[8 + m.i] * f.f) as s
from bends b join (select series, i - 1 as n, c as j, f from second) f on f.series = b.series and f.n = b.i, range(1, 11) m(i)
group by all""",
}
_SPLINE["whole"] = f"""
select series, i, list_concat(list(g + {FIXED_STRENGTH} * s order by j), list_transform(range(1, 11), lambda c: cast(c = i as double)), [any_value(r)]) as v
from gram join penalty using (series, i, j) join response using (series, i) group by series, i"""
_SPLINE.update(_eliminated("whole", 10))
_SPLINE["solved"] = "select series, i, n.j, v[10 + n.j] as w, v[21] as b from whole_10, range(1, 11) n(j)"
_SPLINE["variances"] = """
select series, (cases - 2 * fitted + squared) / (n - freedom) as variance
from (select series, count(*) as n, sum(outcome) as cases from binary_rows group by series)
join (select series, sum(w * g) as freedom, sum(b * v[21] * g) as squared
      from solved join gram using (series, i, j) join (select series, i as j, v from whole_10) using (series, j) group by series) using (series)
join (select series, sum(v[21] * r) as fitted from whole_10 join response using (series, i) group by series) using (series)"""
_SPLINE["grid"] = "select series, p as point, x[1] + (x[10] - x[1]) * (p - 1) / 79 as risk from knots, range(1, 81) n(p)"
_SPLINE["at_grid"] = _spline_basis("grid")
_SPLINE["curve"] = """
select a.series, a.point, a.risk, a.f as observed, 1.96 * sqrt(sum(a.v * s.w * e.v) * variance) as half
from (select *, sum(v * b) over (partition by series, point) as f
      from at_grid join (select series, i as c, v[21] as b from whole_10) using (series, c)) a
join solved s on s.series = a.series and s.i = a.c
join at_grid e on e.series = a.series and e.point = a.point and e.c = s.j
join variances d on d.series = a.series group by a.series, a.point, a.risk, a.f, variance"""

_add(
    "smoothed_calibration_system",
    f"select series, i::int as i, j::int as j, {six('x[i]')} as knot, {six('g')} as product, {six('r')} as response "
    "from gram join response using (series, i) join knots using (series) where j >= i",
    **_SPLINE,
)
_add(
    "smoothed_calibration_fixed",
    f"select series, point::int as point, {_rounded('risk', 'observed')}, {six('observed - half')} as low, {six('observed + half')} as high from curve",
    **_SPLINE,
)

# --- survival and net benefit -----------------------------------------------------------


def _km(part: str, by: str) -> str:
    return f"""
select {by}, years, n, events, at_risk,
       coalesce(exp(sum(case when at_risk > events then ln((at_risk - events) / at_risk) end) over until), 1)
         * (1 - max(cast(at_risk = events as int)) over until) as survival
from (select {by}, years, count(*) as n, sum(outcome) as events,
             sum(count(*)) over (partition by {by} order by years desc) as at_risk
      from {part} group by {by}, years)
window until as (partition by {by} order by years)"""


_add(
    "km_curve",
    f"""select series, {six('years')} as years, n, cast(events as bigint) as events,
       cast(at_risk as bigint) as at_risk, round(survival, 6) as survival from curve""",
    curve=_km("survival_rows", "series"),
)


def _grid(thresholds) -> str:
    return "(select unnest([" + ", ".join(f"{t}::double" for t in thresholds) + "]) as threshold)"


def _strategies(frame: str, extra: str) -> str:
    odds = "case when threshold < 1 then threshold / (1 - threshold) end"
    model, everyone = (six(f"({a} - {odds} * {b})") for a, b in (("tp", "fp"), ("ap", "an")))
    return " union all ".join(
        f"select series, threshold, '{name}' as strategy, {value} as net_benefit{extra} from {frame}"
        for name, value in (("model", model), ("all", everyone), ("none", "0.0::double"))
    )


def _survival_curve(model: str, view: str, horizon: int, thresholds, tag: str) -> tuple[str, dict]:
    km = _km("(select t.threshold, r.* from survival_rows r, " + _grid([-1.0, *thresholds])
             + f" t where r.risk >= t.threshold and series = '{model}')", "series, threshold")
    extra = {
        f"{tag}_curve": km,
        f"{tag}_point": f"""
select series, threshold, sum(n) as n,
       1 - coalesce(arg_max(survival, years) filter (years <= {horizon}), 1) as event
from {tag}_curve group by series, threshold""",
        f"{tag}_frame": f"""
select a.series, t.threshold, p.event * p.n / a.n as tp, (1 - p.event) * p.n / a.n as fp, a.event as ap, 1 - a.event as an
from {tag}_point a, {_grid(thresholds)} t left join {tag}_point p on p.threshold = t.threshold
where a.threshold = -1""",
    }
    return _strategies(f"{tag}_frame", f", '{view}' as view, {horizon} as horizon"), extra


for _model, _y, _views in (
    (PCE_5YR, 5, (("full", 5, FULL_SURVIVAL), ("detail", 5, DETAIL_5YR))),
    (PCE_10YR, 10, (("full", 10, FULL_SURVIVAL), ("detail", 5, DETAIL_10YR), ("detail", 10, DETAIL_10YR))),
):
    _finals, _extra = [], {}
    for _i, (_view, _horizon, _t) in enumerate(_views):
        _sql, _more = _survival_curve(_model, _view, _horizon, _t, f"v{_i}")
        _finals.append(_sql)
        _extra.update(_more)
    _add(f"dca_survival_{_y}yr", " union all ".join(_finals), **_extra)

for _model, _o, _detail in ((ASCVD, "ascvd", DETAIL_ASCVD), (TOTAL_CVD, "total_cvd", DETAIL_TOTAL_CVD)):
    _finals, _extra = [], {}
    for _view, _t in (("full", FULL_BINARY), ("detail", _detail)):
        _extra[f"{_view}_frame"] = f"""
select series, threshold, count(*) filter (risk >= threshold and outcome = 1) / count(*) as tp,
       count(*) filter (risk >= threshold and outcome = 0) / count(*) as fp,
       count(*) filter (outcome = 1) / count(*) as ap, count(*) filter (outcome = 0) / count(*) as an
from binary_rows, {_grid(_t)} t where series = '{_model}' group by series, threshold"""
        _finals.append(_strategies(f"{_view}_frame", f", '{_view}' as view"))
    _add(f"dca_binary_{_o}", " union all ".join(_finals), **_extra)

# --- table one, drop-in -------------------------------------------------------------------

for _m, _t, _flag, _label in _SETS:
    _egfr = "cast(null as double) as egfr" if _m == "PCE" else "egfr::double as egfr"
    _names = ", ".join([*(c for c in CONTINUOUS if c != "egfr"), *CATEGORICAL, *YES_NO])
    PARTS[f"groups_{_t}"] = f"""
select '{_m}' as model, 'Overall' as "group", {_names}, {_egfr} from {_t}
union all
select '{_m}', case when {_flag} = 1 then 'Incident {_label}' else 'No {_label}' end, {_names}, {_egfr} from {_t}"""
PARTS["all_groups"] = " union all ".join(f"select * from groups_{t}" for _, t, *_ in _SETS)

_LONG_VALUES = " union all ".join(
    f"select model, \"group\", '{c}' as variable, {c}::double as value from all_groups where {c} is not null"
    for c in CONTINUOUS
)
_LONG_LEVELS = " union all ".join(
    f"select model, \"group\", '{c}' as variable, cast({c} as varchar) as level from all_groups where {c} is not null"
    for c in (*CATEGORICAL, *YES_NO)
)
_add(
    "table1_continuous",
    """select model, "group", variable, known,
  round((max(value) filter (nth = ceil(known * 0.5)) + max(value) filter (nth = floor(known * 0.5) + 1)) / 2, 6) as median,
  round((max(value) filter (nth = ceil(known * 0.25)) + max(value) filter (nth = floor(known * 0.25) + 1)) / 2, 6) as q1,
  round((max(value) filter (nth = ceil(known * 0.75)) + max(value) filter (nth = floor(known * 0.75) + 1)) / 2, 6) as q3
from (select *, row_number() over (partition by model, "group", variable order by value) as nth,
             count(*) over (partition by model, "group", variable) as known from long_values)
group by model, "group", variable, known""",
    long_values=_LONG_VALUES,
)
_add(
    "table1_categorical",
    f"""select *, round(100.0::double * n / known, 6) as percent from (
  select model, "group", variable, level, count(*) as n,
         cast(sum(count(*)) over (partition by model, "group", variable) as bigint) as known
  from long_levels group by model, "group", variable, level)
where variable in ({', '.join(f"'{c}'" for c in CATEGORICAL)}) or level = '1'""",
    long_levels=_LONG_LEVELS,
)
_add(
    "table1_missing",
    " union all ".join(
        f"select model, \"group\", '{c}' as variable, count(*) - count({c}) as unknown from all_groups group by model, \"group\""
        for c in (*CONTINUOUS, *CATEGORICAL, *YES_NO)
    ),
)
_add(
    "statin_drop_in",
    " union all ".join(
        f"select '{m}' as model, count(*) filter (statin_first_date <= {o}_followup_end_date) as drop_in_count from {t} {w}"
        for m, o, t, w in (
            ("PCE 5 yr", "ascvd", "pce", "where statin_first_date <= contact_date + interval 5 year"),
            ("PCE 10 yr", "ascvd", "pce", ""),
            (ASCVD, "ascvd", "prevent_ascvd", ""),
            (TOTAL_CVD, "total_cvd", "prevent_total_cvd", ""),
        )
    ),
)

# --- metric tables ----------------------------------------------------------------------


def _text(x: str) -> str:
    return f"regexp_replace(cast({x} as varchar), '\\.0$', '')"


def _table_one(model: str, label: str) -> str:
    """Cells of the report table, one row per variable, part and level, then side by side."""

    def quantile(p):
        return f"(max(value) filter (nth = ceil(known * {p})) + max(value) filter (nth = floor(known * {p}) + 1)) / 2"

    whole = [_text(f"round({quantile(p)})") for p in (0.5, 0.25, 0.75)]
    share = "100.0::double * n / known"
    cells = [
        f"""select "group", variable, 0 as part, '' as level, {whole[0]} || ' (' || {whole[1]} || ', ' || {whole[2]} || ')' as cell
from (select *, row_number() over (partition by "group", variable order by value) as nth,
             count(*) over (partition by "group", variable) as known from long_values where model = '{model}')
group by "group", variable, known""",
        f"""select "group", variable, 0, case when variable in {tuple(YES_NO)} then '' else level end,
  n || ' (' || case when {share} > 0 and {share} < 0.1 then '<0.1'
    when {share} >= 10 then {_text(f'round({share})')} else {_text(f'round({share}, 1)')} end || '%)'
from (select "group", variable, level, count(*) as n, sum(count(*)) over (partition by "group", variable) as known
      from long_levels where model = '{model}' group by "group", variable, level)
where variable not in {tuple(YES_NO)} or level = '1'""",
    ]
    cells += [
        f"""select "group", '{c}', 1, 'Unknown', cast(count(*) - count({c}) as varchar) from all_groups
where model = '{model}' group by "group" having count(*) > count({c})"""
        for c in LABELS
    ]
    place = " ".join(f"when '{v}' then {i + 1}" for i, v in enumerate(LABELS))
    title = " ".join(f"when '{v}' then '{t}'" for v, t in LABELS.items())
    sides = ", ".join(
        f'max(cell) filter ("group" = \'{g}\') as {name}'
        for name, g in (("overall", "Overall"), ("incident", f"Incident {label}"), ("free", f"No {label}"))
    )
    return f"""select '{model}' as model, '{label}' as outcome, case variable {place} end as position, variable, case variable {title} end as label,
  part, level, {sides} from ({' union all '.join(cells)}) group by variable, part, level"""


_add("table1_report", " union all ".join(_table_one(m, label) for m, _, _, label in _SETS), long_values=_LONG_VALUES, long_levels=_LONG_LEVELS)


def _interval(name: str) -> str:
    parts = [_text(_significant(c, 2)) for c in (name, f"{name}_low", f"{name}_high")]
    return f"{parts[0]} || ' (' || {parts[1]} || ', ' || {parts[2]} || ')'"


_CASES = {
    "Expected cases (risk)": f"expected_cases || ' (' || {_text('expected_risk')} || ')'",
    "Observed cases (risk)": f"observed_cases || ' (' || {_text('observed_risk')} || ')'",
    "Calibration-in-the-large": _text("in_the_large"),
}
_BINARY = {"AUC": _interval("auc"), **_CASES, "Intercept": _interval("intercept"), "Slope": _interval("slope")}
_SURVIVAL = {
    "Harrell's c-index": _text(_significant("cindex", 3)), **_CASES, "Slope": _interval("slope"),
}


def _metric_parts(survival: str, binary: str) -> dict[str, str]:
    out = {
        "s_eo": _expected_observed(survival), "s_c": _concordance(survival), "s_cox": _cox(survival),
        "b_eo": _expected_observed(binary), "b_auc": _auc(binary), "b_fit": _logistic(binary),
        "s_all": "select * from s_eo join s_c using (series) join s_cox using (series)",
        "b_all": "select * from b_eo join b_auc using (series) join b_fit using (series)",
    }
    quoted = {n: n.replace("'", "''") for n in METRICS}
    out["metric_rows"] = " union all ".join(
        f"select series, '{quoted[n]}' as \"Metric\", {v} as \"Value\" from {t}"
        for t, values in (("s_all", _SURVIVAL), ("b_all", _BINARY))
        for n, v in values.items()
    )
    return out


_add(
    "metrics_long",
    'select series, "Metric", "Value" from metric_rows',
    **_metric_parts("survival_rows", "binary_rows"),
)
_add(
    "report_files",
    'select series, "Metric", "Value" from metric_rows',
    **_metric_parts("survival_rows", "binary_rows"),
)
_POSITION = "list_position([" + ", ".join("'" + n.replace("'", "''") + "'" for n in METRICS) + "], \"Metric\")"
_add(
    "metrics_wide",
    f"""select "Metric", cast({_POSITION} as int) as position,
  {', '.join(f'''max("Value") filter (series = '{m}') as "{m}"''' for m in MODELS)}
from metric_rows group by "Metric" """,
    **_metric_parts("survival_rows", "binary_rows"),
)


def _flipped(part: str, shares) -> str:
    return f"""
select series || '|' || share as series, pat_id, risk, lp, years,
       case when outcome = 0 and nth <= ceil(controls * share) then 1 else outcome end as outcome
from (select *, row_number() over (partition by series, outcome order by {_RANDOM}, pat_id) as nth,
             count(*) filter (outcome = 0) over (partition by series) as controls from {part}),
     (select unnest([{', '.join(f'{s}::double' for s in shares)}]) as share)"""


_add(
    "misclassified_noncases",
    "select a.series, a.pat_id from flipped a join all_rows b on a.pat_id = b.pat_id and split_part(a.series, '|', 1) = b.series "
    "where a.outcome = 1 and b.outcome = 0",
    flipped=_flipped("all_rows", SHARES),
)
_add(
    "misclassification_sensitivity",
    """select split_part(series, '|', 1) as "Model", cast(split_part(series, '|', 2) as double) as "Misclassification",
  "Metric", "Value" from metric_rows""",
    s_flipped=_flipped("survival_rows", SHARES),
    b_flipped=_flipped("binary_rows", SHARES),
    **_metric_parts("s_flipped", "b_flipped"),
)
