"""Named SQL building blocks over the star-schema test tables (DuckDB dialect).

Each entry of ``PARTS`` is one common table expression.  They are written the
direct way (wide joins, windows over everything), unlike the Spark operators, so
that the comparison means something; they are meant for small data only.
"""

from __future__ import annotations

import re

from .. import codes
from ..operators.eligibility import ELIGIBLE_COLUMNS
from ..sources.starschema import EGFR_ANYONE, EGFR_COMPONENTS, EGFR_EVERY, PANEL


def in_list(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def has_code(column: str, fragments) -> str:
    return "(" + " or ".join(f"contains({column}, '{f}')" for f in fragments) + ")"


def mapped(column: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"when '{k}' then '{v}'" for k, v in mapping.items())
    return f"case {column} {arms} else '{default}' end"


_MONTHS = "interval 222 month"
_VALUE = "try_cast(regexp_replace(ord_value, '[=><,]', '') as integer)"
_ORDERED = "case when order_inst is not null then least(order_inst, start_date) end"

PARTS: dict[str, str] = {}

# --- registry tables ----------------------------------------------------------

PARTS["items"] = f"""
select o_custkey as pat_id, l_orderkey as pat_enc_csn_id, l_linenumber,
       cast(l_shipdate + {_MONTHS} as date) as d,
       l_orderkey * 31 + l_linenumber * 7 + l_partkey as h
from lineitem join orders on l_orderkey = o_orderkey"""

PARTS["patients"] = """
select c_custkey as pat_id, 'M' || c_custkey as pat_mrn_id,
       date '1936-01-01' + cast((c_custkey * 7919) % 16000 as int) as birth_date,
       case when c_custkey % 40 = 0 then null
            when c_custkey % 4 < 2 then 'Female' else 'Male' end as pat_sex,
       case when c_mktsegment = 'HOUSEHOLD' then 'Hispanic' else 'Not Hispanic' end as ethnic_group_nm,
       case c_nationkey % 6 when 0 then 'BLACK OR AFRICAN AMERICAN;' when 1 then 'WHITE OR CAUCASIAN;'
            when 2 then 'WHITE OR CAUCASIAN;' when 3 then 'asian;' when 4 then 'AMERICAN INDIAN;' end as patient_race,
       case c_custkey % 6 when 0 then 'Spanish' when 1 then 'American Sign Language' when 2 then null
            when 3 then 'Vietnamese' else 'English' end as language_nm,
       case c_custkey % 7 when 0 then 'Single' when 1 then 'Married' when 2 then 'Other'
            when 3 then 'Widowed' when 4 then 'Windowed' end as marital_status_nm,
       case when c_custkey % 11 = 0
            then date '2014-01-01' + cast((c_custkey * 13) % 2500 as int) end as death_date,
       date '2015-01-01' + cast((c_custkey * 17) % 2900 as int) as last_discharge_or_contact_date
from customer"""

PARTS["encounters"] = f"""
select o_custkey as pat_id, o_orderkey as pat_enc_csn_id,
       cast(o_orderdate + {_MONTHS} as date) as contact_date,
       'Clinic ' || (o_orderkey % 12) as department_name,
       case o_orderkey % 9 when 0 then 'COMMERCIAL' when 1 then 'MEDICARE' when 2 then 'MANAGED MEDICAID'
            when 3 then 'CHARITY' when 4 then 'GRANTS' when 5 then 'GOVERNMENT OTHER'
            when 6 then 'SELF PAY PENDING' when 7 then 'OTHER PLAN' end as product_type_nm
from orders"""

PARTS["diagnoses"] = """
select pat_id, pat_enc_csn_id, d as contact_date,
       case when h % 701 = 0 then 'I21.9, E78.5' when h % 701 = 1 then 'I50.9'
            when h % 701 = 2 then 'I63.9' when h % 701 = 5 then 'I61.0'
            when h % 101 = 3 then 'E11.9' when h % 53 = 4 then 'I10' else 'Z00.0' end as current_icd10_list
from items"""

_EGFR = " ".join(f"when {place} then {component}" for place, component in EGFR_COMPONENTS.items())
PARTS["labs"] = f"""
select pat_id, pat_enc_csn_id,
       cast(case when component_id = {EGFR_ANYONE} then case (h // 2) % {EGFR_EVERY} {_EGFR} else {EGFR_ANYONE} end
            else component_id end as bigint) as component_id,
       cast(d as timestamp) + (8 + l_linenumber % 8) * interval 1 hour as result_time,
       case when h % 37 = 0 then 'SEE NOTE' when h % 31 = 0 then '>1,000'
            when h % 29 = 0 then (base + (h * mult) % span) || '.6'
            when h % 23 = 0 then '>' || (base + (h * mult) % span)
            else cast(base + (h * mult) % span as varchar) end as ord_value
from items,
     (values {', '.join(str(p) for p in PANEL)}) as panel(component_id, base, span, mult)
where h % 2 = 0"""

PARTS["vitals"] = f"""
select o_orderkey as pat_enc_csn_id, 5 as flo_meas_id,
       cast(cast(o_orderdate + {_MONTHS} as date) as timestamp) + interval 9 hour as recorded_time,
       case when o_orderkey % 97 = 0 then '9/5' when o_orderkey % 89 = 0 then 'x120'
            else (95 + (o_orderkey * 7) % 90) || '/' || (60 + o_orderkey % 30) end as meas_value
from orders where o_orderkey % 10 <> 3"""

PARTS["medications"] = """
select pat_id,
       case when h % 41 <> 0 then cast(d as timestamp) + interval 10 hour end as order_inst,
       case when h % 3 <> 0 then cast(d as timestamp) + ((h % 5) * 6) * interval 1 hour end as start_date,
       d + cast(10 + h % 120 as int) as end_date,
       case when h % 211 = 0 then 'C10AA05' when h % 97 = 1 then 'A10AB01' when h % 61 = 2 then 'A10BA02'
            when h % 31 = 3 then 'C09AA03' when h % 37 = 4 then 'C07AB02' else 'N02BE01' end as atc_code
from items"""

PARTS["social_history"] = f"""
select o_custkey as pat_id, cast(o_orderdate + {_MONTHS} as date) as contact_date,
       case o_orderkey % 7 when 0 then 'Every Day' when 1 then 'Former Smoker' when 2 then 'Some Days'
            else 'Never' end as smoking_tob_use_nm
from orders where o_orderkey % 3 = 0"""

PARTS["ndi"] = """
select 'M' || c_custkey as pat_mrn_id, 'TX' as ndi_state_death_code,
       cast(2014 + c_custkey % 7 as varchar) as ndi_year_death_full,
       'C' || c_custkey as ndi_death_cert_no,
       case when c_custkey % 39 = 0 then '0' else '1' end as ndi_status_code
from customer where c_custkey % 13 = 0"""

PARTS["ndi_cause"] = """
select 'M' || c_custkey as pat_mrn_id, 'TX' as ndi_state_death_code,
       cast(2014 + c_custkey % 7 as varchar) as ndi_year_death_full,
       'C' || c_custkey as ndi_death_cert_no,
       cast(1 + c_custkey % 12 as varchar) as ndi_month_death,
       cast(1 + c_custkey % 28 as varchar) as ndi_day_death,
       case c_custkey % 4 when 0 then 'I219' when 1 then 'I500' else 'C349' end as ndi_cause_underlying,
       case when c_custkey % 8 = 2 then 'I639' end as ndi_cause_record_1
from customer where c_custkey % 13 = 0"""

_CAUSES = "coalesce(ndi_cause_underlying, '') || ' ' || coalesce(ndi_cause_record_1, '')"
PARTS["ndi_cause_of_death"] = f"""
select pat_id,
       cast(try_strptime(ndi_year_death_full || '/' || ndi_month_death || '/' || ndi_day_death, '%Y/%m/%d') as date) as death_date,
       case when regexp_matches({_CAUSES}, '{codes.DEATH_PATTERN_ASCVD}') then 'ascvd'
            when regexp_matches({_CAUSES}, '{codes.DEATH_PATTERN_TOTAL_CVD}') then 'total cvd'
            else 'other' end as death_cause
from (select distinct * from ndi where ndi_status_code = '1')
join (select distinct pat_id, pat_mrn_id from patients) using (pat_mrn_id)
join ndi_cause using (pat_mrn_id, ndi_state_death_code, ndi_year_death_full, ndi_death_cert_no)"""

# --- onset definitions ----------------------------------------------------------

PARTS["statins"] = f"""
select pat_id, min({_ORDERED}) as statin_first_date
from medications where {has_code('atc_code', codes.ATC_STATIN)} group by pat_id"""

for _outcome, _codes in (
    ("ascvd", codes.ICD_ASCVD), ("total_cvd", codes.ICD_ASCVD + codes.ICD_HEART_FAILURE),
):
    PARTS[f"{_outcome}_dx"] = f"""
select pat_id, min(contact_date) as ascvd_first_date
from diagnoses where {has_code('current_icd10_list', _codes)} group by pat_id"""
    PARTS[f"{_outcome}_outcome"] = f"""
select pat_id, min(day) as {_outcome}_date from (
  select pat_id, ascvd_first_date as day from {_outcome}_dx
  union all
  select pat_id, death_date from ndi_cause_of_death where death_cause = '{_outcome.replace('_', ' ')}')
group by pat_id"""

PARTS["dyslipidemia"] = f"""
select pat_id, min(result_time) as dyslipidemia_date from labs
where {' or '.join(f'(component_id in {in_list(ids)} and {_VALUE} >= {limit})' for ids, limit in codes.DYSLIPIDEMIA_LIMITS)}
group by pat_id"""

PARTS["diabetes_rows"] = f"""
select pat_id, contact_date as dx, cast(null as timestamp) as med from diagnoses
where {has_code('current_icd10_list', codes.ICD_DIABETES)}
union all
select pat_id, null, {_ORDERED} from medications
where contains(atc_code, '{codes.ATC_DIABETES}') and not contains(atc_code, '{codes.ATC_METFORMIN}')"""

PARTS["second_order"] = f"""
select pat_id, least(order_inst, start_date) as hypertension_med_date from (
  select *, row_number() over (partition by pat_id order by order_inst nulls last, start_date nulls last) as nth
  from medications where {has_code('atc_code', codes.ATC_ANTIHYPERTENSIVE)})
where nth = 2"""

PARTS["hypertension_rows"] = f"""
select pat_id, contact_date as dx, cast(null as timestamp) as med from diagnoses
where {has_code('current_icd10_list', codes.ICD_HYPERTENSION)}
union all
select pat_id, null, hypertension_med_date from second_order"""

for _name in ("diabetes", "hypertension"):
    PARTS[_name] = f"""
select pat_id, min(dx) as {_name}_dx_date, min(med) as {_name}_med_date,
       least(cast(min(dx) as timestamp), min(med)) as {_name}_date
from {_name}_rows group by pat_id"""

PARTS["smokers"] = f"""
select pat_id, contact_date as smoking_status_date from social_history
where smoking_tob_use_nm in {in_list(codes.SMOKING_NOW)}"""

PARTS["people"] = f"""
select pat_id, pat_mrn_id, birth_date, death_date,
       cast(last_discharge_or_contact_date as date) as last_discharge_or_contact_date,
       lower(coalesce(pat_sex, 'unknown')) as sex,
       case when ethnic_group_nm = 'Hispanic' then 'hispanic'
            when patient_race ilike '%black%' then 'nh black'
            when starts_with(patient_race, 'asian')
                 or regexp_matches(patient_race, '(?i)indian|hawaiian|other') then 'nh other'
            when patient_race ilike '%caucasian%' then 'nh white' else 'unknown' end as raceth,
       {mapped("coalesce(language_nm, 'Unknown')", codes.LANGUAGE, 'other')} as language_primary,
       {mapped('marital_status_nm', codes.RELATIONSHIP, 'unknown')} as relationship_status
from patients"""

PARTS["index_deaths"] = """
select pat_id, min(death_date) as ndi_death_date from ndi_cause_of_death group by pat_id"""

PARTS["visits"] = f"""
select pat_id, pat_enc_csn_id, contact_date, department_name,
       {mapped('product_type_nm', codes.INSURANCE, 'unknown')} as insurance
from encounters where contact_date between '{codes.STUDY_START}' and '{codes.STUDY_END}'"""

# --- predictors -------------------------------------------------------------------

PARTS["panels"] = f"""
select pat_id, cast(result_time as date) as chol_date,
       avg(v) filter (component_id in {in_list(codes.HDL)}) as hdl_chol,
       avg(v) filter (component_id in {in_list(codes.LDL)}) as ldl_chol,
       avg(v) filter (component_id in {in_list(codes.TOTAL_CHOLESTEROL)}) as total_chol
from (select *, {_VALUE} as v from labs)
where v > 0 and component_id in {in_list(codes.HDL + codes.LDL + codes.TOTAL_CHOLESTEROL)}
group by all"""

PARTS["pressures"] = f"""
select pat_enc_csn_id, min(recorded_time) as systolic_bp_time,
       round(avg(cast(digits as int))) as systolic_bp
from (select *, regexp_extract(meas_value, '^[0-9]*') as digits from vitals)
where flo_meas_id = {codes.SYSTOLIC_FLOWSHEET} and length(digits) between 2 and 3
group by pat_enc_csn_id"""

PARTS["egfrs"] = f"""
select l.pat_id, result_time, cast(result_time as date) as egfr_date, {_VALUE} as egfr
from labs l left join patients p on l.pat_id = p.pat_id
where {_VALUE} is not null and (
     component_id in {in_list(codes.EGFR_ANYONE)}
  or component_id in {in_list(codes.EGFR_FEMALE)} and pat_sex = 'Female'
  or component_id in {in_list(codes.EGFR_MALE)} and pat_sex = 'Male'
  or component_id in {in_list(codes.EGFR_BLACK)} and patient_race in {in_list(codes.RACE_BLACK)}
  or component_id in {in_list(codes.EGFR_NOT_BLACK)} and patient_race not in {in_list(codes.RACE_BLACK)})"""

_OTHER_CLASSES = tuple(c for c in codes.ATC_ANTIHYPERTENSIVE if c != codes.ATC_SUPPLY_CHECKED)
PARTS["hypertensive_orders"] = f"""
select pat_id, end_date, least(order_inst, start_date) as started from medications
where {has_code('atc_code', _OTHER_CLASSES)}
   or contains(atc_code, '{codes.ATC_SUPPLY_CHECKED}') and date_diff('day', order_inst, end_date) >= {codes.MIN_SUPPLY_DAYS}"""

# --- cohort tables ----------------------------------------------------------------

PARTS["smoking_dates"] = "select pat_id, smoking_status_date, count(*) as records from smokers group by all"


def eligible(outcome: str, smoking: str, shown_rows: str = "", records: str = "") -> str:
    """Eligible visits by the rows of ``smoking``."""
    return f"""
select {', '.join('v.pat_id' if c == 'pat_id' else 'obs_end as ' + c if c.startswith('last_') else c for c in ELIGIBLE_COLUMNS)}{shown_rows}
from (
  select v.*, pe.* exclude (pat_id, last_discharge_or_contact_date), statin_first_date, ascvd_first_date,
         dyslipidemia_date, di.* exclude (pat_id), hy.* exclude (pat_id), smoking_status_date{records}, ndi_death_date,
         year(contact_date) - year(birth_date) as age_yrs,
         case when last_discharge_or_contact_date > death_date then death_date
              when last_discharge_or_contact_date > ndi_death_date then ndi_death_date
              else last_discharge_or_contact_date end as obs_end
  from visits v
  left join people pe on v.pat_id = pe.pat_id
  left join statins st on v.pat_id = st.pat_id
  left join {outcome}_dx ev on v.pat_id = ev.pat_id
  left join dyslipidemia dy on v.pat_id = dy.pat_id
  left join diabetes di on v.pat_id = di.pat_id
  left join hypertension hy on v.pat_id = hy.pat_id
  left join {smoking} sm on v.pat_id = sm.pat_id
  left join index_deaths de on v.pat_id = de.pat_id) v
where age_yrs between {codes.MIN_AGE} and {codes.MAX_AGE}
  and coalesce(contact_date < statin_first_date, true) and coalesce(contact_date < ascvd_first_date, true)
  and coalesce(contact_date >= dyslipidemia_date, true) and coalesce(contact_date >= diabetes_date, true)
  and coalesce(contact_date >= hypertension_date, true)
  and (coalesce(dyslipidemia_date, diabetes_date, hypertension_date) is not null
       or date_diff('day', smoking_status_date, contact_date) between 0 and {codes.LOOKBACK_DAYS})"""


for _outcome in ("ascvd", "total_cvd"):
    PARTS[f"{_outcome}_eligible"] = eligible(
        _outcome, "smoking_dates", ", coalesce(records, 1) as published_rows", ", records"
    )

_NEAR = f"between 0 and {codes.LOOKBACK_DAYS}"
_ORDER = f"""contact_date, pat_enc_csn_id, chol_date desc, {{egfr}}
    coalesce(date_diff('day', smoking_status_date, contact_date) {_NEAR}, false) desc, smoking_status_date desc nulls last"""

PARTS["ascvd_first"] = f"""
select * from (
  select *, row_number() over (partition by pat_id order by {_ORDER.format(egfr='')}) as patient_encounter_row_num
  from ascvd_eligible join pressures using (pat_enc_csn_id) join panels using (pat_id)
  where date_diff('day', chol_date, contact_date) {_NEAR}
    and hdl_chol is not null and ldl_chol is not null and total_chol is not null)
where patient_encounter_row_num = 1"""

PARTS["total_cvd_first"] = f"""
select * from (
  select *, row_number() over (partition by pat_id
      order by {_ORDER.format(egfr='result_time desc, egfr desc,')}) as patient_encounter_row_num
  from total_cvd_eligible join pressures using (pat_enc_csn_id) join egfrs using (pat_id) join panels using (pat_id)
  where date_diff('day', chol_date, contact_date) {_NEAR} and date_diff('day', egfr_date, contact_date) {_NEAR}
    and hdl_chol is not null and ldl_chol is not null and total_chol is not null)
where patient_encounter_row_num = 1"""

for _outcome in ("ascvd", "total_cvd"):
    PARTS[f"{_outcome}_treated"] = f"""
select pat_id, min(started) as current_hypertensive_med_start_date, min(end_date) as current_hypertensive_med_end_date
from hypertensive_orders join {_outcome}_first using (pat_id)
where contact_date >= started and contact_date <= end_date group by pat_id"""
    PARTS[f"{_outcome}_index"] = f"""
select *,
  coalesce(cast(diabetes_date <= contact_date as int), 0) as diabetes_flag,
  coalesce(cast(hypertension_date <= contact_date as int), 0) as hypertension_flag,
  coalesce(cast(dyslipidemia_date <= contact_date as int), 0) as dyslipidemia_flag,
  coalesce(cast(date_diff('day', smoking_status_date, contact_date) {_NEAR} as int), 0) as current_smoker_flag,
  cast(current_hypertensive_med_start_date is not null as int) as current_hypertensive_med_flag,
  coalesce(cast(year({_outcome}_date) - year(contact_date) <= 5 as int), 0) as {_outcome}_5yr_flag,
  coalesce(cast(year({_outcome}_date) - year(contact_date) <= 10 as int), 0) as {_outcome}_10yr_flag,
  case when {_outcome}_date > last_discharge_or_contact_date
       then least({_outcome}_date, cast(contact_date + interval 10 year as date))
       else least({_outcome}_date, death_date, ndi_death_date, last_discharge_or_contact_date,
                  cast(contact_date + interval 10 year as date)) end as {_outcome}_followup_end_date,
  round(date_diff('day', contact_date, {_outcome}_followup_end_date) / 365.25, 2) as {_outcome}_followup_years
from {_outcome}_first left join {_outcome}_treated using (pat_id) left join {_outcome}_outcome using (pat_id)"""

PARTS["prevent_ascvd_index"] = f"""
select * exclude (nth) from (
  select *, row_number() over (partition by pat_id order by result_time desc, egfr desc) as nth
  from ascvd_index join egfrs using (pat_id) where date_diff('day', egfr_date, contact_date) {_NEAR})
where nth = 1"""


def statement(final: str, extra: dict[str, str] | None = None) -> str:
    """One SQL statement: ``final`` preceded by every building block it refers to."""
    known = {**PARTS, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str) -> None:
        for word in dict.fromkeys(re.findall(r"\b(?:from|join)\s+(\w+)|,\s*\n?\s*(\w+)\b", sql)):
            name = word[0] or word[1]
            if name in known and name not in needed:
                visit(known[name])
                needed.append(name)

    visit(final)
    blocks = ",\n".join(f"{n} as materialized ({known[n].strip()})" for n in needed)
    return f"with {blocks}\n{final.strip()}" if needed else final.strip()


# --- display: how result columns are written for the comparison -------------------

_DATES = {
    "contact_date", "death_date", "ndi_death_date", "ascvd_first_date", "diabetes_dx_date",
    "hypertension_dx_date", "smoking_status_date", "last_discharge_or_contact_date", "chol_date",
    "egfr_date", "current_hypertensive_med_end_date", "ascvd_date", "total_cvd_date", "birth_date",
    "ascvd_followup_end_date", "total_cvd_followup_end_date",
}
_TIMES = {
    "statin_first_date", "dyslipidemia_date", "diabetes_med_date", "diabetes_date",
    "hypertension_med_date", "hypertension_date", "systolic_bp_time", "result_time",
    "current_hypertensive_med_start_date",
}


def six(expression: str) -> str:
    """Six decimals; a negative zero is shown as zero."""
    return f"case when round({expression}, 6) = 0 then 0::double else round(cast({expression} as double), 6) end"


def shown(names) -> str:
    """Select list writing dates and times as text and rounding measurements."""
    out = []
    for n in names:
        if n in _DATES:
            out.append(f"strftime({n}, '%Y-%m-%d') as {n}")
        elif n in _TIMES:
            out.append(f"strftime({n}, '%Y-%m-%d %H:%M:%S') as {n}")
        elif n.endswith(("_chol", "_years", "_bp")) or n.startswith(("ln_", "xb", "pce_", "so_", "log_odds", "prevents_")):
            out.append(f"{six(n)} as {n}")
        elif n == "age_yrs" or n.endswith("_flag") or n in ("egfr", "patient_encounter_row_num"):
            out.append(f"cast({n} as int) as {n}")
        else:
            out.append(n)
    return ", ".join(out)
