"""Explicit schemas of the registry extracts and of the death-index files.

Ids are opaque and read as text; results and readings are text because they
hold entries such as ``>1,000`` or ``120/80``.
"""

from __future__ import annotations

from pyspark.sql import types as T

_STR, _DATE, _TS, _LONG = T.StringType(), T.DateType(), T.TimestampNTZType(), T.LongType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


EXTRACTS = {
    "patients": _struct(
        pat_id=_STR, pat_mrn_id=_STR, birth_date=_DATE, pat_sex=_STR, ethnic_group_nm=_STR,
        patient_race=_STR, language_nm=_STR, marital_status_nm=_STR, death_date=_DATE,
    ),
    "last_encounters": _struct(pat_id=_STR, last_discharge_or_contact_date=_TS),
    "diagnoses": _struct(
        pat_id=_STR, pat_enc_csn_id=_STR, hsp_account_id=_STR, contact_date=_DATE,
        diagnosis_source=_STR, current_icd10_list=_STR,
    ),
    "encounters": _struct(
        pat_id=_STR, pat_enc_csn_id=_STR, hsp_account_id=_STR, contact_date=_DATE,
        appt_status_nm=_STR, department_name=_STR, product_type_nm=_STR, cvd_score_list=_STR,
    ),
    "labs": _struct(
        pat_id=_STR, pat_enc_csn_id=_STR, component_id=_LONG, component_nm=_STR,
        result_time=_TS, ord_value=_STR,
    ),
    "medications": _struct(
        pat_id=_STR, pat_enc_csn_id=_STR, order_inst=_TS, start_date=_TS, end_date=_DATE,
        atc_code=_STR, atc_title=_STR,
    ),
    "social_history": _struct(pat_id=_STR, contact_date=_DATE, smoking_tob_use_nm=_STR),
    "vitals": _struct(
        pat_mrn_id=_STR, pat_enc_csn_id=_STR, flo_meas_id=_LONG, flo_meas_name=_STR,
        recorded_time=_TS, meas_value=_STR,
    ),
}

DEATH_KEYS = ("pat_mrn_id", "ndi_state_death_code", "ndi_year_death_full", "ndi_death_cert_no")

# Tables every cohort build starts from.
BASE_TABLES = (
    "patients", "encounters", "diagnoses", "labs", "medications",
    "social_history", "vitals", "ndi_cause_of_death",
)
