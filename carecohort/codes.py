"""Code lists, component ids, vocabularies and study limits.

These must stay as they are for results to agree with earlier analyses of the
same registry, including entries that look like typing slips (noted inline).
"""

from __future__ import annotations

# --- study window and eligibility limits -----------------------------------
STUDY_START = "2013-07-01"
STUDY_END = "2018-12-31"
MIN_AGE = 40
MAX_AGE = 75
LOOKBACK_DAYS = 180
MIN_SUPPLY_DAYS = 30
FOLLOWUP_CAP_YEARS = 10

# --- ICD-10 fragments, matched anywhere inside the delimited code list ------
ICD_ASCVD = ("I21", "I22", "I61", "I62", "I63")
ICD_HEART_FAILURE = ("I50",)
ICD_DIABETES = ("E10", "E11", "E13")
ICD_HYPERTENSION = ("I10", "I11", "I12", "I13", "I15")

# Underlying or contributing causes of death are matched by pattern.
DEATH_PATTERN_ASCVD = "I2[12]|I6[123]"
DEATH_PATTERN_TOTAL_CVD = "I2[12]|I6[123]|I50"

# --- ATC fragments -----------------------------------------------------------
ATC_STATIN = ("C10AA", "C10B")
ATC_DIABETES = "A10"
ATC_METFORMIN = "A10BA"
ATC_ANTIHYPERTENSIVE = ("C02", "C03", "C07", "C08", "C09")
ATC_SUPPLY_CHECKED = "C09"  # the only class the 30-day supply rule reaches

# --- laboratory components ---------------------------------------------------
TOTAL_CHOLESTEROL = (1510312, 1557760, 1230000048)
LDL = (2999, 30400410, 1811463, 1230000143, 1230001313)
NON_HDL = (1811467,)
TRIGLYCERIDES = (1552156, 1230000190)
HDL = (1726268, 123000012)  # second id has one digit fewer than its siblings

DYSLIPIDEMIA_LIMITS = (
    (TOTAL_CHOLESTEROL, 200),
    (LDL, 130),
    (NON_HDL, 160),
    (TRIGLYCERIDES, 150),
)

EGFR_FEMALE = (1232000244,)
EGFR_MALE = (1233000244,)
EGFR_BLACK = (2415, 3735)
EGFR_NOT_BLACK = (2414, 3736)
EGFR_ANYONE = (244, 291, 3733, 3740, 3746, 1232000244)
RACE_BLACK = ("BLACK OR AFRICAN AMERICAN;", "BLACK OR AFRICAN AMERICAN; PATIENT REFUSED;")

# --- vitals and social history -----------------------------------------------
SYSTOLIC_FLOWSHEET = 5
SMOKING_NOW = ("Some Days", "Every Day", "Light Smoker", "Heavy Smoker")

# --- recodes: raw value -> reporting value -----------------------------------
INSURANCE = {
    "COMMERCIAL": "commercial",
    "NON-CONTRACTED COMMERCIAL": "commercial",
    "MEDICARE": "medicare",
    "MANAGED MEDICARE": "medicare",
    "MEDICAID": "medicaid",
    "MANAGED MEDICAID": "medicaid",
    "CHARITY": "hospital-based medical assistance",
    "GRANTS": "other",
    "GOVERNMENT OTHER": "other",
    "SELF PAY": "self pay",
    "SELF PAY PENDING": "self pay",
}
LANGUAGE = {
    "English": "english",
    "Spanish": "spanish",
    "Deaf (none ASL)": "american sign language",
    "American Sign Language": "american sign language",
    "Unknown": "unknown",
}
RELATIONSHIP = {
    "Divorced": "single",
    "Legally Separated": "single",
    "Single": "single",
    "Windowed": "single",  # spelled this way; "Widowed" is not listed
    "Common Law": "in a relationship",
    "Life Partner": "in a relationship",
    "Married": "in a relationship",
    "Significant Other": "in a relationship",
    "Other": "other",
}
