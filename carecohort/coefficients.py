"""Published coefficients of the scored risk equations.

Pooled Cohort Equations: 2013 ACC/AHA guideline on the assessment of
cardiovascular risk (10.1016/j.jacc.2013.11.005) with the 5-year baseline
survival of 10.1001/jama.2014.2630.  PREVENT base equations:
10.1161/CIRCULATIONAHA.123.067626.  Statin terms (x11, x13) are not scored: a
prior statin excludes a patient from the cohort.
"""

from __future__ import annotations

PCE = {
    ("female", "nh black"): {
        "ln_age": 17.114,
        "ln_tc": 0.940,
        "ln_hdl": -18.920,
        "ln_age_ln_hdl": 4.475,
        "ln_treated_sbp": 29.291,
        "ln_age_ln_treated_sbp": -6.432,
        "ln_untreated_sbp": 27.820,
        "ln_age_ln_untreated_sbp": -6.087,
        "current_smoker_flag": 0.691,
        "diabetes_flag": 0.874,
    },
    ("female", "nh white"): {
        "ln_age": -29.799,
        "ln_age_squared": 4.884,
        "ln_tc": 13.540,
        "ln_age_ln_tc": -3.114,
        "ln_hdl": -13.578,
        "ln_age_ln_hdl": 3.149,
        "ln_treated_sbp": 2.019,
        "ln_untreated_sbp": 1.957,
        "current_smoker_flag": 7.574,
        "ln_age_current_smoker_flag": -1.665,
        "diabetes_flag": 0.661,
    },
    ("male", "nh black"): {
        "ln_age": 2.469,
        "ln_tc": 0.302,
        "ln_hdl": -0.307,
        "ln_treated_sbp": 1.916,
        "ln_untreated_sbp": 1.809,
        "current_smoker_flag": 0.549,
        "diabetes_flag": 0.645,
    },
    ("male", "nh white"): {
        "ln_age": 12.344,
        "ln_tc": 11.853,
        "ln_age_ln_tc": -2.664,
        "ln_hdl": -7.990,
        "ln_age_ln_hdl": 1.769,
        "ln_treated_sbp": 1.797,
        "ln_untreated_sbp": 1.764,
        "current_smoker_flag": 7.837,
        "ln_age_current_smoker_flag": -1.795,
        "diabetes_flag": 0.658,
    },
}

# stratum -> (5-year survival, 10-year survival, mean linear predictor)
PCE_BASELINE = {
    ("female", "nh black"): (0.98194, 0.9533, 86.61),
    ("female", "nh white"): (0.98898, 0.9665, -29.19),
    ("male", "nh black"): (0.95726, 0.8954, 19.54),
    ("male", "nh white"): (0.96254, 0.9144, 61.18),
}

PREVENT_ASCVD = {
    "female": {
        "intercept": -3.819975,
        "x1": 0.719883,
        "x2": 0.1176967,
        "x3": -0.151185,
        "x4": -0.0835358,
        "x5": 0.3592852,
        "x6": 0.8348585,
        "x7": 0.4831078,
        "x8": 0.4864619,
        "x9": 0.0397779,
        "x10": 0.2265309,
        "x12": -0.0395762,
        "x14": -0.0567839,
        "x15": 0.0325692,
        "x16": -0.1035985,
        "x17": -0.2417542,
        "x18": -0.0791142,
        "x19": -0.1671492,
    },
    "male": {
        "intercept": -3.500655,
        "x1": 0.7099847,
        "x2": 0.1658663,
        "x3": -0.1144285,
        "x4": -0.2837212,
        "x5": 0.3239977,
        "x6": 0.7189597,
        "x7": 0.3956973,
        "x8": 0.3690075,
        "x9": 0.0203619,
        "x10": 0.2036522,
        "x12": -0.0322916,
        "x14": -0.0300005,
        "x15": 0.0232747,
        "x16": -0.0927024,
        "x17": -0.2018525,
        "x18": -0.0970527,
        "x19": -0.1217081,
    },
}

PREVENT_TOTAL_CVD = {
    "female": {
        "intercept": -3.307728,
        "x1": 0.7939329,
        "x2": 0.0305239,
        "x3": -0.1606857,
        "x4": -0.2394003,
        "x5": 0.360078,
        "x6": 0.8667604,
        "x7": 0.5360739,
        "x8": 0.6045917,
        "x9": 0.0433769,
        "x10": 0.3151672,
        "x12": -0.0663612,
        "x14": -0.0819715,
        "x15": 0.0306769,
        "x16": -0.0946348,
        "x17": -0.27057,
        "x18": -0.078715,
        "x19": -0.1637806,
    },
    "male": {
        "intercept": -3.031168,
        "x1": 0.7688528,
        "x2": 0.0736174,
        "x3": -0.0954431,
        "x4": -0.4347345,
        "x5": 0.3362658,
        "x6": 0.7692857,
        "x7": 0.4386871,
        "x8": 0.5378979,
        "x9": 0.0164827,
        "x10": 0.288879,
        "x12": -0.0475924,
        "x14": -0.0517874,
        "x15": 0.0191169,
        "x16": -0.1049477,
        "x17": -0.2251948,
        "x18": -0.0895067,
        "x19": -0.1543702,
    },
}
