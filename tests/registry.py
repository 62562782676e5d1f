"""Hand-made and random registries for the cohort tests."""

import datetime as dt
import random

from pyspark.sql import types as T

from carecohort.schemas import EXTRACTS

DEATHS = "pat_id string, death_date date, death_cause string"
PATIENTS = T.StructType(
    [*EXTRACTS["patients"].fields, T.StructField("last_discharge_or_contact_date", T.DateType())]
)


def day(text):
    return dt.date.fromisoformat(text)


def at(text):
    return dt.datetime.fromisoformat(text)


def tables(spark, **rows):
    """Base tables from lists of dicts; missing tables are empty, missing fields NULL."""
    out = {}
    for name, schema in {**EXTRACTS, "patients": PATIENTS}.items():
        if name == "last_encounters":
            continue
        data = [tuple(r.get(f.name) for f in schema.fields) for r in rows.get(name, [])]
        out[name] = spark.createDataFrame(data, schema)
    deaths = [(r.get("pat_id"), r.get("death_date"), r.get("death_cause")) for r in rows.get("deaths", [])]
    out["ndi_cause_of_death"] = spark.createDataFrame(deaths, DEATHS)
    return out


def patient(pat_id="p", **changes):
    return {
        "pat_id": pat_id, "pat_mrn_id": f"M{pat_id}", "birth_date": day("1960-01-01"), "pat_sex": "Female",
        "ethnic_group_nm": "Not Hispanic", "patient_race": "WHITE OR CAUCASIAN;",
        "language_nm": "English", "marital_status_nm": "Single",
        "last_discharge_or_contact_date": day("2020-01-01"), **changes,
    }


def panel(when, pat_id="p", ldl="140", hdl="50", total="190"):
    """Three lipids at one time; LDL 140 is an onset of dyslipidemia."""
    return [
        {"pat_id": pat_id, "component_id": c, "result_time": at(when), "ord_value": v}
        for c, v in ((2999, ldl), (1726268, hdl), (1510312, total))
    ]


def visit(when, enc="e1", pat_id="p", reading="120/80"):
    encounter = {"pat_id": pat_id, "pat_enc_csn_id": enc, "contact_date": day(when), "product_type_nm": "MEDICARE"}
    vital = {
        "pat_enc_csn_id": enc, "flo_meas_id": 5, "recorded_time": at(when + "T09:00:00"), "meas_value": reading,
    }
    return encounter, vital


def random_rows(seed, patients=60, scale=1):
    """A registry in which patient 1 owns about a third of every table."""
    rng = random.Random(seed)

    def who():
        return "1" if rng.random() < 0.33 else str(rng.randrange(1, patients + 1))

    def some_day(first="2013-01-01", span=2400):
        return day(first) + dt.timedelta(days=rng.randrange(span))

    def some_time(**kw):
        return dt.datetime.combine(some_day(**kw), dt.time(rng.choice([0, 8, 10, 23])))

    def maybe(value, p=0.1):
        return None if rng.random() < p else value

    people = [
        patient(
            str(i), birth_date=maybe(dt.date(rng.randrange(1935, 1980), 3, 1), 0.03),
            pat_sex=rng.choice(["Female", "Male", None]),
            ethnic_group_nm=rng.choice(["Hispanic", "Not Hispanic", None, "Not Hispanic"]),
            patient_race=rng.choice([
                "BLACK OR AFRICAN AMERICAN;", "BLACK OR AFRICAN AMERICAN; PATIENT REFUSED;", "asian;", "ASIAN;",
                "WHITE OR CAUCASIAN;", "Other", None,
            ]),
            language_nm=rng.choice(["English", "Unknown", None, "Deaf (none ASL)", "Farsi"]),
            marital_status_nm=rng.choice(["Windowed", "Widowed", "Married", None]),
            death_date=maybe(some_day(first="2016-01-01"), 0.7),
            last_discharge_or_contact_date=maybe(some_day(first="2015-01-01"), 0.05),
        )
        for i in range(1, patients + 1)
    ]
    encounters, vitals = [], []
    for i in range(600 * scale):
        e, v = visit(str(some_day()), f"e{i:05d}", who(), rng.choice(["120/80", "135/90", "9/5", "x120", "88", None]))
        encounters.append({**e, "product_type_nm": rng.choice(["CHARITY", "MEDICAID", None, "SELF PAY"])})
        vitals += [v] * rng.choice([0, 1, 1, 2])
    labs = []
    for _ in range(1200 * scale):
        p, t = who(), some_time(first="2012-06-01")
        labs += panel(
            str(t), p, rng.choice(["100", "129.5", "140", "150", ">1,000", "<50"]),
            rng.choice(["50", "41.4", "60", "SEE NOTE"]), rng.choice(["150", "210", "1,99"]),
        )
    components = [244, 291, 2414, 2415, 3735, 3736, 1232000244, 1233000244, 1811467, 1552156, 999]
    for _ in range(900 * scale):
        labs.append({
            "pat_id": who() if rng.random() < 0.97 else "unknown", "component_id": rng.choice(components),
            "result_time": some_time(), "ord_value": rng.choice(["55", "61.5", ">90", "n/a", None, "120", "170"]),
        })
    medications = []
    for _ in range(400 * scale):
        started = some_time()
        medications.append({
            "pat_id": who(), "order_inst": maybe(some_time(), 0.2), "start_date": maybe(started, 0.2),
            "end_date": maybe(started.date() + dt.timedelta(days=rng.choice([5, 29, 30, 400]))),
            "atc_code": rng.choice(["C10AA05", "A10AB01", "A10BA02", "C09AA03", "C07AB02", "C02X", None, *["N02BE01"] * 30]),
        })
    diagnoses = [
        {"pat_id": who(), "contact_date": some_day(span=3500),
         "current_icd10_list": rng.choice(["Z00.0", "I10", "E11.9, Z1", *["Z00.0"] * 8, None, "I50.9" if rng.random() < 0.2 else "Z1", "I63.9" if rng.random() < 0.2 else "Z1"])}
        for _ in range(200 * scale)
    ]
    social = [
        {"pat_id": who(), "contact_date": some_day(), "smoking_tob_use_nm": rng.choice(["Never", "Every Day", "Light Smoker"])}
        for _ in range(150 * scale)
    ]
    social += social[:20]
    deaths = [
        {"pat_id": str(i), "death_date": maybe(some_day(first="2015-01-01", span=3000), 0.05), "death_cause": rng.choice(["ascvd", "total cvd", "other"])}
        for i in range(1, patients + 1, 4)
    ]
    return dict(
        patients=people, encounters=encounters, vitals=vitals, labs=labs, medications=medications,
        diagnoses=diagnoses, social_history=social, deaths=deaths,
    )
