"""Shape of the physical plans the cohort depends on at scale."""

import re

import pytest
from registry import random_rows, tables

from carecohort.operators import eligibility, index_visit, phenotypes, predictors
from carecohort.operators.results import watched_results


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("plans")
    out = {}
    for name, df in tables(spark, **random_rows(1)).items():
        df.write.parquet(f"{folder}/{name}")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


@pytest.fixture()
def shuffled(spark):
    """Plans as they are when no side is small: no broadcast by size, no runtime changes."""
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(text):
    return re.findall(r"(?<!Reused)Exchange hashpartitioning\(([^)]*)\)", text)


def test_patient_rows_are_pre_aggregated_before_each_shuffle(base, shuffled):
    text = plan(phenotypes.patient_profile(base))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # one exchange per source table; smoking has a second, by patient and day
    assert len(exchanges(text)) == 8
    assert text.count("WindowGroupLimit") == 2  # before and after the shuffle


def test_definitions_read_each_source_once(base, shuffled):
    text = plan(phenotypes.diagnosis_onsets(base["diagnoses"]))
    assert text.count("FileScan parquet") == 1 and "partial_min" in text
    assert "ReadSchema: struct<pat_id:string,contact_date:date,current_icd10_list:string>" in text


def test_component_filter_reaches_the_scan(base):
    text = base["labs"].where("component_id in (2999, 30400410)")
    assert "PushedFilters" in plan(text)
    panels = plan(predictors.cholesterol_panels(base["labs"]))
    assert re.search(r"PushedFilters: \[[^\]]*component_id", panels)
    assert "pat_enc_csn_id" not in panels.split("ReadSchema")[1].split("\n")[0]


def test_results_are_cleaned_once(base, spark, tmp_path):
    results = watched_results(base["labs"])
    assert plan(results).count("FileScan") == 1
    results.write.parquet(f"{tmp_path}/results")
    clean = {**base, "labs": spark.read.parquet(f"{tmp_path}/results")}
    for tables_of in (phenotypes.patient_profile, index_visit.visit_timeline):
        assert tables_of(clean).exceptAll(tables_of(base)).count() == 0
        assert "ord_value" not in plan(tables_of(clean))


def test_study_window_reaches_the_scan(base):
    assert re.search(
        r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(contact_date,2013-07-01\)",
        plan(eligibility.clinic_visits(base["encounters"])),
    )


def test_screening_shuffles_the_timeline_once(base, shuffled):
    profile = phenotypes.patient_profile(base)
    timeline = index_visit.visit_timeline(base)
    alone = len(exchanges(plan(timeline)))
    text = plan(index_visit.screened_days(timeline, profile))
    assert len(exchanges(text)) == alone + len(exchanges(plan(profile.drop("smoking"))))
    assert "CartesianProduct" not in text


def test_first_visits_are_cut_before_the_shuffle(base, spark, shuffled):
    screened = index_visit.screened_days(index_visit.visit_timeline(base), phenotypes.patient_profile(base))
    text = plan(index_visit.first_visits(index_visit.candidate_days(screened, "ascvd")))
    assert "WindowGroupLimit" in text


def test_hot_keys_are_the_only_hinted_broadcast(base, shuffled):
    text = plan(predictors.egfr_results(base["labs"], base["patients"]))
    assert "Limit" not in text and "TakeOrdered" not in text  # no hot key is left out
    assert "hashpartitioning(pat_id" in text and "_split" in text
