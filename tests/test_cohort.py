import datetime as dt
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from registry import at, day, panel, patient, random_rows, tables, visit

from carecohort.checks.parts import shown, statement
from carecohort.checks.statements import _index_columns
from carecohort.operators import eligibility, index_visit, phenotypes, predictors
from carecohort.operators.deaths import match_deaths
from carecohort.plans.catalog import presentable
from carecohort.plans.cohort import CohortBuild


# --- hand-made patients: one registry, one patient per case -------------------------

CASES: dict[str, dict] = {}


def case(name, *visits, person=None, **rows):
    """Register a patient; ids in the rows are replaced by the case name."""
    CASES[name] = dict(visits=visits, person=person or {}, rows=rows)
    return name


def smoke(*days):
    return [{"contact_date": day(d), "smoking_tob_use_nm": "Every Day"} for d in days]


class Results:
    """Collected cohort tables of all cases, by case name."""

    def __init__(self, spark):
        rows = dict(patients=[], encounters=[], vitals=[])
        for name, c in CASES.items():
            rows["patients"].append(patient(name, **c["person"]))
            for encounter, vital in c["visits"]:
                enc = f"{name}-{encounter['pat_enc_csn_id']}"
                rows["encounters"].append({**encounter, "pat_id": name, "pat_enc_csn_id": enc})
                rows["vitals"].append({**vital, "pat_enc_csn_id": enc})
            for table, extra in c["rows"].items():
                rows.setdefault(table, []).extend({**r, "pat_id": name} for r in extra)
        build = CohortBuild(tables(spark, **rows))
        self.eligible = {n: [] for n in CASES}
        for r in build.eligible("ascvd").collect():
            self.eligible[r["pat_id"]].append(r)
        self.pce, self.ascvd, self.total_cvd = (
            {r["pat_id"]: r for r in df.collect()}
            for df in (build.pce_index, build.prevent_ascvd_index, build.prevent_total_cvd_index)
        )


@pytest.fixture(scope="module")
def results(spark):
    return Results(spark)


JUNE = visit("2015-06-01")
MAY_PANEL = panel("2015-05-01T09:00:00")


def egfr(when, value):
    return {"component_id": 244, "result_time": at(when), "ord_value": value}


def statin(when):
    return [{"order_inst": at(when), "atc_code": "C10AA05"}]


def dx(when, code):
    return [{"contact_date": day(when), "current_icd10_list": code}]


case("onset_at_ten", JUNE, labs=panel("2015-06-01T10:00:00"))
case("onset_at_midnight", JUNE, labs=panel("2015-06-01T00:00:00"))
case("statin_at_midnight", JUNE, labs=MAY_PANEL, medications=statin("2015-06-01T00:00:00"))
case("statin_at_ten", JUNE, labs=MAY_PANEL, medications=statin("2015-06-01T10:00:00"))
case("panel_180_days", JUNE, labs=panel("2014-12-03T09:00:00"))
case("panel_181_days", JUNE, labs=panel("2014-12-02T09:00:00"))
case(
    "three_panels", JUNE,
    labs=panel("2015-04-01T09:00:00") + panel("2015-05-01T09:00:00", ldl="100") + panel("2015-05-20T09:00:00", hdl="n/a"),
)
case(
    "four_visits", visit("2015-06-01", "e0", reading="9/5"), visit("2015-07-01", "e3"),
    visit("2015-07-01", "e2"), visit("2015-08-01", "e1"), labs=MAY_PANEL,
)
case("nearly_forty", visit("2015-01-01"), person={"birth_date": day("1975-12-31")}, labs=panel("2014-12-01T09:00:00"))
case("later_onset", JUNE, labs=MAY_PANEL, diagnoses=dx("2016-01-01", "I10"))
case("smoking_records", JUNE, labs=MAY_PANEL, social_history=smoke("2015-05-01", "2015-05-01", "2019-01-01"))
LOW_PANEL = panel("2015-05-01T09:00:00", ldl="100")
case("only_smoking", JUNE, labs=LOW_PANEL, social_history=smoke("2015-05-01", "2014-01-01"))
case("only_old_smoking", JUNE, labs=LOW_PANEL, social_history=smoke("2014-01-01"))
case("old_smoking", JUNE, labs=MAY_PANEL, social_history=smoke("2014-01-01"))
case(
    "egfr_days", JUNE,
    labs=MAY_PANEL + [egfr("2015-05-02T08:00:00", "70"), egfr("2015-05-02T18:00:00", "75"), egfr("2015-05-02T18:00:00", "74"), egfr("2015-07-01T08:00:00", "80")],
)
case("egfr_181_days", JUNE, labs=MAY_PANEL + [egfr("2014-12-02T08:00:00", "70")])
case("no_event", JUNE, labs=MAY_PANEL)
case("event_after_contact", JUNE, labs=MAY_PANEL, diagnoses=dx("2021-03-01", "Z1, I21.4"))
case("event_far_out", JUNE, labs=MAY_PANEL, diagnoses=dx("2025-12-01", "Z1, I21.4"))
INDEX_DEATH = [{"death_date": day("2018-02-01"), "death_cause": "ascvd"}]
case("index_death", JUNE, labs=MAY_PANEL, deaths=INDEX_DEATH)
case("both_deaths", JUNE, person={"death_date": day("2019-01-01")}, labs=MAY_PANEL, deaths=INDEX_DEATH)


def index_day(results, name):
    row = results.pce.get(name)
    return row and str(row["contact_date"])


# --- timing rules ---------------------------------------------------------------


def test_result_later_on_the_visit_day_is_an_onset_after_the_visit(results):
    assert results.eligible["onset_at_ten"] == []


def test_result_at_midnight_is_not_after_the_visit(results):
    assert index_day(results, "onset_at_midnight") == "2015-06-01"


def test_statin_on_the_visit_day(results):
    assert results.eligible["statin_at_midnight"] == []
    assert len(results.eligible["statin_at_ten"]) == 1


def test_lookback_is_180_days(results):
    assert len(results.eligible["panel_180_days"]) == len(results.eligible["panel_181_days"]) == 1
    assert index_day(results, "panel_180_days") == "2015-06-01"
    assert index_day(results, "panel_181_days") is None


def test_newest_complete_panel_wins(results):
    row = results.pce["three_panels"]
    assert (row["chol_date"], row["ldl_chol"]) == (day("2015-05-01"), 100.0)


def test_first_visit_with_a_pressure_and_the_lowest_encounter(results):
    row = results.pce["four_visits"]
    assert (str(row["contact_date"]), row["pat_enc_csn_id"]) == ("2015-07-01", "four_visits-e2")


def test_age_is_a_difference_of_years(results):
    assert results.eligible["nearly_forty"][0]["age_yrs"] == 40


def test_later_onset_excludes_an_otherwise_eligible_visit(results):
    assert results.eligible["later_onset"] == []


# --- smoking -----------------------------------------------------------------------


def test_eligible_rows_stand_for_smoking_records(results):
    got = Counter((str(r["smoking_status_date"]), r["published_rows"]) for r in results.eligible["smoking_records"])
    assert got == {("2015-05-01", 2): 1, ("2019-01-01", 1): 1}
    assert str(results.pce["smoking_records"]["smoking_status_date"]) == "2015-05-01"


def test_smoking_alone_qualifies_only_within_lookback(results):
    assert [str(r["smoking_status_date"]) for r in results.eligible["only_smoking"]] == ["2015-05-01"]
    assert results.pce["only_smoking"]["current_smoker_flag"] == 1
    assert results.eligible["only_old_smoking"] == [] and "only_old_smoking" not in results.pce


def test_old_smoking_record_is_shown_but_not_current(results):
    row = results.pce["old_smoking"]
    assert str(row["smoking_status_date"]) == "2014-01-01" and row["current_smoker_flag"] == 0


# --- drugs -------------------------------------------------------------------------


def order(code, order_inst=None, start=None, end=None):
    return {
        "pat_id": "p", "atc_code": code, "order_inst": order_inst and at(order_inst),
        "start_date": start and at(start), "end_date": end and day(end),
    }


def test_order_dates_with_a_missing_time(spark):
    t = tables(spark, medications=[order("C10AA05", None, "2015-01-01"), order("A10AB01", None, "2015-01-01")])
    assert phenotypes.first_statin(t["medications"]).first()["statin_first_date"] is None
    row = phenotypes.diabetes_definition(t["diagnoses"], t["medications"]).first()
    assert row["diabetes_med_date"] is None and row["diabetes_date"] is None


def test_statin_takes_the_earlier_start(spark):
    t = tables(spark, medications=[order("C10BX", "2015-02-01", "2015-01-15"), order("C10AA05", "2015-03-01", "2015-04-01")])
    assert phenotypes.first_statin(t["medications"]).first()["statin_first_date"] == at("2015-01-15")


def test_metformin_is_not_a_diabetes_drug(spark):
    t = tables(spark, medications=[order("A10BA02", "2015-01-01")])
    assert phenotypes.diabetes_definition(t["diagnoses"], t["medications"]).count() == 0


def test_second_order_sorts_missing_times_last(spark):
    orders = [order("C07AB02", None, "2014-01-01"), order("C09AA03", "2015-01-01"), order("C02X", "2016-01-01", "2015-06-01")]
    t = tables(spark, medications=orders)
    got = phenotypes.second_antihypertensive(t["medications"]).first()["hypertension_med_date"]
    assert got == at("2015-06-01")
    two = tables(spark, medications=orders[:2])
    assert phenotypes.second_antihypertensive(two["medications"]).first()["hypertension_med_date"] == at("2014-01-01")
    one = tables(spark, medications=orders[1:2])
    assert phenotypes.second_antihypertensive(one["medications"]).count() == 0


def test_supply_rule_reaches_one_class_unless_asked(spark):
    orders = [order("C07AB02", "2015-05-25", "2015-05-25", "2015-06-04"), order("C09AA03", "2015-05-20", "2015-05-20", "2015-06-03")]
    t = tables(spark, medications=orders)
    index = spark.createDataFrame([("p", day("2015-06-01"))], "pat_id string, contact_date date")
    row = predictors.active_antihypertensive(index, predictors.antihypertensive_courses(t["medications"])).first()
    assert row["current_hypertensive_med_start_date"] == at("2015-05-25")
    assert row["current_hypertensive_med_end_date"] == day("2015-06-04")
    strict = predictors.antihypertensive_courses(t["medications"], all_classes_checked=True)
    assert predictors.active_antihypertensive(index, strict).count() == 0


# --- eGFR ---------------------------------------------------------------------------


@pytest.mark.parametrize(
    "component, sex, race, used",
    [
        (1233000244, "Male", None, True), (1233000244, "Female", None, False),
        (1232000244, "Male", None, True),  # also listed for anyone
        (2415, None, "BLACK OR AFRICAN AMERICAN;", True), (2415, None, "WHITE OR CAUCASIAN;", False),
        (2414, None, "WHITE OR CAUCASIAN;", True), (2414, None, None, False), (2415, None, None, False),
        (244, None, None, True), (999, "Male", None, False),
    ],
)
def test_egfr_component_rules(spark, component, sex, race, used):
    lab = {"pat_id": "p", "component_id": component, "result_time": at("2015-05-01"), "ord_value": "61.5"}
    t = tables(spark, patients=[patient(pat_sex=sex, patient_race=race)], labs=[lab])
    assert [r["egfr"] for r in predictors.egfr_results(t["labs"], t["patients"]).collect()] == ([62] if used else [])
    assert predictors.egfr_days(t["labs"], t["patients"]).count() == int(used)


def test_egfr_of_an_unknown_patient(spark):
    labs = [
        {"pat_id": "nobody", "component_id": c, "result_time": at("2015-05-01"), "ord_value": "60"} for c in (244, 2414)
    ]
    t = tables(spark, patients=[patient()], labs=labs)
    assert predictors.egfr_results(t["labs"], t["patients"]).count() == 1


def test_latest_egfr_within_lookback(results):
    assert results.ascvd["egfr_days"]["egfr"] == 75 and results.total_cvd["egfr_days"]["egfr"] == 75
    assert "egfr_181_days" in results.pce
    assert "egfr_181_days" not in results.ascvd and "egfr_181_days" not in results.total_cvd


# --- outcomes and follow-up ------------------------------------------------------------


def test_followup_without_event(results):
    row = results.pce["no_event"]
    assert (row["ascvd_5yr_flag"], row["ascvd_10yr_flag"]) == (0, 0)
    assert row["ascvd_followup_end_date"] == day("2020-01-01") and row["ascvd_followup_years"] == 4.59


def test_event_after_last_contact_ends_followup_itself(results):
    row = results.pce["event_after_contact"]
    assert row["ascvd_followup_end_date"] == day("2021-03-01")
    assert (row["ascvd_5yr_flag"], row["ascvd_10yr_flag"]) == (0, 1)


def test_event_far_out_counts_by_calendar_year_but_followup_is_capped(results):
    row = results.pce["event_far_out"]
    assert row["ascvd_10yr_flag"] == 1 and row["ascvd_followup_end_date"] == day("2025-06-01")


def test_deaths_before_last_contact_end_observation(results):
    row = results.pce["index_death"]
    assert row["last_discharge_or_contact_date"] == day("2018-02-01")
    assert row["ascvd_date"] == day("2018-02-01") and row["ascvd_5yr_flag"] == 1
    row = results.pce["both_deaths"]
    assert row["last_discharge_or_contact_date"] == day("2019-01-01")
    assert row["ascvd_followup_end_date"] == day("2018-02-01")


def test_labels_of_index_deaths_are_exclusive(spark):
    keys = ("M1", "TX", "2015", "C1")
    columns = "pat_mrn_id string, ndi_state_death_code string, ndi_year_death_full string, ndi_death_cert_no string"
    people = spark.createDataFrame([(str(i), f"M{i}") for i in range(1, 5)], "pat_id string, pat_mrn_id string")
    manifest = spark.createDataFrame(
        [(f"M{i}", *keys[1:], "1") for i in (1, 1, 2, 3)] + [("M4", *keys[1:], "0")], columns + ", ndi_status_code string"
    )
    causes = spark.createDataFrame(
        [("M1", *keys[1:], "3", "1", "I500", "I639"), ("M2", *keys[1:], "13", "1", "I509", None),
         ("M3", *keys[1:], "3", "2", None, None), ("M4", *keys[1:], "3", "2", "I219", None)],
        columns + ", ndi_month_death string, ndi_day_death string, ndi_cause_underlying string, ndi_cause_record_1 string",
    )
    got = sorted(map(tuple, match_deaths(manifest, causes, people).collect()), key=str)
    assert got == [("1", day("2015-03-01"), "ascvd"), ("2", None, "total cvd"), ("3", day("2015-03-02"), "other")]


def test_ascvd_deaths_do_not_count_towards_total_cvd(spark):
    deaths = [{"pat_id": "p", "death_date": day("2018-02-01"), "death_cause": "ascvd"}]
    t = tables(spark, deaths=deaths)
    assert phenotypes.first_outcome(t["diagnoses"], t["ndi_cause_of_death"], "ascvd").count() == 1
    assert phenotypes.first_outcome(t["diagnoses"], t["ndi_cause_of_death"], "total_cvd").count() == 0
    counted = phenotypes.first_outcome(t["diagnoses"], t["ndi_cause_of_death"], "total_cvd", count_ascvd_deaths=True)
    assert counted.first()["total_cvd_date"] == day("2018-02-01")


def test_options_reach_the_index_table(spark):
    rows = dict(
        patients=[patient()], deaths=[{"pat_id": "p", "death_date": day("2018-02-01"), "death_cause": "ascvd"}],
        labs=panel("2015-05-01T09:00:00") + [{"pat_id": "p", "component_id": 244, "result_time": at("2015-05-01"), "ord_value": "80"}],
        medications=[order("C07AB02", "2015-05-25", "2015-05-25", "2015-06-04")],
    )
    encounter, vital = visit("2015-06-01")
    base = tables(spark, encounters=[encounter], vitals=[vital], **rows)
    kept = CohortBuild(base).prevent_total_cvd_index.first()
    assert (kept["total_cvd_date"], kept["current_hypertensive_med_flag"]) == (None, 1)
    changed = CohortBuild(base, all_classes_checked=True, count_ascvd_deaths=True).prevent_total_cvd_index.first()
    assert (changed["total_cvd_date"], changed["current_hypertensive_med_flag"]) == (day("2018-02-01"), 0)


def test_leap_day_index(spark):
    df = spark.createDataFrame([(day("2016-02-29"), None, None, None, day("2040-01-01"))],
                               "contact_date date, ascvd_date date, death_date date, ndi_death_date date, last_discharge_or_contact_date date")
    assert index_visit.with_followup(df, "ascvd").first()["ascvd_followup_end_date"] == dt.date(2026, 2, 28)


# --- random registries against SQL -----------------------------------------------------


def text(v):
    return "" if v is None else repr(v) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module", params=[11, 12])
def random_registry(request, spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp(f"registry{request.param}")
    base = tables(spark, **random_rows(request.param))
    views = {}
    for name, df in base.items():
        df.write.parquet(f"{folder}/{name}")
        views[name] = f"select * from read_parquet('{folder}/{name}/*.parquet')"
    return CohortBuild({n: spark.read.parquet(f"{folder}/{n}") for n in base}), views


def same(df, sql_final, views):
    cursor = duckdb.connect().execute(statement(sql_final, views))
    names = [d[0] for d in cursor.description]
    expected = Counter(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    shown_df = presentable(df)
    got = Counter(tuple(text(r[c]) for c in sorted(names)) for r in shown_df.collect())
    assert sorted(shown_df.columns) == sorted(names)
    assert got - expected == Counter() and expected - got == Counter()
    return sum(got.values())


@pytest.mark.parametrize("outcome", ["ascvd", "total_cvd"])
def test_random_eligible(random_registry, outcome):
    b, views = random_registry
    sql = f"select {shown([*eligibility.ELIGIBLE_COLUMNS, 'published_rows'])} from {outcome}_eligible"
    assert same(b.eligible(outcome), sql, views) > 50
    split = eligibility.eligible_encounters(b.base, b.profile, outcome, rows_per_split=20)
    same(split, sql, views)
    same(b.eligible(outcome, expand=True),
         f"select {shown(eligibility.ELIGIBLE_COLUMNS)} from {outcome}_eligible, lateral (select unnest(range(published_rows)))", views)


def test_random_index_tables(random_registry):
    b, views = random_registry
    assert same(b.pce_index, f"select {shown(_index_columns('ascvd', False))} from ascvd_index", views) > 3
    same(b.prevent_ascvd_index, f"select {shown(_index_columns('ascvd', True))} from prevent_ascvd_index", views)
    same(b.prevent_total_cvd_index, f"select {shown(_index_columns('total_cvd', True))} from total_cvd_index", views)


def test_random_definitions(random_registry):
    b, views = random_registry
    base = b.base
    same(predictors.egfr_results(base["labs"], base["patients"]),
         f"select {shown(['pat_id', 'result_time', 'egfr_date', 'egfr'])} from egfrs", views)
    same(predictors.cholesterol_panels(base["labs"]),
         f"select {shown(['pat_id', 'chol_date', 'hdl_chol', 'ldl_chol', 'total_chol'])} from panels", views)
    same(phenotypes.demographics(base["patients"]),
         f"select {shown(['pat_id', 'pat_mrn_id', 'birth_date', 'death_date', 'last_discharge_or_contact_date', 'sex', 'raceth', 'language_primary', 'relationship_status'])} from people", views)
    for name, fn in (("diabetes", phenotypes.diabetes_definition), ("hypertension", phenotypes.hypertension_definition)):
        columns = ["pat_id", f"{name}_dx_date", f"{name}_med_date", f"{name}_date"]
        same(fn(base["diagnoses"], base["medications"]), f"select {shown(columns)} from {name}", views)


def test_random_index_is_unique_and_eligible(random_registry):
    b, _ = random_registry
    for outcome, index in (("ascvd", b.pce_index), ("total_cvd", b.prevent_total_cvd_index)):
        assert index.groupBy("pat_id").count().where("count > 1").count() == 0
        keys = b.eligible(outcome).select("pat_id", "pat_enc_csn_id").distinct()
        assert index.join(keys, ["pat_id", "pat_enc_csn_id"], "left_anti").count() == 0


def test_hot_splits_do_not_change_visit_days(random_registry):
    b, _ = random_registry
    plain = index_visit.visit_days(b.base["encounters"], b.base["vitals"])
    split = index_visit.visit_days(b.base["encounters"], b.base["vitals"], rows_per_split=1)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_result_does_not_depend_on_partitions(random_registry, spark):
    b, _ = random_registry
    few = CohortBuild({n: df.repartition(1) for n, df in b.base.items()})
    assert few.pce_index.exceptAll(b.pce_index).count() == 0
    assert b.pce_index.agg(F.count(F.lit(1))).first() == few.pce_index.agg(F.count(F.lit(1))).first()


def test_analysis_set_filter_reaches_the_scan(random_registry):
    b, _ = random_registry
    plan = index_visit.analysis_set(b.pce_index, by_race=True)._jdf.queryExecution().executedPlan().toString()
    assert "In(sex, [female,male])" in plan and "In(raceth, [nh black,nh white])" in plan
