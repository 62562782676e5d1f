import pytest
from pyspark.sql.utils import AnalysisException

from carecohort import schemas, storage
from carecohort.plans.cohort import CohortBuild, PublishedCohort
from carecohort.sources import extracts

FILES = {
    "patients": (
        "OTHER,PAT_ID,PAT_MRN_ID,BIRTH_DATE,PAT_SEX,ETHNIC_GROUP_NM,PATIENT_RACE,LANGUAGE_NM,MARITAL_STATUS_NM,DEATH_DATE\n"
        'x,p1,M1,1960-01-01,Female,"Hispanic, Latino",asian;,English,Single,\n'
        "x,p2,M2,1970-02-02,Male,Hispanic,asian;,English,Single,2019-05-05\n"
    ),
    "last_encounters": "PAT_ID\tLAST_DISCHARGE_OR_CONTACT_DATE\np1\t2020-01-01 10:00:00\n",
    "diagnoses": "PAT_ID\tPAT_ENC_CSN_ID\tHSP_ACCOUNT_ID\tCONTACT_DATE\tDIAGNOSIS_SOURCE\tCURRENT_ICD10_LIST\np1\te1\t\t2015-01-01\ts\tI10, E11.9\n",
    "encounters": (
        "PAT_ID\tPAT_ENC_CSN_ID\tHSP_ACCOUNT_ID\tCONTACT_DATE\tNOTE\tAPPT_STATUS_NM\tDEPARTMENT_NAME\tPRODUCT_TYPE_NM\tCVD_SCORE_LIST\n"
        "p1\te1\t\t2015-06-01\ta\tCompleted\tClinic\tMEDICARE\t\n"
        "p1\te1\t\t2015-06-01\tb\tCompleted\tClinic\tMEDICARE\t\n"
    ),
    "labs": "PAT_ID\tPAT_ENC_CSN_ID\tCOMPONENT_ID\tCOMPONENT_NM\tRESULT_TIME\tORD_VALUE\np1\te1\t2999\tLDL\t2015-05-01 09:30:00\t>140\n",
    "medications": "PAT_ID\tPAT_ENC_CSN_ID\tORDER_INST\tSTART_DATE\tEND_DATE\tATC_CODE\tATC_TITLE\np1\te1\t2015-01-01 08:00:00\t\t2015-02-01\tC07AB02\tx\n",
    "social_history": "PAT_ID\tCONTACT_DATE\tSMOKING_TOB_USE_NM\tEXTRA\np1\t2015-05-01\tEvery Day\tkept\n",
    "vitals": "PAT_MRN_ID\tPAT_ENC_CSN_ID\tFLO_MEAS_ID\tFLO_MEAS_NAME\tRECORDED_TIME\tMEAS_VALUE\nM1\te1\t5\tBP\t2015-06-01 09:00:00\t120/80\n",
    "ndi": "pat_mrn_id,ndi_state_death_code,ndi_year_death_full,ndi_death_cert_no,ndi_status_code,other\nM2,TX,2019,007,1,x\nM1,TX,2018,008,0,x\n",
    "ndi_cause": (
        "pat_mrn_id,ndi_state_death_code,ndi_year_death_full,ndi_death_cert_no,ndi_month_death,ndi_day_death,"
        "ndi_cause_underlying,ndi_cause_record_1,ndi_cause_record_2,unused\nM2,TX,2019,007,05,06,C349,,I639,I219\n"
    ),
}


@pytest.fixture()
def paths(tmp_path):
    out = {}
    for name, text in FILES.items():
        (tmp_path / f"{name}.txt").write_text(text)
        out[name] = str(tmp_path / f"{name}.txt")
    return out


def test_registry_files(spark, paths):
    t = extracts.read_registry(spark, paths)
    assert set(t) == set(schemas.BASE_TABLES)
    people = {r["pat_id"]: r for r in t["patients"].collect()}
    assert people["p1"]["ethnic_group_nm"] == "Hispanic, Latino"
    assert str(people["p1"]["last_discharge_or_contact_date"]) == "2020-01-01 10:00:00"
    assert people["p2"]["last_discharge_or_contact_date"] is None
    assert t["encounters"].count() == 1  # repeats differ only in a column that is not kept
    lab = t["labs"].first()
    assert (lab["component_id"], str(lab["result_time"]), lab["ord_value"]) == (2999, "2015-05-01 09:30:00", ">140")
    assert t["social_history"].columns == ["pat_id", "contact_date", "smoking_tob_use_nm", "extra"]
    death = t["ndi_cause_of_death"].collect()
    assert [(r["pat_id"], str(r["death_date"]), r["death_cause"]) for r in death] == [("p2", "2019-05-06", "ascvd")]


def test_only_kept_columns_are_parsed(spark, paths):
    df = extracts.read_extract(spark, paths["encounters"], schemas.EXTRACTS["encounters"])
    plan = df.select("pat_id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<PAT_ID:string>" in plan


def test_bad_values_become_null_and_bad_lines_are_listed(spark, tmp_path):
    path = tmp_path / "labs.txt"
    path.write_text("PAT_ID\tCOMPONENT_ID\np1\tnot a number\np2\np3\t7\n")
    schema = schemas._struct(pat_id=schemas._STR, component_id=schemas._LONG)
    got = {r["pat_id"]: r["component_id"] for r in extracts.read_extract(spark, str(path), schema).collect()}
    assert got["p1"] is None and got["p3"] == 7
    assert [r["pat_id"] for r in extracts.rejected_lines(spark, str(path)).collect()] == ["p2"]


def test_quarantine(spark, tmp_path):
    path = tmp_path / "labs.txt"
    path.write_text('PAT_ID\tNOTE\tCOMPONENT_ID\tDAY\np1\t"two\nlines, ""quoted"""\t7\t2015-01-01\np2\tx\nbad\tx\t1\t2015-01-01\tmore\np3\ty\tseven\tnever\np4\t\t\t\n')
    schema = schemas._struct(pat_id=schemas._STR, component_id=schemas._LONG, day=schemas._DATE, note=schemas._STR)
    rows, rejects = extracts.read_checked(spark, str(path), schema, multi_line=True)
    got = {r["pat_id"]: tuple(r)[1:] for r in rows.collect()}
    assert set(got) == {"p1", "p3", "p4"} and got["p3"][:2] == (None, None) and got["p4"] == (None, None, None)
    assert got["p1"][0] == 7 and got["p1"][2] == 'two\nlines, "quoted"'
    listed = sorted((r["reason"], r["column"] or "", r["value"] or "", (r["line"] or "").split("\t")[0]) for r in rejects.collect())
    assert listed == [
        ("fields", "", "", "bad"), ("fields", "", "", "p2"), ("type", "component_id", "seven", ""), ("type", "day", "never", ""),
    ]
    assert all(r["file"].endswith("labs.txt") for r in rejects.collect())


def test_registry_with_rejects(spark, paths, tmp_path):
    with open(paths["labs"], "a") as f:
        f.write("p9\te1\n")
    t = extracts.read_registry(spark, paths, str(tmp_path / "rejects"), multi_line=("patients",))
    assert t["labs"].count() == 1 and t["patients"].count() == 2
    assert [(r["extract"], r["reason"]) for r in spark.read.parquet(str(tmp_path / "rejects")).collect()] == [("labs", "fields")]


def test_clustered_tables_join_without_an_exchange(spark, tmp_path):
    spark.sql("create database if not exists clustered")
    spark.catalog.setCurrentDatabase("clustered")
    changed = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        for name in ("visits", "profile"):
            df = spark.range(400).selectExpr("cast(id % 50 as string) as pat_id", f"id as {name}_n")
            extracts.create_table(df, name, str(tmp_path), "pat_id", 8)
        joined = spark.table("visits").join(spark.table("profile").groupBy("pat_id").count(), "pat_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 400
    finally:
        for k in changed:
            spark.conf.unset(k)
        for name in extracts.table_names(spark):
            spark.sql(f"drop table {name}")
        spark.catalog.setCurrentDatabase("default")


def test_prefix_selection(spark, paths):
    df = extracts.read_by_prefix(spark, paths["ndi_cause"], ("pat_mrn_id",), ("ndi_cause_record",))
    assert df.columns == ["pat_mrn_id", "ndi_cause_record_1", "ndi_cause_record_2"]


def test_create_tables(spark, paths, tmp_path):
    spark.sql("create database if not exists made")
    spark.catalog.setCurrentDatabase("made")
    try:
        build = CohortBuild(extracts.read_registry(spark, paths))
        build.create_tables(str(tmp_path / "tables"))
        assert len(extracts.table_names(spark)) == 13
        assert "pce_first_eligible_encounter_with_predictors" in extracts.table_names(spark)
        assert len(spark.table("pce_first_eligible_encounter_with_predictors").columns) == 43
        later = PublishedCohort(spark)
        assert later.pce_index.columns == build.pce_index.columns
        assert later.pce.count() == build.pce.count() and later.eligible("ascvd").count() == build.eligible("ascvd").count()
        with pytest.raises(AnalysisException):
            extracts.create_table(spark.range(1), "patients", str(tmp_path / "tables"))
    finally:
        for name in extracts.table_names(spark):
            spark.sql(f"drop table {name}")
        spark.catalog.setCurrentDatabase("default")


def test_report_file(spark, tmp_path):
    extracts.write_report(spark.createDataFrame([("AUC", "0.7")], "Metric string, Value string"), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).collect()[0]["Value"] == "0.7"


def test_written_tables_go_to_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    df = storage.written(spark.range(5), "numbers")
    assert df.count() == 5 and all(f.startswith(folder) for f in df.inputFiles())


def test_unset_folder_resolves_under_the_warehouse(spark):
    from carecohort.storage import shared_folder

    class Unset:
        """A session whose folder isn't set."""

        class conf:
            @staticmethod
            def get(key, *default):
                return default[0] if key == "spark.checkpoint.dir" else spark.conf.get(key, *default)

    assert shared_folder(Unset) == spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
