"""Every registered query against its SQL, and what its plan must not contain."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from carecohort.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def text(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    df = registered.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert forbidden not in plan
    rows = df.collect()
    statement = registered.oracle_sql().get(name)
    if statement is None:
        assert name == "smoothed_calibration" and rows
        return
    cursor = sql.execute(statement)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = Counter(tuple(text(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    got = Counter(tuple(text(r[c]) for c in sorted(names)) for r in rows)
    assert got - expected == Counter() and expected - got == Counter()


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["sex", "raceth", "patients", "events", "mean_risk_10yr"] and df.count() > 0


@pytest.fixture(scope="module")
def smoked_twice(tmp_path_factory):
    """The small tables with every current smoker's record of a day there twice more."""
    folder = tmp_path_factory.mktemp("smoked_twice")
    connection = duckdb.connect()
    for t in TABLES:
        more = " union all select * exclude (n) replace (o_orderkey + 21000000 * n as o_orderkey) " \
            f"from '{FOLDER}/orders.parquet', range(1, 3) r(n) where o_orderkey % 3 = 0 and o_orderkey % 7 in (0, 2)"
        source = f"select * from '{FOLDER}/{t}.parquet'" + (more if t == "orders" else "")
        connection.execute(f"copy ({source}) to '{folder}/{t}.parquet'")
        connection.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return str(folder), connection


@pytest.mark.parametrize("name", ["ascvd_eligible", "total_cvd_eligible"])
def test_eligible_visits_are_there_once_per_smoking_record(spark, smoked_twice, name):
    folder, connection = smoked_twice
    rows = [tuple(map(text, r)) for r in registered.queries()[name](spark, folder).collect()]
    expected = Counter(tuple(map(text, r)) for r in connection.execute(registered.oracle_sql()[name]).fetchall())
    assert Counter(rows) == expected and set(expected.values()) == {1, 3}
