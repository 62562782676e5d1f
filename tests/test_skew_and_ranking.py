import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from carecohort.operators.ranking import bucket_edges, random_rank, running_sums
from carecohort.operators import skew
from carecohort.operators.skew import hot_keys, join_both_split, join_lookup, numbered_copies


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(1 if i % 3 == 0 else (None if i % 7 == 0 else rng.randrange(50)), i) for i in range(900)]
    facts = spark.createDataFrame(rows, "k int, v int")
    lookup = spark.createDataFrame([(k, f"name{k}") for k in range(0, 40)], "k int, name string")
    return rows, facts, lookup


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("rows_per_split", [10, 1_000_000])
def test_split_join_equals_plain_join(skewed, how, rows_per_split):
    _, facts, lookup = skewed
    split = join_lookup(facts, lookup, ["k"], how, rows_per_split).select("k", "v", "name")
    plain = facts.join(lookup, ["k"], how).select("k", "v", "name")
    assert Counter(map(tuple, split.collect())) == Counter(map(tuple, plain.collect()))


def test_hot_keys_are_split_in_proportion(skewed):
    rows, facts, _ = skewed
    found = {r["k"]: r["_splits"] for r in hot_keys(facts, ["k"], 100).collect()}
    counts = Counter(k for k, _ in rows if k is not None)
    assert found == {k: -(-n // 100) for k, n in counts.items() if n > 100}


def test_repeated_rows_of_a_hot_key_are_split(spark):
    facts = spark.createDataFrame([(1, 5)] * 1000 + [(None, 5)] * 500, "k int, v int").coalesce(1)
    lookup = spark.createDataFrame([(1, "a")], "k int, name string")
    joined = join_lookup(facts, lookup, ["k"], "left", 100)
    assert Counter(map(tuple, joined.collect())) == {(1, 5, "a"): 1000, (None, 5, None): 500}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = join_lookup(facts, lookup, ["k"], "left", 100).groupBy("k", F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter(r["k"] for r in parts)[1] > 1 and Counter(r["k"] for r in parts)[None] > 1


def test_keys_below_a_share_of_the_table_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(skew, "SHARES", 4)
    facts = spark.createDataFrame([(1,)] * 60 + [(2,)] * 30 + [(3,)] * 10, "k int")
    found = {r["k"]: r["_splits"] for r in hot_keys(facts, ["k"], 5).collect()}
    assert found == {1: 3, 2: 2}


def test_both_sides_of_a_hot_key_are_dealt_over_a_grid(spark, tmp_path):
    rows = [(1 if i % 3 == 0 else i, i) for i in range(90)] + [(None, 1), (1, 0)]
    for name, shift in (("a", 0), ("b", 5)):
        spark.createDataFrame([(k, v + shift) for k, v in rows], f"k int, {name} int").write.parquet(f"{tmp_path}/{name}")
    a, b = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    plain = Counter(map(tuple, a.join(b, "k").collect()))
    split = join_both_split(a, b, ["k"], 5)
    assert Counter(map(tuple, split.collect())) == plain and sum(plain.values()) > 900
    assert join_both_split(a.limit(0), b, ["k"], 5).count() == 0
    changed = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        parts = join_both_split(a, b, ["k"], 5).where("k = 1").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in changed:
            spark.conf.unset(k)
    assert len(parts) > 2 and max(r["count"] for r in parts) < 900


def test_running_sums_match_a_sort(spark):
    rng = random.Random(2)
    cells = [(g, round(rng.gauss(0, 1), 3), rng.randrange(1, 5)) for g in "ab" for _ in range(300)]
    unique = {(g, x): n for g, x, n in cells}
    df = spark.createDataFrame([(g, x, n) for (g, x), n in unique.items()], "g string, x double, n int")
    got = running_sums(df, "x", ["n"], bucket_edges(df, ["x"], 16)[0], ["g"]).collect()
    for g in "ab":
        total = 0
        expected = {}
        for (_, x), n in sorted((k, n) for k, n in unique.items() if k[0] == g):
            expected[x] = total
            total += n
        assert {r["x"]: r["before_n"] for r in got if r["g"] == g} == expected


def test_running_sums_without_edges(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 3)], "x double, n int")
    got = {r["x"]: r["before_n"] for r in running_sums(df, "x", ["n"], []).collect()}
    assert got == {1.0: 0, 2.0: 2}


def test_random_rank_is_the_hash_order(spark):
    ids = list(range(500))
    df = spark.createDataFrame([(i, "g1" if i % 3 else "g2") for i in ids], "pat_id int, g string")
    got = {(r["g"], r["pat_id"]): r["random_rank"] for r in random_rank(df, "pat_id", ["g"], seed=7).collect()}
    for g in ("g1", "g2"):
        members = [i for i in ids if ("g1" if i % 3 else "g2") == g]
        ordered = sorted(members, key=lambda i: hashlib.md5(f"{i}|7".encode()).hexdigest())
        assert {i: got[g, i] for i in members} == {i: n + 1 for n, i in enumerate(ordered)}


def test_random_rank_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "pat_id")
    one = random_rank(df.repartition(1), "pat_id").collect()
    many = random_rank(df.repartition(13), "pat_id").collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


@pytest.mark.parametrize("spread", [None, ("k",)])
def test_numbered_copies(spark, monkeypatch, spread):
    monkeypatch.setattr(skew, "ROWS_PER_STEP", 3)
    df = spark.createDataFrame([("a", 7), ("b", 1), ("c", 0), ("d", 3)], "k string, n int")
    got = Counter((r["k"], r["i"]) for r in numbered_copies(df, "n", "i", spread).collect())
    assert got == Counter([("a", i) for i in range(7)] + [("b", 0)] + [("d", i) for i in range(3)])
