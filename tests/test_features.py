import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import features as FE
from cadenza.operators import quality as Q


def test_population_std(spark):
    xs = [1.0, 2.0, 4.0, 7.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id long, x double")
    z = [r["z"] for r in FE.standardise(df, "x", "z").orderBy("id").collect()]
    a = np.array(xs)
    assert z == pytest.approx(list((a - a.mean()) / a.std()))


def test_constant_null_and_one_row(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "id long, x double")
    z = {r["id"]: r["z"] for r in FE.standardise(df, "x", "z").collect()}
    assert z == {1: 0.0, 2: 0.0, 3: None}
    one = spark.createDataFrame([(1, 3.0)], "id long, x double")
    assert FE.standardise(one, "x", "z").first()["z"] == 0.0


def test_one_hot_unseen_and_null(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "c")], "id long, c string")
    out = FE.one_hot(df, ["c"], {"c": ["a", "b"]}).orderBy("id").collect()
    assert [(r["c_a"], r["c_b"]) for r in out] == [(1.0, 0.0), (0.0, 1.0), (0.0, 0.0), (0.0, 0.0)]


def test_many_categories_have_no_cap(spark):
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"))
    assert FE.fit_categories(df, ["c"])["c"] == sorted(str(i) for i in range(1500))


def test_dedup_first_total_order(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "z"), ("k", 1, "a"), ("j", 5, "q")],
                               "key string, o long, v string")
    got = {r["key"]: (r["o"], r["v"]) for r in Q.dedup_first(df, "key", ["o"]).collect()}
    assert got == {"k": (1, "a"), "j": (5, "q")}


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in [0, 1, 2, 3, 4, 10]], "x double")
    h = {r["bin"]: r["n"] for r in Q.histogram(df, "x", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 1, 4: 0, 5: 1}  # the maximum goes to the last bin
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert sorted((r["bin"], r["n"], r["lo"]) for r in Q.histogram(const, "x", 2).collect()) == [(1, 0, 0.5), (2, 2, 1.0)]


def test_key_check_raises(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    with pytest.raises(ValueError):
        Q.assert_key(df, "id")
    Q.assert_key(spark.createDataFrame([(1,), (2,)], "id long"), "id")


def test_holdout_is_stable(spark):
    a = spark.range(500).select(FE.holdout_flag(F.col("id")).alias("h")).filter("h").count()
    b = spark.range(500).repartition(7).select(FE.holdout_flag(F.col("id")).alias("h")).filter("h").count()
    assert a == b == 91


def test_sparse_rows_over_many_values(spark):
    n = 200_000  # a third of the rows share one value, the rest have 100,000 others
    df = spark.range(n).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id % 100000) END AS a",
                                   "CASE WHEN id % 2 = 0 THEN 'x' END AS b", "CASE WHEN id % 4 <> 0 THEN id / 2 END AS num")
    index = FE.category_index(df, ["a", "b"])
    values = sorted({"hot" if i % 3 == 0 else f"v{i % 100000}" for i in range(n)})
    got = {r["value"]: (r["idx"], r["n"]) for r in index.where("column = 'a'").collect()}
    assert [v for v, _ in sorted(got.items(), key=lambda x: x[1][0])] == values and len(values) > 60_000
    assert got["hot"][1] == (n + 2) // 3
    rows = FE.sparse_features(df, "id", ["num"], ["a", "b"], index)
    place = {v: 1 + i for i, v in enumerate(values)}
    for i in (0, 1, 2, 3, 99_998, 199_999):
        want = {place["hot" if i % 3 == 0 else f"v{i % 100000}"]: 1.0}
        want |= {1 + len(values): 1.0} if i % 2 == 0 else {}
        want |= {0: i / 2} if i % 4 else {}
        assert {r["feature"]: r["value"] for r in rows.where(f"id = {i}").collect()} == want
    assert rows.count() == n + n // 2 + n - n // 4
    with pytest.raises(ValueError, match="sparse_features"):
        FE.fit_categories(df, ["a"])
    new = spark.createDataFrame([(1, "v1", None, None), (2, "unseen", "x", 3.0)], "id long, a string, b string, num double")
    got = {(r["id"], r["feature"], r["value"]) for r in FE.sparse_features(new, "id", ["num"], ["a", "b"], index).collect()}
    assert got == {(1, place["v1"], 1.0), (2, 1 + len(values), 1.0), (2, 0, 3.0)}


def test_sparse_rows_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, a string, num double")
    assert FE.sparse_features(df, "id", ["num"], ["a"], FE.category_index(df, ["a"])).count() == 0
