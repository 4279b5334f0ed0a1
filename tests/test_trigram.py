import pytest
from pyspark.sql import functions as F

from cadenza.functions.trigram import register_sql_functions, similarity, trigram_set

PAIRS = [("word", "two words", 4 / 11), ("cat", "cat", 1.0), ("Foo|bar", "foo bar", 1.0), ("abc", "", 0.0)]


def test_trigram_set_rules(spark):
    r = spark.createDataFrame([("word",), ("cat",), (None,)], "s string").select(
        F.array_sort(trigram_set(F.col("s"))).alias("t")).collect()
    assert r[0]["t"] == sorted(["  w", " wo", "wor", "ord", "rd "])
    assert len(r[1]["t"]) == 4
    assert r[2]["t"] == []


@pytest.mark.parametrize("a,b,expected", PAIRS)
def test_similarity_pairs(spark, a, b, expected):
    v = spark.createDataFrame([(a, b)], "a string, b string").select(
        similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert v == pytest.approx(expected)


def test_sql_function_form(spark):
    register_sql_functions(spark)
    v = spark.sql("SELECT similarity('word', 'two words') AS s, size(show_trgm('cat')) AS n").first()
    assert v["s"] == pytest.approx(4 / 11) and v["n"] == 4


def test_threshold_is_strict(spark):
    # 'red widget' vs 'red bolt': 4 shared of 16 -> exactly 0.25, not a hit
    v = spark.createDataFrame([("red widget", "red bolt")], "a string, b string").select(
        similarity(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert v == 0.25 and not (v > 0.25)
