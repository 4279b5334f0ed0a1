import math
import urllib.parse

import pytest
from pyspark.sql import functions as F

from cadenza.functions import text as T


def test_adverbs_and_nan(spark):
    vals = [0.0, 0.25, 0.5, 0.75, 1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = [r["a"] for r in df.select(T.adverb(F.col("v")).alias("a")).collect()]
    assert got == ["not ", "not very ", "quite ", "extremely ", "extremely ", "extremely ", "extremely "]


def test_description_template(spark):
    row = dict(name="N", artist="A", year=2001, gender="male", genre="pop", mirex="cluster1",
               dance=0.1, acoustic=0.3, aggressive=0.6, electronic=0.8, happy=0.0, party=0.0,
               relaxed=0.0, sad=0.0, timbre=0.9, tonal=0.0, voice=0.49)
    df = spark.createDataFrame([row])
    d = df.select(T.describe(df).alias("d")).first()["d"]
    assert d.startswith("This song is N, sung by A in 2001. Sung by a male. Likely falls into the pop genre. "
                        "Has the following undertones: passionate, rousing, confident, boisterous, rowdy,  ")
    assert "not dance,not very acoustic,quite aggressive,extremely electronic," in d
    assert "extremely bright," in d and d.endswith("not very voice,instrumental")
    df2 = spark.createDataFrame([dict(row, voice=0.5, genre="roc")])
    d2 = df2.select(T.describe(df2).alias("d")).first()["d"]
    assert d2.endswith("quite voice,vocal") and "the rock genre" in d2


def test_encode_uri_matches_rules(spark):
    samples = ["- 5-LOW by Customer#000000899", "a b*~(x)+é#;,/?:@&=$!'%", "Ünïcödé 100% ok?"]
    got = [r["e"] for r in spark.createDataFrame([(s,) for s in samples], "s string")
           .select(T.encode_uri(F.col("s")).alias("e")).collect()]
    want = [urllib.parse.quote(s, safe=";,/?:@&=+$-_.!~*'()#") for s in samples]
    assert got == want


def test_reply_flags(spark):
    df = spark.createDataFrame([(None,), ("",), (T.RECOMMEND_EXHAUSTED,), ("- a by b",)], "r string")
    got = df.select(T.reply_text(F.col("r")).alias("t"), T.reply_valid(F.col("r")).alias("v")).collect()
    assert [r["t"] for r in got] == [T.REPLY_FALLBACK, T.REPLY_FALLBACK, T.RECOMMEND_EXHAUSTED, "- a by b"]
    assert [r["v"] for r in got] == [False, False, False, True]


def test_recode_whole_value(spark):
    df = spark.createDataFrame([("roc",), ("rocks",), (None,)], "g string")
    got = [r["g"] for r in df.select(T.recode(F.col("g"), T.GENRE_NAMES).alias("g")).collect()]
    assert got == ["rock", "rocks", None]
