import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cadenza.sources import json_ingest as J
from cadenza.sources import tables


def test_bad_key_fails_the_load_and_leaves_the_table(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert tables.load_keyed(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), path, "id") == 2
    for bad in ([(1, "x"), (1, "y")], [(None, "x")]):
        with pytest.raises(ValueError):
            tables.load_keyed(spark.createDataFrame(bad, "id long, v string"), path, "id")
        assert sorted(map(tuple, tables.read_keyed(spark, path).collect())) == [(1, "a"), (2, "b")]
    assert tables.load_keyed(spark.createDataFrame([], "id long, v string"), path, "id") == 0
    assert tables.read_keyed(spark, path).count() == 0


def test_ids_go_on_over_appends(spark, tmp_dir):
    path = f"{tmp_dir}/p"
    tables.create_numbered(spark, path)
    for k, n in enumerate((50, 0, 30)):
        rows = spark.range(n).select((F.lit(n) - F.col("id")).alias("t"), F.lit(k).alias("k")).repartition(4)
        assert tables.append_numbered(rows, path, [F.col("t").asc()], now=datetime(2024, 1, 1 + k)) == n
    got = sorted(map(tuple, tables.read_numbered(spark, path).select("id", "k", "t", "added_at").collect()))
    assert got == [(i + 1, 0, i + 1, datetime(2024, 1, 1)) for i in range(50)] + [(51 + i, 2, i + 1, datetime(2024, 1, 3)) for i in range(30)]
    # an append that broke off before its mark is not read, and the next one takes its ids
    spark.createDataFrame([(81, 9, 9, datetime(2024, 2, 1))], "id long, t long, k int, added_at timestamp_ntz").write.parquet(f"{path}/rows/start=81")
    assert tables.read_numbered(spark, path).count() == 80
    assert tables.append_numbered(spark.range(1).select(F.col("id").alias("t"), F.lit(5).alias("k")), path, [F.col("t").asc()]) == 1
    assert tables.read_numbered(spark, path).where("id = 81").select("k").first()["k"] == 5


def _document(i, year="2001"):
    score = lambda m, k: {m: {"all": {k: 0.5}}}
    high = {}
    for _, m, k in J.SCORE_PATHS:
        high |= score(m, k)
    high |= {m: {"value": "x"} for _, m in J.CATEGORY_PATHS}
    return {"metadata": {"tags": {"musicbrainz_recordingid": [i], "title": ["t"], "artist": ["a"], "date": [year]}}, "highlevel": high}


def test_load_counts_and_names_the_table(spark, tmp_path):
    os.makedirs(tmp_path / "tree/a/b")
    docs = {"a/1.json": _document("x"), "a/b/2.json": _document("x", "2002"), "a/b/3.json": _document("y", "abcd"), "4.json": _document("z")}
    for name, d in docs.items():
        (tmp_path / "tree" / name).write_text(json.dumps(d, indent=2))
    (tmp_path / "tree/a/b/5.json").write_text("{bad")
    (tmp_path / "tree/a/b/notes.txt").write_text("not read")
    got = J.load(spark, str(tmp_path / "tree"), str(tmp_path / "table"))
    assert got == {"read": 5, "kept": 2, "rejected": 2, "duplicate": 1}
    assert {r.id: r.year for r in tables.read_keyed(spark, str(tmp_path / "table")).collect()} == {"x": 2001, "z": 2001}
    rejects = spark.read.parquet(str(tmp_path / "table/rejects"))
    assert {(r._file.rsplit("/", 1)[1], r.reason) for r in rejects.collect()} == {("3.json", "year"), ("5.json", "corrupt")}


def test_many_small_documents_share_a_task(spark, tmp_path):
    os.makedirs(tmp_path / "tree")
    for i in range(200):
        (tmp_path / f"tree/{i}.json").write_text(json.dumps(_document(f"d{i}"), indent=1))
    spark.conf.set("spark.sql.files.openCostInBytes", "4096")
    try:
        df = J.scan(spark, str(tmp_path / "tree"))
        assert df.rdd.getNumPartitions() < 50 and df.count() == 200
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
