import json
import os

from pyspark.sql import functions as F

from cadenza.sources import json_ingest as J


def _record(rid, title="Song", date="2001-05-01", gender="male", null_leaf=False):
    hl = {m: {"all": {k: 0.5}} for _, m, k in J.SCORE_PATHS}
    hl["gender"] = {"value": gender}
    hl["genre_tzanetakis"] = {"value": "roc"}
    hl["moods_mirex"] = {"value": "cluster2"}
    if gender is None:
        del hl["gender"]
    if null_leaf:
        hl["mood_sad"]["all"]["sad"] = None
    return {"metadata": {"tags": {"musicbrainz_recordingid": [rid], "title": title if isinstance(title, list) else [title],
                                  "artist": ["Band"], "date": [date]}}, "highlevel": hl}


def _tree(root):
    files = {
        "a/1.json": _record("x"),
        "a/b/2.json": _record("y2", date="abcd"),
        "a/b/3.json": _record("y3", gender=None),
        "a/b/4.json": _record("x", date="1999"),
        "a/b/5.json": _record("y5", title=[]),
        "a/b/7.json": _record("y7", null_leaf=True),
    }
    for rel, rec in files.items():
        p = os.path.join(root, rel)
        os.makedirs(os.path.dirname(p), exist_ok=True)
        with open(p, "w") as f:
            json.dump(rec, f, indent=2)  # multi-line documents
    with open(os.path.join(root, "a/b/6.json"), "w") as f:
        f.write("{bad")
    with open(os.path.join(root, "a/8.txt"), "w") as f:
        f.write("{}")


def test_fixture_tree(spark, tmp_dir):
    _tree(tmp_dir)
    kept, rejects = J.ingest(spark, tmp_dir)
    k = kept.collect()
    assert [r["id"] for r in k] == ["x"]
    assert k[0]["year"] == 2001  # a/1.json sorts before a/b/4.json
    reasons = {os.path.basename(r["_file"]): r["reason"] for r in rejects.collect()}
    assert reasons == {"2.json": "year", "3.json": "missing field", "5.json": "missing field",
                       "6.json": "corrupt", "7.json": "missing field"}


def test_first_element_of_empty_array_is_null(spark):
    v = spark.createDataFrame([([],), (["a"],)], "a array<string>").select(F.get("a", 0).alias("f")).collect()
    assert [r["f"] for r in v] == [None, "a"]
