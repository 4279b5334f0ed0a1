"""Language ID in the pipeline where no profile can be learned."""

import zlib

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["one text", "два", None, "", "12 34 !", "three"]


@pytest.mark.parametrize("labels", ["none", "held out", "learned"])
def test_only_letterless_documents_go(spark, labels):
    held = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 4 == 2]
    ids = {"none": range(6), "held out": held[:6], "learned": [d for d in range(1000) if d not in held][:6]}[labels]
    lang = None if labels == "none" else "en"
    docs = spark.createDataFrame([(d, t, lang, "s", 1) for d, t in zip(ids, TEXTS)], SCHEMA)
    got = corpus_pipeline.language_id(spark, docs, "")
    assert sorted(r.text for r in got.collect()) == ["one text", "three", "два"]
    assert got.columns == docs.columns
