"""The pipeline against brute force over one small table."""

import zlib

import numpy as np
from test_dedup_ops import brute_components, near_rows

import corpus_pipeline
from cadenza.llm import bpe_chunks, mixing
from cadenza.session import scratch_path


def test_pipeline(spark):
    from tokenizers import Tokenizer

    rows = near_rows(9)
    rows += [(1000 + d, t.upper()) for d, t in rows[:9] if t] + [(2000, "12 34 !")]
    path = scratch_path(spark, "pipeline-test")
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    got = corpus_pipeline.run(spark, path).collect()

    kept = {d: t for d, t in rows if t and any(c.isalpha() for c in t)}
    last = {}
    for d in sorted(kept):
        last[kept[d].encode().lower()] = d
    kept = {d: kept[d] for d in last.values()}
    comp = brute_components(list(kept.items()), 5, 80)
    kept = {d: t for d, t in kept.items() if comp[d][1] == d}
    left = spark.createDataFrame([(d, t, f"s{d % 3}") for d, t in kept.items()], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in mixing.mix(left).collect()}
    t = Tokenizer.from_file(bpe_chunks.default_tokenizer())
    want = []
    for d, text in kept.items():
        ids = t.encode(text, add_special_tokens=False).ids
        want += [(d, len(ids), np.array(ids, "<u4").tobytes())] * copies[d]
    assert sorted((r.doc_id, r.n_tokens, bytes(r.ids)) for r in got) == sorted(want)


def written(spark, rows):
    path = scratch_path(spark, "pipeline-edges")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int, size int").write.parquet(f"{path}/documents.parquet")
    return path


def test_rows_without_or_with_the_same_id(spark):
    rows = [(None, f"no id number{i} " * 9, "en", None, 1, 2) for i in range(5)] + [(None, "no id number0 " * 9, "en", "s", 1, 2)]
    rows += [(7, "the first text of seven", "en", "s", 1, 2), (7, "The first text of seven", "en", "s", 1, 2), (7, None, "en", "s", 1, 2)]
    path = written(spark, rows)
    docs = corpus_pipeline.read_table(spark, path, "documents")
    exact = corpus_pipeline.exact(spark, docs, path)
    assert exact.columns == docs.columns
    texts = sorted((r.text or "").lower() for r in exact.collect())
    assert texts == sorted({(t or "").lower() for _, t, *_ in rows})  # one row of each text, whatever the ids
    ids = corpus_pipeline.run(spark, path).select("doc_id").distinct().collect()
    assert {r.doc_id for r in ids} == {None, 7}


def test_empty_table(spark):
    got = corpus_pipeline.run(spark, written(spark, []))
    assert got.columns == ["doc_id", "n_tokens", "ids"] and not got.collect()


def test_documents_unlike_every_profile_go(spark):
    held = [d for d in range(1000) if zlib.crc32(str(d).encode()) % 4 == 2]
    learned = [d for d in range(1000) if d not in held]
    rows = [(learned[i], "a plain text in one language", "en", "s", 1, 2) for i in range(3)] + [(held[0], "\u0434\u0432\u0430", None, "s", 1, 2), (held[1], "language", None, "s", 1, 2)]
    docs = corpus_pipeline.read_table(spark, written(spark, rows), "documents")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()) == sorted([*learned[:3], held[1]])
