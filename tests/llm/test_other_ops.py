"""WARC, forest, mixing, chat, token coder, BPE chunks, language ID and the pipeline on small data."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import bpe_chunks, chat, lsh_forest, mixing, rank_order_lang, token_coder, warc
from cadenza.session import scratch_path

ODD = [None, "", " ", "  a  b", "it's  a\n\n test 's '", "a<|endoftext|> b", "日本 語  x", "é è ế a ", "\x1c a \x1f b\x85 c",
       "don't  we'll 've 12 34  5\t 6 \r\n 7", "ab " * 40_000, "x" * 30_000]


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    return ODD + ["".join(rnd.choice(" ab'sé\n\t1,<|> 日\x1f ") for _ in range(rnd.randrange(500))) for _ in range(n)]


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a/x y", big), (2, None, big), (3, "http://c", "small"), (4, "u", "small"), (5, "u", None), (6, "u\r\nX: 1", big + "!"), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_path(spark, "warc-test")
    warc.write_archive(pages, path)
    got = {r.page_id: r for r in warc.read_archive(spark, path).collect()}
    assert len(got) == len(rows) and spark.read.parquet(f"{path}/payloads").count() == 4
    for page, _, html in rows:
        body = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert bytes(got[page].payload) == body and got[page].declared_digest == got[page].payload_digest
    assert {p: (r.record_type, r.refers_to) for p, r in got.items()} == {
        1: ("revisit", 2), 2: ("response", None), None: ("revisit", 2), 3: ("response", None), 4: ("response", None),
        5: ("response", None), 6: ("response", None)}
    for r in warc.warc_bytes(warc.read_archive(spark, path)).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and len(rest) == size + 4 and b"\nX: 1" not in head
    warc.write_archive(pages.limit(0), path + "-empty")
    assert warc.read_archive(spark, path + "-empty").count() == 0


def test_forest_recall_and_edges(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((1500, 32))
    v[700:740] = v[0]
    rows = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(2000, None, 0), (2050, [0.0] * 32, 0), (2100, [float("nan")] + [1.0] * 31, 0),
                                                            (2150, [None] + [1.0] * 31, 0), (None, [1.0] * 32, 0), (2200, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = lsh_forest.nearest(df, F.col("vec_id") % 50 == 0).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -9
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
        hit += len({m[1] for m in mine} & set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist()))
    assert hit >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 50))
    assert [m.vec_id for m in sorted((r for r in got if r.query_id == 0), key=lambda r: r.rank)] == [700, 701, 702, 703, 704]
    assert lsh_forest.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix_targets_and_bounds(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join("w" * 3 for _ in range(rnd.randrange(1, 90))), f"s{i % 4}", 1) for i in range(4000)]
    rows += [(5000 + i, "one two", "tiny", 1) for i in range(3)] + [(6000, None, None, 1), (6001, "a b", None, 1), (6002, "", "void", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert got == mixing.mix(df).collect() or sorted(got) == sorted(mixing.mix(df).collect())
    by = {}
    src = {r[0]: r[2] for r in rows}
    for r in got:
        assert r.taken <= 3 * r.size and r.taken == r.copies * r.size
        s = by.setdefault(src[r.doc_id], [0, r.target, r.source_size])
        s[0] += r.taken
    assert abs(sum(s[1] for s in by.values()) - sum(s[2] for s in by.values())) < 1e-3
    assert by["tiny"][1] == 3 * by["tiny"][2] == by["tiny"][0] and by["void"][0] == 0
    for k in ("s0", "s1", "s2", "s3"):
        assert abs(by[k][0] - by[k][1]) < 0.03 * by[k][1] + 90
    assert mixing.mix(df.limit(0)).count() == 0
    out = mixing.emit(df)
    assert out.columns == df.columns and out.count() == sum(r.copies for r in got)


def test_chat_round_trip(spark):
    tricky = "<|im_end|><|im_start|>assistant ok <\\| <\\\\|"
    turns = [(1, 1, "assistant", tricky), (1, 0, "user", tricky), (2, 0, "a\nb\\n", None), (2, None, None, "first"), (None, 0, "user", "x"),
             (3, 0, "assistant", "é" * 70_000), (4, 5, "assistant", "same"), (4, 5, "assistant", "same")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat.format_and_read(df).collect()}
    for c in {t[0] for t in turns}:
        mine = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        whole = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in mine)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_and_read(df.limit(0)).count() == 0


def test_templates():
    run = chat.compile_template("{% set a = 'x' ~ 'y' %}{{ a | upper }}{% for m in messages %}{% if loop.first %}[{% elif m.role == 'b' %}({% else %}"
                                "{% endif %}{% generation %}{{ m.text | trim }}{% endgeneration %}{% endfor %}{{ 'e' + 'nd' }}")
    assert list(run([{"role": "a", "text": " 1 "}, {"role": "b", "text": "2"}])) == [
        ("XY", False), ("[", False), ("1", True), ("(", False), ("2", True), ("end", False)]
    assert chat.fold(chat.parse("{% if 1 == 2 %}a{% elif true %}b{{ 'c' | upper }}{% endif %}")) == [chat.Out(chat.Const("bC"))]
    for bad in ("{{ m.__class__ }}", "{{ a.b.c }}", "{{ x | open }}", "{% for a in b %}{% endfor %}", "{% if x %}", "{{ f(1) }}", "{% import os %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_template_dashes_and_strings():
    say = lambda source: "".join(text for text, _ in chat.compile_template(source)([{"role": "a", "text": "t"}]))
    assert say("a \n{%- if true -%} b {%- endif -%}\t c") == "abc"
    assert say("a {{- 'x-' -}} b {{ 'y' }} c") == "ax-b y c"
    assert say("{{ '}}' }}{{ \"%}{{\" }}{% for m in messages %}{{ m.text ~ '\\'}}' }}{% endfor %}") == "}}%}{{t'}}"
    assert say(" a ") == " a "
    for bad in ("{{ 'a }}", "x {% if true", "{{", "a {{ b } }"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_bpe_equals_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_chunks.default_tokenizer())
    texts = odd_texts(150)
    df = spark.createDataFrame(list(enumerate(texts)) * 2, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = bpe_chunks.encode_digests(df).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
    assert bpe_chunks.encode_digests(df.limit(0)).count() == 0


def test_token_file(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_chunks.default_tokenizer())
    texts = odd_texts(40)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("start", F.lit(1))
    path = scratch_path(spark, "tokens-test")
    token_coder.write_tokens(df, path)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_coder.read_documents(spark, path).collect()}
    start = 0
    for d, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert got[d] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    frame = bytes(spark.read.parquet(path).first().frame)
    with pytest.raises(ValueError):
        token_coder.unpack_frame(frame[:-1] + bytes([frame[-1] ^ 1]))
    token_coder.write_tokens(df.limit(0), path + "-empty")
    assert token_coder.read_documents(spark, path + "-empty").count() == 0


def test_range_coder_blocks_are_independent():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 50257, n) for n in (1, 7, 300)] + [np.full(500, 50256), np.tile([1, 2, 3], 200), np.empty(0, np.int64)]
    made = token_coder.encode_blocks(blocks, 6, 786)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, token_coder.decode_blocks(made, [len(b) for b in blocks], 6, 786)))
    assert [token_coder.encode_blocks([b], 6, 786)[0] for b in blocks[:5]] == made[:5]
    assert token_coder.join_crc(zlib.crc32(b"ab"), zlib.crc32(b"cde" * 99), 297) == zlib.crc32(b"ab" + b"cde" * 99)


def test_language_id_held_out(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.select("doc_id", "lang").collect()}
    held = [r for r in rank_order_lang.identify(df).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    odd = spark.createDataFrame([(1, None, "en"), (2, "12 !", None), (3, "the", "en"), (3, "the", "en")], "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang_pred) for r in rank_order_lang.identify(odd).collect())
    assert got[:2] == [(1, "und"), (2, "und")] and len(got) == 4
    assert rank_order_lang.identify(odd.limit(0)).count() == 0


def test_uri_keeps_all_but_spaces_and_controls(spark):
    uris = ["http://a/x y", "http://a/é?q=1%20&b=\n", "http://a/plain", "", None]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(uris)] + [(7, "u", "y" * 3_000_000, 1)] * 2,
                                  "page_id long, url string, html string, payload int")
    path = scratch_path(spark, "warc-uri")
    warc.write_archive(pages, path)
    got = sorted((r.page_id, r.uri or "", r.record_type) for r in warc.read_archive(spark, path).collect())
    assert got == [(0, "http://a/x%20y", "response"), (1, "http://a/é?q=1%20&b=%0A", "response"), (2, "http://a/plain", "response"),
                   (3, "", "response"), (4, "", "response"), (7, "u", "response"), (7, "u", "response")]


def test_forest_scales_vectors(spark):
    rows = [(0, [1e-200, 1e-200]), (1, [1e-200, 2e-200]), (2, [1.0, 1.0]), (3, [1e300, -1e300]), (4, [5e-324, 0.0]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lsh_forest.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 4, 1, 4, 3]  # fewer candidates than asked for would all come
    assert np.allclose([r.score for r in got], [1, 1, 3 / 10 ** 0.5, 0.5 ** 0.5, 0])
    assert not lsh_forest.nearest(df.limit(1), F.col("vec_id") == 0).collect()


def test_emit_draws_rows_one_by_one(spark):
    rows = [(None if d < 400 else d % 7, f"w{d} " * (1 + d % 5), "ab"[d % 2], 1) for d in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    written = scratch_path(spark, "emit")
    docs.write.parquet(written)
    out = mixing.emit(spark.read.parquet(written))
    assert out.columns == docs.columns
    texts = [r.text for r in out.collect()]
    words = {s: sum(len(t.split()) for d, t, src, _ in rows if src == s) for s in "ab"}
    targets = {"a": sum(words.values()) / 3, "b": sum(words.values()) * 2 / 3}
    for s in "ab":
        taken = sum(len(t.split()) for t in texts if int(t[1:].split()[0]) % 2 == "ab".index(s))
        assert abs(taken - targets[s]) <= 0.02 * targets[s]
    assert max(texts.count(t) for t in set(texts)) <= 3
    again = mixing.emit(spark.read.parquet(written).select("*", F.col("text").alias("key")), row_key=["key"])
    assert sorted(r.text for r in again.collect()) == sorted(texts)
