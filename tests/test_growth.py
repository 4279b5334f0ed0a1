"""Steps whose disk, memory or time once grew faster than their input."""

import gzip
import json
import os

import numpy as np
from pyspark.sql import functions as F

from cadenza.functions.trigram import similarity
from cadenza.operators import encode as EN
from cadenza.operators import projection as PR
from cadenza.operators import quality as Q
from cadenza.operators import topk
from cadenza.plans import q_ingest
from cadenza.sources import json_ingest as J
from cadenza.streaming import jobs

from conftest import SF001


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _files(root: str) -> list[str]:
    root = root.removeprefix("file:")
    return [os.path.join(d, f) for d, _, names in os.walk(root) for f in names if not f.startswith((".", "_"))]


def test_json_tree_is_compressed(spark):
    files = _files(q_ingest.write_json_tree(spark, SF001))
    assert files and all(f.endswith(".json.gz") for f in files)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_scan_takes_plain_and_compressed_files(spark, tmp_path):
    text = json.dumps({"metadata": {"tags": {"title": ["t"]}}})
    (tmp_path / "a.json").write_text(text)
    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c.gz").write_bytes(gzip.compress(text.encode()))
    assert J.scan(spark, str(tmp_path)).count() == 2


def test_a_document_tree_has_no_folder_per_document(spark):
    files = _files(q_ingest.write_document_tree(spark, SF001))
    assert len({os.path.dirname(f) for f in files}) <= 25
    assert len(files) == spark.read.parquet(f"{SF001}/supplier.parquet").count()


def test_rows_of_one_supplier_share_a_file(spark, tmp_path):
    sup = spark.read.parquet(f"{SF001}/supplier.parquet")
    sup.unionByName(sup).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.read.parquet(f"{SF001}/nation.parquet").write.parquet(str(tmp_path / "nation.parquet"))
    assert len(_files(q_ingest.write_document_tree(spark, str(tmp_path)))) == sup.count()
    rows = lambda sf: sorted(map(str, q_ingest.q_ingest_documents(spark, sf).collect()))
    assert rows(str(tmp_path)) == rows(SF001)


def test_keep_first_shuffles_rows_once(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("k"), F.col("id").alias("a"), F.lit("x").alias("b"))
    plan = _plan(Q.dedup_first(df, "k", ["a"]))
    assert "WindowGroupLimit" in plan and plan.count("Exchange") == 1 and "Join" not in plan


def test_first_arrivals_are_not_broadcast(spark):
    rows = spark.createDataFrame([("a", 1), (None, 1), ("b", 2)], "id string, arrival long")
    got = jobs._first_arrivals(rows, spark.createDataFrame([("a", 1), (None, 1), ("b", 1)], "_id string, first long"))
    assert "Broadcast" not in _plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 1), (None, 1)]


def test_similarity_makes_each_set_once(spark):
    df = spark.createDataFrame([("a b a b", "b a c"), (None, "x"), ("", None)], "a string, b string")
    got = df.select(similarity(F.col("a"), F.col("b")).alias("s"))
    assert _plan(got).count("split(") == 2
    assert [round(r.s, 6) for r in got.collect()] == [0.666667, 0.0, 0.0]


def test_token_counts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a"), (None, "c"), (2, None)], "id long, text string")
    out = EN.hash_embed_sparse(df, "id", "text")
    assert _plan(out).count("Exchange") == 1
    assert sorted((str(r.id), round(r.weight, 6)) for r in out.collect()) == [("1", 0.447214), ("1", 0.894427), ("None", 1.0)]


def test_top_pairs_equal_a_sort_with_many_copies():
    rnd = np.random.default_rng(3)
    C = rnd.standard_normal((9000, 8))
    C /= np.linalg.norm(C, axis=1, keepdims=True)
    C[100:4700] = C[5]
    ids = rnd.permutation(9000)
    Q, k = C[[0, 5, 8000, 200]], 6
    kept = topk._few_copies(C, ids, k)
    assert len(kept) < 4500
    rows, found, _ = topk._top_pairs(Q, C[kept], ids[kept], k)
    S = np.einsum("ijk,ijk->ij", np.repeat(Q[:, None], 9000, 1), np.repeat(C[None], 4, 0))
    want = np.lexsort((np.broadcast_to(ids, S.shape), -S), axis=-1)[:, :k]
    assert [list(found[rows == i]) for i in range(4)] == [list(ids[w]) for w in want]


def test_sparse_inputs_train_the_same():
    import pandas as pd

    x = [np.array([0.0, 2.0, 0.0, 0.5]), np.array([0.0, 0.0, 0.0, 0.0])]
    whole = pd.DataFrame({"x": x})
    places = pd.DataFrame({"xi": [np.flatnonzero(v) for v in x], "xv": [v[v != 0] for v in x]})
    assert (PR._inputs(whole, 4) == PR._inputs(places, 4)).all()


def test_encoded_tokens_are_no_rows(spark):
    df = spark.createDataFrame([(1, "B a"), (1, "a"), (None, "c"), (None, "c d"), (2, None), (3, " .")], "id long, text string")
    want = sorted((str(r.id), r.bucket, round(r.weight, 9)) for r in EN.hash_embed_sparse(df, "id", "text", 16).collect())
    whole, places = (EN.HashEncoder(16).encode(df, "id", "text", out="x", sparse=s) for s in (False, True))
    assert "Generate" not in _plan(whole) + _plan(places) and _plan(places).count("Exchange") == 1
    assert sorted((str(r.id), i, round(v, 9)) for r in whole.collect() for i, v in enumerate(r.x) if v) == want
    assert sorted((str(r.id), i, round(v, 9)) for r in places.collect() for i, v in zip(r.xi, r.xv)) == want


def test_encoder_counts_a_few_texts_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(EN, "BATCH_TOKENS", 3)
    df = spark.createDataFrame([(i, "a b c d"[:1 + 2 * (i % 4)]) for i in range(9)], "id long, text string").coalesce(1)
    got = EN.hash_embed_vectors(df, "id", "text", 16).collect()
    assert len(got) == 9 and all(abs(np.linalg.norm(r.vec) - 1) < 1e-12 for r in got)


def test_places_and_whole_inputs_train_the_same(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, [float(v) if rnd.random() < 0.1 else 0.0 for v in rnd.random(30)], [float(v) for v in rnd.random(3)]) for i in range(60)]
    whole = spark.createDataFrame(rows, "id long, x array<double>, y array<double>")
    places = spark.createDataFrame([(i, [k for k, v in enumerate(x) if v], [v for v in x if v], y) for i, x, y in rows],
                                   "id long, xi array<int>, xv array<double>, y array<double>")
    a, _ = PR.fit_projection(whole, None, epochs=2)
    b, _ = PR.fit_projection(places, None, epochs=2, width=30)
    assert all(np.allclose(p, q, rtol=0, atol=1e-12) for x, y in zip(a, b) for p, q in zip(x, y))


def test_adam_in_place_equals_the_written_out_steps():
    rnd = np.random.default_rng(2)
    x = np.where(rnd.random((50, 40)) < 0.02, rnd.random((50, 40)), 0.0)
    y, start = rnd.random((50, 3)), PR.init_params([40, 6, 5, 3], 1)
    kept = [a.copy() for layer in start for a in layer]
    got, loss = PR.adam_epoch(start, x, y, PR.cosine_similarity_loss, 8, np.random.default_rng(0))
    params, total, t = [list(layer) for layer in start], 0.0, 0
    m, v = ([[np.zeros_like(a) for a in layer] for layer in start] for _ in range(2))
    order = np.random.default_rng(0).permutation(50)
    for s in range(0, 50, 8):
        i, t = order[s:s + 8], t + 1
        acts, zs = PR.forward(params, x[i])
        one, g = PR.cosine_similarity_loss(y[i], acts[-1])
        total += one * len(i)
        for li, layer in enumerate(PR.backward(params, acts, zs, g)):
            for k, grad in enumerate(layer):
                m[li][k] = 0.9 * m[li][k] + 0.1 * grad
                v[li][k] = 0.999 * v[li][k] + 0.001 * grad ** 2
                params[li][k] = params[li][k] - 0.001 * (m[li][k] / (1 - 0.9 ** t)) / (np.sqrt(v[li][k] / (1 - 0.999 ** t)) + 1e-7)
    assert abs(loss - total) < 1e-12 and all((a == b).all() for a, b in zip(kept, [a for layer in start for a in layer]))
    assert all(np.allclose(p, q, rtol=0, atol=1e-12) for a, b in zip(got, params) for p, q in zip(a, b))
