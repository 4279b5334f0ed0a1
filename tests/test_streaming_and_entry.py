import os
import sys

from pyspark.sql import functions as F

from cadenza.plans import registry
from cadenza.plans.q_features import DEDUP_ORDER
from cadenza.plans.q_ingest import _out, write_json_tree
from cadenza.sources import json_ingest as J
from cadenza.streaming import jobs

from conftest import SF001


def _same(a, b):
    """Small fixtures: compare the collected rows as sorted lists."""
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.select(*a.columns).collect()), key=key)


def test_stream_ingest_equals_batch_over_several_micro_batches(spark):
    root = write_json_tree(spark, SF001)
    kept, _ = J.ingest(spark, root, multi_line=False, dedup_order=DEDUP_ORDER)
    streamed = jobs.ingest_stream(spark, root, DEDUP_ORDER, max_files_per_trigger=1)
    assert _same(_out(kept), _out(streamed))


def test_stream_replay_equals_batch(spark):
    registry.load_all()
    a = registry.QUERIES["replay_requests"](spark, SF001)
    b = registry.QUERIES["stream_replay"](spark, SF001)
    assert _same(a, b)


def test_repeated_batch_adds_no_row_and_late_texts_are_answered(spark, tmp_path):
    from cadenza.operators import sessions as S
    schema = "request_id bigint, session_id bigint, ts timestamp_ntz, query string"
    for n, texts in enumerate((["a", None, "a"], ["a", "new"])):
        spark.sql("SELECT " + f"explode(array({', '.join(f'struct({10 * n + i}L, {repr(t) if t else chr(39) * 2})' for i, t in enumerate(texts))})) AS r") \
            .selectExpr("r.col1 AS request_id", "1L AS session_id",
                        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, r.col1) AS ts", "r.col2 AS query") \
            .coalesce(1).write.parquet(str(tmp_path / f"in{n}"))
    failed = []

    def search(requests):
        if not failed:  # the first attempt of the first batch breaks off
            failed.append(1)
            raise RuntimeError("lost")
        return requests.select("query").distinct().selectExpr("query AS q", "1L AS rank", "query AS name", "'x' AS artist")

    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))

    try:
        jobs.replay_stream(spark, stream(), search)
        raise AssertionError("the first attempt should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    got = {r["request_id"]: (r["pos"], r["reply"]) for r in jobs.replay_stream(spark, stream(), search).collect()}
    assert {k: v[0] for k, v in got.items()} == {0: 1, 1: None, 2: 2, 10: 3, 11: 1}
    assert got[1][1] == S.NO_QUERY and "new by x" in got[11][1] and got[10][1] == S.SEARCH_REPLIES.exhausted


def test_entry_contract(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["qid", "rank", "id", "reply"]
    assert set(E.oracle_sql()) <= set(E.queries())
