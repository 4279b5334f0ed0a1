import os

from pyspark.sql import functions as F

from cadenza.operators import sessions as S
from cadenza.operators.ordered import ordered_positions
from cadenza.streaming import jobs

SCHEMA = "request_id bigint, session_id bigint, ts timestamp_ntz, query string"


def _search(requests):
    return requests.select("query").distinct().selectExpr("query AS q", "1L AS rank", "query AS name", "'x' AS artist")


def _log(spark, rows):
    return spark.createDataFrame(rows, "request_id long, session_id long, at int, query string").selectExpr(
        "request_id", "session_id", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, at) AS ts", "query")


def test_sessions_go_on_over_micro_batches_without_a_session_in_one_task(spark, tmp_path):
    # session 1 is hot; 2 misses a batch; None is a session like any other
    texts = ["a"] * 40 + ["", "b", "a", "a", None] + ["a"] * 40 + ["c"] * 40
    rows = [(i, 1, i, t) for i, t in enumerate(texts)]
    rows += [(1000 + i, 2, i, "z") for i in (1, 2, 100, 101)] + [(2000 + i, None, i, "n") for i in (3, 60, 110)]
    for n, (lo, hi) in enumerate([(0, 42), (42, 84), (84, 200)]):
        path = str(tmp_path / f"in{n}")
        _log(spark, [r for r in rows if lo <= r[2] < hi]).coalesce(1).write.parquet(path)
        for f in os.listdir(path):
            os.utime(f"{path}/{f}", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in*"))
    got = jobs.replay_stream(spark, stream, _search)
    want = S.replay_requests(_log(spark, rows), _search(_log(spark, rows)), S.SEARCH_REPLIES)
    key = lambda r: r.request_id
    assert sorted(got.collect(), key=key) == sorted(want.select(*got.columns).collect(), key=key)
    assert got.where("pos = 4").where("request_id = 1101").count() == 1


def test_positions_over_many_pieces(spark):
    """A key over many pieces, runs that span whole pieces, null keys and values, against plain loops."""
    import random
    rnd = random.Random(6)
    rows = [(i, rnd.choice([1, 1, 1, 2, None]), i, "a" if i < 200 else rnd.choice(["a", "b", None])) for i in range(300)]
    want, last = {}, {}
    for i, s, _, q in rows:
        pos, run, n, prev = last.get(s, (0, 0, 0, "none yet"))
        same = prev == q
        last[s] = (pos + 1, run + (not same), n + 1 if same else 1, q)
        want[i] = last[s][:3]
    for parts in (1, 7, 60):
        out = ordered_positions(_log(spark, rows), "session_id", [F.col("ts").asc(), F.col("request_id").asc()], "query", parts)
        assert {r.request_id: (r.pos, r.run_no, r.pos_in_run) for r in out.collect()} == want
        out = ordered_positions(_log(spark, rows), "session_id", [F.col("request_id").asc()], partitions=parts)
        assert {r.request_id: r.pos for r in out.collect()} == {i: w[0] for i, w in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_restart_goes_on_from_the_state_store(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, 1 + i % 3 if i < 9 else 7, i, "a") for i in range(9)]
    _log(spark, rows).coalesce(1).write.parquet(source)
    base = str(tmp_path / "job")

    seen = []

    def run():
        seen.clear()
        return jobs.replay_stream(spark, spark.readStream.schema(SCHEMA).parquet(source), _search, base=base, progress=seen)

    assert sorted(r.pos for r in run().collect()) == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    more = [(20, 1, 20, "a"), (21, 1, 21, "b"), (22, 9, 22, "a"), (23, 1, 23, "")]
    _log(spark, more).coalesce(1).write.mode("append").parquet(source)
    got = {r.request_id: r.pos for r in run().collect()}
    assert {i: got[i] for i in (20, 21, 22, 23)} == {20: 4, 21: 1, 22: 1, 23: None} and len(got) == 13
    # the state store wrote the sessions of the new batch only: 1 and 9 of 4
    state = [p["stateOperators"][0] for p in seen if p["stateOperators"]]
    assert sum(s["numRowsUpdated"] for s in state) == 2 and state[-1]["numRowsTotal"] == 4
    assert run().count() == 13
