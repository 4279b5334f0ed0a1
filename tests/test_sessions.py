from datetime import datetime, timedelta

import pytest
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.operators import sessions as S
from cadenza.plans.q_sessions import registrations

from conftest import SF001

T0 = datetime(2024, 1, 1)


def request_runs_window(requests: DataFrame, session: str = "session_id", ts: str = "ts",
                        rid: str = "request_id", query: str = "query") -> DataFrame:
    """The plain window form (one task per session), which the library's form is tested against."""
    w = Window.partitionBy(session).orderBy(F.col(ts), F.col(rid))
    prev = F.lag(F.col(query)).over(w)
    change = F.when((F.row_number().over(w) == 1) | ~prev.eqNullSafe(F.col(query)), F.lit(1)).otherwise(F.lit(0))
    runs = requests.withColumn("_chg", change).withColumn(
        "run_no", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    wr = Window.partitionBy(session, "run_no").orderBy(F.col(ts), F.col(rid))
    return runs.withColumn("pos", F.row_number().over(wr)).drop("_chg").withColumn(
        "run_no", F.col("run_no").cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))


def playlist_listing_window(state: DataFrame, user: str = "username", ts: str = "added_at") -> DataFrame:
    w = Window.partitionBy(user).orderBy(F.col(ts).desc_nulls_first(), F.col("id").asc())
    return state.withColumn("pos", F.row_number().over(w).cast("bigint"))


def _requests(spark, queries, session=1):
    rows = [(i, session, T0 + timedelta(seconds=i), q) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "request_id long, session_id long, ts timestamp_ntz, query string")


def _results(spark, per_query):
    rows = [(q, r, f"n{q}{r}", "a") for q, n in per_query.items() for r in range(1, n + 1)]
    return spark.createDataFrame(rows, "q string, rank long, name string, artist string")


def test_runs_AABA(spark):
    r = S.request_runs(_requests(spark, ["A", "A", "B", "A"])).orderBy("request_id").collect()
    assert [(x["run_no"], x["pos"]) for x in r] == [(1, 1), (1, 2), (2, 1), (3, 1)]


def test_replay_17_with_k15(spark):
    runs = S.request_runs(_requests(spark, ["A"] * 17))
    out = S.replay(runs, _results(spark, {"A": 15}), S.RECOMMEND_REPLIES).orderBy("request_id").collect()
    assert [o["reply"] for o in out[:15]] == [f"- nA{i} by a" for i in range(1, 16)]
    assert [o["reply"] for o in out[15:]] == [S.RECOMMEND_REPLIES.exhausted] * 2


def test_replay_no_hit(spark):
    runs = S.request_runs(_requests(spark, ["Z", "Z"]))
    out = S.replay(runs, _results(spark, {"A": 1}), S.SEARCH_REPLIES).orderBy("request_id").collect()
    assert [o["reply"] for o in out] == [S.SEARCH_REPLIES.none, S.SEARCH_REPLIES.exhausted]


def test_invalid_requests(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x")], "request_id long, query string")
    got = {r["request_id"]: (r["valid"], r["error"]) for r in S.valid_requests(df).collect()}
    assert got == {1: (False, S.NO_QUERY), 2: (False, S.NO_QUERY), 3: (True, None)}


def _regs(spark, rows):
    data = [(i, T0 + timedelta(seconds=i), u, e) for i, (u, e) in enumerate(rows)]
    return spark.createDataFrame(data, "reg_id long, ts timestamp_ntz, username string, email string")


def test_registration_fixture(spark):
    regs = _regs(spark, [("u1", "e1"), ("u1", "e2"), ("u2", "e2"), ("u3", "e1"), (None, "e9")])
    out, rounds = S.register_two_keys(regs, ["ts", "reg_id"])
    got = [r["accepted"] for r in out.orderBy("reg_id").collect()]
    assert got == [True, False, True, False, False]
    msg = [r["message"] for r in out.orderBy("reg_id").collect()]
    assert msg[-1] == S.FILL_ALL and msg[0] == S.REGISTERED and msg[1] == S.TAKEN


def _python_loop(rows):
    users, emails, out = set(), set(), {}
    for rid, u, e in rows:
        if not u or not e:
            out[rid] = False
        elif u in users or e in emails:
            out[rid] = False
        else:
            users.add(u)
            emails.add(e)
            out[rid] = True
    return out


def test_registration_rounds_equal_python_loop(spark):
    regs = registrations(spark, SF001)
    rows = [(r["reg_id"], r["username"], r["email"]) for r in regs.orderBy("ts", "reg_id").collect()]
    out, rounds = S.register_two_keys(regs, ["ts", "reg_id"])
    got = {r["reg_id"]: r["accepted"] for r in out.collect()}
    assert got == _python_loop(rows)
    assert rounds >= 1


def test_playlist(spark):
    adds = spark.createDataFrame([
        (1, "u", "s1", T0), (2, "u", "s1", T0 + timedelta(1)), (3, "u", "s2", None), (4, "v", "s3", T0)],
        "id long, username string, song string, added_at timestamp_ntz")
    dels = spark.createDataFrame([(4,), (99,)], "id long")
    st = S.playlist_listing(S.playlist_state(adds, dels)).orderBy("username", "pos").collect()
    assert [(r["id"], r["pos"]) for r in st] == [(3, 1), (2, 2), (1, 3)]


def _same_rows(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_skew_safe_runs_equal_window_with_hot_session(spark):
    from cadenza.session import read_table
    ev = read_table(spark, SF001, "events").select("event_id", "user_id", "ts", "event_type")
    # a third of the rows in one session, and a session spread over every partition
    hot = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id")))
    for df in (ev, hot, ev.withColumn("user_id", F.lit(5))):
        args = ("user_id", "ts", "event_id", "event_type")
        a = S.request_runs(df.repartition(8), *args).select("event_id", "run_no", "pos")
        b = request_runs_window(df, *args).select("event_id", "run_no", "pos")
        assert _same_rows(a, b)


def test_skew_safe_listing_equals_window(spark):
    from cadenza.plans.inputs import playlist_adds
    adds = playlist_adds(spark, SF001).withColumn("username", F.lit("hot"))
    a = S.playlist_listing(adds).select("id", "pos")
    b = playlist_listing_window(adds).select("id", "pos")
    assert _same_rows(a, b)


def test_runs_with_nulls_agree_with_the_window_form(spark):
    req = _requests(spark, [None, None, "a", None, "a", "a"])
    a = S.request_runs(req).select("request_id", "run_no", "pos")
    b = request_runs_window(req).select("request_id", "run_no", "pos")
    assert _same_rows(a, b)
    assert [(r["run_no"], r["pos"]) for r in b.orderBy("request_id").collect()] == [
        (1, 1), (1, 2), (2, 1), (3, 1), (4, 1), (4, 2)]


def test_request_without_query_does_not_touch_the_run(spark):
    req = _requests(spark, ["A", None, "A", "", "A"])
    out = S.replay_requests(req, _results(spark, {"A": 2}), S.SEARCH_REPLIES).orderBy("request_id").collect()
    assert [o["pos"] for o in out] == [1, None, 2, None, 3]
    assert out[1]["reply"] == out[3]["reply"] == S.NO_QUERY and out[4]["reply"] == S.SEARCH_REPLIES.exhausted


@pytest.mark.parametrize("name, column, kinds", [
    ("replay_requests", "reply", {S.NO_QUERY, S.SEARCH_REPLIES.none, S.SEARCH_REPLIES.exhausted}),
    ("replay_recommend", "reply", {S.NO_QUERY, S.RECOMMEND_REPLIES.none, S.RECOMMEND_REPLIES.exhausted}),
    ("search_reply", "reply", {S.NO_QUERY, S.SEARCH_REPLIES.none}),
    ("valid_requests", "error", {S.NO_QUERY, None}),
    ("register_unique_name", "message", {S.FILL_ALL, S.TAKEN, S.REGISTERED}),
    ("register_accept", "message", {S.FILL_ALL, S.TAKEN, S.REGISTERED}),
    ("login_lookup", "message", {S.USER_NOT_FOUND}),
])
def test_every_reply_occurs(spark, name, column, kinds):
    from cadenza.plans import registry
    registry.load_all()
    seen = {r[0] for r in registry.QUERIES[name](spark, SF001).select(column).distinct().collect()}
    assert kinds <= seen and (len(seen) > len(kinds) or name not in ("replay_requests", "replay_recommend", "search_reply"))


def test_registration_against_existing_users(spark):
    regs = _regs(spark, [("u1", "e1"), ("u2", "e2"), ("u3", "e3")])
    old = spark.createDataFrame([("u1", "x"), ("y", "e2")], "username string, email string")
    out, _ = S.register_two_keys(regs, ["ts", "reg_id"], old)
    assert [r["accepted"] for r in out.orderBy("reg_id").collect()] == [False, False, True]
