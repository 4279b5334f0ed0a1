"""Sessions family: request runs, replay, playlists, registration, login
lookup and request validation, over the ``events`` log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import fuzzy
from ..operators import sessions as S
from ..session import cut_lineage, read_table
from .inputs import (DUCK_ASKED_K, DUCK_EVENT_K, PART_CATALOGUE_SQL, PLAYLIST_ADDS_SQL, PLAYLIST_DELETES_SQL,
                     SEARCH_REQUESTS_SQL, asked_k, event_k, part_catalogue, playlist_adds,
                     playlist_deletes, search_requests, vectors, part_index)
from .q_search import _duck_hits
from .q_vectors import TOPK_SQL
from .catalogue import RECOMMEND_CATALOGUE_SQL, recommend_catalogue
from ..operators import topk
from ..operators.recommend import recommend_lookup
from .registry import query, sql_str

LIST_USER = "u7"


def _duck_runs(src: str, session: str, ts: str, rid: str, q: str) -> str:
    w = f"PARTITION BY {session} ORDER BY {ts}, {rid}"
    return f"""
    SELECT *, CAST(row_number() OVER (PARTITION BY {session}, run_no ORDER BY {ts}, {rid}) AS BIGINT) AS pos FROM (
      SELECT *, CAST(sum(_chg) OVER ({w} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_no FROM (
        SELECT *, CASE WHEN row_number() OVER ({w}) = 1 OR lag({q}) OVER ({w}) IS DISTINCT FROM {q} THEN 1 ELSE 0 END AS _chg
        FROM ({src})))
    """


def _duck_refused(src: str) -> str:
    """Requests without a query: the error, no position."""
    return (f"UNION ALL SELECT request_id, NULL AS pos, '{S.NO_QUERY}' AS reply "
            f"FROM ({src}) WHERE coalesce(CAST(query AS VARCHAR), '') = ''")


def _duck_valid(src: str) -> str:
    return f"SELECT * FROM ({src}) WHERE coalesce(CAST(query AS VARCHAR), '') <> ''"


@query("request_runs", "SELECT event_id, user_id, run_no, pos FROM ("
       + _duck_runs("SELECT event_id, user_id, ts, event_type FROM events", "user_id", "ts", "event_id",
                    "event_type") + ")")
def q_request_runs(spark, sf):
    """Runs of the same event type per user (the same-query test)."""
    ev = read_table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    r = S.request_runs(ev, "user_id", "ts", "event_id", "event_type")
    return r.select("event_id", "user_id", "run_no", "pos")


@query("replay_requests", _duck_hits() + f"""
, ranked AS (SELECT q, id, name, artist, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM hits),
runs AS ({_duck_runs(_duck_valid(SEARCH_REQUESTS_SQL), 'session_id', 'ts', 'request_id', 'query')})
SELECT request_id, runs.pos,
  CASE WHEN r.name IS NOT NULL THEN 'Here''s our closest song: ' || r.name || ' by ' || r.artist || '. Click again if this isn''t it!'
       WHEN runs.pos = 1 THEN {sql_str(T.SEARCH_NONE)} ELSE {sql_str(T.SEARCH_EXHAUSTED)} END AS reply
FROM runs LEFT JOIN (SELECT * FROM ranked WHERE rank <= 5) r ON runs.query = r.q AND runs.pos = r.rank
{_duck_refused(SEARCH_REQUESTS_SQL)}
""")
def q_replay_requests(spark, sf):
    """Each search request's reply: the n-th of the top 5 results of its text,
    n = position in its run of equal requests."""
    req = search_requests(spark, sf)
    top = fuzzy.fuzzy_top(req, part_catalogue(spark, sf), 5, q_col="query", index=part_index(spark, sf))
    return S.replay_requests(req, top.select("q", "rank", "name", "artist"), S.SEARCH_REPLIES)


@query("valid_requests", f"""
SELECT request_id, NOT (query IS NULL OR query = '') AS valid,
       CASE WHEN query IS NULL OR query = '' THEN '{S.NO_QUERY}' END AS error
FROM ({SEARCH_REQUESTS_SQL})
""")
def q_valid_requests(spark, sf):
    v = S.valid_requests(search_requests(spark, sf))
    return v.select("request_id", "valid", "error")


PLAYLIST_STATE_SQL = f"""
SELECT username, CAST(row_number() OVER (PARTITION BY username ORDER BY added_at DESC NULLS FIRST, id) AS BIGINT) AS pos,
       id, song, added_at
FROM ({PLAYLIST_ADDS_SQL}) a WHERE NOT EXISTS (SELECT 1 FROM ({PLAYLIST_DELETES_SQL}) d WHERE d.id = a.id)
"""


@query("playlist_state", PLAYLIST_STATE_SQL)
def q_playlist_state(spark, sf):
    st = cut_lineage(S.playlist_state(playlist_adds(spark, sf), playlist_deletes(spark, sf)), "playlist")
    return S.playlist_listing(st).select("username", "pos", "id", "song", "added_at")


@query("playlist_list", f"SELECT pos, id, song, added_at FROM ({PLAYLIST_STATE_SQL}) WHERE username = '{LIST_USER}'")
def q_playlist_list(spark, sf):
    """One user's listing (equality filter pushed below the window)."""
    st = S.playlist_state(playlist_adds(spark, sf), playlist_deletes(spark, sf))
    return S.playlist_listing(st.filter(F.col("username") == LIST_USER)).select("pos", "id", "song", "added_at")


def registrations(spark, sf):
    """Sign-up log: ``(reg_id, ts, username, email)`` from signup events; some
    lack the name, some have an empty e-mail address."""
    ev = read_table(spark, sf, "events").filter(F.col("event_type") == "signup")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    email = F.concat(F.lit("e"), event_k().cast("string"), F.lit("@example.com"))
    return ev.select(F.col("event_id").alias("reg_id"), "ts",
                     F.when(F.col("event_id") % 19 != 0, name).alias("username"),
                     F.when(F.col("event_id") % 23 == 0, F.lit("")).otherwise(email).alias("email"))


REGISTRATIONS_SQL = f"""
SELECT event_id AS reg_id, ts, CASE WHEN event_id % 19 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS username,
       CASE WHEN event_id % 23 = 0 THEN '' ELSE 'e' || CAST({DUCK_EVENT_K} AS VARCHAR) || '@example.com' END AS email
FROM events WHERE event_type = 'signup'
"""


def existing_users(spark, sf):
    """Accounts from before the log, one per customer, numbered 25 apart (so that only some meet a sign-up's name)."""
    key = (F.col("c_custkey") * 25).cast("string")
    return read_table(spark, sf, "customer").select(F.concat(F.lit("u"), key).alias("username"),
                    F.concat(F.lit("e"), key, F.lit("@example.com")).alias("email"))


EXISTING_USERS_SQL = """
SELECT 'u' || CAST(c_custkey * 25 AS VARCHAR) AS username, 'e' || CAST(c_custkey * 25 AS VARCHAR) || '@example.com' AS email
FROM customer
"""

_COMPLETE = "(coalesce(username, '') <> '' AND coalesce(email, '') <> '')"

REGISTER_NAME_SQL = f"""
SELECT reg_id, ok AND rn = 1 AS accepted,
       CASE WHEN NOT ok THEN '{S.FILL_ALL}' WHEN rn = 1 THEN '{S.REGISTERED}' ELSE '{S.TAKEN}' END AS message
FROM (SELECT *, {_COMPLETE} AS ok, row_number() OVER (PARTITION BY username, {_COMPLETE} ORDER BY ts, reg_id) AS rn
      FROM ({REGISTRATIONS_SQL}))
"""


@query("register_unique_name", REGISTER_NAME_SQL)
def q_register_unique_name(spark, sf):
    out = S.register_first_by_name(registrations(spark, sf), ["ts", "reg_id"])
    return out.select("reg_id", "accepted", "message")


# The oracle replays the sequential greedy (arrival order) as a recursive CTE:
# one step per sign-up, carrying the taken names, e-mails and accepted ids.
REGISTER_TWO_KEYS_SQL = f"""
WITH RECURSIVE r AS (
  SELECT row_number() OVER (ORDER BY ts, reg_id) AS i, reg_id, username, email FROM ({REGISTRATIONS_SQL})),
g(i, users, emails, won) AS (
  SELECT 0::BIGINT, coalesce(list(username), []), coalesce(list(email), []), []::BIGINT[] FROM ({EXISTING_USERS_SQL})
  UNION ALL
  SELECT r.i,
    CASE WHEN ok THEN list_append(g.users, r.username) ELSE g.users END,
    CASE WHEN ok THEN list_append(g.emails, r.email) ELSE g.emails END,
    CASE WHEN ok THEN list_append(g.won, r.reg_id) ELSE g.won END
  FROM g JOIN r ON r.i = g.i + 1,
  LATERAL (SELECT coalesce(r.username, '') <> '' AND coalesce(r.email, '') <> ''
                  AND NOT list_contains(g.users, r.username) AND NOT list_contains(g.emails, r.email) AS ok)),
fin AS (SELECT won FROM g ORDER BY i DESC LIMIT 1)
SELECT reg_id, username, email, list_contains(fin.won, reg_id) AS accepted,
  CASE WHEN coalesce(username, '') = '' OR coalesce(email, '') = '' THEN '{S.FILL_ALL}'
       WHEN list_contains(fin.won, reg_id) THEN '{S.REGISTERED}' ELSE '{S.TAKEN}' END AS message
FROM r, fin
"""


@query("register_accept", REGISTER_TWO_KEYS_SQL)
def q_register_accept(spark, sf):
    """Unique username and unique email among old and new users, first come wins (rounds)."""
    out, _ = S.register_two_keys(registrations(spark, sf), ["ts", "reg_id"], existing_users(spark, sf))
    return out.select("reg_id", "username", "email", "accepted", "message")


@query("login_lookup", f"""
WITH users AS (SELECT * FROM ({REGISTER_NAME_SQL}) a JOIN ({REGISTRATIONS_SQL}) r USING (reg_id) WHERE accepted)
SELECT event_id, u.username IS NOT NULL AS found,
       CASE WHEN u.username IS NULL THEN '{S.USER_NOT_FOUND}' ELSE u.username END AS message
FROM events LEFT JOIN users u ON u.username = CASE WHEN event_id % 29 = 0 THEN 'nobody' ELSE 'u' || CAST(events.user_id AS VARCHAR) END
WHERE event_type = 'view'
""")
def q_login_lookup(spark, sf):
    """Each view event logs in as its user: first user row or 'not found' (some names are unknown)."""
    regs = registrations(spark, sf)
    users = S.register_first_by_name(regs, ["ts", "reg_id"]).filter("accepted")
    att = read_table(spark, sf, "events").filter(F.col("event_type") == "view").select(
        "event_id", F.when(F.col("event_id") % 29 == 0, F.lit("nobody"))
        .otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("username"))
    return S.login_lookup(att, users).select("event_id", "found", "message")


def vector_requests(spark, sf):
    """Recommendation request log: every event asks for the songs closest to
    a vector (the encoded description); some name none, or one that does not exist."""
    ev = read_table(spark, sf, "events")
    return ev.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"), "ts",
                     F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("bigint"))
                     .when((F.col("event_id") % 17 == 0) & (F.col("user_id") % 10 != 0), F.lit(-1).cast("bigint"))
                     .otherwise(asked_k()).alias("query"))


VECTOR_REQUESTS_SQL = f"""
SELECT event_id AS request_id, user_id AS session_id, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 17 = 0 AND user_id % 10 <> 0 THEN -1
            ELSE {DUCK_ASKED_K} END AS query
FROM events
"""


@query("replay_recommend", TOPK_SQL + f"""
, cat AS ({RECOMMEND_CATALOGUE_SQL}),
res AS (SELECT qid, rank, name, artist FROM ranked JOIN cat ON ranked.id = cat.id WHERE rank <= 15),
runs AS ({_duck_runs(_duck_valid(VECTOR_REQUESTS_SQL), 'session_id', 'ts', 'request_id', 'query')})
SELECT request_id, runs.pos,
  CASE WHEN res.name IS NOT NULL THEN '- ' || res.name || ' by ' || res.artist
       WHEN runs.pos = 1 THEN {sql_str(T.RECOMMEND_NONE)} ELSE {sql_str(T.RECOMMEND_EXHAUSTED)} END AS reply
FROM runs LEFT JOIN res ON runs.query = res.qid AND runs.pos = res.rank
{_duck_refused(VECTOR_REQUESTS_SQL)}
""")
def q_replay_recommend(spark, sf):
    """Each recommendation request's reply: the n-th of the 15 closest songs
    to its vector, n = position in its run of equal requests."""
    req = vector_requests(spark, sf)
    v = vectors(spark, sf)
    asked = v.join(req.select(F.col("query").alias("id")).distinct(), "id", "left_semi")
    res = topk.topk_cosine(asked.select(F.col("id").alias("qid"), "vec"), v, k=15)
    top = recommend_lookup(res, recommend_catalogue(spark, sf)).select(
        F.col("qid").alias("q"), "rank", "name", "artist")
    return S.replay_requests(req, top, S.RECOMMEND_REPLIES)
