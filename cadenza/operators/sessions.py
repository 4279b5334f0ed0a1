"""Interaction state as bulk jobs over request and change logs.

* Runs: a valid request continues the previous one of its session when the query
  text is the same (gaps and islands: ``lag`` + running sum of changes).
* Replay: the n-th request of a run gets the n-th result of its query; past
  the last result a closing reply.
* Playlists: inserts minus deletes by key, listed newest first (nulls first,
  as the database does), ties by id.
* Registration: first come wins with unique username and unique email; a
  refused row does not block later rows. Decided by conflict components, in
  rounds only where one is large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.components import connected_components
from ..operators.ordered import ordered_positions
from ..operators.quality import missing_text
from ..session import cut_lineage


def request_runs(requests: DataFrame, session: str = "session_id", ts: str = "ts",
                 rid: str = "request_id", query: str = "query") -> DataFrame:
    """Adds ``run_no`` (1-based within the session) and ``pos`` (1-based
    within the run). Order within a session: ``ts`` then request id.

    Skew-safe: a session with a large share of all requests is split over
    tasks by range partitioning (see ``ordered``)."""
    out = ordered_positions(requests, session, [F.col(ts).asc(), F.col(rid).asc()], value=query)
    return out.drop("pos").withColumnRenamed("pos_in_run", "pos")


@dataclass(frozen=True)
class Replies:
    item: str  # format with {name} and {artist}
    none: str  # first request of a run, no result at all
    exhausted: str  # later request, results used up


SEARCH_REPLIES = Replies(T.SEARCH_ITEM, T.SEARCH_NONE, T.SEARCH_EXHAUSTED)
RECOMMEND_REPLIES = Replies(T.RECOMMEND_ITEM, T.RECOMMEND_NONE, T.RECOMMEND_EXHAUSTED)


def _item(replies: Replies, name: Column, artist: Column) -> Column:
    pre, rest = replies.item.split("{name}")
    mid, post = rest.split("{artist}")
    return F.concat(F.lit(pre), name, F.lit(mid), artist, F.lit(post))


def replay(runs: DataFrame, results: DataFrame, replies: Replies,
           query: str = "query") -> DataFrame:
    """Each request's reply: result ``rank == pos`` of its query text.

    ``results`` holds ``(q, rank, name, artist)`` per distinct query text; the
    equi join on ``(text, rank)`` touches at most one result per request."""
    hit = results.select(F.col("q").alias(query), F.col("rank").alias("pos"), "name", "artist")
    j = runs.join(hit, [query, "pos"], "left")
    reply = (F.when(F.col("name").isNotNull(), _item(replies, F.col("name"), F.col("artist")))
             .when(F.col("pos") == 1, F.lit(replies.none))
             .otherwise(F.lit(replies.exhausted)))
    return j.withColumn("reply", reply).drop("name", "artist")


def replay_requests(requests: DataFrame, results: DataFrame, replies: Replies) -> DataFrame:
    """Validation, runs and replies of a request log: a request without a query
    gets the error and no position; it neither advances nor ends a run."""
    checked = valid_requests(cut_lineage(requests, "requests"))
    runs = request_runs(checked.where("valid").drop("valid", "error"))
    answered = replay(runs, results, replies).select("request_id", "pos", "reply")
    refused = checked.where("NOT valid").select(
        "request_id", F.lit(None).cast("bigint").alias("pos"), F.col("error").alias("reply"))
    return answered.unionByName(refused)


def valid_requests(requests: DataFrame, query: str = "query") -> DataFrame:
    """``valid`` flag and the error text for missing or empty queries."""
    bad = missing_text(F.col(query).cast("string"))
    return requests.withColumn("valid", ~bad).withColumn(
        "error", F.when(bad, F.lit(NO_QUERY)).otherwise(F.lit(None).cast("string")))


# Reply texts of the request and account routes.
NO_QUERY = "No query provided"
FILL_ALL = "Please fill up all fields"
TAKEN = "Username or email taken."
REGISTERED = "User registered successfully."
USER_NOT_FOUND = "User not found."


def playlist_state(adds: DataFrame, deletes: DataFrame) -> DataFrame:
    """Rows still present after the delete log (by id)."""
    return adds.join(deletes.select("id").distinct(), "id", "left_anti")


def playlist_listing(state: DataFrame, user: str = "username", ts: str = "added_at") -> DataFrame:
    """Per user, newest first (null times first), ties by id: ``pos`` 1..
    Skew-safe for a user holding a large share of all rows."""
    return ordered_positions(state, user, [F.col(ts).desc_nulls_first(), F.col("id").asc()])


def register_first_by_name(regs: DataFrame, order: list[str]) -> DataFrame:
    """Single unique key (username): the earliest valid row per name wins.
    ``min(struct(order))`` per name is a partial aggregate."""
    valid = ~(missing_text(F.col("username")) | missing_text(F.col("email")))
    seq = F.struct(*[F.col(c) for c in order])
    firsts = (regs.filter(valid).groupBy("username").agg(F.min(seq).alias("_first"))
              .select(F.col("_first.*")))
    keys = [c for c in order]
    won = firsts.select(*keys).withColumn("_won", F.lit(True))
    out = regs.join(won, keys, "left")
    message = (F.when(~valid, F.lit(FILL_ALL)).when(F.col("_won"), F.lit(REGISTERED))
               .otherwise(F.lit(TAKEN)))
    return out.select(*regs.columns, F.coalesce("_won", F.lit(False)).alias("accepted"),
                      message.alias("message"))


#: Sign-ups of one conflict component that are decided together in one task.
COMPONENT_ROWS = 10_000


def _decide(pdf):
    """First come, first served within one component."""
    names, mails, won = set(), set(), []
    for seq, name, mail in sorted(zip(pdf["seq"], pdf["username"], pdf["email"]), key=lambda r: r[0]):
        if name not in names and mail not in mails:
            names.add(name)
            mails.add(mail)
            won.append(seq)
    return pdf[pdf["seq"].isin(won)][["seq"]]


def register_two_keys(regs: DataFrame, order: list[str], existing: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Greedy in arrival order with unique username and unique email; the decided table and the number of rounds.

    Sign-ups that name a taken username or email are refused at once, and of those with one username and email only the
    first can win. The rest can only be in each other's way within a connected component of the graph of names and
    emails. Components of up to ``COMPONENT_ROWS`` are decided in one grouped step each. Only larger ones go in rounds:
    accept every undecided row that is the earliest with its username *and* with its email (no earlier row can
    block it), refuse those it blocks; as soon as what is left falls into small components, these are decided as above.
    """
    spark = regs.sparkSession
    valid = ~(missing_text(F.col("username")) | missing_text(F.col("email")))
    seq = F.struct(*[F.col(c) for c in order]).alias("_seq")
    base = regs.select("*", seq)
    undecided = base.filter(valid).groupBy("username", "email").agg(F.min("_seq").alias("seq"))
    if existing is not None:
        undecided = (undecided.join(existing.select("username"), "username", "left_anti")
                     .join(existing.select("email"), "email", "left_anti"))
    undecided = cut_lineage(undecided, "undecided")
    won_parts: list[DataFrame] = []
    rounds = 0
    while not undecided.isEmpty():
        rounds += 1
        edges = undecided.select(F.concat(F.lit("u"), "username").alias("a"), F.concat(F.lit("e"), "email").alias("b"))
        parts = connected_components(edges)
        sized = undecided.join(parts.select(F.col("node").alias("_a"), "component"), F.concat(F.lit("u"), "username") == F.col("_a")).drop("_a")
        sizes = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        sized = cut_lineage(sized.join(sizes, "component"), "components")
        # seq travels as a rank within its component, so that any order columns will do
        ranked = sized.where(F.col("n") <= COMPONENT_ROWS).withColumn(
            "nth", F.row_number().over(Window.partitionBy("component").orderBy("seq")).cast("bigint"))
        few = ranked.select("component", F.col("nth").alias("seq"), "username", "email").groupBy("component").applyInPandas(
            lambda key, pdf: _decide(pdf).assign(component=key[0]), "seq bigint, component string")
        small = ranked.join(few.select(F.col("seq").alias("nth"), "component"), ["component", "nth"]).select("seq")
        undecided = sized.where(F.col("n") > COMPONENT_ROWS).select("username", "email", "seq")
        if undecided.isEmpty():
            won_parts.append(cut_lineage(small, "won"))
            break
        first_u = undecided.groupBy("username").agg(F.min("seq").alias("seq"))
        first_e = undecided.groupBy("email").agg(F.min("seq").alias("seq"))
        won = cut_lineage(undecided.join(first_u, ["username", "seq"], "left_semi").join(first_e, ["email", "seq"], "left_semi"), "won")
        won_parts += [cut_lineage(small, "won"), won.select("seq")]
        undecided = cut_lineage(undecided.join(won.select("username"), "username", "left_anti")
                                .join(won.select("email"), "email", "left_anti"), "undecided")
    acc = won_parts[0] if won_parts else spark.createDataFrame([], base.select(F.col("_seq").alias("seq")).schema)
    for p in won_parts[1:]:
        acc = acc.unionByName(p)
    out = base.join(acc.select(F.col("seq").alias("_seq"), F.lit(True).alias("_won")), "_seq", "left")
    message = (F.when(~valid, F.lit(FILL_ALL)).when(F.col("_won"), F.lit(REGISTERED))
               .otherwise(F.lit(TAKEN)))
    return (out.select(*regs.columns, F.coalesce("_won", F.lit(False)).alias("accepted"),
                       message.alias("message")), rounds)


def login_lookup(attempts: DataFrame, users: DataFrame) -> DataFrame:
    """First matching user row per attempt, or 'User not found.'."""
    first = users.groupBy("username").agg(F.min("reg_id").alias("user_row"))
    j = attempts.join(first, "username", "left")
    return j.select(*attempts.columns, F.col("user_row").isNotNull().alias("found"),
                    F.when(F.col("user_row").isNull(), F.lit(USER_NOT_FOUND))
                    .otherwise(F.col("username")).alias("message"))
