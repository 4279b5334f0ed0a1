"""Scalar/text family: prefix year, first element, JSON path, casts, numeric
selection, recode, adverbs, descriptions, reply flags, links, IN-lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import features as FE
from ..operators import fuzzy, topk
from ..operators.recommend import recommend_lookup
from ..operators.sessions import NO_QUERY
from ..session import read_table
from .catalogue import (CATALOGUE_COLUMNS, RECOMMEND_CATALOGUE_SQL, SCORE_COLUMNS, SONGS_SQL,
                        recommend_catalogue, songs)
from .inputs import (DUCK_EVENT_K, PART_CATALOGUE_SQL, SEARCH_REQUESTS_SQL, event_k,
                     part_catalogue, part_index, search_requests, vectors)
from .q_search import _duck_hits
from .q_vectors import TOPK_SQL
from .registry import query, r6


@query("year_prefix", """
SELECT o_orderkey, CAST(TRY_CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 4) AS INTEGER) AS BIGINT) AS year
FROM orders
""")
def q_year_prefix(spark, sf):
    o = read_table(spark, sf, "orders")
    return o.select("o_orderkey",
                    T.year_prefix(F.col("o_orderdate").cast("string")).cast("bigint").alias("year"))


@query("array_first", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def q_array_first(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", r6(T.first_of(F.col("embedding")).cast("double")).alias("first"))


@query("json_extract", f"SELECT event_id, {DUCK_EVENT_K} AS k FROM events")
def q_json_extract(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select("event_id", event_k().alias("k"))


STRING_COLUMNS = ["id", "name", "artist", "gender", "genre", "mirex"]


@query("cast_columns", "SELECT " + ", ".join(
    [f"CAST({c} AS VARCHAR) AS {c}" for c in STRING_COLUMNS]
    + [f"round(CAST({c} AS DOUBLE), 6) AS {c}" for c in SCORE_COLUMNS]) + f" FROM ({SONGS_SQL})")
def q_cast_columns(spark, sf):
    s = songs(spark, sf)
    return s.select(*T.cast_group(STRING_COLUMNS, "string"),
                    *[r6(F.col(c).cast("double")).alias(c) for c in SCORE_COLUMNS])


@query("numeric_only", "SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, "
                       "l_quantity, l_extendedprice, l_discount + 0.0 AS l_discount, l_tax + 0.0 AS l_tax FROM lineitem")
def q_numeric_only(spark, sf):
    li = read_table(spark, sf, "lineitem")
    cols = FE.numeric_columns(li)
    out = li.select(*cols)
    fix = {c: (F.col(c).cast("bigint") if dict(out.dtypes)[c] == "int" else F.col(c) + F.lit(0.0))
           for c in cols if dict(out.dtypes)[c] in ("int", "double")}
    return out.select(*[fix.get(c, F.col(c)).alias(c) for c in cols])


@query("recode", f"""
SELECT id, {T.duck_recode('genre', T.GENRE_NAMES)} AS genre, {T.duck_recode('mirex', T.MIREX_UNDERTONES)} AS mirex
FROM ({SONGS_SQL})
""")
def q_recode(spark, sf):
    s = songs(spark, sf)
    return s.select("id", T.recode(F.col("genre"), T.GENRE_NAMES).alias("genre"),
                    T.recode(F.col("mirex"), T.MIREX_UNDERTONES).alias("mirex"))


@query("adverb_bucket", "SELECT score, adverb, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS score, {T.duck_adverb(c)} AS adverb FROM ({SONGS_SQL})" for c in SCORE_COLUMNS)
    + ") GROUP BY score, adverb")
def q_adverb_bucket(spark, sf):
    """How many rows get each adverb, per score column."""
    s = songs(spark, sf)
    pairs = ", ".join(f"'{c}', adverb_{c}" for c in SCORE_COLUMNS)
    wide = s.select(*[T.adverb(F.col(c)).alias(f"adverb_{c}") for c in SCORE_COLUMNS])
    long = wide.selectExpr(f"stack({len(SCORE_COLUMNS)}, {pairs}) AS (score, adverb)")
    return long.groupBy("score", "adverb").agg(F.count(F.lit(1)).alias("n"))


@query("describe_rows", f"SELECT id, {T.duck_description()} AS description FROM ({SONGS_SQL})")
def q_describe_rows(spark, sf):
    s = songs(spark, sf)
    return s.select("id", T.describe(s).alias("description"))


@query("reply_flags", _duck_hits() + f"""
, firsts AS (SELECT request_id AS qid, name, artist,
    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank
    FROM req JOIN hits ON req.query = hits.q),
replies AS (SELECT req.request_id AS qid,
  CASE WHEN coalesce(req.query, '') = '' THEN '{NO_QUERY}' ELSE coalesce('Here''s our closest song: ' || f.name || ' by ' || f.artist || '. Click again if this isn''t it!',
           '{T.SEARCH_NONE}') END AS reply
  FROM req LEFT JOIN (SELECT * FROM firsts WHERE rank = 1) f ON req.request_id = f.qid)
SELECT qid, coalesce(nullif(reply, ''), '{T.REPLY_FALLBACK}') AS shown,
       (coalesce(reply, '') <> '' AND coalesce(reply, '') <> '{T.RECOMMEND_EXHAUSTED}') AS valid
FROM replies
""")
def q_reply_flags(spark, sf):
    req = search_requests(spark, sf)
    res = fuzzy.fuzzy_search(req, part_catalogue(spark, sf), limit=1, index=part_index(spark, sf),
                             qid_col="request_id", q_col="query")
    rep = fuzzy.search_replies(req, res, "request_id", "query")
    return rep.select("qid", T.reply_text(F.col("reply")).alias("shown"),
                      T.reply_valid(F.col("reply")).alias("valid"))


@query("result_links", TOPK_SQL + f"""
, cat AS ({RECOMMEND_CATALOGUE_SQL}),
rep AS (SELECT qid, rank, '- ' || name || ' by ' || artist AS reply
        FROM ranked JOIN cat ON ranked.id = cat.id WHERE rank <= 15)
SELECT qid, CAST(rank AS BIGINT) AS rank,
  '{T.LINK_PREFIXES["youtube"]}' || {T.duck_encode_uri('reply')} AS youtube,
  '{T.LINK_PREFIXES["spotify"]}' || {T.duck_encode_uri('reply')} AS spotify,
  '{T.LINK_PREFIXES["google"]}' || {T.duck_encode_uri('reply')} AS google
FROM rep
""")
def q_result_links(spark, sf):
    v = vectors(spark, sf)
    res = topk.topk_cosine(v.select(F.col("id").alias("qid"), "vec"), v, k=15)
    rep = recommend_lookup(res, recommend_catalogue(spark, sf))
    ln = T.links(F.col("reply"))
    return rep.select("qid", "rank", ln["youtube"].alias("youtube"),
                      ln["spotify"].alias("spotify"), ln["google"].alias("google"))


@query("in_list", TOPK_SQL + f"""
, cat AS ({RECOMMEND_CATALOGUE_SQL})
SELECT id, name, artist FROM cat WHERE id IN (SELECT id FROM ranked WHERE rank <= 15)
""")
def q_in_list(spark, sf):
    """Metadata rows whose id is in any result list (semi join, not a literal
    IN list: the list grows with the number of queries)."""
    v = vectors(spark, sf)
    res = topk.topk_cosine(v.select(F.col("id").alias("qid"), "vec"), v, k=15)
    return recommend_catalogue(spark, sf).join(res.select("id"), "id", "left_semi")
