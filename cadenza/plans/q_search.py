"""Search family: trigram sets, similarity, postings, fuzzy join and search,
the SQL-function form, parameterised SQL and search replies."""

from __future__ import annotations

import pkgutil

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.trigram import (duck_similarity, duck_trigram_set, register_sql_functions,
                                 similarity, trigram_set)
from ..operators import fuzzy
from ..operators.sessions import NO_QUERY
from ..session import read_table, register_tables
from ..sources import sql_script
from .inputs import (PART_CATALOGUE_SQL, SEARCH_REQUESTS_SQL, part_catalogue, part_index,
                     search_requests)
from .registry import query, r6

# A fixed search text for the single-query statements (the user's input).
SEARCH_TEXT = "blue widget"


@query("trigram_set", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_trigrams, array_to_string(list_sort(t), '|') AS trigrams
FROM (SELECT doc_id, {duck_trigram_set('text')} AS t FROM documents)
""")
def q_trigram_set(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id", "text")
    t = d.select("doc_id", trigram_set(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_trigrams"),
                    F.array_join(F.array_sort("t"), "|").alias("trigrams"))


_HALVES = "substr(text, 1, CAST(floor(length(text) / 2) AS INT))", "substr(text, CAST(floor(length(text) / 2) AS INT) + 1)"


@query("trigram_similarity", f"""
SELECT doc_id, round({duck_similarity('a', 'b')}, 6) AS sim
FROM (SELECT doc_id, {_HALVES[0]} AS a, {_HALVES[1]} AS b FROM documents)
""")
def q_trigram_similarity(spark, sf):
    """The first half of each whole text against the second."""
    d = read_table(spark, sf, "documents").select("doc_id", F.expr(_HALVES[0]).alias("a"), F.expr(_HALVES[1]).alias("b"))
    return d.select("doc_id", r6(similarity(F.col("a"), F.col("b"))).alias("sim"))


@query("trigram_postings", f"""
SELECT field, trigram, id, CAST(n AS BIGINT) AS n FROM (
  SELECT 'name' AS field, id, {duck_trigram_set('name')} AS t, len(t) AS n FROM ({PART_CATALOGUE_SQL})
  UNION ALL
  SELECT 'artist' AS field, id, {duck_trigram_set('artist')} AS t, len(t) AS n FROM ({PART_CATALOGUE_SQL})
), unnest(t) AS u(trigram)
""")
def q_trigram_postings(spark, sf):
    """Per-row postings read from the stored index (distinct-string postings
    joined to the rows that hold the string)."""
    idx = part_index(spark, sf)
    held = idx.rows.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("s")) for f in idx.fields])).alias("x"))
    return idx.postings.join(held.select("id", "x.field", "x.s"), ["field", "s"]).select(
        "field", "trigram", "id", F.col("n").cast("bigint").alias("n"))


def _duck_hits():
    return f"""
    WITH req AS ({SEARCH_REQUESTS_SQL}),
    qs AS (SELECT DISTINCT query AS q FROM req),
    cat AS ({PART_CATALOGUE_SQL}),
    sims AS (SELECT q, id, name, artist, {duck_similarity('name', 'q')} AS sn,
                    {duck_similarity('artist', 'q')} AS sa FROM qs CROSS JOIN cat),
    hits AS (SELECT q, id, name, artist, greatest(sn, sa) AS score FROM sims
             WHERE sn > 0.25::DOUBLE OR sa > 0.25::DOUBLE)
    """


@query("fuzzy_join", _duck_hits() + """
SELECT q, id, round(score, 6) AS score FROM hits
""")
def q_fuzzy_join(spark, sf):
    """Every distinct request text against the whole catalogue."""
    hits = fuzzy.fuzzy_join(search_requests(spark, sf), part_catalogue(spark, sf), q_col="query",
                            index=part_index(spark, sf))
    return hits.select("q", "id", r6("score").alias("score"))


def _duck_search(order: str):
    return _duck_hits() + f"""
    , ranked AS (SELECT request_id AS qid, id, name, artist, score,
        row_number() OVER (PARTITION BY request_id ORDER BY score {order}, id) AS rank
        FROM req JOIN hits ON req.query = hits.q)
    SELECT qid, CAST(rank AS BIGINT) AS rank, id, name, artist, round(score, 6) AS score
    FROM ranked WHERE rank <= 5
    """


def _search(spark, sf, order):
    res = fuzzy.fuzzy_search(search_requests(spark, sf), part_catalogue(spark, sf), order=order,
                             index=part_index(spark, sf),
                             qid_col="request_id", q_col="query")
    return res.select("qid", "rank", "id", "name", "artist", r6("score").alias("score"))


@query("fuzzy_search", _duck_search("DESC"))
def q_fuzzy_search(spark, sf):
    return _search(spark, sf, "desc")


@query("fuzzy_search_asc", _duck_search("ASC"))
def q_fuzzy_search_asc(spark, sf):
    return _search(spark, sf, "asc")


@query("search_reply", _duck_hits() + f"""
, firsts AS (SELECT request_id AS qid, name, artist,
    row_number() OVER (PARTITION BY request_id ORDER BY score DESC, id) AS rank
    FROM req JOIN hits ON req.query = hits.q)
SELECT req.request_id AS qid,
  CASE WHEN coalesce(req.query, '') = '' THEN '{NO_QUERY}' ELSE coalesce('Here''s our closest song: ' || f.name || ' by ' || f.artist || '. Click again if this isn''t it!',
           '{T.SEARCH_NONE}') END AS reply
FROM req LEFT JOIN (SELECT * FROM firsts WHERE rank = 1) f ON req.request_id = f.qid
""")
def q_search_reply(spark, sf):
    req = search_requests(spark, sf)
    res = fuzzy.fuzzy_search(req, part_catalogue(spark, sf), limit=1, index=part_index(spark, sf),
                             qid_col="request_id", q_col="query")
    return fuzzy.search_replies(req, res, "request_id", "query")


@query("param_sql", f"""
SELECT id, name, artist, round(score, 6) AS score FROM (
  SELECT p_partkey AS id, p_name AS name, p_brand AS artist,
         greatest({duck_similarity('p_name', "'" + SEARCH_TEXT + "'")},
                  {duck_similarity('p_brand', "'" + SEARCH_TEXT + "'")}) AS score
  FROM part)
WHERE score > 0.25::DOUBLE
ORDER BY score, id LIMIT 5
""")
def q_param_sql(spark, sf):
    """The application's search: a ``.sql`` file with comments, a preparing statement and the driver's marks."""
    register_tables(spark, sf, ["part"])
    script = pkgutil.get_data("cadenza.plans", "sql/search.sql").decode()
    return sql_script.run_script(spark, sql_script.statements(script), {"q": SEARCH_TEXT})


@query("similarity_sql", f"""
SELECT p_partkey AS id, round({duck_similarity('p_name', "'" + SEARCH_TEXT + "'")}, 6) AS sim
FROM part WHERE {duck_similarity('p_name', "'" + SEARCH_TEXT + "'")} > 0.25::DOUBLE
""")
def q_similarity_sql(spark, sf):
    """``similarity`` used as a SQL function over the whole table."""
    register_tables(spark, sf, ["part"])
    register_sql_functions(spark)
    return spark.sql(
        "SELECT p_partkey AS id, round(similarity(p_name, :q), 6) AS sim FROM part "
        "WHERE similarity(p_name, :q) > 0.25", args={"q": SEARCH_TEXT})
