"""Feature family: standardisation, dictionaries, one-hot, the feature table,
hold-out split, training pairs, dedup, key checks and histograms."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..operators import features as FE
from ..operators import quality as Q
from ..operators.recommend import training_pairs
from ..functions import vectors as V
from ..session import materialised, read_table
from .catalogue import (CATALOGUE_COLUMNS, GENRE_CODES, SCORE_COLUMNS, SONGS_SQL, songs)
from .registry import query, r6

# Fixed category values of the driver data used by the oracle SQL
# (the Spark side discovers them from the data).
ORDER_STATUS = ["F", "O", "P"]
ORDER_PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
GENDERS = ["female", "male"]
MIREX = ["cluster1", "cluster2", "cluster3", "cluster4", "cluster5"]

DEDUP_ORDER = ["year", "name", "artist"]
_REST = [c for c in CATALOGUE_COLUMNS if c not in ["id"] + DEDUP_ORDER]

CATALOGUE_SQL = f"""
SELECT {', '.join(CATALOGUE_COLUMNS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(DEDUP_ORDER + _REST)}) AS _rn
  FROM ({SONGS_SQL})) WHERE _rn = 1
"""


def catalogue(spark, sf, with_key: bool = False):
    """The keyed catalogue: songs with one row per id (keep-first), written
    once to the shared folder (like the application's stored table) so the
    dictionary, the statistics and the output read it instead of
    recomputing the joins."""
    inputs = [os.path.join(sf, f"{t}.parquet") for t in ("lineitem", "orders", "customer", "part")]
    return materialised(spark, f"catalogue{'-key' if with_key else ''}", inputs,
                        lambda: Q.dedup_first(songs(spark, sf, with_key), "id", DEDUP_ORDER))


def _duck_dummies(col, values):
    return [f"CASE WHEN {col} = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"{col}_{v}\"" for v in values]


@query("standardise", """
SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS z
FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)
""")
def q_standardise(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return FE.standardise(o, "o_totalprice", "z").select("o_orderkey", r6("z").alias("z"))


@query("category_dictionary", f"""
SELECT "column", value, CAST(row_number() OVER (PARTITION BY "column" ORDER BY value) - 1 AS BIGINT) AS idx
FROM (SELECT DISTINCT 'gender' AS "column", gender AS value FROM ({SONGS_SQL})
      UNION SELECT DISTINCT 'genre', genre FROM ({SONGS_SQL})
      UNION SELECT DISTINCT 'mirex', mirex FROM ({SONGS_SQL}))
""")
def q_category_dictionary(spark, sf):
    return FE.category_dictionary(songs(spark, sf), ["gender", "genre", "mirex"])


@query("one_hot", "SELECT o_orderkey, " + ", ".join(
    _duck_dummies("o_orderstatus", ORDER_STATUS) + _duck_dummies("o_orderpriority", ORDER_PRIORITY))
    + " FROM orders")
def q_one_hot(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return FE.one_hot(o, ["o_orderstatus", "o_orderpriority"])


@query("feature_wide", f"""
SELECT id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORE_COLUMNS)},
  round((year - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6) AS year_std,
  {', '.join(_duck_dummies('gender', GENDERS) + _duck_dummies('genre', GENRE_CODES) + _duck_dummies('mirex', MIREX))}
FROM ({CATALOGUE_SQL}) c, (SELECT avg(year) AS m, stddev_pop(year) AS s FROM ({CATALOGUE_SQL}))
""")
def q_feature_wide(spark, sf):
    wide, _ = FE.feature_table(catalogue(spark, sf), "id", SCORE_COLUMNS, "year",
                               ["gender", "genre", "mirex"])
    return wide.select(*[r6(c).alias(c) if c in SCORE_COLUMNS + ["year_std"] else F.col(c)
                         for c in wide.columns])


#: The sparse form's columns: ``name`` has about as many values as there are parts.
SPARSE_COLUMNS = ["gender", "genre", "mirex", "name", "artist"]


def _duck_sparse() -> str:
    values = " UNION ".join(f"SELECT {i} AS c, {col} AS value FROM k WHERE {col} IS NOT NULL" for i, col in enumerate(SPARSE_COLUMNS))
    ones = " UNION ALL ".join(f"SELECT id, feature, 1.0::DOUBLE AS value FROM k JOIN d ON d.c = {i} AND d.value = k.{col}"
                              for i, col in enumerate(SPARSE_COLUMNS))
    numbers = " UNION ALL ".join(f"SELECT id, CAST({i} AS BIGINT) AS feature, round(CAST({col} AS DOUBLE), 6) AS value FROM k WHERE {col} IS NOT NULL"
                                 for i, col in enumerate(SCORE_COLUMNS))
    n = len(SCORE_COLUMNS)
    return f"""
    WITH k AS MATERIALIZED ({CATALOGUE_SQL}),
    d AS MATERIALIZED (SELECT c, value, CAST({n + 1} + row_number() OVER (ORDER BY c, value) - 1 AS BIGINT) AS feature FROM ({values}))
    {numbers} UNION ALL
    SELECT id, CAST({n} AS BIGINT), round((year - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 6)
    FROM k, (SELECT avg(year) AS m, stddev_pop(year) AS s FROM k) WHERE year IS NOT NULL
    UNION ALL {ones}"""


@query("feature_sparse", _duck_sparse())
def q_feature_sparse(spark, sf):
    """The feature table as ``(id, feature, value)`` rows, with two columns of many values beside the wide form's three."""
    songs_ = catalogue(spark, sf)
    std = FE.standardise(songs_, "year", "year_std")
    rows = FE.sparse_features(std, "id", [*SCORE_COLUMNS, "year_std"], SPARSE_COLUMNS, FE.category_index(songs_, SPARSE_COLUMNS))
    return rows.select("id", "feature", r6("value").alias("value"))


@query("holdout_split", """
SELECT vec_id, (('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100) < 20 AS holdout
FROM embeddings
""")
def q_holdout_split(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return e.select("vec_id", FE.holdout_flag(F.col("vec_id")).alias("holdout"))


def order_features(spark, sf):
    """Target vectors for the projection: ``orders`` standardised price and
    one-hot status and priority, keyed by ``o_orderkey``."""
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus",
                                               "o_orderpriority")
    wide, names = FE.feature_table(o.withColumnRenamed("o_orderkey", "id"), "id", [],
                                   "o_totalprice", ["o_orderstatus", "o_orderpriority"])
    return FE.assemble(wide, "id", names, "y"), names


ORDER_FEATURES_SQL = ("SELECT o_orderkey AS id, [(o_totalprice - m) / CASE WHEN s = 0 THEN 1 ELSE s END, "
                      + ", ".join(f"CASE WHEN o_orderstatus = '{v}' THEN 1.0 ELSE 0.0 END" for v in ORDER_STATUS)
                      + ", "
                      + ", ".join(f"CASE WHEN o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END" for v in ORDER_PRIORITY)
                      + "]::DOUBLE[] AS y FROM orders, (SELECT avg(o_totalprice) AS m, "
                        "stddev_pop(o_totalprice) AS s FROM orders)")


@query("training_pairs", f"""
SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS n_x, CAST(len(y) AS BIGINT) AS n_y,
  round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda v: v * v))), 6) AS x_norm,
  round(sqrt(list_sum(list_transform(y, lambda v: v * v))), 6) AS y_norm
FROM embeddings JOIN ({ORDER_FEATURES_SQL}) f ON vec_id = f.id
""")
def q_training_pairs(spark, sf):
    x = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    y, _ = order_features(spark, sf)
    p = training_pairs(x, y, "id")
    return p.select("id", F.size("x").cast("bigint").alias("n_x"), F.size("y").cast("bigint").alias("n_y"),
                    r6(V.norm(F.col("x"))).alias("x_norm"), r6(V.norm(F.col("y"))).alias("y_norm"))


@query("dedup_first", """
SELECT doc_id, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1
""")
def q_dedup_first(spark, sf):
    """Exact-copy removal on ``documents``: keep the first doc_id per text."""
    d = read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), "lang", "source", "n_chars")
    return Q.dedup_first(d, "h", ["doc_id"]).select("doc_id", "lang", "source", "n_chars")


@query("key_violations", """
SELECT p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1 OR p_name IS NULL
""")
def q_key_violations(spark, sf):
    return Q.key_violations(read_table(spark, sf, "part"), "p_name")


def _duck_hist(expr: str, src: str, bins: int) -> str:
    return f"""
    WITH v AS (SELECT CAST({expr} AS DOUBLE) AS x FROM {src}),
    r AS (SELECT min(x) - CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS lo,
                 max(x) + CASE WHEN min(x) = max(x) THEN 0.5 ELSE 0 END AS hi FROM v),
    c AS (SELECT CAST(least(floor((x - lo) / (hi - lo) * {bins}.0) + 1, {bins}) AS BIGINT) AS bin, count(*) AS n
          FROM v, r WHERE x IS NOT NULL GROUP BY 1)
    SELECT b.bin, round(lo + (b.bin - 1) * ((hi - lo) / {bins}.0), 6) AS lo,
           round(lo + b.bin * ((hi - lo) / {bins}.0), 6) AS hi, coalesce(c.n, 0) AS n
    FROM range(1, {bins} + 1) b(bin) CROSS JOIN r LEFT JOIN c ON c.bin = b.bin
    """


def _hist(df, col, bins):
    h = Q.histogram(df, col, bins)
    return h.select("bin", r6("lo").alias("lo"), r6("hi").alias("hi"), "n")


@query("histogram", _duck_hist("o_totalprice", "orders", 50))
def q_histogram(spark, sf):
    return _hist(read_table(spark, sf, "orders"), "o_totalprice", 50)


@query("histogram_year", _duck_hist("year", f"({CATALOGUE_SQL})", 200))
def q_histogram_year(spark, sf):
    return _hist(catalogue(spark, sf), "year", 200)
