"""Bindings of the application's data model to the driver tables.

The reference's corpus (a tree of per-recording JSON documents) is absent, so
every registered query works on data Spark derives from the given tables:

* ``songs``: the flat catalogue (id, name, artist, year, 11 scores in [0, 1],
  gender, genre, mirex), one row per ``lineitem`` row joined with its order,
  customer and part. Ids repeat where ``(l_orderkey, l_linenumber)`` repeats,
  which exercises the keep-first dedup.
* ``recommend catalogue``: ``orders ⋈ customer`` keyed by ``o_orderkey``, the
  metadata looked up for ``embeddings.vec_id``.

``SONGS_SQL`` is the same derivation for DuckDB, used by the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# The ten genre codes of the genre model, in the order the rule
# below indexes them, and the five mood cluster names.
GENRE_CODES = ["blu", "cla", "cou", "dis", "hip", "jaz", "met", "pop", "reg", "roc"]

SCORE_COLUMNS = [
    "dance", "acoustic", "aggressive", "electronic", "happy",
    "party", "relaxed", "sad", "timbre", "tonal", "voice",
]
CATEGORY_COLUMNS = ["gender", "genre", "mirex"]
CATALOGUE_COLUMNS = ["id", "name", "artist", "year", "dance", "gender", "genre",
                     "acoustic", "aggressive", "electronic", "happy", "party",
                     "relaxed", "sad", "mirex", "timbre", "tonal", "voice"]


def _genre(p_size: Column) -> Column:
    codes = F.array(*[F.lit(c) for c in GENRE_CODES])
    return F.element_at(codes, (p_size % 10 + 1).cast("int"))


def songs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows plus the raw fields the JSON form carries.

    ``lineitem`` joined with orders, customer and part; Catalyst prunes every
    scan to the columns used.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_discount",
        "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    od = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    # orders meet their customers before the lines do, so that the fact rows are
    # shuffled twice and not three times; each dimension is broadcast only when its
    # estimated size is within the broadcast threshold
    j = (li.join(pa, li.l_partkey == pa.p_partkey)
         .join(od.join(cu, od.o_custkey == cu.c_custkey), li.l_orderkey == od.o_orderkey))
    dance = F.col("l_discount") * 10 + F.lit(0.0)
    acoustic = F.col("l_tax") / F.lit(0.08)
    aggressive = F.col("l_quantity") / F.lit(50.0)
    electronic = F.col("p_size").cast("double") / F.lit(50.0)
    happy = (F.col("p_retailprice") - F.lit(900.0)) / F.lit(100.0)
    return j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).cast("bigint").alias("key"),
        F.col("p_name").alias("name"),
        F.col("c_name").alias("artist"),
        F.year("l_shipdate").alias("year"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"),
        dance.alias("dance"),
        F.when(F.col("o_orderstatus") == "F", "female").otherwise("male").alias("gender"),
        _genre(F.col("p_size")).alias("genre"),
        acoustic.alias("acoustic"),
        aggressive.alias("aggressive"),
        electronic.alias("electronic"),
        happy.alias("happy"),
        (F.lit(1.0) - dance).alias("party"),
        (F.lit(1.0) - acoustic).alias("relaxed"),
        (F.lit(1.0) - aggressive).alias("sad"),
        F.concat(F.lit("cluster"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("mirex"),
        (F.lit(1.0) - electronic).alias("timbre"),
        (F.lit(1.0) - happy).alias("tonal"),
        ((F.col("c_acctbal") + F.lit(1000.0)) / F.lit(11000.0)).alias("voice"),
        "l_returnflag", "l_linestatus", "o_orderpriority",
    )


def songs(spark: SparkSession, sf_dir: str, with_key: bool = False) -> DataFrame:
    """The flat catalogue (duplicates of ``id`` included); ``key`` is the
    numeric form of ``id`` (order key x 1000 + line number)."""
    return songs_raw(spark, sf_dir).select(*CATALOGUE_COLUMNS, *(["key"] if with_key else []))


def recommend_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, name, artist`` for the recommendation lookup."""
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return od.join(cu, od.o_custkey == cu.c_custkey).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"),
        F.col("c_name").alias("artist"))


# ---- DuckDB forms (oracle side) -------------------------------------------

SONGS_RAW_SQL = """
SELECT
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS id,
  p_name AS name, c_name AS artist,
  CAST(year(l_shipdate) AS INTEGER) AS year,
  strftime(l_shipdate, '%Y-%m-%d') AS date,
  l_discount * 10 + 0.0::DOUBLE AS dance,
  CASE WHEN o_orderstatus = 'F' THEN 'female' ELSE 'male' END AS gender,
  ['blu','cla','cou','dis','hip','jaz','met','pop','reg','roc'][CAST(p_size % 10 + 1 AS INTEGER)] AS genre,
  l_tax / 0.08::DOUBLE AS acoustic,
  l_quantity / 50.0::DOUBLE AS aggressive,
  CAST(p_size AS DOUBLE) / 50.0::DOUBLE AS electronic,
  (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS happy,
  1.0::DOUBLE - (l_discount * 10 + 0.0::DOUBLE) AS party,
  1.0::DOUBLE - l_tax / 0.08::DOUBLE AS relaxed,
  1.0::DOUBLE - l_quantity / 50.0::DOUBLE AS sad,
  'cluster' || CAST(c_nationkey % 5 + 1 AS VARCHAR) AS mirex,
  1.0::DOUBLE - CAST(p_size AS DOUBLE) / 50.0::DOUBLE AS timbre,
  1.0::DOUBLE - (p_retailprice - 900.0::DOUBLE) / 100.0::DOUBLE AS tonal,
  (c_acctbal + 1000.0::DOUBLE) / 11000.0::DOUBLE AS voice,
  l_returnflag, l_linestatus, o_orderpriority
FROM lineitem
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey
"""

SONGS_SQL = ("SELECT id, name, artist, year, dance, gender, genre, acoustic, aggressive, "
             "electronic, happy, party, relaxed, sad, mirex, timbre, tonal, voice FROM ("
             + SONGS_RAW_SQL + ")")

RECOMMEND_CATALOGUE_SQL = """
SELECT o_orderkey AS id, o_orderpriority AS name, c_name AS artist
FROM orders JOIN customer ON o_custkey = c_custkey
"""
