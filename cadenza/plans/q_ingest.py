"""Ingest family: the JSON tree (written by Spark from the driver tables,
then scanned recursively), rejects with reasons, load yield, null profile,
and the dirty-value parse on ``pages.url``."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import json_ingest as J
from ..session import read_table, scratch_path, session_conf, written_once
from ..operators import quality as Q
from .catalogue import SCORE_COLUMNS, SONGS_RAW_SQL, songs_raw
from .q_features import DEDUP_ORDER, _REST
from .registry import query, r6

# Fixed rules that make some derived records dirty (so rejects have data):
# a free-text date, an empty title, a null gender.
def _bad_date():
    return (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F") & (F.col("o_orderpriority") == "2-HIGH")


def _empty_title():
    return (F.col("l_returnflag") == "A") & (F.col("o_orderpriority") == "5-LOW")


def _null_gender():
    return (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")

DIRTY_SQL = f"""
SELECT id,
  CASE WHEN l_returnflag = 'A' AND o_orderpriority = '5-LOW' THEN NULL ELSE name END AS name,
  artist,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND o_orderpriority = '2-HIGH' THEN o_orderpriority ELSE date END AS date,
  dance,
  CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' AND o_orderpriority = '1-URGENT' THEN NULL ELSE gender END AS gender,
  genre, acoustic, aggressive, electronic, happy, party, relaxed, sad, mirex, timbre, tonal, voice
FROM ({SONGS_RAW_SQL})
"""

FLAT_SQL = f"""
SELECT *, TRY_CAST(substr(date, 1, 4) AS INTEGER) AS year,
  CASE WHEN id IS NULL OR name IS NULL OR artist IS NULL OR date IS NULL OR gender IS NULL
            OR genre IS NULL OR mirex IS NULL OR {' OR '.join(f'{c} IS NULL' for c in SCORE_COLUMNS)}
       THEN 'missing field'
       WHEN TRY_CAST(substr(date, 1, 4) AS INTEGER) IS NULL THEN 'year' END AS reason
FROM ({DIRTY_SQL})
"""

KEPT_SQL = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(DEDUP_ORDER + _REST)}) AS _rn
  FROM ({FLAT_SQL}) WHERE reason IS NULL) WHERE _rn = 1
"""


#: Folders of the JSON tree a task writes to at a time (there are six pairs of flags at most).
FOLDERS_OPEN = 16


def write_json_tree(spark, sf) -> str:
    """The derived JSON tree for ``sf`` (written once per session)."""
    inputs = [os.path.join(sf, f"{t}.parquet") for t in ("lineitem", "orders", "customer", "part")]
    return written_once(spark, "json-tree", inputs, lambda: _write_json_tree(spark, sf))


def _write_json_tree(spark, sf) -> str:
    """Spark writes the derived records as a JSON tree, one folder level per
    return flag and line status, and returns its root."""
    raw = songs_raw(spark, sf)
    dirty = raw.select(
        "id", "artist", *SCORE_COLUMNS, "genre", "mirex", "l_returnflag", "l_linestatus",
        F.when(_empty_title(), F.array().cast("array<string>")).otherwise(F.array("name")).alias("title"),
        F.when(_bad_date(), F.col("o_orderpriority")).otherwise(F.col("date")).alias("date"),
        F.when(_null_gender(), F.lit(None).cast("string")).otherwise(F.col("gender")).alias("gender"),
    )
    path = scratch_path(spark, "json-tree")
    records = J.to_records(dirty, extra=["l_returnflag", "l_linestatus"])
    # a task keeps one file per folder open instead of sorting its records by folder first
    with session_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", FOLDERS_OPEN):
        records.write.partitionBy("l_returnflag", "l_linestatus").option("compression", "gzip").json(path)
    return path


def _flat(spark, sf) -> DataFrame:
    return J.flatten(J.scan(spark, write_json_tree(spark, sf), multi_line=False))


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "artist", F.col("year").cast("bigint").alias("year"),
                     *[r6(c).alias(c) for c in SCORE_COLUMNS], "gender", "genre", "mirex")


_OUT_SQL = ("SELECT id, name, artist, CAST(year AS BIGINT) AS year, "
            + ", ".join(f"round({c}, 6) AS {c}" for c in SCORE_COLUMNS) + ", gender, genre, mirex")


@query("ingest_json", _OUT_SQL + f" FROM ({KEPT_SQL})")
def q_ingest_json(spark, sf):
    """Recursive JSON scan → flat → rejects out → keep-first per id."""
    root = write_json_tree(spark, sf)
    kept, _ = J.ingest(spark, root, multi_line=False, dedup_order=DEDUP_ORDER)
    return _out(kept)


@query("ingest_reject_reasons", f"SELECT reason, count(*) AS n FROM ({FLAT_SQL}) WHERE reason IS NOT NULL GROUP BY reason")
def q_ingest_reject_reasons(spark, sf):
    _, rejects = J.split_good(_flat(spark, sf))
    return rejects.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("load_yield", f"""
SELECT 'read' AS status, count(*) AS n FROM ({FLAT_SQL})
UNION ALL SELECT 'kept', count(*) FROM ({KEPT_SQL})
UNION ALL SELECT 'rejected', count(*) FROM ({FLAT_SQL}) WHERE reason IS NOT NULL
UNION ALL SELECT 'duplicate', (SELECT count(*) FROM ({FLAT_SQL}) WHERE reason IS NULL) - (SELECT count(*) FROM ({KEPT_SQL}))
""")
def q_load_yield(spark, sf):
    """Rows read, kept, rejected and dropped as duplicates, counted while the tree is loaded into a keyed table."""
    n = J.load(spark, write_json_tree(spark, sf), scratch_path(spark, "load"), multi_line=False, dedup_order=DEDUP_ORDER)
    return spark.createDataFrame(list(n.items()), "status string, n bigint")


# One document per supplier, each in a file of its own. Fixed rules make some dirty: text for a date, no title, a
# document that breaks off.
_DOC_DATE = "CASE WHEN s_suppkey % 7 = 0 THEN 'unknown' ELSE CAST(1950 + s_nationkey AS {0}) || '-05-01' END"
_DOC_SCORE = "(s_acctbal + 1000.0) / 11000.0"


#: Documents of the tree that one task writes.
DOCUMENTS_PER_TASK = 2000


def write_document_tree(spark, sf) -> str:
    """A nested tree of pretty-printed documents, one file each, written by Spark once per session."""
    def write() -> str:
        sup = read_table(spark, sf, "supplier").join(read_table(spark, sf, "nation"), F.expr("s_nationkey = n_nationkey"))
        flat = sup.select(
            "s_suppkey", "s_nationkey", F.concat(F.lit("s"), (F.col("s_suppkey") - F.col("s_suppkey") % 5).cast("string")).alias("id"),
            F.when(F.col("s_suppkey") % 11 == 0, F.array().cast("array<string>")).otherwise(F.array("s_name")).alias("title"),
            F.col("n_name").alias("artist"), F.expr(_DOC_DATE.format("STRING")).alias("date"),
            *[F.expr(_DOC_SCORE).cast("double").alias(c) for c in SCORE_COLUMNS],
            F.when(F.col("s_suppkey") % 2 == 0, "female").otherwise("male").alias("gender"), F.lit("roc").alias("genre"), F.lit("cluster1").alias("mirex"))
        text = F.to_json(F.struct("metadata", "highlevel"), {"pretty": "true"})
        doc = F.when(F.col("s_suppkey") % 13 == 0, F.substring(text, 1, 40)).otherwise(text)
        path = scratch_path(spark, "documents-tree")
        docs = J.to_records(flat, extra=["s_suppkey", "s_nationkey"]).select(doc.alias("value"), "s_nationkey", "s_suppkey")
        # a file per supplier without a folder per supplier (rows of one key share its file, one after the other); a task
        # makes few files and moves them itself when it commits
        tasks = max(1, math.ceil(read_table(spark, sf, "supplier").count() / DOCUMENTS_PER_TASK))
        each = (docs.withColumn("_pos", F.monotonically_increasing_id()).repartition(tasks, "s_nationkey", "s_suppkey")
                .groupBy("s_nationkey", "s_suppkey").agg(F.array_sort(F.collect_list(F.struct("_pos", "value"))).alias("d")))
        (each.select(F.array_join("d.value", "\n").alias("value"), "s_nationkey").write.partitionBy("s_nationkey")
         .option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path))
        return path
    return written_once(spark, "documents-tree", [os.path.join(sf, f"{t}.parquet") for t in ("supplier", "nation")], write)


_DOC_FLAT = f"""
SELECT s_suppkey, 's' || CAST(s_suppkey - s_suppkey % 5 AS VARCHAR) AS id, s_name AS name, n_name AS artist, 1950 + s_nationkey AS year,
       round({_DOC_SCORE}, 6) AS dance,
       CASE WHEN s_suppkey % 13 = 0 THEN 'corrupt' WHEN s_suppkey % 11 = 0 THEN 'missing field' WHEN s_suppkey % 7 = 0 THEN 'year' END AS reason
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""


@query("ingest_documents", f"""
SELECT id, name, artist, CAST(year AS BIGINT) AS year, dance, 'kept' AS status FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY year, name) AS rn FROM ({_DOC_FLAT}) WHERE reason IS NULL) WHERE rn = 1
UNION ALL
SELECT CASE WHEN reason <> 'corrupt' THEN id END, NULL, NULL, NULL, NULL, reason FROM ({_DOC_FLAT}) WHERE reason IS NOT NULL
""")
def q_ingest_documents(spark, sf):
    """A tree with one multi-line document per file: the catalogue and, per file that is no good one, a reject."""
    kept, rejects = J.ingest(spark, write_document_tree(spark, sf), True, ["year", "name"], "*.txt")
    good = kept.select("id", "name", "artist", F.col("year").cast("bigint").alias("year"), r6("dance").alias("dance"), F.lit("kept").alias("status"))
    return good.unionByName(rejects.select("id", F.col("reason").alias("status")), allowMissingColumns=True)


NULL_COLUMNS = ["id", "name", "artist", "date", "year", *SCORE_COLUMNS, "gender", "genre", "mirex"]


@query("null_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM ({FLAT_SQL})"
    for c in NULL_COLUMNS))
def q_null_profile(spark, sf):
    """Nulls per column of the flat rows, before validation."""
    return Q.null_profile(_flat(spark, sf), NULL_COLUMNS)


@query("ingest_rejects", """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN p IS NULL OR p = '' THEN 'missing part'
              WHEN TRY_CAST(p AS INTEGER) IS NULL THEN 'not an integer' ELSE 'ok' END AS reason
  FROM (SELECT CASE WHEN len(string_split(url, '/')) >= 5 THEN string_split(url, '/')[5] END AS p FROM pages))
GROUP BY reason
""")
def q_ingest_rejects(spark, sf):
    """Parse the 5th '/'-separated part of ``pages.url`` as an integer; count
    good values and rejects by reason (the rest continues)."""
    p = read_table(spark, sf, "pages").select(F.get(F.split("url", "/"), 4).alias("p"))
    reason = (F.when(Q.missing_text(F.col("p")), F.lit("missing part"))
              .when(F.col("p").try_cast("int").isNull(), F.lit("not an integer"))
              .otherwise(F.lit("ok")))
    return p.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
