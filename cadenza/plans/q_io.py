"""I/O family: table scan, replace/append/CSV sinks read back, delete by
key, positional-parameter SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import read_table, register_tables, scratch_path
from ..sources import sinks, tables
from .inputs import (PLAYLIST_ADDS_SQL, PLAYLIST_DELETES_SQL, playlist_adds, playlist_deletes)
from .registry import query, r6


@query("scan_table", "SELECT * FROM customer")
def q_scan_table(spark, sf):
    return read_table(spark, sf, "customer")


@query("sink_replace", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_sink_replace(spark, sf):
    """Write twice in replace mode (the second replaces the first), read back."""
    path = scratch_path(spark, "replace")
    cu = read_table(spark, sf, "customer")
    sinks.write_replace(cu.withColumn("c_acctbal", -cu["c_acctbal"]), path)
    sinks.write_replace(cu, path)
    return sinks.read_back(spark, path)


@query("sink_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_sink_csv(spark, sf):
    """CSV export with header, read back with the table's schema."""
    path = scratch_path(spark, "csv")
    cu = read_table(spark, sf, "customer")
    sinks.write_csv(cu, path)
    return sinks.read_csv(spark, path, cu.schema)


@query("sink_append", f"""
SELECT row_number() OVER (ORDER BY event_type, added_at, a.id) AS id, username, song,
       CASE WHEN event_type = 'click' THEN 1 ELSE 2 END AS append_no
FROM ({PLAYLIST_ADDS_SQL}) a JOIN events ON event_id = a.id
""")
def q_sink_append(spark, sf):
    """Playlist inserts appended in two writes (clicks, then views), each in order of time; the table gives
    the ids and the time of each append."""
    path = scratch_path(spark, "append")
    adds = playlist_adds(spark, sf).withColumnRenamed("id", "event")
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("event"), "event_type")
    typed = adds.withColumnRenamed("added_at", "asked_at").join(ev, "event")
    tables.create_numbered(spark, path)
    for t in ("click", "view"):
        tables.append_numbered(typed.filter(F.col("event_type") == t).drop("event_type"), path, [F.col("asked_at").asc(), F.col("event").asc()])
    rows = tables.read_numbered(spark, path)
    times = rows.select("added_at").distinct()  # one per append
    nth = times.select(F.col("added_at").alias("_at"), F.row_number().over(Window.orderBy("added_at")).alias("append_no"))
    return rows.join(nth, F.col("added_at") == F.col("_at")).select("id", "username", "song", "append_no")


@query("delete_by_key", f"""
SELECT * FROM ({PLAYLIST_ADDS_SQL}) a WHERE NOT EXISTS (
  SELECT 1 FROM ({PLAYLIST_DELETES_SQL}) d WHERE d.id = a.id)
""")
def q_delete_by_key(spark, sf):
    return sinks.delete_by_key(playlist_adds(spark, sf), playlist_deletes(spark, sf), "id")


POSITIONAL_SQL = """
SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS pos, event_id AS id, ts AS added_at
FROM events WHERE user_id = ? AND event_type = ?
"""


@query("param_sql_pos", POSITIONAL_SQL.replace("?", "{}", 2).format(7, "'click'"))
def q_param_sql_pos(spark, sf):
    """A listing statement with positional parameters (``?`` markers)."""
    register_tables(spark, sf, ["events"])
    return spark.sql(POSITIONAL_SQL, args=[7, "click"]).select(
        F.col("pos").cast("bigint").alias("pos"), "id", "added_at")
