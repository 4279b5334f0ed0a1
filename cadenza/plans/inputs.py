"""Input tables the application works on, derived from the driver tables
(Spark form and DuckDB form side by side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table


def event_k(col: str = "props"):
    return F.get_json_object(F.col(col), "$.k").try_cast("bigint")


DUCK_EVENT_K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"


# Fixed rules that make some derived requests hard (so every reply occurs): no
# text, empty text, a text that nothing resembles, and users who keep asking
# for one title (runs longer than the result list).
NO_HIT_TEXT = "zqxwv jkqz"


def asked_k():
    """What an event asks for: ``props.k``, or always the same for every tenth user."""
    return F.when(F.col("user_id") % 10 == 0, F.col("user_id")).otherwise(event_k())


DUCK_ASKED_K = f"CASE WHEN user_id % 10 = 0 THEN user_id ELSE {DUCK_EVENT_K} END"


def search_text():
    """The request's text by the rules above, over ``event_id``, ``user_id``, ``p_name``
    (null where the part asked for does not exist)."""
    return (F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string"))
            .when(F.col("event_id") % 11 == 0, F.lit(""))
            .when((F.col("event_id") % 17 == 0) & (F.col("user_id") % 10 != 0), F.lit(NO_HIT_TEXT))
            .otherwise(F.col("p_name")))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log ``(request_id, session_id, ts, query)``: every event asks
    for a part's name; null and empty texts and texts without a hit included."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", asked_k().alias("k"))
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return ev.join(pa, ev.k == pa.p_partkey, "left").select(
        F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"),
        "ts", search_text().alias("query"))


SEARCH_REQUESTS_SQL = f"""
SELECT event_id AS request_id, user_id AS session_id, ts,
       CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN ''
            WHEN event_id % 17 = 0 AND user_id % 10 <> 0 THEN '{NO_HIT_TEXT}' ELSE p_name END AS query
FROM events LEFT JOIN part ON p_partkey = {DUCK_ASKED_K}
"""


def part_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search catalogue ``(id, name, artist)`` from ``part``."""
    return read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.col("p_brand").alias("artist"))


PART_CATALOGUE_SQL = "SELECT p_partkey AS id, p_name AS name, p_brand AS artist FROM part"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def playlist_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Playlist inserts ``(id, username, song, added_at)``: every click or
    view event saves the part named by its ``props.k``."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "view"))
    pa = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    ev = ev.select("event_id", "user_id", "ts", event_k().alias("k"))
    return ev.join(pa, ev.k == pa.p_partkey).select(
        F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        F.col("p_name").alias("song"), F.col("ts").alias("added_at"))


def playlist_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete requests ``(id)``: each purchase event removes playlist row
    ``props.k`` (unknown ids remove nothing)."""
    ev = read_table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    return ev.select(event_k().alias("id"))


PLAYLIST_ADDS_SQL = f"""
SELECT event_id AS id, 'u' || CAST(user_id AS VARCHAR) AS username, p_name AS song, ts AS added_at
FROM events JOIN part ON p_partkey = {DUCK_EVENT_K} WHERE event_type IN ('click', 'view')
"""
PLAYLIST_DELETES_SQL = f"SELECT {DUCK_EVENT_K} AS id FROM events WHERE event_type = 'purchase'"


def part_index(spark: SparkSession, sf_dir: str):
    """The stored trigram index over the part catalogue (built once per session)."""
    import os
    from ..operators.fuzzy import TrigramIndex
    from ..session import scratch_path, written_once
    path = written_once(spark, "trigram-index", [os.path.join(sf_dir, "part.parquet")],
                        lambda: TrigramIndex.build(part_catalogue(spark, sf_dir),
                                                   scratch_path(spark, "trigram-index")).path)
    return TrigramIndex(spark, path)
