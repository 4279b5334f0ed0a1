"""Streaming family: each query runs a Structured Streaming job to the end
(``availableNow``) and returns what it wrote; the rows equal the batch form,
so the batch oracle SQL applies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fuzzy
from ..operators import sessions as S
from ..streaming import jobs
from .inputs import asked_k, part_catalogue, part_index, search_text, vectors
from .q_features import DEDUP_ORDER
from .q_ingest import KEPT_SQL, _OUT_SQL, _out, write_json_tree
from .q_vectors import TOPK_SQL
from .registry import ORACLE, query

#: Files in a micro-batch.
FILES_PER_BATCH = 64


def stream_path(sf: str, table: str) -> str:
    """The table as a stream's source, one file or a folder of part files. A pattern that only the table
    matches: a plain path has to be a folder there."""
    return f"{sf}/{{{table}}}.parquet"


@query("stream_ingest", _OUT_SQL + f" FROM ({KEPT_SQL})")
def q_stream_ingest(spark, sf):
    root = write_json_tree(spark, sf)
    return _out(jobs.ingest_stream(spark, root, DEDUP_ORDER, max_files_per_trigger=FILES_PER_BATCH))


@query("stream_ingest_keyed", _OUT_SQL + f" FROM ({KEPT_SQL})")
def q_stream_ingest_keyed(spark, sf):
    """All files in one micro-batch, so that first arrivals do not depend on the order of the files."""
    return _out(jobs.ingest_stream_keyed(spark, write_json_tree(spark, sf), DEDUP_ORDER))


@query("stream_topk", TOPK_SQL + """
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 15
""")
def q_stream_topk(spark, sf):
    res = jobs.topk_stream(spark, stream_path(sf, "embeddings"),
                           "vec_id bigint, embedding array<float>, label int", "vec_id", "embedding",
                           vectors(spark, sf), k=15, max_files_per_trigger=FILES_PER_BATCH)
    return res.select("qid", "rank", "id", F.round("score", 6).alias("score"))


def _request_stream(spark, sf):
    ev = (spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                                  "value double, props string")
          .option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(stream_path(sf, "events")))
    ev = ev.select("event_id", "user_id", "ts", asked_k().alias("k"))
    pa = part_catalogue(spark, sf).select(F.col("id").alias("k"), F.col("name").alias("p_name"))
    return ev.join(pa, "k", "left").select(F.col("event_id").alias("request_id"), F.col("user_id").alias("session_id"),
                                           "ts", search_text().alias("query"))


def q_stream_replay(spark, sf):
    """Search replay with the per-session cursor carried from micro-batch to micro-batch; each
    searches the stored index for its own texts. Sessions go on in the order in which files arrive."""
    parts, index = part_catalogue(spark, sf), part_index(spark, sf)

    def search(requests):
        return fuzzy.fuzzy_top(requests, parts, 5, q_col="query", index=index).select("q", "rank", "name", "artist")

    return jobs.replay_stream(spark, _request_stream(spark, sf), search, S.SEARCH_REPLIES)


def _register_replay():
    from . import q_sessions  # noqa: F401 - its oracle is used below
    query("stream_replay", ORACLE["replay_requests"])(q_stream_replay)


_register_replay()
