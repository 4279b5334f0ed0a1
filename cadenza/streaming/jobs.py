"""Structured Streaming forms of ingest, scoring and the result cursor.

Each gives the same rows as its batch form:

* ``ingest_stream``: new JSON files -> the same flatten/validate -> appended
  to a Parquet sink, without state; reading keeps the first per id by the same
  aggregate as the batch form, so repeated records fall out there. Equal to the
  batch keep-first whatever order the files arrive in.
* ``ingest_stream_keyed``: the same records into a sink that is keyed itself: the first arrival of an id stays. A second
  stream holds the batch of each id's first arrival in Spark's state store, so a batch costs what it holds.
* ``topk_stream``: request vectors arrive as a stream; each micro-batch is
  scored with the batch operator against the static catalogue, whose unit vectors are stored and counted once.
* ``replay_stream``: each micro-batch numbers its requests by range
  partitioning, so that no session is held by one task, searches for its own
  texts and picks the reply at its position. From batch to batch Spark's state
  store carries each session's last query and position. Equal to the batch
  form where the files arrive in the order of their requests.

``foreachBatch`` steps write one folder per batch id, over whatever an attempt
that failed had left, so that a repeated batch adds no row.

All use file sources and sinks, checkpoints in the shared folder and the
``availableNow`` trigger (process what is there, then stop).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sessions as S
from ..operators import topk as TK
from ..operators.ordered import ordered_positions
from ..session import scratch_path, session_conf
from ..operators.quality import dedup_first
from ..sources import json_ingest as J


STATE = "spark.sql.streaming.stateStore"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _run(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


# ---- X1 -----------------------------------------------------------------

def _flat_records(spark: SparkSession, root: str, max_files_per_trigger: int | None) -> DataFrame:
    """The records of the JSON files below ``root`` with their reasons, as a stream."""
    src = (spark.readStream.schema(J.record_schema())
           .option("recursiveFileLookup", True)
           .option("pathGlobFilter", J.PATTERN)
           .option("multiLine", False)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", J.CORRUPT))
    if max_files_per_trigger:
        src = src.option("maxFilesPerTrigger", max_files_per_trigger)
    return J.flatten(src.json(root).withColumn("_file", F.col("_metadata.file_path")))


def _valid(flat: DataFrame) -> DataFrame:
    good, _ = J.split_good(flat)
    return good.drop("date", "_file")


def ingest_stream(spark: SparkSession, root: str, dedup_order: Sequence[str],
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """Validated records land once per arrival, append-only and without state (the sink keeps each
    file's rows once), and the keyed table is the keep-first over what landed."""
    good = _valid(_flat_records(spark, root, max_files_per_trigger))
    base = scratch_path(spark, "ingest-stream")
    _run(good.writeStream.outputMode("append").format("parquet")
         .option("path", f"{base}/landed").option("checkpointLocation", f"{base}/_checkpoint"))
    return dedup_first(spark.read.schema(good.schema).parquet(f"{base}/landed"), "id", list(dedup_order))


def _first_arrivals(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows named by ``(_id, first)``. Merged, never broadcast: the ids of a batch have no bound, and their files are far
    smaller than their rows in the driver's memory."""
    return rows.join(fresh.hint("merge"), F.col("id").eqNullSafe(F.col("_id")) & (F.col("arrival") == F.col("first")), "left_semi")


def ingest_stream_keyed(spark: SparkSession, root: str, dedup_order: Sequence[str],
                        max_files_per_trigger: int | None = None, base: str | None = None) -> DataFrame:
    """The keyed table itself as the sink: each id once, with the record of its first arrival. Within a micro-batch the
    record smallest in ``dedup_order`` (then in the other columns) comes first, so with one micro-batch the rows are those
    of the batch form. ``base`` names the stream's folder: given again, the stream goes on from its checkpoints and rows
    in the sink stay as they are.

    The first stream lands each micro-batch keyed by itself. The second reads only ``(id, arrival)`` of what landed and
    aggregates the first arrival per id in Spark's state store (two numbers per id; it never expires, as an id may come
    again at any time, so it is kept by RocksDB, on disk and in bounded memory; a stream begun otherwise goes on as it began). An id seen in an earlier batch keeps an
    earlier first arrival and falls out; the others fetch their records from the batches just read.

    The first stream carries the rejects too and a batch is filtered when it lands: ``foreachBatch`` asks its plan for all that
    holds of the rows, and a filter below the columns whose nulls make up ``reason`` says so
    once for each subset of them."""
    flat = _flat_records(spark, root, max_files_per_trigger)
    good = _valid(flat)
    base = base or scratch_path(spark, "ingest-keyed")
    names, key_type = good.columns, good.schema["id"].dataType
    landed = T.StructType([*good.schema.fields, T.StructField("arrival", T.LongType())])
    mark_ddl = "epoch bigint, mark bigint"

    def land(batch: DataFrame, epoch: int) -> None:
        dedup_first(_valid(batch), "id", list(dedup_order)).select(*names, F.lit(epoch).cast("bigint").alias("arrival")) \
            .write.mode("overwrite").parquet(f"{base}/landed/part={epoch}")

    def settle(touched: DataFrame, epoch: int) -> None:
        touched.write.mode("overwrite").parquet(f"{base}/touched/part={epoch}")
        seen = spark.read.schema(touched.schema).parquet(f"{base}/touched/part={epoch}")
        marks = spark.read.schema(mark_ddl).parquet(f"{base}/marks")
        before = marks.where(F.col("epoch") < epoch).agg(F.coalesce(F.max("mark"), F.lit(-1))).first()[0]
        mark = seen.agg(F.coalesce(F.max("latest"), F.lit(before))).first()[0]  # the last batch read so far
        fresh = seen.where(F.col("first") > before).select(F.col("id").alias("_id"), "first")
        rows = spark.read.schema(landed).parquet(f"{base}/landed").where(F.col("part").between(before + 1, mark))
        _first_arrivals(rows, fresh).select(*names) \
            .write.mode("overwrite").parquet(f"{base}/keyed/part={epoch}")
        spark.createDataFrame([(epoch, mark)], mark_ddl).write.mode("overwrite").parquet(f"{base}/marks/part={epoch}")

    for folder, schema in (("landed", landed), ("keyed", good.schema), ("marks", mark_ddl)):  # a stream without data has no batch
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/{folder}/part=-1")
    _run(flat.writeStream.foreachBatch(land).option("checkpointLocation", f"{base}/_landing"))
    ids = spark.readStream.schema(T.StructType([T.StructField("id", key_type), landed["arrival"]])).parquet(f"{base}/landed")
    first = ids.groupBy("id").agg(F.min("arrival").alias("first"), F.max("arrival").alias("latest"))
    with session_conf(spark, f"{STATE}.providerClass", ROCKSDB), session_conf(spark, f"{STATE}.rocksdb.boundedMemoryUsage", "true"):
        _run(first.writeStream.outputMode("update").foreachBatch(settle).option("checkpointLocation", f"{base}/_keys"))
    return spark.read.schema(good.schema).parquet(f"{base}/keyed").select(*names)


def _answer_batches(spark: SparkSession, stream: DataFrame, answer: Callable[[DataFrame, int], DataFrame],
                    schema: str, base: str) -> DataFrame:
    """Run the stream to its end; ``answer(batch, batch id)`` goes to a folder named by the batch id. Each
    batch is written before it is answered, so that the files and joins behind it are read once."""
    def step(batch: DataFrame, epoch: int) -> None:
        path = f"{base}/in/batch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        answer(spark.read.schema(batch.schema).parquet(path), epoch).write.mode("overwrite").parquet(f"{base}/out/batch={epoch}")

    names = T.StructType.fromDDL(schema).names
    spark.createDataFrame([], schema).write.parquet(f"{base}/out/batch=-1")  # a stream without data has no batch
    _run(stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/_checkpoint"))
    return spark.read.schema(schema).parquet(f"{base}/out").select(*names)


# ---- X2 -----------------------------------------------------------------

TOPK_OUT = "qid bigint, rank bigint, id bigint, score double"


def topk_stream(spark: SparkSession, query_path: str, query_schema: str,
                qid_col: str, qvec_col: str,
                catalogue: DataFrame, k: int = TK.DEFAULT_K,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """``query_path`` is a folder of Parquet files or a pattern."""
    base = scratch_path(spark, "topk-stream")
    src = spark.readStream.schema(query_schema)
    if max_files_per_trigger:
        src = src.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = src.parquet(query_path).select(F.col(qid_col).alias("qid"), F.col(qvec_col).alias("vec"))

    stored = TK.stored_catalogue(catalogue)
    return _answer_batches(spark, stream, lambda batch, _: TK.topk_cosine(batch, stored, k=k), TOPK_OUT, base)


# ---- X3 -----------------------------------------------------------------

REPLAY_OUT = "request_id bigint, pos bigint, reply string"


def _carry_over(key, frames, state):
    """Keyed state of one session: its last text, how often that was asked in a row, the last batch seen. In: what each
    new batch holds of the session, a row a batch. Out: how far the batch's first run had come before."""
    import pandas as pd

    rows = pd.concat(list(frames)).sort_values("batch")  # one row per new batch of this session
    text, length, seen = state.get if state.exists else (None, 0, -1)
    out = []
    for r in rows.itertuples(index=False):
        if r.batch <= seen:
            continue
        goes_on = seen >= 0 and r.first_v == text
        out.append((key[0], r.batch, length if goes_on else 0))
        length = length + r.tail if goes_on and r.runs == 1 else r.tail
        text, seen = r.last_v, r.batch
    state.update((text, int(length), int(seen)))
    yield pd.DataFrame(out, columns=["session_id", "batch", "carry"])


def replay_stream(spark: SparkSession, requests: DataFrame, search: Callable[[DataFrame], DataFrame],
                  replies: S.Replies = S.SEARCH_REPLIES, base: str | None = None,
                  progress: list | None = None) -> DataFrame:
    """``(request_id, pos, reply)``. ``requests`` is a streaming DataFrame ``(request_id,
    session_id, ts, query)``; ``search(requests)`` gives ``(q, rank, name, artist)`` for
    their texts and is called in every micro-batch, so texts never seen before are answered.

    Two streams. The first numbers each micro-batch by itself in the range form, so that a hot session is spread over
    tasks, answers the requests without a query, and writes one row per session: its first and last text and the
    lengths of its runs. The second holds the sessions' cursors in Spark's state store, keyed by session; it reads these
    rows only, so a batch costs what it holds, and replies at position + carry. ``base`` names the streams' folder: given
    again, both go on from their checkpoints. ``progress`` gets the second stream's progress reports.

    Order of a session's requests: micro-batches as they come (files in the order of their arrival), by
    ``ts`` and request id within one. The batch form's positions hold where no batch has a request older
    than one of an earlier batch; a request that arrives late follows those already answered. One without
    a query has no position and leaves the run as it is."""
    base = base or scratch_path(spark, "replay-stream")
    key_type = dict(requests.dtypes)["session_id"]
    numbered_ddl = f"request_id bigint, session_id {key_type}, query string, run_no bigint, pos bigint"
    ends_ddl = f"session_id {key_type}, batch bigint, runs bigint, first_v string, last_v string, tail bigint"

    def number(batch: DataFrame, epoch: int) -> None:
        path = f"{base}/in/batch={epoch}"
        batch.write.mode("overwrite").parquet(path)
        checked = S.valid_requests(spark.read.schema(batch.schema).parquet(path))
        asked = checked.where("valid").drop("valid", "error")
        runs = ordered_positions(asked, "session_id", [F.col("ts").asc(), F.col("request_id").asc()], value="query")
        runs.select("request_id", "session_id", "query", "run_no", F.col("pos_in_run").alias("pos"), F.col("pos").alias("nth")) \
            .write.mode("overwrite").parquet(f"{base}/runs/batch={epoch}")
        checked.where("NOT valid").select("request_id", F.lit(None).cast("bigint").alias("pos"), F.col("error").alias("reply")) \
            .write.mode("overwrite").parquet(f"{base}/refused/batch={epoch}")
        done = spark.read.schema(numbered_ddl + ", nth bigint").parquet(f"{base}/runs/batch={epoch}")
        per = done.groupBy("session_id").agg(F.min(F.struct("nth", "query")).alias("lo"),
                                             F.max(F.struct("nth", "query", "run_no", "pos")).alias("hi"))
        # last: the second stream sees a batch when all else of it is there
        per.select("session_id", F.lit(epoch).cast("bigint").alias("batch"), F.col("hi.run_no").alias("runs"),
                   F.col("lo.query").alias("first_v"), F.col("hi.query").alias("last_v"), F.col("hi.pos").alias("tail")) \
            .write.mode("overwrite").parquet(f"{base}/ends/part={epoch}")

    def reply(carried: DataFrame, epoch: int) -> None:
        path = f"{base}/carried/batch={epoch}"
        carried.write.mode("overwrite").parquet(path)
        carry = spark.read.schema(carried.schema).parquet(path)
        batches = [r.batch for r in carry.select("batch").distinct().collect()]  # the few batches read since
        runs = spark.read.schema(numbered_ddl + ", batch bigint").option("basePath", f"{base}/runs").parquet(
            *[f"{base}/runs/batch={b}" for b in batches]) if batches else spark.createDataFrame([], numbered_ddl + ", batch bigint")
        c = carry.select(F.col("session_id").alias("_s"), F.col("batch").alias("_b"), "carry")
        runs = runs.join(c, F.col("session_id").eqNullSafe(F.col("_s")) & (F.col("batch") == F.col("_b")))
        runs = runs.select("request_id", "query", (F.col("pos") + F.when(F.col("run_no") == 1, F.col("carry")).otherwise(F.lit(0))).alias("pos"))
        S.replay(runs, search(runs.select("query")), replies).select("request_id", "pos", "reply") \
            .write.mode("overwrite").parquet(f"{base}/replies/batch={epoch}")

    for folder, ddl in (("runs", numbered_ddl + ", nth bigint"), ("refused", REPLAY_OUT), ("replies", REPLAY_OUT)):
        spark.createDataFrame([], ddl).write.mode("overwrite").parquet(f"{base}/{folder}/batch=-1")  # a stream without data has no batch
    spark.createDataFrame([], ends_ddl).write.mode("overwrite").parquet(f"{base}/ends/part=-1")
    _run(requests.writeStream.foreachBatch(number).option("checkpointLocation", f"{base}/_numbering"))
    ends = spark.readStream.schema(ends_ddl).parquet(f"{base}/ends")
    cursors = ends.groupBy("session_id").applyInPandasWithState(
        _carry_over, f"session_id {key_type}, batch bigint, carry bigint", "last_v string, length bigint, batch bigint", "update", "NoTimeout")
    done = _run(cursors.writeStream.outputMode("update").foreachBatch(reply).option("checkpointLocation", f"{base}/_cursors"))
    if progress is not None:
        progress += done.recentProgress
    return spark.read.schema(REPLAY_OUT).parquet(f"{base}/replies").select("request_id", "pos", "reply").unionByName(
        spark.read.schema(REPLAY_OUT).parquet(f"{base}/refused").select("request_id", "pos", "reply"))
