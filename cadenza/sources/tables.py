"""Stored tables with what a database gives at load and insert: a checked key, counts of the load, ids and times.

A table is a folder of versions and parts. ``load_keyed`` writes a new version, counts its rows in the same pass and
checks the key before a one-line file, ``current``, names the version; a load that fails leaves the table as it was.
``append_numbered`` gives each row of a batch the next ids and the batch one time, as ``SERIAL`` and ``DEFAULT now()``
columns would; the part's name holds the first id after it, so the next append starts there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ordered_positions
from ..operators.quality import assert_key
from ..session import cut_lineage


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
    """``df`` whose next action also computes the given counts (``Observation.get`` afterwards)."""
    seen = Observation(f"counts-{uuid.uuid4().hex[:8]}")
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def load_keyed(df: DataFrame, path: str, key: str) -> int:
    """Replace the table at ``path`` by ``df``; its number of rows. Raises ``ValueError`` and leaves the table as it was
    where ``key`` is null or repeated."""
    spark = df.sparkSession
    version = f"version={uuid.uuid4().hex[:12]}"
    rows, seen = counted(df, n=F.count(F.lit(1)))
    rows.write.parquet(f"{path}/{version}")
    assert_key(spark.read.schema(df.schema).parquet(f"{path}/{version}").select(key), key)
    spark.range(1).select(F.lit(version).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/current")
    return seen.get["n"]


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """The version that ``current`` names."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/current').first()['value']}")


def _next_id(spark: SparkSession, path: str) -> int:
    marks = spark.read.schema("next bigint").parquet(f"{path}/marks").agg(F.max("next").alias("n")).first()["n"]
    return marks or 1


def create_numbered(spark: SparkSession, path: str) -> None:
    """An empty table for ``append_numbered``."""
    spark.createDataFrame([(1,)], "next bigint").write.parquet(f"{path}/marks")


def append_numbered(df: DataFrame, path: str, order: Sequence[Column], id_col: str = "id", time_col: str = "added_at",
                    now: datetime | None = None) -> int:
    """Append ``df`` with ids that go on from the table's last one, without gaps, in ``order`` (total), and the time of the
    append (UTC). The number of rows. Positions come from the range form, so no task holds the whole batch. Ids count
    only when the mark is written after the rows: an append that fails midway leaves none behind that is read."""
    spark = df.sparkSession
    start = _next_id(spark, path)
    at = now or datetime.now(timezone.utc).replace(tzinfo=None)
    numbered = ordered_positions(cut_lineage(df.withColumn("_all", F.lit("*")), "append"), "_all", order)
    rows = numbered.select((F.col("pos") + (start - 1)).alias(id_col), *[F.col(c) for c in df.columns], F.lit(at).cast("timestamp_ntz").alias(time_col))
    rows, seen = counted(rows, n=F.count(F.lit(1)))
    rows.write.mode("overwrite").parquet(f"{path}/rows/start={start}")
    n = seen.get["n"]
    if n:
        spark.createDataFrame([(start + n,)], "next bigint").write.mode("append").parquet(f"{path}/marks")
    return n


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """All rows appended so far; parts at or after the last mark are of appends that did not finish."""
    rows = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return rows.where(F.col("start") < _next_id(spark, path)).drop("start")
