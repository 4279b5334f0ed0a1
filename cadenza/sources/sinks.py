"""Table sinks: replace, append, delete by key, CSV export.

Writes go to the shared checkpoint folder (or a path the caller gives); a
written table also cuts lineage, so a lost executor recomputes from it rather
than from the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def write_append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("append").format(fmt).save(path)


def read_back(spark: SparkSession, path: str, schema=None, fmt: str = "parquet") -> DataFrame:
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    return r.load(path)


def delete_by_key(table: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``table`` whose key is not in ``deletes`` (a delete log);
    unknown keys delete nothing."""
    return table.join(deletes.select(F.col(key)).distinct(), key, "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
