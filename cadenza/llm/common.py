"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import gc
import string
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, files_for, read_table

__all__ = ["cut_lineage", "files_for", "read_table", "release", "forget", "ascii_lower", "arrow_rows", "map_rows", "min_label_components"]

#: Rows that a Python task turns into objects at a time.
SLICE_ROWS = 512
#: Edges that are worth a file of their own.
EDGES_PER_FILE = 100_000


def release(spark: SparkSession) -> None:
    """Ask the driver to collect its garbage, after which Spark removes the shuffle
    files of finished steps whose results were already written as tables."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forget(*tables: DataFrame) -> None:
    """Delete scratch tables made by ``cut_lineage`` that no later step reads."""
    for t in tables:
        jvm, conf = t.sparkSession.sparkContext._jvm, t.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("cadenza-"):
                path.getFileSystem(conf).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (``lower`` would fold other letters too)."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def arrow_rows(batches: Iterable[pa.RecordBatch], slice_rows: int = SLICE_ROWS) -> Iterator[list[dict]]:
    """The rows of Arrow batches as lists of dicts, at most ``slice_rows`` in memory at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, slice_rows):
            yield batch.slice(at, slice_rows).to_pylist()


def map_rows(df: DataFrame, schema: pa.Schema, ddl: str, make: Callable[[], Callable[[list[dict]], Iterable[tuple]]],
             slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``mapInArrow`` with row lists: ``make()`` runs once in each task and returns a function from a
    list of rows to output tuples."""
    names = schema.names

    def run(batches):
        f = make()
        for rows in arrow_rows(batches, slice_rows):
            out = list(f(rows))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], names=names)

    return df.mapInArrow(run, ddl)


def min_label_components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, component = smallest node reachable.

    Alternates large-star and small-star rounds (each node links its larger, then its smaller
    neighbours to the smallest one), which keep the components and shrink the longest path
    geometrically; ends when a round changes no edge. Every round is one written table, in few files where
    there are few edges. ``edges`` is a written table: it is read twice.
    A node with very many neighbours stays cheap: only its minimum is aggregated, map-side first.
    """
    files = files_for(edges.sparkSession, edges.count(), EDGES_PER_FILE)
    cur = cut_lineage(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
                      .where("hi <> lo").distinct(), "cc", files)
    before = None
    while True:
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi")
        nxt = (small.select("hi", F.col("m").alias("lo"))
               .unionByName(small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
               .distinct())
        cur = cut_lineage(nxt, "cc", files)
        sums = cur.agg(F.count(F.lit(1)), F.sum(F.col("hi").cast("decimal(38,0)")),
                       F.sum(F.col("lo").cast("decimal(38,0)")),
                       F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if before == sums:
            break
        before = sums
    tree = cur.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component")
    roots = cur.select(F.col("lo").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return (tree.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")))
