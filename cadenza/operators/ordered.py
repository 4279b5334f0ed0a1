"""Positions and runs within a key, safe when one key holds a large share of
the rows: a segmented prefix scan in DataFrame functions.

A window ``partitionBy(key).orderBy(...)`` puts every row of a key into one
task. Here instead:

1. ``repartitionByRange(key, order...)`` cuts the rows into contiguous
   pieces; the bounds are sampled on the composite (key, order), so a hot key
   is cut into *chunks* over several pieces;
2. windows over (piece, key) number each chunk by itself: position, run
   number (a run = consecutive equal ``value``), position in the run. The
   result is written once, as the next step reads it again;
3. only keys that cross a border between pieces have more than one chunk, and
   such a key is the first or the last of a piece. The chunks at the pieces'
   ends, at most two per piece, give by windows in piece order what the rows of
   a later chunk have to add;
4. these few offsets are joined back on (piece, key); all other rows keep
   their numbers.

Output columns: ``pos`` (1-based in key), and with ``value``: ``run_no`` and
``pos_in_run``. The first row of a key starts a run; a row starts a new run
when its value differs from the previous row's (null-safe).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _number_chunks(ranged: DataFrame, key: str, order: Sequence[Column], value: str | None) -> DataFrame:
    """Local numbers of every row within its (piece, key); ``_end`` marks a chunk's last row."""
    w = Window.partitionBy("_piece", key).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = ranged.select("*", F.row_number().over(w).cast("bigint").alias("_lpos"), F.lead(F.lit(1)).over(w).isNull().alias("_end"),
                        *([F.lag(value).over(w).alias("_prev"), F.first(value).over(so_far).alias("_first")] if value else []))
    if not value:
        return out
    starts = (F.col("_lpos") == 1) | ~F.col("_prev").eqNullSafe(F.col(value))
    out = out.withColumn("_start", F.when(starts, F.col("_lpos")))
    return out.select("*", F.count("_start").over(so_far).alias("_lrun"),
                      (F.col("_lpos") - F.max("_start").over(so_far) + 1).alias("_lrpos")).drop("_prev", "_start")


def _border_offsets(local: DataFrame, key: str, value: str | None) -> DataFrame:
    """``(_at, _k, _pos_off, _run_off, _carry)`` for the chunks of keys that cross a border."""
    runs = [F.col("_lrun").alias("runs"), F.col("_first").alias("first_v"), F.col(value).alias("last_v"), F.col("_lrpos").alias("tail")] if value else []
    chunks = local.where("_end").select(F.col("_piece").alias("_at"), F.col(key).alias("_k"), F.col("_lpos").alias("n"), *runs)
    # nulls sort first; the struct's first field keeps null keys comparable
    ranked = F.struct(F.col("_k").isNotNull().alias("some"), F.col("_k").alias("k"))
    ends = chunks.groupBy(F.col("_at").alias("_p")).agg(F.min(ranked).alias("lo"), F.max(ranked).alias("hi"))
    ends = ends.select("_p", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("e")).select("_p", F.col("e.k").alias("_ek"))
    edge = chunks.join(ends, (F.col("_at") == F.col("_p")) & F.col("_k").eqNullSafe(F.col("_ek"))).drop("_p", "_ek")
    w = Window.partitionBy("_k").orderBy("_at")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pos_off = F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_pos_off")
    if not value:
        return edge.select("_at", "_k", pos_off).where("_pos_off > 0")
    goes_on = F.lag(F.lit(True), 1, False).over(w) & F.lag("last_v").over(w).eqNullSafe(F.col("first_v"))
    e = edge.select("*", pos_off, goes_on.alias("on"))
    # a chunk that is wholly part of the run before passes the run's length on
    e = e.select("*", F.sum(F.when((F.col("runs") == 1) & F.col("on"), F.lit(0)).otherwise(F.lit(1))).over(so_far).alias("stretch"))
    run = Window.partitionBy("_k", "stretch").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = e.select("*", F.sum("tail").over(run).alias("length"))
    return e.select("_at", "_k", "_pos_off",
                    (F.coalesce(F.sum("runs").over(before), F.lit(0)) - F.sum(F.col("on").cast("bigint")).over(so_far)).alias("_run_off"),
                    F.when(F.col("on"), F.lag("length").over(w)).otherwise(F.lit(0)).alias("_carry")).where("_pos_off > 0")


def ordered_positions(df: DataFrame, key: str, order: Sequence[Column], value: str | None = None,
                      partitions: int | None = None) -> DataFrame:
    """``df`` plus ``pos`` (and ``run_no``, ``pos_in_run`` when ``value`` is
    given). ``order`` must be total within a key (end with a unique id). One
    plan at every size: no key, however large, is held by one task. ``df`` is
    read twice (the range bounds are sampled first): give a stored table where
    it is costly to compute."""
    sort = [F.col(key).asc_nulls_first(), *order]
    ranged = df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)
    local = cut_lineage(_number_chunks(ranged.withColumn("_piece", F.spark_partition_id()), key, order, value), "numbered")
    offs = _border_offsets(local, key, value)
    j = local.join(offs, (local["_piece"] == offs["_at"]) & local[key].eqNullSafe(offs["_k"]), "left")
    off = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    cols = [local[c] for c in df.columns] + [(F.col("_lpos") + off("_pos_off")).alias("pos")]
    if value:
        cols += [(F.col("_lrun") + off("_run_off")).alias("run_no"),
                 (F.col("_lrpos") + F.when(F.col("_lrun") == 1, off("_carry")).otherwise(F.lit(0))).alias("pos_in_run")]
    return j.select(*cols)
