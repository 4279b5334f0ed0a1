"""Mixing sources to target weights by systematic sampling.

Every document of a source expects ``target / source size`` copies. The
expected copies are prefix-summed within the source, one random offset is added
and a copy is emitted for each integer boundary crossed. DataFrame functions
only.

The prefix sum is two-level so that no source, however large, meets in one
task: documents are dealt to chunks (leading bits of the size, then a hash
slice), numbered inside their chunk, and the chunk counts (a bounded number of
rows per source) are summed before. Sorting by size first makes the draw
stratified: the words taken stay near the target even if a few documents are
very long.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Hash slices of each size class; with 4 classes per power of two a source has at most 4 * 64 * SLICES chunks.
SLICES = 256
#: A source may be repeated up to this many times.
MAX_REPEAT = 3


def word_count(col):
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null counts 0."""
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int) -> DataFrame:
    """``(source, source_size, n_docs, target)``: all words shared by weight, a target stopping at
    ``max_repeat`` times its source, the excess reshared until none is above.

    Resharing ends at ``min(max_repeat * size, level * weight)`` for one common level: sources are put in
    the order in which they reach their limit, and the level is read off the running sums. One row per
    source is ranked here, a table as long as the list of weights a user would write.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    k = len(weights)
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(by_code_point) - 1) % k + 1).cast("int"))
    per = per.withColumn("weight", w).withColumn("cap", F.col("source_size") * max_repeat)
    everything = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
           .withColumn("all_w", F.sum("weight").over(everything))
           .withColumn("cap_before", (F.sum("cap").over(upto) - F.col("cap")).cast("double"))
           .withColumn("w_before", F.sum("weight").over(upto) - F.col("weight"))
           .withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("all_w") - F.col("w_before")))
           .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap")))
    # the first source whose limit is not reached sets the level for itself and all after it
    per = per.withColumn("final", F.min(F.when(F.col("open"), F.struct(
        F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everything))
    level = F.col("final")["level"]
    return per.select("source", "source_size", "n_docs",
                      F.round(F.least(F.col("cap").cast("double"), F.col("weight") * F.coalesce(level, F.lit(0.0))), 6)
                      .alias("target"))


def random_offset(source, seed: int):
    """The source's offset in [0, 1): a function of the seed and the name, so that reruns agree."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _draw(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], max_repeat: int, seed: int,
          row_key: Sequence[str]) -> DataFrame:
    """``mix`` with the columns of ``row_key`` as ``_key0``, ``_key1`` and so on; they and a hash of the text settle ties of size and id."""
    tie = [F.xxhash64(F.col(text_col)).alias("_text_hash"), *[F.col(c).alias(f"_key{i}") for i, c in enumerate(row_key)]] if row_key else []
    ties = ["_text_hash", *[f"_key{i}" for i in range(len(row_key))]] if row_key else []
    base = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                       *tie)
    bits = F.bin("size")
    key = F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")))
    base = base.select(
        "_id", "source", "size", *ties, F.length(bits).alias("_len"), F.substring(bits, 1, 3).alias("_top"),
        F.conv(F.substring(key, 1, 8), 16, 10).cast("long").bitwiseAND(SLICES - 1).cast("int").alias("_slice"))
    base = cut_lineage(base, "mix-sizes")
    targets = source_targets(base, weights, max_repeat)
    chunk = ["source", "_len", "_top", "_slice"]
    counts = base.groupBy(*chunk).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("source").orderBy("_len", "_top", "_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*chunk, F.coalesce(F.sum("_n").over(order), F.lit(0)).alias("_start"))
    per_chunk = starts.alias("c").join(targets.alias("t"), F.expr("c.source <=> t.source")).select(
        *[F.col(f"c.{x}").alias(f"k{x}") for x in chunk], "_start", "source_size", "target")
    number = Window.partitionBy(*chunk).orderBy("size", "_id", *ties)
    rows = base.withColumn("_nth", F.row_number().over(number))
    rows = rows.join(per_chunk, F.expr("source <=> ksource and _len = k_len and _top = k_top and _slice = k_slice"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = random_offset(F.col("source"), seed)
    at = F.col("_start") + F.col("_nth")
    copies = (F.floor(u + share * at) - F.floor(u + share * (at - 1))).cast("long")
    rows = rows.withColumn("copies", F.greatest(F.least(copies, F.lit(max_repeat)), F.lit(0)))
    return rows.select("_id", *ties, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: Sequence[float] = (1, 2, 3), max_repeat: int = MAX_REPEAT, seed: int = 20) -> DataFrame:
    """One row per input row: ``(<id_col>, size, source_size, target, copies, taken)``.

    ``weights`` repeat over the sources in code-point order, the null source last. Null or empty texts have
    size 0: they are drawn like any other document but add no words. A source of size 0 has target 0 and no
    copies. Ties in size go by id (null first); rows that repeat an id are documents of their own. An empty table gives an
    empty result; other columns are not read.
    """
    drawn = _draw(docs, id_col, text_col, source_col, weights, max_repeat, seed, ())
    return drawn.withColumnRenamed("_id", id_col)


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         weights: Sequence[float] = (1, 2, 3), max_repeat: int = MAX_REPEAT, seed: int = 20, row_key: Sequence[str] = ()) -> DataFrame:
    """The mixed documents themselves, all columns of ``docs``, each as often as the mix takes it (a document
    not taken goes).

    ``row_key`` names columns of ``docs`` that together tell its rows apart; they stay in the result. Without it the rows
    are written once and told apart by their places in the files. So rows that repeat an id, or have none, are drawn one by one.
    """
    rows, key = docs, list(row_key)
    if not key:
        written = cut_lineage(docs, "mix-rows")
        rows = written.select("*", F.col("_metadata.file_path").alias("_mix_file"), F.col("_metadata.row_index").alias("_mix_at"))
        key = ["_mix_file", "_mix_at"]
    drawn = _draw(rows, id_col, text_col, source_col, weights, max_repeat, seed, key).where("copies > 0").select(
        *[f"_key{i}" for i in range(len(key))], F.col("copies").cast("int").alias("_mix_copies"))
    out = rows.join(drawn, [rows[k].eqNullSafe(drawn[f"_key{i}"]) for i, k in enumerate(key)])
    return out.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).drop("col")
