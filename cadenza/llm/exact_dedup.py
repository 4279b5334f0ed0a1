"""Exact dedup: group by a 128-bit content hash, compare the bytes inside a
group, keep one stable id per group of equal texts.

Ids and digests are written once and grouped without their texts: the key is
the 128-bit hash together with the SHA-256, so two texts that share the former
stay apart. Partial aggregation folds a hot group to one row per task before
the shuffle. Only texts whose hash repeats are read again and compared byte by
byte, by the least and the greatest of each group; where these differ the
dedup stops rather than drop a text. Verdicts go back to the rows by digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut_lineage


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: ``(<id_col>, keep_id, group_size, kept, text_sha256)``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` = ``min`` or
    ``max`` names the id that stays; ids are unique, so there are no ties.
    Null text counts as empty (and equals other empty texts). A null id can
    lose but not stay: it is kept only where a group has no other id. Rows that
    repeat an id and text are counted one by one and share the verdict. An
    empty table gives an empty result; columns other than the two named are
    not read, so their names cannot clash.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    texts = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_norm"))
    texts = texts.select("_id", "_norm", F.unhex(F.md5("_norm")).alias("_h128"))
    rows = cut_lineage(texts.select("_id", "_h128", F.unhex(F.sha2("_norm", 256)).alias("_sha")), "exact-digests")
    groups = cut_lineage(rows.groupBy("_h128", "_sha").agg(pick("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
                         "exact-groups")
    repeated = groups.where("group_size > 1").select(F.col("_h128").alias("_again")).distinct()
    compared = (texts.join(repeated, F.col("_h128") == F.col("_again"), "left_semi")
                .groupBy("_h128", F.sha2("_norm", 256).alias("_sha")).agg(F.min("_norm").alias("lo"), F.max("_norm").alias("hi")))
    if compared.where("lo <> hi").limit(1).count():
        raise ValueError("two different texts share a 128-bit hash and a SHA-256")
    back = rows.join(groups, ["_h128", "_sha"])
    return back.select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"))
