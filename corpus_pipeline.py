"""A training corpus from ``documents``: language ID, exact dedup, near dedup, mixing, BPE ids.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last
return the columns of ``docs``, whatever further columns there are. Rows that repeat a doc_id, or have none,
are documents of their own in exact dedup and in the mix, which tell rows apart by their places in the files; in
near dedup rows that repeat an id share its verdict and rows without one stay. An empty table goes through every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm import bpe_chunks, chosen_path, exact_dedup, mixing, rank_order_lang
from cadenza.llm.common import cut_lineage, read_table

#: No SQL: the first stage learns language profiles. tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


#: Columns that tell the rows of a stage's docs apart.
PLACE = ["_place_file", "_place_row"]


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the file and the position that each row is read from; what is no read of files is written first."""
    place = [F.col("_metadata.file_path").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1])]
    try:
        return docs.select("*", *place)
    except AnalysisException:
        return cut_lineage(docs, "pipeline-docs").select("*", *place)


def _keep(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id a verdict keeps; ``verdicts(doc_id, kept)``."""
    ids = verdicts.where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col("_kept_id")), "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that the classifier cannot place: null texts, texts without a letter, and texts at the largest distance
    from every profile. Where no profile can be learned (no ``lang``, all labelled rows held out) the text alone decides."""
    profiles = rank_order_lang.learn_profiles(docs.where(~rank_order_lang.held_out()))
    if not profiles:
        return docs.where(rank_order_lang.has_letter(F.col("text")))
    return docs.where(rank_order_lang.resembles(F.col("text"), profiles))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for the case of A-Z one row stays, the one with the largest doc_id (of several, the last by place)."""
    placed = _placed(docs)
    verdicts = exact_dedup.exact_dedup(placed.withColumn("_row", F.struct("doc_id", *PLACE)), "_row", keep="max")
    kept = verdicts.where("kept").select(*[F.col("_row")[c].alias(f"_kept{c}") for c in PLACE])
    same = [F.col(c) == F.col(f"_kept{c}") for c in PLACE]
    return placed.join(kept, same, "left_semi").drop(*PLACE)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies connect (five-word shingles, similarity 0.8) the one with the smallest doc_id stays."""
    return _keep(docs, chosen_path.near_dedup(docs, words=5, pct=80))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at weights 1, 2, 3 in turn: each document as often as the mix takes it."""
    return mixing.emit(_placed(docs), row_key=PLACE).drop(*PLACE)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)``: ids as little-endian unsigned 32-bit integers."""
    out = bpe_chunks.encode_documents(docs)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
