"""Ingest of a tree of nested JSON records into the flat, keyed catalogue.

* Scan: every file below ``root`` whose name ends in ``json`` or ``json.gz`` (nested
  folders included), read with an explicit schema (no inference pass), ``PERMISSIVE``
  mode with a corrupt-record column, so a broken file becomes a reject instead
  of failing the job.
* Extract: fixed paths into the nested structs; first array elements with
  ``get`` (null when empty, where ``arr[0]`` would raise under ANSI).
* Validate: each row gets a ``reason``; ``null`` means good. JSON nulls count
  as missing, a non-numeric year is a reject (never an abort).
* Dedup: one row per id, the first by a total order (partial aggregate).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_of, year_prefix
from ..operators.quality import dedup_first
from ..session import cut_lineage
from . import tables

CORRUPT = "_corrupt_record"
#: JSON files by name, plain or compressed.
PATTERN = "{*json,*json.gz}"

# The score paths of a record, as (output column, model, key).
SCORE_PATHS = [
    ("dance", "danceability", "danceable"),
    ("acoustic", "mood_acoustic", "acoustic"),
    ("aggressive", "mood_aggressive", "aggressive"),
    ("electronic", "mood_electronic", "electronic"),
    ("happy", "mood_happy", "happy"),
    ("party", "mood_party", "party"),
    ("relaxed", "mood_relaxed", "relaxed"),
    ("sad", "mood_sad", "sad"),
    ("timbre", "timbre", "bright"),
    ("tonal", "tonal_atonal", "tonal"),
    ("voice", "voice_instrumental", "voice"),
]
# Category paths: (output column, model); the value sits in ``.value``.
CATEGORY_PATHS = [("gender", "gender"), ("genre", "genre_tzanetakis"), ("mirex", "moods_mirex")]
TAGS = ["musicbrainz_recordingid", "title", "artist", "date"]

CATALOGUE_ORDER = ["id", "name", "artist", "year", "dance", "gender", "genre", "acoustic",
                   "aggressive", "electronic", "happy", "party", "relaxed", "sad", "mirex",
                   "timbre", "tonal", "voice"]
REQUIRED = [c for c in CATALOGUE_ORDER if c != "year"] + ["date"]

REASON_CORRUPT = "corrupt"
REASON_MISSING = "missing field"
REASON_YEAR = "year"


def record_schema() -> T.StructType:
    """Schema of one raw record (only the paths used)."""
    def score(key: str) -> T.StructType:
        return T.StructType([T.StructField("all", T.StructType([T.StructField(key, T.DoubleType())]))])

    value = T.StructType([T.StructField("value", T.StringType())])
    models = {m: score(k) for _, m, k in SCORE_PATHS}
    models.update({m: value for _, m in CATEGORY_PATHS})
    tags = T.StructType([T.StructField(t, T.ArrayType(T.StringType())) for t in TAGS])
    return T.StructType([
        T.StructField("metadata", T.StructType([T.StructField("tags", tags)])),
        T.StructField("highlevel", T.StructType([T.StructField(m, s) for m, s in models.items()])),
        T.StructField(CORRUPT, T.StringType()),
    ])


def scan(spark: SparkSession, root: str, multi_line: bool = True, pattern: str = PATTERN) -> DataFrame:
    """Raw records below ``root`` (recursive, names that match ``pattern``), with
    the source file path. ``multi_line``: one document per file; a task takes as many small
    files as fit its share of bytes, and a file that is no document is one reject."""
    df = (spark.read.schema(record_schema())
          .option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern)
          .option("multiLine", multi_line)
          .option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT)
          .json(root))
    return df.withColumn("_file", F.col("_metadata.file_path"))


def flatten(raw: DataFrame) -> DataFrame:
    """Fixed column list from the nested record, plus ``date`` and ``reason``."""
    tag = lambda t: first_of(F.col(f"metadata.tags.{t}"))
    cols: dict[str, Column] = {
        "id": tag("musicbrainz_recordingid"),
        "name": tag("title"),
        "artist": tag("artist"),
        "date": tag("date"),
    }
    cols["year"] = year_prefix(cols["date"])
    for out, model, key in SCORE_PATHS:
        cols[out] = F.col(f"highlevel.{model}.all.{key}").cast("double")
    for out, model in CATEGORY_PATHS:
        cols[out] = F.col(f"highlevel.{model}.value").cast("string")
    missing = None
    for c in REQUIRED:
        m = cols[c].isNull()
        missing = m if missing is None else (missing | m)
    reason = (F.when(F.col(CORRUPT).isNotNull(), F.lit(REASON_CORRUPT))
              .when(missing, F.lit(REASON_MISSING))
              .when(cols["year"].isNull(), F.lit(REASON_YEAR)))
    return raw.select(*[cols[c].alias(c) for c in CATALOGUE_ORDER], cols["date"].alias("date"),
                      "_file", reason.alias("reason"))


def split_good(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``reason``, rejects ``(_file, id, reason)``)."""
    good = flat.filter(F.col("reason").isNull()).drop("reason")
    rejects = flat.filter(F.col("reason").isNotNull()).select("_file", "id", "reason")
    return good, rejects


def ingest(spark: SparkSession, root: str, multi_line: bool = True,
           dedup_order: Sequence[str] = ("_file",), pattern: str = PATTERN) -> tuple[DataFrame, DataFrame]:
    """``(catalogue, rejects)``: one row per id, first by ``dedup_order``
    (source path by default, then the record content). The tree is read once: its rows are written with their reasons."""
    flat = cut_lineage(flatten(scan(spark, root, multi_line, pattern)), "flat")
    good, rejects = split_good(flat)
    kept = dedup_first(good.drop("date"), "id", list(dedup_order))
    return kept.select(*CATALOGUE_ORDER, *[c for c in kept.columns if c not in CATALOGUE_ORDER]), rejects


def load(spark: SparkSession, root: str, path: str, multi_line: bool = True, dedup_order: Sequence[str] = ("_file",),
         pattern: str = PATTERN) -> dict[str, int]:
    """Ingest the tree into the keyed table at ``path`` (``sources.tables``) and its rejects into ``<path>/rejects``.

    The tree is read once: its rows are written with their reasons, and read and rejected rows are counted in that pass,
    kept ones while the table is written. The table is named only when its key holds. Returns the counts."""
    flat, seen = tables.counted(flatten(scan(spark, root, multi_line, pattern)), read=F.count(F.lit(1)), rejected=F.count("reason"))
    good, rejects = split_good(cut_lineage(flat, "flat"))
    kept = tables.load_keyed(dedup_first(good.drop("date"), "id", list(dedup_order)).select(*CATALOGUE_ORDER), path, "id")
    rejects.write.mode("overwrite").parquet(f"{path}/rejects")
    n = seen.get
    return {"read": n["read"], "kept": kept, "rejected": n["rejected"], "duplicate": n["read"] - n["rejected"] - kept}


def to_records(flat: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """The inverse shape: flat columns (``title`` is an array, possibly
    empty) to nested records, for writing a JSON tree; ``extra`` columns are
    passed through (e.g. to partition the written tree by)."""
    def score(out: str, key: str) -> Column:
        return F.struct(F.struct(F.col(out).alias(key)).alias("all"))

    hl = F.struct(*[score(out, key).alias(model) for out, model, key in SCORE_PATHS],
                  *[F.struct(F.col(out).alias("value")).alias(model) for out, model in CATEGORY_PATHS])
    tags = F.struct(F.array(F.col("id")).alias("musicbrainz_recordingid"),
                    F.col("title").alias("title"),
                    F.array(F.col("artist")).alias("artist"),
                    F.array(F.col("date")).alias("date"))
    return flat.select(F.struct(tags.alias("tags")).alias("metadata"), hl.alias("highlevel"), *extra)
