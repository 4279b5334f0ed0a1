"""Data-quality operators: keep-first dedup, key checks, null profile,
equal-width histograms, load yield and request validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one smallest in ``order`` (then in all other
    columns, so the choice is total and repeatable).

    Each task first keeps its own first row per key (the ``WindowGroupLimit`` that Spark puts before the shuffle),
    so a row crosses the network once and a hot key costs one row per task."""
    keys = [key] if isinstance(key, str) else list(key)
    full = [*order, *[c for c in df.columns if c not in keys and c not in order]]
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in full or keys])
    return df.withColumn("_dedup_rank", F.row_number().over(w)).where("_dedup_rank = 1").select(*df.columns)


def key_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that would break a primary key: null or repeated. ``(key, n)``."""
    return (df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") > 1) | F.col("key").isNull()))


def assert_key(df: DataFrame, key: str) -> DataFrame:
    """Fail like ``ADD PRIMARY KEY`` would, when the key is not unique/non-null."""
    bad = key_violations(df, key).limit(1).collect()  # at most one row to the driver
    if bad:
        raise ValueError(f"key {key!r} violated, e.g. {bad[0]['key']!r} x{bad[0]['n']}")
    return df


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Nulls per column in one pass: ``(column, n_null)``."""
    cols = list(columns or df.columns)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in cols])
    pairs = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, n_null)").select(
        "column", F.coalesce(F.col("n_null"), F.lit(0)).cast("bigint").alias("n_null"))


def equal_width_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin 1..bins of an equal-width histogram over [lo, hi]; the maximum goes
    to the last bin."""
    raw = F.floor((x - lo) / (hi - lo) * F.lit(float(bins))) + 1
    return F.least(raw, F.lit(bins)).cast("bigint")


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``(bin, lo, hi, n)``: counts per equal-width bin, empty bins included; nulls count nowhere.

    One value only: the range reaches half a unit to each side. No value: null
    borders and zero counts. The range is one scalar subquery; the count is a
    partial aggregate per bin."""
    x = F.col(col).cast("double")
    flat = F.when(F.min(x) == F.max(x), F.lit(0.5)).otherwise(F.lit(0.0))
    rng = df.agg(F.struct((F.min(x) - flat).alias("lo"), (F.max(x) + flat).alias("hi")).alias("r")).scalar()
    lo, hi = rng["lo"], rng["hi"]
    counts = (df.where(F.col(col).isNotNull()).select(equal_width_bin(x, lo, hi, bins).alias("bin"))
              .groupBy("bin").agg(F.count(F.lit(1)).alias("_n")))
    width = (hi - lo) / F.lit(float(bins))
    each = df.sparkSession.range(1, bins + 1).select(F.col("id").alias("bin")).join(counts, "bin", "left")
    return each.select("bin", (lo + (F.col("bin") - 1) * width).alias("lo"), (lo + F.col("bin") * width).alias("hi"),
                       F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"))


def missing_text(c: Column) -> Column:
    return c.isNull() | (c == F.lit(""))
