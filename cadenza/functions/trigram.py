"""Trigram sets and similarity with the rules of PostgreSQL's ``pg_trgm``.

A string is lower-cased and split into words of letters and digits; each word
is padded with two spaces in front and one behind, every 3-character window is
a trigram, and the set is made distinct. Similarity is shared / union of the
two sets, 0 when either set is empty. Everything is a Catalyst expression
(higher-order functions), so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[^\p{L}\p{N}]+"


def words(s: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(s, F.lit(""))), WORD_SPLIT)
    return F.filter(parts, lambda w: w != F.lit(""))


def trigram_set(s: Column) -> Column:
    """``array<string>`` of the distinct trigrams of ``s`` (empty for null)."""
    def word_trigrams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.char_length(w) + 1),
                           lambda i: F.substring(padded, i, 3))
    # a word that repeats adds no trigram
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(words(s)), word_trigrams)))


def set_similarity(a: Column, b: Column) -> Column:
    """Similarity of two trigram sets (arrays)."""
    shared = F.size(F.array_intersect(a, b))
    na, nb = F.size(a), F.size(b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / (na + nb - shared).cast("double"))


def similarity(a: Column, b: Column) -> Column:
    """Similarity of two texts. The sets and their sizes are bound as lambda variables, so that each is computed once."""
    sets = F.array(F.struct(trigram_set(a).alias("x"), trigram_set(b).alias("y")))
    sizes = F.transform(sets, lambda s: F.struct(F.size(s["x"]).alias("m"), F.size(s["y"]).alias("n"),
                                                 F.size(F.array_intersect(s["x"], s["y"])).alias("both")))
    return F.element_at(F.transform(sizes, lambda c: similarity_from_counts(c["both"], c["m"], c["n"])), 1)


def similarity_from_counts(shared: Column, na: Column, nb: Column) -> Column:
    """Similarity when only set sizes and the overlap count are known."""
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(
        shared.cast("double") / (na + nb - shared).cast("double"))


SHOW_TRGM_DDL = r"""
CREATE OR REPLACE TEMPORARY FUNCTION show_trgm(s STRING) RETURNS ARRAY<STRING>
RETURN array_distinct(flatten(transform(
  filter(split(lower(coalesce(s, '')), '[^\\p{L}\\p{N}]+'), w -> w <> ''),
  w -> transform(sequence(1, char_length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))
"""

# the sets and their overlap are bound as lambda variables, so that each is computed once
SIMILARITY_DDL = r"""
CREATE OR REPLACE TEMPORARY FUNCTION similarity(a STRING, b STRING) RETURNS DOUBLE
RETURN element_at(transform(
  transform(array(struct(show_trgm(a) AS x, show_trgm(b) AS y)),
            s -> struct(size(s.x) AS m, size(s.y) AS n, size(array_intersect(s.x, s.y)) AS both)),
  c -> CASE WHEN c.m = 0 OR c.n = 0 THEN 0D ELSE c.both / (c.m + c.n - c.both) END), 1)
"""


def register_sql_functions(spark: SparkSession) -> None:
    """``show_trgm(s)`` and ``similarity(a, b)`` as SQL functions.

    SQL UDFs are inlined by the analyzer, so they stay JVM-side.
    """
    spark.sql(SHOW_TRGM_DDL)
    spark.sql(SIMILARITY_DDL)


# DuckDB forms for oracle SQL: same rules.
def duck_trigram_set(expr: str) -> str:
    return (
        "list_distinct(flatten(list_transform("
        f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), "
        "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def duck_similarity(a: str, b: str) -> str:
    ta, tb = duck_trigram_set(a), duck_trigram_set(b)
    return (
        f"(CASE WHEN len({ta}) = 0 OR len({tb}) = 0 THEN 0.0::DOUBLE ELSE "
        f"len(list_intersect({ta}, {tb}))::DOUBLE / "
        f"(len({ta}) + len({tb}) - len(list_intersect({ta}, {tb})))::DOUBLE END)"
    )
