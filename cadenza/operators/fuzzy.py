"""Trigram fuzzy search for many queries at once, as a prefix-filtered similarity join.

Every set of trigrams is put into one global order, the rarest of the catalogue first. Two sets of sizes m and n whose
similarity exceeds t share more than t(m+n)/(1+t) trigrams, so each of them has a shared one among the first
m - floor(tm) of its own: only these *prefixes* are indexed and joined, never the most frequent trigrams of a string.

1. distinct query strings get their trigrams in that order (pure expressions);
2. prefixes meet on the trigram, with the bounds that sizes and the two positions put on the overlap;
3. the distinct string pairs that are left are confirmed on the whole sets;
4. ranking knows strings only: the best strings per query and field, then the distinct field combinations they stand
   in, and the first ids of the combinations that can still be among the results. No row id enters before that.

Exact: no bound drops a pair above the strict threshold. A row hit on several fields has the greatest similarity; a field
that misses is below the hit, so this equals ``GREATEST`` over all fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.trigram import similarity_from_counts, trigram_set
from ..session import scratch_path
from .sessions import valid_requests

DEFAULT_THRESHOLD = 0.25
DEFAULT_LIMIT = 5


def _parts(threshold: float) -> tuple[int, int]:
    """The threshold as a fraction, so that bounds are exact in integers."""
    f = Fraction(str(float(threshold)))
    if not 0 <= f < 1:
        raise ValueError("the threshold must be in [0, 1)")
    return f.numerator, f.denominator


def prefix_size(n: Column, threshold: float) -> Column:
    """How many of a set's first trigrams a partner above the threshold must share one of."""
    p, q = _parts(threshold)
    return (n - F.floor(n * p / q)).cast("int")


def _long(catalogue: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``(field, s)``: the distinct strings of every field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("s")) for f in fields])
    return catalogue.select(F.explode(pairs).alias("x")).select("x.field", "x.s").where("s IS NOT NULL").distinct()


def _in_rarity_order(strings: DataFrame, keys: Sequence[str], frequency: DataFrame) -> DataFrame:
    """``strings(keys, tri)`` with ``tri`` sorted by (strings of the catalogue that hold it, trigram)."""
    each = strings.select(*keys, F.explode("tri").alias("t")).join(frequency, "t", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "t")))
    return each.groupBy(*keys).agg(order.alias("o")).select(*keys, F.transform("o", lambda x: x["t"]).alias("tri"))


class TrigramIndex:
    """The stored form of a trigram index over text columns, built once and read by searches:

    * ``strings``: the distinct strings ``(field, s, n, tri)``, trigrams rarest first;
    * ``prefixes``: ``(t, field, s, n, j)``, the trigrams at place j of the prefix at ``threshold`` (searches at it or above);
    * ``frequency``: ``(t, df)``;
    * ``rows``: the catalogue's ``(id, fields...)``; ``combos``: the distinct field combinations.
    """

    def __init__(self, spark, path: str):
        self.path = path
        self.strings, self.prefixes, self.frequency, self.rows, self.combos = (
            spark.read.parquet(f"{path}/{t}") for t in ("strings", "prefixes", "frequency", "rows", "combos"))
        self.fields = self.combos.columns
        self.threshold = float(spark.read.parquet(f"{path}/threshold").first()["threshold"])

    @property
    def postings(self) -> DataFrame:
        """All postings of the distinct strings ``(field, s, n, trigram)``."""
        return self.strings.select("field", "s", "n", F.explode("tri").alias("trigram"))

    @staticmethod
    def build(catalogue: DataFrame, path: str, fields: Sequence[str] = ("name", "artist"), id_col: str = "id",
              threshold: float = DEFAULT_THRESHOLD) -> "TrigramIndex":
        spark = catalogue.sparkSession

        def stored(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            return spark.read.parquet(f"{path}/{name}")

        rows = stored(catalogue.select(F.col(id_col).alias("id"), *[F.col(f).cast("string").alias(f) for f in fields]), "rows")
        stored(rows.select(*fields).distinct(), "combos")
        sets = stored(_long(rows, fields).select("field", "s", trigram_set(F.col("s")).alias("tri")).where(F.size("tri") > 0), "sets")
        frequency = stored(sets.select(F.explode("tri").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df")), "frequency")
        strings = stored(_in_rarity_order(sets, ["field", "s"], frequency).select("field", "s", F.size("tri").alias("n"), "tri"), "strings")
        stored(strings.select("field", "s", "n", F.posexplode(F.slice("tri", F.lit(1), prefix_size(F.col("n"), threshold))).alias("j", "t"))
               .select("t", "field", "s", "n", (F.col("j") + 1).alias("j")), "prefixes")
        stored(spark.range(1).select(F.lit(float(threshold)).alias("threshold")), "threshold")
        return TrigramIndex(spark, path)


def _index(catalogue: DataFrame, fields: Sequence[str], id_col: str, threshold: float, index: TrigramIndex | None) -> TrigramIndex:
    if index is None:
        return TrigramIndex.build(catalogue, scratch_path(catalogue.sparkSession, "trigram-index"), fields, id_col, threshold)
    if index.threshold > threshold:
        raise ValueError(f"the index serves thresholds from {index.threshold} on")
    return index


def string_hits(queries: DataFrame, index: TrigramIndex, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """``(q, field, s, sim)``: the index's strings whose similarity to a text of ``queries(q)`` (distinct) exceeds the threshold."""
    p, q = _parts(threshold)
    sets = queries.select("q", trigram_set(F.col("q")).alias("tri")).where(F.size("tri") > 0)
    asked = _in_rarity_order(sets, ["q"], index.frequency).select("q", F.size("tri").alias("m"), "tri")
    first = asked.select("q", "m", F.posexplode(F.slice("tri", F.lit(1), prefix_size(F.col("m"), threshold))).alias("i", "t"))
    first = first.select("q", "m", "t", (F.col("i") + 1).alias("i"))
    at_least = F.floor((F.col("m") + F.col("n")) * p / (p + q)) + 1
    at_most = F.least("i", "j") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j"))
    met = first.join(index.prefixes, "t").where((F.least("m", "n") >= at_least) & (at_most >= at_least))
    pairs = met.select("q", "field", "s").distinct()
    whole = (pairs.join(asked.select("q", "m", F.col("tri").alias("qt")), "q")
             .join(index.strings.select("field", "s", "n", F.col("tri").alias("st")), ["field", "s"]))
    shared = F.size(F.array_intersect("qt", "st"))
    return (whole.select("q", "field", "s", similarity_from_counts(shared, F.col("m"), F.col("n")).alias("sim"))
            .where(F.col("sim") > F.lit(float(threshold))))


def _combo_hits(hits: DataFrame, index: TrigramIndex) -> DataFrame:
    """``(q, fields..., score)``: the distinct field combinations that the hit strings stand in."""
    found = None
    for f in index.fields:
        on = hits.where(F.col("field") == f).select("q", F.col("s").alias("_s"), "sim")
        part = on.join(index.combos, F.col("_s") == F.col(f)).select("q", *index.fields, "sim")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("q", *index.fields).agg(F.max("sim").alias("score"))


def _with_ids(combos: DataFrame, rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The rows of field combinations; their fields may be null."""
    named = rows.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    same = None
    for f in fields:
        on = F.col(f).eqNullSafe(F.col(f"_{f}"))
        same = on if same is None else same & on
    return combos.join(named, same).drop(*[f"_{f}" for f in fields])


def fuzzy_join(queries: DataFrame, catalogue: DataFrame, threshold: float = DEFAULT_THRESHOLD,
               fields: Sequence[str] = ("name", "artist"), id_col: str = "id",
               q_col: str = "q", index: TrigramIndex | None = None) -> DataFrame:
    """All catalogue rows with ``sim(field, q) > t`` for any field, per
    distinct query text: ``(q, id, score)``, score = greatest similarity.
    With a stored ``index`` the catalogue side is read, not re-derived."""
    index = _index(catalogue, fields, id_col, threshold, index)
    hits = string_hits(queries.select(F.col(q_col).alias("q")).distinct(), index, threshold)
    return _with_ids(_combo_hits(hits, index), index.rows, index.fields).select("q", "id", "score")


def fuzzy_top(queries: DataFrame, catalogue: DataFrame, limit: int = DEFAULT_LIMIT, order: str = "desc",
              threshold: float = DEFAULT_THRESHOLD, fields: Sequence[str] = ("name", "artist"), id_col: str = "id",
              q_col: str = "q", index: TrigramIndex | None = None) -> DataFrame:
    """``(q, rank, id, fields..., score)``: the first ``limit`` hits of every distinct text, by score then id.

    Each distinct string and combination has a row of its own, so one with ``limit`` better ones before it cannot
    be among the results: strings (closest first only, as a weak string may stand beside a strong one), then combinations,
    then at most ``limit`` ids of each are kept. Filtered ranks plan as ``WindowGroupLimit``: every task keeps its own
    first rows before the shuffle, so neither a hot query nor a hot string piles up."""
    index = _index(catalogue, fields, id_col, threshold, index)
    hits = string_hits(queries.select(F.col(q_col).alias("q")).distinct(), index, threshold)
    if order == "desc":
        best = Window.partitionBy("q", "field").orderBy(F.col("sim").desc())
        hits = hits.withColumn("_r", F.rank().over(best)).where(F.col("_r") <= limit).drop("_r")
    by_score = F.col("score").desc() if order == "desc" else F.col("score").asc()
    combos = (_combo_hits(hits, index).withColumn("_r", F.rank().over(Window.partitionBy("q").orderBy(by_score)))
              .where(F.col("_r") <= limit).drop("_r"))
    of_combo = Window.partitionBy(*index.fields).orderBy(F.col("id").asc())
    heads = index.rows.withColumn("_r", F.row_number().over(of_combo)).where(F.col("_r") <= limit).drop("_r")
    w = Window.partitionBy("q").orderBy(by_score, F.col("id").asc())
    return (_with_ids(combos, heads, index.fields).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("q", F.col("rank").cast("bigint").alias("rank"), "id", *index.fields, "score"))


def fuzzy_search(queries: DataFrame, catalogue: DataFrame, limit: int = DEFAULT_LIMIT,
                 order: str = "desc", threshold: float = DEFAULT_THRESHOLD,
                 fields: Sequence[str] = ("name", "artist"), id_col: str = "id",
                 qid_col: str = "qid", q_col: str = "q", index: TrigramIndex | None = None) -> DataFrame:
    """Top ``limit`` hits per request, ranked by score then id.

    ``order="desc"`` gives the closest first (the stated intent);
    ``order="asc"`` reproduces the application's SQL, which sorts ascending
    and so returns the weakest hits above the threshold. Ranking happens once
    per distinct query text; requests then pick up their (at most ``limit``)
    rows by an equi join on the text.
    """
    top = fuzzy_top(queries, catalogue, limit, order, threshold, fields, id_col, q_col, index)
    req = queries.select(F.col(qid_col).alias("qid"), F.col(q_col).alias("q"))
    return req.join(top, "q").select("qid", "rank", "id", *fields, "score")


def search_replies(queries: DataFrame, results: DataFrame, qid_col: str = "qid", q_col: str = "q") -> DataFrame:
    """First reply per query, the 'not in our database' reply when the query
    has no hit (left join + coalesce), or the error for a missing query."""
    first = results.filter(F.col("rank") == 1).select(
        "qid", T.search_item(F.col("name"), F.col("artist")).alias("hit"))
    checked = valid_requests(queries.select(F.col(qid_col).alias("qid"), F.col(q_col).alias("query")))
    return checked.join(first, "qid", "left").select(
        "qid", F.coalesce("error", "hit", F.lit(T.SEARCH_NONE)).alias("reply"))
