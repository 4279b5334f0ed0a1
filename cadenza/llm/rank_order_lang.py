"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (1 to
3) in rank order. A document is compared to each profile by the out-of-place
distance: for each of the document's own most frequent n-grams, how far its
rank lies from the profile's, the full profile length where it is missing.

Learning counts n-grams on a bounded sample per language (``FIT_DOCS``), the
rows with the smallest hash of their id (a bounded list of ids is broadcast to
the scan that reads their texts). Prediction reads every whole text, in
place, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Length of a profile and of a document's own list.
PROFILE = 400
#: Labelled documents per language the profiles are learned from.
FIT_DOCS = 1000
UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """True at the code points that are letters."""
    global _LETTER
    if _LETTER is None:
        import unicodedata

        _LETTER = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the 1- to 3-grams over lower-cased letters, every run of other characters one space.
    A code packs the code points, 21 bits each. Grams that start or end inside no word (spaces alone) do not count."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[cp]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cp = np.where(is_letter, cp, 32).astype(np.int64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    cp = np.concatenate(([32], cp[keep], [32]))
    one = cp[cp != 32]
    two = (cp[:-1] << 21) | cp[1:]
    three = (cp[:-2] << 42) | (cp[1:-1] << 21) | cp[2:]
    three = three[cp[1:-1] != 32]
    return np.unique(np.concatenate((one, two, three)), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int = PROFILE) -> np.ndarray:
    """The ``length`` most frequent codes, most frequent first, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:length]]


def learn_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   fit_docs: int = FIT_DOCS, length: int = PROFILE) -> dict[str, list[int]]:
    """``{language: n-gram codes in rank order}`` from ``labelled``; rows without a language are not used.

    Per language the ``fit_docs`` documents with the smallest hash of their id count (ties by id). The result is
    bounded by languages x ``length`` numbers. No rows, no profiles.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"), F.xxhash64(id_col).alias("_h"), F.col(id_col).alias("_id"))
    # ranked without the texts; the chosen ids, at most fit_docs per language, then pick their texts in the scan
    pick = Window.partitionBy("_lang").orderBy("_h", "_id")
    chosen = (rows.select("_lang", "_h", "_id").withColumn("_rank", F.row_number().over(pick)).where(F.col("_rank") <= fit_docs)
              .select(F.col("_lang").alias("_l"), F.col("_id").alias("_i")).distinct())
    sample = rows.join(F.broadcast(chosen), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_lang") == F.col("_l")), "left_semi")
    sample = sample.repartition(2 * sample.sparkSession.sparkContext.defaultParallelism, "_h")

    def make():
        def count(batch):
            by: dict[str, list] = {}
            for r in batch:
                by.setdefault(r["_lang"], []).append(ngrams(r["_text"]))
            for lang, parts in by.items():
                codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)
                yield from zip([lang] * len(codes), codes.tolist(), counts.tolist())
        return count

    grams = map_rows(sample.select("_lang", "_text"), pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]),
                     "lang string, gram long, n long", make, 256)
    total = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= length)
    out: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").select("lang", "gram").toLocalIterator():
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Classifier:
    """Out-of-place distance to every profile at once."""

    def __init__(self, profiles: dict[str, list[int]], length: int = PROFILE):
        self.langs, self.length = sorted(profiles), length
        self.codes = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.codes), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(profiles[lang], np.int64)), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 at distance 0, 0 at the largest distance possible. Ties go to the first name."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.length)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        there = self.rank[at]
        there = np.where((self.codes[at] == own)[:, None], there, -1)
        place = np.arange(len(own))[:, None]
        distance = np.where(there < 0, self.length, np.abs(there - place)).sum(0)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.length * len(own)))


def predict_lang(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text",
                 length: int = PROFILE) -> DataFrame:
    """``(<id_col>, lang_pred, score)`` for every row; only the two columns are read.

    Null texts and texts without a letter get ``und`` and 0.0, as does everything when there are no profiles.
    Whole texts are read whatever their length; repeated rows are answered one by one.
    """
    def make():
        c = Classifier(profiles, length)
        return lambda rows: ((r["_id"], *c.predict(r["_text"])) for r in rows)

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")),
                    pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())]),
                    f"`{id_col}` long, lang_pred string, score double", make, 256)


def resembles(text, profiles: dict[str, list[int]], length: int = PROFILE):
    """Whether a text column lies nearer to some profile than the largest distance possible, as a column: false for null,
    for texts without a letter, and for texts none of whose frequent n-grams stands in any profile."""
    @F.pandas_udf(T.BooleanType())
    def test(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = Classifier(profiles, length)
        for s in parts:
            yield pd.Series([c.predict(t)[1] > 0 for t in s], index=s.index, dtype=bool)

    return test(text)


def has_letter(text):
    """Whether a text column has a letter, as a column (false for null): where ``predict`` compares profiles at all."""
    @F.pandas_udf(T.BooleanType())
    def test(s: pd.Series) -> pd.Series:
        return pd.Series([len(ngrams(t)[0]) > 0 for t in s], index=s.index, dtype=bool)

    return test(text)


def held_out(id_col: str = "doc_id"):
    """Documents not learned from: crc32 of the id as text leaves 2 when divided by 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, predict all: ``(<id_col>, held_out, lang_pred, score)``."""
    profiles = learn_profiles(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    out = predict_lang(docs, profiles, id_col, text_col)
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
