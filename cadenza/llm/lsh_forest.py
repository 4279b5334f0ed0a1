"""Approximate nearest neighbours by a hash-prefix forest.

Each tree gives a vector a long hash string, the signs of its products with
random directions. A tree is the sorted array of these strings. A query
descends in every tree to the strings that share its longest prefix, then all
trees ascend together, one character at a time, and take in the vectors that
share the shorter prefixes until there are enough candidates. Candidates are
scored by their exact cosine in double precision.

The index is dealt into blocks of rows, the given query set into blocks of
queries; a cell is one block of each. A cell holds a bounded number of rows
whatever the table's size, or the number of equal vectors in it, since rows
are dealt by a hash of their id. The best of all cells are merged per query.

``share`` is the part of a block that a query takes in as candidates, at least
``MIN_CANDIDATES``. Vectors without structure need a large share; measured
recall is in the README and in the tests.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

TREES = 40
BITS = 32
BLOCK_ROWS = 4096
BLOCK_QUERIES = 2048
SHARE = 0.4
MIN_CANDIDATES = 64


class Forest:
    """Sorted hash strings of one block of vectors, ``TREES`` trees."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.trees, self.bits = trees, bits
        self.directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], trees * bits)).astype(np.float32)
        codes = self.hash(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable")
        self.codes = np.take_along_axis(codes, self.order, axis=1)
        self.n = len(vectors)

    def hash(self, vectors: np.ndarray) -> np.ndarray:
        """Hash strings as integers, first character highest: (trees, vectors)."""
        signs = (vectors.astype(np.float32) @ self.directions > 0).reshape(len(vectors), self.trees, self.bits)
        weight = (1 << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        return np.ascontiguousarray((signs * weight).sum(2, dtype=np.uint64).T)

    def ranges(self, codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, where the strings with the same ``length`` first characters begin and end."""
        rest = np.uint64((1 << (self.bits - length)) - 1)
        lo = np.stack([np.searchsorted(c, q & ~rest, "left") for c, q in zip(self.codes, codes)])
        hi = np.stack([np.searchsorted(c, q | rest, "right") for c, q in zip(self.codes, codes)])
        return lo, hi

    def candidates(self, queries: np.ndarray, wanted: int):
        """For each query the rows that share the longest prefixes, at least ``wanted`` of them (all, if fewer)."""
        codes = self.hash(queries)
        wanted = min(wanted, self.n)
        found: list[np.ndarray | None] = [None] * len(queries)
        open_ = np.arange(len(queries))
        for length in range(self.bits, -1, -1):  # the synchronous ascent
            lo, hi = self.ranges(codes[:, open_], length)
            enough = (hi - lo).sum(0) >= wanted  # else the union cannot be large enough either
            left = []
            for k, q in enumerate(open_.tolist()):
                if enough[k]:
                    seen = np.zeros(self.n, bool)
                    for t in range(self.trees):
                        seen[self.order[t, lo[t, k]:hi[t, k]]] = True
                    if seen.sum() >= wanted:
                        found[q] = np.flatnonzero(seen)
                        continue
                left.append(q)
            open_ = np.array(left, np.int64)
            if not len(open_):
                break
        return found


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component to [0.5, 1): cosines stay what they are,
    and no square underflows or overflows."""
    _, power = np.frexp(np.abs(vectors).max(1, initial=0.0))
    return np.ldexp(vectors, -power[:, None])


def cosine(queries: np.ndarray, q: int, vectors: np.ndarray, norms: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of one query with some rows; equal vectors get equal values."""
    x = queries[q]
    return (vectors[rows] * x).sum(1) / (norms[rows] * math.sqrt(float((x * x).sum())))


def usable(col):
    """A vector that takes part: not null, no null or non-finite component, not all zero."""
    return F.coalesce(
        col.isNotNull() & (F.size(col) > 0)
        & ~F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists(col, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            trees: int = TREES, share: float = SHARE, seed: int = 7) -> DataFrame:
    """``(query_id, rank, <id_col>, score)``: for each row that fulfils ``is_query`` its ``k`` nearest others found.

    Score: cosine in double precision; nearest first, ties to the smaller id. Null, zero and non-finite vectors and
    rows without an id take no part. Vectors are compared with those of the same length only. Rows that repeat an id
    are candidates one by one, but not of a query with that id. Fewer than ``k`` others: all of them. An empty table
    gives no rows; other columns are not read.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("is_query"))
    rows = cut_lineage(rows.withColumn("dim", F.size("v")), "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count(F.when(F.col("is_query"), 1))).first()
    row_blocks, query_blocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(n_queries / BLOCK_QUERIES))
    place = F.xxhash64("id", "v")
    indexed = rows.select("dim", "id", "v", F.lit(False).alias("asks"), F.pmod(place, F.lit(row_blocks)).cast("int").alias("rb"),
                          F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    asking = rows.where("is_query").select("dim", "id", "v", F.lit(True).alias("asks"),
                                           F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"),
                                           F.pmod(place, F.lit(query_blocks)).cast("int").alias("qb"))

    def search(table: pa.Table) -> pa.Table:
        dim = table["dim"][0].as_py()
        flat = scaled(table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
        ids, asks = table["id"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
        order = np.argsort(ids[~asks], kind="stable")
        x, xid, q, qid = flat[~asks][order], ids[~asks][order], flat[asks], ids[asks]
        out: tuple[list, list, list] = ([], [], [])
        if len(x) and len(q):
            norms = np.sqrt((x * x).sum(1))
            forest = Forest(x / norms[:, None], trees, seed=seed)
            wanted = max(MIN_CANDIDATES, math.ceil(share * len(x)))
            unit = q / np.sqrt((q * q).sum(1))[:, None]
            for i, rows_ in enumerate(forest.candidates(unit, wanted)):
                rows_ = rows_[xid[rows_] != qid[i]]
                score = cosine(q, i, x, norms, rows_)
                best = np.lexsort((xid[rows_], -score))[:k]
                out[0].extend([int(qid[i])] * len(best))
                out[1].extend(xid[rows_[best]].tolist())
                out[2].extend(score[best].tolist())
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "near_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    cells = indexed.unionByName(asking).groupBy("dim", "rb", "qb")
    found = cells.applyInArrow(search, "query_id long, near_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "near_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("near_id").alias(id_col), "score"))
