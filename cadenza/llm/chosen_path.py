"""MinHash near-dedup as a chosen-path set similarity join.

A document is its set of distinct word shingles, sketched by ``HASHES`` minwise
tokens. Independent trees branch the documents by chosen tokens: a path from
the root chooses ``ROOT`` positions of the sketch, one after the other, and
deals the documents by their tokens there; a node that is still large branches
on, twice at every level. Nodes of at most ``LEAF`` documents are compared exhaustively on
their sketches; pairs that may reach the threshold are confirmed on the full
sets. A second sketch, the least hash of the set in each of ``BINS`` ranges, tells
links from pairs just below the threshold (it holds nearly all of a small set). A pair at the threshold follows one path
with probability 0.51, so ``TREES`` trees miss it with a probability of 1.6e-8; where all its nodes branch down to the last
level (only in very large groups, which hold together by other links too) with one of 3e-6.

Only connected components are wanted, so pairs inside one component need no
comparing. Documents with equal sets are one from the start. Then the trees are walked in rounds, each confirming links and
joining components: first the best partner of every document, where large nodes are dealt into leaves at random, and dealt
again with other hashes as long as that joins components, so that a large group of near copies comes
together without comparing all its pairs; then for every node the best pairs of each two components; and at last all
pairs left between different components. Nodes that lie in one component are
dropped, on narrow rows, before sketches are fetched. In a large node the documents outside its main component meet the
whole node, in blocks, if they are few; else the node is branched on, and
at the deepest level they meet it in any case. No node is capped and no pair
sampled.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, cut_lineage, files_for, forget, min_label_components, release

HASHES = 64
TREES = 25
ROOT = 3
LEAF = 64
DEPTH = 6
#: A pair is confirmed if this many tokens of the sketch agree; a pair at 0.8 has fewer with a chance of 3e-7.
AGREE = 34
#: Ranges of the second sketch, and standard deviations by which a pair may fall short of the threshold there: a pair at
#: it falls shorter with a chance of 1e-7.
BINS = 512
SHORT = 5.2
#: Round 2 confirms this many pairs of two components in a leaf.
BEST = 4
#: Documents outside the main component of a large node that are compared with a block of as many of its documents at once.
FEW = 1024
#: Documents whose rows in a scratch table are worth a file of their own.
DOCS_PER_FILE = 4_000
#: Characters per array computation.
SLICE = 1 << 20

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_MULTIPLY = (np.random.default_rng(11).integers(1, 1 << 62, HASHES, dtype=np.uint64) << _U(1)) | _U(1)
_BYTE = np.random.default_rng(12).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.ones(1, _U)
_INVERSE = np.ones(1, _U)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least ``n`` of each."""
    global _POWERS, _INVERSE
    if len(_POWERS) < n:
        n = max(n, 2 * len(_POWERS), 1 << 16)
        inv = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, _BASE, _U))))
            _INVERSE = np.concatenate((np.ones(1, _U), np.cumprod(np.full(n, inv, _U))))
    return _POWERS, _INVERSE


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order."""
    data = (text or "").encode().lower()
    if not data:
        return np.empty(0, _U)
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = []
    at = 0
    while at < len(start):  # in slices of about SLICE bytes, so that a very long text needs no large arrays
        to = max(at + 1, int(np.searchsorted(end, start[at] + SLICE, "right")))
        lo, hi = start[at], end[to - 1]
        up, down = _powers(int(hi - lo) + 1)
        sums = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b[lo:hi]] * up[:hi - lo])))
        s, e = start[at:to] - lo, end[at:to] - lo
        out.append(_scramble((sums[e] - sums[s]) * down[s] + (e - s).astype(_U)))
        at = to
    return np.concatenate(out) if out else np.empty(0, _U)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles; with fewer words the whole sequence is one; no words, none."""
    w = word_hashes(text)
    if not len(w):
        return np.empty(0, _U)
    k = min(words, len(w))
    h = np.full(len(w) - k + 1, k, _U)
    for i in range(k):
        h = _scramble(h * _U(_BASE) + w[i:len(w) - k + 1 + i])
    return np.unique(h)


def sketch(s: np.ndarray) -> np.ndarray:
    """Minwise tokens of a set of hashes."""
    out = np.full(HASHES, ~_U(0), _U)
    for at in range(0, len(s), 2048):
        part = s[at:at + 2048, None] * _MULTIPLY
        out = np.minimum(out, (part ^ (part >> _U(32))).min(0))
    return (out >> _U(16)).astype(np.uint32)


def bin_sketch(s: np.ndarray) -> np.ndarray:
    """Of a sorted set of hashes, 8 bits of the least one in each of ``BINS`` equal ranges of values; 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    where = s >> _U(64 - BINS.bit_length() + 1)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    out[where[first].astype(np.int64)] = 1 + _scramble(s[first]) % _U(255)
    return out


def may_link(f: np.ndarray, g: np.ndarray, n: np.ndarray, m: np.ndarray, pct: int) -> np.ndarray:
    """Whether pairs of sets with bin sketches ``f`` and ``g`` and sizes ``n`` and ``m`` may reach the threshold.

    Ranges that either set has anything in are draws, without replacement, from the union; at the threshold that holds
    at most (n + m) / (1 + pct / 100) shingles."""
    out = np.empty(len(f), bool)
    t = pct / 100
    for at in range(0, len(f), 4096):
        z = slice(at, at + 4096)
        a, b = f[z], g[z]
        drawn = ((a | b) != 0).sum(1)
        equal = ((a == b) & (a != 0)).sum(1)
        union = np.maximum((n[z] + m[z]) / (1 + t), drawn)
        spread = np.sqrt(t * (1 - t) * drawn * (1 - drawn / (union + 1)))
        out[z] = equal >= t * drawn - SHORT * spread - 1
    return out


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], names=schema.names)


def _hash(*parts) -> np.ndarray:
    x = np.zeros(1, _U)
    for p in parts:
        x = _scramble(x * _U(_BASE) + np.asarray(p).astype(_U) + _U(1))
    return x


#: The positions that the trees' first levels choose: disjoint triples first, then triples across these.
_PATHS = np.array([(3 * t, 3 * t + 1, 3 * t + 2) for t in range(HASHES // ROOT)]
                  + [(5 * t % HASHES, (5 * t + 22) % HASHES, (5 * t + 43) % HASHES) for t in range(TREES - HASHES // ROOT)])


def first_nodes(tokens: np.ndarray) -> np.ndarray:
    """The node in each tree that documents with these minwise tokens (a row each) reach by its first choices."""
    return _hash(np.arange(TREES)[None, :], *[tokens[:, _PATHS[:, k]] for k in range(ROOT)]).view(np.int64)


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("sk", pa.binary()), ("bins", pa.binary()),
                     ("nodes", pa.list_(pa.int64())), ("prints", pa.binary())])


def sketch_documents(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, n, key, sk, bins, nodes, prints)``: size, 128-bit digest, low bytes of the minwise tokens, bin sketch, first
    nodes and their low 32 bits of each document's set."""
    def run(batches):
        for rows in arrow_rows(batches):
            out = []
            for r in rows:
                s = shingle_set(r["_text"], words)
                if not len(s):
                    out.append((r["_id"], 0, None, None, None, None, None))
                    continue
                tokens = sketch(s)
                nodes = first_nodes(tokens[None, :])[0]
                out.append((r["_id"], len(s), hashlib.md5(s.tobytes()).digest(), tokens.astype(np.uint8).tobytes(), bin_sketch(s).tobytes(),
                            nodes, nodes.astype(np.uint32).tobytes()))
            yield _batch(zip(*out), _SKETCH)

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, "doc_id long, n long, key binary, sk binary, bins binary, nodes array<long>, prints binary")


def _groups(batches, columns: list[str]):
    """Whole groups of rows sorted by node, as dicts of arrays; a group is bounded by the caller's counts."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]).select(columns)
        held = t if held is None or not held.num_rows else pa.concat_tables([held, t])
        node = held["node"].to_numpy()
        if not len(node) or node[0] == node[-1]:
            continue
        cut = int(np.flatnonzero(node[1:] != node[:-1])[-1]) + 1
        yield from _split(held.slice(0, cut))
        held = held.slice(cut)
    if held is not None and held.num_rows:
        yield from _split(held)


def _split(t: pa.Table):
    wide = {"sk": (HASHES, np.uint8), "bins": (BINS, np.uint8), "prints": (TREES, np.uint32)}
    cols = {c: (t[c].to_numpy() if c not in wide else np.frombuffer(b"".join(t[c].to_pylist()), wide[c][1]).reshape(-1, wide[c][0]))
            for c in t.column_names}
    edge = np.flatnonzero(np.diff(cols["node"])) + 1
    for a, z in zip([0, *edge.tolist()], [*edge.tolist(), t.num_rows]):
        yield {c: v[a:z] for c, v in cols.items()}


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _near_pairs(g: dict, p: np.ndarray, q: np.ndarray, once: bool, fresh: bool, pct: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows ``p`` and ``q`` of a group worth confirming, and minus the tokens they share. ``once``: ``p`` and ``q`` are
    the same rows, a pair counts in one order; ``fresh``: less pairs that an earlier tree compares. Few rows and few pairs at a
    time, as a group of near copies has a million pairs and a bin sketch 512 bytes."""
    comp, n = g["comp"], g["n"]
    sk, m = g["sk"][q], n[q]
    found = [(np.empty(0, np.int64),) * 3]
    for at in range(0, len(p), 32):
        some = p[at:at + 32]
        agree = (g["sk"][some][:, None, :] == sk[None, :, :]).sum(2, dtype=np.int16)
        near = (agree >= AGREE) & (comp[some][:, None] != comp[q][None, :])
        near &= 100 * np.minimum(n[some][:, None], m[None, :]) >= pct * np.maximum(n[some][:, None], m[None, :])
        if once:
            near = np.triu(near, at)
        i, j = np.nonzero(near)
        for z in range(0, len(i), 4096):
            x, y, level = some[i[z:z + 4096]], q[j[z:z + 4096]], -agree[i[z:z + 4096], j[z:z + 4096]].astype(np.int64)
            keep = may_link(g["bins"][x], g["bins"][y], n[x], n[y], pct)
            if fresh:
                before = (g["prints"][x] == g["prints"][y]) & (np.arange(TREES)[None, :] < g["tree"][x][:, None])
                before &= ((g["whole"][x][:, None] >> np.arange(TREES)[None, :]) & 1).astype(bool)
                keep &= ~before.any(1)
            found.append((x[keep], y[keep], level[keep]))
    return tuple(np.concatenate(c) for c in zip(*found))


def leaf_pairs(leaves: DataFrame, best: int, pct: int) -> DataFrame:
    """Pairs ``(a, b)``, a < b, worth confirming in leaves ``(node, half, id, comp, n, sk, bins)``: of different components,
    sizes and sketches near enough. ``best`` = 1: only the best of each document; more: so many of each two components; 0:
    all, and leaves also have ``(tree, prints, whole)``: a pair is left out in a tree if an earlier one has compared it.
    Where ``half`` is 1 and 2, only pairs between the halves."""
    columns = ["node", "half", "id", "comp", "n", "sk", "bins", *([] if best else ["tree", "prints", "whole"])]

    def run(batches):
        out: list[np.ndarray] = []
        size = 0
        for g in _groups(batches, columns):
            ids, comp, n, half = g["id"], g["comp"], g["n"], g["half"]
            p, q = (np.flatnonzero(half == 1), np.flatnonzero(half == 2)) if half.any() else (np.arange(len(ids)),) * 2
            x, y, level = _near_pairs(g, p, q, not half.any(), not best, pct)
            if not len(x):
                continue
            if best:  # each pair from both sides
                x, y, level = np.append(x, y), np.append(y, x), np.append(level, level)
            if best:
                # most agreement first, ties to the smaller ids; of each document, or of each two components
                if best == 1:
                    first = np.lexsort((ids[y], level, x))
                    x, y = x[first], y[first]
                    new = np.append(True, x[1:] != x[:-1])
                else:
                    x, y, level = x[once := comp[x] < comp[y]], y[once], level[once]
                    first = np.lexsort((ids[y], ids[x], level, comp[y], comp[x]))
                    x, y = x[first], y[first]
                    new = np.append(True, (comp[x[1:]] != comp[x[:-1]]) | (comp[y[1:]] != comp[y[:-1]]))[:len(x)]
                begin = np.flatnonzero(new)
                nth = np.arange(len(x)) - np.repeat(begin, np.diff(np.append(begin, len(x))))
                x, y = x[nth < best], y[nth < best]
            pair = np.unique(np.stack((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])), 1), axis=0)
            out.append(pair)
            size += len(pair)
            if size >= 50_000:
                p = np.concatenate(out)
                yield _batch((p[:, 0], p[:, 1]), _PAIRS)
                out, size = [], 0
        if out:
            p = np.concatenate(out)
            yield _batch((p[:, 0], p[:, 1]), _PAIRS)

    return (leaves.select(*columns).repartition("node").sortWithinPartitions("node")
            .mapInArrow(run, "a long, b long"))


def _children(rows: DataFrame, depth: int) -> DataFrame:
    """Nodes branched on: each picks two positions of the sketch and deals its documents by their tokens there."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            node = t["node"].to_numpy()
            sk = np.frombuffer(b"".join(t["sk"].to_pylist()), np.uint8).reshape(-1, HASHES)
            for k in range(2):
                place = (_hash(node.view(_U), np.full(len(node), 2 * depth + k)) % _U(HASHES)).astype(np.int64)
                child = _hash(node.view(_U), place, sk[np.arange(len(node)), place]).view(np.int64)
                yield from t.set_column(t.column_names.index("node"), "node", pa.array(child)).to_batches()

    return rows.mapInArrow(run, rows.schema)


def _mixed(nodes: DataFrame, files: int) -> DataFrame:
    """``(node, tree, id, comp, rows)``: the rows of nodes that hold more than one component, written, without sketches."""
    about = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    mixed = about.where("c0 <> c1").select(F.col("node").alias("_node"), "rows")
    return cut_lineage(nodes.join(mixed, F.col("node") == F.col("_node")).select("node", "tree", "id", "comp", "rows"), "nodes", files)


def _in_components(tree: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return tree.select("node", "tree", "id", F.col("id").alias("comp"))
    named = comp.select(F.col("node").alias("_id"), "component")
    return (tree.join(named, F.col("id") == F.col("_id"), "left").select("node", "tree", "id", F.coalesce("component", "id").alias("comp")))


def _whole(f: Column) -> Column:
    return F.ceil(f).cast("int")


def deal_pairs(nodes: DataFrame, about: DataFrame, pct: int, salt: int) -> DataFrame:
    """Each document's best partner in the nodes ``(node, id, comp, rows)``, the large ones dealt into leaves at random."""
    deal = F.pmod(F.xxhash64("id", "node", F.lit(salt)), F.ceil(F.col("rows") / LEAF))
    leaf = F.when(F.col("rows") <= LEAF, F.col("node")).otherwise(F.xxhash64("node", deal))
    return leaf_pairs(nodes.withColumn("node", leaf).withColumn("half", F.lit(0)).join(about, "id"), 1, pct)


def all_pairs(nodes: DataFrame, about: DataFrame, best: int, pct: int, files: int) -> DataFrame:
    """Candidate pairs of all nodes ``(node, tree, id, comp, rows)``: large ones are compared in blocks with the documents
    outside their main component, or branched on. ``best`` as in ``leaf_pairs``. In the round that wants all pairs, rows know
    in which trees their first node is compared whole, so that a pair is found in the first of these only."""
    found, whole = [], None
    for depth in range(DEPTH + 1):
        large = nodes.where(F.col("rows") > LEAF)
        # the main component of a large node needs no comparing with itself: the others meet all blocks of the node
        sizes = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("size"))
        main = sizes.groupBy(F.col("node").alias("_node")).agg(F.max("size").alias("most"))
        main = (sizes.join(main, (F.col("node") == F.col("_node")) & (F.col("size") == F.col("most")))
                .groupBy("_node", "most").agg(F.min("comp").alias("main")))
        large = cut_lineage(large.join(main, F.col("node") == F.col("_node")).select(
            "node", "tree", "id", "comp", "rows", "main", (F.col("rows") - F.col("most")).alias("others")), "large-nodes", files)
        met = large if depth == DEPTH else large.where(F.col("others") <= FEW)
        leaves = nodes.where(F.col("rows") <= LEAF).withColumn("half", F.lit(0))
        if best == 0 and depth == 0:
            in_tree = F.sum(F.pow(F.lit(2), F.col("tree")).cast("long"))  # a document is once in a tree
            whole = cut_lineage(leaves.select("id", "tree").unionByName(met.select("id", "tree")).groupBy("id").agg(in_tree.alias("whole")), "whole", files)

        def compared(rows: DataFrame, name: str) -> DataFrame:
            rows = rows.join(about, "id")
            if best == 0:
                rows = rows.join(whole, "id", "left").withColumn("whole", F.coalesce("whole", F.lit(0)))
            return cut_lineage(leaf_pairs(rows, best, pct), name, files)

        found.append(compared(leaves, "leaf-pairs"))
        if large.limit(1).count() == 0:
            break
        blocks, parts = _whole(F.col("rows") / FEW), _whole(F.col("others") / FEW)
        block, part = F.pmod(F.xxhash64("id", "node"), blocks).cast("int"), F.pmod(F.xxhash64("node", "id"), parts).cast("int")
        one = met.select("node", "tree", "id", "comp", F.lit(1).alias("half"), block.alias("_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_p"))
        other = met.where(F.col("comp") != F.col("main")).select(
            "node", "tree", "id", "comp", F.lit(2).alias("half"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_b"), part.alias("_p"))
        cells = one.unionByName(other).withColumn("node", F.xxhash64("node", "_b", "_p"))
        found.append(compared(cells, "cell-pairs"))
        more = large.where(F.col("others") > FEW)
        if depth == DEPTH or more.limit(1).count() == 0:
            break
        nodes = _mixed(_children(more.select("node", "tree", "id", "comp").join(about.select("id", "sk"), "id"), depth).drop("sk"), files)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


#: Bits of the filter that keeps rows of documents without a candidate where they are: at most 131,072 words of 64.
MARKS = 1 << 23


def _marked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs(id, ...)`` less most rows whose id is not in ``ids``: a bitmap of hashed ids, bounded whatever their number, goes
    to all tasks, so that only rows that may be wanted are shuffled."""
    place = f"pmod(xxhash64(id), {MARKS}L)"
    marks = (ids.select(F.expr(f"{place} div 64").alias("_word"), F.expr(f"shiftleft(1L, cast({place} % 64 AS int))").alias("_bit"))
             .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    hit = F.expr(f"shiftright(_bits, cast({place} % 64 AS int)) & 1L") == 1
    return docs.join(F.broadcast(marks), F.expr(f"{place} div 64") == F.col("_word")).where(hit).drop("_word", "_bits")


class _Sets:
    """Full sets of the documents that take part in a pair, written once."""

    def __init__(self, docs: DataFrame, words: int, id_col: str, text_col: str, files: int):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))
        self.words, self.files, self.table = words, files, None

    def add(self, ids: DataFrame) -> None:
        new = ids if self.table is None else ids.join(self.table.select("id"), "id", "left_anti")
        if self.table is not None:
            new = cut_lineage(new, "set-ids", self.files)
            if new.limit(1).count() == 0:
                return
        words = self.words

        def run(batches):
            for rows in arrow_rows(batches):
                yield _batch(([r["id"] for r in rows],
                              [shingle_set(r["_text"], words).tobytes() for r in rows]),
                             pa.schema([("id", pa.int64()), ("s", pa.binary())]))

        # the exact join comes after the sets are made: the optimizer would move it below the filter otherwise
        made = _marked(self.docs, new).mapInArrow(run, "id long, s binary").join(new, "id", "left_semi")
        made = cut_lineage(made.dropDuplicates(["id"]), "sets", self.files)
        self.table = made if self.table is None else self.table.unionByName(made)


@F.pandas_udf(T.BooleanType())
def _reaches(a, b, pct):
    import pandas as pd

    def one(x: bytes, y: bytes, p: int) -> bool:
        both = len(np.intersect1d(np.frombuffer(x, _U), np.frombuffer(y, _U), assume_unique=True))
        return 100 * both >= p * ((len(x) + len(y)) // 8 - both)

    return pd.Series([one(x, y, p) for x, y, p in zip(a, b, pct)], dtype=bool)


def confirm(pairs: DataFrame, sets: _Sets, pct: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: 100 * intersection >= pct * union."""
    ids = cut_lineage(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "pair-ids", sets.files)
    sets.add(ids)
    s = _marked(sets.table, ids)
    both = (pairs.join(s.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
            .join(s.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b"))
    return both.where(_reaches("sa", "sb", F.lit(pct))).select("a", "b")


def near_dedup(docs: DataFrame, words: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, n_shingles, component_id, kept)``, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a set holds the distinct ``words``-word shingles, the whole
    sequence if there are fewer words. Documents link at ``100 * intersection >= pct * union``. A component is named
    by its smallest id, which is the one kept. Null texts and texts without words have an empty set, link with
    nothing and are kept. Rows without an id link with nothing: component null, kept. An id names one
    document: rows that repeat it repeat its text and its verdict (with other texts under the same id they count as
    one node). Texts of any length are read whole; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    base = cut_lineage(sketch_documents(docs, words, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "sketches")
    files = files_for(spark, base.count(), DOCS_PER_FILE)
    linked = base.where("n > 0 and doc_id is not null")
    # one row stands for all documents with its set; the others of a set are mostly few
    classes = cut_lineage(linked.groupBy("key").agg(F.min(F.struct("doc_id", "row")).alias("m"))
                          .select("key", F.col("m.doc_id").alias("id"), F.col("m.row").alias("_row")), "classes", files)
    copies = cut_lineage(linked.select("key", "row").join(classes.select("key", "_row"), "key").where("row <> _row").select("row"), "copies", files)
    reps = linked.join(copies, "row", "left_anti").withColumnRenamed("doc_id", "id")
    first = reps.select(F.posexplode("nodes").alias("tree", "node"), "id")
    shared = first.groupBy("node").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("node").alias("_node"))
    tree = cut_lineage(first.join(shared, F.col("node") == F.col("_node"), "left_semi"), "tree", files)
    about = cut_lineage(_marked(reps.select("id", "n", "sk", "bins", "prints"), tree.select("id").distinct()), "class-sketches", files)
    release(spark)
    sets = _Sets(docs, words, id_col, text_col, files)
    links = tried = comp = None

    def join_by(pairs: DataFrame) -> int:
        """Confirm pairs not tried before and join components; the number of new links."""
        nonlocal links, tried, comp
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = cut_lineage(pairs, "pairs", files)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if pairs.limit(1).count() == 0:
            return 0
        new = cut_lineage(confirm(pairs, sets, pct), "links", files)
        release(spark)
        n = new.count()
        if n:
            links = new if links is None else links.unionByName(new)
            comp = cut_lineage(min_label_components(links), "components", files)
            release(spark)
        return n

    salt, nodes = 0, _mixed(_in_components(tree, comp), files)
    while True:
        new = join_by(deal_pairs(nodes, about, pct, salt))
        forget(nodes)
        nodes = _mixed(_in_components(tree, comp), files)
        large = nodes.where(F.col("rows") > LEAF).count()
        if new * LEAF < large or not large:  # dealing no longer pays; the next rounds compare the rest
            break
        salt += 1
    for best in (BEST, 0):
        if best == 0:
            forget(nodes)
            nodes = _mixed(_in_components(tree, comp), files)
        join_by(all_pairs(nodes, about, best, pct, files))
    by_class = classes.select(F.col("key").alias("_key"), F.col("id").alias("_class"))
    if comp is not None:
        by_class = (by_class.join(comp, F.col("_class") == F.col("node"), "left")
                    .select("_key", F.coalesce("component", "_class").alias("_class")))
    out = base.select("doc_id", "n", "key").join(by_class, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_class", "doc_id"))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))
