"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases, the phrases' names into longer phrases,
and so on up to one name for the text. At each level runs of one name are
first made one symbol, so neighbours differ; then deterministic coin tossing
gives every symbol a label below six that differs from its neighbour's: the
lowest bit in which a symbol differs from the one before it, and that bit's
value, four times over. Symbols with the greatest label around start a phrase,
whose name is a hash of its symbols. Where a phrase starts depends on a few
symbols around it only, so equal substrings are parsed alike inside, wherever
they stand; only phrases near their ends differ.

The fingerprint keeps one-permutation sketches of the phrase names of level 1,
of level 2 and of all levels from 3 on, and the name of the whole text.
``likeness`` compares the coarsest sketch that both texts fill well enough, an
estimate of the share of phrases in common. Equal texts have equal
fingerprints. All documents of a batch are parsed together in NumPy.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage

#: Slots of the sketches of level 1, level 2 and the levels from 3 on; one byte each (0: no phrase fell into it).
SLOTS = (32, 32, 64)
#: A sketch is compared where both texts fill so many of its slots; the finest one always.
FILLED = (0, 12, 16)
#: Characters parsed at a time; a longer text is parsed by itself.
BATCH_CHARS = 1 << 20

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE_NAMES = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _toss_table() -> np.ndarray:
    """Label of ``a`` after ``b``, at ``a * 256 + b``: twice the lowest differing bit, plus ``a``'s value there."""
    a, b = np.arange(256)[:, None], np.arange(256)[None, :]
    low = (a ^ b) & -(a ^ b)
    k = np.bitwise_count(np.maximum(low, 1).astype(np.uint16) - np.uint16(1))
    return (2 * k + ((a & low) != 0)).astype(np.uint8).ravel()


_TOSS = _toss_table()


def _toss_names(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First coin toss of 64-bit names, each against the one before; ``first``: the documents' first symbols."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    d = x ^ before
    low = d & (~d + _U(1))
    return (2 * np.bitwise_count(low - _U(1)) + ((x & low) != 0)).astype(np.uint8)


def _toss_small(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin toss of labels below 256."""
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[first] = ~x[first]
    return _TOSS[(x.astype(np.uint16) << np.uint16(8)) | before]


def _phrase_starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start: the documents' first symbols, and inside them symbols labelled above both neighbours."""
    start = np.zeros(len(label), bool)
    if len(label) > 2:
        start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    start[first[1:] - 1] = False  # a document's last symbol starts none
    start[first] = True
    return np.flatnonzero(start)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, 0x9E3779B97F4A7C15 | 1, _U)
    return np.cumprod(out, dtype=_U)


_WEIGHT = _powers(4096)


def parse(texts: list[bytes]):
    """Yields ``(level, names, doc)`` from level 1 on: the phrase names of all texts (none empty), in order, and the text
    each belongs to. A text takes part until one name stands for it; the last level of all has such names only."""
    size = np.array([len(t) for t in texts])
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(texts), np.uint8)
    alive, names = np.arange(len(texts)), None
    for level in range(1, 200):
        here = raw if level == 1 else names
        head = np.zeros(len(here), bool)  # runs of one symbol become one symbol
        head[0] = True
        np.not_equal(here[1:], here[:-1], out=head[1:])
        head[first] = True
        at = np.flatnonzero(head)
        run = np.diff(at, append=len(here))
        first = np.searchsorted(at, first)
        symbol = here[at]
        label = _toss_small(symbol, first) if level == 1 else _toss_names(symbol, first)
        for _ in range(3):
            label = _toss_small(label, first)
        name = _BYTE_NAMES[symbol] if level == 1 else symbol
        several = np.flatnonzero(run > 1)
        name[several] = _mix(name[several] + _U(0xD1B54A32D192ED03) * run[several].astype(_U))
        start = _phrase_starts(label, first)
        length = np.diff(start, append=len(name))
        place = np.arange(len(name)) - np.repeat(start, length)
        names = _mix(np.add.reduceat(name * _WEIGHT[place], start) + _U(level))
        first = np.searchsorted(start, first)
        count = np.diff(first, append=len(names))
        yield level, names, np.repeat(alive, count)
        go = count > 1
        if not go.any():
            return
        names, alive = names[np.repeat(go, count)], alive[go]
        first = np.cumsum(count[go]) - count[go]


def fingerprints(texts: list[bytes]) -> list[bytes]:
    """A binary fingerprint per text: the sketches, then the text's own 64-bit name; empty for an empty text."""
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return [b""] * len(texts)
    n = len(full)
    least = [np.full(n * s, np.iinfo(_U).max, _U) for s in SLOTS]
    root = np.zeros(n, _U)
    for level, names, doc in parse([texts[i] for i in full]):
        k = min(level, 3) - 1
        key = _mix(names ^ _U(0xA0761D6478BD642F))
        np.minimum.at(least[k], doc * SLOTS[k] + (key >> _U(58 if SLOTS[k] == 64 else 59)).astype(np.int64), key & _U((1 << 58) - 1))
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
        root[doc[last]] = names[last]
    parts = [np.where(x == np.iinfo(_U).max, 0, x % _U(255) + _U(1)).astype(np.uint8).reshape(n, s) for x, s in zip(least, SLOTS)]
    packed = np.concatenate([*parts, root.astype(">u8").view(np.uint8).reshape(n, 8)], axis=1)
    out = [b""] * len(texts)
    for i, row in zip(full, packed):
        out[i] = row.tobytes()
    return out


def likeness(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Likeness of fingerprints pairwise, 0 to 1: the share of equal slots among those that either fills, in the coarsest
    sketch that both fill well. Equal fingerprints (two empty texts too) have 1, an empty text and another 0."""
    out = np.array([float(x == y) for x, y in zip(a, b)])
    both = [i for i, (x, y) in enumerate(zip(a, b)) if x and y and x != y]
    if both:
        m, n = (np.frombuffer(b"".join([z[i] for i in both]), np.uint8).reshape(len(both), -1) for z in (a, b))
        score, at = np.zeros(len(both)), 0
        for s, need in zip(SLOTS, FILLED):
            x, y = m[:, at:at + s], n[:, at:at + s]
            at += s
            enough = ((x > 0).sum(1) >= need) & ((y > 0).sum(1) >= need)
            union = ((x > 0) | (y > 0)).sum(1)
            share = ((x == y) & (x > 0)).sum(1) / np.maximum(union, 1)
            score = np.where(enough, share, score)
        out[both] = score
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter (rounded down) replaced by as many first characters of ``following``, or all it has."""
    n = len(text) // 4
    return text[:len(text) - n] + following[:n]


def _results(rows: list[tuple], nexts: list[str]):
    """Output rows of ``(doc_id, text)`` with the texts that follow them."""
    texts = [t for _, t in rows]
    changed = [edited(t, f) for t, f in zip(texts, nexts)]
    own = fingerprints([t.encode() for t in [*texts, nexts[-1]]])
    # all but the last are followed by the next row
    following = [*own[1:-1], own[-1]] if nexts[:-1] == texts[1:] else fingerprints([t.encode() for t in nexts])
    own = own[:-1]
    after = fingerprints([t.encode() for t in changed])
    near = likeness(own, after).tolist(), likeness(own, following).tolist()
    for (d, t), c, f, g, x, y in zip(rows, changed, own, after, *near):
        yield (d, len(t), hashlib.sha256(c.encode()).digest(), f, g, x, y)


_MADE = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.binary()), ("own", pa.binary()), ("after", pa.binary()),
                   ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.int8()), ("piece", pa.int32()), ("text", pa.string())])
_MADE_DDL = ("doc_id long, n_chars long, edited binary, own binary, after binary, near_edited double, near_next double, "
             "edge tinyint, piece int, text string")


def _made(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _MADE)], schema=_MADE)


def _ordered(batches):
    """Results of a sorted piece for all rows but its last; its first (edge 1) and last (edge 2) with their texts."""
    piece = TaskContext.get().partitionId()
    held, size, begun = [], 0, False
    for rows in arrow_rows(batches):
        for r in rows:
            row = (r["doc_id"], r["text"] or "")
            if not begun:
                yield _made([(row[0], None, None, None, None, None, None, 1, piece, row[1])])
                begun = True
            held.append(row)
            size += len(row[1])
            if size >= BATCH_CHARS and len(held) > 1:
                yield _made([(*x, 0, piece, None) for x in _results(held[:-1], [t for _, t in held[1:]])])
                held, size = held[-1:], len(row[1])
    if len(held) > 1:
        yield _made([(*x, 0, piece, None) for x in _results(held[:-1], [t for _, t in held[1:]])])
    if held:
        yield _made([(held[-1][0], None, None, None, None, None, None, 2, piece, held[-1][1])])


def _borders(batches):
    for rows in arrow_rows(batches, 16):
        out = [next(_results([(r["doc_id"], r["text"])], [r["following"]])) for r in rows]
        yield _made([(*x, 0, 0, None) for x in out])


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)`` and of their edited texts, and how like these and the next document are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``, one row per input
    row. The next document is that of the next doc_id (null first; rows that repeat an id by a hash of their texts, then
    the texts; after the last comes the first, so a single document follows itself). Null text counts as empty; an
    empty text has an empty fingerprint. A text of any length is parsed whole. Other columns are not read.

    Rows are dealt into ranges by (id, hash), so that a hot id is split too, and each is followed by the next one read.
    Only the last row of a range waits for the first of the next, a row per range.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    pieces = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc())
    made = cut_lineage(pieces.mapInArrow(_ordered, _MADE_DDL), "fingerprints")
    firsts = made.where("edge = 1").select(F.col("piece").alias("_at"), F.col("text").alias("following"))
    line = made.where("edge = 1").select("piece")  # one row per range
    w = Window.orderBy("piece")
    after = line.select("piece", F.coalesce(F.lead("piece").over(w), F.first("piece").over(w)).alias("_at"))
    lasts = made.where("edge = 2").select("doc_id", "text", "piece").join(after, "piece").join(firsts, "_at")
    ends = lasts.select("doc_id", "text", "following").mapInArrow(_borders, _MADE_DDL)
    whole = made.where("edge = 0").unionByName(ends)
    return whole.select("doc_id", "n_chars", F.lower(F.hex("edited")).alias("edited_sha256"), F.lower(F.hex("own")).alias("fingerprint"),
                        F.lower(F.hex("after")).alias("edited_fingerprint"), "near_edited", "near_next")
