"""Suffix-array dedup: remove every byte covered by a long string that occurs again.

The index is a logarithmic family of suffix arrays. Documents come in batches.
A batch's suffix array is merge-scanned against the levels that exist, which
finds the suffixes whose beginning occurs again; equal-sized levels merge into
one of twice the size. A suffix array here is sparse: it has the suffixes at
sync points (the positions with the least hash of ``HEAD`` bytes among as many
as fit into a string of ``min_len``; a repeated string has them at the same
places in each of its occurrences), at one entry per 85 bytes. It is ordered by
the bytes of the suffixes as far as every match must reach, ``HEAD``;
neighbours with so long a common prefix are folded to a count.

A suffix without such a neighbour cannot lie in a repeat. From the others, the
match is extended to both sides. A sync point stands for strings of ``min_len``
bytes that start up to ``min_len - HEAD`` before it; equal surroundings are
folded first, so that a passage shared by very many documents is one row. Then
the strings are taken in blocks of ``WIDTH`` neighbouring starts: where another
occurrence has all bytes of a block, its strings repeat; where none has even the
bytes common to them, none does; only in the blocks between these two is
each string looked up. Every step is an aggregation over fixed-size keys,
so no task ever holds a group, however many occurrences or kinds one has.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut_lineage, forget, release

MIN_LEN = 200
HEAD = 32
BATCHES = 4
#: Neighbouring strings that are compared as one block first.
WIDTH = 13
#: Bytes of a text that are searched for sync points at a time.
SLICE = 1 << 20
_U = np.uint64


def sync_points(data: bytes, min_len: int = MIN_LEN) -> list[tuple[np.ndarray, ...]]:
    """``(position, first string, last string, hash)`` arrays: each sync point with the range of starts of the
    ``min_len``-byte strings it stands for. Every start belongs to one sync point."""
    width = min_len - HEAD + 1
    out = []
    for at in range(0, max(0, len(data) - min_len + 1), SLICE):
        b = np.frombuffer(data, np.uint8, min(SLICE + min_len - 1, len(data) - at), at).astype(_U)
        h, size = (b + _U(1)) * _U(0x9E3779B97F4A7C15), 1
        while size < HEAD:
            h = (h[:-size] ^ (h[:-size] >> _U(29))) * _U(0xBF58476D1CE4E5B9 + 2 * size) + h[size:]
            size *= 2
        h = (h ^ (h >> _U(32))) * _U(0x94D049BB133111EB)
        h ^= h >> _U(29)
        least = ((h >> _U(24)) << _U(24)) | np.arange(len(h), dtype=_U)  # ties to the first position
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = width - size
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        where = (least & _U((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        last = np.append(first[1:], len(where)) - 1
        pos = where[first]
        out.append((pos + at, first + at, last + at, h[pos].view(np.int64)))
    return out


def _row_key():
    """A 128-bit key per document and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("_id").cast("string"), F.lit("-")), F.lit(":"), F.col("_text"))))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as an Arrow column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def find_sync_points(docs: DataFrame, min_len: int) -> DataFrame:
    """``(row, suffix, pos, left, right)``: a sync point, the first ``HEAD`` bytes from it, and the strings it stands
    for: they start ``left`` to ``right`` bytes before it."""
    names = ["row", "suffix", "pos", "left", "right"]

    def run(batches):
        for rows in arrow_rows(batches, 256):
            for r in rows:
                data = r["_text"].encode()
                whole, key = np.frombuffer(data, np.uint8), np.frombuffer(r["row"], np.uint8)
                for pos, first, last, _ in sync_points(data, min_len):
                    yield pa.RecordBatch.from_arrays(
                        [_binary(np.tile(key, (len(pos), 1))), _binary(whole[pos[:, None] + np.arange(HEAD)]), pa.array(pos, pa.int64()),
                         pa.array((pos - first).astype(np.int16)), pa.array((pos - last).astype(np.int16))], names=names)

    def joined(batches):
        held, size = [], 0
        for b in run(batches):
            held.append(b)
            size += b.num_rows
            if size >= 10_000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return docs.where(F.octet_length("_text") >= min_len).select(_row_key().alias("row"), "_text").mapInArrow(
        joined, "row binary, suffix binary, pos long, left short, right short")


class LevelIndex:
    """Logarithmic family of folded suffix arrays ``(suffix, n)``, one written table per level; hashes of the suffixes deal
    it over the partitions, each of which is ordered by the suffixes' bytes."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.repeated: list[DataFrame] = []

    def add(self, suffixes: DataFrame) -> None:
        """Take in a batch ``(suffix)``: build its suffix array, scan it against every level, merge equal-sized levels.

        The merge is the scan of the levels that it takes in: a suffix of both sides has a count of at least 2."""
        rows, rank, old = suffixes.withColumn("n", F.lit(1).cast("long")), 0, []
        while rank in self.levels:
            old.append(self.levels.pop(rank))
            rows = rows.unionByName(old[-1])
            rank += 1
        level = cut_lineage(rows.groupBy("suffix").agg(F.sum("n").alias("n")).sortWithinPartitions("suffix"), "suffixes")
        for other in self.levels.values():
            self.repeated.append(cut_lineage(level.join(other.select("suffix"), "suffix").select("suffix"), "repeats"))
        self.levels[rank] = level
        forget(*old)

    def repeated_suffixes(self) -> DataFrame:
        """Beginnings of suffixes that occur more than once in all batches."""
        out = None
        for part in [*self.repeated, *(t.where("n > 1").select("suffix") for t in self.levels.values())]:
            out = part if out is None else out.unionByName(part)
        return out.distinct()


def _sid(left: int, seg: bytes) -> bytes:
    return hashlib.md5(left.to_bytes(2, "little") + seg).digest()


def segments(work: DataFrame, min_len: int, with_text: bool) -> DataFrame:
    """The surroundings of the sync points listed in ``work(row, _text, points)``: ``(left, sid, seg)``, ``seg`` being all
    strings that the point stands for, or without texts their places ``(row, start, sid)``."""
    types = [pa.int16(), pa.binary(), pa.binary()] if with_text else [pa.binary(), pa.int64(), pa.binary()]
    names = ["left", "sid", "seg"] if with_text else ["row", "start", "sid"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, out = batch.slice(at, 128), []
                lists = part.column("points")
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)).tolist()
                pos, left, right = (c.to_pylist() for c in lists.flatten().flatten())
                begin = 0
                for key, text, end in zip(part.column("row").to_pylist(), part.column("_text").to_pylist(), ends):
                    data = text.encode()
                    for p, l, r in zip(pos[begin:end], left[begin:end], right[begin:end]):
                        seg = data[p - l:p - r + min_len]
                        out.append((l, _sid(l, seg), seg) if with_text else (key, p - l, _sid(l, seg)))
                    begin = end
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return work.select("row", "_text", "points").mapInArrow(
        run, "left short, sid binary, seg binary" if with_text else "row binary, start long, sid binary")


def _blocks(kinds: DataFrame, min_len: int, width: int) -> DataFrame:
    """``(sid, n, core, hull, low, high)`` per block of each surroundings ``(sid, left, seg, n)``: its strings start ``low`` to
    ``high`` bytes before the sync point. ``core`` names the bytes that all strings of a full block have, ``hull`` those of the
    strings that are there. Blocks begin at multiples of ``width``, so that equal strings share a block."""
    types = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int16(), pa.int16()]
    names = ["sid", "n", "core", "hull", "low", "high"]

    def run(batches):
        for rows in arrow_rows(batches, 1024):
            out = []
            for r in rows:
                seg, left = r["seg"], r["left"]
                low = left - (len(seg) - min_len)
                while low <= left:
                    base = low - low % width
                    high = min(left, base + width - 1)
                    name = base.to_bytes(2, "little")
                    core = hashlib.md5(name + seg[left - base:left - base - width + 1 + min_len]).digest()
                    hull = hashlib.md5(low.to_bytes(2, "little") + high.to_bytes(2, "little") + seg[left - high:left - low + min_len]).digest()
                    out.append((r["sid"], r["n"], core, hull, low, high))
                    low = high + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return kinds.select("sid", "left", "seg", "n").mapInArrow(run, "sid binary, n long, core binary, hull binary, low short, high short")


def _strings(blocks: DataFrame, min_len: int) -> DataFrame:
    """``(hull, n, at, string)`` per string of the blocks ``(hull, n, low, high, left, seg)``; it starts ``at`` before the point."""
    types, names = [pa.binary(), pa.int64(), pa.int16(), pa.binary()], ["hull", "n", "at", "string"]

    def run(batches):
        for rows in arrow_rows(batches, 1024):
            out = [(r["hull"], r["n"], d, _sid(d, r["seg"][r["left"] - d:r["left"] - d + min_len]))
                   for r in rows for d in range(r["low"], r["high"] + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return blocks.select("hull", "n", "low", "high", "left", "seg").mapInArrow(run, "hull binary, n long, at short, string binary")


def extend_matches(folded: DataFrame, min_len: int, width: int) -> DataFrame:
    """``(sid, parts)``: the parts of the surroundings ``folded(left, sid, seg, n)`` that repeat, as byte ranges."""
    head = F.xxhash64(F.expr(f"substring(seg, left + 1, {HEAD})"))
    # a beginning with one kind of surroundings: nothing but whole repeats
    several = folded.groupBy(head.alias("_h")).agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("_h")
    kinds = cut_lineage(folded.withColumn("head", head).join(several, F.col("head") == F.col("_h"), "left_semi").drop("head"), "kinds")
    blocks = cut_lineage(_blocks(kinds, min_len, width), "blocks")
    hulls = cut_lineage(blocks.groupBy("core", "hull", "low", "high").agg(F.sum("n").alias("n"), F.min("sid").alias("sid")), "hulls")
    open_cores = (hulls.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
                  .where("kinds > 1 and least = 1").select(F.col("core").alias("_core")))
    unsettled = hulls.join(open_cores, F.col("core") == F.col("_core"), "left_semi").select("hull", "low", "high", "n", "sid")
    texts = kinds.select(F.col("sid").alias("_sid"), "left", "seg")
    strings = cut_lineage(_strings(unsettled.join(texts, F.col("sid") == F.col("_sid")), min_len), "strings")
    again = strings.groupBy("string").agg(F.sum("n").alias("times")).where("times > 1").select(F.col("string").alias("_string"))
    single = (strings.where("n = 1").join(again, F.col("string") == F.col("_string"), "left_semi")
              .select("hull", F.col("at").alias("from"), F.col("at").alias("to")))
    found = hulls.where("n > 1").select("hull", F.col("low").alias("from"), F.col("high").alias("to")).unionByName(single)
    # the strings of one block side by side, at most ``width`` of them; the blocks of one surroundings likewise
    found = found.groupBy(F.col("hull").alias("_hull")).agg(F.collect_list(F.struct("from", "to")).alias("parts"))
    partly = (blocks.where("n = 1").join(found, F.col("hull") == F.col("_hull")).select("sid", F.explode("parts").alias("p"))
              .groupBy("sid").agg(F.collect_list("p").alias("p"))
              .join(texts.select("_sid", "left"), F.col("sid") == F.col("_sid"))
              .select("sid", F.expr(f"transform(p, x -> struct(int(left - x.to) as a, int(left - x.from + {min_len}) as z))").alias("parts")))
    whole = folded.where("n > 1").select("sid", F.array(F.struct(F.lit(0).alias("a"), F.octet_length("seg").alias("z"))).alias("parts"))
    out = cut_lineage(whole.unionByName(partly), "covered")
    forget(kinds, blocks, hulls, strings)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_len: int = MIN_LEN,
                   batches: int = BATCHES, width: int = WIDTH) -> DataFrame:
    """``(<id_col>, n_bytes, n_removed, n_spans, kept_sha256, kept)``, one row per input row; ``kept`` has the remaining bytes, null
    where no string of the text was looked at closely, so that all of it remains.

    Texts are UTF-8 bytes, null is empty. Removed is each byte covered by a ``min_len``-byte string that also starts
    anywhere else, in the same text (overlaps count) or another, judged on the input. Rows that repeat an id
    and text are occurrences of their own. Shorter texts stay whole; very long texts are searched in slices; an
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    points = cut_lineage(find_sync_points(texts, min_len), "sync-points")
    index = LevelIndex()
    for k in range(batches):
        index.add(points.where(F.pmod(F.xxhash64("row"), F.lit(batches)) == k).select("suffix"))
        release(spark)
    repeated = index.repeated_suffixes().select(F.col("suffix").alias("_suffix"))
    mine = cut_lineage(points.join(repeated, F.col("suffix") == F.col("_suffix"), "left_semi")
                       .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("pos", "left", "right"))).alias("points")), "points")
    forget(points, *index.levels.values(), *index.repeated)
    release(spark)
    work = cut_lineage(texts.withColumn("_row", _row_key()).join(mine, F.col("_row") == F.col("row"), "left")
                       .select("_id", F.col("_row").alias("row"), "points", F.octet_length("_text").alias("n_bytes"),
                               F.when(F.col("points").isNull(), F.sha2("_text", 256)).alias("whole_sha"),
                               F.when(F.col("points").isNotNull(), F.col("_text")).alias("_text")), "work")
    forget(mine)
    release(spark)
    touched = work.where("points is not null")
    folded = cut_lineage(segments(touched, min_len, True).groupBy("sid", "left", "seg").agg(F.count(F.lit(1)).alias("n")), "folded")
    release(spark)
    covered = extend_matches(folded, min_len, width)
    forget(folded)
    release(spark)
    spans = (segments(touched, min_len, False).join(covered.withColumnsRenamed({"sid": "_s"}), F.col("sid") == F.col("_s"))
             .select("row", F.explode("parts").alias("p"), "start")
             .groupBy(F.col("row").alias("_row"))
             .agg(F.collect_set(F.struct((F.col("start") + F.col("p.a")).alias("a"), (F.col("start") + F.col("p.z")).alias("z"))).alias("spans")))

    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.binary())])

    def run(batches_):
        for rows in arrow_rows(batches_, 128):
            out = []
            for r in rows:
                data, spans_ = r["_text"].encode(), sorted((s["a"], s["z"]) for s in r["spans"] or ())
                kept, at, removed, n = [], 0, 0, 0
                for a, z in spans_:
                    if a > at or n == 0:  # not touching the removed run before it
                        kept.append(data[at:a])
                        removed, n, at = removed + z - a, n + 1, z
                    elif z > at:
                        removed, at = removed + z - at, z
                kept.append(data[at:])
                whole = b"".join(kept)
                out.append((r["_id"], len(data), removed, n, hashlib.sha256(whole).hexdigest(), whole))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], names=schema.names)

    changed = (touched.join(spans, F.col("row") == F.col("_row"), "left").select("_id", "_text", "spans")
               .mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
    same = work.where("points is null").select(
        F.col("_id").alias(id_col), F.col("n_bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("whole_sha").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    return changed.unionByName(same)
