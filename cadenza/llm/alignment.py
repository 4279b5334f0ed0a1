"""Cross-tokenizer alignment as an Arrow pipeline.

A batch of documents is two list columns of token ids. ``list_flatten`` and
``list_parent_indices`` turn them into token rows, cumulative sums of token
byte lengths, less the sum at the document's start, give each token's end, and
an Acero hash join on (document, end) finds the ends both tokenizers share:
every one is a link of an A token to a B token and closes a group. Group texts
are built by nested ``binary_join``; ``Table.group_by`` counts the block's id
pairs, and Spark merges these partial counts over the corpus.

A block is some megabytes of text (a longer document is a block by itself). Its
links travel as positions in the block's pair list, so the corpus-wide counts
come back once per block and pair, not once per link, and meet the block's
documents in one cogroup of bounded size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_chunks import Bpe, batches_by_bytes, default_tokenizer
from .common import arrow_rows, cut_lineage

#: Characters of text in a block, and in a part of it that is tokenized at a time.
BLOCK_CHARS = 4 << 20
PART_CHARS = 1 << 18

_ROW = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                  ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.list_(pa.int32())),
                  ("at", pa.int32()), ("a_id", pa.int32()), ("b_id", pa.int32()), ("n", pa.int64())])
_ROW_DDL = ("block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>, "
            "at int, a_id int, b_id int, n long")
_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
_OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.a = Bpe(a_path)
        self.a.t.encode_special_tokens = True
        self.fast = _ranked(self.a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = pa.array(self.a.bytes_of, pa.binary())
        self.b_bytes = pa.array([bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                                 else self.b.id_to_piece(i).replace("▁", " ").encode()
                                 for i in range(self.b.get_piece_size())], pa.binary())

    def encode_a(self, wanted: list[bytes]) -> list[bytes]:
        """Ids of A, as little-endian 32-bit bytes. Texts with very long runs without a break go to the library itself."""
        plain = [self.fast is not None and not _LONG_RUN.search(w) for w in wanted]
        quick = iter(self.fast.encode_ordinary_batch([w.decode() for w, p in zip(wanted, plain) if p], num_threads=1) if any(plain) else ())
        slow = iter(self.a.encode([w for w, p in zip(wanted, plain) if not p]))
        return [np.array(next(quick), "<u4").tobytes() if p else next(slow) for p in plain]

    def encode(self, texts: list[str]) -> tuple[pa.ListArray, pa.ListArray]:
        """Ids of both tokenizers, lists of length 0 where the document has no tokens."""
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        ids = pa.list_(pa.int32())
        packed = self.encode_a(wanted)
        a = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, packed)]) // 4, pa.int32()),
                                     pa.array(np.frombuffer(b"".join(packed), "<i4")))
        b = pa.array(self.b.encode(texts, num_threads=1), ids)
        good = [x and y for x, y in zip(_spells(a, self.a_bytes, wanted), _spells(b, self.b_bytes, wanted))]
        if all(good):
            return a, b
        keep = pa.array(good)
        return tuple(pc.if_else(keep, x, pa.scalar([], ids)) for x in (a, b))


#: So many bytes without a change between space, letter and other are encoded by the library itself.
_LONG_RUN = re.compile(rb"[^\x00-\x20]{4000}|[\x00-\x20]{4000}")
#: The split of a plain byte-level pre-tokenizer (fixed).
_BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(a: Bpe):
    """The same vocabulary as ranks, which encodes several times faster: for a plain byte-level BPE whose n-th merge makes
    id 256 + n, so that ranks and merges say the same. None for any other tokenizer."""
    import tiktoken

    told = json.loads(a.t.to_str())
    pre, model = told["pre_tokenizer"] or {}, told["model"]
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model.get("merges", [])]
    if (told["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True)
            or model.get("type") != "BPE" or any(model["vocab"].get(m) != 256 + i for i, m in enumerate(merges))):
        return None
    ranks = {a.bytes_of[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("ranked", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


def _spells(ids: pa.ListArray, of: pa.BinaryArray, wanted: list[bytes]) -> list[bool]:
    """Whether each list's token bytes, joined, are the wanted ones."""
    tokens = pc.list_flatten(ids)
    spelled = of.take(tokens)
    ends = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(pc.binary_length(spelled).cast(pa.int64()))])
    data = spelled.buffers()[2]
    data = memoryview(data if data is not None else b"").cast("B")
    edge = ends.take(ids.offsets).to_pylist()
    return [e - s == len(w) and data[s:e] == w for s, e, w in zip(edge[:-1], edge[1:], wanted)]


def _ends(ids: pa.ListArray, lengths: pa.Array, key: str) -> pa.Table:
    """Token rows ``(doc, end, <key>, <key>_row)``; ``end``: bytes of the document up to the token's end."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    run = pc.cumulative_sum(lengths.take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), run]).take(ids.offsets.slice(0, len(ids)))
    return pa.table({"doc": doc, "end": pc.subtract(run, before.take(doc)), key: flat,
                     f"{key}_row": pa.array(np.arange(len(flat)))})


def _joined(values: pa.Array, after: pa.Array, by: str) -> pa.Array:
    """Consecutive strings joined; ``after``: how many are used up at the end of each list."""
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), after.cast(pa.int32())])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), by)


def link(pair: Pair, texts: list[str]) -> tuple[list[dict], pa.Table]:
    """``(rows, links)`` of documents: counts and digest a document, and ``links(doc, a, b)`` in order."""
    a, b = pair.encode(texts)
    left = _ends(a, pc.binary_length(pair.a_bytes).cast(pa.int64()), "a")
    right = _ends(b, pc.binary_length(pair.b_bytes).cast(pa.int64()), "b")
    met = left.join(right, keys=["doc", "end"], join_type="inner", use_threads=False).sort_by("a_row").combine_chunks()
    column = {c: met[c].combine_chunks() if met[c].num_chunks != 1 else met[c].chunk(0) for c in met.column_names}
    one = pc.add(column["a_row"], 1), pc.add(column["b_row"], 1)
    sides = [_joined(pc.list_flatten(x).cast(pa.string()), after, ",") for x, after in zip((a, b), one)]
    groups = pc.binary_join_element_wise(*sides, "|")
    per = pa.table({"doc": column["doc"]}).group_by("doc", use_threads=False).aggregate([([], "count_all")])
    n = [0] * len(texts)
    for d, k in zip(per["doc"].to_pylist(), per["count_all"].to_pylist()):
        n[d] = k
    whole = _joined(groups, pc.cumulative_sum(pa.array(n, pa.int64())), ";").to_pylist()
    n_a, n_b = pc.list_value_length(a).to_pylist(), pc.list_value_length(b).to_pylist()
    rows = [{"n_a": x, "n_b": y, "n_groups": k, "n_links": k, "groups_sha256": hashlib.sha256(g.encode()).hexdigest() if k else ""}
            for x, y, k, g in zip(n_a, n_b, n, whole)]
    return rows, pa.table({c: column[c] for c in ("doc", "a", "b")})


def _blocks(batches):
    """Rows of a task in blocks of about ``BLOCK_CHARS``, each a list of parts."""
    held, size = [], 0
    for rows in arrow_rows(batches):
        for part in batches_by_bytes(rows, "text", PART_CHARS):
            held.append(part)
            size += sum([len(r["text"] or "") for r in part])
            if size >= BLOCK_CHARS:
                yield held
                held, size = [], 0
    if held:
        yield held


_LOADED: dict[tuple[str, str], Pair] = {}


def _linked(a_path: str, b_path: str):
    def run(batches):
        if (a_path, b_path) not in _LOADED:
            _LOADED[a_path, b_path] = Pair(a_path, b_path)
        pair = _LOADED[a_path, b_path]
        first = TaskContext.get().partitionId() << 32
        for k, parts in enumerate(_blocks(batches)):
            rows, tables, start = [], [], 0
            for part in parts:
                made, links = link(pair, [r["text"] or "" for r in part])
                rows += [{"block": first + k, "doc_id": r["doc_id"]} | m for r, m in zip(part, made)]
                tables.append(links.set_column(0, "doc", pc.add(links["doc"], start).cast(pa.int64())))
                start += len(part)
            links = pa.concat_tables(tables)
            code = pc.add(pc.multiply(links["a"].cast(pa.int64()), 1 << 32), links["b"].cast(pa.int64()))
            count = pa.table({"code": code}).group_by("code", use_threads=False).aggregate([([], "count_all")])
            codes = count["code"].combine_chunks()
            at = pc.index_in(code, value_set=codes).combine_chunks()
            offsets = pa.array([0] + [r["n_links"] for r in rows], pa.int32())
            lists = pa.ListArray.from_arrays(pc.cumulative_sum(offsets), at)
            docs = pa.Table.from_pylist(rows, schema=pa.schema([f for f in _ROW if f.name in rows[0]])).append_column("links", lists)
            a_id = pc.shift_right(codes, 32)
            pairs = pa.table({"block": pa.repeat(first + k, len(codes)).cast(pa.int64()), "at": pa.array(np.arange(len(codes), dtype=np.int32)),
                              "a_id": a_id.cast(pa.int32()), "b_id": pc.subtract(codes, pc.shift_left(a_id, 32)).cast(pa.int32()),
                              "n": count["count_all"]})
            for t in (docs, pairs):
                full = pa.table([t[f.name].cast(f.type) if f.name in t.column_names else pa.nulls(len(t), f.type) for f in _ROW], schema=_ROW)
                yield from full.combine_chunks().to_batches(max_chunksize=8192)
    return run


def _scored(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the corpus counts of their links."""
    if not len(docs):
        return _OUT.empty_table()
    counts = counts.sort_by("at")
    lists = docs["links"].combine_chunks()
    flat, doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
    total, best = (counts[c].combine_chunks().take(flat) for c in ("total", "best"))
    per = pa.table({"doc": doc, "total": total, "best": best.cast(pa.int64())}).group_by("doc", use_threads=False).aggregate(
        [("total", "sum"), ("best", "sum")])
    where = pc.index_in(pa.array(np.arange(len(docs))), value_set=per["doc"].cast(pa.int64()).combine_chunks())
    pick = lambda c: pc.fill_null(per[c].combine_chunks().take(where), 0).cast(pa.int64())
    made = {"n_best": pick("best_sum"), "count_sum": pick("total_sum")}
    return pa.table([made[f.name] if f.name in made else docs[f.name] for f in _OUT], schema=_OUT)


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Links between the tokens of two tokenizers for every whole text of ``docs(doc_id, text)``.

    ``(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)``, one row per input row. A (byte-level)
    reads a space and the text, B (pieces) the text. Null and empty texts, and texts that either side does not spell
    back byte by byte, have zeros and an empty digest column, and count nowhere. Rows that repeat a doc_id (or have
    none) are aligned and counted one by one; a very long text is a block by itself; an empty table has no rows; other
    columns are not read.
    """
    a_path, b_path = a_path or default_tokenizer(), b_path or default_pieces()
    table = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                        .mapInArrow(_linked(a_path, b_path), _ROW_DDL), "alignment")
    pairs = table.where("at IS NOT NULL").select("block", "at", "a_id", "b_id", "n")
    merged = pairs.groupBy("a_id", "b_id").agg(F.sum("n").alias("total"))
    merged = cut_lineage(merged, "alignment-counts")
    top = merged.groupBy("b_id").agg(F.max("total").alias("top"))
    ranked = merged.join(top, "b_id").select("a_id", "b_id", "total", (F.col("total") == F.col("top")).alias("best"))
    known = pairs.join(ranked, ["a_id", "b_id"]).select(F.col("block").alias("of"), "at", "total", "best")
    rows = table.where("at IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")
    return rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_scored, _OUT_DDL)
