"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the bytes cuts texts into chunks, so that a passage shared
by many documents is cut the same way in each of them. Every task encodes a
chunk it has met before from its cache. Where two chunks join, tokens may
differ from those of the whole text; the join is re-encoded from the last
settled boundary on its left to the first on its right, growing over further
chunks until both sides are settled, and then agrees exactly with the whole
text's tokens.

A boundary is settled in front of a space or line end that follows a character
other than white space: the byte-level pre-tokenizer never lets a word reach
over it and never looks back over it. Inside a new chunk the pieces between
settled boundaries have a cache of their own, so the tokenizer itself runs on
new pieces only.

Documents are encoded where they are read; nothing is shuffled. The caches
hold a bounded number of bytes and are emptied when full.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: A chunk ends where the low bits of the rolling hash are zero: every 2**CHUNK_BITS bytes on average.
CHUNK_BITS = 8
#: The rolling hash sees this many bytes.
WINDOW = 16
#: Bounds of the caches of a task. A piece met twice moves from the second to the first.
PIECE_ENTRIES = 300_000
SEEN_ENTRIES = 200_000
CHUNK_BYTES = 24 << 20
#: Pieces longer than this are not cached.
LONG_PIECE = 64


#: The n-th keeps the lowest n bytes of a word.
_LOW_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as one character: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """A byte-level tokenizer file with piece and chunk caches. Ids travel as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.no_truncation()
        self.t.no_padding()
        pre = self.t.pre_tokenizer.__getstate__() if self.t.pre_tokenizer is not None else b"{}"
        added = [a.content.encode() for a in self.t.get_added_tokens_decoder().values()]
        lead = [a for a in self.t.get_added_tokens_decoder().values() if a.lstrip or a.rstrip or a.single_word]
        #: Pieces may be encoded alone only for a plain byte-level tokenizer without special space rules.
        self.by_pieces = (b'"ByteLevel"' in pre and b'"add_prefix_space":false' in pre and self.t.normalizer is None
                          and not lead and not any(b" " in a for a in added))
        self.pieces: dict[bytes, bytes] = {}
        self.seen: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, bytes] = {}
        self.chunk_bytes = 0
        char = _byte_of_char()
        special = self.t.get_added_tokens_decoder()
        self.bytes_of = []
        for i in range(self.t.get_vocab_size(with_added_tokens=True)):
            s = special[i].content if i in special else self.t.id_to_token(i) or ""
            self.bytes_of.append(bytes(char[c] for c in s) if all(c in char for c in s) else s.encode())

    def _run(self, texts: list[bytes]) -> list[bytes]:
        made = self.t.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in made]

    def _piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, from the caches or the tokenizer."""
        known, seen = self.pieces, self.seen
        out = [known.get(w) for w in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        again = {i: seen.pop(pieces[i]) for i in missing if pieces[i] in seen}
        new = [i for i in missing if i not in again]
        fresh = dict(zip(new, self._run([pieces[i] for i in new]))) if new else {}
        if len(known) + len(again) > PIECE_ENTRIES:
            known.clear()
        if len(seen) + len(fresh) > SEEN_ENTRIES:
            seen.clear()
        for i, x in again.items():
            out[i] = known[pieces[i]] = x
        for i, x in fresh.items():
            out[i] = x
            if len(pieces[i]) <= LONG_PIECE:
                seen[pieces[i]] = x
        return out

    def encode_spans(self, spans: list[tuple[bytes, np.ndarray]]) -> list[bytes]:
        """Ids of spans, each given with the settled positions that split it (its start first, its end not).

        Equal pieces of up to 24 bytes are found by their bytes read as three integers; longer ones stand alone."""
        if not spans:
            return []
        sizes = np.array([len(s) for s, _ in spans])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        blob = b"".join([s for s, _ in spans])
        start = np.concatenate([at + o for (_, at), o in zip(spans, begin.tolist())])
        end = np.append(start[1:], len(blob))
        length = end - start
        word = np.ndarray(len(blob) + 17, "<u8", blob + bytes(32), strides=(1,))
        keys = []
        for k in range(3):
            left = np.clip(length - 8 * k, 0, 8)
            keys.append(word[np.minimum(start + 8 * k, len(blob))] & _LOW_BYTES[left])
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k in (*keys[1:], length.astype(np.uint64)):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + k * np.uint64(0x94D049BB133111EB)
        _, first, which = np.unique(mixed, return_index=True, return_inverse=True)
        rep = first[which]
        alone = length > 24
        for k in (*keys, length):
            alone |= k != k[rep]
        alone = np.flatnonzero(alone)
        which[alone] = len(first) + np.arange(len(alone))
        first = np.concatenate((first, alone))
        ids = self._piece_ids([blob[a:b] for a, b in zip(start[first].tolist(), end[first].tolist())])
        count = np.array([len(x) // 4 for x in ids])
        table = np.frombuffer(b"".join(ids), "<u4")
        offset = np.cumsum(count) - count
        n = count[which]
        upto = np.concatenate(([0], np.cumsum(n)))
        flat = table[np.repeat(offset[which] - upto[:-1], n) + np.arange(upto[-1])]
        edge = upto[np.searchsorted(start, begin)].tolist()
        return [flat[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])]

    def settled(self, data: bytes) -> np.ndarray:
        """Positions in front of which a text may be split without changing a token."""
        if not self.by_pieces or len(data) < 2:
            return np.empty(0, np.int64)
        b = np.frombuffer(data, np.uint8)
        solid = (b > 32) & (b < 127)  # white space outside ASCII never looks like this
        solid[1:] |= (b[:-1] >= 0xC3) & (b[:-1] < 0xE0) & (b[1:] >= 128)
        # of three bytes: no white space but in E1 9A, E1 A0 (once), E2 80, E2 81 and E3 80; of four: none
        lead, mid = b[:-2], b[1:-1]
        solid[2:] |= (lead >= 0xE0) & (lead < 0xF0) & (
            (lead != 0xE1) | (mid != 0x9A) & (mid != 0xA0)) & ((lead != 0xE2) | (mid > 0x81)) & ((lead != 0xE3) | (mid != 0x80))
        solid[3:] |= b[:-3] >= 0xF0
        gap = (b == 32) | (b == 10)
        return np.flatnonzero(gap[1:] & solid[:-1]) + 1

    def cuts(self, data: bytes) -> np.ndarray:
        """Ends of the chunks: positions whose last ``WINDOW`` bytes hash to zero in the low bits."""
        if len(data) <= WINDOW:
            return np.empty(0, np.int64)
        h = np.frombuffer(data, np.uint8).astype(np.uint32) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        span, size = h, 1
        while size < WINDOW:  # sums over 2, 4, 8, 16 bytes, the older half multiplied, so that order counts
            span = span[:-size] * np.uint32(0x85EBCA6B + 2 * size) + span[size:]
            size *= 2
        span ^= span >> np.uint32(16)
        return np.flatnonzero((span & np.uint32((1 << CHUNK_BITS) - 1)) == 0) + WINDOW

    def split_chunks(self, data: bytes) -> list[tuple[bytes, np.ndarray, bool]]:
        """The text as ``(span, settled positions inside, is_body)``: chunk bodies between the first and the last
        settled boundary of a chunk, and the joins between them. A chunk without two settled boundaries is part of
        a join, which so grows until it is settled on both sides."""
        at = self.settled(data)
        ends = self.cuts(data)
        # a chunk's body: from its first settled boundary to its last one, the text's own ends being settled
        edge = np.concatenate(([0], at, [len(data)]))
        limit = np.unique(np.concatenate(([0], ends, [len(data)])))
        first = np.searchsorted(edge, limit[:-1], "left")
        last = np.searchsorted(edge, limit[1:], "right") - 1
        marks = [0]
        for f, l in zip(first.tolist(), last.tolist()):
            if l > f:
                marks += [f, l]
        marks.append(len(edge) - 1)
        out = []
        for k, (i, j) in enumerate(zip(marks[:-1], marks[1:])):
            a, b = int(edge[i]), int(edge[j])
            if b > a:
                out.append((data[a:b], edge[i:j] - a, k % 2 == 1))
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of whole texts, equal to those of the tokenizer on each whole text."""
        split = [self.split_chunks(x) for x in texts]
        new: dict[bytes, np.ndarray] = {}
        for spans in split:
            for s, at, _ in spans:
                if s not in self.chunks and s not in new:
                    new[s] = at
        fresh = dict(zip(new, self.encode_spans(list(new.items()))))
        out = [b"".join([fresh[s] if s in fresh else self.chunks[s] for s, _, _ in spans]) for spans in split]
        kept = {s: fresh[s] for spans in split for s, _, body in spans if body and s in fresh}
        size = sum(len(s) + len(i) + 150 for s, i in kept.items())
        if self.chunk_bytes + size > CHUNK_BYTES:
            self.chunks, self.chunk_bytes = {}, 0
        if size <= CHUNK_BYTES:
            self.chunks.update(kept)
            self.chunk_bytes += size
        return out

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes joined, sequences that are not UTF-8 replaced."""
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Bpe] = {}


def tokenizer(path: str) -> Bpe:
    """The tokenizer and its caches, kept while the Python worker lives."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def batches_by_bytes(rows: list[dict], key: str, limit: int = 1 << 21):
    """Sublists of about ``limit`` characters, whatever the length of single texts."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += len(r[key] or "")
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(<id_col>, ids)`` with ids as little-endian unsigned 32-bit bytes, one row per input row, for every whole text.
    A null text has no ids; repeated rows are encoded one by one (from the cache); other columns are not read."""
    path = path or default_tokenizer()

    def make():
        t = tokenizer(path)

        def run(rows):
            for part in batches_by_bytes(rows, "_text"):
                yield from zip([r["_id"] for r in part], t.encode([(r["_text"] or "").encode() for r in part]))
        return run

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")),
                    pa.schema([(id_col, pa.int64()), ("ids", pa.binary())]), f"`{id_col}` long, ids binary", make)


def encode_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``(<id_col>, n_tokens, ids_sha256, decoded_sha256)``: encode, decode the ids again, digest both; rows as in
    ``encode_documents``."""
    path = path or default_tokenizer()

    def make():
        t = tokenizer(path)

        def run(rows):
            for part in batches_by_bytes(rows, "_text"):
                for r, ids in zip(part, t.encode([(r["_text"] or "").encode() for r in part])):
                    yield (r["_id"], len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                           hashlib.sha256(t.decode(ids).encode()).hexdigest())
        return run

    return map_rows(docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")),
                    pa.schema([(id_col, pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]),
                    f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
