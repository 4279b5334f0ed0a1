"""Merkle manifest of a table: incremental witnesses over streamed, aligned appends.

A log of nodes grows by appends. Every node of an *open* run (fewer than
``ARITY`` siblings so far) stands for an open subtree and holds the partial
witnesses of the leaves below it. When a later sibling completes the run, all
these witnesses are extended by the run's other nodes, and the run's digest is
appended to the log one level up (``Log``).

Distributed, the leaves of a key are numbered, cut into aligned blocks of
``ARITY ** BLOCK_LEVELS`` and streamed through one ``Log`` a block; the block
roots are then further appends of the same kind, and so are the roots of the
keys. A leaf's witness is what its own block attached plus what the later
rounds attached to its block's root. There are as many rounds as a key's count
has digits in base 4096, and no task holds more than a block.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, ascii_lower, cut_lineage

ARITY = 8
BLOCK_LEVELS = 4
BLOCK = ARITY ** BLOCK_LEVELS


def digest(nodes: list[bytes]) -> bytes:
    """H of digests: SHA-256 over their lower-case hex texts, concatenated."""
    return hashlib.sha256(b"".join([n.hex().encode() for n in nodes])).digest()


class Log:
    """Append-only tree of one block. ``witness[i]`` belongs to the i-th leaf appended: for each level up to where its
    subtree is still open, one byte (place in the run), one byte (siblings), then the siblings' digests."""

    def __init__(self) -> None:
        self.witness: list[bytearray] = []
        self.open: list[list[tuple[bytes, int, int]]] = [[]]  # by level: (node, first leaf below it, last + 1)

    def append(self, leaf: bytes) -> None:
        self.witness.append(bytearray())
        self._push(0, (leaf, len(self.witness) - 1, len(self.witness)))

    def _push(self, level: int, node: tuple[bytes, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The run at ``level`` is whole: extend every witness below it, append its digest above."""
        run, self.open[level] = self.open[level], []
        for place, (_, first, end) in enumerate(run):
            step = bytes([place, len(run) - 1]) + b"".join([n for i, (n, _, _) in enumerate(run) if i != place])
            for w in self.witness[first:end]:
                w += step
        self._push(level + 1, (digest([n for n, _, _ in run]), run[0][1], run[-1][2]))

    def close(self, levels: int | None = None) -> bytes:
        """End of the block: complete what is open, up to ``levels`` or to where one node is left; its root."""
        level = 0
        while level < levels if levels is not None else len(self.open) > level + 1 or len(self.open[level]) > 1:
            if level < len(self.open) and self.open[level]:
                self._complete(level)
            level += 1
        return self.open[level][0][0]


def steps_of(witness: bytes):
    """``(place, siblings)`` of a witness, bottom up."""
    at = 0
    while at < len(witness):
        place, n = witness[at], witness[at + 1]
        yield place, [witness[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def fold(node: bytes, witness: bytes) -> bytes:
    """The root that ``node`` and the siblings of its witness give."""
    for place, run in steps_of(witness):
        node = digest([*run[:place], node, *run[place:]])
    return node


def witness_digest(witness: bytes) -> str:
    """Hex H over all siblings, level by level, left to right."""
    return digest([n for _, run in steps_of(witness) for n in run]).hex()


def number(nodes: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """``nodes`` plus ``pos`` (from 0 within ``key`` by ``order``) and ``total`` (nodes of the key).

    Range partitions on (key, order) split a hot key over tasks; the offset of each of its pieces comes from the
    row counts of the pieces before it, one row per partition and key.
    """
    cols = [f"`{c}`" for c in nodes.columns]
    sort = [key.asc_nulls_first(), *order]
    ranged = nodes.repartitionByRange(*sort).sortWithinPartitions(*sort)
    seen = cut_lineage(ranged.select(*cols, key.alias("_k"), F.spark_partition_id().alias("_pid"),
                                     F.monotonically_increasing_id().alias("_row")), "merkle-order")
    w = Window.partitionBy("_k").orderBy("_pid")
    pieces = seen.groupBy("_k", "_pid").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    pieces = pieces.select(F.col("_k").alias("_pk"), F.col("_pid").alias("_pp"),
                           (F.sum("_n").over(w) - F.col("_n") - F.col("_first")).alias("_shift"),
                           F.sum("_n").over(Window.partitionBy("_k")).alias("total"))
    joined = seen.join(pieces, F.col("_k").eqNullSafe(F.col("_pk")) & (F.col("_pid") == F.col("_pp")))
    return joined.select(*cols, (F.col("_row") + F.col("_shift")).alias("pos"), "total")


def _append_block(batches):
    """Rows of sorted blocks ``(grp, block, pos, total, node, ...)`` with the witness that their block attaches."""
    log = held = None

    def flush():
        log.close(None if held[0]["total"] <= BLOCK else BLOCK_LEVELS)
        rows = [r | {"witness": bytes(w)} for r, w in zip(held, log.witness)]
        for at in range(0, len(rows), 512):
            yield rows[at:at + 512]

    for rows in arrow_rows(batches):
        for r in rows:
            if held and (r["grp"], r["block"]) != (held[0]["grp"], held[0]["block"]):
                yield from flush()
                held = None
            if not held:
                log, held = Log(), []
            log.append(r["node"])
            held.append(r)
    if held:
        yield from flush()


def _attach(nodes: DataFrame) -> DataFrame:
    """One round of appends: ``nodes(grp, pos, total, node, ...)`` plus ``block`` and ``witness``, as a written table."""
    keyed = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    dealt = keyed.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    out = dealt.withColumn("witness", F.lit(b"")).schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for rows in _append_block(batches):
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return cut_lineage(dealt.mapInArrow(run, out), "merkle-witness")


@F.pandas_udf(T.BinaryType())
def _fold_udf(node, witness):  # noqa: ANN001, ANN202
    import pandas as pd

    return pd.Series([fold(n, w) for n, w in zip(node, witness)])


def _grow(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rounds over ``nodes(grp, pos, total, node, ...)``.

    ``(nodes with block and whole witness, roots(grp, root))``. The block roots of a round are the nodes of the next,
    until every group has one root; the witnesses of block roots extend those of the blocks."""
    rounds = [_attach(nodes)]
    roots = None
    while True:
        first = rounds[-1].where(F.col("pos") % BLOCK == 0)
        up = cut_lineage(first.select("grp", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"),
                                      _fold_udf("node", "witness").alias("node")), "merkle-roots")
        done = up.where("total = 1").select("grp", F.col("node").alias("root"))
        roots = done if roots is None else roots.unionByName(done)
        more = up.where("total > 1")
        if more.isEmpty():
            break
        rounds.append(_attach(more))
    while len(rounds) > 1:
        top = rounds.pop().select(F.col("grp").alias("_g"), F.col("pos").alias("_b"), F.col("witness").alias("_up"))
        below = rounds[-1]
        rounds[-1] = (below.join(top, (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_b")), "left")
                      .withColumn("witness", F.concat("witness", F.coalesce("_up", F.lit(b"")))).drop("_g", "_b", "_up"))
    return rounds[0], roots


def _field(col: Column) -> Column:
    s = col.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hex(*cols: Column) -> Column:
    """A row's leaf: hex SHA-256 over its fields, each ``-`` if null, else UTF-8 byte count, ``:``, value."""
    return F.sha2(F.concat(*[_field(c) for c in cols]), 256)


def _proofs(batches):
    for rows in arrow_rows(batches):
        out = []
        for r in rows:
            w, root = r["witness"], r["root"]
            got = fold(r["probe"], w)
            out.append({"doc_id": r["doc_id"], "leaf": r["node"].hex(), "subroot": r["subroot"].hex(), "root": root.hex(),
                        "proof_sha256": witness_digest(w), "folded_root": got.hex(), "verified": got == root,
                        "witness": w})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
             ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_()), ("witness", pa.binary())]))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaf, roots, witness and its check for every row of ``docs(doc_id, text, lang, source, n_chars)``.

    A tree per ``lang`` (null is a language of its own, first), leaves by doc_id (null first; rows that repeat an id by
    their digest), then a tree over the languages in the byte order of their UTF-8. ``tampered``: where true, the row is
    checked with the A-Z of its text lower-cased; its witness and the roots are those of the table as it is. Returns
    ``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, witness)``, a row per input row. A null
    text stays null, an empty one counts 0 bytes; an empty table has no rows; other columns are not read.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    changed = ascii_lower(F.col("text"))
    flag = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    leaf, other = leaf_hex(*fields), leaf_hex(*fields[:-1], changed)
    leaves = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                                     F.unhex(leaf).alias("node"), F.when(flag, F.unhex(other)).alias("probe")), "merkle-leaves")
    placed = number(leaves, F.col("lang"), [F.col("doc_id").asc_nulls_first(), F.col("node").asc()])
    # a group's key is never null: "-" for no language, else "=" and the language
    group = F.when(F.col("lang").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), "lang"))
    rows, subroots = _grow(placed.select(group.alias("grp"), "pos", "total", "node", "doc_id", "probe"))
    tops = cut_lineage(subroots.select(F.col("grp").alias("member"), F.col("root").alias("node")), "merkle-subroots")
    joint, root = _grow(number(tops, F.lit("*"), [F.col("member").cast("binary").asc()])
                        .select(F.lit("*").alias("grp"), "pos", "total", "node", "member"))
    ends = joint.join(root, "grp").select(F.col("member").alias("grp"), F.col("node").alias("subroot"), "root",
                                          F.col("witness").alias("_top"))
    whole = rows.join(ends, "grp").select("doc_id", "node", F.coalesce("probe", "node").alias("probe"), "subroot", "root",
                                          F.concat("witness", "_top").alias("witness"))
    return whole.mapInArrow(_proofs, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
                                     "folded_root string, verified boolean, witness binary")
