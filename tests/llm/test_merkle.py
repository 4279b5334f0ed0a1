"""Merkle manifest: the log against a plain recursive tree, witnesses, and the operator's edge cases."""

import hashlib
import random

import pytest

from cadenza.llm import merkle
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, root string, witness string, node string"


def h(nodes):
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def plain_tree(nodes):
    """(root, proofs) of hex nodes; a proof is a list of (place, siblings)."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a // 8 * 8:a // 8 * 8 + 8]
            proofs[i].append((a % 8, run[:a % 8] + run[a % 8 + 1:]))
            at[i] = a // 8
        level = [h(level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], proofs


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 520, 4096])
def test_log(n):
    leaves = [hashlib.sha256(bytes([i % 251, i // 251])).digest() for i in range(n)]
    log = merkle.Log()
    for x in leaves:
        log.append(x)
    root, proofs = plain_tree([x.hex() for x in leaves])
    assert log.close().hex() == root
    for x, w, p in zip(leaves, log.witness, proofs):
        assert [(a, [s.hex() for s in run]) for a, run in merkle.steps_of(bytes(w))] == p
        assert merkle.fold(x, bytes(w)).hex() == root


def test_partial_block_reaches_its_level():
    log = merkle.Log()
    log.append(b"\1" * 32)
    want = "01" * 32
    for _ in range(merkle.BLOCK_LEVELS):
        want = h([want])
    assert log.close(merkle.BLOCK_LEVELS).hex() == want


def brute(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, t, g, s, n: hashlib.sha256("".join(map(field, (d, s, g, n, t))).encode()).hexdigest()
    groups = {}
    if not rows:
        return []
    for r in rows:
        groups.setdefault(r[2], []).append((-1 if r[0] is None else r[0], leaf(*r), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: x[:2])
        trees[g] = plain_tree([x[1] for x in groups[g]])
    root, tops = plain_tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for (_, lf, r), proof in zip(groups[g], trees[g][1]):
            path = proof + tops[k]
            bad = r[0] is not None and r[0] % 2 == 0
            node = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if r[1] is not None else None, *r[2:]) if bad else lf
            for place, run in path:
                node = h(run[:place] + [node] + run[place:])
            out.append((-1 if r[0] is None else r[0], lf, trees[g][0], root, h([s for _, run in path for s in run]), node, node == root))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, "g", 1, "r", "w", "n") for r in rows], DOCS)
    made = merkle.manifest(df, F.col("doc_id") % 2 == 0)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in made.collect())
    assert got == brute(rows)


def test_manifest_edges(spark):
    check(spark, [])
    check(spark, [(5, "Only", "en", "s", 4)])
    rnd = random.Random(3)
    rows = [(rnd.randrange(60), rnd.choice(["", None, "Abc", "é ß", "x" * 100_000, "lower"]), rnd.choice([None, "", "en", "é", "-", "=en"]),
             rnd.choice([None, "web"]), rnd.choice([None, 3])) for _ in range(120)]
    rows += [(None, "A", "en", "s", 1), (None, None, None, None, None), rows[0], rows[0]]
    check(spark, rows)


def test_several_rounds_and_many_languages(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, f"Text {i}", "hot" if i % 3 else f"l{i % 33}", "s", i) for i in range(0, 700)]
    check(spark, rows)
