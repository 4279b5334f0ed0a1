"""Locally consistent parsing, and the query's operator against a plain version."""

import hashlib
import random

import numpy as np

from cadenza.llm import fingerprints as fp

DOCS = "doc_id long, text string, piece int, edge int, following string, own string"


def prose(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randrange(2, 9))) for _ in range(800)]
    return " ".join(rnd.choice(words) for _ in range(n))


def test_parse_is_locally_consistent():
    base = prose(1, 3000).encode()
    lead = prose(2, 11).encode()
    a = {lv: n.tolist() for lv, n, _ in fp.parse([base])}
    b = {lv: n.tolist() for lv, n, _ in fp.parse([lead + base + lead])}
    for level in (1, 2, 3, 4):
        # all but a few phrases at the ends reappear, in the same order
        inner = a[level][8:-8]
        at = next(i for i in range(len(b[level])) if b[level][i:i + 5] == inner[:5])
        assert b[level][at:at + len(inner)] == inner


def test_parse_shrinks_and_ends():
    texts = [b"a", b"aa", b"a" * 100_000, b"ab" * 5000, bytes(range(256)) * 3, prose(3, 500).encode(), b"\xff\x00"]
    last, seen = None, set()
    for level, names, doc in fp.parse(texts):
        if level > 1:
            assert len(names) < last[0] or len(np.unique(last[1])) == last[0]
        n = np.bincount(doc, minlength=len(texts))
        seen |= set(np.flatnonzero(n == 1).tolist())
        last = (len(names), doc)
    assert seen == set(range(len(texts)))


def test_alone_or_in_a_batch():
    texts = [prose(i, 5 + 37 * i).encode() for i in range(12)] + [b"", b"x", b"", b"yyyyyy", b"x"]
    whole = fp.fingerprints(texts)
    assert whole == [fp.fingerprints([t])[0] for t in texts]
    assert whole[-1] == whole[-4] and whole[12] == b""
    assert len(set(whole)) == len(set(texts))


def test_likeness():
    a = prose(5, 2000)
    ids = [fp.fingerprints([t.encode()])[0] for t in (a, a, prose(6, 2000), a[:8000] + prose(7, 900), "", "", "b")]
    near = lambda i, j: fp.likeness([ids[i]], [ids[j]])[0]
    assert near(0, 1) == 1 and near(4, 5) == 1 and near(4, 6) == 0 and near(6, 4) == 0
    assert near(0, 2) < 0.1 < near(0, 3)
    small = prose(8, 3000)
    one, two = small, small.replace(" ", "  ", 1)
    assert fp.likeness(fp.fingerprints([one.encode()]), fp.fingerprints([two.encode()]))[0] > 0.85


def brute(rows):
    key = lambda r: (r[0] is not None, r[0] or 0)
    rows = sorted(((d, t or "") for d, t in rows), key=key)
    out = []
    for k, (d, t) in enumerate(rows):
        f = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[:len(t) - n] + f[:n]
        x, y, z = (fp.fingerprints([s.encode()])[0] for s in (t, e, f))
        out.append((-1 if d is None else d, len(t), hashlib.sha256(e.encode()).hexdigest(), x.hex(), y.hex(),
                    float(fp.likeness([x], [y])[0]), float(fp.likeness([x], [z])[0])))
    return sorted(out)


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "f", "o") for r in rows], DOCS).repartition(4)
    assert sorted((-1 if r.doc_id is None else r.doc_id, *list(r)[1:]) for r in fp.compare_with_edits(df).collect()) == brute(rows)


def test_operator(spark, monkeypatch):
    check(spark, [])
    check(spark, [(3, "only one document, followed by itself")])
    rows = [(i, prose(i, i % 17 * 9)) for i in range(150)] + [(None, "null id ÄÖÜ"), (200, None), (201, ""), (202, "ab"), (203, "Grüße 世界" * 3000),
                                                            (204, "tie"), (204, "tie")]
    monkeypatch.setattr(fp, "BATCH_CHARS", 700)
    check(spark, rows)


def test_repeated_ids_have_a_fixed_order(spark):
    rows = [(1, prose(k, 30)) for k in range(40)] + [(None, prose(k, 20)) for k in range(50, 60)]
    one, two = (sorted(map(tuple, fp.compare_with_edits(spark.createDataFrame(x, "doc_id long, text string").repartition(n)).fillna(-1).collect()))
                for x, n in ((rows, 2), (rows[::-1], 5)))
    assert one == two and len(one) == len(rows)
