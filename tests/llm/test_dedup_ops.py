"""Exact, suffix and chosen-path dedup against brute force, with the edge cases of their docstrings."""

import numpy as np
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cadenza.llm import chosen_path, exact_dedup, suffix_dedup

DOCS = "doc_id long, text string, kept string, n long, key string, seg string"


def docs_df(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", 1, "k", None) for d, t in rows], DOCS)


def words(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" for _ in range(n))


def test_exact_dedup(spark):
    rows = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "abc "), (7, "abc "), (None, "abc"), (9, "x" * 200_000), (10, "X" * 200_000)]
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(docs_df(spark, rows), keep="max").collect())
    want = []
    low = [(d, (t or "").encode().lower()) for d, t in rows]
    for d, t in low:
        same = [x for x, y in low if y == t]
        keep = max(x for x in same if x is not None)
        want.append((d or 0, keep, len(same), d == keep, hashlib.sha256(t).hexdigest()))
    assert got == sorted(want)
    assert exact_dedup.exact_dedup(docs_df(spark, []), keep="max").count() == 0
    assert {r.keep_id for r in exact_dedup.exact_dedup(docs_df(spark, rows[:2])).collect()} == {1}


def brute_components(rows, k, pct):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}
    comp = {d: d for d in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                comp[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), root(d)) for d in sets}


def near_rows(seed):
    rnd = random.Random(seed)
    rows, d = [], 0
    for _ in range(12):
        base = words(rnd, rnd.randrange(30, 120)).split()
        for _ in range(rnd.randrange(1, 14)):
            w = list(base)
            for _ in range(rnd.randrange(0, 4)):
                w[rnd.randrange(len(w))] = f"v{rnd.randrange(1000)}"
            rows.append((d, " ".join(w).upper() if rnd.random() < 0.2 else " ".join(w)))
            d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, " \t\n"), (d + 3, "one two"), (d + 4, "One  Two"), (d + 5, "three"), (d + 6, words(rnd, 60_000, 50_000))]
    return rows


@pytest.mark.parametrize("leaf", [64, 3])
def test_near_dedup_finds_every_link(spark, monkeypatch, leaf):
    """With tiny leaves the large-node paths (dealing, branching, block against block) run as well."""
    monkeypatch.setattr(chosen_path, "LEAF", leaf)
    monkeypatch.setattr(chosen_path, "FEW", 256 if leaf == 64 else 2)
    monkeypatch.setattr(chosen_path, "DEPTH", 2)
    rows = near_rows(leaf)
    want = brute_components(rows, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in chosen_path.near_dedup(docs_df(spark, rows), words=4).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_near_dedup_edges(spark):
    assert chosen_path.near_dedup(docs_df(spark, [])).count() == 0
    got = chosen_path.near_dedup(docs_df(spark, [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in got) == [(-1, None, True), (2, 2, True), (2, 2, True)]


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i:i + length]] = count.get(b[i:i + length], 0) + 1
    out = []
    for b in data:
        hit = [False] * len(b)
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                hit[i:i + length] = [True] * length
        spans = sum(h and (i == 0 or not hit[i - 1]) for i, h in enumerate(hit))
        out.append((len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest()))
    return out


@pytest.mark.parametrize("width", [13, 1, 200])
def test_suffix_dedup(spark, width):
    """With a ``width`` of 1 blocks are single strings; with 200 each surroundings is one block, looked up string by string."""
    rnd = random.Random(5)
    shared = ["".join(rnd.choice("abcdé \n") for _ in range(rnd.randrange(150, 420))) for _ in range(6)]
    texts = [None, "", "short", "ab" * 300, "x" * 199, "x" * 200]
    for _ in range(40):
        parts = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(300)))]
        for _ in range(rnd.randrange(3)):
            s = rnd.choice(shared)
            parts += [s[rnd.randrange(60):len(s) - rnd.randrange(60)], "".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(80)))]
        texts.append("".join(parts))
    texts += [texts[-1], texts[-2][:230], "y" * 900]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs_df(spark, rows), width=width).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 200)))


@pytest.mark.parametrize("batches", [1, 5])
def test_suffix_dedup_of_a_line_in_many_surroundings(spark, batches):
    """One line of 190 bytes, with few and with many different neighbours on each side, in one batch and over uneven levels."""
    rnd = random.Random(11)
    line = "".join(rnd.choice("abcdefghij") for _ in range(190))
    few = ["".join(rnd.choice("klm ") for _ in range(40)) for _ in range(3)]
    rows = []
    for i in range(120):
        own = "".join(rnd.choice("nopqrs") for _ in range(rnd.randrange(30)))
        before, after = rnd.choice([own, rnd.choice(few)]), rnd.choice([own, rnd.choice(few)[:rnd.randrange(41)]])
        rows.append((i, f"{own}{before}{line}{after}{own[::-1]}"))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
           for r in suffix_dedup.remove_repeats(docs_df(spark, rows), batches=batches).collect()}
    want = dict(enumerate(brute_repeats([t for _, t in rows], 200)))
    assert got == want and 0 < sum(w[1] > 0 for w in want.values()) < len(want)


def test_suffix_dedup_edges(spark, monkeypatch):
    assert suffix_dedup.remove_repeats(docs_df(spark, [])).count() == 0
    t = "".join(random.Random(1).choice("abc") for _ in range(300))
    got = suffix_dedup.remove_repeats(docs_df(spark, [(1, t), (1, t), (None, "q")]).withColumn("spans", F.lit(1))).collect()
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in got) == [(0, 0, 0), (1, 300, 1), (1, 300, 1)]


def test_sync_points_of_long_texts_cover_every_start(monkeypatch):
    data = bytes(random.Random(2).randrange(97, 123) for _ in range(7000))
    for size in (1 << 20, 1000):
        monkeypatch.setattr(suffix_dedup, "SLICE", size)
        starts = sorted(s for _, a, z, _ in suffix_dedup.sync_points(data) for x, y in zip(a, z) for s in range(x, y + 1))
        assert starts == list(range(len(data) - 200 + 1))


def test_bin_sketch_keeps_links_and_drops_clear_non_links():
    rng = np.random.default_rng(5)
    for n in (1, 4, 5, 30, 400, 3000, 40_000):
        both = -(-8 * n // 10)  # at the threshold: 0.8 of the union is shared
        rest = n - both
        f, g, fn, gn, far = [], [], [], [], []
        for _ in range(60):
            h = rng.integers(0, 1 << 63, n + 2 * n, dtype=np.uint64) * np.uint64(2)
            cut = rest // 2
            a, b = np.unique(h[:both + cut]), np.unique(np.concatenate((h[:both], h[both + cut:n])))
            f.append(chosen_path.bin_sketch(a))
            g.append(chosen_path.bin_sketch(b))
            fn.append(len(a))
            gn.append(len(b))
            far.append(chosen_path.bin_sketch(np.unique(np.concatenate((a[:len(a) // 3], h[n:n + len(a) - len(a) // 3])))))
        f, g, far = np.array(f), np.array(g), np.array(far)
        fn, gn = np.array(fn), np.array(gn)
        assert chosen_path.may_link(f, g, fn, gn, 80).all()
        if n >= 30:
            assert not chosen_path.may_link(f, far, fn, fn, 80).any()
    assert not len(chosen_path.may_link(f[:0], g[:0], fn[:0], gn[:0], 80))
