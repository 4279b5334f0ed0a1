"""Tokenizer alignment against plain loops."""

import hashlib
from collections import Counter
from itertools import accumulate

from cadenza.llm import alignment

DOCS = "doc_id long, text string, block long, at int, links string, total long, a_id string"


def brute(rows):
    pair = alignment.Pair(alignment.default_tokenizer(), alignment.default_pieces())
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(alignment.default_tokenizer())
    lib.encode_special_tokens = True
    ab, bb = pair.a_bytes.to_pylist(), pair.b_bytes.to_pylist()
    made, count = [], Counter()
    for d, t in rows:
        whole = (" " + t).encode() if t else b""
        a = lib.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        if b"".join(ab[i] for i in a) != whole or b"".join(bb[i] for i in b) != whole:
            a, b = [], []
        ea, eb = list(accumulate(len(ab[i]) for i in a)), list(accumulate(len(bb[i]) for i in b))
        links, groups, ga, gb, seen = [], [], [], [], set(eb)
        j = 0
        for i, e in zip(a, ea):
            ga.append(str(i))
            if e in seen:
                while j < len(b):
                    gb.append(str(b[j]))
                    j += 1
                    if eb[j - 1] == e:
                        break
                links.append((i, b[j - 1]))
                groups.append(",".join(ga) + "|" + ",".join(gb))
                ga, gb = [], []
        made.append((d, len(a), len(b), links, groups))
        count.update(links)
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    return sorted((-1 if d is None else d, a, b, len(g), len(ls), sum(count[x] == top[x[1]] for x in ls), sum(count[x] for x in ls),
                   hashlib.sha256(";".join(g).encode()).hexdigest() if a else "") for d, a, b, ls, g in made)


def check(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 1, 2, "x", 3, "y") for r in rows], DOCS).repartition(parts)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                 for r in alignment.align(df).collect())
    assert got == brute(rows)


def test_edges(spark):
    check(spark, [])
    check(spark, [(1, None)])
    rows = [(1, "The quick brown fox"), (2, "the quick  brown\nfox."), (3, ""), (None, "a"), (None, "a"), (4, None), (5, "a▁b"),
            (6, "<|endoftext|> </s> <unk>"), (7, "Grüße, 世界! \U0001f600‍"), (7, "Grüße, 世界! \U0001f600‍"), (8, " leading and trailing "),
            (9, "naïve " * 5000), (10, "x" * 30_000), (11, "\t\r\n\x0b\x00  　")]
    check(spark, rows)


def test_blocks_and_parts(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    words = ["alpha", "Beta", "gamma's", "délta", "1234", "—", "word", "tokens"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(300)]
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 2000)
    monkeypatch.setattr(alignment, "PART_CHARS", 500)
    check(spark, rows, 2)


def test_ranks_encode_as_the_tokenizer():
    import random

    import numpy as np

    pair = alignment.Pair(alignment.default_tokenizer(), alignment.default_pieces())
    assert pair.fast is not None
    rnd = random.Random(5)
    tokens = [x.decode("utf-8", "ignore") for x in pair.a_bytes.to_pylist()[:50_000]]
    texts = ["".join(rnd.choice(tokens) for _ in range(30)) for _ in range(1500)]
    # every code point of the first planes by turns, beside letters, digits, signs and white space
    texts += [f" a{c}a 1{c}1 {c}{c}'s  {c}\n {c} \t{c}.{c}" for c in map(chr, [*range(0, 0x3000), *range(0x3000, 0xD800, 37), *range(0xE000, 0x110000, 997)])]
    texts += ["y" * 9000, " " * 9000 + "x", "<|endoftext|>", "\u00a0" * 5000]
    want = [e.ids for e in pair.a.t.encode_batch_fast(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in pair.encode_a([t.encode() for t in texts])] == want
