"""Settled boundaries outside ASCII: they are there, and tokens stay the whole text's."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cadenza.llm import bpe_chunks

SPACES = [chr(c) for c in (0x20, 0x0a, 0x09, 0x85, 0xa0, 0x1680, 0x180e, 0x2000, 0x200a, 0x2028, 0x2029, 0x202f, 0x205f, 0x3000)]
LETTERS = list("aZ9.,'") + list("éяжΩωعربيअक한글漢字ქ、。") + list("’…​﻿́ẞ\U0001d518\U0001f600\U0002070e")


@pytest.fixture(scope="module")
def bpe():
    return bpe_chunks.tokenizer(bpe_chunks.default_tokenizer())


@pytest.mark.parametrize("word", ["слово", "λόγος", "كلمة", "漢字", "한글", "शब्द", "😀"])
def test_there_are_settled_boundaries(bpe, word):
    data = " ".join([word] * 5).encode()
    assert len(bpe.settled(data)) == 4


def test_a_settled_boundary_changes_no_token(bpe):
    t = Tokenizer.from_file(bpe_chunks.default_tokenizer())
    ids = lambda x: t.encode(x.decode(), add_special_tokens=False).ids
    rng = random.Random(5)
    for _ in range(3000):
        data = "".join(rng.choice(SPACES + [" "] * 6 if rng.random() < 0.4 else LETTERS) for _ in range(rng.randint(2, 30))).encode()
        cut = [0, *bpe.settled(data).tolist(), len(data)]
        assert [i for a, b in zip(cut, cut[1:]) for i in ids(data[a:b])] == ids(data), data
        assert list(np.frombuffer(bpe.encode([data])[0], "<u4")) == ids(data), data
