import random

import regex
from pyspark.sql import functions as F

from cadenza.functions.trigram import similarity, trigram_set

ALPHABET = list("abcxyzABCÉéüßñ0129 -_|.,'") + ["  "]
SPLIT = regex.compile(r"[^\p{L}\p{N}]+")


def py_trigrams(s):
    out = set()
    for w in SPLIT.split((s or "").lower()):
        if w:
            p = "  " + w + " "
            out.update(p[i:i + 3] for i in range(len(w) + 1))
    return out


def py_similarity(a, b):
    ta, tb = py_trigrams(a), py_trigrams(b)
    if not ta or not tb:
        return 0.0
    return len(ta & tb) / len(ta | tb)


def test_random_strings_match_python_rules(spark):
    rnd = random.Random(7)
    pairs = [("".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))),
              "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.select("a", "b", F.array_sort(trigram_set(F.col("a"))).alias("t"),
                    similarity(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        assert set(r["t"]) == py_trigrams(r["a"]), r["a"]
        assert abs(r["s"] - py_similarity(r["a"], r["b"])) < 1e-12, (r["a"], r["b"])
