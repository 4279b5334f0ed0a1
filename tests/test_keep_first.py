"""Keep-first and registration against plain loops, and what their plans hold."""

import random
from datetime import datetime, timedelta

import pytest

from cadenza.operators import quality as Q
from cadenza.operators import sessions as S
from cadenza.operators.components import connected_components
from cadenza.plans import registry

from conftest import SF001


def _first(rows, n_keys):
    rank = lambda r: tuple((v is not None, v) for v in r[n_keys:])
    best = {}
    for r in rows:
        k = r[:n_keys]
        if k not in best or rank(r) < rank(best[k]):
            best[k] = r
    return sorted(best.values(), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("kinds", [("string", "long"), ("long", "string"), ("double", "string"), ("string", "string")])
def test_dedup_first_equals_a_loop(spark, kinds):
    rnd = random.Random(str(kinds))
    draw = {"string": lambda: rnd.choice([None, "", "same beginning a", "same beginning b", "é", "z"]),
            "long": lambda: rnd.choice([None, -5, 0, 3, 2**60]), "double": lambda: rnd.choice([None, -1.5, 0.0, 2.5])}
    rows = [(rnd.choice(["hot", "hot", None, f"k{rnd.randrange(40)}"]), draw[kinds[0]](), draw[kinds[1]](), rnd.randrange(5)) for _ in range(400)]
    df = spark.createDataFrame(rows, f"k string, a {kinds[0]}, b {kinds[1]}, n long").repartition(5)
    got = sorted(map(tuple, Q.dedup_first(df, "k", ["a", "b"]).collect()), key=lambda r: tuple(map(str, r)))
    assert got == _first(rows, 1)


def test_dedup_first_edges(spark):
    empty = spark.createDataFrame([], "k string, a long")
    assert Q.dedup_first(empty, "k", ["a"]).collect() == []
    two = spark.createDataFrame([(1, "x", [2], 9), (1, "x", [1], 9), (1, "y", [3], 9), (None, "x", None, 9), (None, "x", [0], 9)], "k long, l string, a array<int>, _n long")
    assert {tuple(map(str, r)) for r in Q.dedup_first(two, ["k", "l"], ["a"]).collect()} == {
        ("1", "x", "[1]", "9"), ("1", "y", "[3]", "9"), ("None", "x", "None", "9")}


def test_no_sorted_payload(spark):
    registry.load_all()
    for name in ("dedup_first", "ingest_json"):
        plan = registry.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan, name


def test_components(spark):
    rnd = random.Random(2)
    edges = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{rnd.randrange(80)}", f"m{rnd.randrange(80)}") for _ in range(60)]
    label = {}
    for a, b in edges:
        for x in (a, b):
            label.setdefault(x, x)
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == label
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("limit", [10_000, 15, 0])
def test_registration_by_components(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "COMPONENT_ROWS", limit)
    rnd = random.Random(limit)
    # a chain in which every row blocks the next one, and a tangle
    rows = [(f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(40)] + [(f"x{rnd.randrange(25)}", f"y{rnd.randrange(25)}") for _ in range(80)] + [("", "e"), (None, None)]
    data = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), u, e) for i, (u, e) in enumerate(rows)]
    names, mails, want = {"u3"}, {"y1"}, {}
    for i, (u, e) in enumerate(rows):
        want[i] = bool(u and e and u not in names and e not in mails)
        if want[i]:
            names.add(u)
            mails.add(e)
    old = spark.createDataFrame([("u3", "none"), ("none", "y1")], "username string, email string")
    out, rounds = S.register_two_keys(spark.createDataFrame(data, "reg_id long, ts timestamp_ntz, username string, email string"), ["ts", "reg_id"], old)
    assert {r.reg_id: r.accepted for r in out.collect()} == want
    assert rounds == 1 if limit == 10_000 else rounds > 1
