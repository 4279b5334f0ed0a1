from pyspark.sql import functions as F

from cadenza.functions.trigram import similarity
from cadenza.operators import fuzzy
from cadenza.plans.inputs import part_catalogue, search_requests

from conftest import SF001


def _brute(spark, req, cat):
    qs = req.select(F.col("query").alias("q")).distinct()
    pairs = qs.crossJoin(cat)  # test oracle only
    s = pairs.select("q", "id", similarity(F.col("name"), F.col("q")).alias("sn"),
                     similarity(F.col("artist"), F.col("q")).alias("sa"))
    return s.filter((F.col("sn") > 0.25) | (F.col("sa") > 0.25)).select(
        "q", "id", F.greatest("sn", "sa").alias("score"))


def test_posting_join_equals_brute_force(spark):
    req, cat = search_requests(spark, SF001), part_catalogue(spark, SF001)
    got = fuzzy.fuzzy_join(req, cat, q_col="query")
    want = _brute(spark, req, cat)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_no_pairwise_product_in_plan(spark):
    req, cat = search_requests(spark, SF001), part_catalogue(spark, SF001)
    plan = fuzzy.fuzzy_join(req, cat, q_col="query")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_search_orders_and_limit(spark):
    cat = spark.createDataFrame([(1, "red widget", "Brand#1"), (2, "blue widget", "Brand#2"),
                                 (3, "red bolt", "Brand#3"), (4, "widget", "x")], "id long, name string, artist string")
    req = spark.createDataFrame([(10, "blue widget")], "qid long, q string")
    desc = fuzzy.fuzzy_search(req, cat, limit=2).orderBy("rank").collect()
    asc = fuzzy.fuzzy_search(req, cat, limit=2, order="asc").orderBy("rank").collect()
    assert [r["id"] for r in desc] == [2, 4]
    assert asc[0]["score"] <= asc[1]["score"]
    assert all(r["score"] > 0.25 for r in asc)


def test_no_hit_reply(spark):
    cat = spark.createDataFrame([(1, "red widget", "Brand#1")], "id long, name string, artist string")
    req = spark.createDataFrame([(10, "zzzz"), (11, "red widget")], "qid long, q string")
    res = fuzzy.fuzzy_search(req, cat)
    rep = {r["qid"]: r["reply"] for r in fuzzy.search_replies(req, res).collect()}
    assert rep[10].startswith("We might not have this song")
    assert rep[11].startswith("Here's our closest song: red widget by Brand#1")


def test_ranked_search_limits_before_shuffle(spark):
    req, cat = search_requests(spark, SF001), part_catalogue(spark, SF001)
    plan = fuzzy.fuzzy_search(req, cat, qid_col="request_id", q_col="query") \
        ._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_stored_index_equals_direct(spark, tmp_dir):
    req, cat = search_requests(spark, SF001), part_catalogue(spark, SF001)
    idx = fuzzy.TrigramIndex.build(cat, tmp_dir)
    a = fuzzy.fuzzy_join(req, cat, q_col="query")
    b = fuzzy.fuzzy_join(req, cat, q_col="query", index=idx)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 7))) for _ in range(n))


def _random_catalogue(spark, seed):
    import random
    rnd = random.Random(seed)
    names = [_words(rnd, rnd.randrange(1, 4)) for _ in range(60)] + [None, "", "é à"]
    rows = [(i, rnd.choice(names), rnd.choice(names[:12] + [None])) for i in range(300)]
    cat = spark.createDataFrame(rows, "id long, name string, artist string")
    req = spark.createDataFrame([(i, rnd.choice(names + [_words(rnd, 2)])) for i in range(80)], "qid long, query string")
    return req, cat


def test_random_strings_at_several_thresholds(spark):
    for seed, t in ((1, 0.25), (2, 0.0), (3, 0.5), (4, 0.3), (5, 0.9)):
        req, cat = _random_catalogue(spark, seed)
        pairs = req.select(F.col("query").alias("q")).distinct().crossJoin(cat)  # test oracle only
        s = pairs.select("q", "id", similarity(F.col("name"), F.col("q")).alias("sn"), similarity(F.col("artist"), F.col("q")).alias("sa"))
        want = {(r.q, r.id): r.score for r in s.where((F.col("sn") > t) | (F.col("sa") > t)).select("q", "id", F.greatest("sn", "sa").alias("score")).collect()}
        got = {(r.q, r.id): r.score for r in fuzzy.fuzzy_join(req, cat, t, q_col="query").collect()}
        assert got == want
        for order, sign in (("desc", -1), ("asc", 1)):
            top = {(r.q, r.rank): r.id for r in fuzzy.fuzzy_top(req, cat, 4, order, t, q_col="query").collect()}
            best = {}
            for (q, i), v in sorted(want.items(), key=lambda x: (x[0][0] or "", sign * x[1], x[0][1])):
                best.setdefault(q, []).append(i)
            assert top == {(q, k + 1): i for q, ids in best.items() for k, i in enumerate(ids[:4])}


def test_index_threshold_is_checked(spark, tmp_dir):
    import pytest
    req, cat = _random_catalogue(spark, 7)
    index = fuzzy.TrigramIndex.build(cat, tmp_dir, threshold=0.5)
    assert fuzzy.fuzzy_join(req, cat, 0.6, q_col="query", index=index).exceptAll(fuzzy.fuzzy_join(req, cat, 0.6, q_col="query")).isEmpty()
    with pytest.raises(ValueError):
        fuzzy.fuzzy_join(req, cat, 0.25, q_col="query", index=index)


def test_no_frequent_trigram_is_joined_and_ids_come_last(spark, tmp_dir):
    req, cat = search_requests(spark, SF001), part_catalogue(spark, SF001)
    index = fuzzy.TrigramIndex.build(cat, tmp_dir)
    # the prefix leaves out the most frequent trigrams of every string
    last = index.strings.select("field", "s", "n", F.element_at("tri", -1).alias("t")).where("n >= 4")
    assert last.join(index.prefixes, ["field", "s", "t"], "left_semi").isEmpty() and index.prefixes.count() < index.postings.count()
    plan = fuzzy.fuzzy_search(req, cat, qid_col="request_id", q_col="query", index=index)._jdf.queryExecution().optimizedPlan().toString()
    # reading down from the top: every relation with ids stands beside, not below, the limited combinations
    lines = plan.split("\n")
    prefixes = next(i for i, x in enumerate(lines) if "Relation" in x and "j#" in x)
    depth = len(lines[prefixes]) - len(lines[prefixes].lstrip(" :+-"))
    below, d = [], depth
    for x in reversed(lines[:prefixes]):
        here = len(x) - len(x.lstrip(" :+-"))
        if here < d:
            below.append(x)
            d = here
        if "row_number" in x or "rank(" in x:
            break
    assert not any("id#" in x for x in below)
