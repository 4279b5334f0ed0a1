"""Vector family: norms, unit vectors, cosine to a centroid, cosine loss, exact
top-k and the recommendation lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import topk
from ..operators.recommend import centroids, recommend_lookup
from .catalogue import RECOMMEND_CATALOGUE_SQL, recommend_catalogue
from .inputs import vectors
from .registry import query, r6

DUCK_UNIT = """
u AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
             sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n
      FROM embeddings)
"""

DUCK_CENTROID = """
elems AS (SELECT label, i, x FROM (
    SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)),
cent AS (SELECT label, list(s ORDER BY i) AS c FROM (
    SELECT label, i, sum(x) AS s FROM elems GROUP BY label, i) GROUP BY label)
"""


@query("vector_norm", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), "
                      "lambda x: x * x))), 6) AS norm FROM embeddings")
def q_vector_norm(spark, sf):
    v = vectors(spark, sf)
    return v.select(F.col("id").alias("vec_id"), r6(V.norm(F.col("vec"))).alias("norm"))


@query("l2_normalise", f"""
WITH {DUCK_UNIT}
SELECT vec_id, CAST(i AS BIGINT) AS i, round(x / nullif(n, 0), 6) AS x
FROM (SELECT vec_id, n, generate_subscripts(e, 1) - 1 AS i, unnest(e) AS x FROM u)
""")
def q_l2_normalise(spark, sf):
    v = vectors(spark, sf).select(F.col("id").alias("vec_id"), V.normalise(F.col("vec")).alias("u"))
    return v.select("vec_id", F.posexplode("u").alias("i", "x")).select(
        "vec_id", F.col("i").cast("bigint").alias("i"), r6("x").alias("x"))


@query("pair_cosine", f"""
WITH {DUCK_CENTROID}
SELECT vec_id, CAST(embeddings.label AS BIGINT) AS label,
  round(list_dot_product(CAST(embedding AS DOUBLE[]), c)
        / (sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x)))
           * sqrt(list_sum(list_transform(c, lambda x: x * x)))), 6) AS cosine
FROM embeddings JOIN cent ON embeddings.label = cent.label
""")
def q_pair_cosine(spark, sf):
    """Cosine of each vector to the centroid of its label."""
    v = vectors(spark, sf)
    cent = centroids(v, "label", "vec")
    j = v.join(cent, "label")
    return j.select(F.col("id").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
                    r6(V.cosine(F.col("vec"), F.col("centroid"))).alias("cosine"))


@query("cosine_loss", f"""
WITH {DUCK_CENTROID}
SELECT CAST(embeddings.label AS BIGINT) AS label, round(1 - avg(
  list_dot_product(
    list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(greatest(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)), 1e-12))),
    list_transform(c, lambda x: x / sqrt(greatest(list_sum(list_transform(c, lambda y: y * y)), 1e-12))))), 6) AS loss
FROM embeddings JOIN cent ON embeddings.label = cent.label
GROUP BY embeddings.label
""")
def q_cosine_loss(spark, sf):
    """Mean cosine loss of each vector against its label centroid, per label."""
    v = vectors(spark, sf)
    j = v.join(centroids(v, "label", "vec"), "label")
    return j.groupBy(F.col("label").cast("bigint").alias("label")).agg(
        r6(F.lit(1.0) - F.avg(V.pair_loss_term(F.col("vec"), F.col("centroid")))).alias("loss"))


TOPK_SQL = f"""
WITH {DUCK_UNIT},
scored AS (SELECT a.vec_id AS qid, b.vec_id AS id,
                  list_dot_product(a.e, b.e) / (a.n * b.n) AS score
           FROM u a, u b WHERE a.n > 0 AND b.n > 0),
ranked AS (SELECT qid, id, score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM scored)
"""


@query("topk_cosine", TOPK_SQL + """
SELECT qid, CAST(rank AS BIGINT) AS rank, id, round(score, 6) AS score FROM ranked WHERE rank <= 15
""")
def q_topk_cosine(spark, sf):
    """Every vector as a query against all vectors, k = 15."""
    v = vectors(spark, sf)
    res = topk.topk_cosine(v.select(F.col("id").alias("qid"), "vec"), v, k=15)
    return res.select("qid", "rank", "id", r6("score").alias("score"))


@query("recommend", TOPK_SQL + f"""
, cat AS ({RECOMMEND_CATALOGUE_SQL})
SELECT qid, CAST(rank AS BIGINT) AS rank, ranked.id, '- ' || name || ' by ' || artist AS reply
FROM ranked JOIN cat ON ranked.id = cat.id WHERE rank <= 15
""")
def q_recommend(spark, sf):
    """Top 15 per query vector, joined to its metadata (rank kept)."""
    v = vectors(spark, sf)
    res = topk.topk_cosine(v.select(F.col("id").alias("qid"), "vec"), v, k=15)
    out = recommend_lookup(res, recommend_catalogue(spark, sf))
    return out.select("qid", "rank", "id", "reply")
