"""Vector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline.functions import vectors as vx
from flockline.operators import text as to
from flockline.operators import vectors as vo
from flockline.plans import sql as s
from flockline.plans.tables import DIM, THETA, Tables, big, r6
from flockline.session import materialize


def _entries(df, key: str, col: str):
    """One row per vector entry."""
    return df.select(key, F.posexplode(col).alias("pos", "x")).select(key, "pos", r6("x").alias("x"))


def embed_posts(spark, path):
    found = to.embed_posts(Tables(spark, path).prepared, DIM)
    return _entries(found, "id", "embedding").filter("x <> 0")


def l2_normalize(spark, path):
    return _entries(vo.l2_normalize(Tables(spark, path).vectors), "id", "embedding")


def drop_zero_vectors(spark, path):
    found = to.embed_posts(Tables(spark, path).prepared, DIM)
    return vo.drop_zero_vectors(found).select("id")


def cosine_pairs(spark, path):
    t = Tables(spark, path)
    left = t.members.join(t.vectors.select(F.col("id").alias("post_id"), "embedding"), "post_id")
    right = vo.centroids(t.members, t.vectors).select("cluster_id", F.col("centroid").alias("embedding"))
    found = vo.cosine_pairs(left, right, "cluster_id")
    return found.select("cluster_id", "post_id", r6("similarity").alias("similarity"))


def topic_vectors(spark, path):
    """Topic vectors as every cluster sees them: the similarity of each centroid to each topic."""
    t = Tables(spark, path)
    means = vo.centroids(t.members, t.vectors)
    topics = t.topics.select("title", "embedding").collect()  # configuration, four rows
    entries = F.array(
        *[
            F.struct(F.lit(r["title"]).alias("title"), F.array(*[F.lit(x) for x in r["embedding"]]).alias("tv"))
            for r in topics
        ]
    )
    return means.select("cluster_id", "centroid", F.explode(entries).alias("t")).select(
        "cluster_id", "t.title", r6(vx.dot(F.col("centroid"), F.col("t.tv"))).alias("similarity")
    )


def topic_match(spark, path):
    t = Tables(spark, path)
    found = vo.topic_match(t.vectors, t.topics)
    return found.select("id", "topic", r6("topic_similarity").alias("topic_similarity"))


def _nearest(found):
    return found.select("id", "cluster_id", r6("similarity").alias("similarity"))


def nearest_clusters(spark, path):
    t = Tables(spark, path)
    return _nearest(vo.nearest_clusters(t.vectors, vo.centroids(t.members, t.vectors), 10, THETA))


def nearest_cluster(spark, path):
    t = Tables(spark, path)
    return _nearest(vo.nearest_cluster(t.vectors, vo.centroids(t.members, t.vectors), THETA))


def centroids(spark, path):
    t = Tables(spark, path)
    return _entries(vo.centroids(t.members, t.vectors), "cluster_id", "centroid")


def running_centroid(spark, path):
    t = Tables(spark, path)
    return _entries(vo.running_centroid(t.members, t.vectors), "cluster_id", "centroid")


def centroid_preview(spark, path):
    t = Tables(spark, path)
    return _entries(vo.centroid_preview(vo.centroids(t.members, t.vectors)), "cluster_id", "preview")


def vector_pca(spark, path):
    """Posts along the first two components, the largest loading of each positive."""
    t = Tables(spark, path)
    found = vo.vector_pca(t.vectors, t.members)
    return found.select("id", "cluster_id", *[F.round(F.col("point")[i], 4).alias(f"pc{i + 1}") for i in range(2)])


def similar_post_join(spark, path):
    found = vo.similar_post_join(Tables(spark, path).vectors, THETA)
    low, high = F.least("left_id", "right_id"), F.greatest("left_id", "right_id")
    return found.select(
        low.alias("left_id"), high.alias("right_id"), r6("similarity").alias("similarity"), "left_posts", "right_posts"
    )


def similar_post_candidates(spark, path):
    """Recall of the hashed search for the posts whose id is divisible by 50, against all posts, and pairs that are none."""
    t = Tables(spark, path)
    pair = [F.least("left_id", "right_id").alias("a"), F.greatest("left_id", "right_id").alias("b")]
    asked = lambda c: F.col(c) % 50 == 0
    exact = materialize(vo.similar_post_join(t.vectors, THETA, asked).select(*pair), "exact")
    found = materialize(vo.similar_post_candidates(t.vectors, THETA, bits=4, recall=0.99, asked=asked).select(*pair), "found")
    hits = exact.join(found, ["a", "b"], "left_semi")
    wrong = found.join(exact, ["a", "b"], "left_anti")
    return exact.agg(F.count("*").alias("links")).select(
        "links",
        big(hits.agg(F.count("*")).scalar() >= 0.9 * F.col("links")).alias("recall_reached"),
        wrong.agg(F.count("*")).scalar().alias("wrong"),
    )


QUERIES = {f.__name__: f for f in (
    embed_posts, l2_normalize, drop_zero_vectors, cosine_pairs, topic_vectors, topic_match, nearest_clusters,
    nearest_cluster, centroids, running_centroid, centroid_preview, vector_pca, similar_post_join,
    similar_post_candidates,
)}

_EMB = s.embedded("prepared", "emb", "id", "cleaned_text")


def _unrolled(source: str, key: str, col: str, n: int) -> str:
    return f"SELECT {key}, (d.i - 1)::BIGINT AS pos, {s.r6(f'{col}[d.i]')} AS x FROM {source}, generate_series(1,{n}) d(i)"


_NEAR = (
    "near AS (SELECT id, cluster_id, round(list_dot_product(u, c), 6) AS s, row_number() OVER (PARTITION BY id "
    "ORDER BY round(list_dot_product(u, c), 6) DESC, cluster_id) AS r FROM vec, cen WHERE round(list_dot_product(u, c), 6) {cmp} {theta})"
)
_RUN = """seq AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY joined_at, post_id) AS n FROM mem),
run(cluster_id, n, c) AS (SELECT cluster_id, n, u FROM seq WHERE n = 1 UNION ALL
  SELECT seq.cluster_id, seq.n, list_transform(
    list_transform(list_zip(run.c, seq.u), lambda z: (z[1] * (seq.n - 1) + z[2]) / seq.n),
    lambda x: x / sqrt(list_dot_product(
      list_transform(list_zip(run.c, seq.u), lambda z: (z[1] * (seq.n - 1) + z[2]) / seq.n),
      list_transform(list_zip(run.c, seq.u), lambda z: (z[1] * (seq.n - 1) + z[2]) / seq.n))))
  FROM run JOIN seq ON seq.cluster_id = run.cluster_id AND seq.n = run.n + 1),
fin AS (SELECT cluster_id, arg_max(c, n) AS c FROM run GROUP BY 1)"""

ORACLES = {
    "embed_posts": s.query([*s.PRE, _EMB], f"SELECT id, i AS pos, {s.r6('x')} AS x FROM emb"),
    "l2_normalize": s.query([s.VEC], _unrolled("vec", "id", "u", DIM)),
    "drop_zero_vectors": s.query([*s.PRE, _EMB], "SELECT DISTINCT id FROM emb"),
    "cosine_pairs": s.query(
        [s.VEC, s.MEM, s.CEN],
        f"SELECT cluster_id, post_id, {s.r6('list_dot_product(u, c)')} AS similarity FROM mem JOIN cen USING (cluster_id)",
    ),
    "topic_vectors": s.query(
        [s.VEC, s.MEM, s.CEN, s.TOPICS],
        f"SELECT cluster_id, title, {s.r6('list_dot_product(c, tv)')} AS similarity FROM cen, topics",
    ),
    "topic_match": s.query(
        [s.VEC, s.TOPICS, s.matched("vec", "tm", "id", "u")],
        f"SELECT id, topic, {s.r6('topic_similarity')} AS topic_similarity FROM tm",
    ),
    "nearest_clusters": s.query(
        [s.VEC, s.MEM, s.CEN, _NEAR.format(cmp=">=", theta=THETA)],
        f"SELECT id, cluster_id, {s.r6('s')} AS similarity FROM near WHERE r <= 10",
    ),
    "nearest_cluster": s.query(
        [s.VEC, s.MEM, s.CEN, _NEAR.format(cmp=">", theta=THETA)],
        f"SELECT id, cluster_id, {s.r6('s')} AS similarity FROM near WHERE r = 1",
    ),
    "centroids": s.query([s.VEC, s.MEM, s.CEN], _unrolled("cen", "cluster_id", "c", DIM)),
    "running_centroid": s.query([s.VEC, s.MEM, _RUN], _unrolled("fin", "cluster_id", "c", DIM)),
    "centroid_preview": s.query([s.VEC, s.MEM, s.CEN], _unrolled("cen", "cluster_id", "c", 5)),
    "similar_post_candidates": s.query(
        [s.VEC],
        "SELECT count(*) AS links, 1::BIGINT AS recall_reached, 0::BIGINT AS wrong FROM vec a JOIN vec b ON a.id < b.id "
        f"WHERE round(list_dot_product(a.u, b.u), 6) >= {THETA} AND (a.id % 50 = 0 OR b.id % 50 = 0)",
    ),
    "similar_post_join": s.query(
        [s.VEC],
        "SELECT a.id AS left_id, b.id AS right_id, "
        + s.r6("list_dot_product(a.u, b.u)")
        + " AS similarity, 1::BIGINT AS left_posts, 1::BIGINT AS right_posts FROM vec a JOIN vec b ON a.id < b.id "
        f"WHERE round(list_dot_product(a.u, b.u), 6) >= {THETA}",
    ),
}
