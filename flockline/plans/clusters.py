"""Clustering queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline.functions import vectors as vx
from flockline.operators import clustering as cl
from flockline.plans import sql as s
from flockline.plans.tables import DIM, THETA, Tables, big, r6, stamp
from flockline.session import materialize

MICRO_RADIUS = 0.9
ECHOES = 3  # copies of a vector in the fixture of near copies
ECHO_RADIUS = 0.2  # different given vectors lie further apart than twice this


def leader_cluster(spark, path):
    found = cl.leader_cluster(Tables(spark, path).vectors, THETA)
    return found.select("cluster_id", "post_id", stamp("joined_at").alias("joined_at"), r6("similarity").alias("similarity"))


def refine_clusters(spark, path):
    """One round from the given clustering: every post with its best centroid."""
    t = Tables(spark, path)
    found = cl.refine_clusters(t.vectors, t.members, 1, THETA)
    return found.select("cluster_id", "post_id", r6("similarity").alias("similarity"))


def assign_incremental(spark, path):
    """The given clusters as stored state without views; the views arrive as a batch."""
    t = Tables(spark, path)
    stored = t.members.filter(~F.col("cluster_id").endswith("-view"))
    members, merged = cl.assign_incremental(
        cl.cluster_features(stored, t.vectors), t.vectors.filter("event_type = 'view'"), THETA
    )
    sizes = merged.select("cluster_id", "n")
    return (
        members.join(sizes, "cluster_id")
        .select("cluster_id", "post_id", r6("similarity").alias("similarity"), big("leads").alias("leads"), "n")
    )


def batch_outcomes(spark, path):
    return Tables(spark, path).outcomes.select("id", "outcome")


def outcome_counts(spark, path):
    return cl.outcome_counts(Tables(spark, path).outcomes)


def cluster_features(spark, path):
    t = Tables(spark, path)
    found = cl.cluster_features(t.members, t.vectors)
    radius = cl.feature_centroids(found).select("cluster_id", "radius")
    return (
        found.join(radius, "cluster_id")
        .select("cluster_id", "n", "square_sum", "radius", F.posexplode("linear_sum").alias("pos", "x"))
        .select(
            "cluster_id", "n", r6("square_sum").alias("square_sum"), r6("radius").alias("radius"), "pos", r6("x").alias("x")
        )
    )


def micro_clusters(spark, path):
    """What must hold for any grouping: all posts are in, and no radius exceeds the bound."""
    found = cl.micro_clusters(Tables(spark, path).vectors, MICRO_RADIUS)
    return found.agg(
        big(F.sum("n")).alias("posts"),
        r6(F.sum("square_sum")).alias("square_sum"),
        big(F.count_if(F.col("radius") > MICRO_RADIUS + 1e-6)).alias("too_wide"),
    )


def recluster(spark, path):
    t = Tables(spark, path)
    found = cl.recluster(t.members, t.clusters, t.vectors)
    total = found.agg(big(F.sum("n")).alias("posts"), F.max("radius").alias("widest"))
    radius = F.greatest(F.lit(0.2), 0.5 - F.col("posts") / 10000)
    return total.select("posts", big(F.col("widest") > radius + 1e-6).alias("too_wide"))


def _echoes(t: Tables) -> DataFrame:
    """Every vector and two echoes of it, a little longer and a second later each."""
    echo = F.explode(F.sequence(F.lit(0), F.lit(ECHOES - 1))).alias("echo")
    rows = t.vectors.select("*", echo)
    return rows.select(
        (F.col("id") * 10 + F.col("echo")).alias("id"),
        F.transform("embedding", lambda x: x * (1 + F.col("echo") * 0.05)).alias("embedding"),
        F.timestamp_micros(F.unix_micros("created_at") + F.col("echo") * 1_000_000).alias("created_at"),
        F.concat(F.lit("c"), "label", F.lit("-"), "event_type").alias("cluster_id"),
    )


def _echo_labels(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Members of the given clusters with echoes, and their labels after a new fit of the active clusters."""
    rows = _echoes(t)
    members = rows.select("cluster_id", F.col("id").alias("post_id"))
    return members, cl.post_labels(members, t.clusters, rows)


def micro_members(spark, path):
    """The micro cluster of each post: an echo shares that of its original and of nothing else."""
    found = cl.micro_members(materialize(_echoes(Tables(spark, path)), "echoes"), ECHO_RADIUS)
    sizes = found.groupBy("label").agg(F.count("*").alias("n"))
    return found.join(sizes, "label").select("post_id", "label", "n")


def post_labels(spark, path):
    """Labels of the posts of active clusters after a new fit."""
    return _echo_labels(Tables(spark, path))[1]


def cluster_labels(spark, path):
    """The report base with the label of each cluster."""
    t = Tables(spark, path)
    members, labels = _echo_labels(t)
    return cl.cluster_labels(members, labels)


def cluster_table(spark, path):
    return Tables(spark, path).clusters.select(
        "cluster_id",
        "size",
        stamp("created_at").alias("created_at"),
        stamp("last_post_at").alias("last_post_at"),
        "topic",
        r6("topic_similarity").alias("topic_similarity"),
        r6(vx.total(F.col("centroid"))).alias("centroid_total"),
        "status",
        big("alert_sent").alias("alert_sent"),
    )


def cluster_posts(spark, path):
    t = Tables(spark, path)
    found = cl.cluster_posts(t.members, t.posts, page_size=8)
    return found.select("cluster_id", "page", "size", F.explode("posts").alias("p")).select(
        "cluster_id", "page", "size", "p.position", "p.id", "p.text", "p.author"
    )


def member_dedupe(spark, path):
    t = Tables(spark, path)
    once = t.members.withColumn("similarity", F.lit(1.0))
    later = F.timestamp_micros(F.unix_micros("joined_at") + 1_000_000)
    found = cl.member_dedupe(once.unionByName(once.withColumn("joined_at", later)))
    return found.select("cluster_id", "post_id", stamp("joined_at").alias("joined_at"))


QUERIES = {f.__name__: f for f in (
    leader_cluster, refine_clusters, assign_incremental, batch_outcomes, outcome_counts, cluster_features,
    micro_clusters, recluster, micro_members, post_labels, cluster_labels, cluster_table, cluster_posts, member_dedupe,
)}

# Views arrive in order: compare with the stored centroids and the earlier new leaders of the batch.
_INCREMENTAL = f"""old AS (SELECT * FROM mem WHERE cluster_id NOT LIKE '%-view'),
{s.mean("old", "oc")},
bat AS MATERIALIZED (SELECT id, u, row_number() OVER (ORDER BY created_at, id) AS k FROM vec WHERE event_type = 'view'),
hit AS MATERIALIZED (SELECT k, cluster_id, round(list_dot_product(u, c), 6) AS s FROM bat, oc WHERE round(list_dot_product(u, c), 6) >= {THETA}),
fresh AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY k) AS q FROM bat WHERE k NOT IN (SELECT k FROM hit)),
bpr AS MATERIALIZED (SELECT a.k AS i, b.k AS j, round(list_dot_product(a.u, b.u), 6) AS s FROM bat a JOIN bat b ON a.k < b.k
  WHERE round(list_dot_product(a.u, b.u), 6) >= {THETA}),
fadj AS MATERIALIZED (SELECT f.q, f.k, coalesce(list(bpr.i) FILTER (bpr.i IS NOT NULL), []) AS nb
  FROM fresh f LEFT JOIN bpr ON bpr.j = f.k GROUP BY f.q, f.k),
fst(q, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT fadj.q, CASE WHEN list_has_any(fadj.nb, fst.leaders) THEN fst.leaders ELSE list_append(fst.leaders, fadj.k) END
  FROM fst JOIN fadj ON fadj.q = fst.q + 1),
flead AS MATERIALIZED (SELECT unnest(leaders) AS k FROM (SELECT leaders FROM fst ORDER BY q DESC LIMIT 1)),
options AS (SELECT k, s, 0 AS o, cluster_id FROM hit
  UNION ALL SELECT bpr.j, bpr.s, -1, a.id::VARCHAR FROM bpr JOIN flead ON flead.k = bpr.i JOIN bat a ON a.k = bpr.i
  UNION ALL SELECT k, 1.0, -2, id::VARCHAR FROM flead JOIN bat USING (k)),
chosen AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s DESC, o DESC, cluster_id) AS r FROM options),
asg AS MATERIALIZED (SELECT c.cluster_id, b.id AS post_id, c.s, c.o = -2 AS leads FROM chosen c JOIN bat b USING (k) WHERE r = 1),
total AS (SELECT cluster_id, count(*) AS n FROM (SELECT cluster_id FROM old UNION ALL SELECT cluster_id FROM asg) GROUP BY 1)"""

_ECHOES = f"""echoes AS (SELECT post_id * 10 + e.k AS id, post_id * 10 AS origin, cluster_id
  FROM mem, generate_series(0,{ECHOES - 1}) e(k))"""

ORACLES = {
    "leader_cluster": s.query(
        s.SEQ,
        f"SELECT cluster_id::VARCHAR AS cluster_id, post_id, {s.stamp('joined_at')} AS joined_at, {s.r6('similarity')} AS similarity FROM placed",
    ),
    "refine_clusters": s.query(
        [s.VEC, s.MEM, s.CEN],
        f"SELECT cluster_id, id AS post_id, {s.r6('s')} AS similarity FROM (SELECT id, cluster_id, round(list_dot_product(u, c), 6) AS s, "
        "row_number() OVER (PARTITION BY id ORDER BY round(list_dot_product(u, c), 6) DESC, cluster_id) AS r FROM vec, cen) WHERE r = 1",
    ),
    "assign_incremental": s.query(
        [s.VEC, s.MEM, _INCREMENTAL],
        f"SELECT cluster_id, post_id, {s.r6('s')} AS similarity, leads::BIGINT AS leads, n FROM asg JOIN total USING (cluster_id)",
    ),
    "batch_outcomes": s.query([*s.SEQ, s.OUTCOMES], "SELECT id, outcome FROM outcomes"),
    "outcome_counts": s.query([*s.SEQ, s.OUTCOMES], "SELECT outcome, count(*) AS posts FROM outcomes GROUP BY 1"),
    "cluster_features": s.query(
        [
            s.VEC,
            s.MEM,
            f"fd AS (SELECT cluster_id, d.i, sum(u[d.i]) AS x, count(*) AS n FROM mem, generate_series(1,{DIM}) d(i) GROUP BY 1, 2)",
            "sq AS (SELECT cluster_id, sum(list_dot_product(u, u)) AS square_sum FROM mem GROUP BY 1)",
            "rad AS (SELECT cluster_id, sqrt(greatest(any_value(square_sum) / any_value(n) - sum(x * x) / any_value(n * n), 0.0)) AS radius FROM fd JOIN sq USING (cluster_id) GROUP BY 1)",
        ],
        f"SELECT cluster_id, n, {s.r6('square_sum')} AS square_sum, {s.r6('radius')} AS radius, (i - 1)::BIGINT AS pos, {s.r6('x')} AS x "
        "FROM fd JOIN sq USING (cluster_id) JOIN rad USING (cluster_id)",
    ),
    "micro_clusters": s.query(
        [s.VEC],
        f"SELECT count(*) AS posts, {s.r6('sum(list_dot_product(v, v))')} AS square_sum, 0::BIGINT AS too_wide FROM vec",
    ),
    "recluster": s.query(
        s.CLU,
        "SELECT count(*) AS posts, 0::BIGINT AS too_wide FROM mem WHERE cluster_id IN (SELECT cluster_id FROM clusters WHERE status = 'active')",
    ),
    "micro_members": s.query(
        [s.VEC, s.MEM, _ECHOES],
        f"SELECT id AS post_id, origin::VARCHAR AS label, {ECHOES}::BIGINT AS n FROM echoes",
    ),
    "post_labels": s.query(
        [*s.CLU, _ECHOES],
        "SELECT id AS post_id, origin::VARCHAR AS label FROM echoes JOIN clusters USING (cluster_id) WHERE status = 'active'",
    ),
    "cluster_labels": s.query(
        [*s.CLU, _ECHOES],
        "SELECT cluster_id, label, n AS label_posts FROM (SELECT cluster_id, origin::VARCHAR AS label, count(*) AS n, "
        "row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, origin::VARCHAR) AS r "
        "FROM echoes JOIN clusters USING (cluster_id) WHERE status = 'active' GROUP BY 1, 2) WHERE r = 1",
    ),
    "cluster_table": s.query(
        s.CLU,
        f"SELECT cluster_id, size, {s.stamp('created_at')} AS created_at, {s.stamp('last_post_at')} AS last_post_at, topic, "
        f"{s.r6('topic_similarity')} AS topic_similarity, {s.r6('list_sum(centroid)')} AS centroid_total, status, alert_sent::BIGINT AS alert_sent FROM clusters",
    ),
    "cluster_posts": s.query(
        [s.POSTS, s.VEC, s.MEM],
        "SELECT cluster_id, (position - 1) // 8 AS page, count(*) OVER (PARTITION BY cluster_id, (position - 1) // 8) AS size, position, id, text, author FROM ("
        "SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY joined_at, id) AS position, id, text, author_username AS author "
        "FROM mem JOIN posts ON id = post_id)",
    ),
    "member_dedupe": s.query(
        [s.VEC, s.MEM], f"SELECT cluster_id, post_id, {s.stamp('joined_at')} AS joined_at FROM mem"
    ),
}
