"""Window and lifecycle queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline.functions import vectors as vx
from flockline.operators import windows as wi
from flockline.plans import sql as s
from flockline.plans.tables import EXPIRY_HOURS, Tables, big, r6, stamp


def window_assign(spark, path):
    found = wi.window_assign(Tables(spark, path).posts)
    return found.select("id", "window_id", stamp("window_start").alias("window_start"))


def window_assign_anchored(spark, path):
    found = wi.window_assign_anchored(Tables(spark, path).posts)
    return found.select("id", "window_id", stamp("window_start").alias("window_start"))


def _windows(t: Tables):
    return wi.window_table(wi.window_assign(t.posts))


def _ages(found):
    return found.select(
        "window_id",
        stamp("window_start").alias("window_start"),
        stamp("expires_at").alias("expires_at"),
        "post_count",
        r6("age_hours").alias("age_hours"),
    )


def window_info(spark, path):
    t = Tables(spark, path)
    return _ages(wi.window_info(_windows(t), wi.max_time(t.posts)))


def expired_windows(spark, path):
    t = Tables(spark, path)
    return _ages(wi.expired_windows(_windows(t), wi.max_time(t.posts)))


def retract_window(spark, path):
    """Six-hour windows that live for twelve hours."""
    t = Tables(spark, path)
    placed = wi.window_assign(t.vectors, 6)
    dead = wi.expired_windows(wi.window_table(placed, 12), t.as_of, 12)
    posts = placed.join(dead.select("window_id"), "window_id", "left_semi").select(F.col("id").alias("post_id"))
    found = wi.retract_window(t.clusters, t.members, t.vectors, t.topics, posts)
    return found.select(
        "cluster_id",
        "size",
        "topic",
        r6("topic_similarity").alias("topic_similarity"),
        r6(vx.total(F.col("centroid"))).alias("centroid_total"),
        "status",
    )


def sliding_counts(spark, path):
    t = Tables(spark, path)
    found = wi.sliding_counts(t.posts, t.members)
    return found.select(
        stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "posts", "clusters"
    )


def expire_clusters(spark, path):
    t = Tables(spark, path)
    known = t.clusters.withColumn("status", F.when(F.col("alert_sent"), "expired").otherwise("active"))
    return wi.expire_clusters(known, t.as_of, EXPIRY_HOURS).select(
        "cluster_id", stamp("last_post_at").alias("last_post_at")
    )


def cluster_status(spark, path):
    return Tables(spark, path).clusters.select("cluster_id", "status", big("alert_sent").alias("alert_sent"))


def active_clusters(spark, path):
    return wi.active_clusters(Tables(spark, path).clusters).select("cluster_id", "size", "status")


QUERIES = {f.__name__: f for f in (
    window_assign, window_assign_anchored, window_info, expired_windows, retract_window, sliding_counts,
    expire_clusters, cluster_status, active_clusters,
)}

_BUCKET = "time_bucket(INTERVAL {h} HOUR, created_at, TIMESTAMP '1970-01-01')"
_WIN = f"""wposts AS (SELECT id, created_at, {_BUCKET.format(h=18)} AS window_start FROM posts),
wend AS (SELECT max(created_at) AS as_of FROM posts),
wins AS (SELECT (epoch_us(window_start) // 64800000000)::BIGINT AS window_id, window_start, window_start + INTERVAL 24 HOUR AS expires_at,
  count(*) AS post_count, (epoch_us(any_value(as_of)) - epoch_us(window_start)) / 3600000000.0 AS age_hours FROM wposts, wend GROUP BY window_start)"""
_AGES = f"SELECT window_id, {s.stamp('window_start')} AS window_start, {s.stamp('expires_at')} AS expires_at, post_count, {s.r6('age_hours')} AS age_hours FROM wins"
_ANCHORED = """ws(window_id, start) AS (SELECT 0::BIGINT, min(created_at) FROM posts UNION ALL
  SELECT window_id + 1, (SELECT min(created_at) FROM posts WHERE created_at >= ws.start + INTERVAL 18 HOUR) FROM ws
  WHERE EXISTS (SELECT 1 FROM posts WHERE created_at >= ws.start + INTERVAL 18 HOUR))"""
_RETRACT = f"""rp AS (SELECT *, {_BUCKET.format(h=6)} AS window_start FROM vec),
gone AS (SELECT id FROM rp, newest WHERE epoch_us(as_of) - epoch_us(window_start) > 12 * 3600000000),
touched AS (SELECT DISTINCT cluster_id FROM mem WHERE post_id IN (SELECT id FROM gone)),
kept AS MATERIALIZED (SELECT * FROM mem WHERE post_id NOT IN (SELECT id FROM gone) AND cluster_id IN (SELECT cluster_id FROM touched)),
fate AS (SELECT cluster_id, count(post_id) AS n FROM touched LEFT JOIN kept USING (cluster_id) GROUP BY 1),
{s.mean("kept", "kc")},
{s.matched("kc", "km", "cluster_id", "c")},
after AS (SELECT cluster_id, size, topic, topic_similarity, list_sum(centroid) AS t, status FROM clusters WHERE cluster_id NOT IN (SELECT cluster_id FROM touched)
  UNION ALL SELECT cluster_id, n, km.topic, km.topic_similarity, list_sum(kc.c), status FROM fate JOIN kc USING (cluster_id) JOIN km USING (cluster_id) JOIN clusters USING (cluster_id) WHERE n >= 5
  UNION ALL SELECT cluster_id, n, topic, topic_similarity, list_sum(centroid), 'expired' FROM fate JOIN clusters USING (cluster_id) WHERE n < 5)"""

ORACLES = {
    "window_assign": s.query(
        [s.POSTS, _WIN],
        f"SELECT id, (epoch_us(window_start) // 64800000000)::BIGINT AS window_id, {s.stamp('window_start')} AS window_start FROM wposts",
    ),
    "window_assign_anchored": s.query(
        [s.POSTS, _ANCHORED],
        f"SELECT id, max(window_id) AS window_id, {s.stamp('max(start)')} AS window_start FROM posts JOIN ws ON ws.start <= created_at GROUP BY id",
    ),
    "window_info": s.query([s.POSTS, _WIN], _AGES + " WHERE wins.age_hours <= 24"),
    "expired_windows": s.query([s.POSTS, _WIN], _AGES + " WHERE wins.age_hours > 24"),
    "retract_window": s.query(
        [*s.CLU, _RETRACT],
        f"SELECT cluster_id, size, topic, {s.r6('topic_similarity')} AS topic_similarity, {s.r6('t')} AS centroid_total, status FROM after",
    ),
    "sliding_counts": s.query(
        [
            s.POSTS,
            s.VEC,
            s.MEM,
            "pm AS (SELECT id, posts.created_at, cluster_id FROM posts LEFT JOIN mem ON post_id = id)",
            "hits AS (SELECT *, b - o * INTERVAL 18 HOUR AS ws FROM (SELECT *, "
            + _BUCKET.format(h=18)
            + " AS b FROM pm), generate_series(0, 1) g(o))",
        ],
        f"SELECT {s.stamp('ws')} AS window_start, {s.stamp('ws + INTERVAL 24 HOUR')} AS window_end, count(*) AS posts, count(DISTINCT cluster_id) AS clusters "
        "FROM hits WHERE created_at < ws + INTERVAL 24 HOUR GROUP BY ws",
    ),
    "expire_clusters": s.query(
        s.CLU,
        f"SELECT cluster_id, {s.stamp('last_post_at')} AS last_post_at FROM clusters, newest WHERE NOT alert_sent AND as_of - last_post_at > INTERVAL {EXPIRY_HOURS} HOUR",
    ),
    "cluster_status": s.query(s.CLU, "SELECT cluster_id, status, alert_sent::BIGINT AS alert_sent FROM clusters"),
    "active_clusters": s.query(s.CLU, "SELECT cluster_id, size, status FROM clusters WHERE status <> 'expired'"),
}
