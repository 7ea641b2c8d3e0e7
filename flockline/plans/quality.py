"""Quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline.operators import clustering as cl
from flockline.operators import quality as q
from flockline.plans import sql as s
from flockline.plans.tables import Tables, r6


def coherence(spark, path):
    t = Tables(spark, path)
    return q.coherence(t.members, t.vectors).select("cluster_id", r6("coherence").alias("coherence"))


def coherence_fast(spark, path):
    t = Tables(spark, path)
    found = q.coherence_fast(cl.cluster_features(t.members, t.vectors))
    return found.select("cluster_id", r6("coherence").alias("coherence"))


def low_coherence(spark, path):
    found = q.low_coherence(Tables(spark, path).base)
    return found.select("cluster_id", "size", r6("coherence").alias("coherence"))


def quality_score(spark, path):
    return q.quality_scores(Tables(spark, path).base).select("cluster_id", r6("quality").alias("quality"))


def health_matrix(spark, path):
    return q.health_matrix(Tables(spark, path).base)


def health_pivot(spark, path):
    small, medium, large = q.SIZE_BINS
    return q.health_pivot(Tables(spark, path).base).select(
        "coherence_bin", F.col(small).alias("small"), F.col(medium).alias("medium"), F.col(large).alias("large")
    )


def topic_quality(spark, path):
    return q.topic_quality(Tables(spark, path).base).select("topic", r6("quality").alias("quality"))


def coherence_vs_size(spark, path):
    found = q.coherence_vs_size(Tables(spark, path).base)
    return found.select("cluster_id", "size", r6("coherence").alias("coherence"))


def similarity_vs_size(spark, path):
    found = q.similarity_vs_size(Tables(spark, path).base)
    return found.select("cluster_id", "size", "topic", r6("topic_similarity").alias("topic_similarity"))


def avg_coherence_sample(spark, path):
    found = q.avg_coherence(Tables(spark, path).base)
    return found.select(r6("average_coherence").alias("average_coherence"))


QUERIES = {f.__name__: f for f in (
    coherence, coherence_fast, low_coherence, quality_score, health_matrix, health_pivot, topic_quality,
    coherence_vs_size, similarity_vs_size, avg_coherence_sample,
)}

_BINNED = """binned AS (SELECT CASE WHEN size <= 2 THEN 'Small (1-2)' WHEN size <= 10 THEN 'Medium (3-10)' ELSE 'Large (11+)' END AS size_bin,
  CASE WHEN coherence < 0.5 THEN 'Low (<0.5)' WHEN coherence < 0.8 THEN 'Medium (0.5-0.8)' ELSE 'High (0.8+)' END AS coherence_bin
  FROM base WHERE status = 'active')"""
QUALITY = """(greatest(coherence, 0.0) + least(size / 10, 1.0) + greatest(topic_similarity, 0.0)) / 3"""

ORACLES = {
    "coherence": s.query([s.VEC, s.MEM, s.COHERENCE], f"SELECT cluster_id, {s.r6('coherence')} AS coherence FROM coh"),
    "coherence_fast": s.query(
        [s.VEC, s.MEM, s.COHERENCE],
        "SELECT cluster_id, "
        + s.r6("CASE WHEN count(s) = 0 THEN 1.0 ELSE avg(s) END")
        + " AS coherence FROM (SELECT DISTINCT cluster_id FROM mem) LEFT JOIN coh0 USING (cluster_id) GROUP BY 1",
    ),
    "low_coherence": s.query(
        s.REP,
        f"SELECT cluster_id, size, {s.r6('coherence')} AS coherence FROM base WHERE status = 'active' AND size > 5 AND coherence < 0.6",
    ),
    "quality_score": s.query(
        s.REP, f"SELECT cluster_id, {s.r6(QUALITY)} AS quality FROM base WHERE status = 'active'"
    ),
    "health_matrix": s.query(
        [*s.REP, _BINNED],
        "SELECT size_bin, coherence_bin, count(b.n) AS clusters FROM (VALUES ('Small (1-2)'), ('Medium (3-10)'), ('Large (11+)')) x(size_bin) "
        "CROSS JOIN (VALUES ('Low (<0.5)'), ('Medium (0.5-0.8)'), ('High (0.8+)')) y(coherence_bin) "
        "LEFT JOIN (SELECT *, 1 AS n FROM binned) b USING (size_bin, coherence_bin) GROUP BY 1, 2",
    ),
    "health_pivot": s.query(
        [*s.REP, _BINNED],
        "SELECT coherence_bin, count(*) FILTER (size_bin = 'Small (1-2)') AS small, count(*) FILTER (size_bin = 'Medium (3-10)') AS medium, "
        "count(*) FILTER (size_bin = 'Large (11+)') AS large FROM binned GROUP BY 1",
    ),
    "topic_quality": s.query(
        s.REP,
        "SELECT topic, "
        + s.r6("(coalesce(avg(coherence) FILTER (coherence > 0), 0.0) + least(avg(size) / 5, 1.0)) / 2")
        + " AS quality FROM base WHERE status = 'active' AND topic IS NOT NULL GROUP BY 1",
    ),
    "coherence_vs_size": s.query(
        s.REP, f"SELECT cluster_id, size, {s.r6('coherence')} AS coherence FROM base WHERE base.coherence > 0"
    ),
    "similarity_vs_size": s.query(
        s.REP,
        f"SELECT cluster_id, size, coalesce(topic, 'None') AS topic, {s.r6('topic_similarity')} AS topic_similarity FROM base WHERE base.topic_similarity > 0",
    ),
    "avg_coherence_sample": s.query(
        s.REP,
        f"SELECT {s.r6('coalesce(avg(coherence), 0.0)')} AS average_coherence FROM (SELECT * FROM base ORDER BY created_at, cluster_id LIMIT 10) WHERE status = 'active'",
    ),
}
