"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline.functions import vectors as vx
from flockline.operators import reports as rp
from flockline.operators import text as to
from flockline.plans import sql as s
from flockline.plans.alerts import WORDS
from flockline.plans.quality import QUALITY
from flockline.plans.tables import Tables, big, r6, stamp
from flockline.sources.posts import check_posts

DETAIL = "c1-click"


def cluster_report_base(spark, path):
    return Tables(spark, path).base.select(
        "cluster_id",
        "size",
        "status",
        "topic",
        r6("topic_similarity").alias("topic_similarity"),
        r6("coherence").alias("coherence"),
        stamp("created_at").alias("created_at"),
        stamp("last_post_at").alias("last_post_at"),
    )


def engine_stats(spark, path):
    t = Tables(spark, path)
    found = rp.engine_stats(t.base, t.vectors)
    for name in ("average_cluster_size", "average_size_all", "average_coherence"):
        found = found.withColumn(name, r6(name))
    return found


def list_clusters(spark, path):
    t = Tables(spark, path)
    found = rp.list_clusters(t.clusters, t.members, t.vectors, status="active", limit=50)
    return found.select(
        "cluster_id",
        "size",
        "topic",
        r6("topic_similarity").alias("topic_similarity"),
        r6("coherence").alias("coherence"),
        stamp("created_at").alias("created_at"),
        "status",
    )


def cluster_detail(spark, path):
    t = Tables(spark, path)
    found = rp.cluster_detail(DETAIL, t.clusters, t.members, t.posts, t.vectors, t.prepared)
    return found.select(
        "cluster_id",
        "size",
        "status",
        "topic",
        r6("coherence").alias("coherence"),
        "summary",
        r6(vx.total(F.col("centroid"))).alias("preview_total"),
        F.posexplode("sample_posts").alias("n", "p"),
    ).select(
        "cluster_id", "size", "status", "topic", "coherence", "summary", "preview_total", "p.rank", "p.post_id", "p.text",
        "p.author_username", big("p.engagement.retweets").alias("retweets"), big("p.engagement.likes").alias("likes"),
        big("p.engagement.replies").alias("replies"),
    )


def cluster_samples(spark, path):
    t = Tables(spark, path)
    found = rp.cluster_samples(t.clusters, t.members, t.posts)
    return found.select("cluster_id", "size", F.array_join("sample_texts", "\n").alias("texts"))


def cluster_summary(spark, path):
    t = Tables(spark, path)
    clustered = t.members.select(F.col("post_id").alias("id"))
    # Texts of other posts are not cleaned; those that are left are dealt out evenly, wherever their ids lay.
    posts = t.posts.join(clustered, "id", "left_semi").repartition(F.xxhash64("id"))
    return rp.cluster_summary(t.base, t.members, to.prepare_posts(posts))


def topic_distribution(spark, path):
    found = rp.topic_distribution(Tables(spark, path).base)
    return found.select("topic", "clusters", r6("percentage").alias("percentage"))


def top_clusters(spark, path):
    found = rp.top_clusters(Tables(spark, path).base)
    return found.select(
        "cluster_id", "size", "topic", r6("topic_similarity").alias("topic_similarity"), r6("coherence").alias("coherence")
    )


def _bins(found):
    return found.select(big("bin").alias("bin"), r6("lower").alias("lower"), r6("upper").alias("upper"), "n")


def size_histogram(spark, path):
    return _bins(rp.size_histogram(Tables(spark, path).base))


def coherence_histogram(spark, path):
    return _bins(rp.coherence_histogram(Tables(spark, path).base))


def quality_histogram(spark, path):
    return _bins(rp.quality_histogram(Tables(spark, path).base))


def cluster_timeline(spark, path):
    found = rp.cluster_timeline(Tables(spark, path).clusters)
    return found.select("cluster_id", r6("hours").alias("hours"), "cumulative_clusters")


def topic_timeline(spark, path):
    found = rp.topic_timeline(Tables(spark, path).clusters)
    return found.select("topic", "cluster_id", r6("hours").alias("hours"), "cumulative")


def label_distribution(spark, path):
    return rp.label_distribution(Tables(spark, path).posts, "author_username").withColumnRenamed(
        "author_username", "label"
    )


def quality_metrics(spark, path):
    t = Tables(spark, path)
    found = rp.quality_metrics(rp.engine_stats(t.base, t.vectors), rp.processing_metrics(t.outcomes))
    return found.select(*[r6(c).alias(c) for c in found.columns])


def processing_metrics(spark, path):
    found = rp.processing_metrics(Tables(spark, path).outcomes)
    return found.withColumn("success_rate", r6("success_rate"))


def topic_similarity_avg(spark, path):
    found = rp.topic_similarity_avg(Tables(spark, path).base)
    return found.select("topic", "clusters", r6("avg_similarity").alias("avg_similarity"))


def pipeline_counts(spark, path):
    """Posts and kept alerts per day as batches; posts of one source lack an author and are errors."""
    t = Tables(spark, path)
    day = F.date_format("created_at", "yyyy-MM-dd")
    author = F.when(F.col("source") != "src3", F.col("author_username"))
    raw = t.posts.withColumn("post_id", F.col("id")).withColumn("author_username", author)
    checked = check_posts(raw, F.lit(None).cast("timestamp")).withColumn("batch", day)
    alerts = t.alerts.withColumn("batch", F.date_format("alerted_at", "yyyy-MM-dd"))
    found = rp.pipeline_counts(checked, alerts)
    return found.withColumn("last_processing_time", stamp("last_processing_time"))


def text_report(spark, path):
    t = Tables(spark, path)
    found = rp.text_report(t.base, rp.engine_stats(t.base, t.vectors), rp.processing_metrics(t.outcomes))
    return found.withColumn("value", r6("value"))


QUERIES = {f.__name__: f for f in (
    cluster_report_base, engine_stats, list_clusters, cluster_detail, cluster_samples, cluster_summary,
    topic_distribution, top_clusters, size_histogram, coherence_histogram, quality_histogram, cluster_timeline,
    topic_timeline, label_distribution, quality_metrics, processing_metrics, topic_similarity_avg,
    pipeline_counts, text_report,
)}

_STATS = """stats AS MATERIALIZED (SELECT count(*) FILTER (status = 'active') AS active_clusters, count(*) FILTER (status = 'expired') AS expired_clusters,
  count(*) AS total_clusters, count(*) FILTER (status = 'active' AND size > 50) AS large_clusters,
  coalesce(avg(size) FILTER (status = 'active'), 0.0) AS average_cluster_size, coalesce(max(size) FILTER (status = 'active'), 0) AS max_cluster_size,
  avg(size) AS average_size_all,
  (SELECT coalesce(avg(coherence), 0.0) FROM base WHERE status = 'active') AS average_coherence,
  (SELECT count(*) FROM vec) AS vectors_stored FROM base)"""
_PROC = """proc AS MATERIALIZED (SELECT count(*) AS posts_processed, count(*) FILTER (outcome = 'new_cluster') AS clusters_created,
  count(*) FILTER (outcome = 'clustered') AS posts_clustered, count(*) AS posts_assigned, count(*) // 100 AS quality_checks, count(*) // 1000 AS refits,
  count(*) FILTER (outcome = 'clustered') * 100.0::DOUBLE / greatest(count(*), 1) AS success_rate FROM outcomes)"""
_FIRST = """fp AS (SELECT m.cluster_id, m.rank, p.* FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY joined_at, post_id) AS rank FROM mem) m
  JOIN posts p ON p.id = m.post_id)"""
_SUMMARY = """summ AS (SELECT cluster_id, 'Cluster about: ' || keywords || CASE WHEN topic IS NOT NULL THEN ' (Topic: ' || topic || ')' ELSE '' END ||
  printf(' [Coherence: %.2f]', coherence) AS summary FROM base JOIN kw USING (cluster_id))"""
_LONG = WORDS.format(extra="", sep=", ")


def _hist(rows: str, bins: int) -> list[str]:
    return [
        f"hv AS (SELECT v::DOUBLE AS v FROM ({rows}))",
        "he AS (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo, CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM hv)",
        f"hb AS (SELECT least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})::BIGINT AS bin, count(*) AS n FROM hv, he GROUP BY 1)",
    ]


def _hist_body(bins: int) -> str:
    w = f"((hi - lo) / {bins})"
    return f"SELECT g.bin, {s.r6(f'lo + g.bin * {w}')} AS lower, {s.r6(f'lo + (g.bin + 1) * {w}')} AS upper, coalesce(hb.n, 0) AS n FROM he, generate_series(0, {bins - 1}) g(bin) LEFT JOIN hb ON hb.bin = g.bin WHERE lo IS NOT NULL"


ORACLES = {
    "cluster_report_base": s.query(
        s.REP,
        f"SELECT cluster_id, size, status, topic, {s.r6('topic_similarity')} AS topic_similarity, {s.r6('coherence')} AS coherence, "
        f"{s.stamp('created_at')} AS created_at, {s.stamp('last_post_at')} AS last_post_at FROM base",
    ),
    "engine_stats": s.query(
        [*s.REP, _STATS],
        f"SELECT * REPLACE ({s.r6('average_cluster_size')} AS average_cluster_size, {s.r6('average_size_all')} AS average_size_all, "
        f"{s.r6('average_coherence')} AS average_coherence) FROM stats",
    ),
    "list_clusters": s.query(
        s.REP,
        f"SELECT cluster_id, size, topic, {s.r6('topic_similarity')} AS topic_similarity, {s.r6('coherence')} AS coherence, {s.stamp('created_at')} AS created_at, status "
        "FROM base WHERE status = 'active' ORDER BY size DESC, cluster_id LIMIT 50",
    ),
    "cluster_detail": s.query(
        [*s.PRE, *s.REP, _LONG, _SUMMARY, _FIRST],
        f"SELECT cluster_id, size, status, topic, {s.r6('coherence')} AS coherence, summary, {s.r6('list_sum(centroid[1:5])')} AS preview_total, rank, id AS post_id, text, "
        "author_username, retweet_count AS retweets, like_count AS likes, reply_count AS replies FROM base JOIN fp USING (cluster_id) LEFT JOIN summ USING (cluster_id) "
        f"WHERE cluster_id = '{DETAIL}' AND rank <= 10",
    ),
    "cluster_samples": s.query(
        [s.POSTS, *s.CLU, _FIRST],
        "SELECT cluster_id, size, coalesce(texts, '') AS texts FROM clusters LEFT JOIN (SELECT cluster_id, string_agg(text, chr(10) ORDER BY rank) AS texts FROM fp "
        "WHERE rank <= 3 GROUP BY 1) USING (cluster_id) WHERE status = 'active'",
    ),
    "cluster_summary": s.query([*s.PRE, *s.REP, _LONG, _SUMMARY], "SELECT cluster_id, summary FROM summ"),
    "topic_distribution": s.query(
        s.REP,
        f"SELECT topic, n AS clusters, {s.r6('n * 100.0::DOUBLE / t')} AS percentage FROM (SELECT topic, count(*) AS n, (SELECT count(*) FROM base WHERE topic IS NOT NULL) AS t "
        "FROM base WHERE topic IS NOT NULL GROUP BY 1)",
    ),
    "top_clusters": s.query(
        s.REP,
        f"SELECT cluster_id, size, coalesce(topic, 'No Topic') AS topic, {s.r6('topic_similarity')} AS topic_similarity, {s.r6('coherence')} AS coherence FROM base "
        "ORDER BY size DESC, cluster_id LIMIT 10",
    ),
    "size_histogram": s.query(
        [*s.CLU, *_hist("SELECT size AS v FROM clusters WHERE status = 'active'", 20)], _hist_body(20)
    ),
    "coherence_histogram": s.query(
        [*s.REP, *_hist("SELECT coherence AS v FROM base WHERE coherence > 0", 20)], _hist_body(20)
    ),
    "quality_histogram": s.query(
        [*s.REP, *_hist(f"SELECT {QUALITY} AS v FROM base WHERE status = 'active'", 15)], _hist_body(15)
    ),
    "cluster_timeline": s.query(
        s.CLU,
        f"SELECT cluster_id, {s.r6('(epoch_us(created_at) - epoch_us((SELECT min(created_at) FROM clusters))) / 3600000000.0')} AS hours, "
        "row_number() OVER (ORDER BY created_at, cluster_id) AS cumulative_clusters FROM clusters",
    ),
    "topic_timeline": s.query(
        s.CLU,
        f"SELECT topic, cluster_id, {s.r6('(epoch_us(created_at) - epoch_us(min(created_at) OVER (PARTITION BY topic))) / 3600000000.0')} AS hours, "
        "row_number() OVER (PARTITION BY topic ORDER BY created_at, cluster_id) AS cumulative FROM clusters WHERE status = 'active' AND topic IS NOT NULL",
    ),
    "label_distribution": s.query(
        [s.POSTS],
        "SELECT author_username AS label, count(*) AS n FROM posts GROUP BY 1 ORDER BY n DESC, label LIMIT 15",
    ),
    "quality_metrics": s.query(
        [*s.REP, _STATS, s.LEADERS, s.OUTCOMES, _PROC],
        f"SELECT {s.r6('average_coherence')} AS average_coherence, {s.r6('large_clusters / greatest(active_clusters, 1)')} AS large_ratio, "
        f"{s.r6('active_clusters / greatest(total_clusters, 1)')} AS active_ratio, {s.r6('posts_clustered / greatest(posts_processed, 1)')} AS coverage, "
        f"{s.r6('CASE WHEN greatest(active_clusters, large_clusters) > 0 THEN active_clusters / greatest(active_clusters, large_clusters) ELSE 0.0 END')} AS active_scaled, "
        f"{s.r6('CASE WHEN greatest(active_clusters, large_clusters) > 0 THEN large_clusters / greatest(active_clusters, large_clusters) ELSE 0.0 END')} AS large_scaled FROM stats, proc",
    ),
    "processing_metrics": s.query(
        [*s.SEQ, s.OUTCOMES, _PROC], f"SELECT * REPLACE ({s.r6('success_rate')} AS success_rate) FROM proc"
    ),
    "topic_similarity_avg": s.query(
        s.REP,
        f"SELECT topic, count(*) AS clusters, {s.r6('coalesce(avg(topic_similarity) FILTER (topic_similarity > 0), 0.0)')} AS avg_similarity FROM base "
        "WHERE status = 'active' AND topic IS NOT NULL GROUP BY 1",
    ),
    "pipeline_counts": s.query(
        [
            s.POSTS,
            *s.ALR,
            "sent AS (SELECT strftime(alerted_at, '%Y-%m-%d') AS batch, count(*) AS n FROM deduped WHERE kept GROUP BY 1)",
        ],
        f"SELECT batch, processed, errors, last_processing_time, coalesce(n, 0) AS alerts_sent FROM (SELECT strftime(created_at, '%Y-%m-%d') AS batch, count(*) FILTER (source <> 'src3') AS processed, "
        f"count(*) FILTER (source = 'src3') AS errors, {s.stamp('max(created_at)')} AS last_processing_time FROM posts GROUP BY 1) LEFT JOIN sent USING (batch)",
    ),
    "text_report": s.query(
        [*s.REP, _STATS, s.LEADERS, s.OUTCOMES, _PROC, "top5 AS (SELECT * FROM base ORDER BY size DESC, cluster_id LIMIT 5)"],
        f"SELECT section, name, {s.r6('value')} AS value FROM ("
        "SELECT 'processing' AS section, 'posts_processed' AS name, posts_processed::DOUBLE AS value FROM proc UNION ALL SELECT 'processing', 'posts_clustered', posts_clustered FROM proc "
        "UNION ALL SELECT 'processing', 'success_rate', success_rate FROM proc UNION ALL SELECT 'clusters', 'total_clusters', total_clusters FROM stats "
        "UNION ALL SELECT 'clusters', 'active_clusters', active_clusters FROM stats UNION ALL SELECT 'clusters', 'large_clusters', large_clusters FROM stats "
        "UNION ALL SELECT 'clusters', 'average_cluster_size', average_cluster_size FROM stats UNION ALL SELECT 'clusters', 'max_cluster_size', max_cluster_size FROM stats "
        "UNION ALL SELECT 'quality', 'average_coherence', average_coherence FROM stats "
        "UNION ALL SELECT 'quality', 'quality_checks', quality_checks FROM proc UNION ALL SELECT 'quality', 'refits', refits FROM proc "
        "UNION ALL SELECT 'topics', topic, count(*) FROM base WHERE topic IS NOT NULL GROUP BY topic "
        "UNION ALL SELECT 'topic_share', topic, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () FROM base WHERE topic IS NOT NULL GROUP BY topic "
        "UNION ALL SELECT 'top_clusters', cluster_id, size FROM top5 UNION ALL SELECT 'top_cluster_similarity', cluster_id, topic_similarity FROM top5 "
        "UNION ALL SELECT 'top_cluster_coherence', cluster_id, coherence FROM top5)",
    ),
}
