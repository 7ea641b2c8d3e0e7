"""Alert queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline import schemas
from flockline.functions import vectors as vx
from flockline.operators import alerts as al
from flockline.plans import sql as s
from flockline.plans import tables as tb
from flockline.plans.tables import Tables, big, r6, stamp

RULES = [("small", 3, 0.0, True), ("medium", 8, 0.05, True), ("large", 12, 0.1, True), ("off", 1, 0.0, False)]


def alert_candidates(spark, path):
    found = al.alert_candidates(Tables(spark, path).clusters, topic_similarity=tb.GATE_SIMILARITY)
    return found.select("cluster_id", "size", "topic", r6("topic_similarity").alias("topic_similarity"))


def rule_matches(spark, path):
    rules = spark.createDataFrame(RULES, schemas.ALERT_RULES)
    return al.rule_matches(Tables(spark, path).clusters, rules)


def alert_ready_at(spark, path):
    found = al.alert_ready_at(Tables(spark, path).members)
    return found.select("cluster_id", stamp("ready_at").alias("ready_at"))


def cluster_keywords(spark, path):
    t = Tables(spark, path)
    found = al.cluster_keywords(t.members, t.prepared)
    return found.select("cluster_id", F.array_join("keywords", ",").alias("keywords"))


def dedupe_alerts(spark, path):
    return Tables(spark, path).deduped.select("alert_id", big("kept").alias("kept"))


def suppression_reason(spark, path):
    found = al.suppression_reason(Tables(spark, path).deduped, tb.ALERT_SIMILARITY, tb.ALERT_COOLDOWN_HOURS)
    return found.select(
        "alert_id", "kept_alert_id", "reason", r6(F.coalesce("similarity", F.lit(0.0))).alias("similarity")
    )


def record_alerts(spark, path):
    return Tables(spark, path).alerts.select(
        "alert_id",
        "cluster_id",
        "topic",
        F.array_join("keywords", ",").alias("keywords"),
        "fingerprint",
        r6(vx.total(vx.normalize(vx.doubles(F.col("embedding"))))).alias("embedding_total"),
        stamp("alerted_at").alias("alerted_at"),
        "post_count",
        r6("threshold").alias("threshold"),
    )


def alert_stats(spark, path):
    t = Tables(spark, path)
    found = al.alert_stats(t.alerts, t.as_of)
    return found.select(
        big("total_alerts").alias("total_alerts"),
        big("recent_alerts_24h").alias("recent_alerts_24h"),
        "topics_covered",
        stamp("oldest_alert").alias("oldest_alert"),
        stamp("newest_alert").alias("newest_alert"),
        "top_topics",
    )


def alert_cooldown(spark, path):
    t = Tables(spark, path)
    return al.alert_cooldown(t.alerts, t.as_of, 12).select("alert_id", stamp("alerted_at").alias("alerted_at"))


def representative_posts(spark, path):
    t = Tables(spark, path)
    return al.representative_posts(t.members, t.posts).select("cluster_id", "rank", "id", "text")


def cluster_engagement(spark, path):
    t = Tables(spark, path)
    return al.cluster_engagement(t.members, t.posts).select("cluster_id", big("engagement").alias("engagement"))


def alert_payload(spark, path):
    t = Tables(spark, path)
    found = al.alert_payload(t.clusters, t.members, t.posts)
    return found.withColumn("posts", F.array_join("posts", "\n"))


def pending_alerts(spark, path):
    found = al.pending_alerts(Tables(spark, path).deduped)
    return found.select(
        "alert_id",
        "cluster_id",
        "topic",
        F.array_join("keywords", ",").alias("keywords"),
        "post_count",
        stamp("alerted_at").alias("alerted_at"),
        "reason",
    )


def summary_report(spark, path):
    t = Tables(spark, path)
    found = al.summary_report(t.outcomes, t.clusters, t.alerts)
    return found.withColumn("average_cluster_size", r6("average_cluster_size"))


QUERIES = {f.__name__: f for f in (
    alert_candidates, rule_matches, alert_ready_at, cluster_keywords, dedupe_alerts, suppression_reason,
    record_alerts, alert_stats, alert_cooldown, representative_posts, cluster_engagement, alert_payload,
    pending_alerts, summary_report,
)}

WORDS = """ctok AS (SELECT cluster_id, joined_at, post_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM
  (SELECT m.cluster_id, m.joined_at, m.post_id, list_filter(string_split(p.cleaned_text, ' '), lambda x: x <> '') AS w
   FROM mem m JOIN prepared p ON p.id = m.post_id)),
cw AS (SELECT cluster_id, word, count(*) AS n, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC,
    min(row(joined_at, post_id, pos))) AS r FROM ctok WHERE length(word) > 3 {extra} GROUP BY 1, 2),
kw AS (SELECT cluster_id, string_agg(word, '{sep}' ORDER BY r) AS keywords FROM cw WHERE r <= 5 GROUP BY 1)"""
_REP = """rep AS (SELECT cluster_id, post_id AS id, text, author_username, like_count, retweet_count, row_number() OVER (PARTITION BY cluster_id
  ORDER BY like_count + retweet_count DESC, joined_at, post_id) AS rank FROM mem JOIN posts ON id = post_id),
eng AS (SELECT cluster_id, sum(like_count + retweet_count + reply_count)::BIGINT AS engagement FROM mem JOIN posts ON id = post_id GROUP BY 1)"""
_KEPT = "alerts AS (SELECT * FROM deduped WHERE kept)"

ORACLES = {
    "alert_candidates": s.query(
        s.CLU,
        f"SELECT cluster_id, size, topic, {s.r6('topic_similarity')} AS topic_similarity FROM clusters WHERE status = 'active' AND NOT alert_sent "
        f"AND size >= 5 AND clusters.topic_similarity >= {tb.GATE_SIMILARITY} AND topic IS NOT NULL",
    ),
    "rule_matches": s.query(
        [*s.CLU, "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b}::DOUBLE, {str(e).lower()})" for n, a, b, e in RULES) + ") v(rule, ms, ts, enabled))"],
        "SELECT cluster_id, rule FROM clusters JOIN rules ON size >= ms AND topic_similarity >= ts WHERE enabled AND status = 'active'",
    ),
    "alert_ready_at": s.query(
        [s.VEC, s.MEM],
        f"SELECT cluster_id, {s.stamp('joined_at')} AS ready_at FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY joined_at, post_id) AS r FROM mem) WHERE r = 5",
    ),
    "cluster_keywords": s.query(
        [*s.PRE, s.VEC, s.MEM, WORDS.format(extra=r"AND regexp_full_match(word, '\p{L}+')", sep=",")],
        "SELECT cluster_id, keywords FROM kw",
    ),
    "dedupe_alerts": s.query(s.ALR, "SELECT alert_id, kept::BIGINT AS kept FROM deduped"),
    "suppression_reason": s.query(
        [
            *s.ALR,
            "ex AS (SELECT j, min(i) AS i FROM conf JOIN keep ON keep.k = conf.i WHERE same GROUP BY 1)",
            f"sem AS (SELECT j, i, s, row_number() OVER (PARTITION BY j ORDER BY s DESC, i) AS r FROM conf JOIN keep ON keep.k = conf.i WHERE s > {tb.ALERT_SIMILARITY})",
        ],
        "SELECT d.alert_id, o.alert_id AS kept_alert_id, CASE WHEN ex.i IS NOT NULL THEN 'exact' ELSE 'semantic' END AS reason, "
        + s.r6("CASE WHEN ex.i IS NOT NULL THEN 0.0 ELSE sem.s END")
        + " AS similarity FROM deduped d LEFT JOIN ex ON ex.j = d.k LEFT JOIN sem ON sem.j = d.k AND sem.r = 1 "
        "JOIN drafts o ON o.k = coalesce(ex.i, sem.i) WHERE NOT d.kept",
    ),
    "record_alerts": s.query(
        [*s.ALR, _KEPT],
        f"SELECT alert_id, cluster_id, topic, keywords, fingerprint, {s.r6('list_sum(u)')} AS embedding_total, {s.stamp('alerted_at')} AS alerted_at, "
        f"1::BIGINT AS post_count, {tb.ALERT_SIMILARITY}::DOUBLE AS threshold FROM alerts",
    ),
    "alert_stats": s.query(
        [
            *s.ALR,
            _KEPT,
            "newest AS (SELECT max(created_at) AS as_of FROM vec)",
            "pt AS (SELECT topic, count(*) AS n, min(row(alerted_at, alert_id)) AS f FROM alerts GROUP BY 1)",
        ],
        f"SELECT count(*) AS total_alerts, count(*) FILTER (epoch_us(as_of) - epoch_us(alerted_at) < 86400000000) AS recent_alerts_24h, count(DISTINCT topic) AS topics_covered, "
        f"{s.stamp('min(alerted_at)')} AS oldest_alert, {s.stamp('max(alerted_at)')} AS newest_alert, "
        "(SELECT string_agg(topic || '=' || n, '; ' ORDER BY n DESC, f) FROM (SELECT * FROM pt ORDER BY n DESC, f LIMIT 5)) AS top_topics FROM alerts, newest",
    ),
    "alert_cooldown": s.query(
        [*s.ALR, _KEPT, "newest AS (SELECT max(created_at) AS as_of FROM vec)"],
        f"SELECT alert_id, {s.stamp('alerted_at')} AS alerted_at FROM alerts, newest WHERE epoch_us(as_of) - epoch_us(alerts.alerted_at) <= 12 * 3600000000",
    ),
    "representative_posts": s.query(
        [s.POSTS, s.VEC, s.MEM, _REP], "SELECT cluster_id, rank, id, text FROM rep WHERE rank <= 3"
    ),
    "cluster_engagement": s.query([s.POSTS, s.VEC, s.MEM, _REP], "SELECT cluster_id, engagement FROM eng"),
    "alert_payload": s.query(
        [
            s.POSTS,
            *s.CLU,
            _REP,
            "pv AS (SELECT cluster_id, string_agg(CASE WHEN length(text) > 100 THEN substr(text,1,100) || '...' ELSE text END || ' | @' || author_username || "
            "' | ' || like_count || ' likes | ' || retweet_count || ' reposts', chr(10) ORDER BY rank) AS posts FROM rep WHERE rank <= 3 GROUP BY 1)",
        ],
        "SELECT cluster_id, coalesce(topic, 'General Discussion') AS topic, size || ' posts' AS size_text, printf('%.2f%%', topic_similarity * 100) AS similarity_text, "
        "format('{:,}', coalesce(engagement, 0)) || ' interactions' AS engagement_text, strftime(created_at, '%Y-%m-%d %H:%M') || ' - ' || strftime(last_post_at, '%Y-%m-%d %H:%M') AS period, "
        "coalesce(pv.posts, '') AS posts FROM clusters LEFT JOIN eng USING (cluster_id) LEFT JOIN pv USING (cluster_id)",
    ),
    "pending_alerts": s.query(
        [*s.ALR, _KEPT],
        f"SELECT alert_id, cluster_id, topic, keywords, 1::BIGINT AS post_count, {s.stamp('alerted_at')} AS alerted_at, 'New alert' AS reason FROM alerts",
    ),
    "summary_report": s.query(
        [*s.CLU, s.LEADERS, s.OUTCOMES, s.DRAFTS, s.DEDUPED],
        "SELECT (SELECT count(*) FROM outcomes) AS posts_processed, (SELECT count(*) FROM outcomes WHERE outcome = 'clustered') AS posts_clustered, "
        f"count(*) FILTER (status = 'active') AS active_clusters, count(*) AS clusters_created, {s.r6('avg(size)')} AS average_cluster_size, "
        "(SELECT count(*) FROM deduped WHERE kept) AS alerts_sent FROM clusters",
    ),
}
