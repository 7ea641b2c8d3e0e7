"""Alert gate, keywords, de-duplication, payloads, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.functions import text as tx
from flockline.functions import vectors as vx
from flockline.operators.kernel import Rule, match_rows
from flockline.operators.leaders import first_independent
from flockline.operators.vectors import UNDATED
from flockline.operators.windows import hours_between
from flockline.session import materialize

_HOUR = 3_600_000_000
INLINE_RULES = 1000  # rules that are compared inside the row; more are joined


def alert_candidates(
    clusters: DataFrame,
    min_size: int = K.MIN_CLUSTER_SIZE,
    topic_similarity: float = K.ALERT_TOPIC_SIMILARITY,
    need_topic: bool = True,
) -> DataFrame:
    gate = (
        (F.col("status") == "active")
        & ~F.col("alert_sent")
        & (F.col("size") >= min_size)
        & (F.col("topic_similarity") >= topic_similarity)
    )
    return clusters.filter(gate & F.col("topic").isNotNull() if need_topic else gate)


def rule_matches(clusters: DataFrame, rules: DataFrame) -> DataFrame:
    """Active clusters and the enabled rules they satisfy (a join on two thresholds).

    A short list of rules enters the plan as one literal array, so the non-equal
    join is an in-row filter. A longer one is joined.
    """
    enabled = rules.filter("enabled")
    table = enabled.limit(INLINE_RULES + 1).collect()
    if len(table) > INLINE_RULES:
        met = (F.col("size") >= F.col("min_cluster_size")) & (F.col("topic_similarity") >= F.col("topic_similarity_threshold"))
        active = clusters.filter("status = 'active'").select("cluster_id", "size", "topic_similarity")
        wanted = enabled.select(F.col("name").alias("rule"), "min_cluster_size", "topic_similarity_threshold")
        return active.join(wanted, met).select("cluster_id", "rule")
    if not table:
        return clusters.limit(0).select("cluster_id", F.lit("").alias("rule"))
    entries = F.array(
        *[
            F.struct(
                F.lit(r["name"]).alias("name"),
                F.lit(r["min_cluster_size"]).alias("s"),
                F.lit(r["topic_similarity_threshold"]).alias("t"),
            )
            for r in table
        ]
    )
    met = F.filter(
        entries, lambda r: (F.col("size") >= r["s"]) & (F.col("topic_similarity") >= r["t"])
    )
    return clusters.filter("status = 'active'").select("cluster_id", F.explode(met).alias("r")).select(
        "cluster_id", F.col("r.name").alias("rule")
    )


def alert_ready_at(members: DataFrame, min_size: int = K.MIN_CLUSTER_SIZE) -> DataFrame:
    """Event time at which each cluster reached ``min_size`` posts.

    The rank filter is applied before the shuffle too, so a large cluster sends
    only its first posts.
    """
    order = Window.partitionBy("cluster_id").orderBy("joined_at", "post_id")
    first = members.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= min_size)
    return first.filter(F.col("__r") == min_size).select("cluster_id", F.col("joined_at").alias("ready_at"))


def ranked_words(
    members: DataFrame, prepared: DataFrame | None = None, top_k: int = 5, alphabetic: bool = True
) -> DataFrame:
    """(cluster_id, rank, word, n): most frequent long words, ties to the first seen.

    Without ``prepared`` the members themselves carry ``cleaned_text``.
    """
    if prepared is not None:
        texts = prepared.select(F.col("id").alias("post_id"), "cleaned_text")
        members = members.select("cluster_id", "post_id", "joined_at").join(texts, "post_id")
    tokens = (
        members.select("cluster_id", "post_id", "joined_at", F.posexplode(tx.words(F.col("cleaned_text"))).alias("pos", "word"))
        .filter(F.length("word") > 3)
    )
    if alphabetic:
        tokens = tokens.filter(F.col("word").rlike(r"^\p{L}+$"))
    counts = tokens.groupBy("cluster_id", "word").agg(
        F.count("*").alias("n"), F.min(F.struct("joined_at", "post_id", "pos")).alias("__first")
    )
    order = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "__first")
    return (
        counts.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top_k)
        .drop("__first")
    )


def _word_lists(ranked: DataFrame) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))
    return ranked.groupBy("cluster_id").agg(F.transform(listed, lambda w: w["word"]).alias("keywords"))


def cluster_keywords(members: DataFrame, prepared: DataFrame | None = None, top_k: int = 5) -> DataFrame:
    return _word_lists(ranked_words(members, prepared, top_k))


def alert_drafts(candidates: DataFrame, keywords: DataFrame, alerted_at: Column) -> DataFrame:
    """Candidate clusters in the shape of alert rows, before de-duplication."""
    topic = F.coalesce("topic", F.lit("general"))
    terms = F.coalesce("keywords", F.array().cast("array<string>"))
    seconds = F.floor(F.unix_micros(alerted_at) / 1_000_000).cast("string")
    return candidates.join(keywords, "cluster_id", "left").select(
        F.concat(F.lit("alert_"), "cluster_id", F.lit("_"), seconds).alias("alert_id"),
        "cluster_id",
        topic.alias("topic"),
        terms.alias("keywords"),
        tx.fingerprint(topic, terms).alias("fingerprint"),
        F.col("centroid").alias("embedding"),
        alerted_at.alias("alerted_at"),
        F.col("size").alias("post_count"),
    )


def _alert_nodes(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        F.col("alert_id").alias("id"),
        F.coalesce(F.unix_micros("alerted_at"), F.lit(UNDATED)).alias("ts"),
        vx.normalize(vx.doubles(F.col("embedding"))).alias("vec"),
        F.col("fingerprint").alias("tag"),
    )


def _conflict(similarity: float, cooldown_hours: float, earlier: bool = True) -> Rule:
    return Rule(
        theta=similarity, strict=True, tag=True, earlier=earlier, max_age=int(cooldown_hours * _HOUR)
    )


def dedupe_alerts(
    drafts: DataFrame,
    history: DataFrame | None = None,
    similarity: float = K.ALERT_DUPLICATE_SIMILARITY,
    cooldown_hours: float = K.ALERT_COOLDOWN_HOURS,
    **blocks,
) -> DataFrame:
    """Drafts with ``kept``: false when an earlier kept alert is within cooldown and alike.

    Alike means the same fingerprint or a cosine above ``similarity``. Alerts
    that were suppressed suppress nothing, so this is the same selection that
    chooses cluster leaders. Alerts of ``history`` were sent before all drafts:
    they suppress within the cooldown, whatever their times and ids.
    """
    rule = _conflict(similarity, cooldown_hours)
    rows = _alert_nodes(drafts)
    if history is not None and not history.isEmpty():
        rows = materialize(rows, "drafts")
        oldest = rows.agg(F.min("ts")).head()[0]
        age = int(cooldown_hours * _HOUR)
        past = _alert_nodes(history)
        if oldest is not None:  # what left the cooldown before the first draft suppresses nothing
            past = past.filter(F.col("ts") >= max(oldest - age, UNDATED))
        past = materialize(past, "history")
        before = _conflict(similarity, cooldown_hours, earlier=False)
        hits = match_rows(rows, past, before, **blocks).select("id").distinct()
        rows = rows.join(hits, "id", "left_anti")
    kept = first_independent(rows, rule, **blocks).withColumn("kept", F.lit(True))
    return drafts.join(kept.withColumnRenamed("id", "alert_id"), "alert_id", "left").withColumn(
        "kept", F.coalesce("kept", F.lit(False))
    )


def suppression_reason(
    deduped: DataFrame,
    similarity: float = K.ALERT_DUPLICATE_SIMILARITY,
    cooldown_hours: float = K.ALERT_COOLDOWN_HOURS,
) -> DataFrame:
    """Why each suppressed alert was held back, and which kept alert did it."""
    age = int(cooldown_hours * _HOUR)
    held = materialize(_alert_nodes(deduped.filter("NOT kept")), "held")
    kept = materialize(_alert_nodes(deduped.filter("kept")), "kept")
    exact = match_rows(held, kept, Rule(theta=None, tag=True, keep="first", earlier=True, max_age=age))
    exact = materialize(exact, "exact")
    others = materialize(held.join(exact, "id", "left_anti"), "others")
    near = match_rows(others, kept, Rule(theta=similarity, strict=True, earlier=True, max_age=age))
    return (
        exact.select("id", "match_id", F.lit("exact").alias("reason"), F.lit(None).cast("double").alias("similarity"))
        .unionByName(near.select("id", "match_id", F.lit("semantic").alias("reason"), "similarity"))
        .select(F.col("id").alias("alert_id"), F.col("match_id").alias("kept_alert_id"), "reason", "similarity")
    )


def record_alerts(deduped: DataFrame, similarity: float = K.ALERT_DUPLICATE_SIMILARITY) -> DataFrame:
    """Rows for the alert table."""
    return deduped.filter("kept").drop("kept").withColumn("threshold", F.lit(similarity))


def alert_cooldown(alerts: DataFrame, as_of: Column, cooldown_hours: float = K.ALERT_COOLDOWN_HOURS) -> DataFrame:
    """Alerts that still block others."""
    return alerts.filter(hours_between(as_of, F.col("alerted_at")) <= cooldown_hours)


def alert_stats(alerts: DataFrame, as_of: Column, top: int = 5) -> DataFrame:
    """One row about the alert history; topics are listed by count, then first seen."""
    recent = hours_between(as_of, F.col("alerted_at")) < 24
    per_topic = alerts.groupBy("topic").agg(
        F.count("*").alias("n"),
        F.count_if(recent).alias("recent"),
        F.min(F.struct("alerted_at", "alert_id")).alias("first"),
        F.max("alerted_at").alias("last"),
    )
    per_topic = materialize(per_topic, "topics")
    best = per_topic.orderBy(F.desc("n"), "first").limit(top)
    entry = F.struct((-F.col("n")).alias("o"), "first", F.concat("topic", F.lit("="), "n").alias("t"))
    listed = best.agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "; ").alias("top_topics")
    )
    totals = per_topic.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_alerts"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("recent_alerts_24h"),
        F.count("*").alias("topics_covered"),
        F.min("first.alerted_at").alias("oldest_alert"),
        F.max("last").alias("newest_alert"),
    )
    return totals.select("*", listed.scalar().alias("top_topics"))


def representative_posts(members: DataFrame, posts: DataFrame, k: int = 3) -> DataFrame:
    """The k most engaging posts of each cluster, ties in member order."""
    rows = members.select("cluster_id", F.col("post_id").alias("id"), "joined_at").join(posts, "id")
    order = Window.partitionBy("cluster_id").orderBy(F.desc(tx.ranking_engagement()), "joined_at", "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cluster_engagement(members: DataFrame, posts: DataFrame) -> DataFrame:
    rows = members.select("cluster_id", F.col("post_id").alias("id")).join(posts, "id")
    return rows.groupBy("cluster_id").agg(F.sum(tx.total_engagement()).alias("engagement"))


def alert_payload(
    clusters: DataFrame, members: DataFrame, posts: DataFrame, preview_length: int = 100
) -> DataFrame:
    """Message fields of each cluster, ready for any notifier.

    Lines are made before posts meet their clusters, so that whole texts do not travel.
    """
    line = F.concat(
        tx.preview(F.col("text"), preview_length),
        F.lit(" | @"),
        "author_username",
        F.format_string(" | %d likes | %d reposts", "like_count", "retweet_count"),
    )
    lines = posts.select("id", "like_count", "retweet_count", line.alias("line"))
    best = representative_posts(members, lines)
    listed = F.array_sort(F.collect_list(F.struct("rank", "line")))
    previews = best.groupBy("cluster_id").agg(F.transform(listed, lambda e: e["line"]).alias("posts"))
    stamp = "yyyy-MM-dd HH:mm"
    return (
        clusters.join(cluster_engagement(members, posts), "cluster_id", "left")
        .join(previews, "cluster_id", "left")
        .select(
            "cluster_id",
            F.coalesce("topic", F.lit(K.GENERAL_TOPIC)).alias("topic"),
            F.concat(F.col("size").cast("string"), F.lit(" posts")).alias("size_text"),
            F.format_string("%.2f%%", F.col("topic_similarity") * 100).alias("similarity_text"),
            F.concat(F.format_number(F.coalesce("engagement", F.lit(0)), 0), F.lit(" interactions")).alias("engagement_text"),
            F.concat(
                F.date_format("created_at", stamp), F.lit(" - "), F.date_format("last_post_at", stamp)
            ).alias("period"),
            F.coalesce("posts", F.array().cast("array<string>")).alias("posts"),
        )
    )


def pending_alerts(deduped: DataFrame) -> DataFrame:
    return deduped.filter("kept").select(
        "alert_id", "cluster_id", "topic", "keywords", "post_count", "alerted_at", F.lit(K.NEW_ALERT).alias("reason")
    )


def summary_report(outcomes: DataFrame, clusters: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: posts processed and clustered, clusters, average size, alerts."""
    posts = outcomes.agg(
        F.count("*").alias("posts_processed"), F.count_if(F.col("outcome") == "clustered").alias("posts_clustered")
    )
    groups = clusters.agg(
        F.count_if(F.col("status") == "active").alias("active_clusters"),
        F.count("*").alias("clusters_created"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_cluster_size"),
    )
    sent = alerts.agg(F.count("*").alias("alerts_sent"))
    packed = groups.select(F.struct("*").alias("g")).scalar()
    return posts.select("*", packed.alias("g"), sent.scalar().alias("alerts_sent")).select(
        "posts_processed", "posts_clustered", "g.*", "alerts_sent"
    )
