"""Reports over the cluster table.

Most read ``base``, the output of :func:`cluster_report_base`: one row per
cluster with coherence. Build it once (it is a stored table) and share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.operators import quality as q
from flockline.operators.alerts import ranked_words
from flockline.operators.clustering import cluster_labels
from flockline.operators.windows import hours_between, running_count
from flockline.session import materialize

NO_TOPIC = K.NO_TOPIC


def cluster_report_base(
    clusters: DataFrame, members: DataFrame, vectors: DataFrame, labels: DataFrame | None = None
) -> DataFrame:
    """Cluster table with coherence, stored so that every report reads it once.

    With ``labels`` (post_id, label) each cluster also gets the most frequent ``label`` of its posts.
    """
    scored = q.coherence(members, vectors)
    base = clusters.join(scored, "cluster_id", "left").withColumn(
        "coherence", F.coalesce("coherence", F.lit(1.0))
    )
    if labels is not None:
        base = base.join(cluster_labels(members, labels).drop("label_posts"), "cluster_id", "left")
    return materialize(base, "report-base")


def engine_stats(base: DataFrame, vectors: DataFrame, sample: int | None = None) -> DataFrame:
    """One row of cluster counts, sizes, coherence and stored vectors."""
    active = F.col("status") == "active"
    size = F.when(active, F.col("size"))
    counts = base.agg(
        F.count_if(active).alias("active_clusters"),
        F.count_if(F.col("status") == "expired").alias("expired_clusters"),
        F.count("*").alias("total_clusters"),
        F.count_if(active & (F.col("size") > K.LARGE_CLUSTER_SIZE)).alias("large_clusters"),
        F.coalesce(F.avg(size), F.lit(0.0)).alias("average_cluster_size"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_cluster_size"),
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_size_all"),
    )
    return counts.select(
        "*",
        q.avg_coherence(base, sample).scalar().alias("average_coherence"),
        vectors.agg(F.count("*")).scalar().alias("vectors_stored"),
    )


def list_clusters(
    clusters: DataFrame,
    members: DataFrame,
    vectors: DataFrame,
    status: str | None = None,
    topic: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """Largest clusters after the filters, with coherence computed only for those returned."""
    kept = clusters
    if status is not None:
        kept = kept.filter(F.col("status") == status)
    if topic is not None:
        kept = kept.filter(F.col("topic") == topic)
    page = materialize(kept.orderBy(F.desc("size"), "cluster_id").limit(limit), "page")
    scored = q.coherence(members.join(page.select("cluster_id"), "cluster_id", "left_semi"), vectors)
    return (
        page.join(scored, "cluster_id", "left")
        .withColumn("coherence", F.coalesce("coherence", F.lit(1.0)))
        .select(
            "cluster_id", "size", "topic", "topic_similarity", "coherence", "created_at", "last_post_at", "status"
        )
        .orderBy(F.desc("size"), "cluster_id")
    )


def first_posts(members: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """The first k members of each cluster that have a post; the rank filter runs before the shuffle."""
    order = Window.partitionBy("cluster_id").orderBy("joined_at", "post_id")
    first = members.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return first.select("cluster_id", "rank", F.col("post_id").alias("id")).join(posts, "id")


def cluster_summary(base: DataFrame, members: DataFrame, prepared: DataFrame, top_k: int = 5) -> DataFrame:
    """One line per cluster: its most frequent words, topic and coherence."""
    ranked = ranked_words(members, prepared, top_k, alphabetic=False)
    listed = F.array_sort(F.collect_list(F.struct("rank", "word")))
    words = ranked.groupBy("cluster_id").agg(
        F.array_join(F.transform(listed, lambda w: w["word"]), ", ").alias("words")
    )
    return base.join(words, "cluster_id").select(
        "cluster_id",
        F.concat(
            F.lit(K.ABOUT),
            "words",
            F.when(F.col("topic").isNotNull(), F.concat(F.lit(" (Topic: "), "topic", F.lit(")"))).otherwise(""),
            F.format_string(" [Coherence: %.2f]", "coherence"),
        ).alias("summary"),
    )


def cluster_detail(
    cluster_id: str,
    clusters: DataFrame,
    members: DataFrame,
    posts: DataFrame,
    vectors: DataFrame,
    prepared: DataFrame,
    sample: int = 10,
) -> DataFrame:
    """One cluster with coherence, summary, its first posts and a look at its centroid."""
    mine = F.col("cluster_id") == cluster_id
    one, own = clusters.filter(mine), members.filter(mine)
    base = cluster_report_base(one, own, vectors)
    entry = F.struct(
        "rank",
        F.col("id").alias("post_id"),
        "text",
        "author_username",
        F.col("created_at").alias("posted_at"),
        F.struct(
            F.col("retweet_count").alias("retweets"),
            F.col("like_count").alias("likes"),
            F.col("reply_count").alias("replies"),
        ).alias("engagement"),
    )
    shown = first_posts(own, posts, sample).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(entry)).alias("sample_posts")
    )
    return (
        base.join(cluster_summary(base, own, prepared), "cluster_id", "left")
        .join(shown, "cluster_id", "left")
        .withColumn("centroid", F.slice("centroid", 1, 5))
    )


def cluster_samples(clusters: DataFrame, members: DataFrame, posts: DataFrame, k: int = 3) -> DataFrame:
    """Active clusters with the texts of their first posts."""
    active = clusters.filter("status = 'active'")
    own = members.join(active.select("cluster_id"), "cluster_id", "left_semi")
    listed = F.array_sort(F.collect_list(F.struct("rank", "text")))
    texts = first_posts(own, posts, k).groupBy("cluster_id").agg(
        F.transform(listed, lambda e: e["text"]).alias("sample_texts")
    )
    return active.join(texts, "cluster_id", "left").withColumn(
        "sample_texts", F.coalesce("sample_texts", F.array().cast("array<string>"))
    )


def topic_distribution(base: DataFrame) -> DataFrame:
    """Clusters per topic and their share of the matched clusters."""
    counts = base.filter("topic IS NOT NULL").groupBy("topic").agg(F.count("*").alias("clusters"))
    share = F.col("clusters") * 100.0 / F.sum("clusters").over(Window.partitionBy())
    return counts.withColumn("percentage", share)


def top_clusters(base: DataFrame, limit: int = 10) -> DataFrame:
    return (
        base.orderBy(F.desc("size"), "cluster_id")
        .limit(limit)
        .select("cluster_id", "size", F.coalesce("topic", F.lit(NO_TOPIC)).alias("topic"), "topic_similarity", "coherence")
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins between the smallest and largest value; empty bins are kept.

    One value only makes a single bin of width one around it, as plotting
    libraries do.
    """
    rows = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    edge = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).head()
    lo, hi = edge["lo"], edge["hi"]
    if lo is not None and lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    spark = df.sparkSession
    if lo is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    width = (hi - lo) / bins
    place = F.least(F.floor((F.col("v") - lo) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    scale = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + F.col("id") * width).alias("lower"),
        (F.lit(lo) + (F.col("id") + 1) * width).alias("upper"),
    )
    return scale.join(counts, "bin", "left").na.fill(0, ["n"])


def size_histogram(base: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(base.filter("status = 'active'"), F.col("size"), bins)


def coherence_histogram(base: DataFrame, bins: int = 20) -> DataFrame:
    return histogram(base.filter("coherence > 0"), F.col("coherence"), bins)


def quality_histogram(base: DataFrame, bins: int = 15) -> DataFrame:
    return histogram(q.quality_scores(base), F.col("quality"), bins)


def cluster_timeline(base: DataFrame) -> DataFrame:
    """Hours since the first cluster and the running number of clusters."""
    start = base.agg(F.min("created_at"))
    placed = running_count(base.select("cluster_id", "created_at"), ["created_at", "cluster_id"])
    return placed.select(
        "cluster_id",
        hours_between(F.col("created_at"), start.scalar()).alias("hours"),
        F.col("position").alias("cumulative_clusters"),
    )


def topic_timeline(base: DataFrame) -> DataFrame:
    """The same for the active clusters of each topic."""
    rows = base.filter("status = 'active' AND topic IS NOT NULL").select("cluster_id", "topic", "created_at")
    placed = running_count(rows, ["created_at", "cluster_id"], ["topic"])
    starts = rows.groupBy("topic").agg(F.min("created_at").alias("start"))
    return placed.join(starts, "topic").select(
        "topic",
        "cluster_id",
        hours_between(F.col("created_at"), F.col("start")).alias("hours"),
        F.col("position").alias("cumulative"),
    )


def label_distribution(rows: DataFrame, label: str = "label", limit: int = 15) -> DataFrame:
    """The most frequent labels."""
    counts = rows.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), label).limit(limit)


def quality_metrics(stats: DataFrame, processing: DataFrame) -> DataFrame:
    """Ratios of the dashboard, and the counts normalised by the larger of the two."""

    def ratio(top: str, bottom: str) -> Column:
        return F.col(top) / F.greatest(F.col(bottom), F.lit(1))

    both = stats.select("*", processing.select(F.struct("*").alias("p")).scalar().alias("p"))
    both = both.withColumn("clustered", F.col("p.posts_clustered")).withColumn(
        "processed", F.col("p.posts_processed")
    )
    most = F.greatest("active_clusters", "large_clusters")

    def scaled(name: str) -> Column:
        return F.when(most > 0, F.col(name) / most).otherwise(0.0)

    return both.select(
        "average_coherence",
        ratio("large_clusters", "active_clusters").alias("large_ratio"),
        ratio("active_clusters", "total_clusters").alias("active_ratio"),
        ratio("clustered", "processed").alias("coverage"),
        scaled("active_clusters").alias("active_scaled"),
        scaled("large_clusters").alias("large_scaled"),
    )


def processing_metrics(
    outcomes: DataFrame, quality_check_interval: int = K.QUALITY_CHECK_INTERVAL, refit_interval: int = K.REFIT_INTERVAL
) -> DataFrame:
    """Counts of a run and the share of posts that joined an existing cluster."""
    clustered = F.count_if(F.col("outcome") == "clustered")
    created = F.count_if(F.col("outcome") == "new_cluster")
    return outcomes.agg(
        F.count("*").alias("posts_processed"),
        created.alias("clusters_created"),
        clustered.alias("posts_clustered"),
        (created + clustered).alias("posts_assigned"),
        F.floor(F.count("*") / quality_check_interval).alias("quality_checks"),
        F.floor(F.count("*") / refit_interval).alias("refits"),
        (clustered * 100.0 / F.greatest(F.count("*"), F.lit(1))).alias("success_rate"),
    )


def topic_similarity_avg(base: DataFrame) -> DataFrame:
    """Active clusters per topic with their mean positive similarity."""
    positive = F.when(F.col("topic_similarity") > 0, F.col("topic_similarity"))
    return (
        base.filter("status = 'active' AND topic IS NOT NULL")
        .groupBy("topic")
        .agg(F.count("*").alias("clusters"), F.coalesce(F.avg(positive), F.lit(0.0)).alias("avg_similarity"))
    )


def pipeline_counts(posts: DataFrame, alerts: DataFrame, batch: str = "batch") -> DataFrame:
    """Processed, failed and alerted numbers and the last event time of each batch."""
    valid = posts.groupBy(batch).agg(
        F.count_if("is_valid").alias("processed"),
        F.count_if(~F.col("is_valid")).alias("errors"),
        F.max("created_at").alias("last_processing_time"),
    )
    sent = alerts.groupBy(batch).agg(F.count("*").alias("alerts_sent"))
    return valid.join(sent, batch, "left").na.fill(0, ["alerts_sent"])


def text_report(base: DataFrame, stats: DataFrame, processing: DataFrame) -> DataFrame:
    """The plain summary as rows (section, name, value): processing, clusters, quality, topics with their share, largest clusters."""

    def rows(df: DataFrame, section: str, names: list[str]) -> DataFrame:
        pairs = ", ".join(f"'{n}', cast({n} as double)" for n in names)
        return df.selectExpr(f"'{section}' as section", f"stack({len(names)}, {pairs}) as (name, value)")

    def listed(df: DataFrame, name: str, sections: dict[str, str]) -> DataFrame:
        pairs = ", ".join(f"'{section}', cast({c} as double)" for section, c in sections.items())
        found = df.selectExpr(f"{name} as name", f"stack({len(sections)}, {pairs}) as (section, value)")
        return found.select("section", "name", "value")

    topics = listed(topic_distribution(base), "topic", {"topics": "clusters", "topic_share": "percentage"})
    largest = listed(
        top_clusters(base, 5),
        "cluster_id",
        {"top_clusters": "size", "top_cluster_similarity": "topic_similarity", "top_cluster_coherence": "coherence"},
    )
    return (
        rows(processing, "processing", ["posts_processed", "posts_clustered", "success_rate"])
        .unionByName(
            rows(
                stats,
                "clusters",
                ["total_clusters", "active_clusters", "large_clusters", "average_cluster_size", "max_cluster_size"],
            )
        )
        .unionByName(rows(stats, "quality", ["average_coherence"]))
        .unionByName(rows(processing, "quality", ["quality_checks", "refits"]))
        .unionByName(topics)
        .unionByName(largest)
    )


