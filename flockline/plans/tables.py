"""The given tables seen as posts, vectors, members and clusters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.functions import text as tx
from flockline.functions import vectors as vx
from flockline.operators import alerts as al
from flockline.operators import clustering as cl
from flockline.operators import reports as rp
from flockline.operators import text as to
from flockline.operators import windows as wi
from flockline.session import materialize, spread

DIM = 64
THETA = 0.3  # the given vectors have no near copies: few pairs lie above it
EXPIRY_HOURS = 6
ALERT_COOLDOWN_HOURS = 4
ALERT_SIMILARITY = 0.3
GATE_SIMILARITY = 0.1
HASHTAG_RULES = {
    "click": "Technology Trends",
    "purchase": "Market Analysis",
    "error": "Breaking News",
    "signup": "Product Launches",
}


def stamp(col: Column | str) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def r6(col: Column | str) -> Column:
    return vx.round6(F.col(col) if isinstance(col, str) else col)


def big(col: Column | str) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


class Tables:
    """Lazy views over one data folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def posts(self) -> DataFrame:
        """Documents as posts: whole texts, with the tags, links and times of their events."""
        doc = F.col("doc_id")
        text = F.concat(
            "text",
            F.lit(" #"),
            "event_type",
            F.when(doc % 7 == 0, F.concat(F.lit(" https://x.co/a_"), doc, F.lit("?q=1"))).otherwise(""),
            F.when(doc % 5 == 0, F.concat(F.lit(" @user"), "user_id")).otherwise(""),
            F.when(doc % 11 == 0, " :) top-notch").otherwise(""),
        )
        documents = spread(self.read("documents"), "doc_id")
        joined = documents.join(self.events, F.col("event_id") == doc)
        value = F.col("value")
        return joined.select(
            doc.alias("id"),
            text.alias("text"),
            F.col("user_id").alias("author_id"),
            F.concat(F.lit("user"), "user_id").alias("author_username"),
            F.col("ts").alias("created_at"),
            F.floor(value).cast("int").alias("like_count"),
            F.floor(value / 3).cast("int").alias("retweet_count"),
            F.floor(value / 5).cast("int").alias("reply_count"),
            F.floor(value / 6).cast("int").alias("quote_count"),
            "source",
        )

    @cached_property
    def prepared(self) -> DataFrame:
        return to.prepare_posts(self.posts)

    @cached_property
    def vectors(self) -> DataFrame:
        return (
            self.read("embeddings")
            .join(self.events, F.col("event_id") == F.col("vec_id"))
            .select(
                F.col("vec_id").alias("id"), "embedding", "label", F.col("ts").alias("created_at"), "event_type"
            )
        )

    @cached_property
    def members(self) -> DataFrame:
        """A given clustering: by label and event type."""
        return self.vectors.select(
            F.concat(F.lit("c"), "label", F.lit("-"), "event_type").alias("cluster_id"),
            F.col("id").alias("post_id"),
            F.col("created_at").alias("joined_at"),
        )

    @cached_property
    def topics(self) -> DataFrame:
        return to.topic_vectors(to.topics_of_interest(self.spark), DIM)

    @cached_property
    def as_of(self) -> Column:
        return wi.max_time(self.vectors)

    @cached_property
    def sent(self) -> DataFrame:
        """Clusters with an alert in the past: those of errors."""
        return self.members.filter(F.col("cluster_id").endswith("-error")).select("cluster_id").distinct()

    @cached_property
    def clusters(self) -> DataFrame:
        table = cl.cluster_table(self.members, self.vectors, self.topics)
        return wi.cluster_status(table, self.sent, self.as_of, EXPIRY_HOURS)

    @cached_property
    def base(self) -> DataFrame:
        return rp.cluster_report_base(self.clusters, self.members, self.vectors)

    @cached_property
    def drafts(self) -> DataFrame:
        """Every vector as a draft alert of its label and event type."""
        terms = F.array(F.concat(F.lit("label"), "label"), F.lit("post"))
        return self.vectors.select(
            F.concat(F.lit("alert_"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("alert_id"),
            F.concat(F.lit("c"), "label", F.lit("-"), "event_type").alias("cluster_id"),
            F.col("event_type").alias("topic"),
            terms.alias("keywords"),
            tx.fingerprint(F.col("event_type"), terms).alias("fingerprint"),
            "embedding",
            F.col("created_at").alias("alerted_at"),
            F.lit(1).cast("bigint").alias("post_count"),
        )

    @cached_property
    def deduped(self) -> DataFrame:
        return materialize(
            al.dedupe_alerts(self.drafts, None, ALERT_SIMILARITY, ALERT_COOLDOWN_HOURS), "deduped"
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return al.record_alerts(self.deduped, ALERT_SIMILARITY)

    @cached_property
    def outcomes(self) -> DataFrame:
        """Leader clustering of the given vectors, as outcomes of the posts behind them."""
        found = cl.leader_cluster(self.vectors, THETA)
        led = found.withColumn("leads", F.col("cluster_id") == F.col("post_id").cast("string"))
        return cl.batch_outcomes(self.vectors, led)
