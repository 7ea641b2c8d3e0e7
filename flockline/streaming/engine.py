"""The clustering and alerting loop as a ``foreachBatch`` job over versioned tables.

A micro-batch reads the version before its own and writes the version of its own id, so a
replayed batch reads the same input and overwrites its own output: running it twice changes
nothing. What a batch reads is bounded by what is alive, not by the history:

* ``parts`` holds the additive summary (n, sum, sum of squares) of each live cluster and
  window. A window that grows too old leaves by dropping its parts; a cluster that lost
  posts lives on with the sums of its other parts, or expires if too few posts are left.
* ``members`` is partitioned by window and version. Only live windows are read: to find
  posts that came before, the words and texts of clusters that alert, and the vectors for a new fit.
* ``recent`` holds the alerts that still block others, ``pending`` the candidates that
  were held back. These are candidates again in the next batch, until the cooldown ends.
* ``alerts``, ``outbox`` (payloads, one per alert), ``expired``, ``quality`` and
  ``batches`` (counters) are logs: each batch adds its partition and reads none back.
* ``refits`` logs the new fits of micro clusters, one for every ``refit_every`` posts, and
  ``labels`` holds the micro cluster of each post that lived at the newest one.

Counters come from observed metrics of the writes themselves, without a second pass. Once a
batch is placed, alerts, coherence and the new fit read its tables and write their own: they run
side by side, so that the small jobs of one do not wait for those of another.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flockline.functions import constants as K
from flockline.functions import vectors as vx
from flockline.operators import alerts as al
from flockline.operators.clustering import FOLD_ROWS, adaptive_radius, assign_batch, feature_centroids, micro_assignment
from flockline.operators.quality import coherence_of_sums
from flockline.operators.text import embed_posts, prepare_posts
from flockline.operators.vectors import topic_match, vector_sums
from flockline.operators.windows import SLIDE_HOURS, is_expired
from flockline.session import discard, exists, materialize, remove

_HOUR = 3_600_000_000
_POST = "text string, author_username string, like_count int, retweet_count int, reply_count int"
PARTS = (
    "cluster_id string, window_id bigint, n bigint, linear_sum array<double>, square_sum double, "
    "created_at timestamp, last_post_at timestamp, alert_sent boolean"
)
MEMBERS = f"cluster_id string, post_id string, joined_at timestamp, similarity double, leads boolean, cleaned_text string, {_POST}"
VECTORS = "vec array<double>"  # unit vectors of members, read by new fits alone
EXPIRED = "cluster_id string, n bigint, created_at timestamp, last_post_at timestamp, cause string"
ALERTS = (
    "alert_id string, cluster_id string, topic string, keywords array<string>, fingerprint string, "
    "embedding array<double>, alerted_at timestamp, post_count bigint, threshold double"
)
PENDING = "alert_id string, cluster_id string, fingerprint string, post_count bigint"
OUTBOX = (
    "alert_id string, cluster_id string, topic string, size_text string, similarity_text string, engagement_text string, "
    "period string, posts array<string>"
)
LABELS = "post_id string, label string"
REFITS = "processed bigint, posts bigint, radius double, labels bigint, widest double"
QUALITY = "processed bigint, clusters bigint, low_clusters bigint, average_coherence double"
BATCHES = (
    "batch_id bigint, as_of bigint, processed bigint, meaningful bigint, late bigint, repeated bigint, clustered bigint, "
    "new_clusters bigint, expired bigint, alerts bigint, held_back bigint, total bigint"
)
_NAMES = {
    "parts": PARTS,
    "expired": EXPIRED,
    "alerts": ALERTS,
    "recent": ALERTS,
    "pending": PENDING,
    "outbox": OUTBOX,
    "quality": QUALITY,
    "labels": LABELS,
    "refits": REFITS,
    "batches": BATCHES,
}


def columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


@dataclass
class StreamEngine:
    """Paths and parameters of one running job."""

    spark: SparkSession
    path: str
    topics: DataFrame
    dim: int = 384
    threshold: float = K.SIMILARITY_THRESHOLD
    min_size: int = K.MIN_CLUSTER_SIZE
    topic_similarity: float = K.ALERT_TOPIC_SIMILARITY
    duplicate_similarity: float = K.ALERT_DUPLICATE_SIMILARITY
    cooldown_hours: float = K.ALERT_COOLDOWN_HOURS
    expiry_hours: float = K.CLUSTER_EXPIRY_HOURS
    window_hours: float = K.WINDOW_SIZE_HOURS
    slide_hours: float = SLIDE_HOURS
    quality_every: int = K.QUALITY_CHECK_INTERVAL
    refit_every: int = K.REFIT_INTERVAL
    refit_posts: int = K.REFIT_POSTS  # with no more live posts than these there is nothing to fit
    low_coherence: float = K.MIN_COHERENCE
    embed: object = None  # posts -> posts with ``embedding``; feature hashing by default
    _last: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        # Topics are configuration: a few rows, which every batch reads.
        self.topics = self.spark.createDataFrame(self.topics.collect(), self.topics.schema)

    # Tables

    def _at(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/version={version}"

    def _read(self, name: str, version: int) -> DataFrame:
        """One version of a table; empty where it was not written."""
        if version >= 0 and exists(self.spark, self._at(name, version)):
            return self.spark.read.schema(_NAMES[name]).parquet(self._at(name, version))
        return self.spark.createDataFrame([], _NAMES[name])

    def _log(self, name: str) -> DataFrame:
        """All versions of a table, for readers outside the loop."""
        if not exists(self.spark, f"{self.path}/{name}"):
            return self.spark.createDataFrame([], f"{_NAMES[name]}, version bigint")
        return self.spark.read.schema(f"{_NAMES[name]}, version bigint").parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, version: int, **metrics: Column) -> dict:
        """Write a version and return metrics observed on the way."""
        seen = Observation()
        rows = df.select(*columns(_NAMES[name])).observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])
        rows.write.mode("overwrite").parquet(self._at(name, version))
        return seen.get

    def newest(self) -> int:
        """The last version that was finished, -1 if none was."""
        if "version" not in self._last:
            found = self._log("batches").agg(F.max("version")).head()[0]
            self._last["version"] = -1 if found is None else found
        return self._last["version"]

    def parts(self) -> DataFrame:
        return self._read("parts", self.newest())

    def members(self) -> DataFrame:
        """All posts that were ever placed."""
        if not exists(self.spark, f"{self.path}/members"):
            return self.spark.createDataFrame([], f"{MEMBERS}, window_id bigint, version bigint")
        return self.spark.read.schema(f"{MEMBERS}, window_id bigint, version bigint").parquet(f"{self.path}/members")

    def clusters(self) -> DataFrame:
        """Live clusters of the newest version and all that expired: ``cluster_id, n, created_at, last_post_at, status``."""
        live = self._whole(self.parts()).withColumn("status", F.lit("active"))
        names = ["cluster_id", "n", "created_at", "last_post_at", "status"]
        return live.select(*names).unionByName(self._log("expired").withColumn("status", F.lit("expired")).select(*names))

    def alerts(self) -> DataFrame:
        return self._log("alerts").drop("version")

    def outbox(self) -> DataFrame:
        return self._log("outbox").drop("version")

    def batches(self) -> DataFrame:
        """Counters of every batch."""
        return self._log("batches").drop("version").withColumn("as_of", F.timestamp_micros("as_of"))

    def quality(self) -> DataFrame:
        return self._log("quality")

    def refits(self) -> DataFrame:
        return self._log("refits")

    def labels(self) -> DataFrame:
        """(post_id, label): the micro cluster of each post that lived at the newest fit."""
        newest = self.refits().agg(F.max("version")).head()[0]
        return self._read("labels", -1 if newest is None else newest)

    def expired(self) -> DataFrame:
        return self._log("expired")

    # One micro-batch

    def process(self, batch: DataFrame, version: int) -> None:
        """Place one micro-batch, let windows and clusters expire, raise alerts."""
        before = self._before(version)
        rows, counts = self._vectors(batch)
        as_of = max((x for x in (counts["newest"], before["as_of"]) if x is not None), default=None)
        now = F.timestamp_micros(F.lit(as_of).cast("bigint"))
        first = None if as_of is None else self._first_live(as_of)
        alive, dead = self._retract(version, first)
        placed, fates = self._place(rows, alive, first, version, counts["meaningful"])
        totals, _ = self._beside(lambda: self._settle(alive, dead, placed, now, version), lambda: self._keep_members(placed, version))
        total = before["total"] + counts["processed"]
        sent, _, _ = self._beside(
            lambda: self._alert(version, now, first),
            lambda: self._check(version, before["total"], total),
            lambda: self._refit(version, before["total"], total, first),
        )
        row = (
            version, as_of, counts["processed"], counts["meaningful"], fates["late"], fates["repeated"], fates["clustered"],
            fates["new_clusters"], totals["rows"], sent["alerts"], sent["held_back"], total,
        )
        self._write(self.spark.createDataFrame([row], BATCHES), "batches", version)
        discard(rows, placed)
        for name in ("parts", "recent", "pending"):  # a replay of the next batch needs this version, nothing needs older ones
            remove(self.spark, self._at(name, version - 2))
        self._last = {"version": version, "as_of": as_of, "total": total}

    def _beside(self, *steps) -> list:
        """Results of steps that do not read one another's tables, run at the same time; the first failure is raised."""
        with ThreadPoolExecutor(len(steps)) as pool:
            running = [pool.submit(inheritable_thread_target(self.spark)(step)) for step in steps]
        return [r.result() for r in running]

    def _before(self, version: int) -> dict:
        """Event time and number of posts up to a version."""
        if self._last.get("version") == version - 1 and "total" in self._last:
            return self._last
        found = self._read("batches", version - 1).head()
        return found.asDict() if found else {"as_of": None, "total": 0}

    def _first_live(self, as_of: int) -> int:
        """The oldest window that is not older than ``window_hours``."""
        return -(-(as_of - int(self.window_hours * _HOUR)) // int(self.slide_hours * _HOUR))

    def _vectors(self, batch: DataFrame) -> tuple[DataFrame, dict]:
        """Kernel rows of the meaningful posts with an id and a time, and counters of the batch."""
        seen, good = Observation(), Observation()
        posts = batch.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _POST.split(", ") if c.split()[0] not in batch.columns})
        posts = posts.na.fill(0, ["like_count", "retweet_count", "reply_count"])
        newest = F.max(F.unix_micros("created_at"))
        posts = posts.withColumn("id", F.col("id").cast("string")).observe(seen, F.count(F.lit(1)).alias("processed"), newest.alias("newest"))
        prepared = prepare_posts(posts)
        embed = self.embed or (lambda rows: embed_posts(rows, self.dim))
        found = embed(prepared).filter("is_meaningful AND created_at IS NOT NULL AND id IS NOT NULL").filter(vx.is_nonzero(F.col("embedding")))
        rows = found.select(
            "id",
            F.unix_micros("created_at").alias("ts"),
            vx.normalize(vx.doubles(F.col("embedding"))).alias("vec"),
            F.floor(F.unix_micros("created_at") / int(self.slide_hours * _HOUR)).alias("window_id"),
            "cleaned_text",
            *columns(_POST),
        )
        rows = materialize(rows.observe(good, F.count(F.lit(1)).alias("meaningful")), "vectors")
        return rows, seen.get | good.get

    def _whole(self, parts: DataFrame) -> DataFrame:
        """One row per cluster: the sums of its parts."""
        found = parts.groupBy("cluster_id").agg(
            F.sum("n").alias("n"),
            F.min("created_at").alias("created_at"),
            F.max("last_post_at").alias("last_post_at"),
            F.max("alert_sent").alias("alert_sent"),
            F.sum("square_sum").alias("square_sum"),
            F.collect_list("linear_sum").alias("sums"),  # at most one for each live window
        )
        total = F.aggregate(F.slice("sums", 2, 1 << 30), F.get("sums", F.lit(0)), lambda s, x: F.zip_with(s, x, lambda a, b: a + b))
        return found.withColumn("linear_sum", total).drop("sums")

    def _retract(self, version: int, first: int | None) -> tuple[DataFrame, DataFrame]:
        """(parts that stay, clusters that end): windows before ``first`` leave.

        A cluster that loses posts ends when fewer than ``min_size`` are left.
        """
        old = self._read("parts", version - 1)
        if exists(self.spark, self._at("alerts", version - 1)):
            sent = self._read("alerts", version - 1).select("cluster_id", F.lit(True).alias("now_sent"))
            old = old.join(sent, "cluster_id", "left")
            old = old.withColumn("alert_sent", F.col("alert_sent") | F.coalesce("now_sent", F.lit(False))).drop("now_sent")
        own = Window.partitionBy("cluster_id")
        stays = F.col("window_id") >= (first if first is not None else 0)
        left = F.sum(F.when(stays, F.col("n")).otherwise(0)).over(own)
        marked = old.withColumns({"stays": stays, "left": left, "all": F.sum("n").over(own)})
        marked = marked.withColumn("ends", (F.col("left") < F.col("all")) & (F.col("left") < self.min_size))
        marked = materialize(marked, "retracted")
        alive = marked.filter("stays AND NOT ends").drop("stays", "left", "all", "ends")
        dead = marked.filter("ends").groupBy("cluster_id").agg(
            F.max("left").alias("n"), F.min("created_at").alias("created_at"), F.max("last_post_at").alias("last_post_at")
        )
        return alive, dead.withColumn("cause", F.lit("window"))

    def _live_members(self, first: int | None, before: int) -> DataFrame | None:
        """Members in live windows of versions below ``before``; None if there are none."""
        root = f"{self.path}/members"
        if first is None or not exists(self.spark, root):
            return None
        found = self.spark.read.schema(f"{MEMBERS}, {VECTORS}, window_id bigint, version bigint").parquet(root)
        return found.filter((F.col("window_id") >= first) & (F.col("version") < before))

    def _place(self, rows: DataFrame, alive: DataFrame, first: int | None, version: int, n: int) -> tuple[DataFrame, dict]:
        """Members of the batch with their vectors, and what became of its posts.

        Posts of windows that have left are late. Of a repeated id the earliest row counts;
        an id that a live window already holds is left out.
        """
        fates = Observation()
        late = F.col("window_id") < (first if first is not None else 0)
        timely = rows.observe(fates, F.count_if(late).alias("late"), F.count(F.lit(1)).alias("rows")).filter(~late)
        names = [c for c in rows.columns if c != "id"]
        fresh = timely.groupBy("id").agg(F.min(F.struct("ts", *[c for c in names if c != "ts"])).alias("r")).select("id", "r.*")
        known = self._live_members(first, version)
        if known is not None:
            fresh = fresh.join(known.select(F.col("post_id").alias("id")).distinct(), "id", "left_anti")
        homes = self._whole(alive).select(
            F.col("cluster_id").alias("id"), F.lit(0).cast("bigint").alias("ts"), vx.normalize(F.col("linear_sum")).alias("vec")
        )
        fresh, homes = self._beside(lambda: materialize(fresh, "fresh"), lambda: materialize(homes, "homes"))
        late_rows, all_rows = fates.get["late"], fates.get["rows"]
        counted = None if n > FOLD_ROWS else n
        chosen = assign_batch(homes, fresh.select("id", "ts", "vec"), self.threshold, counted=counted)
        outcome = Observation()
        placed = fresh.join(chosen, "id").select(
            "cluster_id", F.col("id").alias("post_id"), F.timestamp_micros("ts").alias("joined_at"), "similarity", "leads",
            "cleaned_text", *columns(_POST), "vec", "window_id",
        )
        counts = [F.count_if("leads").alias("new_clusters"), F.count_if(~F.col("leads")).alias("clustered")]
        placed = materialize(placed.observe(outcome, *counts), "placed")
        discard(fresh, homes)
        done = outcome.get
        repeated = all_rows - late_rows - done["new_clusters"] - done["clustered"]
        return placed, {"late": late_rows, "repeated": repeated, **done}

    def _keep_members(self, placed: DataFrame, version: int) -> None:
        """Write the members of the batch with their vectors."""
        log = placed.select(*columns(MEMBERS), "vec", "window_id", F.lit(version).cast("bigint").alias("version"))
        # A replay places the same posts again, so it overwrites just its own partitions.
        writer = log.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("window_id", "version").parquet(f"{self.path}/members")

    def _settle(self, alive: DataFrame, dead: DataFrame, placed: DataFrame, now: Column, version: int) -> dict:
        """Write the parts of the live clusters and the clusters that ended now."""
        key = F.struct("cluster_id", "window_id").alias("key")
        sums = vector_sums(placed.select(key, "vec", "joined_at"), "key")
        times = placed.groupBy(key).agg(F.min("joined_at").alias("created_at"), F.max("joined_at").alias("last_post_at"))
        new = sums.join(times, "key").select("key.*", "n", "linear_sum", "square_sum", "created_at", "last_post_at", F.lit(False).alias("alert_sent"))
        both = alive.select(*columns(PARTS)).unionByName(new)
        merged = both.groupBy("cluster_id", "window_id").agg(
            F.sum("n").alias("n"),
            F.collect_list("linear_sum").alias("sums"),  # the old part and the new one
            F.sum("square_sum").alias("square_sum"),
            F.min("created_at").alias("born"),
            F.max("last_post_at").alias("newest"),
            F.max("alert_sent").alias("sent"),
        )
        own = Window.partitionBy("cluster_id")  # at most one row for each live window
        joint = F.when(F.size("sums") == 1, F.get("sums", F.lit(0))).otherwise(
            F.zip_with(F.get("sums", F.lit(0)), F.get("sums", F.lit(1)), lambda a, b: a + b)
        )
        merged = merged.select(
            "cluster_id", "window_id", "n", joint.alias("linear_sum"), "square_sum", F.min("born").over(own).alias("created_at"),
            F.max("newest").over(own).alias("last_post_at"), F.max("sent").over(own).alias("alert_sent"),
        )
        merged = materialize(merged, "merged")
        old = is_expired(now, self.expiry_hours)
        ended = merged.filter(old).groupBy("cluster_id").agg(
            F.sum("n").alias("n"), F.min("created_at").alias("created_at"), F.max("last_post_at").alias("last_post_at")
        )
        dead = dead.unionByName(ended.withColumn("cause", F.lit("age")))
        gone, _ = self._beside(lambda: self._write(dead, "expired", version), lambda: self._write(merged.filter(~old), "parts", version))
        discard(merged)
        return gone

    def cluster_view(self, version: int) -> DataFrame:
        """Live clusters large enough for an alert and without one, with centroid and topic, as the gate reads them."""
        whole = self._whole(self._read("parts", version)).filter(F.col("n") >= self.min_size).filter("NOT alert_sent")
        table = whole.select(
            "cluster_id", F.col("n").alias("size"), "created_at", "last_post_at", F.lit("active").alias("status"), "alert_sent",
            vx.normalize(F.col("linear_sum")).alias("centroid"),
        )
        return topic_match(table, self.topics, "centroid")

    def _alert(self, version: int, now: Column, first: int | None) -> dict:
        """Gate, de-duplicate and record alerts, and put their payloads into the outbox."""
        ready = materialize(al.alert_candidates(self.cluster_view(version), self.min_size, self.topic_similarity), "ready")
        past = al.alert_cooldown(self._read("recent", version - 1), now, self.cooldown_hours)
        if ready.isEmpty():
            if exists(self.spark, self._at("recent", version - 1)):
                self._write(past, "recent", version)
            discard(ready)
            return {"alerts": 0, "held_back": 0}
        own = self._live_members(first, version + 1).drop("vec").join(F.broadcast(ready.select("cluster_id")), "cluster_id", "left_semi")
        live = materialize(own, "own")
        drafts = materialize(al.alert_drafts(ready, al.cluster_keywords(live), now), "drafts")
        deduped = materialize(al.dedupe_alerts(drafts, past, self.duplicate_similarity, self.cooldown_hours), "deduped")
        recorded = al.record_alerts(deduped, self.duplicate_similarity)
        kept = self._write(recorded, "alerts", version)["rows"]
        fresh = self._read("alerts", version)
        recent = past.select(*columns(ALERTS)).unionByName(fresh.select(*columns(ALERTS)))
        posts = live.withColumnRenamed("post_id", "id").select("id", *columns(_POST))
        chosen = ready.join(fresh.select("cluster_id", "alert_id"), "cluster_id")
        sheet = al.alert_payload(chosen, live, posts).join(fresh.select("cluster_id", "alert_id"), "cluster_id")
        held, _, _ = self._beside(
            lambda: self._write(deduped.filter("NOT kept"), "pending", version),
            lambda: self._write(recent, "recent", version),
            lambda: self._write(sheet, "outbox", version),
        )
        discard(ready, live, drafts, deduped)
        return {"alerts": kept, "held_back": held["rows"]}

    def _check(self, version: int, before: int, total: int) -> None:
        """Coherence of the live clusters whenever another ``quality_every`` posts were processed."""
        if before // self.quality_every == total // self.quality_every:
            return
        whole = self._whole(self._read("parts", version)).filter("n > 1")
        scored = whole.withColumn("coherence", coherence_of_sums(F.col("n"), F.col("linear_sum"), F.col("square_sum")))
        found = scored.agg(
            F.lit(total).cast("bigint").alias("processed"),
            F.count("*").alias("clusters"),
            F.count_if(F.col("coherence") < self.low_coherence).alias("low_clusters"),
            F.avg("coherence").alias("average_coherence"),
        )
        self._write(found, "quality", version)

    def _refit(self, version: int, before: int, total: int, first: int | None) -> None:
        """Fit micro clusters to all live posts anew whenever another ``refit_every`` posts were processed.

        It reads the vectors stored with the live members. Only the newest labels and those before
        them, which a replay of this batch may show, are kept.
        """
        members = self._live_members(first, version + 1)
        if before // self.refit_every == total // self.refit_every or members is None:
            return
        alive = self._read("parts", version).select("cluster_id").distinct()
        own = members.select("cluster_id", "post_id", "joined_at", "vec").join(alive, "cluster_id", "left_semi")
        live = own.select(F.col("post_id").alias("id"), F.col("joined_at").alias("created_at"), F.col("vec").alias("embedding"))
        live = materialize(live, "live")
        n = live.count()
        if n > self.refit_posts:
            radius = adaptive_radius(n)
            summaries, labels = micro_assignment(live, radius)
            old = [v for (v,) in self.refits().select("version").filter(F.col("version") < version).distinct().collect()]
            self._write(labels, "labels", version)
            found = feature_centroids(summaries).agg(
                F.lit(total).cast("bigint").alias("processed"),
                F.lit(n).cast("bigint").alias("posts"),
                F.lit(radius).alias("radius"),
                F.count("*").alias("labels"),
                F.max("radius").alias("widest"),
            )
            self._write(found, "refits", version)
            for gone in sorted(old)[:-1]:
                remove(self.spark, self._at("labels", gone))
            discard(summaries, labels)
        discard(live)

    def start(self, posts: DataFrame, **trigger) -> StreamingQuery:
        """Run over a stream of posts; by default every thirty seconds."""
        every = trigger or {"processingTime": f"{K.PROCESSING_INTERVAL_SECONDS} seconds"}
        return (
            posts.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.path}/checkpoint")
            .trigger(**every)
            .start()
        )

