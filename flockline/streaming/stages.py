"""Stream stages without state tables: preparation, windows, de-duplication, cooldown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flockline.functions import constants as K
from flockline.operators.text import meaningful_posts, prepare_posts
from flockline.operators.windows import SLIDE_HOURS
from flockline.session import exists, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_prepare(posts: DataFrame) -> DataFrame:
    """Cleaning and the meaningful gate: the batch functions, unchanged."""
    return meaningful_posts(prepare_posts(posts))


def stream_window_counts(
    posts: DataFrame, slide_hours: int = SLIDE_HOURS, delay: str = "1 hour", col: str = "created_at"
) -> DataFrame:
    """Posts per window; a window is emitted once, when the watermark has passed its end."""
    return (
        posts.withWatermark(col, delay)
        .groupBy(F.window(col, f"{slide_hours} hours").alias("w"))
        .agg(F.count("*").alias("posts"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "posts")
    )


def stream_dedupe(posts: DataFrame, delay: str = "24 hours", key: str = "id", col: str = "created_at") -> DataFrame:
    """Drop repeated posts; state is kept only as long as the watermark delay."""
    return posts.withWatermark(col, delay).dropDuplicatesWithinWatermark([key])


class _Cooldown(StatefulProcessor):
    """Remembers when a fingerprint last passed; a timer forgets it after the cooldown."""

    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown_ms = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at_us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Only ids and times are held, in event order within the micro-batch.
        parts = [(pdf["alert_id"].to_numpy(), pdf["at_us"].to_numpy(dtype="int64")) for pdf in rows]
        ids = np.concatenate([p[0] for p in parts])
        at = np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, at))
        last = self.last.get()[0] if self.last.exists() else None
        before, kept = last, []
        for i in order:
            ok = last is None or at[i] - last > self.cooldown_ms * 1000
            kept.append(bool(ok))
            if ok:
                last = int(at[i])
        if last != before:
            self.last.update((last,))
            self.handle.registerTimer(last // 1000 + self.cooldown_ms + 1)
        yield pd.DataFrame(
            {"fingerprint": key[0], "alert_id": ids[order], "at_us": at[order], "kept": kept}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # A later pass may have moved the time on; its own timer will follow.
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and self.last.get()[0] // 1000 + self.cooldown_ms + 1 <= due:
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def keyed_cooldown(
    alerts: DataFrame, cooldown_hours: float = K.ALERT_COOLDOWN_HOURS, delay: str = "1 hour"
) -> DataFrame:
    """Per fingerprint, pass an alert unless one passed within the cooldown before it.

    The exact-match half of alert de-duplication with one state value per
    fingerprint and no scan of the history. Needs the RocksDB state store.
    """
    timed = alerts.withWatermark("alerted_at", delay).select(
        "fingerprint", "alert_id", F.unix_micros("alerted_at").alias("at_us"), "alerted_at"
    )
    return timed.groupBy("fingerprint").transformWithStateInPandas(
        statefulProcessor=_Cooldown(int(cooldown_hours * 3_600_000)),
        outputStructType="fingerprint string, alert_id string, at_us bigint, kept boolean",
        outputMode="Append",
        timeMode="EventTime",
    )


def run_to_table(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over everything available now into a parquet table and read it."""
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/data")
        .option("checkpointLocation", f"{path}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


def stream_stats(stream: DataFrame, name: str = "stats") -> DataFrame:
    """Processed and meaningful counts of each micro-batch, whose rows go to a table.

    The counts are observed while the rows are written, so no batch is read twice. Every
    batch writes its own partitions: none is forgotten however many there are, and a batch
    that is run again replaces its rows and counts.
    """
    spark: SparkSession = stream.sparkSession
    path = scratch_path(spark, name)
    schema = "processed bigint, meaningful bigint, batch_id bigint"

    def keep(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        rows = batch.observe(seen, F.count(F.lit(1)).alias("processed"), F.count_if("is_meaningful").alias("meaningful"))
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
        counts = [(seen.get["processed"], seen.get["meaningful"])]
        spark.createDataFrame(counts, "processed bigint, meaningful bigint").write.mode("overwrite").parquet(f"{path}/counts/batch_id={batch_id}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if not exists(spark, f"{path}/counts"):
        return spark.createDataFrame([], schema)
    counts = spark.read.schema(schema).parquet(f"{path}/counts")
    return counts.filter("processed > 0").select("batch_id", "processed", "meaningful")
