"""Window assignment, expiry, cluster lifecycle, running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.session import discard, materialize

GRID_ROWS = 100_000  # rows of five numbers in a grid that is broadcast
SLIDE_HOURS = K.WINDOW_SIZE_HOURS - K.WINDOW_OVERLAP_HOURS
_HOUR = 3_600_000_000


def running_count(df: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Add ``position``: the 1-based rank of each row in ``order`` within ``by``.

    A plain window would send each group, or everything, to one task. Rows are
    range-partitioned instead, counted inside each range, and shifted by the
    counts of the ranges before it.
    """
    by = by or []
    ranged = df.repartitionByRange(*[F.col(c) for c in [*by, *order]])
    placed = materialize(ranged.withColumn("__part", F.spark_partition_id()), "ranges")
    keys = [*by, "__part"]
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*keys)
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        .drop("__n")
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        placed.withColumn("__local", local)
        .join(offsets, keys)
        .withColumn("position", (F.col("__before") + F.col("__local")).cast("bigint"))
        .drop("__part", "__local", "__before")
    )


def max_time(df: DataFrame, col: str = "created_at") -> Column:
    """The newest event time of a table, as a literal: the default ``as_of``."""
    return F.lit(df.agg(F.max(col)).head()[0])


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / _HOUR


def window_assign(posts: DataFrame, slide_hours: int = SLIDE_HOURS, col: str = "created_at") -> DataFrame:
    """Put every post in one window of width ``slide_hours``."""
    start = F.window(F.col(col), f"{slide_hours} hours").getField("start")
    width = slide_hours * _HOUR
    return posts.withColumn("window_start", start).withColumn(
        "window_id", F.floor(F.unix_micros("window_start") / width)
    )


def _successors(times: DataFrame, width: int) -> DataFrame:
    """(ts, nxt): the first time at least ``width`` after ``ts``; times without one are left out.

    Times and bounds are range-partitioned together, searched inside each range, and what a
    range does not hold is the first time of a later one.
    """
    both = times.select(F.col("ts").alias("at"), F.lit(None).cast("bigint").alias("ts")).unionByName(
        times.select((F.col("ts") + width).alias("at"), "ts")
    )
    placed = materialize(both.repartitionByRange("at").withColumn("part", F.spark_partition_id()), "bounds")
    time = F.when(F.col("ts").isNull(), F.col("at"))
    here = Window.partitionBy("part").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    later = placed.groupBy("part").agg(F.min(time).alias("head")).select("part", F.min("head").over(after).alias("later"))
    found = (
        placed.withColumn("found", F.min(time).over(here))
        .filter("ts IS NOT NULL")
        .join(F.broadcast(later), "part")  # one row per range
        .select("ts", F.coalesce("found", "later").alias("nxt"))
        .filter("nxt IS NOT NULL")
    )
    pairs = materialize(found, "steps")
    discard(placed)
    return pairs


def _reached(steps: DataFrame, first: int) -> DataFrame:
    """The times that ``steps`` reach from ``first``, by pointer doubling.

    Round k keeps jumps of 2^k steps, and only at times that such jumps end at: paths that
    meet stay together, so tables shrink from round to round. The way back adds, for each
    power of two, where its jumps lead from what is reached so far.
    """
    levels = []
    while steps.filter(F.col("ts") == first).head() is not None:
        levels.append(steps)
        onward = steps.select(F.col("ts").alias("nxt"), F.col("nxt").alias("far"))
        twice = materialize(steps.join(onward, "nxt").select("ts", F.col("far").alias("nxt")), "twice")
        ends = twice.select(F.col("nxt").alias("ts")).distinct()
        kept = twice.join(ends, "ts", "left_semi").unionByName(
            twice.filter(F.col("ts") == first).join(ends, "ts", "left_anti")
        )
        steps = materialize(kept, "steps")
        discard(twice)
    discard(steps)
    reached = steps.sparkSession.createDataFrame([(first,)], "ts bigint")
    for level in reversed(levels):
        more = level.join(reached, "ts", "left_semi").select(F.col("nxt").alias("ts"))
        reached = materialize(reached.unionByName(more), "reached")
        discard(level)
    return reached


def anchored_starts(
    posts: DataFrame, slide_hours: float = SLIDE_HOURS, col: str = "created_at", walk_rows: int = GRID_ROWS
) -> DataFrame:
    """(window_id, ts): start times (microseconds) of lazily opened windows, numbered from 0.

    The next window starts at the first post at least ``slide_hours`` after the last start.
    Up to ``walk_rows`` distinct times are walked on the driver; of more, every time gets its
    successor and the starts are reached in twice as many rounds as the number of windows has
    binary digits. Posts without a time open no window.
    """
    width = int(slide_hours * _HOUR)
    spark = posts.sparkSession
    times = posts.select(F.unix_micros(col).alias("ts")).filter("ts IS NOT NULL").distinct()
    times = materialize(times, "times")
    few = times.limit(walk_rows + 1).collect()
    if len(few) <= walk_rows:
        rows, bound = [], None
        for (ts,) in sorted(few):
            if bound is None or ts >= bound:
                rows.append((len(rows), ts))
                bound = ts + width
        found = spark.createDataFrame(rows, "window_id bigint, ts bigint")
    else:
        reached = _reached(_successors(times, width), times.agg(F.min("ts")).head()[0])
        found = running_count(reached, ["ts"]).select((F.col("position") - 1).alias("window_id"), "ts")
    discard(times)
    return found


def window_assign_anchored(
    posts: DataFrame, slide_hours: float = SLIDE_HOURS, col: str = "created_at", walk_rows: int = GRID_ROWS
) -> DataFrame:
    """Put every post in the last lazily opened window at or before it; posts without a time are left out.

    Starts are a slide apart, so a grid cell of that width holds at most one, and the start of
    a post's window lies less than a slide before it: in its own cell or the one before. The
    range lookup becomes an equal join on the cell, whose table has two rows per window,
    however far apart the windows are.
    """
    width = int(slide_hours * _HOUR)
    starts = anchored_starts(posts, slide_hours, col, walk_rows)
    cell = F.floor(F.col("ts") / width)
    own = starts.select(cell.alias("cell"), F.struct("window_id", "ts").alias("this"), F.lit(None).alias("last"))
    next_cell = starts.select((cell + 1).alias("cell"), F.lit(None).alias("this"), F.struct("window_id", "ts").alias("last"))
    grid = materialize(
        own.unionByName(next_cell).groupBy("cell").agg(F.max("this").alias("this"), F.max("last").alias("last")), "grid"
    )
    if grid.limit(GRID_ROWS + 1).count() <= GRID_ROWS:
        grid = F.broadcast(grid)
    micros = F.unix_micros(col)
    start = F.when(micros >= F.col("this.ts"), F.col("this")).otherwise(F.col("last"))
    return (
        posts.withColumn("cell", F.floor(micros / width))
        .join(grid, "cell")
        .withColumn("window_id", start.getField("window_id"))
        .withColumn("window_start", F.timestamp_micros(start.getField("ts")))
        .drop("cell", "this", "last")
    )


def window_table(assigned: DataFrame, size_hours: float = K.WINDOW_SIZE_HOURS) -> DataFrame:
    """(window_id, window_start, expires_at, post_count)."""
    expires = F.timestamp_micros(F.unix_micros("window_start") + int(size_hours * _HOUR))
    return (
        assigned.groupBy("window_id", "window_start")
        .agg(F.count("*").alias("post_count"))
        .withColumn("expires_at", expires)
    )


def window_info(windows: DataFrame, as_of: Column, size_hours: float = K.WINDOW_SIZE_HOURS) -> DataFrame:
    """Live windows with their age in hours."""
    age = hours_between(as_of, F.col("window_start"))
    return windows.withColumn("age_hours", age).filter(F.col("age_hours") <= size_hours)


def expired_windows(windows: DataFrame, as_of: Column, size_hours: float = K.WINDOW_SIZE_HOURS) -> DataFrame:
    age = hours_between(as_of, F.col("window_start"))
    return windows.withColumn("age_hours", age).filter(F.col("age_hours") > size_hours)


def retract_window(
    clusters: DataFrame,
    members: DataFrame,
    vectors: DataFrame,
    topics: DataFrame,
    expired_posts: DataFrame,
    min_size: int = K.MIN_CLUSTER_SIZE,
) -> DataFrame:
    """Cluster table after the posts of dead windows left.

    ``expired_posts`` is (post_id). A cluster that lost posts is expired when
    fewer than ``min_size`` remain, else its centroid and topic are rebuilt;
    other clusters keep their rows.
    """
    from flockline.operators.clustering import cluster_table

    gone = members.join(expired_posts, "post_id", "left_semi")
    kept = members.join(expired_posts, "post_id", "left_anti")
    touched = gone.select("cluster_id").distinct()
    left = kept.join(touched, "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("left"))
    fates = touched.join(left, "cluster_id", "left").select(
        "cluster_id", F.coalesce("left", F.lit(0)).alias("left")
    )
    fates = materialize(fates, "fates")
    enough = fates.filter(F.col("left") >= min_size)
    rebuilt = cluster_table(kept.join(enough, "cluster_id", "left_semi"), vectors, topics)
    cols = ["cluster_id", "size", "topic", "topic_similarity", "centroid", "status"]
    return (
        clusters.join(fates, "cluster_id", "left_anti")
        .select(*cols)
        .unionByName(
            rebuilt.join(clusters.select("cluster_id", "status"), "cluster_id").select(*cols)
        )
        .unionByName(
            clusters.join(fates.filter(F.col("left") < min_size), "cluster_id")
            .withColumn("size", F.col("left"))
            .withColumn("status", F.lit("expired"))
            .select(*cols)
        )
    )


def sliding_counts(
    posts: DataFrame,
    members: DataFrame,
    size_hours: int = K.WINDOW_SIZE_HOURS,
    slide_hours: int = SLIDE_HOURS,
) -> DataFrame:
    """Posts and distinct clusters per overlapping window."""
    placed = posts.join(members.select(F.col("post_id").alias("id"), "cluster_id"), "id", "left")
    return (
        placed.groupBy(F.window("created_at", f"{size_hours} hours", f"{slide_hours} hours").alias("w"))
        .agg(F.count("*").alias("posts"), F.countDistinct("cluster_id").alias("clusters"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "posts", "clusters")
    )


def is_expired(as_of: Column, hours: float = K.CLUSTER_EXPIRY_HOURS) -> Column:
    """Strictly older than the limit."""
    return F.unix_micros(as_of) - F.unix_micros("last_post_at") > int(hours * _HOUR)


def expire_clusters(clusters: DataFrame, as_of: Column, hours: float = K.CLUSTER_EXPIRY_HOURS) -> DataFrame:
    """Clusters that expire now; those already expired are not reported again."""
    return clusters.filter("status <> 'expired'").filter(is_expired(as_of, hours))


def cluster_status(
    clusters: DataFrame, alerts: DataFrame, as_of: Column, hours: float = K.CLUSTER_EXPIRY_HOURS
) -> DataFrame:
    """Status from scratch: expired by age, else alerted when an alert exists, else active."""
    sent = alerts.select("cluster_id").distinct().withColumn("__sent", F.lit(True))
    return (
        clusters.drop("status", "alert_sent")
        .join(sent, "cluster_id", "left")
        .withColumn("alert_sent", F.coalesce("__sent", F.lit(False)))
        .withColumn(
            "status",
            F.when(is_expired(as_of, hours), "expired").when(F.col("alert_sent"), "alerted").otherwise("active"),
        )
        .drop("__sent")
    )


def active_clusters(clusters: DataFrame) -> DataFrame:
    return clusters.filter("status <> 'expired'")
