"""State tables: keyed upserts, snapshots, expiry of posts, the alert table."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flockline.functions import constants as K
from flockline.operators.alerts import alert_cooldown
from flockline.session import exists, remove

MANIFEST = "name string, folder string, rows bigint, schema string"


def upsert(old: DataFrame, new: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last write wins per key. The newest row is picked by an aggregate, which combines map-side."""
    both = old.unionByName(new)
    cols = both.columns
    return (
        both.groupBy(key)
        .agg(F.max_by(F.struct(*cols), seq).alias("r"))
        .select(*[F.col(f"r.{c}").alias(c) for c in cols])
    )


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def snapshot_state(tables: dict[str, DataFrame], path: str, snapshot_ts: int) -> None:
    """Write every table whole under its own folder, partitioned by ``snapshot_ts``.

    A snapshot counts once its manifest below ``markers`` is written, which happens last:
    one row (name, folder, rows, schema) per table. Writing a snapshot again takes its manifest
    away first, so that a retry which breaks off leaves the snapshot before it as the newest.
    """
    spark = next(iter(tables.values())).sparkSession
    at = f"snapshot_ts={snapshot_ts}"
    if exists(spark, f"{path}/markers/{at}"):
        remove(spark, f"{path}/markers/{at}")
    manifest = []
    for name, table in tables.items():
        counted = Observation()
        table.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{path}/{name}/{at}")
        manifest.append((name, f"{name}/{at}", int(counted.get["rows"]), table.schema.json()))
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/markers/{at}")


def latest_snapshot(spark: SparkSession, path: str) -> int | None:
    """The newest snapshot with a manifest; None where there is none."""
    if not exists(spark, f"{path}/markers"):
        return None
    return _manifests(spark, path).agg(F.max("snapshot_ts")).head()[0]


def _manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{MANIFEST}, snapshot_ts bigint").parquet(f"{path}/markers")


def snapshot_manifest(spark: SparkSession, path: str, snapshot_ts: int | None = None) -> DataFrame:
    """(name, folder, rows, schema) of the tables of one snapshot, by default the newest."""
    at = latest_snapshot(spark, path) if snapshot_ts is None else snapshot_ts
    if at is None:
        raise ValueError(f"no complete snapshot below {path}")
    return _manifests(spark, path).filter(F.col("snapshot_ts") == at).drop("snapshot_ts")


def restore_state(spark: SparkSession, path: str, snapshot_ts: int | None = None) -> dict[str, DataFrame]:
    """All tables of one complete snapshot, by default the newest; only the folders its manifest names are read."""
    rows = snapshot_manifest(spark, path, snapshot_ts).collect()  # one row per table
    if not rows:
        raise ValueError(f"snapshot {snapshot_ts} below {path} is not complete")
    schemas = {r.name: StructType.fromJson(json.loads(r.schema)) for r in rows}
    return {r.name: spark.read.schema(schemas[r.name]).parquet(f"{path}/{r.folder}") for r in rows}


def restore_latest(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of the newest complete snapshot."""
    return restore_state(spark, path)[name]


def engine_state(
    clusters: DataFrame, members: DataFrame, posts: DataFrame, vectors: DataFrame, statistics: DataFrame, **parameters
) -> dict[str, DataFrame]:
    """The six tables of a whole snapshot; parameters are rows (name, value as JSON)."""
    rows = [(name, json.dumps(value)) for name, value in sorted(parameters.items())]
    stored = clusters.sparkSession.createDataFrame(rows, "name string, value string")
    return {
        "clusters": clusters,
        "members": members,
        "posts": posts,
        "vectors": vectors,
        "statistics": statistics,
        "parameters": stored,
    }


def state_parameters(tables: dict[str, DataFrame]) -> dict:
    """The parameters of a restored snapshot."""
    return {r.name: json.loads(r.value) for r in tables["parameters"].collect()}


def purge_expired_posts(posts: DataFrame, members: DataFrame, expired: DataFrame) -> DataFrame:
    """Posts (or vectors) that do not belong to an expired cluster."""
    gone = members.join(expired.select("cluster_id"), "cluster_id", "left_semi")
    return posts.join(gone.select(F.col("post_id").alias("id")), "id", "left_anti")


def append_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts that the table does not hold yet: writing a batch twice changes nothing."""
    spark = alerts.sparkSession
    if exists(spark, path):
        known = spark.read.parquet(path).select("alert_id")
        alerts = alerts.join(known, "alert_id", "left_anti")
    alerts.dropDuplicates(["alert_id"]).write.mode("append").parquet(path)


def load_alerts(
    spark: SparkSession, path: str, as_of: Column, cooldown_hours: float = K.ALERT_COOLDOWN_HOURS
) -> DataFrame:
    """Stored alerts that still block others."""
    return alert_cooldown(spark.read.parquet(path), as_of, cooldown_hours)
