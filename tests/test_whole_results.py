"""Nothing is lost, doubled or size-dependent: repeated ids, retries, history ties, many micro-batches."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline.operators import alerts, clustering, quality
from flockline.plans import reports as report_plans
from flockline.session import discard, materialize
from flockline.sources import state
from flockline.streaming import stages


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_repeated_ids_on_both_paths(spark, broadcast):
    rows = [(1, 0, [1.0, 0.0]), (2, 1, [0.9, 0.1]), (2, 2, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, t long, embedding array<double>").withColumn("created_at", F.timestamp_seconds("t"))
    got = clustering.leader_cluster(df, 0.7, broadcast_rows=broadcast, block_rows=16)
    assert sorted((r.post_id, r.cluster_id) for r in got.collect()) == [(1, "1"), (2, "1")]


def test_history_suppresses_at_the_same_time(spark):
    schema = "alert_id string, fingerprint string, embedding array<double>, t long"
    one = lambda i: spark.createDataFrame([(i, "f", [1.0, 0.0], 50)], schema).withColumn("alerted_at", F.timestamp_seconds("t"))
    assert not alerts.dedupe_alerts(one("alert_a"), one("alert_b")).first().kept
    assert alerts.dedupe_alerts(one("alert_a"), one("alert_b").withColumn("alerted_at", F.timestamp_seconds(F.lit(-90 * 3600)))).first().kept


def test_snapshot_retry_changes_nothing(spark, tmp_path):
    table = spark.range(5).toDF("id")
    for at in (1, 2, 2):
        state.snapshot_state({"posts": table}, str(tmp_path), at)
    assert state.latest_snapshot(spark, str(tmp_path)) == 2
    assert sorted(r.id for r in state.restore_latest(spark, str(tmp_path), "posts").collect()) == list(range(5))


def test_append_alerts_demands_its_key(spark, tmp_path):
    path = str(tmp_path / "alerts")
    spark.range(2).toDF("other").write.parquet(path)
    with pytest.raises(Exception, match="alert_id"):
        state.append_alerts(spark.createDataFrame([("a",)], "alert_id string"), path)


def test_stream_stats_keeps_every_batch(spark, tmp_path):
    for k in range(6):
        spark.createDataFrame([(k, k % 2 == 0)], "id long, is_meaningful boolean").coalesce(1).write.mode("append").parquet(str(tmp_path))
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        stream = spark.readStream.schema("id long, is_meaningful boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
        got = stages.stream_stats(stream).collect()
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    assert sum(r.processed for r in got) == 6 and sum(r.meaningful for r in got) == 3


def test_low_coherence_lists_all(spark):
    base = spark.createDataFrame([(f"c{k}", "active", 9, 0.1) for k in range(7)], "cluster_id string, status string, size long, coherence double")
    assert quality.low_coherence(base).count() == 7


def test_discard_removes_the_table(spark):
    table = materialize(spark.range(3))
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    discard(table)
    import os

    assert not os.path.exists(folder)


def test_micro_clusters_do_not_follow_the_partition_count(spark, monkeypatch):
    monkeypatch.setattr(clustering, "BUCKET_ROWS", 16)
    r = np.random.default_rng(3)
    at = datetime(2024, 1, 1)
    rows = [(f"p{k}", at + timedelta(seconds=k), (np.eye(4)[k % 4] + 0.05 * r.standard_normal(4)).tolist()) for k in range(80)]
    table = spark.createDataFrame(rows, "id string, created_at timestamp, embedding array<double>")

    def found():
        return sorted((x.cluster_id, x.n) for x in clustering.micro_clusters(table, 0.4).collect())

    first = found()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert found() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sum(n for _, n in first) == 80 and len(first) < 40


def test_many_rules_are_joined(spark, monkeypatch):
    clusters = spark.createDataFrame(
        [("a", 5, 0.9, "active"), ("b", 50, 0.2, "active"), ("c", 50, 0.9, "expired")],
        "cluster_id string, size long, topic_similarity double, status string",
    )
    rules = spark.createDataFrame(
        [("small", 3, 0.5, True), ("large", 20, 0.1, True), ("off", 1, 0.0, False)],
        "name string, min_cluster_size long, topic_similarity_threshold double, enabled boolean",
    )
    want = {("a", "small"), ("b", "large")}
    assert {tuple(r) for r in alerts.rule_matches(clusters, rules).collect()} == want
    monkeypatch.setattr(alerts, "INLINE_RULES", 1)
    assert {tuple(r) for r in alerts.rule_matches(clusters, rules).collect()} == want


def test_rows_without_a_time_are_the_earliest(spark):
    rows = [(k, None if k % 4 == 0 else k, [float(k == d) for d in range(12)]) for k in range(12)]
    df = spark.createDataFrame(rows, "id long, t long, embedding array<double>").withColumn("created_at", F.timestamp_seconds("t"))
    got = clustering.leader_cluster(df, 0.7)
    nodes = clustering.vo.nodes(df)
    for prefix in (65_536, 4):
        led = clustering.first_independent(nodes, clustering.Rule(theta=0.7), first_prefix=prefix)
        assert sorted(r.id for r in led.collect()) == list(range(12))
    assert sorted((r.post_id, r.joined_at is None) for r in got.collect()) == [(k, k % 4 == 0) for k in range(12)]


def test_batches_are_walked_or_selected_alike(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(9, 6))
    rows = [(k, k // 3, (base[rng.integers(9)] + 0.25 * rng.normal(size=6)).tolist()) for k in range(120)]
    df = spark.createDataFrame(rows, "id long, t long, embedding array<double>").withColumn("created_at", F.timestamp_seconds("t"))
    none = spark.createDataFrame([], "cluster_id string, n bigint, linear_sum array<double>, square_sum double")
    first, features = clustering.assign_incremental(none, df.filter("id < 50"), 0.8)
    results = []
    for fold_rows in (4096, 0):
        members, _ = clustering.assign_incremental(features, df.filter("id >= 50"), 0.8, fold_rows=fold_rows)
        results.append(sorted((r.post_id, r.cluster_id, r.similarity, r.leads) for r in members.collect()))
    assert results[0] == results[1] and 0 < sum(r[3] for r in results[0]) < 70


def test_snapshot_counts_by_its_manifest(spark, tmp_path):
    out = str(tmp_path / "state")
    assert state.latest_snapshot(spark, out) is None
    with pytest.raises(ValueError):
        state.restore_state(spark, out)
    rows, empty = spark.range(5), spark.createDataFrame([], "a string, b array<double>")
    state.snapshot_state({"rows": rows, "empty": empty}, out, 1)
    rows.limit(2).write.parquet(f"{out}/rows/snapshot_ts=2")  # broke off before its manifest
    found = state.restore_state(spark, out)
    assert set(found) == {"rows", "empty"} and found["rows"].count() == 5
    assert found["empty"].schema == empty.schema and found["empty"].count() == 0
    state.snapshot_state({"rows": rows.limit(3)}, out, 2)  # the retry
    state.snapshot_state({"rows": rows.limit(4)}, out, 2)
    assert state.latest_snapshot(spark, out) == 2
    assert state.restore_latest(spark, out, "rows").count() == 4
    assert state.restore_state(spark, out, 1)["rows"].count() == 5
    with pytest.raises(ValueError):
        state.restore_state(spark, out, 9)


def test_parameters_travel_with_a_snapshot(spark, tmp_path):
    one = spark.range(1)
    tables = state.engine_state(one, one, one, one, one, threshold=0.7, names=["a"], note=None)
    state.snapshot_state(tables, str(tmp_path / "whole"), 7)
    found = state.restore_state(spark, str(tmp_path / "whole"))
    assert len(found) == 6 and state.state_parameters(found) == {"threshold": 0.7, "names": ["a"], "note": None}


def test_summary_cleans_clustered_posts_only(spark, tmp_path, monkeypatch):
    """Texts of posts without a cluster are not cleaned; words and summaries are those of the clusters."""
    start = datetime(2024, 1, 1)
    documents = [(i, f"network outage region{i} storage failure", "web") for i in range(1, 8)]
    events = [(i, start + timedelta(hours=i), 7, "click", 9.0) for i in range(1, 8)]
    given = [(i, [1.0, float(i)] + [0.0] * 62, 0) for i in (2, 5)]
    tables = {
        "documents": spark.createDataFrame(documents, "doc_id bigint, text string, source string"),
        "events": spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double"),
        "embeddings": spark.createDataFrame(given, "vec_id bigint, embedding array<double>, label int"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    cleaned, clean = [], report_plans.to.prepare_posts
    monkeypatch.setattr(report_plans.to, "prepare_posts", lambda posts: cleaned.append(posts) or clean(posts))
    (row,) = report_plans.cluster_summary(spark, str(tmp_path)).collect()
    assert row["cluster_id"] == "c0-click" and "network" in row["summary"] and "outage" in row["summary"]
    assert [sorted(r["id"] for r in p.select("id").collect()) for p in cleaned] == [[2, 5]]
