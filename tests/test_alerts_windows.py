import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline.operators import alerts as al
from flockline.operators import kernel
from flockline.operators import windows as wi
from flockline.plans import state as plan_state
from flockline.sources import posts as ps
from flockline.sources import state as st

START = datetime(2024, 1, 1)
ALERT = "alert_id string, fingerprint string, embedding array<double>, alerted_at timestamp"


def at(hours):
    return START + timedelta(hours=hours)


def kept(df):
    return {r["alert_id"] for r in df.filter("kept").collect()}


def test_suppressed_alerts_suppress_nothing(spark):
    rows = [(n, "f", [1.0, 0.0], at(h)) for n, h in (("a", 0), ("b", 20), ("c", 30))]
    drafts = spark.createDataFrame(rows, ALERT)
    deduped = al.dedupe_alerts(drafts)
    assert kept(deduped) == {"a", "c"}
    reason = al.suppression_reason(deduped).collect()
    assert [(r["alert_id"], r["kept_alert_id"], r["reason"]) for r in reason] == [("b", "a", "exact")]


def test_cooldown_is_inclusive_and_history_counts(spark):
    rows = [("a", "f", [1.0, 0.0], at(24)), ("b", "g", [0.0, 1.0], at(24))]
    past = spark.createDataFrame([("p", "f", [0.6, 0.8], at(0))], ALERT)
    assert kept(al.dedupe_alerts(spark.createDataFrame(rows, ALERT), past)) == {"b"}
    late = [("a", "f", [1.0, 0.0], at(24) + timedelta(seconds=1))]
    assert kept(al.dedupe_alerts(spark.createDataFrame(late, ALERT), past)) == {"a"}


@pytest.mark.parametrize("blocks", [{}, {"broadcast_rows": 0, "block_rows": 16}])
def test_dedupe_equals_sequential(spark, blocks):
    rng = np.random.default_rng(3)
    vec = rng.normal(size=(150, 4))
    vec /= np.linalg.norm(vec, axis=1, keepdims=True)
    hours = np.sort(rng.integers(0, 200, 150))
    prints = np.where(rng.random(150) < 1 / 3, "hot", [f"f{k}" for k in rng.integers(0, 40, 150)])
    rows = [(f"a{i:03d}", str(prints[i]), vec[i].tolist(), at(int(hours[i]))) for i in range(150)]
    expected = []
    for i in range(150):
        if not any(
            hours[i] - hours[j] <= 24
            and (prints[i] == prints[j] or np.floor(float(vec[i] @ vec[j]) * 1e6 + 0.5) / 1e6 > 0.85)
            for j in expected
        ):
            expected.append(i)
    got = kept(al.dedupe_alerts(spark.createDataFrame(rows, ALERT), **blocks))
    assert got == {f"a{i:03d}" for i in expected}


def posts_at(spark, hours):
    return spark.createDataFrame([(i, at(h)) for i, h in enumerate(hours)], "id int, created_at timestamp")


def test_anchored_windows(spark):
    got = wi.window_assign_anchored(posts_at(spark, [0, 5, 19, 30, 37]), 18)
    sizes = {r["window_id"]: (r["window_start"], r["post_count"]) for r in wi.window_table(got).collect()}
    assert sizes == {0: (at(0), 2), 1: (at(19), 2), 2: (at(37), 1)}


def test_anchored_windows_cross_gaps(spark):
    got = wi.window_assign_anchored(posts_at(spark, [3, 100, 101, 130]), 18)
    assert [r["window_start"] for r in got.orderBy("id").collect()] == [at(3), at(100), at(100), at(130)]


@pytest.mark.parametrize("seed,span", [(1, 40), (2, 900), (3, 5000)])
def test_anchored_windows_by_doubling(spark, monkeypatch, seed, span):
    rng = random.Random(seed)
    hours = [rng.randrange(span * 4) / 4 for _ in range(400)] + [0.0, 0.0, 90_000.0, 18.0]
    expected, start = {}, None
    for h in sorted(set(hours)):
        start = h if start is None or h >= start + 18 else start
        expected[h] = start
    order = {s: i for i, s in enumerate(sorted(set(expected.values())))}
    rows = posts_at(spark, hours).unionByName(spark.createDataFrame([(-1, None)], "id int, created_at timestamp"))
    rounds, write = [], wi.materialize
    monkeypatch.setattr(wi, "materialize", lambda df, name: rounds.append(name) or write(df, name))
    for walk in (0, 1000):
        got = {r["id"]: (r["window_id"], r["window_start"]) for r in wi.window_assign_anchored(rows, 18, walk_rows=walk).collect()}
        assert got == {i: (order[expected[h]], at(expected[h])) for i, h in enumerate(hours)}
    assert rounds.count("twice") == (len(order) - 1).bit_length()


def test_anchored_windows_of_nothing(spark):
    empty = spark.createDataFrame([(1, None)], "id int, created_at timestamp")
    assert wi.window_assign_anchored(empty, walk_rows=0).count() == 0


def test_expiry_is_strict_and_reports_new_only(spark):
    rows = [("a", at(0), "active"), ("b", at(0) - timedelta(seconds=1), "active"), ("c", at(-90), "expired")]
    clusters = spark.createDataFrame(rows, "cluster_id string, last_post_at timestamp, status string")
    got = wi.expire_clusters(clusters, F.lit(at(48))).collect()
    assert [r["cluster_id"] for r in got] == ["b"]


def test_running_count_spans_ranges(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("g"), F.lit(at(1)).alias("t"))
    got = wi.running_count(rows.repartition(8), ["t", "id"], ["g"])
    assert got.filter((F.col("position") - 1) * 3 + F.col("g") != F.col("id")).count() == 0
    whole = wi.running_count(rows.repartition(8), ["t", "id"])
    assert whole.filter(F.col("position") != F.col("id") + 1).count() == 0


def test_ingest_defaults_and_rejects(spark):
    raw = spark.createDataFrame(
        [("1", "hi", "u", "n", 3), ("2", None, "u", "n", None), ("3", "yo", "u", "n", None)],
        "post_id string, text string, author_id string, author_username string, like_count int",
    )
    good, bad = ps.ingest_posts(raw, F.lit(at(5)))
    assert {(r["id"], r["like_count"], r["created_at"]) for r in good.collect()} == {("1", 3, at(5)), ("3", 0, at(5))}
    assert [r["post_id"] for r in bad.collect()] == ["2"]


def test_malformed_rows_are_rejected_with_their_text(spark, tmp_path):
    good = '{"post_id": "1", "text": "hi", "author_id": "u", "author_username": "n"}'
    (tmp_path / "posts.json").write_text(good + "\n{broken\n")
    raw = ps.read_posts(spark, str(tmp_path / "posts.json"), malformed=True)
    accepted, rejected = ps.ingest_posts(raw, F.lit(at(5)))
    assert [r["id"] for r in accepted.collect()] == ["1"]
    assert [r["_corrupt_record"] for r in rejected.collect()] == ["{broken"]


def test_anchored_grid_is_broadcast(spark):
    rows = spark.range(3).select("id", F.timestamp_seconds(F.col("id") * 60).alias("created_at"))
    plan = wi.window_assign_anchored(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_multiline_array_is_read(spark, tmp_path):
    (tmp_path / "posts.json").write_text('[{"post_id": "1", "text": "é"},\n {"post_id": "2", "text": "b"}]')
    got = ps.read_posts(spark, str(tmp_path / "posts.json"), multiline=True)
    assert [(r["post_id"], r["text"]) for r in got.orderBy("post_id").collect()] == [("1", "é"), ("2", "b")]


def test_snapshot_without_marker_is_ignored(spark, tmp_path):
    path = str(tmp_path / "snap")
    st.snapshot_state({"t": spark.range(3).toDF("id")}, path, 1)
    spark.range(9).toDF("id").withColumn("snapshot_ts", F.lit(2).cast("bigint")).write.mode("append").partitionBy(
        "snapshot_ts"
    ).parquet(f"{path}/t")
    assert st.restore_latest(spark, path, "t").count() == 3


def test_upsert_keeps_newest(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "c", 3), (3, "d", 4)], "id int, v string, seq int")
    assert {tuple(r) for r in st.upsert(old, new).collect()} == {(1, "a", 1), (2, "c", 3), (3, "d", 4)}


def test_a_probe_meets_two_tiles_of_a_long_history(spark):
    """200 alerts of one fingerprint, one an hour: with a cooldown of ten hours a row meets 20 at most, not 200."""
    rows = [(f"a{i:03d}", "hot", [1.0, 0.0], at(i) if i else None) for i in range(200)]
    nodes = al._alert_nodes(spark.createDataFrame(rows, ALERT)).withColumn("cell", F.col("tag"))
    rule = al._conflict(0.85, 10)
    homes, probes = kernel._tiled(nodes, nodes, rule)
    met = probes.select(F.col("id").alias("p"), F.col("ts").alias("pt"), "cell").join(homes, "cell")
    assert met.groupBy("p").count().agg(F.max("count")).head()[0] <= 20
    right = F.col("pt").between(F.col("ts"), F.col("ts") + rule.max_age)
    assert met.filter(right).count() == sum(min(i, 11) for i in range(1, 200)) + 1  # each pair once, the undated row meets itself
    got = kept(al.dedupe_alerts(spark.createDataFrame(rows, ALERT), cooldown_hours=10, broadcast_rows=0, block_rows=16, walk_rows=0))
    assert got == {"a000"} | {f"a{i:03d}" for i in range(1, 200, 11)}


def test_history_is_read_back_to_the_first_draft_only(spark):
    drafts = spark.createDataFrame([("d", "f", [1.0, 0.0], at(100)), ("e", "g", [0.0, 1.0], at(90))], ALERT)
    history = spark.createDataFrame([("p", "g", [1.0, 0.0], at(66)), ("q", "f", [1.0, 0.0], at(60)), ("r", "f", [1.0, 0.0], None)], ALERT)
    assert kept(al.dedupe_alerts(drafts, history)) == {"d"}


def test_payload_joins_lines_instead_of_texts(spark, monkeypatch):
    clusters = spark.createDataFrame([("a", 2, "T", 0.5, at(0), at(1))], "cluster_id string, size int, topic string, topic_similarity double, created_at timestamp, last_post_at timestamp")
    members = spark.createDataFrame([("a", 1, at(0)), ("a", 2, at(1))], "cluster_id string, post_id int, joined_at timestamp")
    posts = spark.createDataFrame([(1, "x" * 300, "u", 1, 0, 0), (2, None, "v", 5, 1, 2)], "id int, text string, author_username string, like_count int, retweet_count int, reply_count int")
    joined, best = [], al.representative_posts
    monkeypatch.setattr(al, "representative_posts", lambda m, p, *k: joined.append(p.columns) or best(m, p, *k))
    row = al.alert_payload(clusters, members, posts).head()
    assert row["engagement_text"] == "9 interactions" and len(row["posts"]) == 2 and len(row["posts"][1]) < 140
    assert len(joined) == 1 and "text" not in joined[0]


def test_alert_sink_makes_payloads_once(spark, monkeypatch):
    written, write = [], plan_state.materialize
    monkeypatch.setattr(plan_state, "materialize", lambda df, name: written.append(name) or write(df, name))
    found = plan_state.alert_sink(spark, "/root/testdata/sf0.001")
    assert written == ["payload"] and found.count() == found.select("alert_id").distinct().count() > 0
