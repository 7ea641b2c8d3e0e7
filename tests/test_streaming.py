from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flockline.operators import clustering as cl
from flockline.operators import text as to
from flockline.operators.windows import running_count
from flockline.plans import streams
from flockline.streaming import stages as sg
from flockline.streaming.engine import StreamEngine

START = datetime(2024, 1, 1)
THEMES = [
    "climate summit leaders agree carbon emission targets",
    "football final stadium fans celebrate winning goal",
    "machine learning model research breakthrough results",
]


def batch(spark, first, n):
    rows = [
        (str(1000 + i), f"{THEMES[i % 3]} update{'abcdefgh'[i % 8]}", START + timedelta(minutes=i))
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, "id string, text string, created_at timestamp")


def engine(spark, path):
    topics = to.topic_vectors(to.topics_of_interest(spark), 64)
    return StreamEngine(spark, str(path), topics, dim=64, topic_similarity=-1.0)


def state(e):
    members = {(r["post_id"], r["cluster_id"]) for r in e.members().collect()}
    clusters = {(r["cluster_id"], r["n"], r["status"]) for r in e.clusters().collect()}
    return members, clusters, sorted(r["alert_id"] for r in e.alerts().collect())


def test_engine_equals_batches_and_replays(spark, tmp_path):
    e = engine(spark, tmp_path / "a")
    batches = [batch(spark, 0, 12), batch(spark, 12, 9)]
    for version, posts in enumerate(batches):
        e.process(posts, version)
    once = state(e)
    e.process(batches[1], 1)
    assert state(e) == once

    features = spark.createDataFrame([], "cluster_id string, n bigint, linear_sum array<double>, square_sum double")
    expected = set()
    for posts in batches:
        vectors = to.embed_posts(to.prepare_posts(posts), 64)
        members, features = cl.assign_incremental(features, vectors)
        expected |= {(r["post_id"], r["cluster_id"]) for r in members.collect()}
        features = spark.createDataFrame(features.collect(), features.schema)
    assert once[0] == expected
    assert sum(n for _, n, _ in once[1]) == 21
    assert e.outbox().count() == len(once[2])
    assert len(once[2]) == len({a.rsplit("_", 1)[0] for a in once[2]})  # a cluster alerts once


def test_refits_keep_their_cadence_and_label_live_posts(spark, tmp_path):
    e = engine(spark, tmp_path / "r")
    e.refit_every, e.refit_posts = 15, 10
    batches = [batch(spark, 0, 12), batch(spark, 12, 9), batch(spark, 21, 5), batch(spark, 26, 6)]
    for version, posts in enumerate(batches):
        e.process(posts, version)
    e.process(batches[3], 3)
    fits = {r["version"]: (r["processed"], r["posts"]) for r in e.refits().collect()}
    assert fits == {1: (21, 21), 3: (32, 32)}
    labels = {int(r["post_id"]) - 1000: r["label"] for r in e.labels().collect()}
    assert sorted(labels) == list(range(32))
    own = [{labels[i] for i in range(k, 32, 3)} for k in range(3)]
    assert not (own[0] & own[1] or own[0] & own[2] or own[1] & own[2])  # themes never share a label
    assert len(set(labels.values())) < 32
    assert all(labels[i] == labels[i + 24] for i in range(8))  # equal texts share theirs


def test_repeats_and_late_posts_change_nothing_and_windows_leave(spark, tmp_path):
    e = engine(spark, tmp_path / "c")
    e.process(batch(spark, 0, 12), 0)
    before = {(r["cluster_id"], r["n"]) for r in e.clusters().collect()}
    e.process(batch(spark, 0, 12).union(batch(spark, 3, 2)), 1)
    assert {(r["cluster_id"], r["n"]) for r in e.clusters().collect()} == before
    assert e.members().count() == 12
    shift = lambda k, days: batch(spark, k, 6).withColumn("created_at", F.lit(START + timedelta(days=days)))
    e.process(shift(20, 1.5), 2)  # the window of the first twelve is too old now
    counts = {r["batch_id"]: r for r in e.batches().collect()}
    assert counts[1]["repeated"] == 14 and counts[1]["clustered"] == counts[1]["new_clusters"] == 0
    assert {r["cause"] for r in e.expired().collect()} == {"window"}
    assert sum(r["n"] for r in e.clusters().filter("status = 'active'").collect()) == 6
    e.process(batch(spark, 12, 5), 3)
    assert e.batches().filter("batch_id = 3").first()["late"] == 5 and e.members().count() == 18
    again = engine(spark, tmp_path / "c")  # a new driver goes on from the tables
    again.process(shift(40, 1.6), 4)
    assert again.batches().filter("batch_id = 4").first()["total"] == 12 + 14 + 6 + 5 + 6


def test_a_held_back_cluster_alerts_when_the_cooldown_ends(spark, tmp_path):
    e = engine(spark, tmp_path / "d")
    e.duplicate_similarity, e.cooldown_hours, e.window_hours, e.expiry_hours = -1.0, 2, 1000, 1000
    one = lambda theme, first, hour: spark.createDataFrame(
        [(str(first + i), THEMES[theme], START + timedelta(hours=hour, minutes=i)) for i in range(6)], "id string, text string, created_at timestamp"
    )
    e.process(one(0, 100, 0), 0)
    e.process(one(1, 200, 1), 1)  # alike enough to the first alert: held back
    assert e.alerts().count() == 1 and e._read("pending", 1).count() == 1
    e.process(one(2, 300, 5), 2)  # the cooldown is over: one of the two is sent, the other waits
    e.process(one(2, 300, 5), 2)
    assert [r["version"] for r in e._log("alerts").orderBy("version").collect()] == [0, 2]
    sheets = e.outbox().collect()
    assert sorted(r["alert_id"] for r in sheets) == sorted(r["alert_id"] for r in e.alerts().collect())
    assert all(len(r["posts"]) == 3 for r in sheets)


def test_engine_expires_clusters(spark, tmp_path):
    e = engine(spark, tmp_path / "b")
    e.process(batch(spark, 0, 6), 0)
    late = batch(spark, 6, 1).withColumn("created_at", F.lit(START + timedelta(days=5)))
    e.process(late, 1)
    states = {r["cluster_id"]: r["status"] for r in e.clusters().collect()}
    assert sorted(states.values()).count("expired") >= 2 and "active" in states.values()


def test_stream_prepare_equals_batch(spark, tmp_path):
    posts = batch(spark, 0, 20)
    posts.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(posts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sg.run_to_table(sg.stream_prepare(stream))
    expected = to.meaningful_posts(to.prepare_posts(posts))
    assert got.exceptAll(expected).count() == 0 and got.count() == expected.count()


def test_more_posts_come_in_more_files():
    """A file is one task: their number follows the posts, and small inputs keep a few."""
    assert streams._files(0) == streams._files(10_000) == streams.FILES
    assert streams._files(500_000) == 10 * streams.FILES


def test_copies_of_the_stream_are_made_from_its_files(spark, monkeypatch):
    """The tables are read for the first copy only, and files are compressed."""
    times = [START + timedelta(microseconds=1, hours=i) for i in range(20)]
    rows = spark.createDataFrame([(str(i), f"post \u00fc {i}", times[i]) for i in range(20)], "id string, text string, created_at timestamp")
    made, paths, write = [], [], streams.write_posts
    monkeypatch.setattr(streams, "_full_posts", lambda t: made.append(t) or rows)
    monkeypatch.setattr(streams, "write_posts", lambda p, out, **k: paths.append(out) or write(p, out, **k))
    streams._stream(streams.Tables(spark, "nowhere"), copies=2)
    assert len(made) == 1 and len(paths) == 2
    got = [(r["id"], r["text"], r["created_at"]) for r in streams.read_posts(spark, paths[0]).collect()]
    assert sorted(got) == sorted(2 * [tuple(r) for r in rows.collect()])
    assert all(f.endswith(".json.gz") for f in streams.read_posts(spark, paths[0]).inputFiles())


def test_refits_read_stored_vectors(spark, tmp_path):
    """A post is embedded once, when it comes; steps beside each other give their results or raise."""
    e = engine(spark, tmp_path)
    e.refit_every, e.refit_posts = 10, 5
    calls = []
    e.embed = lambda posts: calls.append(1) or to.embed_posts(posts, 64)
    for version in range(2):
        e.process(batch(spark, 12 * version, 12), version)
    assert len(calls) == 2 and e.refits().count() == 2 and e.labels().count() == 24
    assert "vec" not in e.members().columns
    assert e._beside(lambda: 1, lambda: 2) == [1, 2]
    with pytest.raises(ZeroDivisionError):
        e._beside(lambda: 1, lambda: 1 // 0)


def test_batches_are_found_by_their_first_rows(spark, tmp_path, monkeypatch):
    """Five batches by time and id, a tenth late, two repeated; also for rows without a time, equal rows and few posts."""
    narrow, batches, write = [], [], streams.write_posts
    monkeypatch.setattr(streams, "running_count", lambda df, order: narrow.append(df.columns) or running_count(df, order))
    monkeypatch.setattr(streams, "write_posts", lambda p, out, **k: batches.append(p.select("id", "created_at").collect()) or write(p, out, **k))
    for n in (3, 47):
        when = lambda i: None if i % 11 == 0 else START + timedelta(hours=i * 7 % 13, microseconds=i % 2)
        rows = [(str(i // 2), f"text {i}", when(i - i % 4 // 3)) for i in range(n)]
        posts = spark.createDataFrame(rows, "id string, text string, created_at timestamp")
        monkeypatch.setattr(streams, "_full_posts", lambda t, posts=posts: posts)
        batches.clear()
        streams._arrivals(streams.Tables(spark, "nowhere"), str(tmp_path / f"in{n}"))
        order = sorted(((i, t) for i, _, t in rows), key=lambda r: (r[1] is not None, r[1], r[0]))
        due = [min(4, p * 5 // n + (int(r[0]) % 10 == 3)) for p, r in enumerate(order)]
        expected = [[r for r, d in zip(order, due) if d in (k, {3: 2, 4: 0}.get(k))] for k in range(5)]
        assert [sorted(map(repr, map(tuple, b))) for b in batches] == [sorted(map(repr, b)) for b in expected]
    assert narrow == 2 * [["created_at", "id", "row"]]
