import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flockline.operators import clustering as cl
from flockline.operators import kernel
from flockline.operators import leaders as ld
from flockline.operators import quality as q
from flockline.operators import reports as rp
from flockline.operators import vectors as vo

START = datetime(2024, 1, 1)
SCHEMA = "id bigint, created_at timestamp, embedding array<double>"


def vectors(spark, rows):
    data = [(i, START + timedelta(minutes=i), [float(x) for x in v]) for i, v in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def angles(degrees):
    return [(math.cos(math.radians(a)), math.sin(math.radians(a))) for a in degrees]


def bursts(seed=1, n=240, groups=6, dim=8, noise=0.25):
    """A third exact copies, the rest noisy copies of a few directions."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    rows = centers[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, dim))
    rows[rng.random(n) < 1 / 3] = centers[0]
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def sequential(rows, theta):
    leaders, owner = [], {}
    for i, v in enumerate(rows):
        sims = [(-np.floor(float(v @ rows[j]) * 1e6 + 0.5) / 1e6, j) for j in leaders]
        best = min(sims, default=(0, None))
        if best[1] is not None and -best[0] >= theta:
            owner[i] = best[1]
        else:
            leaders.append(i)
            owner[i] = i
    return owner


def owners(found):
    return {r["post_id"]: int(r["cluster_id"]) for r in found.collect()}


def test_leader_rule_on_angles(spark):
    assert owners(cl.leader_cluster(vectors(spark, angles([0, 40, 80, 35])))) == {0: 0, 1: 0, 2: 2, 3: 0}


@pytest.mark.parametrize("blocks", [{}, {"broadcast_rows": 0, "block_rows": 16}])
def test_leader_rule_equals_sequential(spark, blocks):
    rows = bursts()
    assert owners(cl.leader_cluster(vectors(spark, rows), 0.8, **blocks)) == sequential(rows, 0.8)


def test_leader_rule_with_short_lists_and_prefixes(spark, monkeypatch):
    """Cut neighbour lists and many prefixes give the same leaders."""
    rows = bursts(seed=2, noise=0.5)
    nodes = vo.nodes(vectors(spark, rows))
    found = ld.first_independent(nodes, cl.Rule(theta=0.6), neighbours=2, first_prefix=16)
    expected = {j for i, j in sequential(rows, 0.6).items() if i == j}
    assert {r["id"] for r in found.collect()} == expected


def test_ranges_settle_long_chains(spark):
    """Every row only matches the one before it: leaders alternate."""
    rows = angles([i * 0.35 for i in range(400)])
    found = cl.leader_cluster(vectors(spark, rows), math.cos(math.radians(0.4)))
    assert owners(found) == sequential(np.array(rows), math.cos(math.radians(0.4)))


def test_pairs_fold_copies(spark):
    rows = vectors(spark, angles([0, 0, 0, 10, 90]))
    got = vo.similar_post_join(rows, 0.9).collect()
    assert [(r["left_posts"], r["right_posts"]) for r in got] in ([(3, 1)], [(1, 3)])
    assert {got[0]["left_id"], got[0]["right_id"]} == {0, 3}


def test_nearest_paths_agree(spark):
    rows = vectors(spark, bursts(seed=3))
    clusters = rows.filter("id % 5 = 0").select(
        F.concat(F.lit("c"), "id").alias("cluster_id"), F.col("embedding").alias("centroid")
    )
    one = vo.nearest_clusters(rows, clusters, 3, 0.5)
    two = vo.nearest_clusters(rows, clusters, 3, 0.5, broadcast_rows=0, block_rows=8)
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0 and one.count() > 100


def members_of(rows, clusters=4):
    return rows.select(
        F.concat(F.lit("c"), F.col("id") % clusters).alias("cluster_id"),
        F.col("id").alias("post_id"),
        F.col("created_at").alias("joined_at"),
    )


def brute_coherence(rows, clusters=4):
    out = {}
    for c in range(clusters):
        own = rows[c::clusters]
        sims = (own @ own.T)[np.triu_indices(len(own), 1)]
        pos = sims[sims >= 5e-7]
        out[f"c{c}"] = 1.0 if len(own) < 2 else (pos.mean() if len(pos) else 0.0)
    return out


@pytest.mark.parametrize("noise", [0.05, 0.6, 3.0])
def test_coherence_equals_all_pairs(spark, noise):
    """Tight clusters use the closed form, loose ones the blocks, most use both."""
    rows = bursts(seed=4, groups=2, noise=noise)
    table = vectors(spark, rows)
    got = {r["cluster_id"]: r["coherence"] for r in q.coherence(members_of(table), table, block_rows=7).collect()}
    assert got == pytest.approx(brute_coherence(rows), abs=1e-9)


@pytest.mark.parametrize("noise", [0.05, 0.6, 3.0])
def test_coherence_by_cells_equals_all_pairs(spark, noise):
    rows = bursts(seed=4, groups=2, noise=noise)
    table = vectors(spark, rows)
    got = q.coherence(members_of(table), table, block_rows=7, cell_rows=0).collect()
    assert {r["cluster_id"]: r["coherence"] for r in got} == pytest.approx(brute_coherence(rows), abs=1e-9)


@pytest.mark.parametrize("shape", ["cone", "opposite", "ring"])
def test_coherence_cells_compare_few_pairs(spark, shape):
    """Posts that are clearly near or clearly opposite are settled by sums of cells."""
    rng = np.random.default_rng(6)
    n = 6000
    if shape == "cone":  # most within 45 degrees of the axis, the others up to 50
        lean = np.radians(np.where(rng.random(n) < 0.3, rng.uniform(46, 50, n), rng.uniform(0, 35, n)))
        side = rng.normal(size=(n, 5))
        side /= np.linalg.norm(side, axis=1)[:, None]
        rows = np.c_[np.cos(lean), side * np.sin(lean)[:, None]]
    elif shape == "opposite":
        rows = np.repeat([[1.0, 0.0, 0.0], [-0.6, 0.8, 0.0], [-0.6, -0.8, 0.1]], n // 3, 0) + rng.normal(size=(n, 3)) / 50
    else:
        turn = rng.uniform(0, 2 * np.pi, n)
        rows = np.c_[np.cos(turn), np.sin(turn)]
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    table = vectors(spark, rows)
    got = q.coherence_sums(members_of(table, 1), table).head()
    assert got["total"] / got["pairs"] == pytest.approx(brute_coherence(rows, 1)["c0"], abs=1e-9)
    share = got["compared"] / (n * (n - 1) / 2)
    assert share < {"cone": 0.25, "opposite": 0.01, "ring": 0.2}[shape]


def test_coherence_edge_cases(spark):
    def one(rows):
        t = vectors(spark, rows)
        return q.coherence(members_of(t, 1), t).head()["coherence"]

    assert one([(1, 0)]) == 1.0
    assert one([(1, 0), (-1, 0)]) == 0.0
    assert one([(1, 0), (0, 1)]) == 0.0


def test_fast_coherence_is_mean_of_all_pairs(spark):
    rows = bursts(seed=5, n=60)
    table = vectors(spark, rows)
    sims = (rows @ rows.T)[np.triu_indices(len(rows), 1)]
    got = q.coherence_fast(cl.cluster_features(members_of(table, 1), table)).head()["coherence"]
    assert got == pytest.approx(sims.mean(), abs=1e-12)


def test_features_merge_in_any_grouping(spark):
    table = vectors(spark, bursts(seed=6, n=90))
    whole = cl.cluster_features(members_of(table), table)
    parts = [cl.cluster_features(members_of(table.filter(F.col("id") % 3 == k)), table) for k in range(3)]
    left = cl.merge_features(cl.merge_features(parts[0], parts[1]), parts[2])
    right = cl.merge_features(parts[0], cl.merge_features(parts[1], parts[2]))
    for other in (left, right):
        a = {r["cluster_id"]: r for r in whole.collect()}
        for r in other.collect():
            assert r["n"] == a[r["cluster_id"]]["n"]
            assert r["linear_sum"] == pytest.approx(a[r["cluster_id"]]["linear_sum"], abs=1e-12)


@pytest.mark.parametrize("per_round", [10_000, 13])
def test_running_centroid_replays_order(spark, per_round):
    rows = bursts(seed=7, n=80)
    table = vectors(spark, rows)
    got = {r["cluster_id"]: r["centroid"] for r in vo.running_centroid(members_of(table), table, per_round).collect()}
    for c in range(4):
        mean = None
        for n, v in enumerate(rows[c::4], 1):
            mean = v if mean is None else (mean * (n - 1) + v) / n
            mean = mean / np.linalg.norm(mean)
        assert got[f"c{c}"] == pytest.approx(list(mean), abs=1e-9)


def test_micro_clusters_keep_bound_and_posts(spark):
    table = vectors(spark, bursts(seed=8, n=300, noise=0.2))
    got = cl.micro_clusters(table, 0.4).collect()
    assert sum(r["n"] for r in got) == 300 and len(got) < 200
    assert max(r["radius"] for r in got) <= 0.4 + 1e-9


def test_incremental_single_rows_follow_the_mean(spark):
    """One post per batch is the sequential rule with normalised means."""
    rows = bursts(seed=9, n=8, groups=2, dim=4, noise=0.4)
    features = spark.createDataFrame(
        [], "cluster_id string, n bigint, linear_sum array<double>, square_sum double"
    )
    sums, expected, got = {}, {}, {}
    for i, v in enumerate(rows):
        sims = {c: float(v @ (s / np.linalg.norm(s))) for c, s in sums.items()}
        best = max(sims, key=sims.get, default=None)
        home = best if best is not None and sims[best] >= 0.7 else str(i)
        expected[i] = home
        sums[home] = sums.get(home, 0) + v
        batch = vectors(spark, rows).filter(F.col("id") == i)
        members, merged = cl.assign_incremental(features, batch)
        got.update({r["post_id"]: r["cluster_id"] for r in members.collect()})
        features = spark.createDataFrame(merged.collect(), merged.schema)
    assert got == expected


def test_member_pages(spark):
    table = vectors(spark, bursts(n=25))
    posts = table.select("id", F.lit("t").alias("text"), F.lit("a").alias("author_username"))
    pages = cl.cluster_posts(members_of(table, 1), posts, page_size=10).orderBy("page").collect()
    assert [r["size"] for r in pages] == [10, 10, 5]
    assert [p["id"] for r in pages for p in r["posts"]] == list(range(25))


def test_principal_components_have_a_fixed_direction(spark):
    points = np.random.default_rng(5).normal(size=(60, 4)) * [1.0, 9.0, 0.3, 4.0]
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<double>")
    members = spark.createDataFrame([(0, "c")], "post_id long, cluster_id string")
    got = {r["id"]: (r["point"], r["cluster_id"]) for r in vo.vector_pca(rows, members).collect()}
    axes = np.linalg.eigh(np.cov(points.T))[1][:, [3, 2]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(2)])
    assert np.allclose([got[i][0] for i in range(60)], points @ axes)
    assert got[0][1] == "c" and got[1][1] == "Unknown"


def test_micro_members_name_every_post(spark):
    """Sums by label equal the summaries, whether one bucket folds the posts or many; near copies share a label."""
    rows = bursts(seed=8, n=200, noise=0.05)
    table = vectors(spark, rows).unionByName(vectors(spark, rows[:1]).select(
        F.lit(999).cast("bigint").alias("id"), F.lit(None).cast("timestamp").alias("created_at"), "embedding"))
    for bucket_rows in (8192, 40):
        cl.BUCKET_ROWS, before = bucket_rows, cl.BUCKET_ROWS
        try:
            summaries, members = cl.micro_assignment(table, 0.4)
        finally:
            cl.BUCKET_ROWS = before
        label = {r["post_id"]: r["label"] for r in members.collect()}
        assert set(label) == {*range(200), 999} and label[0] == label[999] == "999"
        every = {**dict(enumerate(rows)), 999: rows[0]}
        found = {r["cluster_id"]: r for r in summaries.collect()}
        assert set(found) == set(label.values()) and len(found) <= 20
        means, slack = [], []
        for name, s in found.items():
            own = np.array([every[p] for p in label if label[p] == name])
            assert s["n"] == len(own) and s["linear_sum"] == pytest.approx(list(own.sum(0)), abs=1e-9)
            spread = (own**2).sum() / len(own) - (own.mean(0) ** 2).sum()
            assert spread <= 0.16 + 1e-9
            means.append(own.mean(0))
            slack.append(0.16 - spread)
        for i in range(len(means)):
            for j in range(i):
                assert ((means[i] - means[j]) ** 2).sum() > min(slack[i], slack[j]) - 1e-9


def test_labels_of_clusters(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("b", 5), ("c", 6)], "cluster_id string, post_id bigint")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "z"), (5, "w")], "post_id bigint, label string")
    got = {tuple(r) for r in cl.cluster_labels(members, labels).collect()}
    assert got == {("a", "y", 2), ("b", "w", 1)}


@pytest.mark.parametrize("block_rows", [None, 16])
def test_hashed_pairs_are_right_and_nearly_all(spark, block_rows):
    """Recall against all pairs, for the rows whose id is divisible by 50 and for all."""
    rows = bursts(seed=12, n=600, groups=40, dim=16, noise=0.06)
    table = vectors(spark, rows).unionByName(spark.createDataFrame([(900, START, [0.0] * 16), (901, START, None)], SCHEMA))
    exact = {(r["left_id"], r["right_id"]): r for r in vo.similar_post_join(vectors(spark, rows), 0.9).collect()}
    found = vo.similar_post_candidates(table, 0.9, bits=8, block_rows=block_rows).collect()
    assert len(found) == len({(r["left_id"], r["right_id"]) for r in found})
    assert all(exact[r["left_id"], r["right_id"]] == r for r in found)
    assert len(found) >= 0.95 * len(exact) > 100
    asked = [p for p in exact if p[0] % 50 == 0 or p[1] % 50 == 0]
    got = {(r["left_id"], r["right_id"]) for r in found}
    assert sum(p in got for p in asked) >= 0.9 * len(asked)


def test_report_base_carries_labels(spark):
    table = vectors(spark, bursts(n=8))
    members = members_of(table, 2)
    clusters = members.select("cluster_id").distinct()
    labels = members.select("post_id", F.concat(F.lit("of "), "cluster_id").alias("label"))
    got = rp.cluster_report_base(clusters, members, table, labels.filter("label = 'of c0'"))
    assert {(r["cluster_id"], r["label"]) for r in got.collect()} == {("c0", "of c0"), ("c1", None)}
    assert [tuple(r) for r in rp.label_distribution(got).collect()] == [("of c0", 1)]


def test_sifted_tiles_equal_whole_ones(monkeypatch):
    """Single precision only leaves pairs out: matches and scores are those of the whole product."""
    rng = np.random.default_rng(3)
    vec = rng.standard_normal((400, 16))
    vec[200:] = vec[:200] + 0.05 * rng.standard_normal((200, 16))
    unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
    ids, ts, slack = np.arange(400), rng.integers(0, 50, 400), rng.uniform(0, 0.5, 400)
    order = np.lexsort((ids, ts))
    for rows, rule in [(unit, kernel.Rule(theta=0.7)), (unit, kernel.Rule(theta=0.7, strict=True, earlier=True)), (vec, kernel.Rule(slack=True, earlier=True))]:
        block = kernel.Block(ids, ts, rows, slack if rule.slack else None, None).part(order)
        assert kernel._sifted(block, block, rule) is not None
        sifted = pd.concat(kernel.compare(block, block, rule))
        with monkeypatch.context() as patched:
            patched.setattr(kernel, "_sifted", lambda p, h, r: None)
            whole = pd.concat(kernel.compare(block, block, rule))
        pd.testing.assert_frame_equal(sifted, whole)
        assert len(sifted)


def test_tiles_are_small(monkeypatch):
    """No product that a comparison makes holds more than 16 MB of numbers."""
    shapes, whole = [], kernel._best_dense
    monkeypatch.setattr(kernel, "_best_dense", lambda p, h, r: shapes.append((len(p.ids), len(h.ids))) or whole(p, h, r))
    unit = np.random.default_rng(4).standard_normal((5000, 2))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    block = kernel.Block(np.arange(5000), np.zeros(5000, dtype="int64"), unit, None, None)
    found = pd.concat(kernel.compare(block, block, kernel.Rule(theta=0.7)))
    assert max(a * b * 8 for a, b in shapes) <= 16 << 20
    assert sorted(found["id"]) == list(range(5000))


@pytest.mark.parametrize("block_rows", [None, 16])
def test_pairs_of_asked_posts(spark, monkeypatch, block_rows):
    """Pairs of the posts asked for are those among all pairs, once each; no table holds the copies of the rows."""
    table = vectors(spark, bursts(seed=3, n=300, groups=20, dim=16, noise=0.06))
    asked = lambda c: F.col(c) % 5 == 0
    whole = {tuple(r) for r in vo.similar_post_join(table, 0.9).collect()}
    expected = {r for r in whole if r[0] % 5 == 0 or r[1] % 5 == 0}
    got = [tuple(r) for r in vo.similar_post_join(table, 0.9, asked, block_rows=block_rows, broadcast_rows=block_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) < len(whole)
    written, write = [], kernel.materialize
    monkeypatch.setattr(kernel, "materialize", lambda df, name="stage": written.append(name) or write(df, name))
    found = [tuple(r) for r in vo.similar_post_candidates(table, 0.9, bits=6, asked=asked, block_rows=block_rows).collect()]
    assert len(found) == len(set(found)) and set(found) <= expected and len(found) >= 0.95 * len(expected)
    assert written == ["grid"]


def test_near_copies_are_folded_in_one_bucket(spark, monkeypatch):
    """Beyond one bucket rows are dealt by direction, not by a hash of the id; a hot direction is still cut."""
    monkeypatch.setattr(cl, "BUCKET_ROWS", 40)
    rows = [v * (1 + k * 0.05) for v in np.eye(16) for k in range(10)]
    local, members = cl._local_summaries(vectors(spark, rows), 0.04)
    assert {(r["id"], r["n"]) for r in local.collect()} == {(10 * k, 10) for k in range(16)}
    assert {(r["post_id"], r["label"]) for r in members.collect()} == {(i, i // 10 * 10) for i in range(160)}
    hot = cl._directions(spark.createDataFrame([(0, i, [1.0, 0.0]) for i in range(200)], "ts bigint, id bigint, vec array<double>"), 200)
    sizes = [r["count"] for r in hot.groupBy("bucket").count().collect()]
    assert sum(sizes) == 200 and len(sizes) == 5 and max(sizes) < 80


def test_later_rounds_compare_what_moved(spark):
    """Owners among all summaries, and among those that moved and what they match, are the same."""
    limit = 0.25
    points = bursts(seed=3, n=120, groups=30, dim=8, noise=0.08)
    rows = spark.createDataFrame([(i, i, 1, v.tolist(), 1.0) for i, v in enumerate(points)], "id bigint, ts bigint, n bigint, linear_sum array<double>, square_sum double")
    nodes = cl._summary_nodes(rows, limit)
    first = cl._owners(nodes)
    moved = first.filter("id <> owner").select(F.col("owner").alias("id")).distinct()
    nodes = cl._summary_nodes(cl._united(nodes, first), limit)
    n = nodes.count()
    assert 0 < moved.count() < n < 120
    whole, part = (dict(map(tuple, cl._owners(nodes, m).collect())) for m in (None, moved))
    assert whole == part and len(part) == n


def test_cells_beyond_a_plane_are_left_out(spark):
    """Probes go to far fewer cells than distances to pivots alone would name, and every pair is found."""
    points = np.random.default_rng(7).normal(size=(600, 24))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = np.concatenate([points, points * 1.02 + 0.001])
    rows = spark.createDataFrame([(i, 0, v.tolist(), 0.04) for i, v in enumerate(points)], "id bigint, ts bigint, vec array<double>, slack double")
    rule = kernel.Rule(slack=True, keep="all")
    _, probes = kernel._metric_cells(rows, rows, rule, 1200, 100, 0.2)
    assert probes.count() < 0.5 * 1200 * 96
    got = {(r["id"], r["match_id"]) for r in kernel.match_rows(rows, rows, rule, block_rows=100, broadcast_rows=0).collect()}
    d2 = ((points[:, None] - points[None]) ** 2).sum(2)
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.04 + 1e-12))}
