"""Rows that one task walks through: tiles, and prefixes of a longer order."""

import numpy as np
from pyspark.sql import functions as F

from flockline.operators import clustering as cl
from flockline.operators import leaders as ld

NODES = "id string, ts long, vec array<double>"


def crowd(n, seed=5):
    """Unit vectors around a few directions, several of one time."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 8))
    vecs = base[rng.integers(12, size=n)] + 0.3 * rng.normal(size=(n, 8))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    return [(f"p{k:04d}", k // 3, v.tolist()) for k, v in enumerate(vecs)]


def first_set(rows, theta):
    chosen = []
    for k, (_, _, v) in enumerate(rows):
        if all(np.floor(np.dot(v, rows[j][2]) * 1e6 + 0.5) / 1e6 < theta for j in chosen):
            chosen.append(k)
    return {rows[k][0] for k in chosen}


def test_first_prefix_is_walked_and_takes_the_rest(spark, monkeypatch):
    """A few more rows than one task walks need no rounds of links."""
    rows = crowd(150)
    nodes = spark.createDataFrame(rows, NODES).repartition(3)
    monkeypatch.setattr(ld, "WALK_TILE", 16)
    monkeypatch.setattr(ld, "_settle", lambda *a: 1 / 0)
    for walk in (100, 150):
        got = [r["id"] for r in ld.first_independent(nodes, cl.Rule(theta=0.8), walk_rows=walk).collect()]
        assert set(got) == first_set(rows, 0.8) and len(got) == len(set(got)) < 100


def test_a_null_id_is_walked(spark):
    rows = [(None, 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("b", 1, [0.0, 1.0])]
    got = [r["id"] for r in ld._walked(spark.createDataFrame(rows, NODES), cl.Rule(theta=0.7, keep="first", earlier=True)).collect()]
    assert got == [None, "a"]


def test_folded_tiles_equal_the_selection_by_prefixes(spark, monkeypatch):
    rows = crowd(130, 6)
    nodes = spark.createDataFrame(rows[30:], NODES)
    homes = spark.createDataFrame([(i, 0, v) for i, _, v in rows[:30:6]], NODES)
    monkeypatch.setattr(cl, "FOLD_TILE", 8)
    one, other = (
        sorted(tuple(r) for r in cl.assign_batch(homes, nodes, 0.8, fold_rows=n).select("id", "cluster_id", F.round("similarity", 6), "leads").collect())
        for n in (1000, 0)
    )
    assert one == other and 5 < sum(r[3] for r in one) < 90
