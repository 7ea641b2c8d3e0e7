"""Connected components of a link table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline.session import discard, materialize

FEW = 50_000  # links that one task contracts without a shuffle


def components(links: DataFrame) -> DataFrame:
    """Each id that occurs in ``links (a, b)`` with the smallest id it can reach: ``(id, component_id)``.

    Every round each id hooks onto the first of itself and its neighbours, links
    are rewritten to the hooks, and links within one hook vanish. The order of ids
    is their value in the first round, which settles stars around small ids, and a
    fresh pseudo-random one in each later round, so that even chains shrink by a
    constant factor: rounds grow with the logarithm of the longest path. Hubs are
    pre-aggregated by ``min``; nothing is gathered per id. Null ends are no links.
    Links shrink fast; the last ``FEW`` of them need no more shuffles.
    """
    edges = materialize(_tidy(links.select("a", "b")), "edges")
    steps: list[DataFrame] = []
    while n := edges.count():
        packed = (lambda df: df.coalesce(1)) if n <= FEW else (lambda df: df)
        old, edges = edges, packed(edges)
        rank = (lambda c: F.xxhash64(F.lit(len(steps)), c)) if steps else (lambda c: c.cast("long"))
        both = edges.select(F.col("a").alias("id"), F.col("b").alias("near"))
        both = both.union(edges.select("b", "a"))
        best = F.min(F.struct(rank(F.col("near")).alias("rank"), "near")).alias("best")
        own = F.struct(rank(F.col("id")).alias("rank"), F.col("id").alias("near"))
        hooks = both.groupBy("id").agg(best).select("id", F.least(own, "best")["near"].alias("hook"))
        hooks = materialize(hooks, "hooks")
        ends = [packed(hooks).select(F.col("id").alias(c), F.col("hook").alias(f"{c}_hook")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").select(F.col("a_hook").alias("a"), F.col("b_hook").alias("b"))
        edges = materialize(_tidy(moved), "edges")
        discard(old)
        steps.append(hooks)
    if not steps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    root = steps[0]
    for k, step in enumerate(steps[1:]):
        step = step.select(F.col("id").alias("hook"), F.col("hook").alias("next"))
        root = root.join(step, "hook", "left").select("id", F.coalesce("next", "hook").alias("hook"))
    root = materialize(root, "roots")
    discard(edges, *steps)
    least = root.groupBy("hook").agg(F.min("id").alias("component_id"))
    return root.join(least, "hook").select("id", "component_id")


def extended(label: DataFrame, links: DataFrame) -> DataFrame:
    """Components ``label (id, component_id)`` after more ``links``; only components are contracted again."""
    if links.isEmpty():
        return label
    ends = [label.select(F.col("id").alias(c), F.col("component_id").alias(f"{c}_at")) for c in ("a", "b")]
    named = links.join(ends[0], "a", "left").join(ends[1], "b", "left")
    a, b = F.coalesce("a_at", "a"), F.coalesce("b_at", "b")
    onto = components(named.select(a.alias("a"), b.alias("b"))).toDF("component_id", "onto")
    new = named.select(F.explode(F.array(F.when(F.col("a_at").isNull(), F.col("a")), F.when(F.col("b_at").isNull(), F.col("b")))).alias("id"))
    every = label.union(new.filter("id IS NOT NULL").distinct().select("id", F.col("id").alias("component_id")))
    return materialize(every.join(onto, "component_id", "left").select("id", F.coalesce("onto", "component_id").alias("component_id")), "label")


def _tidy(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
