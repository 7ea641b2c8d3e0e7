"""Cluster quality: coherence, scores, health."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.functions import vectors as vx
from flockline.operators import vectors as vo
from flockline.operators.kernel import PROBES_PER_TASK, Block, stream_blocks
from flockline.session import discard, materialize

# Two unit vectors both this close to a third have a cosine above 2 * c^2 - 1 > 0.
CORE_COSINE = 0.7072
_POSITIVE = 5e-7  # what still rounds to a positive number of six decimals
CELL_ROWS = 1024  # posts outside the core that are compared with a whole cluster
MAX_PIVOTS = 256
_SHELL = np.pi / 36
_SHELLS = 37
_MARGIN = 2e-6  # radians: more than the rounding of angles and _POSITIVE together
_SUMS = ["cluster_id", "pairs", "total", "compared"]


def coherence(members: DataFrame, vectors: DataFrame, block_rows: int = 8192, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Mean of the positive pairwise cosines of each cluster, exactly; see :func:`coherence_sums`."""
    sums = coherence_sums(members, vectors, block_rows, cell_rows)
    return sums.select(
        "cluster_id",
        F.when(F.col("n") < 2, 1.0)
        .when(F.coalesce("pairs", F.lit(0.0)) == 0, 0.0)
        .otherwise(F.col("total") / F.col("pairs"))
        .alias("coherence"),
    )


def coherence_sums(members: DataFrame, vectors: DataFrame, block_rows: int = 8192, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(cluster_id, n, pairs, total, compared): number and sum of the positive pairwise cosines.

    Posts within 45 degrees of their centroid have only positive cosines among
    each other, so all those pairs are one closed form of their vector sum.
    Posts outside that core meet all others in bounded blocks that each return
    one partial sum; no pair is ever a row. Where more than ``cell_rows`` posts
    are outside, whole cells of posts are settled first (:func:`_cell_sums`).
    ``compared`` counts the cosines that were computed.
    """
    rows = vo.cluster_vectors(members, vectors).select("cluster_id", F.col("post_id").alias("id"), "vec")
    rows = materialize(rows, "rows")
    centers = vo.vector_sums(rows).select("cluster_id", vx.normalize(F.col("linear_sum")).alias("center"))
    flagged = materialize(
        rows.join(centers, "cluster_id")
        .withColumn("slack", vx.dot(F.col("vec"), F.col("center")))
        .withColumn("tag", F.col("slack") >= CORE_COSINE)
        .withColumn("ts", F.lit(0).cast("bigint"))
        .drop("center"),
        "flagged",
    )
    discard(rows)
    core = vo.vector_sums(flagged.filter("tag")).select(
        "cluster_id",
        (F.col("n") * (F.col("n") - 1) / 2).alias("pairs"),
        ((vx.dot(F.col("linear_sum"), F.col("linear_sum")) - F.col("square_sum")) / 2).alias("total"),
        F.lit(0.0).alias("compared"),
    )
    sizes = flagged.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.count_if(~F.col("tag")).alias("outside")
    )
    grid = materialize(
        sizes.select(
            "cluster_id",
            "n",
            "outside",
            F.ceil(F.col("outside") / block_rows).cast("int").alias("chunks"),
            F.ceil(F.col("n") / PROBES_PER_TASK).cast("int").alias("salts"),
        ),
        "grid",
    )
    work = grid.filter((F.col("outside") > 0) & (F.col("outside") <= cell_rows)).select("cluster_id", "chunks", "salts")
    spread = F.xxhash64("id")
    plain = flagged.drop("slack")
    home = (
        plain.filter(~F.col("tag"))
        .join(work, "cluster_id")
        .withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("chunks", "salts")
    )
    probe = (
        plain.join(work, "cluster_id")
        .withColumn("salt", F.pmod(spread, F.col("salts")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks", "salts")
    )

    def partial(key: tuple, block: Block, q: Block):
        total, pairs = 0.0, 0
        for a in range(0, len(q.ids), 2048):
            p = q.part(slice(a, a + 2048))
            dots = p.vec @ block.vec.T
            counted = (dots >= _POSITIVE) & (
                p.tag.astype(bool)[:, None] | (p.ids[:, None] < block.ids[None, :])
            )
            total += float(dots[counted].sum())
            pairs += int(counted.sum())
        compared = float(len(q.ids) * len(block.ids))
        yield pd.DataFrame([(key[0], float(pairs), total, compared)], columns=_SUMS)

    kind = flagged.schema["cluster_id"].dataType.simpleString()
    schema = f"cluster_id {kind}, pairs double, total double, compared double"
    positive = core.unionByName(stream_blocks(home, probe, ["cluster_id", "chunk", "salt"], partial, schema))
    loose = grid.filter(F.col("outside") > cell_rows).select("cluster_id", "outside", "salts")
    if loose.head() is not None:
        positive = positive.unionByName(_cell_sums(flagged, loose, kind, block_rows))
    positive = positive.groupBy("cluster_id").agg(*[F.sum(c).alias(c) for c in _SUMS[1:]])
    sums = materialize(grid.select("cluster_id", "n").join(positive, "cluster_id", "left"), "sums")
    discard(flagged, grid)
    return sums


def _cells(rows: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their cell, and the pivots of each cluster.

    A cell holds the posts that are nearest to one pivot and lie in one shell
    of five degrees around the centroid. A cluster has about half as many pivots
    as the root of its outside posts, so pairs of cells grow with the posts.
    """
    first = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.xxhash64("id"), "id"))
    wanted = F.ceil(F.sqrt("outside") / 2)
    pivots = materialize(
        rows.filter(~F.col("tag"))
        .select("cluster_id", "id", "outside", "salts", "vec", (first - 1).cast("bigint").alias("pivot"))
        .filter((F.col("pivot") < MAX_PIVOTS) & (F.col("pivot") < wanted))
        .drop("outside", "id"),
        "pivots",
    )
    home = pivots.select(
        "cluster_id",
        F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"),
        F.col("pivot").alias("ts"),
        "vec",
        F.lit(1.0).alias("slack"),
        F.lit(False).alias("tag"),
    )
    probe = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts", "outside")

    def nearest(key: tuple, block: Block, q: Block):
        dots = q.vec @ block.vec.T
        pivot = dots.argmax(1)
        lean = np.arccos(np.clip(q.slack, -1.0, 1.0))
        shell = (lean / _SHELL).astype("int64")
        yield pd.DataFrame(
            {
                "cluster_id": key[0],
                "id": q.ids,
                "vec": list(q.vec),
                "cell": (q.tag.astype("int64") * _SHELLS + shell) * MAX_PIVOTS + block.ts[pivot],
                "lean": lean,
                "turn": np.arccos(np.clip(dots[np.arange(len(pivot)), pivot], -1.0, 1.0)),
            }
        )

    ids = rows.schema["id"].dataType.simpleString()
    schema = f"cluster_id {kind}, id {ids}, vec array<double>, cell bigint, lean double, turn double"
    return materialize(stream_blocks(home, probe, ["cluster_id", "salt"], nearest, schema), "celled"), pivots


def _cell_sums(flagged: DataFrame, loose: DataFrame, kind: str, block_rows: int) -> DataFrame:
    """Positive pairs of loose clusters, but for pairs within the core.

    Two cells whose members can only have acute angles are a product of vector sums, two
    whose members can only have obtuse ones are nothing; both follow from the angle between
    their pivots and from the angles to the centroid. Members are compared for the other
    pairs of cells only: the one cell is dealt to bounded blocks, and of the other one copy
    goes to each block that holds a cell it must meet.
    """
    celled, pivots = _cells(flagged.join(loose, "cluster_id"), kind)
    cells = (
        celled.groupBy("cluster_id", "cell")
        .agg(
            F.count("*").alias("n"),
            Summarizer.sum(array_to_vector(F.col("vec"))).alias("sum"),
            F.sum(vx.dot(F.col("vec"), F.col("vec"))).alias("square"),
            F.max("turn").alias("turn"),
            F.min("lean").alias("low"),
            F.max("lean").alias("high"),
        )
        .withColumn("pivot", F.pmod("cell", F.lit(MAX_PIVOTS)))
        .join(pivots.select("cluster_id", "pivot", "vec"), ["cluster_id", "pivot"])
    )
    numbers = F.array(F.col("n").cast("double"), "square", "turn", "low", "high")
    before = Window.partitionBy("cluster_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(
        cells.select(
            "cluster_id",
            F.col("cell").alias("id"),
            F.col("cell").alias("ts"),
            "vec",
            F.concat(numbers, vector_to_array("sum")).alias("tag"),
            "n",
            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        ),
        "cells",
    )
    core_from = _SHELLS * MAX_PIVOTS

    def settle(key: tuple, block: Block, q: Block):
        h = np.stack(block.tag)
        for a in range(0, len(q.ids), 512):
            p = q.part(slice(a, a + 512))
            g = np.stack(p.tag)
            angle = np.arccos(np.clip(p.vec @ block.vec.T, -1.0, 1.0))
            turns = g[:, 2][:, None] + h[:, 2][None, :]
            most = np.minimum(angle + turns, g[:, 4][:, None] + h[:, 4][None, :])
            least = np.maximum(angle - turns, g[:, 3][:, None] - h[:, 4][None, :])
            least = np.maximum(least, h[:, 3][None, :] - g[:, 4][:, None])
            same = p.ids[:, None] == block.ids[None, :]
            wanted = (block.ids[None, :] <= p.ids[:, None]) & (block.ids < core_from)[None, :]
            wanted &= ~(same & (g[:, 0] < 2)[:, None])
            acute = wanted & (most < np.pi / 2 - _MARGIN)
            mixed = wanted & ~acute & (least <= np.pi / 2 + _MARGIN)
            n = np.where(same, (g[:, 0] * (g[:, 0] - 1) / 2)[:, None], g[:, 0][:, None] * h[:, 0][None, :])
            dots = g[:, 5:] @ h[:, 5:].T
            dots = np.where(same, (dots - g[:, 1][:, None]) / 2, dots)
            i, j = np.nonzero(mixed)
            yield pd.DataFrame(
                {
                    "cluster_id": key[0],
                    "cell": np.r_[p.ids[i], -1],
                    "other": np.r_[block.ids[j], -1],
                    "pairs": np.r_[np.zeros(len(i)), n[acute].sum()],
                    "total": np.r_[np.zeros(len(i)), dots[acute].sum()],
                }
            )

    sides = cells.drop("n", "start")
    schema = f"cluster_id {kind}, cell bigint, other bigint, pairs double, total double"
    settled = materialize(stream_blocks(sides, sides, ["cluster_id"], settle, schema), "settled")
    spans = cells.select("cluster_id", F.col("id").alias("other"), "n", "start")
    met = settled.filter("cell >= 0").join(spans, ["cluster_id", "other"])
    last = F.floor((F.col("start") + F.col("n") - 1) / block_rows)
    met = (
        met.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / block_rows), last)))
        .groupBy("cluster_id", "cell", "chunk")
        .agg(F.collect_list("other").alias("others"))
    )
    place = F.col("start") + F.pmod(F.xxhash64("id"), F.col("n"))
    home = celled.join(spans.withColumnRenamed("other", "cell"), ["cluster_id", "cell"]).select(
        "cluster_id", F.floor(place / block_rows).alias("chunk"), "id", F.col("cell").alias("ts"), "vec",
        F.array("cell").alias("tag"),
    )
    tasks = loose.select("cluster_id", "salts")
    home = home.filter(F.col("ts") < core_from).join(tasks, "cluster_id")
    home = home.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    probe = celled.join(met, ["cluster_id", "cell"]).join(tasks, "cluster_id").select(
        "cluster_id", "chunk", "id", F.col("cell").alias("ts"), "vec", F.col("others").alias("tag"),
        F.pmod(F.xxhash64("id", "chunk"), F.col("salts")).cast("int").alias("salt"),
    )

    def partial(key: tuple, block: Block, q: Block):
        total, pairs, compared = 0.0, 0, 0
        for cell in np.unique(q.ts):
            mine = q.part(np.nonzero(q.ts == cell)[0])
            theirs = block.part(np.isin(block.ts, mine.tag[0]))
            for a in range(0, len(mine.ids), 2048):
                p = mine.part(slice(a, a + 2048))
                dots = p.vec @ theirs.vec.T
                once = (theirs.ts != cell)[None, :] | (p.ids[:, None] < theirs.ids[None, :])
                counted = (dots >= _POSITIVE) & once
                total += float(dots[counted].sum())
                pairs += int(counted.sum())
                compared += dots.size
        yield pd.DataFrame([(key[0], float(pairs), total, float(compared))], columns=_SUMS)

    schema = f"cluster_id {kind}, pairs double, total double, compared double"
    found = stream_blocks(home, probe, ["cluster_id", "chunk", "salt"], partial, schema)
    settled_sums = settled.filter("cell < 0").select("cluster_id", "pairs", "total", F.lit(0.0).alias("compared"))
    sums = materialize(found.unionByName(settled_sums), "sums")
    discard(celled, pivots, cells, settled)
    return sums


def coherence_of_sums(n: Column, linear_sum: Column, square_sum: Column) -> Column:
    """Mean cosine over all pairs of ``n`` unit vectors, from their additive summary alone."""
    return F.when(n < 2, 1.0).otherwise((vx.dot(linear_sum, linear_sum) - square_sum) / (n * (n - 1)))


def coherence_fast(features: DataFrame) -> DataFrame:
    """Mean over all pairs of unit vectors, from the additive summary alone."""
    found = coherence_of_sums(F.col("n"), F.col("linear_sum"), F.col("square_sum"))
    return features.select("cluster_id", found.alias("coherence"))


def low_coherence(
    base: DataFrame, min_coherence: float = K.MIN_COHERENCE, min_size: int = 5, limit: int | None = None
) -> DataFrame:
    """Active clusters larger than ``min_size`` whose coherence is too low, worst first."""
    found = (
        base.filter((F.col("status") == "active") & (F.col("size") > min_size))
        .filter(F.col("coherence") < min_coherence)
        .select("cluster_id", "size", "coherence")
    )
    return found if limit is None else found.orderBy("coherence", "cluster_id").limit(limit)


def quality_score() -> Column:
    """Mean of coherence, size up to ten and topic similarity, negatives as zero."""
    zero = F.lit(0.0)
    return (
        F.greatest(F.col("coherence"), zero)
        + F.least(F.col("size") / 10, F.lit(1.0))
        + F.greatest(F.col("topic_similarity"), zero)
    ) / 3


def quality_scores(base: DataFrame) -> DataFrame:
    return base.filter("status = 'active'").select("cluster_id", quality_score().alias("quality"))


SIZE_BINS = ["Small (1-2)", "Medium (3-10)", "Large (11+)"]
COHERENCE_BINS = ["Low (<0.5)", "Medium (0.5-0.8)", "High (0.8+)"]


def _binned(base: DataFrame) -> DataFrame:
    size, coh = F.col("size"), F.col("coherence")
    return base.filter("status = 'active'").select(
        F.when(size <= 2, SIZE_BINS[0]).when(size <= 10, SIZE_BINS[1]).otherwise(SIZE_BINS[2]).alias("size_bin"),
        F.when(coh < 0.5, COHERENCE_BINS[0])
        .when(coh < 0.8, COHERENCE_BINS[1])
        .otherwise(COHERENCE_BINS[2])
        .alias("coherence_bin"),
    )


def health_matrix(base: DataFrame) -> DataFrame:
    """Counts of active clusters in all nine cells of size by coherence."""
    cells = base.sparkSession.createDataFrame(
        [(s, c) for s in SIZE_BINS for c in COHERENCE_BINS], "size_bin string, coherence_bin string"
    )
    counts = _binned(base).groupBy("size_bin", "coherence_bin").agg(F.count("*").alias("clusters"))
    return cells.join(counts, ["size_bin", "coherence_bin"], "left").na.fill(0, ["clusters"])


def health_pivot(base: DataFrame) -> DataFrame:
    """The same matrix with one column per size bin."""
    return _binned(base).groupBy("coherence_bin").pivot("size_bin", SIZE_BINS).count().na.fill(0)


def topic_quality(base: DataFrame) -> DataFrame:
    """Per topic: mean of average positive coherence and average size up to five."""
    active = base.filter("status = 'active' AND topic IS NOT NULL")
    coherent = F.coalesce(F.avg(F.when(F.col("coherence") > 0, F.col("coherence"))), F.lit(0.0))
    return active.groupBy("topic").agg(
        ((coherent + F.least(F.avg("size") / 5, F.lit(1.0))) / 2).alias("quality")
    )


def coherence_vs_size(base: DataFrame) -> DataFrame:
    return base.filter("coherence > 0").select("cluster_id", "size", "coherence")


def similarity_vs_size(base: DataFrame) -> DataFrame:
    return base.filter("topic_similarity > 0").select(
        "cluster_id", "size", "topic_similarity", F.coalesce("topic", F.lit("None")).alias("topic")
    )


def avg_coherence(base: DataFrame, sample: int | None = 10) -> DataFrame:
    """Mean coherence of the active ones among the first ``sample`` clusters, or of all active."""
    first = base if sample is None else base.orderBy("created_at", "cluster_id").limit(sample)
    return first.filter("status = 'active'").agg(
        F.coalesce(F.avg("coherence"), F.lit(0.0)).alias("average_coherence")
    )
