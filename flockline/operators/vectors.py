"""Vector stages: normalising, pairs, nearest rows, centroids, projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.functions import vectors as vx
from flockline.operators.kernel import Rule, match_candidates, match_rows
from flockline.session import materialize

MAX_LITERAL_TOPICS = 256
UNDATED = -(1 << 62)  # rows without a time come before all others


def l2_normalize(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    return vectors.withColumn(col, vx.normalize(vx.doubles(F.col(col))))


def drop_zero_vectors(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    return vectors.filter(vx.is_nonzero(F.col(col)))


def nodes(vectors: DataFrame, ts: Column | None = None) -> DataFrame:
    """(id, ts in microseconds, unit vec): the input form of the comparison kernel. Rows without a time are the earliest."""
    when = F.unix_micros("created_at") if ts is None else ts
    return vectors.select(
        "id", F.coalesce(when, F.lit(UNDATED)).alias("ts"), vx.normalize(vx.doubles(F.col("embedding"))).alias("vec")
    )


def node_time(ts: str = "ts") -> Column:
    """The time of a kernel row; null where it has none."""
    return F.when(F.col(ts) > UNDATED, F.timestamp_micros(ts))


def one_per_id(rows: DataFrame) -> DataFrame:
    """Kernel rows with repeated ids folded to their first appearance (ties to the smaller vector)."""
    return rows.groupBy("id").agg(F.min(F.struct("ts", "vec")).alias("first")).select("id", "first.*")


def cosine_pairs(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Cosine of the two embeddings that share a key, e.g. a post and its cluster's centroid."""
    a = left.withColumn("__a", vx.normalize(vx.doubles(F.col("embedding")))).drop("embedding")
    b = right.select(on, vx.normalize(vx.doubles(F.col("embedding"))).alias("__b"))
    return a.join(b, on).withColumn("similarity", vx.dot(F.col("__a"), F.col("__b"))).drop("__a", "__b")


def topic_match(rows: DataFrame, topics: DataFrame, col: str = "embedding") -> DataFrame:
    """Best topic by cosine, strictly positive, ties to the first in configured order.

    Topics are configuration. Up to ``MAX_LITERAL_TOPICS`` enter the plan as literals, so
    matching is a projection without any join; more are compared as stored rows, where
    similarities below a millionth count as none.
    """
    known = topics.filter(vx.is_nonzero(F.col("embedding"))).orderBy("ord").limit(MAX_LITERAL_TOPICS + 1)
    table = known.select("ord", "title", vx.normalize(vx.doubles(F.col("embedding"))).alias("unit")).collect()
    if len(table) > MAX_LITERAL_TOPICS:
        return _topic_join(rows, topics, col)
    if not table:
        return rows.withColumn("topic", F.lit(None).cast("string")).withColumn(
            "topic_similarity", F.lit(0.0)
        )
    numbers = lambda unit: F.expr("array(" + ",".join(f"double('{float(x)!r}')" for x in unit) + ")")
    scored = [
        F.struct(vx.dot(F.col("__unit"), numbers(t["unit"])).alias("s"), F.lit(-t["ord"]).alias("o"), F.lit(t["title"]).alias("title"))
        for t in table
    ]
    best = F.array_max(F.array(*scored))
    hit = F.col("__best.s") > 0
    return (
        rows.withColumn("__unit", vx.normalize(vx.doubles(F.col(col))))
        .withColumn("__best", best)
        .withColumn("topic", F.when(hit, F.col("__best.title")))
        .withColumn("topic_similarity", F.when(hit, F.col("__best.s")).otherwise(0.0))
        .drop("__unit", "__best")
    )


def _topic_join(rows: DataFrame, topics: DataFrame, col: str) -> DataFrame:
    unit = lambda c: vx.normalize(vx.doubles(F.col(c))).alias("vec")
    keyed = materialize(rows.withColumn("__row", F.monotonically_increasing_id()), "rows")
    probes = keyed.filter(vx.is_nonzero(F.col(col))).select(F.col("__row").alias("id"), F.lit(0).cast("bigint").alias("ts"), unit(col))
    order = F.col("ord").cast("bigint")
    homes = topics.filter(vx.is_nonzero(F.col("embedding"))).select(order.alias("id"), order.alias("ts"), unit("embedding"))
    found = match_rows(probes, materialize(homes, "topics"), Rule(theta=0.0, strict=True))
    named = found.join(topics.select(order.alias("match_id"), F.col("title").alias("topic")), "match_id")
    best = named.select(F.col("id").alias("__row"), "topic", F.col("similarity").alias("topic_similarity"))
    return keyed.join(best, "__row", "left").withColumn("topic_similarity", F.coalesce("topic_similarity", F.lit(0.0))).drop("__row")


def _cluster_nodes(clusters: DataFrame) -> DataFrame:
    return clusters.select(
        F.col("cluster_id").alias("id"),
        F.lit(0).cast("bigint").alias("ts"),
        vx.normalize(vx.doubles(F.col("centroid"))).alias("vec"),
    )


def nearest_clusters(
    vectors: DataFrame,
    clusters: DataFrame,
    k: int = 10,
    threshold: float = K.SIMILARITY_THRESHOLD,
    strict: bool = False,
    **blocks,
) -> DataFrame:
    """The k most similar centroids within the threshold, for every vector."""
    found = match_rows(
        nodes(vectors),
        materialize(_cluster_nodes(clusters), "centroids"),
        Rule(theta=threshold, strict=strict, k=k),
        **blocks,
    )
    return found.select("id", F.col("match_id").alias("cluster_id"), "similarity")


def nearest_cluster(
    vectors: DataFrame,
    clusters: DataFrame,
    threshold: float = K.SIMILARITY_THRESHOLD,
    strict: bool = True,
    **blocks,
) -> DataFrame:
    """The single most similar centroid, when it is similar enough."""
    return nearest_clusters(vectors, clusters, 1, threshold, strict, **blocks)


def similar_post_join(
    vectors: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, asked: Callable[[str], Column] | None = None, **blocks
) -> DataFrame:
    """Exact pairs of distinct vectors within the threshold; with ``asked``, a condition on an id column, pairs of asked posts.

    Exact copies are folded first: a pair stands for ``left_posts x right_posts``
    posts, and the earliest post represents its copies, so a large group of
    copies adds one row instead of all its pairs.
    """
    folded = _folded_copies(nodes(vectors))
    if asked is None:
        pairs = match_rows(folded, folded, Rule(theta=threshold, keep="all", earlier=True), **blocks)
    else:
        pairs = _once(match_rows(folded.filter(asked("id")), folded, Rule(theta=threshold, keep="all"), **blocks), asked)
    return _weighted_pairs(pairs, folded)


def similar_post_candidates(
    vectors: DataFrame,
    threshold: float = K.SIMILARITY_THRESHOLD,
    bits: int = 12,
    recall: float = 0.95,
    asked: Callable[[str], Column] | None = None,
    **blocks,
) -> DataFrame:
    """The rows of :func:`similar_post_join` that locality-sensitive hashing finds: all are right, some may lack.

    Only vectors that share one of several keys of ``bits`` random signs are compared; the number
    of keys follows from the threshold and the ``recall`` wanted for pairs at it. More bits make
    smaller groups and more copies of each row: worth it for high thresholds and large tables.
    Vectors that are null or zero match nothing.
    """
    folded = _folded_copies(nodes(drop_zero_vectors(vectors)))
    if asked is None:
        pairs = match_candidates(folded, Rule(theta=threshold, keep="all", earlier=True), bits, recall, **blocks)
    else:
        rule = Rule(theta=threshold, keep="all")
        pairs = _once(match_candidates(folded, rule, bits, recall, probe=folded.filter(asked("id")), **blocks), asked)
    return _weighted_pairs(pairs, folded)


def _once(found: DataFrame, asked: Callable[[str], Column]) -> DataFrame:
    """Each pair of an asked post and another one, as its later post and its match; pairs of two asked posts are found twice."""
    pairs = found.filter((F.col("match_id") < F.col("id")) | ((F.col("match_id") > F.col("id")) & ~F.coalesce(asked("match_id"), F.lit(False))))
    return pairs.select(F.greatest("id", "match_id").alias("id"), F.least("id", "match_id").alias("match_id"), "similarity")


def _folded_copies(found: DataFrame) -> DataFrame:
    return materialize(
        found.groupBy("vec")
        .agg(F.min(F.struct("ts", "id")).alias("first"), F.count("*").alias("posts"))
        .select("first.id", F.lit(0).cast("bigint").alias("ts"), "vec", "posts"),
        "folded",
    )


def _weighted_pairs(pairs: DataFrame, folded: DataFrame) -> DataFrame:
    sizes = folded.select("id", "posts")
    return (
        pairs.select(F.col("match_id").alias("left_id"), F.col("id").alias("right_id"), "similarity")
        .join(sizes.select(F.col("id").alias("left_id"), F.col("posts").alias("left_posts")), "left_id")
        .join(sizes.select(F.col("id").alias("right_id"), F.col("posts").alias("right_posts")), "right_id")
    )


def cluster_vectors(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """(cluster_id, post_id, joined_at, vec): each member with its unit vector."""
    unit = vectors.select(
        F.col("id").alias("post_id"), vx.normalize(vx.doubles(F.col("embedding"))).alias("vec")
    )
    return members.select("cluster_id", "post_id", "joined_at").join(unit, "post_id")


def vector_sums(rows: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, n, linear_sum, square_sum) with map-side partial sums, all in the JVM."""
    return (
        rows.groupBy(key)
        .agg(
            F.count("*").alias("n"),
            Summarizer.sum(array_to_vector(F.col("vec"))).alias("__sum"),
            F.sum(vx.dot(F.col("vec"), F.col("vec"))).alias("square_sum"),
        )
        .select(key, "n", vector_to_array("__sum").alias("linear_sum"), "square_sum")
    )


def centroids(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Normalised mean of the member vectors of each cluster."""
    sums = vector_sums(cluster_vectors(members, vectors))
    return sums.select("cluster_id", "n", vx.normalize(F.col("linear_sum")).alias("centroid"))


def centroid_preview(clusters: DataFrame, length: int = 5) -> DataFrame:
    return clusters.select("cluster_id", F.slice("centroid", 1, length).alias("preview"))


def running_centroid(
    members: DataFrame, vectors: DataFrame, rows_per_round: int = 50_000_000
) -> DataFrame:
    """Centroid renormalised after every post, in arrival order.

    The result depends on the order of each cluster's posts, so a cluster is
    folded as a stream: rows are sorted, and one state vector per cluster is
    carried, never the rows. Long histories are cut into time slices with the
    state table in between, which bounds the rows any one task reads.
    """
    rows = cluster_vectors(members, vectors).select(
        "cluster_id", F.unix_micros("joined_at").alias("ts"), F.col("post_id").alias("id"), "vec"
    )
    rows = materialize(rows, "running")
    largest = rows.groupBy("cluster_id").count().agg(F.max("count")).head()[0] or 0
    slices = max(1, -(-largest // rows_per_round))
    bounds = []
    if slices > 1:
        points = [i / slices for i in range(1, slices)]
        bounds = sorted(set(rows.agg(F.percentile_approx("ts", points)).head()[0]))
    state = None
    for lo, hi in zip([None, *bounds], [*bounds, None]):
        part = rows
        part = part if lo is None else part.filter(F.col("ts") > lo)
        part = part if hi is None else part.filter(F.col("ts") <= hi)
        state = _fold_slice(part, state)
        if hi is not None:
            state = materialize(state, "running-state")
    return state.select("cluster_id", "n", "centroid")


def _fold_slice(part: DataFrame, state: DataFrame | None) -> DataFrame:
    rows = part.select("cluster_id", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("kind"), "ts", "id", "vec")
    if state is not None:
        start = state.select(
            "cluster_id",
            "n",
            F.lit(0).alias("kind"),
            F.lit(None).cast("bigint").alias("ts"),
            F.lit(None).cast(part.schema["id"].dataType).alias("id"),
            F.col("centroid").alias("vec"),
        )
        rows = rows.unionByName(start)
    placed = rows.repartition("cluster_id").sortWithinPartitions("cluster_id", "kind", "ts", "id")

    def fold(batches):
        cluster, n, c = None, 0, None
        for pdf in batches:
            done = []
            for cid, had, kind, vec in zip(pdf["cluster_id"], pdf["n"], pdf["kind"], pdf["vec"]):
                if cid != cluster:
                    if cluster is not None:
                        done.append((cluster, n, c))
                    cluster, n, c = cid, 0, None
                if kind == 0:
                    n, c = had, vec
                else:
                    n += 1
                    c = vec if c is None else (c * (n - 1) + vec) / n
                    size = np.sqrt(c @ c)
                    c = c / size if size > 0 else c
            if done:
                yield pd.DataFrame(done, columns=["cluster_id", "n", "centroid"])
        if cluster is not None:
            yield pd.DataFrame([(cluster, n, c)], columns=["cluster_id", "n", "centroid"])

    kind = part.schema["cluster_id"].dataType.simpleString()
    return placed.mapInPandas(fold, f"cluster_id {kind}, n bigint, centroid array<double>")


def vector_pca(vectors: DataFrame, members: DataFrame, dims: int = 2, sample: int | None = None) -> DataFrame:
    """Principal components of the vectors with the cluster label of each post.

    The components are fitted on all rows; ``sample`` limits only the rows
    returned (the published scatter plot shows at most 500). The largest loading of
    a component is positive, so that its direction is always the same.
    """
    rows = vectors.select("id", array_to_vector(vx.doubles(F.col("embedding"))).alias("__v"))
    model = PCA(k=dims, inputCol="__v", outputCol="__p").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(dims)]).tolist()
    raw = model.transform(rows).select("id", vector_to_array("__p").alias("raw"))
    projected = raw.select("id", F.array(*[F.col("raw")[i] * sign for i, sign in enumerate(signs)]).alias("point"))
    if sample is not None:
        projected = projected.orderBy("id").limit(sample)
    labels = members.select(F.col("post_id").alias("id"), "cluster_id")
    return projected.join(labels, "id", "left").withColumn(
        "cluster_id", F.coalesce("cluster_id", F.lit("Unknown"))
    )


