"""Leader clustering, refinement, incremental assignment, micro clusters, cluster table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockline.functions import constants as K
from flockline.functions import vectors as vx
from flockline.operators import vectors as vo
from flockline.operators.kernel import Rule, match_rows
from flockline.operators.leaders import first_independent
from flockline.operators.windows import running_count
from flockline.session import discard, materialize

BUCKET_ROWS = 8192  # rows that one task folds into local summaries
MAX_PIVOTS = 4096  # directions by which rows are dealt to such tasks
FOLD_ROWS = 16_384  # rows of a batch that one task walks through in order
FOLD_TILE = 512  # of them at a time


def select_leaders(nodes: DataFrame, threshold: float, strict: bool = False, **blocks) -> DataFrame:
    """Leader rows (id, ts, vec). Copies of a vector are folded first: they never change leaders."""
    folded = (
        nodes.groupBy("vec")
        .agg(F.min(F.struct("ts", "id")).alias("first"))
        .select("first.id", "first.ts", "vec")
    )
    ids = first_independent(folded, Rule(theta=threshold, strict=strict), **blocks)
    return materialize(nodes.join(ids, "id", "left_semi"), "leaders")


def leader_cluster(
    vectors: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, strict: bool = False, **blocks
) -> DataFrame:
    """Members under the arrival-order rule: join the most similar earlier leader, else lead.

    The cluster id is the id of its leader. Of repeated ids the first row counts.
    """
    rows = materialize(vo.one_per_id(vo.nodes(vo.drop_zero_vectors(vectors))), "nodes")
    leaders = select_leaders(rows, threshold, strict, **blocks)
    joined = match_rows(rows, leaders, Rule(theta=threshold, strict=strict, earlier=True), **blocks)
    found = rows.select("id", "ts").join(joined.select("id", "match_id", "similarity"), "id", "left")
    led = found.join(leaders.select("id", F.lit(True).alias("leads")), "id", "left")
    return led.select(
        F.when(F.col("leads"), F.col("id")).otherwise(F.col("match_id")).cast("string").alias("cluster_id"),
        F.col("id").alias("post_id"),
        vo.node_time().alias("joined_at"),
        F.when(F.col("leads"), 1.0).otherwise(F.col("similarity")).alias("similarity"),
    )


def refine_clusters(
    vectors: DataFrame, members: DataFrame, rounds: int = 1, threshold: float = K.SIMILARITY_THRESHOLD
) -> DataFrame:
    """Move centroids to the mean of their members and reassign every post, ``rounds`` times.

    Most posts find a centroid within the threshold, where the search prunes;
    only the others are compared without a bound.
    """
    rows = materialize(vo.one_per_id(vo.nodes(vo.drop_zero_vectors(vectors))), "nodes")
    times = members.select(F.col("post_id").alias("id"), "joined_at")
    for _ in range(rounds):
        means = vo.centroids(members, vectors)
        homes = materialize(
            means.select(
                F.col("cluster_id").alias("id"),
                F.lit(0).cast("bigint").alias("ts"),
                F.col("centroid").alias("vec"),
            ),
            "centroids",
        )
        near = materialize(match_rows(rows, homes, Rule(theta=threshold)), "near")
        far = match_rows(rows.join(near, "id", "left_anti"), homes, Rule(theta=-1.0))
        best = near.unionByName(far).join(times, "id")
        members = materialize(
            best.select(
                F.col("match_id").alias("cluster_id"),
                F.col("id").alias("post_id"),
                "joined_at",
                "similarity",
            ),
            "members",
        )
    return members


def cluster_features(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Additive summary of each cluster: n, sum of vectors, sum of squares."""
    return vo.vector_sums(vo.cluster_vectors(members, vectors))


def merge_features(left: DataFrame, right: DataFrame) -> DataFrame:
    """Features of the union of two disjoint member sets."""
    return _summed(left.unionByName(right))


def _summed(parts: DataFrame) -> DataFrame:
    return (
        parts.groupBy("cluster_id")
        .agg(
            F.sum("n").alias("n"),
            Summarizer.sum(array_to_vector(F.col("linear_sum"))).alias("__sum"),
            F.sum("square_sum").alias("square_sum"),
        )
        .select("cluster_id", "n", vector_to_array("__sum").alias("linear_sum"), "square_sum")
    )


def feature_centroids(features: DataFrame) -> DataFrame:
    """Unit centroid and radius of each summary."""
    mean_sq = vx.dot(F.col("linear_sum"), F.col("linear_sum")) / (F.col("n") * F.col("n"))
    spread = F.greatest(F.col("square_sum") / F.col("n") - mean_sq, F.lit(0.0))
    return features.select(
        "cluster_id",
        "n",
        vx.normalize(F.col("linear_sum")).alias("centroid"),
        F.sqrt(spread).alias("radius"),
    )


def _fold_batch(rows: DataFrame, stored: DataFrame, threshold: float, strict: bool) -> DataFrame:
    """Choices of a batch that one task walks through in arrival order."""

    def best(v: np.ndarray, vecs: np.ndarray, out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Score and place of the most similar leader of each row, the first among equals; -inf where none is near."""
        top, at = np.full(len(v), -np.inf), np.zeros(len(v), dtype="int64")
        for lo in range(0, len(vecs), 4 * FOLD_TILE):
            s = np.floor(v @ vecs[lo : lo + 4 * FOLD_TILE].T * 1e6 + 0.5) / 1e6
            s[(s <= threshold) if strict else (s < threshold)] = -np.inf
            if out is not None:
                s[out[:, lo : lo + 4 * FOLD_TILE]] = -np.inf
            k = s.argmax(1)
            more = s[np.arange(len(k)), k] > top
            top[more], at[more] = s[more, k[more]], lo + k[more]
        return top, at

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaders, vecs = np.zeros(0, dtype=object), None
        for batch in batches:
            for a in range(0, len(batch), FOLD_TILE):
                pdf = batch.iloc[a : a + FOLD_TILE]
                ids = pdf["id"].astype(str).to_numpy(dtype=object)
                v = np.stack(pdf["vec"].to_numpy()).astype("float64")
                homes = pdf["match_id"].to_numpy(dtype=object)
                homeless = pdf["match_id"].isna().to_numpy()
                vecs = np.zeros((0, v.shape[1])) if vecs is None else vecs
                top, at = best(v, vecs)
                free = np.nonzero(homeless & (top == -np.inf))[0]
                # Rows that no leader before the tile takes decide among themselves, row by row.
                s = np.floor(v[free] @ v[free].T * 1e6 + 0.5) / 1e6
                near = s > threshold if strict else s >= threshold
                led = np.zeros(len(free), dtype=bool)
                for k in range(len(free)):
                    led[k] = not (near[k, :k] & led[:k]).any()
                new = free[led]
                more, place = best(v, v[new], new[None, :] >= np.arange(len(v))[:, None])
                later = more > top
                top[later], at[later] = more[later], len(leaders) + place[later]
                leaders, vecs = np.concatenate([leaders, ids[new]]), np.concatenate([vecs, v[new]])
                near_home = pdf["similarity"].to_numpy(dtype="float64")
                held = ~homeless & (near_home >= top)
                lead = np.zeros(len(v), dtype=bool)
                lead[new] = True
                taken = ~held & ~lead
                chosen = np.where(held, homes, ids)
                chosen[taken] = leaders[at[taken]]
                scores = np.where(held, near_home, np.where(lead, 1.0, top))
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "cluster_id": chosen, "similarity": scores, "leads": lead})

    kind = rows.schema["id"].dataType.simpleString()
    placed = rows.join(stored.select("id", "match_id", "similarity"), "id", "left").select("ts", "id", "vec", "match_id", "similarity")
    ordered = placed.repartition(1).sortWithinPartitions("ts", "id")
    return ordered.mapInPandas(walk, f"id {kind}, cluster_id string, similarity double, leads boolean")


def assign_batch(
    homes: DataFrame,
    rows: DataFrame,
    threshold: float = K.SIMILARITY_THRESHOLD,
    strict: bool = False,
    fold_rows: int = FOLD_ROWS,
    counted: int | None = None,
) -> DataFrame:
    """(id, cluster_id, similarity, leads) of a batch, given stored centroids, both as kernel rows.

    A row joins the most similar of the stored centroids and the earlier new leaders of its
    batch, the stored one among equals; a row near neither starts a cluster under its own
    id. A batch of at most ``fold_rows`` rows is walked through by one task once the stored
    centroids are compared; a larger one selects its leaders by prefixes. Both give the same.
    """
    stored = match_rows(rows, homes, Rule(theta=threshold, strict=strict))
    if (rows.count() if counted is None else counted) <= fold_rows:
        return _fold_batch(rows, stored, threshold, strict)
    stored = materialize(stored, "stored")
    leaders = select_leaders(materialize(rows.join(stored, "id", "left_anti"), "fresh"), threshold, strict)
    new = match_rows(rows, leaders, Rule(theta=threshold, strict=strict, earlier=True))
    own = F.col("id").cast("string").alias("match_id")
    choice = (
        stored.select("id", "similarity", F.lit(0).alias("o"), F.col("match_id").cast("string").alias("match_id"))
        .unionByName(new.select("id", "similarity", F.lit(-1).alias("o"), F.col("match_id").cast("string").alias("match_id")))
        .unionByName(leaders.select("id", F.lit(1.0).alias("similarity"), F.lit(-2).alias("o"), own))
        .groupBy("id")
        .agg(F.max(F.struct("similarity", "o", "match_id")).alias("c"))
    )
    return choice.select("id", F.col("c.match_id").alias("cluster_id"), "c.similarity", (F.col("c.o") == -2).alias("leads"))


def assign_incremental(
    features: DataFrame, batch: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, strict: bool = False, **fold
) -> tuple[DataFrame, DataFrame]:
    """(members of the batch, merged features) for stored features and a new batch of vectors."""
    rows = materialize(vo.one_per_id(vo.nodes(vo.drop_zero_vectors(batch))), "batch")
    homes = materialize(vo._cluster_nodes(feature_centroids(features)), "centroids")
    chosen = assign_batch(homes, rows, threshold, strict, **fold)
    columns = ["cluster_id", F.col("id").alias("post_id"), vo.node_time().alias("joined_at"), "similarity", "leads", "vec"]
    members = materialize(rows.join(chosen, "id").select(*columns), "assigned")
    discard(homes)
    merged = merge_features(features, vo.vector_sums(members))
    return members.drop("vec"), merged


def batch_outcomes(posts: DataFrame, members: DataFrame) -> DataFrame:
    """Outcome of every post of a batch: new_cluster, clustered or skipped."""
    placed = members.select(F.col("post_id").alias("id"), "cluster_id", "leads")
    return posts.select("id").join(placed, "id", "left").withColumn(
        "outcome",
        F.when(F.col("cluster_id").isNull(), "skipped")
        .when(F.col("leads"), "new_cluster")
        .otherwise("clustered"),
    )


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("posts"))


def micro_clusters(vectors: DataFrame, radius: float = K.RADIUS_THRESHOLD) -> DataFrame:
    """Summaries (cluster_id, n, linear_sum, square_sum, radius), every radius <= ``radius``."""
    summaries, _ = micro_assignment(vectors, radius)
    radii = feature_centroids(summaries).select("cluster_id", "radius")
    return summaries.join(radii, "cluster_id")


def micro_members(vectors: DataFrame, radius: float = K.RADIUS_THRESHOLD) -> DataFrame:
    """(post_id, label): the micro cluster of every post, named after its earliest post."""
    return micro_assignment(vectors, radius)[1]


def micro_assignment(vectors: DataFrame, radius: float = K.RADIUS_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(summaries, members) of the micro clusters; ids are unique and vectors of one length.

    Buckets of at most about ``BUCKET_ROWS`` rows of like direction are folded into local
    summaries, so neither the partition count nor a task's share changes the result, and near
    copies meet at once. The summaries are then grouped around leaders whose spread still fits
    the bound, and the groups again, until no centroid lies within the slack of another. The
    mean has the least spread, so a group's true radius stays within it. Leaders that
    nobody joined stay as they are, so a later round only compares those that moved with all.
    A post's way to its cluster is post -> local summary -> owner of each round; only ids
    travel along it. Rows without a vector are left out; rows without a time are the earliest.
    """
    limit = radius * radius
    local, members = _local_summaries(vectors, limit)
    moved = None
    while True:
        nodes = materialize(_summary_nodes(local, limit), "summaries")
        owners = _owners(nodes, moved)
        joined = owners.filter("id <> owner")
        if not joined.head(1):
            break
        moved = materialize(joined.select(F.col("owner").alias("id")).distinct(), "moved")
        discard(local)
        local = materialize(_united(nodes, owners), "united")
        step = owners.select(F.col("id").alias("label"), "owner")
        longer = materialize(
            members.join(step, "label").select("post_id", F.col("owner").alias("label")), "members"
        )
        discard(members, nodes, owners)
        members = longer
    discard(nodes, owners)
    summaries = local.select(F.col("id").cast("string").alias("cluster_id"), "n", "linear_sum", "square_sum")
    return summaries, members.select("post_id", F.col("label").cast("string").alias("label"))


def _directions(rows: DataFrame, n: int) -> DataFrame:
    """``bucket`` by the pivot of the most similar direction; pivots with more than ``BUCKET_ROWS`` rows are cut by a hash of the id."""
    wanted = min(MAX_PIVOTS, 8 * -(-n // BUCKET_ROWS))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen], dtype="float64")
    pivots = np.unique(pivots / np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12), axis=0)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(bucket=(np.stack(pdf["vec"].to_numpy()) @ pivots.T).argmax(1))

    schema = T.StructType([*rows.schema.fields, T.StructField("bucket", T.LongType())])
    near = materialize(rows.mapInPandas(nearest, schema), "directions")
    sizes = near.groupBy("bucket").count().filter(F.col("count") > BUCKET_ROWS).collect()
    chunk = F.lit(0).cast("bigint")
    if sizes:
        chunks = F.create_map(*[F.lit(x) for r in sizes for x in (r["bucket"], -(-r["count"] // BUCKET_ROWS))])
        chunk = F.pmod(F.xxhash64("id"), F.coalesce(chunks[F.col("bucket")], F.lit(1))).cast("bigint")
    return near.withColumn("bucket", F.col("bucket") + chunk * len(pivots))


def _local_summaries(vectors: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """Summaries (id, ts, n, linear_sum, square_sum) of each bucket, and (post_id, label) of its posts."""
    when = F.coalesce(F.unix_micros("created_at"), F.lit(vo.UNDATED))
    rows = vectors.select(when.alias("ts"), "id", vx.doubles(F.col("embedding")).alias("vec"))
    rows = rows.filter(F.size("vec") > 0)
    n = vectors.count()
    bucketed = _directions(rows, n) if n > BUCKET_ROWS else rows.withColumn("bucket", F.lit(0).cast("bigint"))
    placed = bucketed.repartition("bucket").sortWithinPartitions("bucket", "ts", "id")

    def fold(batches):
        ids, ts = [], []
        n, sq = np.zeros(0), np.zeros(0)
        sums, means, half = np.zeros((0, 0)), np.zeros((0, 0)), np.zeros(0)
        used, now = 0, None

        def local():
            return pd.DataFrame(
                {
                    "post_id": None,
                    "id": ids,
                    "ts": ts,
                    "n": n[:used].astype("int64"),
                    "linear_sum": list(sums[:used].copy()),
                    "square_sum": sq[:used].copy(),
                }
            )

        for pdf in batches:
            joins = []
            for bucket, when, pid, vec in zip(pdf["bucket"], pdf["ts"], pdf["id"], pdf["vec"]):
                if bucket != now:
                    if used:
                        yield local()
                    now, used, ids, ts = bucket, 0, [], []
                v = np.asarray(vec, dtype=float)
                s = float(v @ v)
                if used:
                    # Half of |mean|^2 less the product orders by distance; what lies within its rounding is compared by distance.
                    rough = half[:used] - means[:used] @ v
                    least = rough.min()
                    close = np.nonzero(rough <= least + 1e-9 * (1.0 + s + abs(least)))[0]
                    near = int(close[0] if len(close) == 1 else close[((means[close] - v) ** 2).sum(1).argmin()])
                    joined = sums[near] + v
                    count = n[near] + 1
                    if (sq[near] + s) / count - joined @ joined / count**2 <= limit:
                        sums[near], n[near], sq[near] = joined, count, sq[near] + s
                        means[near] = joined / count
                        half[near] = means[near] @ means[near] / 2
                        joins.append(ids[near])
                        continue
                if used == len(n):
                    grow = max(64, used)
                    n, sq = np.r_[n, np.zeros(grow)], np.r_[sq, np.zeros(grow)]
                    half = np.r_[half, np.zeros(grow)]
                    sums = np.vstack([sums.reshape(-1, len(v)), np.zeros((grow, len(v)))])
                    means = np.vstack([means.reshape(-1, len(v)), np.zeros((grow, len(v)))])
                ids.append(pid)
                ts.append(when)
                joins.append(pid)
                sums[used], n[used], sq[used] = v, 1, s
                means[used], half[used] = v, s / 2
                used += 1
            placed_rows = {"post_id": pdf["id"], "id": joins, "ts": None, "n": None, "linear_sum": None, "square_sum": None}
            yield pd.DataFrame(placed_rows)
        if used:
            yield local()

    kind = vectors.schema["id"].dataType.simpleString()
    schema = f"post_id {kind}, id {kind}, ts bigint, n bigint, linear_sum array<double>, square_sum double"
    both = materialize(placed.mapInPandas(fold, schema), "local")
    local = materialize(both.filter("n IS NOT NULL").drop("post_id"), "summaries")
    members = materialize(both.filter("n IS NULL").select("post_id", F.col("id").alias("label")), "members")
    discard(both)
    return local, members


def _summary_nodes(local: DataFrame, limit: float) -> DataFrame:
    """Summaries as kernel rows: mean, and how far another mean may lie without passing the bound."""
    spread = F.greatest(
        F.col("square_sum") / F.col("n") - vx.dot(F.col("vec"), F.col("vec")), F.lit(0.0)
    )
    means = local.withColumn("vec", F.transform("linear_sum", lambda x: x / F.col("n")))
    return means.withColumn("slack", F.greatest(F.lit(limit) - spread, F.lit(0.0)))


def _owners(nodes: DataFrame, moved: DataFrame | None = None) -> DataFrame:
    """(id, owner): the leader that each summary joins, itself if it leads.

    With ``moved``, ids, no two other summaries match; then only these and what they match can join.
    """
    rule = Rule(slack=True)
    shape = nodes.select("id", "ts", "vec", "slack")
    if moved is not None:
        own = materialize(shape.join(moved, "id", "left_semi"), "moved")
        near = match_rows(shape, own, Rule(slack=True, keep="first")).select("id").unionByName(own.select("id")).distinct()
        shape = materialize(shape.join(near, "id", "left_semi"), "near")
    leaders = materialize(shape.join(first_independent(shape, rule), "id", "left_semi"), "leaders")
    others = shape.join(leaders.select("id"), "id", "left_anti")  # a leader matches no earlier leader
    joined = match_rows(others, leaders, Rule(slack=True, earlier=True)).select("id", "match_id")
    led = leaders.select("id", F.lit(True).alias("leads"))
    owner = F.when(F.col("leads"), F.col("id")).otherwise(F.coalesce("match_id", "id"))
    found = nodes.select("id").join(joined, "id", "left").join(led, "id", "left")
    owned = materialize(found.select("id", owner.alias("owner")), "owners")
    discard(leaders)
    return owned


def _united(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """Sums of the summaries of each owner; the owner is the earliest of them."""
    parts = nodes.join(owners, "id")
    sums = _summed(parts.select(F.col("owner").alias("cluster_id"), "n", "linear_sum", "square_sum"))
    times = parts.groupBy(F.col("owner").alias("cluster_id")).agg(F.min("ts").alias("ts"))
    return sums.join(times, "cluster_id").withColumnRenamed("cluster_id", "id")


def adaptive_radius(n: int) -> float:
    return max(0.2, 0.5 - n / 10000)


def recluster(members: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """Micro clusters of the posts of active clusters, with a radius that shrinks as data grows."""
    kept, radius = _active_vectors(members, clusters, vectors)
    return micro_clusters(kept, radius)


def post_labels(members: DataFrame, clusters: DataFrame, vectors: DataFrame) -> DataFrame:
    """(post_id, label): the micro cluster of each post of an active cluster after a full new fit."""
    kept, radius = _active_vectors(members, clusters, vectors)
    return micro_members(kept, radius)


def _active_vectors(members: DataFrame, clusters: DataFrame, vectors: DataFrame) -> tuple[DataFrame, float]:
    active = members.join(clusters.filter("status = 'active'"), "cluster_id", "left_semi")
    kept = materialize(
        vectors.join(active.select(F.col("post_id").alias("id")), "id", "left_semi"), "active"
    )
    return kept, adaptive_radius(kept.count())


def cluster_labels(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster_id, label, label_posts): the most frequent label of a cluster's posts, ties to the smaller label."""
    counts = members.join(labels, "post_id").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    first = F.struct((-F.col("n")).alias("n"), "label")
    best = counts.groupBy("cluster_id").agg(F.min(first).alias("m"))
    return best.select("cluster_id", F.col("m.label").alias("label"), (-F.col("m.n")).alias("label_posts"))


def member_dedupe(members: DataFrame) -> DataFrame:
    """One row per (cluster, post): the earliest."""
    return (
        members.groupBy("cluster_id", "post_id")
        .agg(F.min_by(F.struct("joined_at", "similarity"), "joined_at").alias("m"))
        .select("cluster_id", "post_id", "m.joined_at", "m.similarity")
    )


def cluster_table(members: DataFrame, vectors: DataFrame, topics: DataFrame) -> DataFrame:
    """One row per cluster: size, times, centroid, topic."""
    times = members.groupBy("cluster_id").agg(
        F.count("*").alias("size"),
        F.min("joined_at").alias("created_at"),
        F.max("joined_at").alias("last_post_at"),
    )
    means = vo.centroids(members, vectors).drop("n")
    return vo.topic_match(times.join(means, "cluster_id", "left"), topics, "centroid")


def cluster_posts(members: DataFrame, posts: DataFrame, page_size: int = 1000) -> DataFrame:
    """Posts of each cluster in member order, nested in pages of ``page_size``.

    One array per cluster would grow with the cluster, so the list is paged.
    """
    rows = members.select("cluster_id", F.col("post_id").alias("id"), "joined_at").join(
        posts.select("id", "text", F.col("author_username").alias("author")), "id"
    )
    placed = running_count(rows, ["joined_at", "id"], ["cluster_id"])
    entry = F.struct("position", "id", "text", "author")
    return (
        placed.withColumn("page", F.floor((F.col("position") - 1) / page_size))
        .groupBy("cluster_id", "page")
        .agg(F.count("*").alias("size"), F.array_sort(F.collect_list(entry)).alias("posts"))
    )


