"""Source, sink and state queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline import schemas
from flockline.operators import alerts as al
from flockline.operators import reports as rp
from flockline.operators import text as to
from flockline.operators import windows as wi
from flockline.plans import sql as s
from flockline.plans.tables import EXPIRY_HOURS, THETA, Tables, big, stamp
from flockline.session import materialize, scratch_path
from flockline.sources import posts as ps
from flockline.sources import state as st


def _full_posts(t: Tables):
    """The posts in the full schema, list fields filled."""
    found = to.post_entities(t.posts).withColumn("post_id", F.col("id").cast("string"))
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.POSTS.fields])


def _flat(found):
    return found.select(
        "id",
        "text",
        "author_id",
        stamp("created_at").alias("created_at"),
        big("like_count").alias("like_count"),
        F.array_join("hashtags", ",").alias("hashtags"),
        F.array_join("mentions", ",").alias("mentions"),
    )


def read_posts(spark, path):
    """The subset projection of stored posts."""
    out = scratch_path(spark, "posts")
    ps.write_posts(_full_posts(Tables(spark, path)), out)
    found = ps.read_posts(spark, out, schemas.POSTS_SUBSET)
    return found.select("post_id", "text", "author_id", "author_username", stamp("created_at").alias("created_at"))


def write_posts(spark, path):
    """Every field after a round trip."""
    out = scratch_path(spark, "posts")
    ps.write_posts(_full_posts(Tables(spark, path)), out)
    return _flat(ps.read_posts(spark, out))


def ingest_posts(spark, path):
    """Conversation turns as raw posts: users only have a name, so other roles are rejected."""
    t = Tables(spark, path)
    raw = t.read("conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("post_id"),
        "text",
        F.col("conv_id").cast("string").alias("author_id"),
        F.when(F.col("role") == "user", F.concat(F.lit("user"), "conv_id")).alias("author_username"),
    )
    accepted, rejected = ps.ingest_posts(raw, wi.max_time(t.events, "ts"))

    def flat(df, outcome):
        return df.select(
            F.lit(outcome).alias("outcome"), "post_id", "text", stamp("created_at").alias("created_at"),
            big("like_count").alias("like_count"), big(F.size("hashtags")).alias("tags"),
        )

    return flat(accepted, "accepted").unionByName(flat(rejected, "rejected"))


def upsert_posts(spark, path):
    """Events per user: the newest event of a user replaces the older ones."""
    t = Tables(spark, path)
    rows = t.events.select(F.col("user_id").alias("id"), "event_type", "value", F.col("event_id").alias("seq"))
    old, new = rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'")
    return st.upsert(old, new)


def load_state(spark, path):
    t = Tables(spark, path)
    out = scratch_path(spark, "state")
    _full_posts(t).write.parquet(out)
    return _flat(st.load_state(spark, out))


def _snapshots(t: Tables, out: str) -> None:
    """Two snapshots of members and clusters: without signups, then whole."""
    first = t.members.filter(~F.col("cluster_id").endswith("-signup"))
    st.snapshot_state({"members": first, "clusters": first.select("cluster_id").distinct()}, out, 1)
    st.snapshot_state({"members": t.members, "clusters": t.members.select("cluster_id").distinct()}, out, 2)


def snapshot_state(spark, path):
    """Rows of each snapshot and table."""
    out = scratch_path(spark, "snapshots")
    _snapshots(Tables(spark, path), out)
    counts = [
        spark.read.parquet(f"{out}/{name}").groupBy("snapshot_ts").agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        for name in ("members", "clusters")
    ]
    return counts[0].unionByName(counts[1]).withColumn("snapshot_ts", big("snapshot_ts"))


def restore_latest(spark, path):
    out = scratch_path(spark, "snapshots")
    _snapshots(Tables(spark, path), out)
    found = st.restore_latest(spark, out, "members")
    return found.select("cluster_id", "post_id", stamp("joined_at").alias("joined_at"))


def restore_state(spark, path):
    """The six tables of the newest complete snapshot: an older one and a half-written one lie beside it."""
    t = Tables(spark, path)
    out = scratch_path(spark, "whole")
    statistics = rp.engine_stats(t.base, t.vectors)
    settings = {"similarity_threshold": THETA, "expiry_hours": EXPIRY_HOURS}
    whole = st.engine_state(t.clusters, t.members, t.posts, t.vectors, statistics, **settings)
    st.snapshot_state({"members": t.members.limit(1)}, out, 1)
    st.snapshot_state(whole, out, 2)
    t.members.limit(2).write.parquet(f"{out}/members/snapshot_ts=3")
    found = st.restore_state(spark, out)
    checks = {
        "clusters": F.sum("size"),
        "members": F.sum("post_id"),
        "posts": F.sum(F.length("text")),
        "vectors": F.sum(F.floor(F.element_at("embedding", 1).cast("double") * 1000)),
        "statistics": F.sum("vectors_stored"),
        "parameters": F.sum(F.floor(F.col("value").cast("double") * 1000)),
    }
    parts = [
        found[name].agg(big(F.count("*")).alias("n"), big(value).alias("checked")).withColumn("name", F.lit(name))
        for name, value in checks.items()
    ]
    rows = st.snapshot_manifest(spark, out).select("name", "rows")
    return reduce(DataFrame.unionByName, parts).join(rows, "name")


def purge_expired_posts(spark, path):
    t = Tables(spark, path)
    gone = t.clusters.filter(wi.is_expired(t.as_of, EXPIRY_HOURS))
    return st.purge_expired_posts(t.posts, t.members, gone).select("id", "text")


def append_alerts(spark, path):
    """Alerts written twice are stored once; old ones are left out when read."""
    t = Tables(spark, path)
    out = scratch_path(spark, "alerts")
    st.append_alerts(t.alerts, out)
    st.append_alerts(t.alerts, out)
    found = st.load_alerts(spark, out, t.as_of, 24)
    return found.select("alert_id", "fingerprint", stamp("alerted_at").alias("alerted_at"))


def alert_sink(spark, path):
    """Payloads of the candidate clusters, handed over once."""
    t = Tables(spark, path)
    ready = al.alert_candidates(t.clusters, topic_similarity=0.0)
    payload = al.alert_payload(ready, t.members, t.posts).withColumn("alert_id", F.concat(F.lit("alert_"), "cluster_id"))
    payload = materialize(payload, "payload")
    out = scratch_path(spark, "payloads")
    st.append_alerts(payload, out)
    st.append_alerts(payload, out)
    return spark.read.parquet(out).select("alert_id", "topic", "size_text", "period")


def save_load_minimal(spark, path):
    """The whole clustering saved and read back: clusters with their sizes."""
    out = scratch_path(spark, "minimal")
    t = Tables(spark, path)
    st.snapshot_state({"members": t.members}, out, 1)
    return st.restore_latest(spark, out, "members").groupBy("cluster_id").agg(F.count("*").alias("size"))


QUERIES = {f.__name__: f for f in (
    read_posts, write_posts, ingest_posts, upsert_posts, load_state, snapshot_state, restore_latest, restore_state,
    purge_expired_posts, append_alerts, alert_sink, save_load_minimal,
)}

_LISTS = (
    r"coalesce(array_to_string(list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: starts_with(w, '#')), lambda w: substr(w, 2)), ','), '') AS hashtags, "
    "coalesce(array_to_string(list_transform(regexp_extract_all(text, '@[A-Za-z0-9_]+'), lambda w: substr(w, 2)), ','), '') AS mentions"
)
_FLAT = s.query(
    [s.POSTS],
    f"SELECT id::VARCHAR AS id, text, author_id::VARCHAR AS author_id, {s.stamp('created_at')} AS created_at, like_count, {_LISTS} FROM posts",
)

ORACLES = {
    "read_posts": s.query(
        [s.POSTS],
        f"SELECT id::VARCHAR AS post_id, text, author_id::VARCHAR AS author_id, author_username, {s.stamp('created_at')} AS created_at FROM posts",
    ),
    "write_posts": _FLAT,
    "load_state": _FLAT,
    "ingest_posts": f"SELECT CASE WHEN role = 'user' AND text IS NOT NULL THEN 'accepted' ELSE 'rejected' END AS outcome, conv_id || '-' || turn AS post_id, text, "
    f"{s.stamp('(SELECT max(ts) FROM events)')} AS created_at, 0::BIGINT AS like_count, 0::BIGINT AS tags FROM conversations",
    "upsert_posts": "SELECT user_id AS id, event_type, value, event_id AS seq FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1",
    "snapshot_state": s.query(
        [s.VEC, s.MEM, "older AS (SELECT * FROM mem WHERE cluster_id NOT LIKE '%-signup')"],
        "SELECT 1::BIGINT AS snapshot_ts, 'members' AS name, count(*) AS n FROM older UNION ALL SELECT 1, 'clusters', count(DISTINCT cluster_id) FROM older "
        "UNION ALL SELECT 2, 'members', count(*) FROM mem UNION ALL SELECT 2, 'clusters', count(DISTINCT cluster_id) FROM mem",
    ),
    "restore_latest": s.query(
        [s.VEC, s.MEM], f"SELECT cluster_id, post_id, {s.stamp('joined_at')} AS joined_at FROM mem"
    ),
    "restore_state": s.query(
        [s.POSTS, *s.CLU],
        "SELECT *, n AS rows FROM (SELECT 'clusters' AS name, count(*) AS n, sum(size)::BIGINT AS checked FROM clusters "
        "UNION ALL SELECT 'members', count(*), sum(post_id)::BIGINT FROM mem "
        "UNION ALL SELECT 'posts', count(*), sum(length(text))::BIGINT FROM posts "
        "UNION ALL SELECT 'vectors', count(*), sum(floor(embedding[1]::DOUBLE * 1000))::BIGINT FROM embeddings JOIN events ON event_id = vec_id "
        "UNION ALL SELECT 'statistics', 1, count(*) FROM vec "
        f"UNION ALL SELECT 'parameters', 2, {int(THETA * 1000 + EXPIRY_HOURS * 1000)})",
    ),
    "purge_expired_posts": s.query(
        [s.POSTS, *s.CLU],
        "SELECT id, text FROM posts WHERE id NOT IN (SELECT post_id FROM mem JOIN clusters USING (cluster_id) WHERE status = 'expired')",
    ),
    "append_alerts": s.query(
        [*s.ALR, "newest AS (SELECT max(created_at) AS as_of FROM vec)"],
        f"SELECT alert_id, fingerprint, {s.stamp('alerted_at')} AS alerted_at FROM deduped, newest WHERE kept AND epoch_us(as_of) - epoch_us(deduped.alerted_at) <= 24 * 3600000000",
    ),
    "alert_sink": s.query(
        s.CLU,
        "SELECT 'alert_' || cluster_id AS alert_id, topic, size || ' posts' AS size_text, strftime(created_at, '%Y-%m-%d %H:%M') || ' - ' || strftime(last_post_at, '%Y-%m-%d %H:%M') AS period "
        "FROM clusters WHERE status = 'active' AND size >= 5 AND topic IS NOT NULL",
    ),
    "save_load_minimal": s.query([s.VEC, s.MEM], "SELECT cluster_id, count(*) AS size FROM mem GROUP BY 1"),
}
