"""Streaming queries: each runs a stream over everything available and returns its table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline.functions import vectors as vx
from flockline.operators.windows import running_count
from flockline.plans import sql as s
from flockline.plans import tables as tb
from flockline.plans.state import _full_posts
from flockline.plans.tables import DIM, Tables, big, r6, stamp
from flockline.session import discard, materialize, remove, scratch_path
from flockline.sources.posts import read_posts
from flockline.sources.posts import stream_posts as post_stream
from flockline.sources.posts import write_posts
from flockline.streaming import stages as sg
from flockline.streaming.engine import StreamEngine

THETA = 0.7
GATE_SIMILARITY = 0.05
_ALL_FILES = 1_000_000

# The loop gets the posts in five batches of about fourteen hours: a tenth of the posts come a
# batch late, two batches come a second time, and windows and clusters die on the way.
BATCHES, FILES = 5, 4
FILE_POSTS, MAX_FILES = 50_000, 400  # above so many posts in all, batches have more files
LOOP = {
    "threshold": THETA,
    "min_size": 2,
    "topic_similarity": GATE_SIMILARITY,
    "duplicate_similarity": tb.ALERT_SIMILARITY,
    "cooldown_hours": 20,
    "expiry_hours": 24,
    "window_hours": 28,
    "slide_hours": 9,
    "quality_every": 100,
    "refit_every": 250,
}


_ENGINES: dict[tuple[str, str], StreamEngine] = {}


def _stream(t: Tables, files_per_trigger: int = _ALL_FILES, copies: int = 1):
    """The posts as a stream of files; further ``copies`` are made from the files of the first, not from the tables again."""
    out = scratch_path(t.spark, "incoming")
    write_posts(_full_posts(t), out, compression="gzip")
    if copies > 1:
        first = read_posts(t.spark, out)  # the files there are now
        for _ in range(copies - 1):
            write_posts(first, out, mode="append", compression="gzip")
    return post_stream(t.spark, out, files_per_trigger=files_per_trigger)


def stream_posts(spark, path):
    found = sg.run_to_table(_stream(Tables(spark, path), files_per_trigger=2))
    return found.select("id", "text", stamp("created_at").alias("created_at"))


def stream_prepare(spark, path):
    found = sg.run_to_table(sg.stream_prepare(_stream(Tables(spark, path))))
    return found.select("id", "cleaned_text")


def stream_window_counts(spark, path):
    found = sg.run_to_table(sg.stream_window_counts(_stream(Tables(spark, path)), 6))
    return found.select(stamp("window_start").alias("window_start"), stamp("window_end").alias("window_end"), "posts")


def _files(n: int) -> int:
    """Files of a batch: a few for a few posts, more as there are more, since each is one task."""
    return min(MAX_FILES, FILES * max(1, n // FILE_POSTS))


def _cuts(stored: DataFrame, n: int) -> list[tuple]:
    """The first row of each batch but the first, in the order of arrival; ``row`` orders equal times and ids."""
    order = ["created_at", "id", "row"]
    places = [-(-k * n // BATCHES) + 1 for k in range(1, BATCHES)]
    placed = running_count(stored.select(*order), order).filter(F.col("position").isin(places))
    return [tuple(r) for r in placed.orderBy("position").select(F.unix_micros("created_at"), "id", "row", "position").collect()]


def _arrivals(t: Tables, out: str) -> int:
    """The batches as files, one after the other; how many files each has.

    Texts do not take part in the ordering: a post finds its batch by the first rows of the batches.
    """
    stored = materialize(_full_posts(t).withColumn("row", F.monotonically_increasing_id()), "posts")
    n = stored.count()
    own = F.struct(F.unix_micros("created_at").alias("t"), F.col("id").alias("i"), F.col("row").alias("r"))
    batch = F.lit(0)
    for cut in _cuts(stored, n):
        first = F.struct(*[F.lit(x).cast(kind).alias(c) for x, kind, c in zip(cut, ("bigint", "string", "bigint"), "tir")])
        steps = sum(-(-k * n // BATCHES) + 1 == cut[3] for k in range(1, BATCHES))  # of fewer posts than batches
        batch = batch + F.when(own >= first, steps).otherwise(0)
    due = F.least(batch + F.when(F.col("id").cast("long") % 10 == 3, 1).otherwise(0), F.lit(BATCHES - 1))
    arranged, folder = stored.withColumn("due", due).drop("row"), scratch_path(t.spark, "arrivals")
    arranged.write.partitionBy("due").parquet(folder)  # a batch reads its own part
    posts = t.spark.read.schema(arranged.schema).parquet(folder)
    discard(stored)
    again = {3: 2, 4: 0}  # batch 3 brings batch 2 once more, batch 4 brings batch 0
    files = _files(n)
    for k in range(BATCHES):
        batch = posts.filter(F.col("due").isin([k, again.get(k, k)])).drop("due")
        write_posts(batch.repartition(files), out, mode="append")
    remove(t.spark, folder)
    return files


def _run_engine(spark, path) -> StreamEngine:
    """The loop over all batches; one run serves all queries of a session that look at its tables."""
    key = spark.sparkContext.applicationId, path
    if key not in _ENGINES:
        _ENGINES[key] = _loop(spark, path)
    return _ENGINES[key]


def _loop(spark, path) -> StreamEngine:
    t = Tables(spark, path)
    incoming = scratch_path(spark, "incoming")
    folder, topics = scratch_path(spark, "engine"), t.topics
    with ThreadPoolExecutor(1) as pool:  # topics are embedded, by the first Python workers to start, while posts are laid out
        made = pool.submit(inheritable_thread_target(spark)(lambda: StreamEngine(spark, folder, topics, dim=DIM, **LOOP)))
        files = _arrivals(t, incoming)
    engine = made.result()
    engine.start(post_stream(spark, incoming, files_per_trigger=files), availableNow=True).awaitTermination()
    remove(spark, incoming)
    return engine


def stream_assign(spark, path):
    """Every post once, with its batch, window and cluster."""
    found = _run_engine(spark, path).members()
    return found.select(
        big("version").alias("batch"), "cluster_id", "post_id", "window_id", r6("similarity").alias("similarity"), big("leads").alias("leads")
    )


def stream_expiry(spark, path):
    """Clusters with their fates."""
    found = _run_engine(spark, path).clusters()
    return found.select("cluster_id", "n", stamp("created_at").alias("created_at"), stamp("last_post_at").alias("last_post_at"), "status")


def stream_retract(spark, path):
    """Which clusters each batch ended, and why; of those that live at the end, what their windows hold and where their centroid is."""
    engine = _run_engine(spark, path)
    ended = engine.expired().select(
        F.col("version").cast("bigint").alias("batch"), "cluster_id", "n", "cause", F.lit(0).cast("bigint").alias("windows"), F.lit(0.0).alias("centroid")
    )
    parts = engine.parts()
    whole = engine._whole(parts).join(parts.groupBy("cluster_id").agg(F.count("*").alias("windows")), "cluster_id")
    weights = F.aggregate(F.transform(vx.normalize(F.col("linear_sum")), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    live = whole.select(
        F.lit(BATCHES).cast("bigint").alias("batch"), "cluster_id", "n", F.lit("alive").alias("cause"), "windows", r6(F.round(weights, 6)).alias("centroid")
    )
    return ended.unionByName(live)


def stream_alerts(spark, path):
    """Alerts of all batches."""
    found = _run_engine(spark, path)._log("alerts")
    return found.select(
        big("version").alias("batch"), "alert_id", "cluster_id", "topic", F.array_join("keywords", ",").alias("keywords"), "fingerprint", "post_count"
    )


def stream_outbox(spark, path):
    """The payload of every alert, once."""
    found = _run_engine(spark, path).outbox()
    return found.select("alert_id", "cluster_id", "topic", "size_text", "engagement_text", "period", big(F.size("posts")).alias("previews"))


def stream_batches(spark, path):
    """Counters of every batch, observed while its tables were written."""
    names = ["batch_id", "processed", "meaningful", "late", "repeated", "clustered", "new_clusters", "expired", "alerts", "held_back"]
    return _run_engine(spark, path).batches().select(*names, stamp("as_of").alias("as_of"))


def stream_quality(spark, path):
    """Checks of the live clusters, one for each batch that passes another hundred posts."""
    found = _run_engine(spark, path).quality()
    return found.select(big("version").alias("batch"), "processed", "clusters", "low_clusters", r6("average_coherence").alias("average_coherence"))


def stream_refits(spark, path):
    """New fits of the live posts: all get a label, alike ones the same, and no micro cluster is too wide."""
    engine = _run_engine(spark, path)
    found = engine.refits()
    newest = found.agg(F.max("version")).head()[0]
    labelled = engine.labels().agg(F.countDistinct("post_id").alias("labelled"), F.countDistinct("label").alias("given"))
    last = found.filter(F.col("version") == newest).crossJoin(F.broadcast(labelled))  # one row each
    checked = last.select("version", "labelled", (F.col("given") == F.col("labels")).alias("agree"))
    return found.join(checked, "version", "left").select(
        big("version").alias("batch"), "processed", "posts", r6("radius").alias("radius"),
        big(F.col("widest") > F.col("radius") + 1e-6).alias("too_wide"), big(F.col("labels") < F.col("posts")).alias("merged"),
        "labelled", big("agree").alias("agree"),
    )


def keyed_cooldown(spark, path):
    t = Tables(spark, path)
    out = scratch_path(spark, "drafts")
    t.drafts.select("fingerprint", "alert_id", "alerted_at").write.parquet(out)
    incoming = spark.readStream.schema("fingerprint string, alert_id string, alerted_at timestamp").parquet(out)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, sg.ROCKSDB)
    try:
        found = sg.run_to_table(sg.keyed_cooldown(incoming, tb.ALERT_COOLDOWN_HOURS))
    finally:
        spark.conf.set(name, before)
    return found.select("fingerprint", "alert_id", big("kept").alias("kept"))


def stream_dedupe(spark, path):
    found = sg.run_to_table(sg.stream_dedupe(_stream(Tables(spark, path), copies=2)))
    return found.select("id", "text")


def stream_stats(spark, path):
    prepared = sg.prepare_posts(_stream(Tables(spark, path), files_per_trigger=2))
    found = sg.stream_stats(prepared)
    return found.agg(big(F.sum("processed")).alias("processed"), big(F.sum("meaningful")).alias("meaningful"))


QUERIES = {f.__name__: f for f in (
    stream_posts, stream_prepare, stream_window_counts, stream_assign, stream_expiry, stream_alerts,
    stream_retract, stream_outbox, stream_batches, stream_quality, stream_refits, keyed_cooldown, stream_dedupe, stream_stats,
)}

# Post vectors as the stream engine sees them, and its rules replayed batch by batch.
_POST_VEC = f"""{s.embedded("prepared", "emb", "id", "cleaned_text")},
vec AS MATERIALIZED (SELECT id, list(coalesce(x, 0.0) ORDER BY d.i) AS u, any_value(created_at) AS created_at,
    any_value(epoch_us(created_at)) // {LOOP["slide_hours"] * 3_600_000_000} AS w
  FROM (SELECT p.id, p.created_at, d.i FROM prepared p, generate_series(0,{DIM - 1}) d(i) WHERE p.is_meaningful AND p.id IN (SELECT id FROM emb)) d
  LEFT JOIN emb USING (id, i) GROUP BY id)"""
_ARRIVE = f"""due AS MATERIALIZED (SELECT id, least({BATCHES - 1}, {BATCHES} * (row_number() OVER (ORDER BY created_at, id::VARCHAR) - 1) // count(*) OVER ()
    + CASE WHEN id % 10 = 3 THEN 1 ELSE 0 END) AS b FROM posts),
arr AS MATERIALIZED (SELECT id, b FROM due UNION ALL SELECT id, 3 FROM due WHERE b = 2 UNION ALL SELECT id, 4 FROM due WHERE b = 0)"""
_FIRST = """mem AS (SELECT '' AS cluster_id, 0::BIGINT AS post_id, 0::BIGINT AS w, NULL::TIMESTAMP AS joined_at, []::DOUBLE[] AS u,
  NULL::TIMESTAMP AS last, NULL::TIMESTAMP AS born WHERE false),
acc AS (SELECT 0::BIGINT AS post_id WHERE false),
alerts AS (SELECT '' AS alert_id, '' AS cluster_id, '' AS fingerprint, []::DOUBLE[] AS u, NULL::TIMESTAMP AS alerted_at WHERE false)"""


def _leads(out: str, nodes: str, links: str) -> str:
    """The first independent set of ``nodes`` (k) under ``links`` (i before j), row by row."""
    return f"""{out}_a AS MATERIALIZED (SELECT n.k, coalesce(list(l.i) FILTER (l.i IS NOT NULL), []) AS nb FROM {nodes} n LEFT JOIN {links} l ON l.j = n.k GROUP BY n.k),
{out}_s(k, chosen) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT a.k, CASE WHEN list_has_any(a.nb, s.chosen) THEN s.chosen ELSE list_append(s.chosen, a.k) END FROM {out}_s s JOIN {out}_a a ON a.k = s.k + 1),
{out} AS MATERIALIZED (SELECT unnest(chosen) AS k FROM (SELECT chosen FROM {out}_s ORDER BY k DESC LIMIT 1))"""


def _replayed(b: int) -> str:
    """Batch ``b``: windows leave, new posts are placed, clusters expire, alerts are raised."""
    p = "" if b == 0 else str(b - 1)
    hours = {k: v * 3_600_000_000 for k, v in LOOP.items() if k.endswith("_hours")}
    small = LOOP["min_size"]
    return f"""asof{b} AS MATERIALIZED (SELECT max(created_at) AS t FROM arr JOIN posts USING (id) WHERE b <= {b}),
lo{b} AS MATERIALIZED (SELECT ceil((epoch_us(t) - {hours["window_hours"]})::DOUBLE / {hours["slide_hours"]})::BIGINT AS lo FROM asof{b}),
left{b} AS MATERIALIZED (SELECT m.*, m.w >= lo AS stays FROM mem{p} m, lo{b}),
dead{b} AS MATERIALIZED (SELECT cluster_id, count(*) FILTER (stays) AS n, min(born) AS born, max(last) AS last FROM left{b} GROUP BY 1
  HAVING count(*) FILTER (stays) < count(*) AND count(*) FILTER (stays) < {small}),
base{b} AS MATERIALIZED (SELECT * EXCLUDE (stays) FROM left{b} WHERE stays AND cluster_id NOT IN (SELECT cluster_id FROM dead{b})),
{s.mean(f"base{b}", f"cen{b}")},
in{b} AS MATERIALIZED (SELECT v.* FROM vec v, lo{b} WHERE w >= lo AND id IN (SELECT id FROM arr WHERE b = {b}) AND id NOT IN (SELECT post_id FROM acc{p})),
near{b} AS MATERIALIZED (SELECT id, cluster_id, s FROM (SELECT i.id, c.cluster_id, round(list_dot_product(i.u, c.c), 6) AS s,
  row_number() OVER (PARTITION BY i.id ORDER BY round(list_dot_product(i.u, c.c), 6) DESC, c.cluster_id) AS r FROM in{b} i, cen{b} c) WHERE r = 1 AND s >= {THETA}),
fresh{b} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY created_at, id::VARCHAR) AS k FROM in{b} WHERE id NOT IN (SELECT id FROM near{b})),
pair{b} AS MATERIALIZED (SELECT f.id AS lid, f.k AS i, x.id, y.k AS j, round(list_dot_product(f.u, x.u), 6) AS s FROM fresh{b} f
  JOIN in{b} x ON f.created_at < x.created_at OR (f.created_at = x.created_at AND f.id::VARCHAR < x.id::VARCHAR)
  LEFT JOIN fresh{b} y ON y.id = x.id WHERE round(list_dot_product(f.u, x.u), 6) >= {THETA}),
{_leads(f"lead{b}", f"fresh{b}", f"pair{b}")},
new{b} AS (SELECT id, lid, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, i) AS r FROM pair{b} WHERE i IN (SELECT k FROM lead{b})) WHERE r = 1),
placed{b} AS MATERIALIZED (SELECT i.id AS post_id, i.w, i.created_at AS joined_at, i.u, f.id IS NOT NULL AS leads,
    CASE WHEN f.id IS NOT NULL THEN i.id::VARCHAR WHEN o.s >= coalesce(n.s, -9) THEN o.cluster_id ELSE n.lid::VARCHAR END AS cluster_id,
    CASE WHEN f.id IS NOT NULL THEN 1.0 WHEN o.s >= coalesce(n.s, -9) THEN o.s ELSE n.s END AS similarity
  FROM in{b} i LEFT JOIN (SELECT id FROM fresh{b} JOIN lead{b} USING (k)) f ON f.id = i.id LEFT JOIN near{b} o ON o.id = i.id LEFT JOIN new{b} n ON n.id = i.id),
raw{b} AS (SELECT cluster_id, post_id, w, joined_at, u, last, born FROM base{b} UNION ALL SELECT cluster_id, post_id, w, joined_at, u, joined_at, joined_at FROM placed{b}),
grp{b} AS MATERIALIZED (SELECT cluster_id, count(*) AS n, max(last) AS last, min(born) AS born, any_value(epoch_us(t)) - epoch_us(max(last)) > {hours["expiry_hours"]} AS old
  FROM raw{b}, asof{b} GROUP BY 1),
mem{b} AS MATERIALIZED (SELECT r.* REPLACE (g.last AS last, g.born AS born) FROM raw{b} r JOIN grp{b} g USING (cluster_id) WHERE NOT old),
acc{b} AS MATERIALIZED (SELECT post_id FROM acc{p} UNION ALL SELECT post_id FROM placed{b}),
exp{b} AS MATERIALIZED (SELECT cluster_id, n, born, last, 'window' AS cause FROM dead{b} UNION ALL SELECT cluster_id, n, born, last, 'age' FROM grp{b} WHERE old),
{s.mean(f"mem{b}", f"pc{b}")},
{s.matched(f"pc{b}", f"pt{b}", "cluster_id", "c")},
tok{b} AS (SELECT cluster_id, joined_at, post_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM
  (SELECT m.cluster_id, m.joined_at, m.post_id::VARCHAR AS post_id, list_filter(string_split(p.cleaned_text, ' '), lambda x: x <> '') AS ws
   FROM mem{b} m JOIN prepared p ON p.id = m.post_id)),
pw{b} AS (SELECT cluster_id, word, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(row(joined_at, post_id, pos))) AS r
  FROM tok{b} WHERE length(word) > 3 AND regexp_full_match(word, '\\p{{L}}+') GROUP BY 1, 2),
pk{b} AS (SELECT cluster_id, list(word ORDER BY r) AS keywords FROM pw{b} WHERE r <= 5 GROUP BY 1),
ready{b} AS (SELECT 'alert_' || cluster_id || '_' || epoch_us(t) // 1000000 AS alert_id, cluster_id, n, g.born, g.last, topic, topic_similarity, coalesce(keywords, []) AS keywords,
    substr(md5(topic || ':' || coalesce(array_to_string(list_sort(keywords), ':'), '')), 1, 12) AS fingerprint, c AS u, t AS alerted_at
  FROM grp{b} g JOIN pc{b} USING (cluster_id) JOIN pt{b} USING (cluster_id) LEFT JOIN pk{b} USING (cluster_id), asof{b}
  WHERE NOT old AND n >= {small} AND topic IS NOT NULL AND topic_similarity >= {GATE_SIMILARITY} AND cluster_id NOT IN (SELECT cluster_id FROM alerts{p})),
held{b} AS MATERIALIZED (SELECT DISTINCT r.alert_id FROM ready{b} r JOIN alerts{p} a ON epoch_us(r.alerted_at) - epoch_us(a.alerted_at) <= {hours["cooldown_hours"]}
  AND (a.fingerprint = r.fingerprint OR round(list_dot_product(a.u, r.u), 6) > {tb.ALERT_SIMILARITY})),
open{b} AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY alert_id) AS k FROM ready{b} WHERE alert_id NOT IN (SELECT alert_id FROM held{b})),
alike{b} AS MATERIALIZED (SELECT a.k AS i, c.k AS j FROM open{b} a JOIN open{b} c ON a.k < c.k
  WHERE a.fingerprint = c.fingerprint OR round(list_dot_product(a.u, c.u), 6) > {tb.ALERT_SIMILARITY}),
{_leads(f"keep{b}", f"open{b}", f"alike{b}")},
kept{b} AS MATERIALIZED (SELECT o.* FROM open{b} o JOIN keep{b} USING (k)),
alerts{b} AS MATERIALIZED (SELECT * FROM alerts{p} UNION ALL SELECT alert_id, cluster_id, fingerprint, u, alerted_at FROM kept{b})"""


_LOOP = [*s.PRE, s.TOPICS, _POST_VEC, _ARRIVE, _FIRST, *[_replayed(b) for b in range(BATCHES)]]


def _every(select: str) -> str:
    """A select over each batch, ``#`` for its number."""
    return " UNION ALL ".join(select.replace("#", str(b)) for b in range(BATCHES))


_LAST = BATCHES - 1
_COOL = f"""ord AS MATERIALIZED (SELECT fingerprint, alert_id, alerted_at, row_number() OVER (PARTITION BY fingerprint ORDER BY alerted_at, alert_id) AS n FROM drafts),
cool(fingerprint, n, alert_id, last_at, kept) AS (SELECT fingerprint, n, alert_id, alerted_at, 1::BIGINT FROM ord WHERE n = 1 UNION ALL
  SELECT o.fingerprint, o.n, o.alert_id, CASE WHEN o.alerted_at - c.last_at > INTERVAL {tb.ALERT_COOLDOWN_HOURS} HOUR THEN o.alerted_at ELSE c.last_at END,
    CASE WHEN o.alerted_at - c.last_at > INTERVAL {tb.ALERT_COOLDOWN_HOURS} HOUR THEN 1 ELSE 0 END
  FROM cool c JOIN ord o ON o.fingerprint = c.fingerprint AND o.n = c.n + 1)"""

ORACLES = {
    "stream_posts": s.query(
        [s.POSTS], f"SELECT id::VARCHAR AS id, text, {s.stamp('created_at')} AS created_at FROM posts"
    ),
    "stream_prepare": s.query(s.PRE, "SELECT id::VARCHAR AS id, cleaned_text FROM prepared WHERE is_meaningful"),
    "stream_window_counts": s.query(
        [
            s.POSTS,
            "w AS (SELECT time_bucket(INTERVAL 6 HOUR, created_at, TIMESTAMP '1970-01-01') AS ws, count(*) AS posts FROM posts GROUP BY 1)",
        ],
        f"SELECT {s.stamp('ws')} AS window_start, {s.stamp('ws + INTERVAL 6 HOUR')} AS window_end, posts FROM w "
        "WHERE ws + INTERVAL 6 HOUR <= (SELECT max(created_at) FROM posts) - INTERVAL 1 HOUR",
    ),
    "stream_assign": s.query(
        _LOOP,
        _every(
            f"SELECT #::BIGINT AS batch, cluster_id, post_id::VARCHAR AS post_id, w AS window_id, {s.r6('similarity')} AS similarity, leads::BIGINT AS leads FROM placed#"
        ),
    ),
    "stream_expiry": s.query(
        _LOOP,
        f"SELECT cluster_id, n, {s.stamp('born')} AS created_at, {s.stamp('last')} AS last_post_at, status FROM (SELECT *, 'active' AS status FROM grp{_LAST} WHERE NOT old "
        f"UNION ALL BY NAME SELECT *, 'expired' AS status FROM ({_every('SELECT cluster_id, n, born, last FROM exp#')}))",
    ),
    "stream_retract": s.query(
        _LOOP,
        _every("SELECT #::BIGINT AS batch, cluster_id, n, cause, 0::BIGINT AS windows, 0.0::DOUBLE AS centroid FROM exp#")
        + f" UNION ALL SELECT {BATCHES}::BIGINT, cluster_id, g.n, 'alive', windows, {s.r6('(SELECT sum(x * i) FROM (SELECT unnest(c) AS x, generate_subscripts(c, 1) AS i))')} "
        f"FROM grp{_LAST} g JOIN pc{_LAST} USING (cluster_id) JOIN (SELECT cluster_id, count(DISTINCT w) AS windows FROM mem{_LAST} GROUP BY 1) USING (cluster_id) WHERE NOT old",
    ),
    "stream_alerts": s.query(
        _LOOP,
        _every("SELECT #::BIGINT AS batch, alert_id, cluster_id, topic, coalesce(array_to_string(keywords, ','), '') AS keywords, fingerprint, n AS post_count FROM kept#"),
    ),
    "stream_outbox": s.query(
        _LOOP,
        _every(
            "SELECT alert_id, cluster_id, topic, n || ' posts' AS size_text, format('{:,}', e) || ' interactions' AS engagement_text, "
            "strftime(k.born, '%Y-%m-%d %H:%M') || ' - ' || strftime(k.last, '%Y-%m-%d %H:%M') AS period, least(n, 3)::BIGINT AS previews FROM kept# k "
            "JOIN (SELECT cluster_id, sum(like_count + retweet_count + reply_count)::BIGINT AS e FROM mem# m JOIN posts ON posts.id = m.post_id GROUP BY 1) USING (cluster_id)"
        ),
    ),
    "stream_batches": s.query(
        _LOOP,
        _every(
            "SELECT #::BIGINT AS batch_id, (SELECT count(*) FROM arr WHERE b = #) AS processed, (SELECT count(*) FROM arr JOIN vec USING (id) WHERE b = #) AS meaningful, "
            "(SELECT count(*) FROM arr JOIN vec USING (id), lo# WHERE b = # AND w < lo) AS late, "
            "(SELECT count(*) FROM arr JOIN vec USING (id), lo# WHERE b = # AND w >= lo) - (SELECT count(*) FROM placed#) AS repeated, "
            "(SELECT count(*) FROM placed# WHERE NOT leads) AS clustered, (SELECT count(*) FROM placed# WHERE leads) AS new_clusters, (SELECT count(*) FROM exp#) AS expired, "
            "(SELECT count(*) FROM kept#) AS alerts, (SELECT count(*) FROM ready#) - (SELECT count(*) FROM kept#) AS held_back, "
            f"{s.stamp('(SELECT t FROM asof#)')} AS as_of"
        ),
    ),
    "stream_quality": s.query(
        _LOOP,
        _every(
            f"SELECT batch, processed, count(*) FILTER (n IS NOT NULL) AS clusters, count(*) FILTER (coherence < 0.6) AS low_clusters, {s.r6('avg(coherence)')} AS average_coherence FROM "
            "(SELECT #::BIGINT AS batch, (SELECT count(*) FROM arr WHERE b <= #) AS processed, (SELECT count(*) FROM arr WHERE b < #) AS before) LEFT JOIN "
            "(SELECT a.cluster_id, 1 AS n, avg(list_dot_product(a.u, c.u)) AS coherence FROM mem# a JOIN mem# c ON a.cluster_id = c.cluster_id AND a.post_id < c.post_id GROUP BY 1) ON true "
            "WHERE processed // 100 > before // 100 GROUP BY 1, 2"
        ),
    ),
    "stream_refits": s.query(
        _LOOP,
        "SELECT batch, processed, posts, radius, too_wide, merged, CASE WHEN batch = max(batch) OVER () THEN posts END AS labelled, "
        "CASE WHEN batch = max(batch) OVER () THEN 1::BIGINT END AS agree FROM ("
        + _every(
            f"SELECT batch, processed, posts, {s.r6('greatest(0.2, 0.5 - posts / 10000)')} AS radius, 0::BIGINT AS too_wide, "
            "(EXISTS (SELECT 1 FROM mem# a JOIN mem# c ON a.post_id < c.post_id WHERE 2 - 2 * list_dot_product(a.u, c.u) <= pow(greatest(0.2, 0.5 - posts / 10000), 2)))::BIGINT AS merged FROM "
            "(SELECT #::BIGINT AS batch, (SELECT count(*) FROM arr WHERE b <= #) AS processed, (SELECT count(*) FROM arr WHERE b < #) AS before, (SELECT count(*) FROM mem#) AS posts) "
            f"WHERE processed // {LOOP['refit_every']} > before // {LOOP['refit_every']} AND posts > 100"
        )
        + ")",
    ),
    "keyed_cooldown": s.query([s.VEC, s.DRAFTS, _COOL], "SELECT fingerprint, alert_id, kept FROM cool"),
    "stream_dedupe": s.query([s.POSTS], "SELECT id::VARCHAR AS id, text FROM posts"),
    "stream_stats": s.query(
        s.PRE, "SELECT count(*) AS processed, count(*) FILTER (is_meaningful) AS meaningful FROM prepared"
    ),
}
