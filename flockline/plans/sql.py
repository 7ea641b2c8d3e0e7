"""Fragments of the SQL counterparts. Each constant is a list of CTEs."""

from __future__ import annotations

from flockline.functions import constants as K
from flockline.plans import tables as t


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listing(words: list[str]) -> str:
    return "[" + ",".join(quote(w) for w in words) + "]"


def r6(x: str) -> str:
    return f"CASE WHEN round({x},6)=0 THEN 0.0::DOUBLE ELSE round({x},6) END"


def stamp(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"


STOP = listing(K.STOP_WORDS)


def clean(expr: str, out: str) -> str:
    """Select items that end in the cleaned text ``out``."""
    s = f"lower(coalesce({expr},''))"
    for pattern, by in [
        (K.URL_PATTERN, ""),
        (K.WWW_PATTERN, ""),
        (K.MENTION_PATTERN, ""),
        (K.HASHTAG_PATTERN, r"\1"),
        (r"\s+", " "),
    ]:
        s = f"regexp_replace({s}, {quote(pattern)}, {quote(by)}, 'g')"
    flat, emo = f"{out}_u", f"{out}_e"
    body = (
        f"translate({flat}, {quote(K.PUNCTUATION)}, '') || ' ' || coalesce(array_to_string({emo}, ' '), '')"
    )
    return (
        f"{s} AS {flat}, regexp_extract_all({flat}, {quote(K.EMOTICON_PATTERN)}) AS {emo}, "
        rf"trim(regexp_replace(regexp_replace({body}, '\d+', '', 'g'), '\s+', ' ', 'g')) AS {out}"
    )


def content(expr: str) -> str:
    return (
        f"list_filter(string_split({expr}, ' '), lambda w: w <> '' AND NOT list_contains({STOP}, w))"
    )


POSTS = """posts AS MATERIALIZED (SELECT d.doc_id AS id,
  concat(d.text,' #',e.event_type,
    CASE WHEN d.doc_id%7=0  THEN concat(' https://x.co/a_',d.doc_id,'?q=1') ELSE '' END,
    CASE WHEN d.doc_id%5=0  THEN concat(' @user',e.user_id) ELSE '' END,
    CASE WHEN d.doc_id%11=0 THEN ' :) top-notch' ELSE '' END) AS text,
  e.user_id AS author_id, concat('user',e.user_id) AS author_username, e.ts AS created_at,
  CAST(floor(e.value) AS BIGINT) AS like_count, CAST(floor(e.value/3) AS BIGINT) AS retweet_count,
  CAST(floor(e.value/5) AS BIGINT) AS reply_count, CAST(floor(e.value/6) AS BIGINT) AS quote_count,
  d.source AS source
FROM documents d JOIN events e ON e.event_id = d.doc_id)"""

CLEANED = f"cleaned AS (SELECT *, {clean('text', 'cl')} FROM posts)"
PREPARED = (
    f"prepared0 AS (SELECT *, array_to_string({content('cl')}, ' ') AS cleaned_text FROM cleaned),\n"
    f"prepared1 AS (SELECT *, {clean('cleaned_text', 'c2')} FROM prepared0),\n"
    f"prepared AS MATERIALIZED (SELECT *, len(list_filter({content('c2')}, lambda w: length(w) >= 3)) >= 2 "
    f"AS is_meaningful FROM prepared1)"
)
VEC = """vec0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label, e.ts AS created_at, e.event_type
  FROM embeddings JOIN events e ON e.event_id = vec_id),
vec AS MATERIALIZED (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v,v))) AS u FROM vec0)"""
MEM = """mem AS MATERIALIZED (SELECT 'c' || label || '-' || event_type AS cluster_id, id AS post_id,
  created_at AS joined_at, u FROM vec)"""


def mean(source: str, out: str, key: str = "cluster_id") -> str:
    """Normalised mean of ``u`` per key, as list ``c``."""
    return f"""{out}_d AS (SELECT {key}, d.i, avg(u[d.i]) AS a FROM {source}, generate_series(1,{t.DIM}) d(i)
  GROUP BY {key}, d.i),
{out}_r AS (SELECT {key}, list(a ORDER BY i) AS r FROM {out}_d GROUP BY {key}),
{out} AS MATERIALIZED (SELECT {key}, list_transform(r, lambda x: x / sqrt(list_dot_product(r,r))) AS c FROM {out}_r)"""


CEN = mean("mem", "cen")


def embedded(source: str, out: str, key: str, text: str, dim: int = t.DIM) -> str:
    """(key, i, x): the non-zero entries of the hashed unit vectors of ``text``."""
    return f"""{out}_w AS (SELECT {key}, unnest(list_filter(string_split({text}, ' '), lambda w: w <> '')) AS w FROM {source}),
{out}_s AS (SELECT {key}, ('0x' || substr(md5(w),1,8))::BIGINT % {2 * dim} AS m FROM {out}_w),
{out}_c AS (SELECT {key}, m % {dim} AS i, sum(CASE WHEN m < {dim} THEN 1 ELSE -1 END)::DOUBLE AS n FROM {out}_s GROUP BY 1, 2),
{out}_n AS (SELECT {key}, sqrt(sum(n*n)) AS size FROM {out}_c GROUP BY 1),
{out} AS MATERIALIZED (SELECT {key}, i, n / size AS x FROM {out}_c JOIN {out}_n USING ({key}) WHERE n <> 0)"""


_TOPIC_ROWS = ", ".join(
    f"({i}, {quote(title)}, {quote(title + ' ' + text)})" for i, (title, text) in enumerate(K.TOPICS_OF_INTEREST)
)
TOPICS = f"""topic_text AS (SELECT *, {clean('txt', 'cl')} FROM (VALUES {_TOPIC_ROWS}) v(ord, title, txt)),
{embedded("topic_text", "te", "ord", "cl")},
topics AS MATERIALIZED (SELECT ord, title, list(coalesce(x, 0.0) ORDER BY d.i) AS tv
  FROM topic_text CROSS JOIN generate_series(0,{t.DIM - 1}) d(i) LEFT JOIN te USING (ord, i) GROUP BY ord, title)"""


def matched(source: str, out: str, key: str, vector: str) -> str:
    """Best topic per key: (key, topic, topic_similarity)."""
    return f"""{out}_a AS (SELECT {key}, title, list_dot_product({vector}, tv) AS s,
  row_number() OVER (PARTITION BY {key} ORDER BY list_dot_product({vector}, tv) DESC, ord) AS r FROM {source}, topics),
{out} AS (SELECT {key}, CASE WHEN s > 0 THEN title END AS topic, CASE WHEN s > 0 THEN s ELSE 0.0 END AS topic_similarity
  FROM {out}_a WHERE r = 1)"""


CLUSTERS = f"""{matched("cen", "tm", "cluster_id", "c")},
times AS (SELECT cluster_id, count(*) AS size, min(joined_at) AS created_at, max(joined_at) AS last_post_at
  FROM mem GROUP BY 1),
newest AS (SELECT max(created_at) AS as_of FROM vec),
clusters AS MATERIALIZED (SELECT cluster_id, size, created_at, last_post_at, c AS centroid, topic, topic_similarity,
  cluster_id LIKE '%-error' AS alert_sent,
  CASE WHEN as_of - last_post_at > INTERVAL {t.EXPIRY_HOURS} HOUR THEN 'expired'
       WHEN cluster_id LIKE '%-error' THEN 'alerted' ELSE 'active' END AS status
  FROM times JOIN cen USING (cluster_id) JOIN tm USING (cluster_id), newest)"""
COHERENCE = """coh0 AS (SELECT a.cluster_id, list_dot_product(a.u, b.u) AS s
  FROM mem a JOIN mem b ON a.cluster_id = b.cluster_id AND a.post_id < b.post_id),
coh AS MATERIALIZED (SELECT m.cluster_id, CASE WHEN m.n < 2 THEN 1.0 ELSE coalesce(p.a, 0.0) END AS coherence
  FROM (SELECT cluster_id, count(*) AS n FROM mem GROUP BY 1) m
  LEFT JOIN (SELECT cluster_id, avg(s) AS a FROM coh0 WHERE round(s,6) > 0 GROUP BY 1) p USING (cluster_id))"""
BASE = "base AS MATERIALIZED (SELECT * FROM clusters JOIN coh USING (cluster_id))"

# Leaders of all vectors in arrival order, replayed row by row.
LEADERS = f"""ordered AS MATERIALIZED (SELECT id, u, created_at, row_number() OVER (ORDER BY created_at, id) AS k FROM vec),
pr AS MATERIALIZED (SELECT a.k AS i, b.k AS j, round(list_dot_product(a.u,b.u),6) AS s
  FROM ordered a JOIN ordered b ON a.k < b.k WHERE round(list_dot_product(a.u,b.u),6) >= {t.THETA}),
adj AS MATERIALIZED (SELECT o.k, coalesce(list(pr.i) FILTER (pr.i IS NOT NULL), []) AS nb
  FROM ordered o LEFT JOIN pr ON pr.j = o.k GROUP BY o.k),
st(k, leaders) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT adj.k, CASE WHEN list_has_any(adj.nb, st.leaders) THEN st.leaders ELSE list_append(st.leaders, adj.k) END
  FROM st JOIN adj ON adj.k = st.k + 1),
lead AS MATERIALIZED (SELECT unnest(leaders) AS k FROM (SELECT leaders FROM st ORDER BY k DESC LIMIT 1)),
placed0 AS (SELECT pr.j AS k, pr.i AS lk, pr.s, row_number() OVER (PARTITION BY pr.j ORDER BY pr.s DESC, pr.i) AS r
  FROM pr JOIN lead ON lead.k = pr.i),
placed AS MATERIALIZED (SELECT o.id AS post_id, o.created_at AS joined_at, o.u, l.k IS NOT NULL AS leads,
    CASE WHEN l.k IS NOT NULL THEN o.id ELSE ol.id END AS cluster_id,
    CASE WHEN l.k IS NOT NULL THEN 1.0 ELSE p.s END AS similarity
  FROM ordered o LEFT JOIN lead l ON l.k = o.k LEFT JOIN placed0 p ON p.k = o.k AND p.r = 1
  LEFT JOIN ordered ol ON ol.k = p.lk)"""
OUTCOMES = """outcomes AS (SELECT post_id AS id, CASE WHEN leads THEN 'new_cluster' ELSE 'clustered' END AS outcome FROM placed)"""

DRAFTS = """drafts AS MATERIALIZED (SELECT 'alert_' || lpad(id::VARCHAR, 12, '0') AS alert_id,
  'c' || label || '-' || event_type AS cluster_id, event_type AS topic, 'label' || label || ',post' AS keywords,
  substr(md5(event_type || ':' || 'label' || label || ':post'), 1, 12) AS fingerprint, u, created_at AS alerted_at,
  row_number() OVER (ORDER BY created_at, 'alert_' || lpad(id::VARCHAR, 12, '0')) AS k FROM vec)"""
DEDUPED = f"""conf AS MATERIALIZED (SELECT a.k AS i, b.k AS j, a.fingerprint = b.fingerprint AS same,
    round(list_dot_product(a.u,b.u),6) AS s
  FROM drafts a JOIN drafts b ON a.k < b.k AND b.alerted_at - a.alerted_at <= INTERVAL {t.ALERT_COOLDOWN_HOURS} HOUR
  WHERE a.fingerprint = b.fingerprint OR round(list_dot_product(a.u,b.u),6) > {t.ALERT_SIMILARITY}),
cadj AS MATERIALIZED (SELECT d.k, coalesce(list(conf.i) FILTER (conf.i IS NOT NULL), []) AS nb
  FROM drafts d LEFT JOIN conf ON conf.j = d.k GROUP BY d.k),
cst(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT cadj.k, CASE WHEN list_has_any(cadj.nb, cst.kept) THEN cst.kept ELSE list_append(cst.kept, cadj.k) END
  FROM cst JOIN cadj ON cadj.k = cst.k + 1),
keep AS MATERIALIZED (SELECT unnest(kept) AS k FROM (SELECT kept FROM cst ORDER BY k DESC LIMIT 1)),
deduped AS MATERIALIZED (SELECT d.*, keep.k IS NOT NULL AS kept FROM drafts d LEFT JOIN keep ON keep.k = d.k)"""


def query(ctes: list[str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


CLU = [VEC, MEM, CEN, TOPICS, CLUSTERS]
REP = [*CLU, COHERENCE, BASE]
SEQ = [VEC, LEADERS]
ALR = [VEC, DRAFTS, DEDUPED]
PRE = [POSTS, CLEANED, PREPARED]
