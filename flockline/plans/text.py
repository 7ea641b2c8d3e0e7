"""Text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.functions import text as tx
from flockline.operators import text as to
from flockline.plans import sql as s
from flockline.plans.tables import HASHTAG_RULES, Tables, big, r6

# A small lexicon for the query; users bring their own.
LEXICON = [
    ("good", 0.7, 0.6),
    ("great", 0.8, 0.75),
    ("best", 1.0, 0.3),
    ("bad", -0.7, 0.67),
    ("wrong", -0.5, 0.9),
    ("thing", 0.3, 0.2),
    ("then", 0.25, 0.4),
    ("than", -0.4, 0.5),
    ("there", -0.2, 0.3),
    ("other", -0.125, 0.375),
    ("und", 0.15, 0.25),
    ("que", -0.3, 0.1),
]
_LEX_SQL = "lex AS (SELECT * FROM (VALUES " + ", ".join(
    f"({s.quote(w)}, {p}::DOUBLE, {u}::DOUBLE)" for w, p, u in LEXICON
) + ") v(word, polarity, subjectivity))"


def clean_text(spark, path):
    return Tables(spark, path).posts.select("id", tx.clean_text(F.col("text")).alias("cleaned"))


def remove_stop_words(spark, path):
    words = tx.remove_stop_words(tx.clean_text(F.col("text")))
    return Tables(spark, path).posts.select("id", words.alias("content"))


def extract_keywords(spark, path):
    return Tables(spark, path).posts.select("id", F.array_join(tx.keywords(F.col("text")), " ").alias("keywords"))


def meaningful_posts(spark, path):
    return to.meaningful_posts(Tables(spark, path).prepared).select("id")


def prepare_posts(spark, path):
    return Tables(spark, path).prepared.select("id", "cleaned_text", big("is_meaningful").alias("is_meaningful"))


def entity_mentions(spark, path):
    found = to.entity_mentions(Tables(spark, path).posts)
    return found.select(
        "id", *[F.array_join(c, ",").alias(c) for c in ("companies", "locations", "people", "technologies")]
    )


def entity_counts(spark, path):
    return to.entity_counts(Tables(spark, path).posts)


def sentiment(spark, path):
    lexicon = spark.createDataFrame(LEXICON, "word string, polarity double, subjectivity double")
    scored = to.sentiment(Tables(spark, path).posts, lexicon)
    return scored.select("id", r6("polarity").alias("polarity"), r6("subjectivity").alias("subjectivity"), "label")


def hashtags(spark, path):
    return Tables(spark, path).posts.select("id", F.array_join(tx.hashtags(F.col("text")), ",").alias("tags"))


def hashtag_topic(spark, path):
    return to.hashtag_topic(Tables(spark, path).posts, HASHTAG_RULES).select("id", "topic")


def topic_share(spark, path):
    shares = to.topic_share(to.hashtag_topic(Tables(spark, path).posts, HASHTAG_RULES))
    return shares.select("topic", "posts", r6("percentage").alias("percentage"))


def preview(spark, path):
    text = F.col("text")
    return Tables(spark, path).posts.select(
        "id", tx.preview(text, 100).alias("short"), tx.preview(text, 200).alias("long")
    )


def engagement(spark, path):
    return Tables(spark, path).posts.select(
        "id", big(tx.ranking_engagement()).alias("ranking"), big(tx.total_engagement()).alias("total")
    )


def fingerprint(spark, path):
    terms = tx.keywords(F.col("text"))
    tagged = to.hashtag_topic(Tables(spark, path).posts, HASHTAG_RULES)
    return tagged.select("id", tx.fingerprint(F.col("topic"), F.array_distinct(terms)).alias("fingerprint"))


def word_counts(spark, path):
    return to.word_counts(Tables(spark, path).prepared, "source")


def mentions_urls(spark, path):
    found = to.post_entities(Tables(spark, path).posts)
    return found.select(
        "id", F.array_join("mentions", ",").alias("mentions"), F.array_join("urls", ",").alias("urls")
    )


QUERIES = {f.__name__: f for f in (
    clean_text, remove_stop_words, extract_keywords, meaningful_posts, prepare_posts, entity_mentions,
    entity_counts, sentiment, hashtags, hashtag_topic, topic_share, preview, engagement, fingerprint,
    word_counts, mentions_urls,
)}

_TAGS = r"list_transform(list_filter(regexp_split_to_array(text, '\s+'), lambda w: starts_with(w, '#')), lambda w: substr(w, 2))"
_RULES = "CASE lower(x) " + " ".join(f"WHEN {s.quote(k)} THEN {s.quote(v)}" for k, v in HASHTAG_RULES.items()) + " END"
_TAGGED = (
    f"tagged AS (SELECT *, coalesce(list_filter(list_transform({_TAGS}, lambda x: {_RULES}), "
    f"lambda y: y IS NOT NULL)[1], 'General') AS topic FROM posts)"
)
_KEYS = f"list_filter({s.content('cl')}, lambda w: length(w) >= 3)"


def _found(terms: list[str]) -> str:
    title = lambda w: " ".join(p.capitalize() for p in w.split())
    pairs = ", ".join(f"CASE WHEN contains(lower(text), {s.quote(w)}) THEN {s.quote(title(w))} END" for w in terms)
    return f"list_filter([{pairs}], lambda e: e IS NOT NULL)"


def _joined(expr: str, sep: str = ",") -> str:
    return f"coalesce(array_to_string({expr}, {s.quote(sep)}), '')"


ORACLES = {
    "clean_text": s.query([s.POSTS, s.CLEANED], "SELECT id, cl AS cleaned FROM cleaned"),
    "remove_stop_words": s.query(
        [s.POSTS, s.CLEANED], f"SELECT id, {_joined(s.content('cl'), ' ')} AS content FROM cleaned"
    ),
    "extract_keywords": s.query(
        [s.POSTS, s.CLEANED], f"SELECT id, {_joined(_KEYS, ' ')} AS keywords FROM cleaned"
    ),
    "meaningful_posts": s.query(s.PRE, "SELECT id FROM prepared WHERE is_meaningful"),
    "prepare_posts": s.query(s.PRE, "SELECT id, cleaned_text, is_meaningful::BIGINT AS is_meaningful FROM prepared"),
    "entity_mentions": s.query(
        [s.POSTS],
        f"SELECT id, {_joined(_found(K.COMPANIES))} AS companies, '' AS locations, '' AS people, "
        f"{_joined(_found(K.TECHNOLOGIES))} AS technologies FROM posts",
    ),
    "entity_counts": s.query(
        [s.POSTS],
        f"SELECT kind, entity, count(*) AS posts FROM ("
        f"SELECT 'company' AS kind, unnest({_found(K.COMPANIES)}) AS entity FROM posts UNION ALL "
        f"SELECT 'technology', unnest({_found(K.TECHNOLOGIES)}) FROM posts) GROUP BY 1, 2",
    ),
    "sentiment": s.query(
        [
            s.POSTS,
            _LEX_SQL,
            "tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM posts)",
            "sc AS (SELECT id, avg(polarity) AS p, avg(subjectivity) AS u FROM tok JOIN lex USING (word) GROUP BY 1)",
        ],
        f"SELECT id, {s.r6('coalesce(p,0.0)')} AS polarity, {s.r6('coalesce(u,0.0)')} AS subjectivity, "
        "CASE WHEN coalesce(p,0) > 0.1 THEN 'positive' WHEN coalesce(p,0) < -0.1 THEN 'negative' ELSE 'neutral' END AS label "
        "FROM posts LEFT JOIN sc USING (id)",
    ),
    "hashtags": s.query([s.POSTS], f"SELECT id, {_joined(_TAGS)} AS tags FROM posts"),
    "hashtag_topic": s.query([s.POSTS, _TAGGED], "SELECT id, topic FROM tagged"),
    "topic_share": s.query(
        [s.POSTS, _TAGGED],
        f"SELECT topic, posts, {s.r6('posts * 100.0 / t')} AS percentage FROM (SELECT topic, count(*) AS posts, "
        "(SELECT count(*) FROM tagged) AS t FROM tagged GROUP BY 1)",
    ),
    "preview": s.query(
        [s.POSTS],
        "SELECT id, CASE WHEN length(text) > 100 THEN substr(text,1,100) || '...' ELSE text END AS short, "
        "CASE WHEN length(text) > 200 THEN substr(text,1,200) || '...' ELSE text END AS long FROM posts",
    ),
    "engagement": s.query(
        [s.POSTS],
        "SELECT id, like_count + retweet_count AS ranking, like_count + retweet_count + reply_count AS total FROM posts",
    ),
    "fingerprint": s.query(
        [s.POSTS, _TAGGED, f"tc AS (SELECT *, {s.clean('text', 'cl')} FROM tagged)"],
        f"SELECT id, substr(md5(topic || ':' || {_joined(f'list_sort(list_distinct({_KEYS}))', ':')}), 1, 12) AS fingerprint FROM tc",
    ),
    "word_counts": s.query(
        s.PRE,
        "SELECT source, word, count(*) AS n FROM (SELECT source, unnest(string_split(cleaned_text, ' ')) AS word FROM prepared) "
        "WHERE word <> '' GROUP BY 1, 2",
    ),
    "mentions_urls": s.query(
        [s.POSTS],
        f"SELECT id, {_joined('list_transform(regexp_extract_all(text, ' + s.quote(K.MENTION_PATTERN) + '), lambda w: substr(w, 2))')} AS mentions, "
        + _joined("regexp_extract_all(text, 'https?://[!$-_a-z]+|www\\.[!$-_a-z]+')")
        + " AS urls FROM posts",
    ),
}
