"""Table schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)
_STRINGS, _FLOATS, _DOUBLES = (
    T.ArrayType(T.StringType()),
    T.ArrayType(T.FloatType()),
    T.ArrayType(T.DoubleType()),
)

POSTS = _struct(
    ("id", _S),
    ("post_id", _S),
    ("text", _S),
    ("author_id", _S),
    ("author_username", _S),
    ("created_at", _TS),
    ("retweet_count", _I),
    ("like_count", _I),
    ("reply_count", _I),
    ("quote_count", _I),
    ("hashtags", _STRINGS),
    ("mentions", _STRINGS),
    ("urls", _STRINGS),
)

POSTS_SUBSET = _struct(
    ("post_id", _S),
    ("text", _S),
    ("created_at", _TS),
    ("author_id", _S),
    ("author_username", _S),
)

MEMBERS = _struct(("cluster_id", _S), ("post_id", _S), ("joined_at", _TS), ("similarity", _D))

FEATURES = _struct(("cluster_id", _S), ("n", _L), ("linear_sum", _DOUBLES), ("square_sum", _D))

TOPICS = _struct(
    ("title", _S), ("description", _S), ("keywords", _STRINGS), ("embedding", _FLOATS), ("ord", _I)
)

ALERTS = _struct(
    ("alert_id", _S),
    ("cluster_id", _S),
    ("topic", _S),
    ("keywords", _STRINGS),
    ("fingerprint", _S),
    ("embedding", _DOUBLES),
    ("alerted_at", _TS),
    ("post_count", _L),
    ("threshold", _D),
)

ALERT_RULES = _struct(
    ("name", _S),
    ("min_cluster_size", _I),
    ("topic_similarity_threshold", _D),
    ("enabled", T.BooleanType()),
)

REQUIRED_POST_FIELDS = ("post_id", "text", "author_id", "author_username")
COUNT_FIELDS = ("retweet_count", "like_count", "reply_count", "quote_count")
