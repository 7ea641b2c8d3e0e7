"""Post preparation, keywords, entities, sentiment, hashtags."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import cache
from hashlib import md5
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flockline import schemas
from flockline.functions import constants as K
from flockline.functions import text as tx


KNOWN_WORDS = 500_000  # words whose slots a task remembers, and those of one block of texts
COUNTS = 1 << 20  # numbers of a block of texts that is counted at once

_ODD_SPACES = "\x1c\x1d\x1e\x1f"  # Python's split takes them for white space, the cleaner does not
_SPACES = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_MARKS = r"!-/:-@\[-`{-~"
_EMOTICON = r"[:\-=)(\[\]{}|\\/DPp](?:(?<=[:\-=])[)(\[\]{}|\\/DPp]|(?<=[)(\[\]{}|\\/DPp])[:=\-])"  # K.EMOTICON_PATTERN, in order of its first character


@cache
def _digits() -> tuple[str, str]:
    """Decimal digits by the JVM's version of Unicode, and those about which that of Python differs."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    pattern = SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(r"(?U)\D+")
    digits = pattern.matcher(every).replaceAll("")
    return digits, "".join(set(digits) ^ set(re.findall(r"\d", every)))


def prepare_posts(posts: DataFrame) -> DataFrame:
    """Add ``cleaned_text`` (stop words gone) and ``is_meaningful``; null text never fails.

    The same as :func:`tx.clean_text`, :func:`tx.remove_stop_words` and :func:`tx.has_content`, for
    any text (tested). Texts are lower-cased in the JVM and cleaned in Arrow tasks: one
    pass over the words of a text takes a fraction of the time of five over its array. Called not
    deterministic, so that a later filter does not clean every text twice.
    """
    stop = frozenset(K.STOP_WORDS)
    url, www, mention, hashtag = (re.compile(p) for p in (K.URL_PATTERN, K.WWW_PATTERN, K.MENTION_PATTERN, K.HASHTAG_PATTERN))
    digits, disputed = _digits()
    emoticon, dropped, spaces = re.compile(_EMOTICON), re.compile(f"[{_MARKS}\\d]+"), re.compile(_SPACES)
    exactly = re.compile(f"[{_MARKS}{digits}]+")  # many times slower
    table = {i: None for i in range(128) if dropped.match(chr(i))}

    @F.arrow_udf("cleaned_text string, is_meaningful boolean")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            cleaned, meaningful = [], []
            for text in batch.to_pylist():
                if "http" in text:
                    text = url.sub("", text)
                if "www." in text:
                    text = www.sub("", text)
                if "@" in text:
                    text = mention.sub("", text)
                if "#" in text:
                    text = hashtag.sub(r"\1", text)
                if text.isascii():
                    body = text.translate(table)
                else:
                    body = (exactly if any(c in text for c in disputed) else dropped).sub("", text)
                body = " ".join([body, *emoticon.findall(text)])
                odd = any(c in body for c in _ODD_SPACES)
                words = [w for w in (spaces.split(body) if odd else body.split()) if w and w not in stop]
                cleaned.append(" ".join(words))
                meaningful.append(len([*islice((w for w in words if len(w) >= 3), 2)]) == 2)
            arrays = [pa.array(cleaned, pa.string()), pa.array(meaningful, pa.bool_())]
            yield pa.StructArray.from_arrays(arrays, ["cleaned_text", "is_meaningful"])

    low = F.lower(F.coalesce("text", F.lit("")))
    return posts.select("*", made.asNondeterministic()(low).alias("__made")).select(*posts.columns, "__made.*")


def meaningful_posts(prepared: DataFrame) -> DataFrame:
    return prepared.filter("is_meaningful")


def entity_mentions(posts: DataFrame) -> DataFrame:
    """Companies and technologies named in each post; the other two kinds stay empty."""
    none = F.array().cast("array<string>")
    return posts.select(
        "id",
        tx.entities(F.col("text"), K.COMPANIES).alias("companies"),
        none.alias("locations"),
        none.alias("people"),
        tx.entities(F.col("text"), K.TECHNOLOGIES).alias("technologies"),
    )


def entity_counts(posts: DataFrame) -> DataFrame:
    """Number of posts per entity."""
    found = entity_mentions(posts)
    named = F.explode(
        F.concat(
            F.transform("companies", lambda e: F.struct(F.lit("company").alias("kind"), e.alias("entity"))),
            F.transform("technologies", lambda e: F.struct(F.lit("technology").alias("kind"), e.alias("entity"))),
        )
    )
    return (
        found.select(named.alias("e"))
        .groupBy("e.kind", "e.entity")
        .agg(F.count("*").alias("posts"))
    )


LEXICON_WORDS = 100_000  # words of a lexicon that is broadcast


def sentiment(posts: DataFrame, lexicon: DataFrame, margin: float = 0.1) -> DataFrame:
    """Mean polarity and subjectivity of the lexicon words of a post, with a label.

    ``lexicon`` is (word, polarity, subjectivity). One of at most ``LEXICON_WORDS`` words
    is broadcast, so that only sums per post are shuffled; beyond that, words are
    counted per post before the join, and a frequent word is one row per post.
    """
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    tokens = F.regexp_extract_all(low, F.lit(r"([a-z]+)"), F.lit(1))
    words = posts.select("id", F.posexplode_outer(tokens).alias("at", "word"))
    first = (F.coalesce("at", F.lit(0)) == 0).cast("long")  # once for every post, also for one without words
    entries = lexicon.groupBy("word").agg(
        F.sum("polarity").alias("p"), F.sum("subjectivity").alias("s"), F.count("*").alias("m")
    )
    if lexicon.limit(LEXICON_WORDS + 1).count() <= LEXICON_WORDS:
        entries = F.broadcast(entries)
        counts = words.select("id", "word", F.lit(1).alias("n"), first.alias("posts"))
    else:
        counts = words.groupBy("id", "word").agg(F.count("*").alias("n"), F.sum(first).alias("posts"))
    met = F.sum(F.col("m") * F.col("n"))
    scored = counts.join(entries, "word", "left").groupBy("id").agg(
        (F.sum(F.col("p") * F.col("n")) / met).alias("polarity"),
        (F.sum(F.col("s") * F.col("n")) / met).alias("subjectivity"),
        F.sum("posts").alias("posts"),
    )
    return (
        scored.withColumn("posts", F.explode(F.sequence(F.lit(1).cast("long"), "posts")))
        .drop("posts")
        .na.fill(0.0, ["polarity", "subjectivity"])
        .withColumn(
            "label",
            F.when(F.col("polarity") > margin, "positive")
            .when(F.col("polarity") < -margin, "negative")
            .otherwise("neutral"),
        )
    )


def post_entities(posts: DataFrame) -> DataFrame:
    """Fill the list fields ``hashtags``, ``mentions`` and ``urls`` from the raw text."""
    text = F.col("text")
    return (
        posts.withColumn("hashtags", tx.hashtags(text))
        .withColumn("mentions", tx.mentions(text))
        .withColumn("urls", tx.urls(text))
    )


def hashtag_topic(posts: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """Topic of the first hashtag that has a rule, else General. No join: the rules are few."""
    table = K.HASHTAG_TOPICS if rules is None else rules
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    topics = F.filter(
        F.transform(tx.hashtags(F.col("text")), lambda t: lookup[F.lower(t)]), lambda t: t.isNotNull()
    )
    return posts.withColumn("topic", F.coalesce(F.get(topics, F.lit(0)), F.lit("General")))


def topic_share(tagged: DataFrame) -> DataFrame:
    """Posts and percentage per topic."""
    counts = tagged.groupBy("topic").agg(F.count("*").alias("posts"))
    share = F.col("posts") * 100.0 / F.sum("posts").over(Window.partitionBy())
    return counts.withColumn("percentage", share)


def word_counts(cleaned: DataFrame, key: str, min_length: int = 1) -> DataFrame:
    """Frequency of each word of ``cleaned_text`` per ``key``."""
    return (
        cleaned.select(key, F.explode(tx.words(F.col("cleaned_text"))).alias("word"))
        .filter(F.length("word") >= min_length)
        .groupBy(key, "word")
        .agg(F.count("*").alias("n"))
    )


def embed_posts(
    posts: DataFrame, dim: int = 384, text_col: str = "cleaned_text", output_col: str = "embedding"
) -> DataFrame:
    """Unit vectors by signed feature hashing; a text without words gets the zero vector.

    A word falls into one of ``2 * dim`` slots by its md5, the upper half counts
    negatively. Counting is one pass over the words; a task hashes a word once and
    remembers its slot, for at most ``KNOWN_WORDS`` words. Called not deterministic, so that
    a later filter on the vector is not pushed below it, which would make every vector twice.
    """

    size_of_block = max(1, COUNTS // (2 * dim))

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {"": -1}
        for batch in batches:
            found = []
            for lo in range(0, len(batch), size_of_block):
                texts = pc.fill_null(batch.slice(lo, size_of_block), "")
                words = pc.split_pattern(texts, " ")
                coded = pc.dictionary_encode(words.flatten())
                if len(known) >= KNOWN_WORDS:
                    known = {"": -1}
                slots = np.empty(len(coded.dictionary), dtype="int64")
                for k, word in enumerate(coded.dictionary.to_pylist()):
                    slot = known.get(word)
                    if slot is None:
                        slot = known[word] = int(md5(word.encode()).hexdigest()[:8], 16) % (2 * dim)
                    slots[k] = slot
                slots = slots[coded.indices.to_numpy()]
                rows = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy())
                counts = np.bincount((rows * (2 * dim) + slots)[slots >= 0], minlength=2 * dim * len(texts)).reshape(-1, 2 * dim)
                signed = (counts[:, :dim] - counts[:, dim:]).astype("float64")
                size = np.sqrt((signed**2).sum(1, keepdims=True))
                found.append((signed / np.where(size > 0, size, 1.0)).ravel())
            starts = pa.array(np.arange(len(batch) + 1, dtype="int32") * dim)
            yield pa.ListArray.from_arrays(starts, pa.array(np.concatenate([np.zeros(0), *found])))

    return posts.withColumn(output_col, vectors.asNondeterministic()(F.col(text_col)))


def embed_with(posts: DataFrame, encode, text_col: str = "cleaned_text") -> DataFrame:
    """Unit vectors from any model: ``encode()`` builds, once per task, a ``list[str] -> ndarray``."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = encode()
        for batch in batches:
            texts = batch.fillna("")
            out = np.asarray(model(texts.tolist()), dtype=float)
            out[(texts.str.strip() == "").to_numpy()] = 0.0
            size = np.linalg.norm(out, axis=1, keepdims=True)
            yield pd.Series(list(out / np.where(size > 0, size, 1.0)))

    return posts.withColumn("embedding", vectors(F.col(text_col)))


def topics_of_interest(spark: SparkSession, topics=None) -> DataFrame:
    """The topic table, without vectors."""
    rows = [
        (title, description, [], None, i)
        for i, (title, description) in enumerate(topics or K.TOPICS_OF_INTEREST)
    ]
    return spark.createDataFrame(rows, schemas.TOPICS)


def topic_vectors(topics: DataFrame, dim: int = 384) -> DataFrame:
    """Embed "title description" of every topic."""
    texts = topics.drop("embedding").withColumn(
        "__text", tx.clean_text(F.concat_ws(" ", "title", "description"))
    )
    return embed_posts(texts, dim, "__text").drop("__text")
