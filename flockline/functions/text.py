"""Text functions: Column in, Column out, all of them JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flockline.functions import constants as K


_MARKS = r"[!-/:-@\[-`{-~]+"  # the characters of K.PUNCTUATION; translate looks each character up in a map
_SPACES = r"(?U) \s+|[^\S ]\s*"  # runs of white space that are no single blank, so that few places are replaced


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it.

    Common subexpressions are not shared inside lambda functions; a transform
    over a one-element array binds the value instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_text(text: Column) -> Column:
    """Lower-case, strip links, mentions, punctuation and digits; keep emoticons at the end."""
    flat = F.lower(F.coalesce(text, F.lit("")))
    flat = F.regexp_replace(flat, K.URL_PATTERN, "")
    flat = F.regexp_replace(flat, K.WWW_PATTERN, "")
    flat = F.regexp_replace(flat, K.MENTION_PATTERN, "")
    flat = F.regexp_replace(flat, K.HASHTAG_PATTERN, "$1")
    flat = F.regexp_replace(flat, _SPACES, " ")

    def finish(u: Column) -> Column:
        emoticons = F.regexp_extract_all(u, F.lit(K.EMOTICON_PATTERN), F.lit(1))
        body = F.concat_ws(" ", F.regexp_replace(u, _MARKS, ""), F.array_join(emoticons, " "))
        return F.trim(F.regexp_replace(F.regexp_replace(body, r"(?U)\d+", ""), _SPACES, " "))

    return let(flat, finish)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def content_words(text: Column, stop_words: list[str] | None = None) -> Column:
    # isin over many literals becomes a hash set; array_contains would scan the list per word.
    stop = K.STOP_WORDS if stop_words is None else stop_words
    return F.filter(words(text), lambda w: ~F.lower(w).isin(stop))


def remove_stop_words(text: Column, stop_words: list[str] | None = None) -> Column:
    return F.array_join(content_words(text, stop_words), " ")


def keywords(text: Column, min_length: int = 3) -> Column:
    """Content words of the cleaned text with at least ``min_length`` characters."""
    return F.filter(content_words(clean_text(text)), lambda w: F.length(w) >= min_length)


def is_meaningful(text: Column, min_words: int = 2) -> Column:
    return F.size(keywords(text)) >= min_words


def has_content(cleaned: Column, min_words: int = 2) -> Column:
    """:func:`is_meaningful` of a text that is cleaned and without stop words already.

    Cleaning it again changes no word of three or more characters: no mark, digit or second
    blank is left in it but the emoticons of two characters.
    """
    return F.size(F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= 3)) >= min_words


def hashtags(text: Column) -> Column:
    """Words that begin with a hash sign, without it."""
    return F.regexp_extract_all(text, F.lit(r"(?U)#(?<!\S#)(\S*)"), F.lit(1))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(K.MENTION_PATTERN.replace("@", "@(") + ")"), F.lit(1))


def urls(text: Column) -> Column:
    pattern = r"(https?://[!$-_a-z]+|www\.[!$-_a-z]+)"
    some = F.contains(text, F.lit("://")) | F.contains(text, F.lit("www."))  # few texts have any
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(some, found).when(text.isNotNull(), F.array().cast("array<string>"))


def entities(text: Column, terms: list[str]) -> Column:
    """Dictionary terms found anywhere in the text, title case, dictionary order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.transform(
        F.filter(_literals(terms), lambda t: F.contains(low, t)), lambda t: F.initcap(t)
    )


def preview(text: Column, length: int) -> Column:
    return F.when(
        F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))
    ).otherwise(text)


def fingerprint(topic: Column, terms: Column) -> Column:
    content = F.concat(topic, F.lit(":"), F.array_join(F.array_sort(terms), ":"))
    return F.substring(F.md5(content), 1, 12)


def ranking_engagement() -> Column:
    return F.col("like_count") + F.col("retweet_count")


def total_engagement() -> Column:
    return F.col("like_count") + F.col("retweet_count") + F.col("reply_count")
