"""Language identification by rank-order n-gram profiles (operator 4).

A text is lower-cased; runs of anything but letters become one blank, also at both
ends. Its profile is the order of its 300 most frequent grams of one to three
characters. A language's profile is that of all its training texts together. The
distance of a text from a language is the sum, over the text's profile, of how far
each gram is out of place; a gram the language lacks counts 300.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockline.llm.names import unused

PROFILE = 300
MAX_LANGUAGES = 4096  # profiles travel with the tasks: at most 10 MB
_FLUSH = 2_000_000  # grams a training task holds before it passes their counts on
_BLANK = np.uint64(32)
UNKNOWN = "und"
LONGEST_CLASS = 10  # texts of 1,024 characters and more: their profiles are full
STRAY = 0.001  # share of the labelled documents that may be in no language
MARGIN = 0.75

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; built once per worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(text: str | None) -> np.ndarray:
    """All grams of a whole text as numbers, unordered: three code points of 21 bits, left-aligned."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "uint32")
    letter = letter_table()[code]
    if not letter.any():
        return np.zeros(0, "uint64")
    before = np.concatenate([[True], letter[:-1]])
    body = np.where(letter, code, 32)[letter | before]
    line = np.concatenate([[32], body, [32]]).astype("uint64")
    if line[1] == 32:
        line = line[1:]
    if line[-2] == 32:
        line = line[:-1]
    one, two = line << np.uint64(42), line[:-1] << np.uint64(42) | line[1:] << np.uint64(21)
    three = two[:-1] | line[2:]
    return np.concatenate([one[line != _BLANK], two, three])


def counted(found: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in ascending order and their counts."""
    if weights is None:
        found = np.sort(found)
    else:
        order = np.argsort(found, kind="stable")
        found, weights = found[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, "int64")
    sums = np.diff(np.append(at, len(found))) if weights is None else np.add.reduceat(weights, at) if len(at) else weights
    return found[at], sums


def profile(text: str | None) -> np.ndarray:
    """The most frequent grams of a text, most frequent first, ties by code point."""
    found, n = counted(grams(text))
    return found[np.argsort(-n, kind="stable")[:PROFILE]]


def training_counts(docs: DataFrame) -> DataFrame:
    """``(lang, gram, n)`` over all of ``docs (text, lang)``; counts are summed in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                found, n = counted(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view("int64")), pa.array(n)], names=["lang", "gram", "n"]
                )

        size = 0
        for batch in batches:
            raw: dict[str, list] = {}
            pending = 0

            def pack() -> int:
                added = 0
                for lang, parts in raw.items():
                    held.setdefault(lang, []).append(counted(np.concatenate(parts)))
                    added += len(held[lang][-1][0])
                raw.clear()
                return added

            for text, lang in zip(batch.column(0), batch.column(1)):
                found = grams(text.as_py())
                raw.setdefault(lang.as_py(), []).append(found)
                pending += len(found)
                if pending > _FLUSH:
                    size, pending = size + pack(), 0
            size += pack()
            if size > _FLUSH:
                held = {lang: [counted(*(np.concatenate(x) for x in zip(*parts)))] for lang, parts in held.items()}
                size = sum(len(parts[0][0]) for parts in held.values())
                if size > _FLUSH // 2:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    found = docs.select("text", F.col("lang").cast("string")).mapInArrow(count, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Profiles of all languages of the labelled ``docs``, at most 300 numbers each."""
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = training_counts(docs.filter("lang IS NOT NULL AND text IS NOT NULL")).withColumn("rank", F.row_number().over(best))
    rows = ranked.filter(F.col("rank") <= PROFILE).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("top"))
    found = rows.select("lang", "top.gram").orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: the labels are not languages")
    return {r.lang: np.array(r.gram, "int64").view("uint64") for r in found}


def classify(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from the whole text alone.

    The nearest profile wins, ties by name. ``score`` is one less the distance over the
    greatest possible one. A text that is null or has no letter is ``und`` with score 0,
    and so is any text when nothing was learned. Rows pass one by one, so repeated and
    very long texts need nothing special; an earlier lang_pred or score is replaced.
    """
    names = list(model)
    books = []
    for grams_of in model.values():
        order = np.argsort(grams_of)
        books.append((grams_of[order], order))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0)
            own = [profile(t.as_py()) for t in texts]
            size = np.array([len(p) for p in own], "int64")
            at = np.repeat(np.arange(len(own)), size)
            flat = np.concatenate([*own, np.zeros(0, "uint64")])
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            least, best = np.full(len(own), np.inf), np.full(len(own), -1)
            for k, (book, place) in enumerate(books):
                spot = np.minimum(np.searchsorted(book, flat), len(book) - 1)
                far = np.where(book[spot] == flat, np.abs(place[spot] - rank), PROFILE)
                total = np.bincount(at, far, len(own))
                nearer = (size > 0) & (total < least)
                least[nearer], best[nearer] = total[nearer], k
            score = np.where(best >= 0, 1 - least / np.maximum(PROFILE * size, 1), 0.0)
            said = pa.array([names[k] if k >= 0 else UNKNOWN for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], said, pa.array(score)], names=[f.name for f in out])

    rest = [docs[c] for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    chosen = docs.select(F.col("text").cast("string").alias(unused(docs, "whole_text")), *rest)
    out = [*chosen.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return chosen.mapInArrow(predict, T.StructType(out))


def held_out(doc_id: Column) -> Column:
    """The fold that is not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Predictions for every row of ``docs``, learned from the text and lang of the rows that are not held out.

    Adds ``held_out``, ``lang_pred`` and ``score``. Rows without an id are not held out.
    """
    model = learn(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    rest = [docs[c] for c in docs.columns if c.lower() != "held_out"]
    return classify(docs.select(*rest, held_out(F.col("doc_id")).alias("held_out")), model)


def _length_class(text: str = "text") -> Column:
    """0 to ``LONGEST_CLASS``: the power of two that a text's length reaches."""
    return F.least(F.floor(F.log2(F.greatest(F.length(text), F.lit(1)))), F.lit(LONGEST_CLASS)).cast("int")


def least_scores(scored: DataFrame) -> DataFrame:
    """``(length_class, least)``: what a text of some length must score to be in a learned language.

    The scores of the documents that were learned from, of the same length or shorter (short texts
    score lower), set it: their lowest but for one in ``1 / STRAY``, less a margin. One row for each
    class; a class without any such document has none.
    """
    learned = scored.filter(f"NOT held_out AND lang IS NOT NULL AND lang_pred <> '{UNKNOWN}'")
    classes = F.explode(F.sequence(_length_class(), F.lit(LONGEST_CLASS))).alias("length_class")
    rows = learned.select(classes, "score")
    low = F.percentile_approx("score", F.lit(STRAY), F.lit(int(10 / STRAY)))
    return rows.groupBy("length_class").agg((low * MARGIN).alias("least"))


def known(scored: DataFrame) -> DataFrame:
    """The rows of :func:`identify` whose text is in a learned language; ``scored`` is read twice and should be stored.

    A text without a letter goes, and so does one below the least score of its length. Where no
    document was learned from, or none as short, a text with a letter stays. Columns stay as they are.
    """
    bounds = {r.length_class: r.least for r in least_scores(scored).collect()}  # one number for each class
    least = F.lit(0.0)
    for size, bound in sorted(bounds.items()):
        least = F.when(_length_class() == size, bound).otherwise(least)
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
