import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flockline.functions import constants as K
from flockline.functions import text as tx
from flockline.operators import text as to


def _clean_all(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["c"] for r in df.select("i", tx.clean_text(F.col("text")).alias("c")).orderBy("i").collect()]


def _plain(text):
    """The cleaning steps, one after the other."""
    text = (text or "").lower()
    for pattern in (K.URL_PATTERN, K.WWW_PATTERN, K.MENTION_PATTERN):
        text = re.sub(pattern, "", text)
    text = re.sub(r"\s+", " ", re.sub(K.HASHTAG_PATTERN, r"\1", text))
    emoticons = re.findall(K.EMOTICON_PATTERN, text)
    kept = "".join(c for c in text if c not in K.PUNCTUATION)
    kept = " ".join([kept, *emoticons])
    return re.sub(r"\s+", " ", re.sub(r"\d+", "", kept)).strip()


def test_clean_text_cases(spark):
    cases = {
        "Check https://x.co/a_b?q=1 now :) #AI @bob 5G top-notch": "check now ai g topnotch :) p-",
        "RT self-publish :D :P =( www.foo.com/x": "rt selfpublish d p -p :p =(",
        "a (: b :-) x=1": "a b x (: -)",
        "": "",
        None: "",
    }
    assert _clean_all(spark, list(cases)) == list(cases.values())


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB1 \t#@:)(-=/.wp_!é'") , max_size=40), min_size=20, max_size=60))
def test_clean_text_equals_plain_steps(spark, texts):
    texts += ["http://" + t for t in texts[:10]]
    assert _clean_all(spark, texts) == [_plain(t) for t in texts]


def test_prepare_gate_and_stop_words(spark):
    rows = [(1, "The market is moving fast today"), (2, "it is on"), (3, None)]
    got = to.prepare_posts(spark.createDataFrame(rows, "id int, text string")).orderBy("id").collect()
    assert [r["cleaned_text"] for r in got] == ["market moving fast today", "", ""]
    assert [r["is_meaningful"] for r in got] == [True, False, False]


def test_entities_hashtags_previews(spark):
    text = "Google and deep learning said #Launch #Other"
    row = spark.createDataFrame([(1, text)], "id int, text string")
    found = to.entity_mentions(row).head()
    # "ai" is found inside "said": terms match anywhere in the text
    assert found["companies"] == ["Google"] and found["technologies"] == ["Ai", "Deep Learning"]
    assert found["locations"] == [] and found["people"] == []
    assert to.hashtag_topic(row).head()["topic"] == "Product Launches"
    short = row.select(tx.preview(F.col("text"), 6).alias("a"), tx.preview(F.col("text"), 99).alias("b")).head()
    assert short["a"] == "Google..." and short["b"] == text


def test_embedding_is_unit_or_zero(spark):
    rows = spark.createDataFrame([(1, "alpha beta beta"), (2, "")], "id int, cleaned_text string")
    one, two = [r["embedding"] for r in to.embed_posts(rows, 16).orderBy("id").collect()]
    assert abs(sum(x * x for x in one) - 1) < 1e-12 and two == [0.0] * 16
    sizes = sorted(abs(x) for x in one if x)
    assert abs(sizes[-1] / sizes[0] - 2) < 1e-12


def test_embed_with_model(spark):
    import numpy as np

    rows = spark.createDataFrame([(1, "aa"), (2, "")], "id int, cleaned_text string")

    def model():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    one, two = [r["embedding"] for r in to.embed_with(rows, model).orderBy("id").collect()]
    assert abs(one[0] / one[1] - 2) < 1e-12 and two == [0.0, 0.0]


@pytest.mark.parametrize("words", [0, 100])
def test_sentiment_labels(spark, monkeypatch, words):
    monkeypatch.setattr(to, "LEXICON_WORDS", words)
    lexicon = spark.createDataFrame(
        [("good", 0.8, 0.6), ("bad", -0.6, 0.4)], "word string, polarity double, subjectivity double"
    )
    rows = spark.createDataFrame([(1, "Good, good bad"), (2, "bad!"), (3, None), (4, ""), (4, "")], "id int, text string")
    assert to.sentiment(rows, lexicon).count() == 5
    got = {r["id"]: (round(r["polarity"], 6), r["label"]) for r in to.sentiment(rows, lexicon).collect()}
    assert got == {1: (0.333333, "positive"), 2: (-0.6, "negative"), 3: (0.0, "neutral"), 4: (0.0, "neutral")}


def test_a_small_lexicon_is_broadcast(spark):
    lexicon = spark.createDataFrame([("good", 0.8, 0.6)], "word string, polarity double, subjectivity double")
    rows = spark.createDataFrame([(1, "good")], "id int, text string")
    plan = to.sentiment(rows, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_prepared_posts_are_not_cleaned_twice(spark):
    """One look at the cleaned words says what cleaning them again says."""
    texts = ["", None, "a b", ":) :p =D word", "cat 12dog", "x:/yz\u00a0\u2003two  three", "the rt \u0391\u03a31\u0392 \u0130i", "don't -- www.x.co #tag @me", "q\x1cw\tee\n\nrr\x85tt \u0663\u00bd"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    cleaned = tx.remove_stop_words(tx.clean_text(F.col("text")))
    found = rows.select(tx.has_content(cleaned).alias("once"), tx.is_meaningful(cleaned).alias("twice")).collect()
    assert [r["once"] for r in found] == [r["twice"] for r in found]
    assert {r["once"] for r in found} == {True, False}


def test_vectors_of_posts_are_counted_in_tasks_that_remember_words(spark):
    rows = spark.createDataFrame([(1, "cat cat dog"), (2, ""), (3, None)], "id long, cleaned_text string")
    plan = to.embed_posts(rows, 8)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "md5" not in plan
    found = {r["id"]: r["embedding"] for r in to.embed_posts(rows, 8).collect()}
    expected = [0.0] * 8
    for word in ("cat", "cat", "dog"):
        slot = int(hashlib.md5(word.encode()).hexdigest()[:8], 16) % 16
        expected[slot % 8] += 1 if slot < 8 else -1
    size = sum(x * x for x in expected) ** 0.5
    assert found[1] == [x / size if size else 0.0 for x in expected]
    assert found[2] == found[3] == [0.0] * 8


def test_posts_are_cleaned_in_tasks_as_in_the_jvm(spark):
    """Each kind of character, and odd texts: the same words by the Arrow task and by the functions on columns."""
    points = [*range(1, 0x3100), 0xFEFF, 0xFF10, 0xFF21, 0x104A0, 0x10400, 0x11F50, 0x16AC0, 0x1D7CE, 0x1E4F0, 0x1F600]
    texts = [f"ab{chr(c)}cd {chr(c)} X{chr(c)}:) #{chr(c)}t{chr(c)}#u @{chr(c)} three" for c in points]
    texts += ["", None, "#", "RT :D =P p-p:=( d:", "http://x.y www.a the THE 4word", "a\x1cb \x1d c", "ΑΣ İi"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(4)
    made = to.prepare_posts(rows)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    cleaned = tx.remove_stop_words(tx.clean_text(F.col("text")))
    bad = made.filter(~F.col("cleaned_text").eqNullSafe(cleaned) | ~F.col("is_meaningful").eqNullSafe(tx.has_content(cleaned)))
    assert bad.select("id").collect() == []


def test_words_are_counted_in_blocks(spark, monkeypatch):
    """A block of texts, and a task that forgets words, give the vectors of one text after the other."""
    texts = [" ".join(f"w{j * i % 17}" for j in range(i)) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate([*texts, None])), "id long, cleaned_text string")
    whole = to.embed_posts(rows, 8).orderBy("id").collect()
    monkeypatch.setattr(to, "COUNTS", 48)
    monkeypatch.setattr(to, "KNOWN_WORDS", 3)
    assert to.embed_posts(rows, 8).orderBy("id").collect() == whole


def test_entities_of_texts_with_odd_spaces_and_signs(spark):
    texts = ["#a b#c #d#e #f", "# #", "", None, "x\n#g\u0085#h", "@me @@you mail@x.co", "see https://x.co/a?q and www.b.de", "HTTP://no www,"]
    row = to.post_entities(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")).orderBy("id").collect()
    assert [r["hashtags"] for r in row] == [["a", "d#e", "f"], ["", ""], [], None, ["g", "h"], [], [], []]
    assert [r["mentions"] for r in row] == [[], [], [], None, [], ["me", "you", "x"], [], []]
    assert [r["urls"] for r in row] == [[], [], [], None, [], [], ["https://x.co/a?q", "www.b.de"], []]
    plan = to.post_entities(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # no array of all words
