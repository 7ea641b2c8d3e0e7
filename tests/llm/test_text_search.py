"""Lexical search, byte-level BPE and phrase mining against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline.llm import bpe, lexical, phrases

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def sentences(seed: int, n: int, longest: int = 40) -> list[str]:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "été", "naïve", "x1", "New", "York", "stock", "exchange", "中文", "a", "tea", "pot"]
    out = []
    for _ in range(n):
        words = rng.choices(vocabulary, [8, 6, 5, 1, 1, 1, 2, 2, 2, 2, 1, 3, 1, 1], k=rng.randrange(longest))
        out.append("".join(w + rng.choice([" ", " ", " ", " ", ", ", ".", "\t", "  ", "\n"]) for w in words))
    return out


# Lexical search


def ranked(docs, items, k):
    words = [[t.lower() for t in TERM.findall((text or "").encode())] for _, text in docs]
    total, length = sum(1 for w in words if w), sum(map(len, words))
    df = Counter(t for w in words for t in set(w))
    out = []
    for item, text in set(items):
        scores = []
        for (doc, _), own in zip(docs, words):
            tf, m = Counter(own), 100 - 25 + ((25 * len(own) * total) // length if length else 0)
            score = 0
            for t in [t.lower() for t in TERM.findall((text or "").encode())]:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, k):
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit("x"), "n": F.lit(2)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"query": F.lit(1), "doc_id": F.lit(7)})
    return sorted([tuple(r) for r in lexical.search(rows.repartition(3), asked, k).collect()], key=repr)


@pytest.mark.parametrize("k", [1, 3, 500])
def test_search_equals_brute_force(spark, k):
    texts = sentences(1, 120)
    docs = list(enumerate(texts)) + [(200, None), (201, ""), (202, "..."), (None, texts[3]), (5, texts[5]), (300, texts[0]), (301, texts[0])]
    items = [(i, t) for i, t in enumerate(sentences(2, 12, 9))] + [(50, None), (51, ""), (52, "unheard of"), (0, "tea"), (None, "tea pot"), (53, "tea"), (53, "tea"), (54, "tea tea tea New")]
    assert found(spark, docs, items, k) == ranked(docs, items, k)


def test_search_without_documents_or_items(spark):
    assert found(spark, [], [(1, "tea")], 3) == []
    assert found(spark, [(1, "tea")], [], 3) == []
    assert found(spark, [(1, None)], [(1, "tea"), (2, "!")], 3) == []


def test_search_with_a_long_text_in_small_shards_and_blocks(spark, monkeypatch):
    docs = list(enumerate(sentences(3, 60))) + [(99, "tea pot " * 300_000)]
    items = [(i, t) for i, t in enumerate(sentences(4, 9, 12))]
    whole = found(spark, docs, items, 5)
    assert whole == ranked(docs, items, 5)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 64)
    assert found(spark, docs, items, 5) == whole


def test_best_positions_stop_early_and_right():
    rng = np.random.default_rng(5)
    size, terms = 5000, 4
    doc = np.concatenate([np.sort(rng.choice(size, 2000, replace=False)) for _ in range(terms)])
    term = np.repeat(np.arange(terms), 2000)
    # One list falls steeply, so few documents can reach the top; ties are common.
    impact = (10_000 / (1 + rng.integers(0, 400, len(doc)))).astype("int64")
    shard = lexical.Shard(term, doc, impact, size, terms)
    full = np.zeros(size, "int64")
    np.add.at(full, doc, impact * np.array([1, 2, 1, 3])[term])
    rank = rng.permutation(size)
    order = np.lexsort((rank, -full))[:20]
    docs, scores, depth = shard.best([0, 1, 2, 3], [1, 2, 1, 3], 20, rank)
    assert docs.tolist() == order.tolist() and scores.tolist() == full[order].tolist()
    assert depth < 1000


def test_impacts_beyond_64_bits():
    tf, n, w = np.array([10**10, 3]), np.array([10**11, 5]), np.array([20_000, 7])
    total, words = 10**12, 10**14
    want = [int(w[i]) * ((10**9 * int(tf[i])) // (1000 * int(tf[i]) + 12 * (75 + 25 * int(n[i]) * total // words))) for i in range(2)]
    assert lexical.impacts(tf, n, w, total, words).tolist() == want


# Byte-level BPE


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    ranks = bpe.read_ranks(bpe.VOCABULARY)
    return tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(plain):
    codec = bpe.codec(bpe.VOCABULARY, bpe.PATTERN)
    rng = random.Random(1)
    tokens = [t.decode("utf-8", "ignore") for t in codec.ranks]
    texts = ["", " ", "\n\n  x", "a\x1cb \x85c  d", "'s 'll we've", "<|endoftext|>", "e" * 20_000, " " * 20_000, "=-" * 9_000]
    for _ in range(1500):
        kind = rng.random()
        if kind < 0.4:
            texts.append("".join(rng.choice("abcde \n.'xsé中🙂\t12 \x1f") for _ in range(rng.randrange(60))))
        elif kind < 0.8:
            texts.append("".join(rng.choice(tokens) for _ in range(rng.randrange(20))))
        else:
            texts.append("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(80))))
    for text in texts:
        packed = codec.encode(text)
        assert list(memoryview(packed).cast("I")) == plain.encode_ordinary(text)
        assert codec.decode(packed) == text.encode()


def made_up_merges(rng: random.Random, n: int) -> dict[bytes, int]:
    """Ranks of the most frequent pairs of random strings, merged one after the other."""
    ranks = {bytes([b]): b for b in range(256)}
    rows = [[bytes([rng.choice(b"abc")]) for _ in range(rng.randrange(2, 60))] for _ in range(60)]
    for _ in range(n):
        pairs = Counter(pair for row in rows for pair in zip(row, row[1:]) if pair[0] + pair[1] not in ranks)
        if not pairs:
            break
        (a, b), _ = pairs.most_common(1)[0]
        ranks[a + b] = len(ranks)
        for row in rows:
            k = 0
            while k + 1 < len(row):
                if row[k] == a and row[k + 1] == b:
                    row[k : k + 2] = [a + b]
                k += 1
    return ranks


def test_ids_of_made_up_merges_equal_the_library():
    import tiktoken

    rng = random.Random(7)
    for _ in range(30):
        ranks = made_up_merges(rng, 60)
        codec = bpe.Codec(ranks)
        other = tiktoken.Encoding("other", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for _ in range(200):
            text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 60)))
            assert list(memoryview(codec.encode(text)).cast("I")) == other.encode_ordinary(text)


def test_ranks_that_are_no_merges_are_refused():
    single = {bytes([b]): b for b in range(256)}
    with pytest.raises(ValueError, match="no list of merges"):
        bpe.Codec(single | {b"abc": 256})
    with pytest.raises(ValueError, match="without a token"):
        bpe.Codec({b"a": 0})


def test_a_full_memory_changes_nothing(plain, monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 3)
    monkeypatch.setattr(bpe, "MEMO", 5)
    codec = bpe.Codec(bpe.read_ranks(bpe.VOCABULARY))
    for text in sentences(8, 40):
        assert list(memoryview(codec.encode(text)).cast("I")) == plain.encode_ordinary(text)


def test_encode_and_decode_documents(spark, plain):
    texts = [None, "", "Hello  world", "été 中文🙂", "Hello  world", "long " * 500_000]
    docs = spark.createDataFrame([(k if k != 3 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.withColumns({"ids": F.lit(1), "decoded": F.lit("x"), "n_tokens": F.lit(None)})
    rows = bpe.decode(bpe.encode(docs)).collect()
    assert len(rows) == len(texts)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], list(memoryview(bytes(r["ids"])).cast("I")), bytes(r["decoded"])) for r in rows)
    ids = [plain.encode_ordinary(t or "") for t in texts]
    want = sorted((k == 3, k if k != 3 else 0, len(ids[k]), ids[k], (t or "").encode()) for k, t in enumerate(texts))
    assert got == want
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0


# Phrases


def mined(docs, least, top):
    counts, n = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    key = lang, tuple(words[i : i + size])
                    counts[key] = counts.get(key, 0) + 1
    candidates = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, words), a in candidates.items():
        longer = [q for (other, q), f in candidates.items() if other == lang and len(q) > len(words) and 100 * f >= 100 * a]
        if any(words == q[i : i + len(words)] for q in longer for i in range(len(q))):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


def collocated(spark, docs, least, top):
    rows = spark.createDataFrame([(k, *d) for k, d in enumerate(docs)], "doc_id long, text string, lang string")
    rows = rows.withColumns({"phrase": F.lit("p"), "score": F.lit(1), "rank": F.lit(2), "slice": F.lit(3), "f": F.lit(4)})
    return sorted(tuple(r) for r in phrases.collocations(rows.repartition(4), least, top).collect())


DOCS = [(t, lang) for lang, seed in (("en", 11), ("fr", 12), (None, 13)) for t in sentences(seed, 40)] + [
    (None, "en"), ("", "en"), (" . ,", "fr"), ("New York stock exchange. " * 9, "en"), ("NEW YORK stock exchange", "en"), ("one two three four five six " * 4, "de"), ("", ""), ("a b a b a b a b", "")]


@pytest.mark.parametrize(("least", "top"), [(3, 2000), (6, 5), (1, 50)])
def test_phrases_equal_brute_force(spark, least, top):
    assert collocated(spark, DOCS, least, top) == mined(DOCS, least, top)


def test_phrases_over_many_shards_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANGE_BYTES", 512)
    assert collocated(spark, DOCS, 4, 2000) == mined(DOCS, 4, 2000)


def test_phrases_of_nothing_and_of_a_long_text(spark):
    assert collocated(spark, [], 1, 10) == []
    assert collocated(spark, [(None, "en"), ("word", "en")], 1, 10) == []
    docs = [("x y z " * 200_000, "en"), ("x y", "en")]
    assert collocated(spark, docs, 100, 2000) == mined(docs, 100, 2000)


def test_scores_beyond_64_bits(spark):
    rows = [(10**14, 10**18, 10**15, 10**14 + 7), (123456789012, 98765432109876543, 123456789013, 234567890123), (7, 9, 2, 3)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(phrases.exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r"))).collect()]
    assert got == [1000 * a * n // (x * y) for a, n, x, y in rows]


def test_automata_unite_and_look_up():
    words = [b"a", b"b", b"c", b"d"]
    one = phrases.Automaton.build(words, np.array([[0, 1], [0, 2], [3, 0]]), np.array([5, 1, 2]))
    two = phrases.Automaton.build([b"b", b"c", b"e"], np.array([[0, 1], [2, 2]]), np.array([4, 9]))
    both = phrases.Automaton.unite([one, two, one])
    assert dict(zip(both.phrases(), both.weights.tolist())) == {b"a b": 10, b"a c": 2, b"d a": 4, b"b c": 4, b"e e": 9}
    assert [len(x) for x in both.labels] == [4, 5]  # "a b" and "a c" share their first state
    assert both.compose([[b"a", b"c"], [b"a", b"d"], [b"x", b"b"], [b"e", b"e"]]).tolist() == [2, 0, 0, 9]
    assert both.at_least(5).phrases() == [b"a b", b"e e"]
