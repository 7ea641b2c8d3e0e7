"""Training-data operators against brute force on small tables with odd rows."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from flockline.llm import hnsw, langid, lines, minhash, mixing, packing, reputation, suffixes, topk
from flockline.llm import components as cc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies long, shard string"


def prose(seed, n, words=40):
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, words, n))


@pytest.fixture(scope="module")
def docs(spark):
    a, b = prose(1, 300), prose(2, 120)
    near = a.split()
    near[150] = "Changed"
    half = " ".join(a.split()[:150] + b.split()[:100])
    long = "\n".join(prose(s, 30) for s in range(3, 60))
    texts = [
        a, " ".join(near), a.upper(), half, b, b, None, "", " \n\t ", "one", "ONE", "one two", "one two three four five",
        long, long + "\nlast", "a\nb\nc\nd", "x\na\nb\nc\ny", "\n\n\n\n", "ab " * 500, "été " * 200, prose(9, 2000),
    ]
    rows = [(i * 3, t, ["en", "de", None][i % 3], ["s2", None, "s1"][i % 3], None, 7, "x") for i, t in enumerate(texts)]
    rows += [rows[4], (None, a, "en", "s1", 1, 1, None), (500, prose(9, 2000), "en", "s1", 1, 1, "")]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark, docs):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingles(text):
    words = (text or "").translate(str.maketrans(mixing_upper(), mixing_upper().lower())).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def mixing_upper():
    return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@pytest.mark.parametrize("few", [50_000, 0])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(cc, "FEW", few)
    chain = [(i, i + 1) for i in range(100, 130)] + [(7, 7), (1, 130)]
    label = cc.components(spark.createDataFrame(chain, "a long, b long"))
    assert {r[1] for r in rows(label)} == {1} and label.count() == 32
    more = cc.extended(label, spark.createDataFrame([(0, 110), (900, 901)], "a long, b long"))
    assert {(r[0], r[1]) for r in rows(more) if r[0] in (0, 130, 901)} == {(0, 0), (130, 0), (901, 900)}


def test_minhash(docs, nothing):
    got = rows(minhash.near_duplicates(docs))
    have = [(r.doc_id, shingles(r.text)) for r in docs.collect()]
    assert sorted((i, n) for i, n, *_ in got if i is not None) == sorted((i, len(s)) for i, s in have if i is not None)
    group = {i: i for i, _ in have}
    for _ in have:
        for i, s in have:
            for j, t in have:
                if None not in (i, j) and s and t and 100 * len(s & t) >= 75 * len(s | t):
                    group[i] = group[j] = min(group[i], group[j])
    assert {(i, c, k) for i, _, c, k in got} == {(i, c, i is None or i == c) for i, c in group.items()}
    assert minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("small", [32, 1])
def test_minhash_finds_links_off_the_stars(spark, monkeypatch, small):
    """A path of texts: neighbours are linked, the others only through them."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [f"t{k}" for k in range(400)]
    texts = [" ".join(base[8 * k : 8 * k + 80]) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.component_id for r in minhash.near_duplicates(df).collect()} == {0}


@pytest.mark.parametrize("small", [32, 1])
def test_minhash_of_a_shared_passage(spark, monkeypatch, small):
    """Many texts share a passage and are about as similar as the bound, on both of its sides."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    passage = prose(40, 90, 5000).split()
    texts = [" ".join(passage + prose(100 + k, 10 + 3 * (k % 8), 5000).split()) for k in range(60)]
    texts += [t + " end" for t in texts[::9]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    group = list(range(len(texts)))
    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            if 100 * len(s & t) >= 75 * len(s | t):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert len(set(group)) > 5
    assert [r.component_id for r in minhash.near_duplicates(df).orderBy("doc_id").collect()] == group


def test_estimate_is_unbiased(spark):
    r = np.random.default_rng(0)
    words = [f"q{k}" for k in r.integers(0, 10**6, 900)]
    df = spark.createDataFrame([(0, " ".join(words[:600])), (1, " ".join(words[200:800]))], "doc_id long, text string")
    a, b = minhash.sketches(df).orderBy("doc_id").collect()
    pair = spark.createDataFrame([(a.sig, b.sig)], "a array<long>, b array<long>")
    found = pair.select(minhash.similarity(minhash.matches(F.col("a"), F.col("b")))).first()[0]
    true = len(shingles(" ".join(words[:600])) & shingles(" ".join(words[200:800]))) / a.n_shingles
    assert abs(found - true / (2 - true)) < 0.2


def test_mixing(docs, nothing):
    got = mixing.mix(docs).collect()
    totals = {}
    for r in got:
        assert r.taken == r.copies * r.size and r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        totals.setdefault(r.source, [0, r.target, 0])
        totals[r.source][0] += r.taken
        totals[r.source][2] = max(totals[r.source][2], r.size)
    assert all(abs(taken - target) <= most for taken, target, most in totals.values())
    assert abs(sum(t[1] for t in totals.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert sorted(map(tuple, got), key=repr) == sorted(rows(mixing.mix(docs)), key=repr)
    assert mixing.mix(nothing).count() == 0
    assert mixing.repeated(docs).columns == docs.columns


def test_mixing_without_ids(spark):
    """Rows without an id, some of them equal, are single documents of their sources."""
    own = [(None, prose(k, 4 + k % 5), "a", k) for k in range(150)] + [(None, "one two three", "a", 0)] * 90
    own += [(None, prose(k, 5), "b", k) for k in range(60)] + [(k, prose(k, 6), "b", k) for k in range(20)]
    df = spark.createDataFrame(own, "doc_id long, text string, source string, n long").repartition(7)
    got = mixing.mix(df).collect()
    assert len(got) == len(own)
    for source in ("a", "b"):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4
    want = Counter((r.doc_id, r.source, r.size) for r in got for _ in range(r.copies))
    mixed = mixing.repeated(df)
    assert mixed.columns == df.columns
    rows_of = lambda df: Counter((r.doc_id, r.source, len(r.text.split())) for r in df.collect())
    assert rows_of(mixed) == want == rows_of(mixing.repeated(df.repartition(3)))


def test_water_filling_clamps(spark):
    sources = spark.createDataFrame([("a", 10, 5.0), ("b", 100, 2.0), ("c", 1000, 1.0)], "source string, source_size long, weight double")
    got = {r.source: r.target for r in mixing.fill(sources, 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": pytest.approx(1.5 * 1110 - 220)}


def vectors(spark):
    r = np.random.default_rng(4)
    base = r.standard_normal((300, 16))
    close = base[:60] + 0.02 * r.standard_normal((60, 16))
    crowd = base[7] + 0.05 * r.standard_normal((120, 16))
    data = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, close, crowd, base[:5], 3 * base[5:9]]))]
    n = len(data)
    data += [(n, None), (n + 1, [0.0] * 16), (n + 2, [float("nan")] * 16), (n + 3, [1.0, None]), (n + 4, []), (None, [1.0] * 16)]
    data += [(n + 20, [1e300] * 16), (n + 21, [1.0] * 16), (n + 22, [1.0, 1.0]), (n + 23, [2.0, 2.0]), data[3]]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>")


def test_hnsw(spark):
    data, df = vectors(spark)
    ok = {i: np.array(v) / max(map(abs, v)) for i, v in data if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    ok = {i: v / np.linalg.norm(v) for i, v in ok.items()}
    links = {i: {j for j, w in ok.items() if i != j and len(v) == len(w) and v @ w >= 0.95} for i, v in ok.items()}
    got = hnsw.near_duplicates(df).collect()
    assert len(got) == len(data)
    assert {r.vec_id: r.n_links for r in got if r.vec_id != 3} == {i: len(links.get(i, ())) for i, _ in data if i != 3}
    least = {i: i for i in links}
    while any(least[j] < least[i] for i in links for j in links[i]):
        least |= {i: min([least[i], *(least[j] for j in links[i])]) for i in links}
    assert all(r.component_id == least.get(r.vec_id, r.vec_id) for r in got)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    by = {r.vec_id: r.component_id for r in got}
    assert by[300] == by[0] and by[360] == by[7]


def test_hnsw_recall_of_the_audited_beam():
    r = np.random.default_rng(8)
    unit = r.standard_normal((3000, 32)).astype("float32")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    graph = hnsw.Graph.build(unit)
    pos, _ = graph.search(unit, hnsw.audited_width(graph, 0.95))
    assert (pos == np.arange(3000)[:, None]).any(axis=1).mean() >= 0.99


def test_hnsw_empty(spark):
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_language(docs, nothing, spark):
    got = langid.identify(docs).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} <= {"en", "de", langid.UNKNOWN}
    assert all((r.lang_pred == langid.UNKNOWN) == (not any(c.isalpha() for c in r.text or "")) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(nothing).count() == 0
    words = {"en": ["the", "and", "with", "house", "this"], "de": ["der", "und", "nicht", "haus", "wir"]}
    r = np.random.default_rng(2)
    table = [(i, " ".join(r.choice(words[lang], 60)), lang) for i in range(60) for lang in [("en", "de")[i % 2]]]
    held = langid.identify(spark.createDataFrame(table, "doc_id long, text string, lang string")).filter("held_out")
    assert held.filter("lang = lang_pred").count() == held.count() > 5


def gram_ranks(counts):
    """The 300 most frequent grams, ties by code points with a blank's place for what is not there."""
    order = sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in g]))
    return {g: k for k, g in enumerate(order[:300])}


def gram_counts(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    line = " " + " ".join(words) + " "
    found = Counter(line[k : k + m] for m in (1, 2, 3) for k in range(len(line) - m + 1)) if words else Counter()
    del found[" "]
    return found


def test_language_equals_plain_profiles(docs, spark):
    """Label and score of every row by counters, also of a text of a megabyte."""
    words = {"en": ["the", "and", "with", "house", "this"], "de": ["der", "und", "nicht", "haus", "wir"]}
    r = np.random.default_rng(5)
    extra = [(i, " ".join(r.choice(words[lang], 30 + i)), lang) for i in range(600, 630) for lang in [("en", "de")[i % 2]]]
    extra.append((700, "the house Ünder wir 12 " * 45_000, None))
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    data = [tuple(x) for x in table.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    sums = {}
    for i, text, lang in data:
        if not held(i) and lang is not None and text is not None:
            sums.setdefault(lang, Counter()).update(gram_counts(text))
    books = {lang: gram_ranks(c) for lang, c in sums.items()}

    def said(text):
        own = gram_ranks(gram_counts(text))
        if not own:
            return "und", 0.0
        far = {lang: sum(abs(k - book[g]) if g in book else 300 for g, k in own.items()) for lang, book in books.items()}
        best = min(sorted(far), key=far.get)
        return best, round(1 - far[best] / (300 * len(own)), 9)

    got = sorted((x.doc_id or -1, x.held_out, x.lang_pred, round(x.score, 9)) for x in langid.identify(table).collect())
    assert got == sorted((i or -1, held(i), *said(text)) for i, text, _ in data)


def test_known_languages(spark):
    """Foreign prose and noise go; clean texts, short ones too, stay; nothing learned, nothing rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    clean = [r.text for r in docs.filter("lang IS NOT NULL AND length(text) > 200").orderBy("doc_id").limit(40).collect()]
    short = [" ".join(t.split()[:4]) for t in clean]
    foreign = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw, są obdarzeni rozumem i sumieniem.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan, heille on annettu järki ja omatunto.",
        " ".join(hashlib.sha256(bytes([k])).hexdigest() for k in range(40)),
    ]
    more = [(10**9 + k, t, None) for k, t in enumerate(foreign)] + [(2 * 10**9 + k, t, None) for k, t in enumerate(clean + short)]
    table = docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    scored = langid.identify(table).persist()
    kept = {r.doc_id for r in langid.known(scored).select("doc_id").collect()}
    lost = {r.doc_id: r.score for r in scored.filter("lang_pred <> 'und'").collect() if r.doc_id not in kept}
    scored.unpersist()
    assert set(lost) == {10**9, 10**9 + 1, 10**9 + 2}, lost
    unlabelled = spark.createDataFrame(more[:5], "doc_id long, text string, lang string")
    assert langid.known(langid.identify(unlabelled)).count() == 0  # nothing learned: every text is und


def test_language_profile_by_hand():
    found, n = langid.counted(langid.grams("Ab, a1b"))
    texts = {"".join(chr(int(g) >> s & 0x1FFFFF) for s in (42, 21, 0) if int(g) >> s & 0x1FFFFF): int(k) for g, k in zip(found, n)}
    line = " ab a b "
    want = Counter(line[k : k + m] for m in (1, 2, 3) for k in range(len(line) - m + 1))
    del want[" "]
    assert texts == dict(want)


@pytest.mark.parametrize("hot", [2048, 1])
def test_suffixes(docs, hot):
    have = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    width = 60
    seen = Counter(b[k : k + width] for _, b in have for k in range(len(b) - width + 1))
    want = []
    for i, b in have:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    assert sorted(rows(suffixes.dedup_substrings(docs, width, hot)), key=repr) == sorted(want, key=repr)


def test_suffixes_empty(nothing):
    assert suffixes.dedup_substrings(nothing).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 20])
def test_suffix_array(letters):
    r = np.random.default_rng(letters)
    for _ in range(10):
        data = np.append(r.integers(97, 97 + letters, 200), 255).astype("uint8")
        data[100:140] = data[20:60].copy()
        raw, depth = data.tobytes(), int(r.choice([8, 11, 20]))
        order = suffixes.suffix_array(data, depth)
        keys = [raw[k : k + depth] for k in order]
        assert sorted(order) == list(range(len(data))) and keys == sorted(keys)


def test_packing(docs, nothing):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).collect()
    stream = sorted((r.sequence_id * 1024 + r.offset, r.length) for r in got)
    assert stream[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(stream, stream[1:]))
    assert all(r.offset + r.length <= 1024 for r in got)
    ids = {r.doc_id: np.array(own.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4") for r in docs.collect()}
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
    assert sum(n for _, n in stream) == sum(len(ids[r.doc_id]) for r in docs.collect())
    assert packing.pack(nothing).count() == 0


def test_encoder_equals_the_library():
    enc = packing.encoder(packing.VOCABULARY)
    for text in ["", " ", "a", " a", "a ", "a  b", "it's  \n x\ty", "été, l'eau—ça", "a\u00a0b c", "\n", "x \u3000 y", "1 2 33"]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == enc.bpe.encode_ordinary(text)


ADDED = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "one two<|endoftext|>\n\n<|endoftext|", "it  <|endoftext|>'s 1"]


def test_encoder_of_added_tokens_equals_the_json():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(packing.VOCABULARY)
    assert np.frombuffer(enc.encode("<|endoftext|>"), "<u4").tolist() == [50256] and enc.size == own.get_vocab_size()
    for text in ADDED:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == own.encode(text, add_special_tokens=False).ids


def test_packing_of_added_tokens(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    own = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ADDED, prose(1, 900) + "<|endoftext|>" + prose(2, 900), "plain"]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    ids = [np.array(own.encode(t, add_special_tokens=False).ids + [0], "<u4") for t in texts]
    assert sum(r.length for r in got) == sum(map(len, ids))
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(part.tobytes()) == r.ids_crc32


def test_hilbert_neighbours_touch():
    side = np.arange(16)
    cells = np.stack(np.meshgrid(side, side, indexing="ij"), axis=-1).reshape(-1, 2)
    order = cells[np.argsort(packing.hilbert(cells, 4))]
    assert sorted(packing.hilbert(cells, 4)) == list(range(256)) and (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


PAGES = [
    (0, "http://A.Example.NET/en/1?x#y"), (1, "https://example.net/de/2"), (2, "x://sub.example.com/de/"), (3, "http://q.org/fr/3"),
    (4, "http://q.org"), (5, None), (6, "no url"), (7, ""), (8, "http://bad.org/x"), (9, "http://bad.org/y#z"), (10, "http://net"), (None, "http://net/"),
]


def test_url_rules(spark, monkeypatch):
    pages = spark.createDataFrame([(*p, "h") for p in PAGES], "page_id long, url string, host string")
    good = spark.createDataFrame([(8, False), (9, False), (4, True), (4, True)] + [(8, False)], "page_id long, good boolean")
    want = {0: "example.net/en/", 1: "net/", 2: "example.com/de/", 3: "org/fr/", 4: None, 5: None, 6: None, 7: None, 8: None, 9: None, 10: None, None: "net/"}
    for inline in (1000, 0):
        monkeypatch.setattr(reputation, "INLINE_RULES", inline)
        got = reputation.judge(pages, good).collect()
        assert {r.page_id: r.rule for r in got} == want
        assert {r.page_id: (r.host, r.path) for r in got if r.page_id in (0, 5, 10)} == {0: ("a.example.net", "/en/1"), 5: ("", ""), 10: ("net", "")}
    assert reputation.judge(pages.limit(0), good).count() == 0 and reputation.judge(pages, good.limit(0)).count() == len(PAGES)


def test_reputation_blocks_what_is_surely_bad(spark):
    hosts = [(i, f"http://h{i % 10}.site.com/{i}") for i in range(2000)]
    good = [(i, i % 10 != 3 or i % 100 == 3) for i in range(2000)]
    got = reputation.judge(spark.createDataFrame(hosts, "page_id long, url string"), spark.createDataFrame(good, "page_id long, good boolean"), rules=())
    assert {r.host for r in got.filter("verdict = 'block'").collect()} == {"h3.site.com"}


def test_lines(docs, nothing):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    by_id = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    seen = set()
    for i in sorted(by_id):
        text = by_id[i]
        parts = text.split("\n") if text is not None else []
        gone = set()
        for k in range(len(parts) - 2):
            if window := tuple(parts[k : k + 3]) if "".join(parts[k : k + 3]).strip() else None:
                gone |= {k, k + 1, k + 2} if window in seen else set()
                seen.add(window)
        want = "\n".join(p for k, p in enumerate(parts) if k not in gone) if text is not None else None
        assert (got[i].text, got[i].n_lines, got[i].n_removed) == (want, len(parts), len(gone))
    assert got[None].n_removed == 0 and lines.dedup_lines(nothing).count() == 0
    assert set(docs.columns) < set(lines.dedup_lines(docs).columns)


def test_lines_sql(docs):
    con = duckdb.connect()
    table = docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select("doc_id", "text").toPandas()
    con.register("d", table)
    want = con.execute(f"WITH {lines.lines_sql('d')} SELECT doc_id, n_removed FROM cleaned ORDER BY 1").fetchall()
    found = lines.dedup_lines(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).select("doc_id", "n_removed")
    assert sorted(rows(found)) == want


def test_topk(spark):
    data, df = vectors(spark)
    ok = [(i, np.floor(64 * np.array(v)).tolist()) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    ok = list({(i, tuple(min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in v)) for i, v in ok})
    want = []
    for i, v in ok:
        if i % 20 == 0:
            score = [(-sum(x * y for x, y in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)]
            want += [(i, k + 1, j, min(max(-s, -topk.END), topk.END)) for k, (s, j) in enumerate(sorted(score)[:20])]
    assert sorted(rows(topk.top_k(df))) == sorted(want)


def test_topk_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.5]) for i in range(100)] + [(200, [9.0, 9.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in topk.top_k(df, k=4).collect())
    assert [g for g in got if g[0] == 20] == [(20, 1, 200), (20, 2, 0), (20, 3, 1), (20, 4, 2)]
    assert topk.top_k(df.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as cp

    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    n = docs.count()
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert name in ("line_dedup", "source_mixture") or out.join(docs, "doc_id", "left_anti").count() == 0
        docs = cp.materialize(out, "test")
    assert 0 < docs.count() <= 2 * n and cp.run(spark, path).count() > 0


def test_near_dedup_of_rows_without_ids(spark):
    import corpus_pipeline as cp

    a, b, c, d = (prose(s, 200, 5000) for s in (50, 51, 52, 53))
    top = (1 << 63) - 1
    own = [(3, a), (None, a), (None, a + " end"), (None, b), (None, b), (None, b + " end"), (9, c), (9, c), (9, c), (top, d), (None, d), (top - 1, d + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in own], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.near_dedup(spark, df.repartition(5), "").collect()
    assert sorted((r.doc_id, r.text) for r in got if r.doc_id is not None) == [(3, a), (9, c), (top - 1, d + " end")]
    left = [r.text for r in got if r.doc_id is None]
    assert len(left) == 1 and left[0] in (b, b + " end")
    assert [r.text for r in cp.near_dedup(spark, df.repartition(2), "").collect() if r.doc_id is None] == left
    assert cp.near_dedup(spark, df.limit(0), "").columns == df.columns


def test_equal_buckets_fold(spark):
    held = {10: [1, 2, 3], 11: [1, 2, 3], 12: [1, 3], 13: [1, 2, 4, 3], 14: [5], 15: [2, 3], 9: [2, 3]}
    rows = [(key, doc) for key, docs in held.items() for doc in docs]
    got = minhash._buckets(spark.createDataFrame(rows, "key long, doc long")).collect()
    assert sorted(map(tuple, got)) == [(9, 2), (10, 1), (12, 1), (13, 1)]
