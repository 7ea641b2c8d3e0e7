"""Phrase collocations by weighted acyclic automata (operator 13).

Shards of text count their n-grams; sorted, these build an automaton: every n-gram adds
only the states past its common prefix with the one before it, and its last state weighs
its count. Automata are cut by prefix range, and one task unites the parts of all shards
in a range and sums equal paths' weights. Ranges are ranges of hashed paths, since one
frequent word may begin a third of all n-grams; a path is in one range and has one state
there per shard, however frequent it is. Parts of a candidate are looked up by composing
them with the automaton of their range.

An n-gram is as frequent as asked only if the two n-grams one word shorter in it are.
Words are counted first, then pairs of frequent words, then longer n-grams of frequent
pairs. Shards learn what is frequent from a Bloom filter of fixed size, which may let
rare n-grams through to the union but stops no frequent one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.hashing import mix, numbers, span_hashes, spans, text_chunks
from flockline.session import discard, materialize

SHARD_BYTES = 32 << 20  # text whose n-grams are counted together
RANGE_BYTES = 64 << 20  # text for each range of the united automata
FILTER_BITS = 1 << 26  # of the broadcast filter: 8 MB
LONGEST = 5
NO_LANG = "und"

# Pieces end at these; words are the runs of other bytes than blanks and tabs inside them.
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD = ~_ENDS
_WORD[[0x09, 0x20]] = False
_STEPS = numbers(29, LONGEST)

_ROW = "lang string, length int, slice int, automaton binary"


def path_hash(lang: str, words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of paths, given the hashes of their words column by column."""
    start = np.frombuffer(lang.encode().ljust(8, b"\0")[:8], "<u8")[0] ^ np.uint64(len(lang))
    out = np.full(len(words[0]), start, "uint64")
    with np.errstate(over="ignore"):
        for step, word in zip(_STEPS, words):
            out = mix((out ^ word) * (step | np.uint64(1)))
    return out


class Automaton:
    """A weighted acyclic automaton whose paths all have one length; symbols are words.

    States are kept layer by layer in the order of their paths. ``labels[d]`` are the
    symbols that lead into layer d, ``fans[d]`` says how many states follow each state of
    the layer above, and ``weights`` belong to the last layer.
    """

    def __init__(self, symbols: list[bytes], labels: list[np.ndarray], fans: list[np.ndarray], weights: np.ndarray) -> None:
        self.symbols, self.labels, self.fans, self.weights = symbols, labels, fans, weights

    @classmethod
    def build(cls, symbols: list[bytes], paths: np.ndarray, weights: np.ndarray) -> "Automaton":
        """From different paths in order: each adds the states past its common prefix with the one before."""
        fresh = np.ones(paths.shape, bool)
        fresh[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        labels, fans, above = [], [], np.zeros(1, "int64") if len(paths) else np.zeros(0, "int64")
        for d in range(paths.shape[1]):
            here = np.flatnonzero(fresh[:, d])
            labels.append(paths[here, d])
            fans.append(np.diff(np.append(np.searchsorted(here, above), len(here))))
            above = here
        return cls(symbols, labels, fans, weights)

    def pack(self) -> bytes:
        """Compressed bytes: a head of counts, the symbols, then every array in its smallest type."""
        words = b" ".join(self.symbols)  # a word has no blank
        arrays = [*self.labels, *self.fans, self.weights]
        small = [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in arrays]
        head = [len(self.labels), len(self.symbols), len(words)] + [n for x in small for n in (len(x), x.itemsize)]
        raw = b"".join([np.array(head, "<i8").tobytes(), words, *[x.tobytes() for x in small]])
        return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def unpack(cls, packed: pa.Buffer) -> "Automaton":
        size = int.from_bytes(packed[:8].to_pybytes(), "little")
        raw = memoryview(pa.decompress(packed[8:], size, "zstd"))
        depth, symbols, words = np.frombuffer(raw, "<i8", 3).tolist()
        shapes = np.frombuffer(raw, "<i8", 4 * depth + 2, 24).reshape(-1, 2).tolist()
        at = 24 + 8 * (4 * depth + 2)
        spelled = bytes(raw[at : at + words]).split(b" ") if symbols else []
        at += words
        arrays = []
        for n, width in shapes:
            arrays.append(np.frombuffer(raw, f"<u{width}", n, at).astype("int64"))
            at += n * width
        return cls(spelled, arrays[:depth], arrays[depth:-1], arrays[-1])

    def paths(self) -> np.ndarray:
        """All paths in order, as rows of symbol numbers."""
        columns: list[np.ndarray] = []
        for label, fan in zip(self.labels, self.fans):
            columns = [np.repeat(column, fan) for column in columns] + [label]
        return np.stack(columns, axis=1)

    @classmethod
    def unite(cls, parts: list["Automaton"]) -> "Automaton":
        """The union; equal paths' weights are summed."""
        symbols = sorted({word for part in parts for word in part.symbols})
        number = {word: k for k, word in enumerate(symbols)}
        renamed = [np.array([number[word] for word in part.symbols], "int64")[part.paths()] for part in parts]
        paths, weights = np.concatenate(renamed), np.concatenate([part.weights for part in parts])
        order = np.lexsort(paths.T[::-1])
        paths, weights = paths[order], weights[order]
        first = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1))) if len(paths) else np.zeros(0, "int64")
        return cls.build(symbols, paths[first], np.add.reduceat(weights, first) if len(first) else weights)

    def at_least(self, least: int) -> "Automaton":
        """The paths of at least a weight, and the symbols on them."""
        kept = self.weights >= least
        paths = self.paths()[kept]
        used, number = np.unique(paths, return_inverse=True)
        return self.build([self.symbols[k] for k in used], number.reshape(paths.shape), self.weights[kept])

    def compose(self, phrases: list[list[bytes]]) -> np.ndarray:
        """The weight of each phrase, all walking from state to state together; 0 where one falls off."""
        number = {word: k for k, word in enumerate(self.symbols)}
        state, good = np.zeros(len(phrases), "int64"), np.ones(len(phrases), bool)
        for d, (label, fan) in enumerate(zip(self.labels, self.fans)):
            arcs = np.repeat(np.arange(len(fan)), fan) * (len(self.symbols) + 1) + label
            symbol = np.array([number.get(phrase[d], len(self.symbols)) for phrase in phrases], "int64")
            wanted = state * (len(self.symbols) + 1) + symbol
            state = np.minimum(np.searchsorted(arcs, wanted), max(len(arcs) - 1, 0))
            good &= arcs[state] == wanted if len(arcs) else False
        return np.where(good, self.weights[state] if len(self.weights) else 0, 0)

    def hashes(self, lang: str) -> np.ndarray:
        words = _word_hashes(self.symbols)
        return path_hash(lang, list(words[self.paths()].T))

    def phrases(self) -> list[bytes]:
        return [b" ".join([self.symbols[k] for k in path]) for path in self.paths().tolist()]


def _word_hashes(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum([len(word) for word in words], dtype="int64")
    data = np.frombuffer(b"".join(words), "uint8")
    return span_hashes(data, ends - np.diff(ends, prepend=0), ends) if len(words) else np.zeros(0, "uint64")


def _rows(found: list[tuple[str, int, int, Automaton]]) -> pa.RecordBatch:
    langs, lengths, slices, automata = zip(*found)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(langs, pa.string()),
            pa.array(lengths, pa.int32()),
            pa.array(slices, pa.int32()),
            pa.array([x.pack() for x in automata], pa.binary()),
        ],
        names=["lang", "length", "slice", "automaton"],
    )


def _read(batch: pa.RecordBatch | pa.Table, row: int) -> Automaton:
    return Automaton.unpack(batch.column("automaton")[row].as_buffer())


class Bloom:
    """Paths of one pass that are frequent, and few others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for bit in (hashes & np.uint64(FILTER_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)):
            out &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom(automata: DataFrame) -> Bloom:
    """The filter of all paths of some automata: numbers of at most ``FILTER_BITS`` bits come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes = _read(batch, row).hashes(batch.column("lang")[row].as_py())
                bits = np.concatenate([hashes & np.uint64(FILTER_BITS - 1), (hashes >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)])
                mask = np.uint64(1) << (bits & np.uint64(63))
                yield pa.RecordBatch.from_arrays(
                    [pa.array((bits >> np.uint64(6)).astype("int64")), pa.array(mask.view("int64"))], names=["word", "mask"]
                )

    bits = automata.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    words = np.zeros(FILTER_BITS // 64, "uint64")
    for batch in bits.toArrow().to_batches():
        words[batch.column(0).to_numpy()] = batch.column(1).to_numpy().view("uint64")
    return Bloom(words)


class _Words:
    """The words of one language in a shard: hashes in order, and whether a piece begins."""

    def __init__(self) -> None:
        self.hashes, self.begins, self.spots, self.data, self.sizes = [], [], [], [], []

    def read(self, texts: pa.Array) -> None:
        for _, data, offsets in text_chunks(texts):
            a, b = spans(data, offsets, _WORD)
            if not len(a):
                continue
            ends = np.cumsum(_ENDS[data])[a] + np.searchsorted(offsets, a, "right")  # grows with every end of a piece or text
            begins = np.ones(len(a), bool)
            begins[1:] = ends[1:] != ends[:-1]
            self.hashes.append(span_hashes(data, a, b))
            self.begins.append(begins)
            self.spots.append((a, b))
            self.data.append(data)

    def grams(self, lang: str, lengths: tuple[int, ...], seen: Bloom | None) -> Iterator[tuple[np.ndarray, Automaton]]:
        """(path hashes, automaton) of each asked length that occurs."""
        if not self.hashes:
            return
        hashes, begins = np.concatenate(self.hashes), np.concatenate(self.begins)
        distinct, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        word = word.astype("int32")
        open_ = np.ones(len(hashes), bool)  # places where an n-gram of the last length may be frequent
        if lengths[0] == 2:
            open_ = seen.holds(path_hash(lang, [distinct]))[word]
        elif lengths[0] > 2:
            pair = np.flatnonzero(~begins[1:])
            open_[:] = False
            open_[pair] = seen.holds(path_hash(lang, [hashes[pair], hashes[pair + 1]]))
        used = np.zeros(len(distinct), bool)
        places = []
        for length in lengths:
            at = np.flatnonzero(open_)
            if length > 1:  # an n-gram needs both that are one shorter, in one piece
                at = at[at + length <= len(hashes)]
                at = at[open_[at + 1] & ~begins[at + length - 1]] if length > 2 else at[open_[at + 1] & ~begins[at + 1]]
                open_[:] = False
                open_[at] = True
            if not len(at):
                break
            places.append((length, at))
            for k in range(length):
                used[word[at + k]] = True
        chosen = np.flatnonzero(used)
        spelled = self._spelled(first[chosen])
        order = sorted(range(len(chosen)), key=spelled.__getitem__)
        number = np.zeros(len(distinct), "int32")
        number[chosen[order]] = np.arange(len(chosen))
        symbols = [spelled[k] for k in order]
        named, own = number[word], distinct[chosen[order]]
        del hashes, word, open_
        for length, at in places:
            paths = np.stack([named[at + k] for k in range(length)], axis=1)
            paths = paths[np.lexsort(paths.T[::-1])]
            at = np.flatnonzero(np.append(True, (paths[1:] != paths[:-1]).any(axis=1)))
            weights = np.diff(np.append(at, len(paths)))
            paths = paths[at]
            yield path_hash(lang, list(own[paths].T)), Automaton.build(symbols, paths, weights)

    def _spelled(self, places: np.ndarray) -> list[bytes]:
        """Lower-cased bytes of the words at some places of the shard."""
        ends = np.cumsum([len(a) for a, _ in self.spots])
        chunk = np.searchsorted(ends, places, "right")
        inside = places - np.append(0, ends)[chunk]
        out = []
        for c, k in zip(chunk.tolist(), inside.tolist()):
            a, b = self.spots[c]
            out.append(self.data[c][a[k] : b[k]].tobytes().lower())
        return out


def _cut(lang: str, hashes: np.ndarray, automaton: Automaton, slices: int) -> list[tuple[str, int, int, Automaton]]:
    """The automaton cut into the ranges of its paths' hashes."""
    part = (hashes >> np.uint64(33)).astype("int64") * slices >> 31
    order = np.argsort(part, kind="stable")
    paths, weights, length = automaton.paths(), automaton.weights, len(automaton.labels)
    edges = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)) if len(order) else []
    out = []
    for lo, hi in zip(edges, [*edges[1:], len(order)]):
        rows = np.sort(order[lo:hi])
        used, number = np.unique(paths[rows], return_inverse=True)
        some = Automaton.build([automaton.symbols[k] for k in used], number.reshape(-1, length), weights[rows])
        out.append((lang, length, int(part[rows[0]]), some))
    return out


def count_shards(docs: DataFrame, lengths: tuple[int, ...], seen: Bloom | None, slices: int) -> DataFrame:
    """Automata of the n-grams of every shard, cut by range."""
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    def shard(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        langs = table.column(0).combine_chunks()
        for lang in langs.unique().to_pylist():
            texts = table.column(1).filter(pa.compute.equal(langs, lang))
            words = _Words()
            for chunk in texts.chunks:
                words.read(chunk)
            for hashes, automaton in words.grams(lang, lengths, shared.value):
                cut = _cut(lang, hashes, automaton, slices)
                for lo in range(0, len(cut), 256):
                    yield _rows(cut[lo : lo + 256])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                held.append(batch.slice(lo, 1024))
                size += sum(x.as_buffer().size for x in held[-1].column(1))
                if size >= SHARD_BYTES:
                    yield from shard(held)
                    held, size = [], 0
        if held:
            yield from shard(held)

    import pyarrow.compute  # noqa: F401

    return docs.mapInArrow(run, _ROW)


def unite_ranges(shards: DataFrame, least: int, slices: int) -> DataFrame:
    """One automaton for each range with the paths of at least ``least``, and ``total``, the weight of all its paths."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        whole = Automaton.unite([_read(table, row) for row in range(table.num_rows)])
        lang, length, part = (x.as_py() for x in key)
        batch = _rows([(lang, length, part, whole.at_least(least))])
        return pa.Table.from_batches([batch]).append_column("total", pa.array([int(whole.weights.sum())], pa.int64()))

    dealt = shards.repartition(max(slices, 1), "lang", "length", "slice")
    return dealt.groupBy("lang", "length", "slice").applyInArrow(run, f"{_ROW}, total long")


def _count(docs: DataFrame, lengths: tuple[int, ...], least: int, seen: Bloom | None, slices: int) -> DataFrame:
    return materialize(unite_ranges(count_shards(docs, lengths, seen, slices), least, slices), "united", "zstd")


def candidates(automata: DataFrame, slices: int) -> DataFrame:
    """``lang, phrase, a, words`` of every path, and its ``parts``: ``k, left, at_left, right, at_right``, each with its range."""
    part = "struct<k:int, left:binary, left_slice:int, right:binary, right_slice:int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found, lang = _read(batch, row), batch.column("lang")[row].as_py()
                paths = found.paths()
                words, length = _word_hashes(found.symbols)[paths], paths.shape[1]
                spelled = [[found.symbols[k] for k in path] for path in paths.tolist()]
                place = lambda lo, hi: ((path_hash(lang, list(words[:, lo:hi].T)) >> np.uint64(33)).astype("int64") * slices >> 31).tolist()
                cuts = [(k, place(0, k), place(k, length)) for k in range(1, length)]
                parts = [
                    [
                        {"k": k, "left": b" ".join(p[:k]), "left_slice": x[i], "right": b" ".join(p[k:]), "right_slice": y[i]}
                        for k, x, y in cuts
                    ]
                    for i, p in enumerate(spelled)
                ]
                kind = pa.struct([("k", pa.int32()), ("left", pa.binary()), ("left_slice", pa.int32()), ("right", pa.binary()), ("right_slice", pa.int32())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(paths), pa.string()),
                        pa.array([b" ".join(p) for p in spelled], pa.binary()),
                        pa.array(found.weights, pa.int64()),
                        pa.array(np.full(len(paths), length, "int32")),
                        pa.array(parts, pa.list_(kind)),
                    ],
                    names=["lang", "phrase", "a", "words", "parts"],
                )

    return automata.filter("length > 1").mapInArrow(run, f"lang string, phrase binary, a long, words int, parts array<{part}>")


def part_counts(parts: DataFrame, automata: DataFrame) -> DataFrame:
    """``lang, part, f``: counts of phrases (``lang, length, slice, part``) by composition with the automaton of their range."""

    def run(key: tuple, asked: pa.Table, automaton: pa.Table) -> pa.Table:
        phrases = asked.column("part").to_pylist()
        weights = _read(automaton, 0).compose([p.split(b" ") for p in phrases]) if automaton.num_rows else np.zeros(len(phrases), "int64")
        return pa.table({"lang": asked.column("lang"), "part": asked.column("part"), "f": pa.array(weights, pa.int64())})

    keys = ["lang", "length", "slice"]
    return parts.groupBy(*keys).cogroup(automata.drop("total").groupBy(*keys)).applyInArrow(run, "lang string, part binary, f long")


def exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)); the products may have 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    top = (F.lit(1000).cast("decimal(4,0)") * wide(a)).cast("decimal(19,0)") * wide(n)
    return F.call_function("div", top.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def collocations(docs: DataFrame, least: int = 100, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the phrases of 2 to 5 words, ranked within each language.

    ``least`` is the count that makes a phrase a candidate; ``top`` ends each language's
    ranks. Every row of ``docs`` counts, repeated ids included. A null text
    has no words, a null lang is ``und``; texts may have any length, and other columns are
    ignored. Words are numbered by 64-bit hashes inside a shard; automata hold their bytes.
    """
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    text = F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b""))
    rows = docs.select(lang, text.alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slices = 1 + size // RANGE_BYTES
    words = _count(rows, (1,), least, None, slices)
    pairs = _count(rows, (2,), least, bloom(words), slices)
    longer = _count(rows, tuple(range(3, LONGEST + 1)), least, bloom(pairs), slices)
    totals = words.groupBy("lang").agg(F.sum("total").alias("n"))
    automata = words.unionByName(pairs).unionByName(longer)
    chosen = materialize(candidates(automata, slices), "candidates", "zstd")
    cuts = chosen.select("lang", "phrase", "a", "words", F.inline("parts"))
    number = lambda size, part: F.struct(size.cast("int").alias("length"), F.col(f"{part}_slice").alias("slice"), F.col(part).alias("part"))
    both = F.array(number(F.col("k"), "left"), number(F.col("words") - F.col("k"), "right"))
    asked = cuts.select("lang", F.explode(both).alias("p")).select("lang", "p.*").distinct()
    counts = materialize(part_counts(asked, automata), "parts")
    found = cuts.join(counts.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    found = found.join(counts.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    found = materialize(found.select("lang", "phrase", "a", "words", "k", "left", "l", "right", "r"), "cuts")
    whole = F.col("words") > 2
    # A longer phrase of the same count stands for what is one word shorter, and so on down.
    inner = found.filter(whole & (F.col("k") == F.col("words") - 1) & (F.col("l") <= F.col("a"))).select("lang", F.col("left").alias("phrase"))
    inner = inner.union(found.filter(whole & (F.col("k") == 1) & (F.col("r") <= F.col("a"))).select("lang", F.col("right").alias("phrase")))
    scored = found.join(F.broadcast(totals), "lang").withColumn("score", exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    lowest = F.min_by(F.struct("score", "l", "r"), F.struct("score", "k")).alias("s")
    best = scored.groupBy("lang", "phrase", "a", "n").agg(lowest).join(inner.distinct(), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("s.score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long"))
    ranked = ranked.filter(F.col("rank") <= top)
    out = materialize(
        ranked.select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "s.l", "s.r", "n", "s.score"), "collocations"
    )
    discard(words, pairs, longer, chosen, counts, found)
    return out


def collocations_sql(docs: str, least: int = 100, top: int = 2000) -> str:
    """The same rules as SQL: all n-grams are listed."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS size, list_slice(w, i, i + {k - 1}) AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM pieces WHERE len(w) >= {k})"
        for k in range(1, LONGEST + 1)
    )
    return rf"""WITH split AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM {docs}),
pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
grams AS ({grams}),
freq AS MATERIALIZED (SELECT lang, size, p, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM freq WHERE size = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, size, p, f AS a FROM freq WHERE size > 1 AND f >= {least}),
cuts AS (SELECT c.lang, c.p, c.a, k, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c JOIN freq x ON x.lang = c.lang AND x.p = list_slice(c.p, 1, k)
  JOIN freq y ON y.lang = c.lang AND y.p = list_slice(c.p, k + 1, c.size) JOIN totals t ON t.lang = c.lang),
low AS (SELECT lang, p, a, arg_min({{'l': l, 'r': r, 'n': n, 'score': score}}, row(score, k)) AS s FROM cuts GROUP BY ALL),
inside AS (SELECT lang, list_slice(p, i, i + m - 1) AS p, max(a) AS longer FROM
  (SELECT lang, p, a, size, m, unnest(range(1, size - m + 2)) AS i FROM (SELECT *, unnest(range(2, size)) AS m FROM cand WHERE size > 2)) GROUP BY 1, 2),
kept AS (SELECT low.* FROM low LEFT JOIN inside USING (lang, p) WHERE longer IS NULL OR longer < a),
ranked AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, s.l AS l, s.r AS r, s.n AS n, s.score::BIGINT AS score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) WHERE rank <= {top}"""
