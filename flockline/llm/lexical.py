"""Ranked lexical search with best positions (operator 11).

One pass over the texts counts the terms that queries ask for. Statistics over all
documents (N, L, df) follow from its table. Documents are then read in shards; a shard
holds an impact list for every term, its documents by falling contribution to the score.
A query reads its lists from the top, all at the same depth, and looks every document it
meets up in its other lists. That also shows where the document stands there, so each
list has a best position, up to which everything was seen, often far below the last one
read. What the lists hold just beyond their best positions bounds every unseen document;
reading stops when that bound is strictly below the k-th score, as equal scores are
ranked by id. The best k of all shards are merged.

Queries go through in blocks of bounded size, whose terms are broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.hashing import span_hashes, spans, text_chunks
from flockline.session import discard, materialize

BLOCK_BYTES = 4 << 20  # text of the queries that are answered at once
SHARD_ROWS, SHARD_POSTINGS = 8192, 4 << 20  # documents and postings of a shard's impact lists
STEP = 32  # depth that is read before the bound is looked at again

# Terms: maximal runs of ASCII letters and digits and of all other characters from U+0080 on.
_TERM = np.zeros(256, bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes of its terms in order, number of terms of each row), chunk by chunk."""
    for row, data, offsets in text_chunks(texts):
        a, b = spans(data, offsets, _TERM)
        yield row, span_hashes(data, a, b) if len(a) else np.zeros(0, "uint64"), np.diff(np.searchsorted(a, offsets))


def count_terms(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """``doc_id, n, terms, tf`` of every row with a term: all its terms, and its counts of the wanted ones.

    ``wanted`` are sorted hashes; ``terms`` are places in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            ids = batch.column(0)
            for row, hashes, counts in term_hashes(batch.column(1)):
                at = np.minimum(np.searchsorted(asked, hashes), max(len(asked) - 1, 0))
                hit = asked[at] == hashes if len(asked) else np.zeros(len(hashes), bool)
                doc = np.repeat(np.arange(len(counts)), counts)[hit]
                key, tf = np.unique(doc * max(len(asked), 1) + at[hit], return_counts=True)
                owner = key // max(len(asked), 1)
                some = np.flatnonzero(counts)
                edges = pa.array(np.append(np.searchsorted(owner, some), len(key)).astype("int32"))
                lists = [pa.ListArray.from_arrays(edges, pa.array((x).astype("int32"))) for x in (key % max(len(asked), 1), tf)]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + some)), pa.array(counts[some].astype("int64")), *lists], names=["doc_id", "n", "terms", "tf"]
                )

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, weight: np.ndarray, total: int, words: int) -> np.ndarray:
    """What an occurrence count adds to a score: w * ((10**9 * tf) div (1000 * tf + 12 * m)).

    ``m`` is 75 + (25 * n * N) div L. Past 64 bits whole Python numbers take over.
    """
    tf, n, weight = (x.astype("int64") for x in (tf, n, weight))
    if max(int(tf.max(initial=0)) * 10**9, 25 * int(n.max(initial=0)) * total) >= 1 << 62:
        tf, n, weight = tf.astype(object), n.astype(object), weight.astype(object)
    m = 75 + (25 * total * n) // words
    return (weight * ((10**9 * tf) // (1000 * tf + 12 * m))).astype("int64")


class Shard:
    """Impact lists of some documents."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, size: int, terms: int) -> None:
        self.size = size
        keep = impact > 0
        order = np.lexsort((doc[keep], -impact[keep], term[keep]))
        self.doc, self.impact = doc[keep][order], impact[keep][order]
        self.start = np.searchsorted(term[keep][order], np.arange(terms + 1))

    def best(self, terms: list[int], times: list[int], k: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, depth read): the ``k`` best of a query, equal scores by ``rank``."""
        lists = [(self.start[t], self.start[t + 1], c) for t, c in zip(terms, times) if self.start[t + 1] > self.start[t]]
        if not lists:
            return np.zeros(0, "int64"), np.zeros(0, "int64"), 0
        length = np.array([hi - lo for lo, hi, _ in lists])
        longest = int(length.max())
        direct = np.zeros((len(lists), self.size), "int64")  # direct access: a document's impact in each list,
        place = np.full((len(lists), self.size), longest)  # and its place there
        by_depth = np.full((len(lists), longest), -1)
        falling = np.zeros((len(lists), longest + 1), "int64")
        for i, (lo, hi, c) in enumerate(lists):
            docs = self.doc[lo:hi]
            by_depth[i, : hi - lo] = docs
            falling[i, : hi - lo] = direct[i, docs] = self.impact[lo:hi] * c
            place[i, docs] = np.arange(hi - lo)
        every = np.arange(len(lists))
        met = np.zeros(self.size, bool)
        seen = np.zeros((len(lists), longest + 1), bool)  # positions that were seen, by reading or looking up
        seen[:, longest] = True
        position = np.zeros(len(lists), "int64")
        found, scores = np.zeros(0, "int64"), np.zeros(0, "int64")
        depth = 0
        while depth < longest:
            step = by_depth[:, depth : depth + STEP].ravel()
            new = np.unique(step[step >= 0])
            new = new[~met[new]]
            met[new] = True
            depth += STEP
            if len(new):
                seen[every[:, None], place[:, new]] = True
                found = np.concatenate([found, new])
                scores = np.concatenate([scores, direct[:, new].sum(axis=0)])
                if len(found) > k:
                    order = np.lexsort((rank[found], -scores))[:k]
                    found, scores = found[order], scores[order]
            for i in range(len(lists)):
                while position[i] < length[i] and seen[i, position[i]]:
                    ahead = seen[i, position[i] : position[i] + 4 * STEP]
                    position[i] += len(ahead) if ahead.all() else int(ahead.argmin())
            beyond = falling[every, np.minimum(position, length)]
            if len(found) >= k and int(beyond.sum()) < int(scores.min()):
                break  # every unseen document scores at most this
        order = np.lexsort((rank[found], -scores))[:k]
        return found[order], scores[order], min(depth, longest)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of a task in shards of at most ``SHARD_ROWS`` rows and about ``SHARD_POSTINGS`` postings."""
    held, rows, postings = [], 0, 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            if rows and (rows + part.num_rows > SHARD_ROWS or postings > SHARD_POSTINGS):
                yield pa.Table.from_batches(held)
                held, rows, postings = [], 0, 0
            held.append(part)
            rows += part.num_rows
            postings += len(part.column(2).flatten())
    if held:
        yield pa.Table.from_batches(held)


def _answer(counted: DataFrame, queries: list[tuple[int, list[int], list[int]]], weights: np.ndarray, total: int, words: int, k: int) -> DataFrame:
    shared = counted.sparkSession.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        for table in _shards(batches):
            ids = table.column(0).combine_chunks()
            rank = np.empty(len(ids), "int64")
            rank[np.array(pa.compute.sort_indices(ids, null_placement="at_end"))] = np.arange(len(ids))
            n = table.column(1).to_numpy()
            lists = table.column(2).combine_chunks()
            doc = np.repeat(np.arange(len(n)), lists.value_lengths().to_numpy(zero_copy_only=False))
            term = lists.flatten().to_numpy()
            tf = table.column(3).combine_chunks().flatten().to_numpy()
            shard = Shard(term, doc, impacts(tf, n[doc], weight[term], total, words), len(n), len(weight))
            for number, terms, times in asked:
                docs, scores, _ = shard.best(terms, times, k, rank)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(docs), number)), ids.take(pa.array(docs)), pa.array(scores)], names=["query", "doc_id", "score"]
                )

    import pyarrow.compute  # noqa: F401

    return counted.mapInArrow(run, "query long, doc_id long, score long")


def _block(docs: DataFrame, items: list, k: int) -> DataFrame | None:
    """Ranked rows of one block of queries ``(item_id, text)``; None if none of them has a term."""
    spark = docs.sparkSession
    hashes = [np.zeros(0, "uint64")] * len(items)
    texts = pa.array([item["text"] or "" for item in items], pa.string())
    for row, found, counts in term_hashes(texts):
        for i, part in enumerate(np.split(found, np.cumsum(counts)[:-1])):
            hashes[row + i] = part
    wanted = np.unique(np.concatenate(hashes))
    if not len(wanted):
        return None
    counted = materialize(count_terms(docs, wanted), "counts", "zstd")
    total, words = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(wanted), "int64")
    for row in counted.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
        df[row["term"]] = row["count"]  # at most one row for each term of the block
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * int(x) + 1))) for x in df])
    queries = []
    for number, own in enumerate(hashes):
        terms, times = np.unique(np.searchsorted(wanted, own), return_counts=True)
        queries.append((number, terms.tolist(), times.tolist()))
    found = _answer(counted, queries, weights, total, words, k)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item["item_id"]) for i, item in enumerate(items)], "query long, item_id long")
    ranked = best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
    ranked = materialize(ranked, "ranked")
    discard(counted)
    return ranked


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` highest-scoring documents of every item: ``item_id, rank, doc_id, score``.

    Every row of ``docs`` is a document, repeated ids included; equal scores follow by
    doc_id, a null id last. Equal rows of ``items`` are one query, rows that share an id
    but not the text are queries of their own. Null texts have no terms; documents
    without a term count nowhere, items without one have no result. Scores are above 0.
    Texts may have any length; columns other than the ids and texts are ignored. Terms are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct()
    asked = materialize(asked, "items")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_BYTES)
    out = None
    for block in range(blocks):  # a block's queries are few and small; rows of a result never come here
        mine = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        ranked = _block(docs, sorted(mine.collect(), key=repr), k)
        if ranked is not None:
            out = ranked if out is None else out.unionByName(ranked)
    discard(asked)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def search_sql(docs: str, items: str, k: int = 20) -> str:
    """The same ranking as SQL."""
    terms = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""WITH asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({terms.format("text")}) AS term FROM {items}) GROUP BY ALL),
words AS MATERIALIZED (SELECT doc_id, {terms.format("text")} AS w FROM {docs}),
sizes AS MATERIALIZED (SELECT doc_id, len(w) AS n FROM words WHERE len(w) > 0),
stats AS MATERIALIZED (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
tfs AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, stats GROUP BY term),
impact AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS x
  FROM tfs JOIN weights USING (term) JOIN sizes USING (doc_id), stats),
scored AS (SELECT item_id, doc_id, sum(times * x)::BIGINT AS score FROM asked JOIN impact USING (term) GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM scored)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {k}"""
