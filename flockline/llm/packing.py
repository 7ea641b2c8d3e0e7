"""Packing token sequences along a space-filling curve (operator 7).

Texts are tokenised once. A document is a vector of hashed token counts, projected to
four dimensions; its place on a Hilbert curve through them is its sort key. Light rows
(key, length) are range-sorted, running token counts turn the order into one gapless
stream, and each document's ids are cut where a sequence of 1024 is full, so only the
last sequence of a whole table is short. Token ids move once, evenly, by row id.
Ids are those of the tokenizer's JSON form, its added tokens included.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.hashing import mix, numbers
from flockline.session import discard, materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the ranks of byte_bpe_50k.json, which lists the added tokens
LENGTH, END = 1024, 0
HASHED, DIMS, BITS = 1024, 4, 10

_encoders: dict[str, "Encoder"] = {}


def added_tokens(vocabulary: str) -> dict[str, int]:
    """Ids of the tokens that the JSON form beside a rank file adds to it; that file must be there."""
    form = os.path.splitext(vocabulary)[0] + ".json"
    with open(form, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    if odd := [t["content"] for t in listed if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
        raise ValueError(f"added tokens that depend on their surroundings: {odd}")
    return {t["content"]: t["id"] for t in listed}


class Encoder:
    """Byte-level BPE; texts are cut at added tokens first, of overlapping ones at the leftmost and longest."""

    def __init__(self, vocabulary: str) -> None:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        added = added_tokens(vocabulary)
        self.added = {token: np.array([k], "<u4").tobytes() for token, k in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        self.size = max([*ranks.values(), *added.values()]) + 1
        self.bpe = tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).tobytes()

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text."""
        if any(token in text for token in self.added):
            parts = self.cut.split(text)  # every second one is an added token
            return b"".join([self.added[x] if k % 2 else self._ids(x) for k, x in enumerate(parts)])
        return self._ids(text)


def encoder(vocabulary: str) -> Encoder:
    """One encoder per worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n x dims, ``bits`` each) on a Hilbert curve.

    Works from the coarsest bit down: each step reflects or swaps axes so that the
    next finer cell is entered where the curve enters it, then Gray decoding joins
    the bits of all axes.
    """
    x = points.astype("int64").T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(dims):
            upper = (x[k] & q) != 0
            swap = np.where(upper, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(upper, low, swap)
            x[k] ^= swap
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for k in range(dims):
            out = (out << 1) | ((x[k] >> bit) & 1)
    return out


def curve_keys(vectors: np.ndarray) -> np.ndarray:
    """Hilbert keys of rows of hashed counts."""
    pairs = numbers(41, 2 * HASHED * DIMS).reshape(2, HASHED, DIMS).astype("float64") / 2.0**64
    axes = np.sqrt(-2 * np.log(pairs[0] + 1e-18)) * np.cos(2 * np.pi * pairs[1])
    unit = np.sqrt(vectors)
    norm = np.sqrt(vectors.sum(axis=1, keepdims=True))
    at = (unit / np.maximum(norm, 1e-9)) @ axes
    cells = np.clip((at + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype("int64")
    return hilbert(cells, BITS)


def tokenised(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``row_id, doc_id, key, doc_tokens, ids`` of each row; ``ids`` are packed 16- or 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        narrow = bpe.size <= 1 << 16
        slot = (mix(np.arange(bpe.size, dtype="uint64") + np.uint64(1)) % np.uint64(HASHED)).astype("int64")
        row = TaskContext.get().partitionId() << 33
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, 512):
                part = batch.slice(lo, 512)
                found, vectors = [], np.zeros((part.num_rows, HASHED))
                for k, text in enumerate(part.column(1)):
                    ids = np.frombuffer(bpe.encode(text.as_py() or "") + end, "<u4")
                    vectors[k] = np.bincount(slot[ids[:-1]], minlength=HASHED)
                    found.append(ids)
                size = [len(x) for x in found]
                packed = [x.astype("<u2").tobytes() if narrow else x.tobytes() for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + part.num_rows)),
                        part.column(0),
                        pa.array(curve_keys(vectors)),
                        pa.array(size, pa.int64()),
                        pa.array(packed, pa.binary()),
                    ],
                    names=["row_id", "doc_id", "key", "doc_tokens", "ids"],
                )
                row += part.num_rows

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return chosen.mapInArrow(run, "row_id long, doc_id long, key long, doc_tokens long, ids binary")


def along_curve(rows: DataFrame) -> DataFrame:
    """``(row_id, place)``: tokens before each row in the order of (key, scattered row id).

    Rows are range-partitioned, counted per partition and numbered inside it; a hot key
    is split, as the row id belongs to the sort key. The window over partitions has one
    row for each of them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    light = rows.select("row_id", "key", "doc_tokens", F.xxhash64("row_id").alias("tie"))
    ordered = light.repartitionByRange(n, "key", "tie").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ordered.groupBy("part").agg(F.sum("doc_tokens").alias("total"))
    starts = totals.select("part", F.coalesce(F.sum("total").over(run), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("key", "tie", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    place = F.col("start") + F.coalesce(F.sum("doc_tokens").over(inside), F.lit(0))
    return ordered.join(starts, "part").select("row_id", place.alias("place"))


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every row of ``docs`` is a document of its own, repeated ids included: its ids and one
    end id. A null or empty text is the end id alone. Sequences are gapless and, but for
    the last, full; a piece never crosses a sequence. Text that spells an added token of
    the vocabulary is that token. Columns other than doc_id and text are ignored.
    """
    rows = materialize(tokenised(docs, vocabulary), "tokens", "zstd")
    places = materialize(along_curve(rows), "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, start, size, crc, total, at = [], [], [], [], [], []
            columns = [batch.column(k) for k in range(4)]
            for doc_id, n, ids, place in zip(columns[0].to_pylist(), columns[1].to_pylist(), columns[2], columns[3].to_pylist()):
                raw = ids.as_buffer()
                wide = np.frombuffer(raw, "<u2" if raw.size == 2 * n else "<u4").astype("<u4").tobytes()
                lo = 0
                while lo < n:
                    hi = min(n, lo + length - (place + lo) % length)
                    doc.append(doc_id)
                    start.append(lo)
                    size.append(hi - lo)
                    crc.append(zlib.crc32(wide[4 * lo : 4 * hi]))
                    total.append(n)
                    at.append(place + lo)
                    lo = hi
            at = np.array(at, "int64")
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (doc, start, size, crc, total, at // length, at % length)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    # Both sides grow with the table, so they are merged at every size.
    joined = rows.join(places.hint("merge"), "row_id").select("doc_id", "doc_tokens", "ids", "place")
    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = materialize(joined.mapInArrow(cut, names), "pieces")
    discard(rows, places)
    return pieces
