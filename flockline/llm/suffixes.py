"""Repeated byte strings by suffix arrays (operator 5).

Windows of 400 bytes that occur twice are found in two steps. First, every window is
given to the 48-byte gram in it with the smallest hash; equal windows have equal grams,
so runs of windows whose gram occurs nowhere else are done. Second, the other runs meet
in shards by gram. A shard is sorted as one suffix array in two stages: suffixes smaller
than their successors directly, the rest induced from these by one scan over the byte
buckets. Windows with a common prefix of 400 bytes with a neighbour are repeated.

Grams with very many runs are settled by window digests that are counted in a shuffle,
so no shard outgrows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockline.llm.hashing import mix, numbers, powers, prefix_hash, text_chunks
from flockline.session import discard, materialize

WINDOW, GRAM = 400, 48
SHARD_BYTES = 2 << 20
HOT_RUNS = 2048  # runs of one gram above which its windows are counted by digest
_GAP = 0xFF  # never part of UTF-8
_BYTE_TABLE, _SECOND_TABLE = numbers(3, 256), numbers(5, 256)
_EMPTY = hashlib.sha256(b"").digest()


def window_hashes(data: np.ndarray, width: int, table: np.ndarray = _BYTE_TABLE) -> np.ndarray:
    """Hash of every ``width`` bytes."""
    sums = prefix_hash(data, table)
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:-width]) * powers(len(data) + 1, inverse=True)[:n]) if n > 0 else sums[:0]


def runs(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same smallest gram: (text, first start, last start, gram hash, several places).

    The smallest is by the upper half of the hash, then by place, so equal windows
    have the same gram at the same place.
    """
    none = (np.zeros(0, "int64"),) * 3 + (np.zeros(0, "uint64"), np.zeros(0, bool))
    if len(data) < window:
        return none
    hashes = window_hashes(data, gram)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype="uint64")
    span = window - gram + 1
    whole = -(-len(ranked) // span) * span
    padded = np.full(whole, np.iinfo("uint64").max)
    padded[: len(ranked)] = ranked
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(data) - window + 1
    owner = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & np.uint64(0xFFFFFFFF)).astype("int64")
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
    inside = np.arange(n) + window <= offsets[text + 1]
    start = np.flatnonzero(inside)
    if not len(start):
        return none
    owner, text = owner[start], text[start]
    key = hashes[owner]
    change = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(np.concatenate([[True], change]))
    last = np.append(first[1:], len(start)) - 1
    base = offsets[text[first]]
    return text[first], start[first] - base, start[last] - base, key[first], owner[first] != owner[last]


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes."""
    n = len(data)
    change = np.flatnonzero(data[1:] != data[:-1])
    # A suffix is smaller than its successor if the next different byte is larger; at the end it is not.
    ahead = np.searchsorted(change, np.arange(n))
    known = ahead < len(change)
    at = change[ahead[known]]
    rising = np.zeros(n, bool)
    rising[known] = data[at] < data[at + 1]
    direct = _sort_directly(data, np.flatnonzero(rising), depth)
    heads = np.searchsorted(data[direct], np.arange(257))
    queues: list[list[np.ndarray]] = [[] for _ in range(256)]
    queues[int(data[-1])].append(np.array([n - 1]))
    out = []

    def induce(found: np.ndarray, bucket: int) -> np.ndarray:
        """Hand on the falling predecessors in order; those of this bucket come back."""
        before = found[found > 0] - 1
        before = before[~rising[before]]
        byte = data[before]
        here = byte == bucket
        later, byte = before[~here], byte[~here]
        order = np.argsort(byte, kind="stable")
        later, byte = later[order], byte[order]
        edges = np.flatnonzero(np.concatenate([[True], byte[1:] != byte[:-1]])) if len(byte) else []
        for lo, hi in zip(edges, [*edges[1:], len(byte)]):
            queues[byte[lo]].append(later[lo:hi])
        return before[here]

    for bucket in range(256):
        wave = np.concatenate([*queues[bucket], np.zeros(0, "int64")]).astype("int64")
        queues[bucket] = []
        while len(wave):
            out.append(wave)
            wave = induce(wave, bucket)
        mine = direct[heads[bucket] : heads[bucket + 1]]
        if len(mine):
            out.append(mine)
            induce(mine, bucket)
    return np.concatenate(out)


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from every place as one big-endian number, zeros past the end."""
    padded = np.concatenate([data, np.zeros(8, "uint8")])
    return np.ndarray(len(data) + 1, ">u8", padded, strides=(1,))


def _sort_directly(data: np.ndarray, found: np.ndarray, depth: int) -> np.ndarray:
    """Order suffixes by eight bytes at a time, up to ``depth`` bytes or the end of their part.

    Groups whose suffixes all have one fingerprint of that length need no more rounds.
    """
    eight = _words(data)
    end = len(data)
    gaps = np.append(np.flatnonzero(data == _GAP), end - 1)
    stop = np.minimum(found + depth, gaps[np.searchsorted(gaps[:-1], found)] + 1)
    sums = prefix_hash(data, _BYTE_TABLE)
    prints = (sums[stop] - sums[found]) * powers(end + 1, inverse=True)[found] + (stop - found).astype("uint64")
    key = eight[found].astype("uint64")
    order = np.argsort(key, kind="stable")
    found, prints, key = found[order], prints[order], key[order]
    active, group, fresh = np.arange(len(found)), key, True
    for at in range(8, depth, 8):
        if fresh:  # of the groups, keep those of several suffixes that are not all equal
            edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else group
            size = np.diff(np.append(edge, len(group)))
            active, size = active[np.repeat(size > 1, size)], size[size > 1]
            edge = np.cumsum(size) - size
            mine = prints[active]
            mixed = np.minimum.reduceat(mine, edge) != np.maximum.reduceat(mine, edge) if len(size) else size > 1
            active, size = active[np.repeat(mixed, size)], size[mixed]
            edge = np.cumsum(size) - size
            name = np.repeat(np.arange(len(size)), size)
        if not len(active):
            break
        key = eight[np.minimum(found[active] + at, end)].astype("uint64")
        parted = np.minimum.reduceat(key, edge) != np.maximum.reduceat(key, edge)
        fresh = bool(parted.any())
        if fresh:
            rows = np.flatnonzero(np.repeat(parted, size))
            order = np.lexsort((key[rows], name[rows]))
            key[rows] = key[rows][order]
            places = active[rows]
            found[places], prints[places] = found[places][order], prints[places][order]
            group = np.cumsum(np.concatenate([[False], (name[1:] != name[:-1]) | (key[1:] != key[:-1])]))
    return found


def repeated(data: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which of ``starts`` (a mask over ``data``) begin a window that another of them begins, too."""
    order = suffix_array(data, window)
    order = order[starts[order]]
    eight, tail = _words(data), window % 8
    a, b = order[:-1], order[1:]
    steps = [*range(0, window - tail, 8)] + [window - 8] * bool(tail)
    for step in steps:
        same = eight[a + step] == eight[b + step]
        a, b = a[same], b[same]
    out = np.zeros(len(data), bool)
    out[a] = out[b] = True
    return out


def _prints(docs: DataFrame, window: int) -> DataFrame:
    """Per row: ``doc_id, sha, n_bytes, runs`` of the whole text."""
    schema = "doc_id long, sha binary, n_bytes long, runs array<struct<gram:long,lo:int,hi:int,several:boolean>>"
    kind = pa.struct([("gram", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("several", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes()
                n = len(offsets) - 1
                text, lo, hi, gram, several = runs(data, offsets, window)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(n + 1)).astype("int32")),
                    pa.StructArray.from_arrays(
                        [pa.array(gram.view("int64")), pa.array(lo.astype("int32")), pa.array(hi.astype("int32")), pa.array(several)],
                        fields=list(kind),
                    ),
                )
                sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, n), pa.array(sha, pa.binary()), pa.array(np.diff(offsets)), lists],
                    names=["doc_id", "sha", "n_bytes", "runs"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def _segments(texts: DataFrame, window: int, hot: bool) -> DataFrame:
    """Bytes of the candidate runs, or for hot grams a digest of each of their windows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, text, found in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = text.as_buffer()
                found = [r for r in found.as_py() if (r["shard"] < 0) == hot]
                if not found:
                    continue
                data = np.frombuffer(raw, "uint8")
                for r in found:
                    part = data[r["lo"] : r["hi"] + window]
                    n = r["hi"] - r["lo"] + 1
                    if hot:
                        columns = [
                            pa.array(window_hashes(part, window).view("int64")),
                            pa.array(window_hashes(part, window, _SECOND_TABLE).view("int64")),
                            pa.array([sha.as_py()] * n, pa.binary()),
                            pa.array(np.arange(r["lo"], r["hi"] + 1)),
                        ]
                    else:
                        columns = [pa.array([r["shard"]], pa.int64()), pa.array([sha.as_py()], pa.binary()), pa.array([r["lo"]], pa.int64()), pa.array([part.tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["a", "b", "sha", "start"] if hot else ["shard", "sha", "lo", "bytes"]
    kind = "a long, b long, sha binary, start long" if hot else "shard long, sha binary, lo long, bytes binary"
    return texts.mapInArrow(cut, kind)


def _spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype("int8"), [0]])))
    return edge[::2], edge[1::2]


def _settle(window: int):
    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        # equal parts are repeated from end to end; one of them stands for all in the array
        one = pdf["bytes"].map(pdf["bytes"].value_counts(sort=False)).to_numpy() == 1
        parts = pdf["bytes"].drop_duplicates().tolist()
        data = np.frombuffer(bytes([_GAP]).join(parts) + bytes([_GAP]), "uint8")
        size = np.array([len(p) for p in parts])
        base = np.cumsum(size + 1) - size - 1
        mark = np.zeros(len(data) + 1, "int64")
        np.add.at(mark, base, 1)
        np.add.at(mark, base + size - window + 1, -1)
        found = repeated(data, np.cumsum(mark[:-1]) > 0, window)
        lo, hi = _spans(found)  # runs of starts; each lies in one part, as starts of two parts never touch
        part = np.searchsorted(base, lo, "right") - 1
        single = pdf[one].set_index("bytes")["lo"].reindex(parts).to_numpy()  # none for parts that stand for several
        sha = pdf[one].set_index("bytes")["sha"].reindex(parts).to_numpy()
        own = ~np.isnan(single[part])
        lo, hi, part = lo[own], hi[own], part[own]
        shift = single[part].astype("int64") - base[part]
        alone = pd.DataFrame({"sha": sha[part], "lo": lo + shift, "hi": hi + shift - 1 + window})
        many = pdf[~one]
        whole = pd.DataFrame({"sha": many["sha"], "lo": many["lo"], "hi": many["lo"] + many["bytes"].str.len()})
        return pd.concat([alone, whole]).astype({"lo": "int64", "hi": "int64"})

    return shard


def _kept(texts: DataFrame) -> DataFrame:
    """``sha, n_removed, n_spans, kept_sha`` of texts with removed ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, text, spans in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw = np.frombuffer(text.as_buffer(), "uint8")
                mark = np.zeros(len(raw) + 1, "int64")
                for span in spans.as_py():
                    mark[span["lo"]] += 1
                    mark[span["hi"]] -= 1
                gone = np.cumsum(mark[:-1]) > 0
                rows.append((sha.as_py(), int(gone.sum()), len(_spans(gone)[0]), hashlib.sha256(raw[~gone].tobytes()).digest()))
            sha, removed, n, kept = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(sha, pa.binary()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(kept, pa.binary())],
                names=["sha", "n_removed", "n_spans", "kept_sha"],
            )

    return texts.mapInArrow(run, "sha binary, n_removed long, n_spans long, kept_sha binary")


def dedup_substrings(docs: DataFrame, window: int = WINDOW, hot_runs: int = HOT_RUNS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, one row per row of ``docs``.

    A text is its UTF-8 bytes (null: none). Removed is each byte covered by a string of
    ``window`` bytes that also starts anywhere else, in the same text or another; what
    is repeated is judged on the input. Texts shorter than that stay whole. Texts with an
    equal copy, repeated rows included, are removed whole without a search and stand once
    for all their copies in it. Rows without an id are texts like any other.
    """
    prints = materialize(_prints(docs, window), "prints", "zstd")
    light = prints.groupBy("sha").agg(F.count("*").alias("rows"), F.min("doc_id").alias("rep"))
    light = materialize(light, "shas")
    rep = F.col("doc_id").eqNullSafe(F.col("rep"))
    # the copies of one text share a sha; only rows of its smallest id go on
    held = prints.filter(F.size("runs") > 0).select("sha", "doc_id", "runs").join(light.select("sha", "rep"), "sha").filter(rep)
    each = held.select("sha", "doc_id", F.explode("runs").alias("r")).select("sha", "doc_id", "r.*")
    grams = each.groupBy("gram").agg(F.count("*").alias("n"), F.max("several").alias("several"))
    grams = grams.filter("n > 1 OR several").select("gram", "n")
    shared = each.join(grams, "gram")
    shared = materialize(shared.select("sha", "doc_id", "gram", "n", "lo", "hi"), "shared", "zstd")
    volume = shared.filter(F.col("n") <= hot_runs).agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    n_shards = max(1, -(-volume // SHARD_BYTES))
    shard = F.when(F.col("n") > hot_runs, -1).otherwise(F.pmod(F.xxhash64("gram"), F.lit(n_shards)))
    per_text = shared.groupBy("sha", "doc_id").agg(F.collect_set(F.struct(shard.cast("long").alias("shard"), "lo", "hi")).alias("found"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").cast("binary").alias("text"))
    texts = texts.withColumn("own", F.unhex(F.sha2("text", 256)))
    same = (F.col("own") == F.col("sha")) & F.col("id").eqNullSafe(F.col("doc_id"))
    texts = materialize(texts.join(per_text, same).select("sha", "text", "found"), "texts", "zstd")

    spans = _segments(texts, window, False).repartition(n_shards, "shard").groupBy("shard").applyInPandas(_settle(window), "sha binary, lo long, hi long")
    if not shared.filter(F.col("n") > hot_runs).isEmpty():
        digests = materialize(_segments(texts, window, True), "digests", "zstd")
        twice = digests.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
        hot = digests.join(twice, ["a", "b"]).select("sha", F.col("start").alias("lo"), (F.col("start") + window).alias("hi"))
        spans = spans.union(hot)
    marks = spans.groupBy("sha").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    single = texts.join(light.filter("rows = 1").select("sha"), "sha", "left_semi").select("sha", "text")
    kept = materialize(_kept(single.join(marks, "sha").select("sha", "text", "spans")), "kept")
    discard(shared, texts)

    whole = (F.col("rows") > 1) & (F.col("n_bytes") >= window)
    out = prints.select("doc_id", "sha", "n_bytes").join(light.select("sha", "rows"), "sha").join(kept, "sha", "left")
    out = out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.lower(F.hex(F.when(whole, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")))).alias("kept_sha256"),
    )
    out = materialize(out, "removed")
    discard(prints, light, kept)
    return out
