"""Near-duplicate documents by b-bit MinHash (operator 1).

One pass over the texts keeps, per document, the minima of 128 hash functions:
as keys of 32 bands of four full minima, and as the low two bits of each minimum
packed into four longs. Documents with equal shingle sets fold to the smallest id
first, so hot groups of copies never meet. Documents that share a band are
candidates; the packed bits estimate their similarity, corrected for the one in
four minima that agree by chance, and clearly different ones go. What is left is
confirmed on the full shingle sets, one home set at a time.

Within a band only stars are compared: first around the smallest id, then around
the best-linked one, and at last members of what is still apart: pairs of small
buckets, and blocks of large ones, whose tasks confirm links on full sets themselves
and pass on no more than join components. No large group is listed in pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockline.llm.components import components, extended
from flockline.llm.hashing import mix, numbers, shingle_sets
from flockline.session import discard, materialize

HASHES, ROWS, BITS = 128, 4, 2
SLOT = 256  # members compared with one copy of a home set
SMALL = 32  # members of a bucket whose pairs are listed in the last round
BLOCK, BLOCK_SHINGLES = 512, 2_000_000  # members and shingles of a larger bucket in one block
_EACH = (1 << 64) // 3  # 0101...: one bit for each field of two


@dataclass(frozen=True)
class Near:
    """Shingle width and the least similarity, as a whole percentage."""

    width: int = 5
    percent: int = 75

    @property
    def least_match(self) -> int:
        """Equal minima below which a pair with the least similarity falls once in over a million cases."""
        chance = 0.5**BITS
        p = chance + (1 - chance) * self.percent / 100
        return int(HASHES * p - 5 * (HASHES * p * (1 - p)) ** 0.5)


_SKETCH = "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>"


def _minima(found: np.ndarray, flips: np.ndarray, factors: np.ndarray) -> np.ndarray:
    x = (found >> np.uint64(32)).astype("uint32")
    out = np.full(HASHES, 0xFFFFFFFF, "uint32")
    for lo in range(0, len(x), 2048):
        y = np.bitwise_xor.outer(flips, x[lo : lo + 2048])
        y *= factors[:, None]
        np.minimum(out, y.min(axis=1), out=out)
    return out


def sketches(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """One row per document with its set size, a 128-bit fingerprint of the set, packed low bits and band keys."""
    width = near.width

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = numbers(23, 2 * HASHES)
        flips = seeds[:HASHES].astype("uint32")
        factors = seeds[HASHES:].astype("uint32") | np.uint32(1)
        bands = numbers(29, HASHES // ROWS)
        shift = np.arange(0, 64, BITS, dtype="uint64")
        for batch in batches:
            n = batch.num_rows
            size = np.zeros(n, "int64")
            sets, mins = np.zeros((n, 2), "uint64"), np.zeros((n, HASHES), "uint32")
            for row, found in shingle_sets(batch.column(1), width):
                if len(found):
                    size[row] = len(found)
                    sets[row] = mix(found).sum(), mix(found ^ _FLIP).sum()
                    mins[row] = _minima(found, flips, factors)
            wide = mix(mins.astype("uint64") + np.uint64(1))
            low = (wide & np.uint64((1 << BITS) - 1)).reshape(n, HASHES * BITS // 64, 64 // BITS)
            packed = (low << shift).sum(axis=2, dtype="uint64")
            key = np.broadcast_to(bands, (n, len(bands))).copy()
            for k in range(ROWS):
                key = mix((key ^ wide[:, k::ROWS]) * _ODD)
            used = size > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(size),
                    pa.array(sets[:, 0].view("int64")),
                    pa.array(sets[:, 1].view("int64")),
                    _lists(packed, used),
                    _lists(key, used),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sketch, _SKETCH)


_FLIP, _ODD = np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0x9FB21C651E98DF25)


def _lists(rows: np.ndarray, used: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(used * rows.shape[1])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[used].ravel().view("int64")))


def matches(a: Column, b: Column) -> Column:
    """How many of the packed minima agree."""
    total = F.lit(HASHES)
    for k in range(HASHES * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        odd = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(_EACH))
        total = total - F.bit_count(odd)
    return total


def similarity(match: Column) -> Column:
    """Jaccard similarity from agreeing low bits, corrected for chance agreement."""
    chance = 0.5**BITS
    return (match / HASHES - chance) / (1 - chance)


def confirm(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """The pairs ``(a, b)`` that are similar enough on full shingle sets.

    ``a`` is home: its text goes once to each slot of at most about 256 partners
    and is held while their texts stream past, so a hot home is spread over tasks.
    """
    slots = pairs.groupBy("a").agg(F.ceil(F.count("*") / SLOT).alias("slots"))
    slotted = pairs.join(slots, "a").select("a", "b", F.pmod(F.xxhash64("b"), "slots").alias("slot"))
    probes = slotted.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "slot", F.lit(1).alias("kind"), "b", "text")
    homes = slots.join(texts.withColumnRenamed("doc_id", "a"), "a")
    homes = homes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot"), "text")
    homes = homes.select("a", "slot", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    width, percent = near.width, near.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, held = (None, None), np.zeros(0, "uint64")
        for batch in batches:
            a, slot, kind, b = (batch.column(k).to_pylist() for k in range(4))
            keep = np.zeros(batch.num_rows, bool)
            for row, found in shingle_sets(batch.column(4), width):
                if kind[row] == 0:
                    home, held = (a[row], slot[row]), found
                elif home == (a[row], slot[row]) and len(held) and len(found):
                    small, large = sorted((held, found), key=len)
                    at = np.searchsorted(large, small)
                    at[at == len(large)] = 0
                    both = int((large[at] == small).sum())
                    keep[row] = 100 * both >= percent * (len(held) + len(found) - both)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"])
            yield out.filter(pa.array(keep))

    return (
        homes.union(probes)
        .repartition("a", "slot")
        .sortWithinPartitions("a", "slot", "kind")
        .mapInArrow(compare, "a long, b long")
    )


def _bucket_pairs(members: DataFrame, near: Near) -> DataFrame:
    """Pairs of one small bucket, of different components, whose packed bits allow a link."""
    side = lambda name: members.select("key", F.struct("doc", "component", "sig").alias(name))
    x, y = F.col("x"), F.col("y")
    alike = (x["component"] != y["component"]) & (matches(x["sig"], y["sig"]) >= near.least_match)
    found = side("x").join(side("y"), "key").filter((x["doc"] < y["doc"]) & alike)
    return found.select(x["doc"].alias("a"), y["doc"].alias("b")).distinct()


class _Home:
    """One block of a bucket in a task: packed bits, shingles with their owners, and components joined so far."""

    def __init__(self, near: Near) -> None:
        self.near, self.rows, self.sets = near, [], []
        self.up: dict[int, int] = {}

    def add(self, doc: int, component: int, sig: np.ndarray, found: np.ndarray) -> None:
        self.rows.append((doc, component, sig))
        self.sets.append(found)

    def close(self) -> None:
        doc, component, sig = zip(*self.rows)
        self.doc, self.at, self.sig = np.array(doc, "int64"), np.array(component, "int64"), np.stack(sig)
        self.size = np.array([len(x) for x in self.sets], "int64")
        flat, owner = np.concatenate(self.sets), np.repeat(np.arange(len(doc)), self.size)
        order = np.argsort(flat, kind="stable")
        self.owner = owner[order]
        self.known, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))

    def _root(self, component: int) -> int:
        while component in self.up:
            component = self.up[component]
        return component

    def _shared(self, found: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with every set of the block."""
        if not len(self.known):
            return np.zeros(len(self.doc), "int64")
        spot = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
        spot = spot[self.known[spot] == found]
        n = self.first[spot + 1] - self.first[spot]
        at = np.repeat(self.first[spot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.doc))

    def links(self, doc: int, component: int, sig: np.ndarray, found: np.ndarray) -> list[int]:
        """Members of the block that are linked with a document, one of each component not yet joined with it."""
        root = self._root(component)
        x = self.sig ^ sig
        differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(_EACH)).sum(axis=1, dtype="int64")
        rough = (self.at != root) & (HASHES - differ >= self.near.least_match)
        if not rough.any():
            return []
        both = self._shared(found)
        out = []
        for k in np.flatnonzero(rough & (both > 0) & (100 * both >= self.near.percent * (self.size + len(found) - both))):
            other = int(self.at[k])
            if other != root:
                out.append(int(self.doc[k]))
                self.up[other] = root
                self.at[self.at == other] = root
        return out


def _block_links(members: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    """Links ``(a, b)`` that join different components of large buckets, confirmed on full shingle sets.

    ``members (key, doc, component, sig, n_shingles)``. A bucket is cut into blocks of about
    512 members and two million shingles, and every two blocks meet in one task, which holds one
    and lets the other stream past. It passes on at most one link for each component
    that it joins, however many pairs there are.
    """
    weight = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    chunks = members.groupBy("key").agg(weight.alias("chunks"))
    cut = members.join(chunks, "key").withColumn("chunk", F.pmod(F.xxhash64("doc"), "chunks"))
    cut = cut.join(texts.withColumnRenamed("doc_id", "doc"), "doc")
    payload = ["doc", "component", "sig", "text"]
    zero = F.lit(0).cast("long")
    here = F.col("chunk")
    homes = cut.select("key", here.alias("i"), F.explode(F.sequence(here, F.col("chunks") - 1)).alias("j"), F.lit(0).alias("kind"), *payload)
    probes = cut.select("key", F.explode(F.sequence(zero, here)).alias("i"), here.alias("j"), F.lit(1).alias("kind"), *payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, home, closed = None, _Home(near), False
        for batch in batches:
            key, i, j, kind, doc, component = (batch.column(k).to_pylist() for k in range(6))
            sig = batch.column(6).flatten().to_numpy().view("uint64").reshape(batch.num_rows, -1)
            a, b = [], []
            for row, found in shingle_sets(batch.column(7), near.width):
                if place != (key[row], i[row], j[row]):
                    place, home, closed = (key[row], i[row], j[row]), _Home(near), False
                if kind[row] == 0:
                    home.add(doc[row], component[row], sig[row], found)
                elif home.rows:
                    if not closed:
                        home.close()
                        closed = True
                    linked = home.links(doc[row], component[row], sig[row], found)
                    a += linked
                    b += [doc[row]] * len(linked)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cells = homes.union(probes).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "kind")
    return cells.mapInArrow(run, "a long, b long")


def _buckets(banded: DataFrame) -> DataFrame:
    """Buckets ``(key, pivot)`` of several documents, one of those that hold the same documents.

    Alike documents share many bands, and each such bucket would bring the same pairs. Equal
    buckets agree in size, both ends and 96 bits of sums over their members.
    """
    member = F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc"), 32)
    same = {"last": F.max("doc"), "n": F.count("*"), "x": F.bit_xor(F.xxhash64("doc")), "y": F.sum(member)}
    found = banded.groupBy("key").agg(F.min("doc").alias("pivot"), *(v.alias(k) for k, v in same.items()))
    return found.filter("pivot < last").groupBy("pivot", *same).agg(F.min("key").alias("key")).select("key", "pivot")


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """Classes of near-duplicate documents: ``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``.

    Words are runs of anything but space, tab to carriage return, with A-Z lower-cased.
    Documents are linked when their sets of five-word shingles have a Jaccard similarity
    of at least 75 per cent; a class is what links reach, named by its smallest id, and
    that document is kept. Null, empty and blank texts have no shingle and are classes of
    their own; texts of one to four words are one shingle. Sets are compared as sets of
    64-bit hashes, equal sets as 128-bit sums of them. Repeated rows of one id are one
    document; rows without an id are kept and belong to no class. Other columns are ignored.
    """
    sketch = materialize(sketches(docs, near), "sketches")
    some = sketch.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["set_a", "set_b", "n_shingles"]
    sets = some.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    sets = materialize(sets, "sets")
    bits = sets.select(F.col("rep").alias("doc"), "sig", "n_shingles")

    banded = sets.select(F.col("rep").alias("doc"), F.explode("bands").alias("key"))
    members = materialize(banded.join(_buckets(banded), "key"), "members")
    needed = members.select(F.col("doc").alias("doc_id")).distinct()
    whole = docs.select(F.col("doc_id").cast("long"), "text")
    # Both sides grow with the table, so they are merged at every size.
    texts = materialize(whole.join(needed.hint("merge"), "doc_id", "left_semi"), "texts", "zstd")

    def candidates(pairs: DataFrame) -> DataFrame:
        ends = [bits.select(F.col("doc").alias(c), F.col("sig").alias(f"sig_{c}")) for c in ("a", "b")]
        found = pairs.distinct().join(ends[0], "a").join(ends[1], "b")
        return found.filter(matches(F.col("sig_a"), F.col("sig_b")) >= near.least_match).select("a", "b")

    tried = materialize(candidates(members.filter("doc <> pivot").select(F.col("pivot").alias("a"), F.col("doc").alias("b"))), "pairs")
    links = materialize(confirm(tried, texts, near), "links")
    label = materialize(components(links), "label")

    def apart(among: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components, with the size of their bucket."""
        own = label.withColumnRenamed("id", "doc")
        labelled = among.select("key", "doc").join(own, "doc", "left")
        labelled = materialize(labelled.select("key", "doc", F.coalesce("component_id", "doc").alias("component")), "labelled")
        mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
        out = materialize(labelled.join(mixed.filter("lo < hi").select("key", "n"), "key"), "apart")
        discard(labelled)
        return out

    left = apart(members)
    if not left.isEmpty():
        degree = links.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").count()
        ranked = left.join(degree, "doc", "left").withColumn("count", F.coalesce("count", F.lit(0)))
        order = F.struct("count", (-F.col("doc")).alias("minus"), "doc", F.col("component").alias("home"))
        top = ranked.groupBy("key").agg(F.max(order).alias("top"))
        stars = left.join(top.select("key", F.col("top.doc").alias("a"), "top.home"), "key")
        stars = stars.filter("component <> home").select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b"))
        fresh = materialize(candidates(stars.join(tried, ["a", "b"], "left_anti")), "pairs")
        more = materialize(confirm(fresh, texts, near), "links")
        if not more.isEmpty():
            label = extended(label, more)
            before, left = left, apart(left)
            discard(before)
        if not left.isEmpty():
            whole_bits = left.join(bits, "doc")
            large = F.col("n") > SMALL
            blocks = materialize(_block_links(whole_bits.filter(large).drop("n"), texts, near), "links")
            pairs = _bucket_pairs(whole_bits.filter(~large), near)
            pairs = materialize(pairs.join(tried.union(fresh), ["a", "b"], "left_anti"), "pairs")
            label = extended(label, materialize(confirm(pairs, texts, near).union(blocks), "links"))
            discard(pairs, blocks)
        discard(fresh, more)
    discard(left, tried, links, texts, members)

    of_set = sets.select(*key, "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left")
    of_set = of_set.select(*key, F.coalesce("component_id", "rep").alias("component_id"))
    named = some.select("doc_id", *key).join(of_set, key).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    component = F.coalesce("component_id", "doc_id")
    return sketch.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )
