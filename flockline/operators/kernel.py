"""Blocked comparison of two vector tables.

Rows of both sides are ``(id, ts, vec)`` plus optional ``slack`` and ``tag``.
A block of *home* rows is held as a matrix and *probe* rows stream past it in
Arrow batches; what leaves a block is at most ``k`` rows per probe, so results
stay linear however many rows match (except for the explicit pair join).

Small home sides (size checked) are broadcast as one matrix. Larger ones are
split into metric cells around pivots, hot cells into chunks, and hot probe
groups are salted, so no task ever holds more than one bounded chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockline.session import materialize

BLOCK_BYTES = 32 << 20
PROBES_PER_TASK = 262_144
_TILE = 1024  # a tile of numbers is 16 MB, and a few copies of it live at once in every worker
_DENSE = 64  # a tile with more than one close pair in so many is compared whole
_PLANES_SEED = 20240


@dataclass(frozen=True)
class Rule:
    """When two rows match, and which matches of a probe are kept."""

    theta: float | None = 0.7  # similarity bound, None when only tags count
    strict: bool = False  # > instead of >=
    keep: str = "best"  # best: by similarity; first: by order; all
    k: int = 1
    earlier: bool = False  # only matches before the probe in (ts, id)
    max_age: int | None = None  # only matches at most this many microseconds older
    slack: bool = False  # squared distance within both rows' slack instead of theta
    tag: bool = False  # equal tags match as well

    @property
    def reach(self) -> float:
        """Largest distance of a matching pair of unit vectors."""
        return float(np.sqrt(max(0.0, 2.0 - 2.0 * (self.theta - 1e-6))) + 1e-9)


@dataclass
class Block:
    ids: np.ndarray
    ts: np.ndarray
    vec: np.ndarray
    slack: np.ndarray | None
    tag: np.ndarray | None

    @staticmethod
    def of(pdf: pd.DataFrame) -> "Block":
        return Block(
            pdf["id"].to_numpy(),
            pdf["ts"].to_numpy(dtype="int64"),
            np.stack(pdf["vec"].to_numpy()).astype("float64", copy=False),
            pdf["slack"].to_numpy(dtype="float64") if "slack" in pdf else None,
            pdf["tag"].to_numpy() if "tag" in pdf else None,
        )

    def part(self, rows) -> "Block":
        pick = lambda a: None if a is None else a[rows]
        return Block(self.ids[rows], self.ts[rows], self.vec[rows], pick(self.slack), pick(self.tag))

    @staticmethod
    def join(blocks: list["Block"]) -> "Block":
        cat = lambda xs: None if xs[0] is None else np.concatenate(xs)
        return Block(
            cat([b.ids for b in blocks]),
            cat([b.ts for b in blocks]),
            cat([b.vec for b in blocks]),
            cat([b.slack for b in blocks]),
            cat([b.tag for b in blocks]),
        )


def _round6(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def _sifted(p: Block, h: Block, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Indices and similarities (with ``slack`` negative squared distances) of the pairs that can match.

    One product in single precision leaves out every pair that is further from the bound than
    its rounding; what it keeps is computed again in double precision. None where a tile
    is better compared whole: many pairs are close, tags count, or numbers are very large.
    """
    if rule.tag or (not rule.slack and (rule.theta is None or rule.theta <= 0)):
        return None
    pn, hn = (p.vec**2).sum(1), (h.vec**2).sum(1)
    top = float(pn.max() + hn.max())
    if not top < 1e30:
        return None
    a, b, bound = p.vec, h.vec, 0.0
    if rule.slack:  # half of (slack - squared distance) is one product of longer vectors
        a = np.column_stack([a, (p.slack - pn) / 2, np.ones(len(pn))])
        b = np.column_stack([b, np.ones(len(hn)), -hn / 2])
        top += float(p.slack.max())
    else:
        bound = rule.theta - 1e-6
    rough = a.astype("float32") @ b.astype("float32").T
    hit = rough >= np.float32(bound - 3e-7 * (a.shape[1] + 8) * (top + 1.0))
    if np.count_nonzero(hit) * _DENSE > hit.size:
        return None
    i, j = np.nonzero(hit)
    dots = np.einsum("ij,ij->i", p.vec[i], h.vec[j])
    if not rule.slack:
        near = dots >= bound
        return i[near], j[near], dots[near]
    d2 = pn[i] + hn[j] - 2.0 * dots
    near = d2 <= np.minimum(p.slack[i], h.slack[j]) + 1e-12
    return i[near], j[near], -d2[near]


def _tile_matches(p: Block, h: Block, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indices and scores of the matching pairs of one tile."""
    found = _sifted(p, h, rule)
    if found is None:
        dots = p.vec @ h.vec.T
        if rule.slack:
            d2 = (p.vec**2).sum(1)[:, None] + (h.vec**2).sum(1)[None, :] - 2.0 * dots
            hit = d2 <= np.minimum(p.slack[:, None], h.slack[None, :]) + 1e-12
            dots = -d2
        elif rule.theta is not None:
            hit = dots >= rule.theta - 1e-6
        else:
            hit = np.zeros(dots.shape, dtype=bool)
        if rule.tag:
            hit |= p.tag[:, None] == h.tag[None, :]
        i, j = np.nonzero(hit)
        found = i, j, dots[i, j]
    return _judged(p, h, rule, *found)


def _judged(p: Block, h: Block, rule: Rule, i: np.ndarray, j: np.ndarray, dots: np.ndarray):
    """The pairs that match by the rounded score, their order and their age."""
    score = _round6(dots)
    keep = np.ones(len(i), dtype=bool)
    if not rule.slack and rule.theta is not None:
        near = score > rule.theta if rule.strict else score >= rule.theta
        if rule.tag:
            near |= p.tag[i] == h.tag[j]
        keep &= near
    if rule.earlier:
        tp, th = p.ts[i], h.ts[j]
        before = th < tp
        same = np.nonzero(th == tp)[0]
        before[same] = h.ids[j[same]] < p.ids[i[same]]
        keep &= before
    if rule.max_age is not None:
        keep &= p.ts[i] - h.ts[j] <= rule.max_age
    return i[keep], j[keep], score[keep]


def _top(i: np.ndarray, j: np.ndarray, score: np.ndarray, rule: Rule):
    """Keep k matches per probe; home rows are in (ts, id) order, so j breaks ties."""
    if rule.keep == "all" or not len(i):
        return i, j, score
    if rule.keep == "best":
        order = np.lexsort((j, -score, i))
        i, j, score = i[order], j[order], score[order]
    elif (i[1:] < i[:-1]).any():  # one tile comes out in (i, j) order already
        order = np.lexsort((j, i))
        i, j, score = i[order], j[order], score[order]
    starts = np.nonzero(np.r_[True, i[1:] != i[:-1]])[0]
    rank = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
    top = rank < rule.k
    return i[top], j[top], score[top]


def _best_dense(p: Block, h: Block, rule: Rule):
    """The single best match of each probe in a tile, without listing the others."""
    found = _sifted(p, h, rule)
    if found is not None:
        return _top(*_judged(p, h, rule, *found), rule)
    score = _round6(p.vec @ h.vec.T)
    out = score <= rule.theta if rule.strict else score < rule.theta
    if rule.earlier:
        out |= h.ts[None, :] >= p.ts[:, None]
        i, j = np.nonzero(h.ts[None, :] == p.ts[:, None])
        tied = h.ids[j] < p.ids[i]
        i, j = i[tied], j[tied]
        near = score[i, j] > rule.theta if rule.strict else score[i, j] >= rule.theta
        out[i[near], j[near]] = False
    score[out] = -np.inf
    j = score.argmax(1)
    i = np.arange(len(j))
    best = score[i, j]
    found = best > -np.inf
    return i[found], j[found], best[found]


def compare(probe: Block, home: Block, rule: Rule) -> Iterator[pd.DataFrame]:
    """Matches of a probe batch in one home block, tile by tile.

    With ``earlier`` probes are taken in time order, so tiles of later home rows
    are skipped; with ``keep="first"`` a probe leaves once it has its k matches.
    """
    dense = rule.keep == "best" and rule.k == 1 and not (rule.tag or rule.slack) and rule.max_age is None
    if rule.earlier:
        probe = probe.part(np.argsort(probe.ts, kind="stable"))
    for a in range(0, len(probe.ids), _TILE):
        p = probe.part(slice(a, a + _TILE))
        open_rows = np.arange(len(p.ids))
        have = np.zeros(len(p.ids), dtype=int)
        found: list[tuple] = []
        for b in range(0, len(home.ids), 2 * _TILE):
            h = home.part(slice(b, b + 2 * _TILE))
            if not len(open_rows) or (rule.earlier and h.ts[0] > p.ts[-1]):
                break
            q = p if len(open_rows) == len(p.ids) else p.part(open_rows)
            i, j, score = _best_dense(q, h, rule) if dense else _top(*_tile_matches(q, h, rule), rule)
            if len(i):
                i = open_rows[i]
                found.append((i, j + b, score))
                if rule.keep == "first":
                    have += np.bincount(i, minlength=len(have))
                    open_rows = np.nonzero(have < rule.k)[0]
        if found:
            i, j, score = _top(*(np.concatenate(x) for x in zip(*found)), rule)
            yield pd.DataFrame(
                {
                    "id": p.ids[i],
                    "match_id": home.ids[j],
                    "similarity": score,
                    "match_ts": home.ts[j],
                }
            )


def _sorted_block(pdf: pd.DataFrame) -> Block:
    return Block.of(pdf.sort_values(["ts", "id"], kind="stable"))


def stream_blocks(
    home: DataFrame,
    probe: DataFrame,
    keys: list[str],
    fn: Callable[[tuple, Block, Block], Iterator[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Per key: hold the home rows, stream the probe rows past them.

    Home rows of one key must be bounded by construction; probe rows need not
    be. Sorting puts the home rows of a key first, so a task keeps one block.
    """
    both = home.withColumn("__side", F.lit(0)).unionByName(probe.withColumn("__side", F.lit(1)))
    placed = both.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "__side")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, pieces, block = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cols = [batch[k].to_numpy() for k in keys] + [batch["__side"].to_numpy()]
            change = np.zeros(len(batch), dtype=bool)
            change[0] = True
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            edges = np.r_[np.nonzero(change)[0], len(batch)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                part = batch.iloc[lo:hi]
                key = tuple(c[lo] for c in cols[:-1])
                if key != current:
                    current, pieces, block = key, [], None
                if cols[-1][lo] == 0:
                    pieces.append(part)
                elif block is not None or pieces:
                    if block is None:
                        block, pieces = _sorted_block(pd.concat(pieces)), []  # the rows are held once
                    yield from fn(key, block, Block.of(part))

    return placed.mapInPandas(run, schema)


def _result_schema(probe: DataFrame, home: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("id", probe.schema["id"].dataType),
            T.StructField("match_id", home.schema["id"].dataType),
            T.StructField("similarity", T.DoubleType()),
            T.StructField("match_ts", T.LongType()),
        ]
    )


def _columns(df: DataFrame, rule: Rule) -> DataFrame:
    names = ["id", "ts", "vec"] + ["slack"] * rule.slack + ["tag"] * rule.tag
    return df.select(*names)


def _dim(df: DataFrame) -> int:
    row = df.select(F.size("vec").alias("d")).head()
    return 0 if row is None else row["d"]


def _best_of(found: DataFrame, rule: Rule) -> DataFrame:
    if rule.keep == "all":
        return found
    order = ["match_ts", "match_id"]
    if rule.keep == "best":
        order = [F.desc("similarity"), *order]
    if rule.k == 1:
        score = -F.col("similarity") if rule.keep == "best" else F.lit(0.0)
        best = F.min(F.struct(score.alias("s"), "match_ts", "match_id", "similarity")).alias("b")
        return found.groupBy("id").agg(best).select(
            "id", "b.match_id", "b.similarity", "b.match_ts"
        )
    ranked = found.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(*order)))
    return ranked.filter(F.col("__r") <= rule.k).drop("__r")


def _chunked(home: DataFrame, probe: DataFrame, rule: Rule, rows: int, schema) -> DataFrame:
    """Equal ``cell`` join: home cells cut into chunks, probe cells into salts."""
    home_n = home.groupBy("cell").agg(F.ceil(F.count("*") / rows).cast("int").alias("chunks"))
    probe_n = probe.groupBy("cell").agg(
        F.ceil(F.count("*") / PROBES_PER_TASK).cast("int").alias("salts")
    )
    grid = materialize(home_n.join(probe_n, "cell"), "grid")
    spread = F.xxhash64("id")
    h = (
        home.join(grid, "cell")
        .withColumn("chunk", F.pmod(spread, F.col("chunks")).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        .drop("chunks", "salts")
    )
    p = (
        probe.join(grid, "cell")
        .withColumn("salt", F.pmod(spread, F.col("salts")).cast("int"))
        .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .drop("chunks", "salts")
    )
    # One table holds both sides, so ids of different types travel as strings.
    types = (schema["id"].dataType, schema["match_id"].dataType)
    if types[0] != types[1]:
        h, p = h.withColumn("id", F.col("id").cast("string")), p.withColumn("id", F.col("id").cast("string"))
    carried = T.StructType([T.StructField(f.name, h.schema["id"].dataType) for f in schema.fields[:2]] + schema.fields[2:])
    found = stream_blocks(
        h, p, ["cell", "chunk", "salt"], lambda key, b, q: compare(q, b, rule), carried
    )
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _tiled(home: DataFrame, probe: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Cells cut into time tiles of ``max_age``: a probe meets its own tile and the one before.

    Applies to rules that look back a bounded time; others keep their cells whole.
    """
    if not (rule.earlier and rule.max_age):
        return home, probe
    own = F.expr(f"(ts - pmod(ts, {rule.max_age}L)) div {rule.max_age}L")
    cell = F.concat(F.col("cell").cast("string"), F.lit("|"), F.col("__tile").cast("string"))
    both = F.explode(F.array(own - 1, own))
    return (
        home.withColumn("__tile", own).withColumn("cell", cell).drop("__tile"),
        probe.withColumn("__tile", both).withColumn("cell", cell).drop("__tile"),
    )


def sign_bands(theta: float, bits: int, recall: float) -> int:
    """How many keys of ``bits`` signs a row needs, so that a pair at the bound shares one with chance ``recall``."""
    agree = (1.0 - np.arccos(np.clip(theta, -1.0, 1.0)) / np.pi) ** bits
    return 1 if agree >= 1 else max(1, int(np.ceil(np.log1p(-recall) / np.log1p(-agree))))


def sign_cells(df: DataFrame, dim: int, bands: int, bits: int) -> DataFrame:
    """Every row once per band, with ``cell`` from the signs of its products with fixed random planes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(_PLANES_SEED).standard_normal((dim, bands * bits))
        weights = 1 << np.arange(bits, dtype="int64")
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["vec"].to_numpy()).astype("float64")
                keys = ((v @ planes) >= 0).reshape(len(v), bands, bits) @ weights
                yield pdf.assign(cells=list(keys + (np.arange(bands, dtype="int64") << bits)))

    schema = T.StructType([*df.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    return df.mapInPandas(run, schema).withColumn("cell", F.explode("cells")).drop("cells")


def match_candidates(
    rows: DataFrame, rule: Rule, bits: int, recall: float, block_rows: int | None = None, probe: DataFrame | None = None
) -> DataFrame:
    """Matches of ``probe`` (by default all rows) within ``rows`` among pairs that share a sign key, all compared exactly.

    The bands of :func:`sign_bands` find a pair at the bound with chance ``recall``, a closer one
    more surely. Rows are copied once per band, on their way to the comparison and not in a
    table of their own; a key with many rows is cut into chunks.
    """
    schema, plain = _result_schema(rows if probe is None else probe, rows), _columns(rows, rule)
    dim = _dim(plain)
    size = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, dim)))
    signed = lambda df: sign_cells(df, dim, sign_bands(rule.theta, bits, recall), bits)
    found = _chunked(signed(plain), signed(plain if probe is None else _columns(probe, rule)), rule, size, schema)
    return found.dropDuplicates(["id", "match_id"]) if rule.keep == "all" else _best_of(found, rule)


def _distances(df: DataFrame, pivots: np.ndarray, fn, extra: list[T.StructField]) -> DataFrame:
    schema = T.StructType(df.schema.fields + extra)
    squares = (pivots**2).sum(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                v = np.stack(pdf["vec"].to_numpy()).astype("float64")
                d2 = (v**2).sum(1)[:, None] + squares[None, :] - 2.0 * (v @ pivots.T)
                yield fn(pdf, np.sqrt(np.maximum(d2, 0.0)))

    return df.mapInPandas(run, schema)


def _metric_cells(probe: DataFrame, home: DataFrame, rule: Rule, n: int, rows: int, reach: float):
    """Home rows in the cell of their nearest pivot; probes in each cell within reach."""
    wanted = int(min(4096, max(16, 8 * -(-n // rows))))
    chosen = home.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vec").collect()
    pivots = np.unique(np.array([r["vec"] for r in chosen], dtype="float64"), axis=0)

    def nearest(pdf: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        cell = d.argmin(1)
        return pdf.assign(cell=cell.astype("int32"), dist=d[np.arange(len(d)), cell])

    cells = materialize(
        _distances(
            home,
            pivots,
            nearest,
            [T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType())],
        ),
        "cells",
    )
    ranges = cells.groupBy("cell").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi")).collect()
    lo = np.full(len(pivots), np.inf)
    hi = np.full(len(pivots), -np.inf)
    for r in ranges:
        lo[r["cell"]], hi[r["cell"]] = r["lo"] - 1e-6, r["hi"] + 1e-6

    squares = (pivots**2).sum(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2.0 * pivots @ pivots.T, 0.0))

    def within(pdf: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        near = (d >= lo - reach) & (d <= hi + reach)
        # A cell lies beyond the plane halfway to its pivot: no row of it is closer than that plane.
        own = d.argmin(1)
        near &= d**2 - d[np.arange(len(d)), own][:, None] ** 2 <= 2.0 * apart[own] * (reach + 1e-6) + 1e-9
        return pdf.assign(cells=[np.nonzero(row)[0].astype("int32") for row in near])

    near = _distances(
        probe, pivots, within, [T.StructField("cells", T.ArrayType(T.IntegerType()))]
    )
    return cells.drop("dist"), near.withColumn("cell", F.explode("cells")).drop("cells")


def _broadcast_compare(probe: DataFrame, home: DataFrame, rule: Rule, schema) -> DataFrame:
    """The home side has been counted and fits one block: ship it, no shuffle."""
    pdf = home.toPandas()
    if not len(pdf):
        return probe.sparkSession.createDataFrame([], schema)
    block = _sorted_block(pdf)
    # Plain arrays: a broadcast is unpickled before this package travels.
    shared = probe.sparkSession.sparkContext.broadcast(tuple(block.__dict__.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Block(*shared.value)
        for batch in batches:
            if len(batch):
                yield from compare(Block.of(batch), held, rule)

    return probe.mapInPandas(run, schema)


def match_rows(
    probe: DataFrame,
    home: DataFrame,
    rule: Rule,
    block_rows: int | None = None,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """(id, match_id, similarity, match_ts): the matches of each probe among the home rows.

    Vectors are expected to have unit length unless the rule uses ``slack``.
    ``home`` should be a stored table: it is counted first.
    """
    schema = _result_schema(probe, home)
    probe, home = _columns(probe, rule), _columns(home, rule)
    n = home.count()
    rows = block_rows or max(1024, BLOCK_BYTES // (8 * max(1, _dim(home))))
    if n <= (rows if broadcast_rows is None else broadcast_rows):
        return _broadcast_compare(probe, home, rule, schema)
    parts = []
    if rule.slack or rule.theta is not None:
        near = Rule(**{**rule.__dict__, "tag": False}) if rule.tag else rule
        reach = (
            float(np.sqrt(max(0.0, home.agg(F.max("slack")).head()[0] or 0.0))) + 1e-6
            if rule.slack
            else rule.reach
        )
        cells, probes = _metric_cells(probe, home, near, n, rows, reach)
        cells, probes = _tiled(cells, probes, near)
        parts.append(_chunked(cells, materialize(probes, "probes"), near, rows, schema))
    if rule.tag:
        same = Rule(**{**rule.__dict__, "theta": None})
        homes, probes = _tiled(home.withColumn("cell", F.col("tag")), probe.withColumn("cell", F.col("tag")), same)
        parts.append(_chunked(homes, probes, same, rows, schema))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    return _best_of(found, rule)
