"""Exact top-k search by distributed histogram selection (operator 10).

Each query's scores against all candidates are counted in histograms, first over the
whole range, then over the one bin that holds the k-th score, until that bin is one
score wide. A last pass keeps what lies above and, of the ties, the smallest ids.
Scores are never stored: a cell of the query and candidate blocks is recomputed in each
pass by one matrix product and leaves a few rows per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flockline.session import discard, materialize

QUERIES, CANDIDATES, TILE = 1024, 16384, 4096  # rows of a cell's two blocks, and of one product
BINS = 1024
END = (1 << 62) - 1  # largest score


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, v``: floor(scale * x) of the usable vectors, equal rows once."""
    x = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    usable = vectors.filter(F.col("vec_id").isNotNull() & F.forall(x, finite))
    return usable.select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(c * scale)).alias("v")).distinct()


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products: in doubles while these are exact, else with whole numbers, held between the ends."""
    x, y = a.astype("float64"), b.astype("float64")
    if np.abs(x).max(initial=0) * np.abs(y).max(initial=0) * max(a.shape[1], 1) < 2.0**53:
        return (x @ y.T).astype("int64")
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -END, END).astype("int64")


def _cells(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of both sides dealt to cells: ``(dim, q, c, kind, vec_id, v, low, width)``, queries of a cell first."""
    n_q = max(1, -(-queries.count() // QUERIES))
    n_c = max(1, -(-rows.count() // CANDIDATES))
    q = F.pmod(F.xxhash64("vec_id"), F.lit(n_q))
    c = F.pmod(F.xxhash64("vec_id"), F.lit(n_c))
    series = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    dim = F.size("v").alias("dim")
    none = F.lit(None).cast("long")
    left = queries.select(dim, q.alias("q"), series(n_c).alias("c"), F.lit(0).alias("kind"), "vec_id", "v", "low", "width")
    right = rows.select(dim, series(n_q).alias("q"), c.alias("c"), F.lit(1).alias("kind"), "vec_id", "v", none.alias("low"), none.alias("width"))
    return left.union(right).repartition(n_q * n_c, "dim", "q", "c").sortWithinPartitions("dim", "q", "c", "kind")


class _Cell:
    """The queries of one cell, with what the pass gathers from the candidates streaming past."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, low: np.ndarray, width: np.ndarray, k: int, last: bool) -> None:
        self.ids, self.v, self.low, self.width, self.k, self.last = ids, v, low, width, k, last
        self.counts = None if last else np.zeros((len(ids), BINS + 1), "int64")  # the last bin: all above
        self.kept: list[tuple] = []

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        for lo in range(0, len(ids), TILE):
            some = ids[lo : lo + TILE]
            score = products(self.v, v[lo : lo + TILE])
            bins = (score - self.low[:, None]) // self.width[:, None]
            good = (bins >= 0) & (self.ids[:, None] != some[None, :])
            row, col = np.nonzero(good)
            if self.last:
                self.kept.append((row, some[col], score[row, col]))
                if sum(len(x[0]) for x in self.kept) > TILE * 256:
                    self.kept = [self.best()]
            else:
                at = row * (BINS + 1) + np.minimum(bins[row, col], BINS)
                self.counts += np.bincount(at, minlength=self.counts.size).reshape(self.counts.shape)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, ids, score = (np.concatenate(x) for x in zip(*self.kept)) if self.kept else (np.zeros(0, "int64"),) * 3
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        first = np.searchsorted(row, row)
        top = np.arange(len(row)) - first < self.k
        return row[top], ids[top], score[top]

    def rows(self) -> list[np.ndarray]:
        if self.last:
            row, ids, score = self.best()
            return [self.ids[row], score, ids]
        above = np.cumsum(self.counts[:, ::-1], axis=1)[:, ::-1] - self.counts
        row, at = np.nonzero((self.counts > 0) & (above < self.k))  # lower bins can't hold the k-th of all
        return [self.ids[row], at, self.counts[row, at]]


def _pass(queries: DataFrame, rows: DataFrame, k: int, last: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, held = None, None, []
        names = ["query_id", "score", "vec_id"] if last else ["query_id", "bin", "n"]

        def close() -> Iterator[pa.RecordBatch]:
            if cell is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x.astype("int64")) for x in cell.rows()], names=names)

        for batch in batches:
            key = np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in range(4)], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(key)]):
                part = batch.slice(lo, hi - lo)
                place, kind = tuple(key[lo, :3]), key[lo, 3]
                if place != now:
                    yield from close()
                    now, cell, held = place, None, []
                if kind == 0:
                    held.append(part)
                    continue
                if held:
                    whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    ids, low, width = (whole.column(x).to_numpy() for x in (4, 6, 7))
                    cell, held = _Cell(ids, matrix(whole.column(5)), low, width, k, last), []
                if cell is not None:
                    cell.see(part.column(4).to_numpy(), matrix(part.column(5)))
        yield from close()

    out = "query_id long, score long, vec_id long" if last else "query_id long, bin long, n long"
    return _cells(queries, rows).mapInArrow(run, out)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """The ``k`` highest integer inner products of each query: ``query_id, rank, vec_id, score``.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows with
    another id and as many components. Vectors that are null or hold null or non-finite
    components, and rows without an id, take no part; equal rows count once, and of
    several vectors of one id the smallest is the query. Ties go to the smaller id; a
    query with fewer candidates than ``k`` returns them all, one without any no row.
    Scores beyond 2**62 - 1 either way count as that. Other columns are ignored.
    """
    rows = materialize(whole(vectors, scale), "whole")
    peak = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0]
    reach = min(int(float(peak or 0) * 1.0001) + 1, END)  # no product exceeds the largest square
    low, width = -reach, -(-(2 * reach + 1) // BINS)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = materialize(asked.withColumns({"low": F.lit(low), "width": F.lit(width)}), "queries")
    while True:
        counts = _pass(queries, rows, k, False).groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        run = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        above = F.coalesce(F.sum("n").over(run), F.lit(0))
        at = counts.withColumn("above", above).filter(F.col("above") < k).groupBy("query_id").agg(F.min("bin").alias("bin"))
        found = queries.join(at, F.col("vec_id") == F.col("query_id"), "left")
        start = F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")
        finer = F.when(F.col("width") > 1, F.ceil(F.col("width") / BINS)).otherwise(1)
        old, queries = queries, materialize(found.select("vec_id", "v", start.alias("low"), finer.alias("width")), "queries")
        discard(old)
        if width == 1:
            break
        width = -(-width // BINS)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = _pass(queries, rows, k, True).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    out = materialize(kept.select("query_id", "rank", "vec_id", "score"), "top")
    discard(queries, rows)
    return out
