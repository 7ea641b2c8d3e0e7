"""Order-dependent selection: the lexicographically first independent set.

The sequential rule "a row leads unless an earlier leader matches it" is that
set under the order (ts, id). It decides both cluster leaders and kept alerts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockline.operators.kernel import Block, Rule, _tile_matches, compare, match_rows
from flockline.session import materialize

WALK_ROWS = 16_384  # rows that one task walks through in order
WALK_TILE = 512  # of them at a time
NEIGHBOURS = 32
FIRST_PREFIX = 65_536
PREFIX_GROWTH = 8
MAX_ROUNDS = 500


def _resolve(rows: DataFrame) -> DataFrame:
    """Decide what a task can decide alone, in order, over its own range of the order.

    Links only point to earlier rows, so a task walks its sorted range once: a
    row with a leading neighbour is dominated, one without open neighbours leads,
    and one that waits for rows of an earlier range stays open.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for pdf in batches:
            status, waiting = [], []
            for pid, nbs, cut, led in zip(pdf["id"], pdf["nbs"], pdf["cut"], pdf["led"]):
                around = [(nb, seen.get(nb)) for nb in nbs]
                open_nbs = [nb for nb, s in around if s != "D"]
                if led or any(s == "L" for _, s in around):
                    mark, open_nbs = "D", []
                elif not open_nbs and not cut:
                    mark = "L"
                else:
                    mark = None
                seen[pid] = mark
                status.append(mark)
                waiting.append(open_nbs)
            yield pdf.assign(nbs=waiting, status=status)

    placed = rows.repartitionByRange("ts", "id").sortWithinPartitions("ts", "id")
    schema = T.StructType([*rows.schema.fields, T.StructField("status", T.StringType())])
    return placed.mapInPandas(walk, schema)


def _settle(batch: DataFrame, edges: DataFrame, neighbours: int) -> DataFrame:
    """(id, status): L leads, D is dominated, null is open because its list was cut.

    ``edges`` holds the first ``neighbours + 1`` earlier matches of each row;
    a row with more than ``neighbours`` may have unseen ones, so it can be
    dominated but not made a leader here. Each round resolves whole ranges of
    the order, so the number of rounds follows the number of ranges that depend
    on each other, not the length of a chain of rows.
    """
    kind = batch.schema["id"].dataType
    none = F.array().cast(T.ArrayType(kind))
    lists = edges.groupBy("id").agg(
        F.collect_list("match_id").alias("nbs"), (F.count("*") > neighbours).alias("cut")
    )
    rows = batch.select("id", "ts").join(lists, "id", "left")
    rows = rows.withColumn("nbs", F.coalesce("nbs", none)).withColumn(
        "cut", F.coalesce("cut", F.lit(False))
    )
    state = materialize(_resolve(rows.withColumn("led", F.lit(False))), "state")
    open_n = state.filter("status IS NULL").count()
    for _ in range(MAX_ROUNDS):
        if not open_n:
            return state.select("id", "status")
        waits = state.filter("status IS NULL")
        decided = state.filter("status IS NOT NULL")
        known = (
            waits.select("id", F.explode("nbs").alias("nb"))
            .join(state.select(F.col("id").alias("nb"), "status"), "nb")
            .groupBy("id")
            .agg(
                F.collect_list(F.when(F.col("status").isNull(), F.col("nb"))).alias("nbs"),
                F.max(F.coalesce(F.col("status") == "L", F.lit(False))).alias("led"),
            )
        )
        again = waits.select("id", "ts", "cut").join(known, "id", "left").select(
            "id", "ts", F.coalesce("nbs", none).alias("nbs"), "cut", F.coalesce("led", F.lit(False)).alias("led")
        )
        state = materialize(decided.unionByName(_resolve(again)), "state")
        left = state.filter("status IS NULL").count()
        if left == open_n:
            return state.select("id", "status")
        open_n = left
    raise RuntimeError(f"selection still open after {MAX_ROUNDS} rounds: {open_n} rows")


def first_independent(
    nodes: DataFrame,
    rule: Rule,
    neighbours: int = NEIGHBOURS,
    first_prefix: int = FIRST_PREFIX,
    walk_rows: int = WALK_ROWS,
    **blocks,
) -> DataFrame:
    """Ids of the rows that no earlier selected row matches.

    Works through growing prefixes of the order: each prefix is settled among
    itself, then its leaders remove everything they match from the rest. A
    large group of near copies therefore falls to its first leader early and
    its inner pairs are never listed; a row keeps at most ``neighbours + 1`` links.
    Rows without a time are the earliest. A prefix of at most ``walk_rows`` rows, and the first
    one is that short, is decided by one task, one after the other; the result is the same.
    """
    link = replace(rule, keep="first", k=neighbours + 1, earlier=True)
    hit = replace(rule, keep="first", k=1, earlier=True)
    rest = materialize(nodes.withColumn("ts", F.coalesce("ts", F.lit(-(1 << 62)))), "nodes")
    chosen, prefix = None, min(first_prefix, walk_rows * 7 // 8) or first_prefix  # the cut is approximate
    for _ in range(MAX_ROUNDS):
        n = rest.count()
        if not n:
            break
        if n <= walk_rows:
            found = _walked(rest, hit)
            if chosen is None:
                return found
            chosen = chosen.unionByName(rest.join(found, "id", "left_semi"))
            break
        batch, later = rest, None
        if n > prefix:
            cut = rest.agg(F.percentile_approx("ts", prefix / n)).head()[0]
            batch = materialize(rest.filter(F.col("ts") <= cut), "batch")
            later = rest.filter(F.col("ts") > cut)
        found, short = None, later is not None and batch.count() <= walk_rows
        if short:
            found = materialize(batch.join(_walked(batch, hit), "id", "left_semi"), "leaders")
        while not short and batch.head(1):
            edges = materialize(match_rows(batch, batch, link, **blocks), "edges")
            state = _settle(batch, edges, neighbours)
            leaders = materialize(
                batch.join(state.filter("status = 'L'"), "id", "left_semi"), "leaders"
            )
            found = leaders if found is None else found.unionByName(leaders)
            open_rows = state.filter("status IS NULL").select("id")
            if not open_rows.head(1):
                break
            batch = materialize(batch.join(open_rows, "id", "left_semi"), "open")
            batch = _unmatched(batch, leaders, hit, blocks)
        chosen = found if chosen is None else chosen.unionByName(found)
        if later is None:
            break
        rest = _unmatched(later, found, hit, blocks)
        prefix *= PREFIX_GROWTH
    else:
        raise RuntimeError(f"selection not finished after {MAX_ROUNDS} prefixes")
    return nodes.limit(0).select("id") if chosen is None else chosen.select("id")


def _walked(rows: DataFrame, rule: Rule) -> DataFrame:
    """Ids of the selected rows, by one task that holds all of a few rows."""
    both = replace(rule, earlier=False)  # in a tile the places tell what is earlier

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [pdf for pdf in batches if len(pdf)]
        if not held:
            return
        whole = Block.of(pd.concat(held, ignore_index=True))
        chosen = np.zeros(0, dtype="int64")
        for a in range(0, len(whole.ids), WALK_TILE):
            tile = np.arange(a, min(a + WALK_TILE, len(whole.ids)))
            if len(chosen):
                hit = [found["id"].to_numpy() for found in compare(whole.part(tile), whole.part(chosen), rule)]
                if hit:
                    tile = tile[~np.isin(whole.ids[tile], np.concatenate(hit))]
            if not len(tile):
                continue
            # What the leaders before the tile left over decides among itself, row by row.
            part = whole.part(tile)
            i, j, _ = _tile_matches(part, part, both)
            before = (j < i) & ~((part.ts[i] == part.ts[j]) & (part.ids[i] == part.ids[j]))
            i, j = i[before], j[before]
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            ends = np.searchsorted(i, np.arange(len(tile) + 1))
            led = np.zeros(len(tile), dtype=bool)
            for k in range(len(tile)):
                led[k] = not led[j[ends[k] : ends[k + 1]]].any()
            chosen = np.concatenate([chosen, tile[led]])
        yield pd.DataFrame({"id": whole.ids[chosen]})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.repartition(1).sortWithinPartitions("ts", "id").mapInPandas(walk, f"id {kind}")


def _unmatched(rows: DataFrame, leaders: DataFrame, rule: Rule, blocks: dict) -> DataFrame:
    hits = match_rows(rows, materialize(leaders, "leaders"), rule, **blocks).select("id").distinct()
    return materialize(rows.join(hits, "id", "left_anti"), "rest")
