"""Mixing sources to target weights by capped water-filling (operator 2)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
_ORDER_BITS, _STEP = 60, 10  # a document's place in its source; bits that one refinement looks at
_NO_ID = -(1 << 63)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """Seeded pseudo-random place of a document in its source: 60 bits of an MD5."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), doc_id.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def fill(sources: DataFrame, share: float, ceiling: float) -> DataFrame:
    """Targets of ``sources (source, source_size, weight)``: proportional to weight, clamped, the excess reshared.

    Each round clamps the sources whose share reaches ``ceiling`` times their size
    and spreads what is left over the others by weight, until no more are clamped.
    A round is one aggregate; three numbers come back to the driver.
    """
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    cap = F.lit(ceiling) * F.col("source_size")
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= cap
        n, held, open_weight = sources.agg(
            F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))
        ).first()
        if n == clamped or not open_weight:
            return sources.withColumn("target", F.when(full, cap).otherwise(F.col("weight") * F.lit(level)))
        level, clamped = (goal - held) / open_weight, n


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with ``mix_place`` and, for rows without an id, which share a place, ``mix_sub``: 60 bits to order them by.

    Those are a hash of the row and of its number among equal rows, counted per partition
    and offset by the partitions before, so neither many such rows nor many equal ones meet in a task.
    """
    named = docs.withColumn("mix_place", place(F.col("doc_id").cast("long"), seed))
    missing = F.col("doc_id").cast("long").isNull()
    if docs.filter(missing).isEmpty():
        return named.withColumn("mix_sub", F.lit(0).cast("long"))
    plain = [docs[f.name] for f in docs.schema.fields if not {"map", "variant"} & set(re.findall(r"\w+", f.dataType.simpleString()))]
    rows = named.filter(missing).withColumn("mix_hash", F.xxhash64(*plain)).withColumn("mix_row", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("mix_part", F.shiftright("mix_row", 33)), "unnamed", "zstd")
    before = Window.partitionBy("mix_hash").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("mix_hash", "mix_part").agg(F.count("*").alias("n"))
    counts = counts.select("mix_hash", "mix_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("mix_start"))
    number = F.col("mix_start") + F.row_number().over(Window.partitionBy("mix_hash", "mix_part").orderBy("mix_row"))
    sub = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "mix_hash", number), 64 - _ORDER_BITS)
    rows = rows.join(counts, ["mix_hash", "mix_part"]).withColumn("mix_sub", sub).select(*named.columns, "mix_sub")
    rows = materialize(rows, "unnamed", "zstd")
    return named.filter(~missing).withColumn("mix_sub", F.lit(0).cast("long")).union(rows)


def _cuts(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the last place that gets one more repetition: ``(source, cut, cut_sub, cut_id)``.

    Sizes are summed by the leading bits of the place, then by the next bits inside
    the one bucket that the wanted words end in, and only the rest is ordered by row.
    Rows without an id share a place; where there are any, the bits of ``sub`` follow.
    """
    key = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    zero = F.lit(0).cast("long")
    shifts = [_ORDER_BITS - k * _STEP for k in (1, 2)]
    levels = [key(F.shiftright("place", k), zero) for k in shifts]
    if deep := not docs.filter("doc_id IS NULL").isEmpty():
        levels += [key(F.col("place"), F.shiftright("sub", k)) for k in shifts]
    inside = lambda at, bound: at.alias("d").join(
        bound.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.prefix") == F.col("s.prefix"))
    )
    bound = sources.select("source", "wanted", zero.alias("base"), key(zero, zero).alias("prefix"))
    for outer, level in zip([key(zero, zero), *levels], levels):
        found = inside(docs.withColumn("prefix", outer), bound).select("d.source", "wanted", "base", level.alias("prefix"), "size")
        sums = found.groupBy("source", "wanted", "base", "prefix").agg(F.sum("size").alias("sum"))
        run = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.col("base") + F.coalesce(F.sum("sum").over(run), F.lit(0)))
        ends = sums.filter("base < wanted AND base + sum >= wanted")
        bound = materialize(ends.select("source", "wanted", "base", "prefix"), "bounds")
    rows = inside(docs.withColumn("prefix", levels[-1]), bound)
    rows = rows.select("d.source", "wanted", "base", "d.prefix", "place", "sub", "id", "size")
    run = Window.partitionBy("source").orderBy("place", "sub", "id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(run), F.lit(0))
    taken = rows.withColumn("taken", before + F.col("size") / 2 <= F.col("wanted"))
    at = lambda a, b, c: F.struct(a.alias("cut"), b.alias("cut_sub"), c.alias("cut_id"))
    none = F.lit(None).cast("long")
    start = at(F.col("prefix.a"), F.shiftleft("prefix.b", shifts[-1]), none) if deep else at(F.shiftleft("prefix.a", shifts[-1]), zero, none)
    last = F.max(F.when(F.col("taken"), at(F.col("place"), F.col("sub"), F.col("id"))))
    return taken.groupBy("source", "prefix").agg(last.alias("last")).select("source", F.coalesce("last", start).alias("at")).select("source", "at.*")


def _sized(placed: DataFrame) -> DataFrame:
    """``doc_id, source, size, mix_place, mix_sub`` of the rows of :func:`_placed`."""
    light = placed.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.col("text")).alias("size"), "mix_place", "mix_sub",
    )
    return materialize(light, "sized")


def _planned(docs: DataFrame, sized: DataFrame, weights: tuple, share: float, ceiling: float) -> DataFrame:
    """``docs`` with ``mix_source_size``, ``mix_target`` and ``mix_copies``, found from :func:`_sized`."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: the only unpartitioned window, over names, not over documents
    ordered = F.row_number().over(Window.orderBy(F.asc_nulls_last("source")))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (ordered - 1) % len(weights) + 1)
    sources = fill(materialize(sources.withColumn("weight", weight), "sources"), share, ceiling)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("wanted", (ratio - F.floor(ratio)) * F.col("source_size"))
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    named = sized.withColumnsRenamed({"mix_place": "place", "mix_sub": "sub"}).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    cuts = _cuts(named, sources).withColumnRenamed("source", "cut_source")
    plan = sources.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    plan = plan.select(*[F.col(c).alias(f"mix_{c}") for c in ("source", "source_size", "target", "whole", "cut", "cut_sub", "cut_id")])
    plan = materialize(plan, "plan")
    here = F.struct(F.col("mix_place").alias("cut"), F.col("mix_sub").alias("cut_sub"))
    cut = F.struct(F.col("mix_cut").alias("cut"), F.col("mix_cut_sub").alias("cut_sub"))
    more = F.col("mix_cut").isNotNull() & ((here < cut) | ((here == cut) & (F.coalesce(doc_id, F.lit(_NO_ID)) <= F.col("mix_cut_id"))))
    out = docs.join(plan, source.eqNullSafe(F.col("mix_source")))
    return out.withColumn("mix_copies", F.col("mix_whole") + F.coalesce(more, F.lit(False)).cast("long"))


def mix(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 7) -> DataFrame:
    """How often the mix takes each document: ``doc_id, size, source, source_size, target, copies, taken``.

    The size of a text is its number of words (null: 0). Sources by code point, null
    last, weigh ``weights``, repeating; together they get ``share`` times all words, none
    more than ``ceiling`` times its own. A source's documents are all repeated the whole
    part of target over size; for the fraction, those first in a seeded order are taken
    once more until the words are there, so the result is within half a document of the
    target and the same in every run. Empty texts and sources take nothing. Repeated
    rows of one id and source are taken alike; each row without an id is a document of its
    own, with a place among the others by a hash of the row.
    """
    sized = _sized(_placed(docs, seed))
    planned = _planned(sized, sized, weights, share, ceiling)
    planned = planned.withColumnsRenamed({"mix_source_size": "source_size", "mix_target": "target", "mix_copies": "copies"})
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return planned.select("doc_id", "size", "source", "source_size", "target", "copies", taken)


def repeated(docs: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, ceiling: float = 2.0, seed: int = 7) -> DataFrame:
    """The mixed table itself: each row of ``docs`` as often as the mix takes it, columns unchanged."""
    names = docs.columns
    aside = {c: f"own_{k}_{c}" for k, c in enumerate(names) if c.lower().startswith("mix_")}
    placed = _placed(docs.withColumnsRenamed(aside), seed)
    planned = _planned(placed, _sized(placed), weights, share, ceiling)
    each = F.explode(F.expr("CASE WHEN mix_copies > 0 THEN sequence(1, mix_copies) END"))
    taken = planned.select(*[aside.get(c, c) for c in names], each.alias("mix_copy")).drop("mix_copy")
    return taken.withColumnsRenamed({own: c for c, own in aside.items()})


def mix_sql(docs: str, seed: int = 7) -> str:
    """CTEs of the same rule on a relation ``docs`` with the default weights, ending in ``mixed``."""
    place = f"('0x' || substr(md5('{seed}' || coalesce('-' || d.doc_id::VARCHAR, '')), 1, 15))::BIGINT"
    size = rf"len(regexp_extract_all(coalesce(d.text, ''), '{WORD}'))::BIGINT"
    return f"""sized AS MATERIALIZED (
  SELECT d.doc_id, d.source, {size} AS size, {place} AS place FROM {docs} d),
per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
ratios AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS limit_level FROM per_source),
levels AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per_source)
      - coalesce(sum(cap) OVER (ORDER BY limit_level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY limit_level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
lifted AS (SELECT arg_min(level, limit_level) AS level FROM levels WHERE level < limit_level),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level >= cap THEN cap ELSE weight * level END AS target
  FROM ratios, lifted),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM targets),
ranked AS (
  SELECT s.doc_id, s.size, p.source, p.source_size, p.target, floor(p.ratio)::BIGINT AS whole,
    (p.ratio - floor(p.ratio)) * p.source_size AS wanted,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
mixed AS (
  SELECT doc_id, size, source, source_size, target,
    whole + CASE WHEN wanted > 0 AND before < wanted AND before + size / 2.0 <= wanted THEN 1 ELSE 0 END AS copies
  FROM ranked)"""
