"""Line deduplication by overlapping three-line windows (operator 9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockline.llm.names import unused
from flockline.session import discard, materialize

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeats(docs: DataFrame) -> DataFrame:
    """Start lines, per document, of windows that occurred before: ``(doc_id, starts)``.

    Every three consecutive lines, not all blank, are one window with a 128-bit hash.
    Of equal windows the first by (doc_id, line) stays. Hot windows are pre-aggregated
    by ``min`` and ``max``; what comes back per document is bounded by its lines.
    """
    lines = F.col("lines")
    part = lambda i: [F.get(lines, i + k) for k in range(SPAN)]
    blank = lambda i: F.concat(*part(i)).rlike(r"^\s*$")
    window = lambda i: F.when(~blank(i), F.struct(F.xxhash64(*part(i)).alias("a"), F.xxhash64(F.lit(SPAN), *part(i)).alias("b")))
    cut = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), _lines(F.col("text")).alias("lines"))
    cut = cut.filter(F.size("lines") >= SPAN)
    hashed = cut.select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("lines") - SPAN), window)))
    windows = hashed.filter("col IS NOT NULL").select("doc_id", F.col("pos").alias("line"), "col.a", "col.b")
    windows = materialize(windows, "windows")
    spot = F.struct("doc_id", "line")
    seen = windows.groupBy("a", "b").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).filter("first < last")
    again = windows.join(seen.select("a", "b", "first"), ["a", "b"]).filter(spot != F.col("first"))
    starts = materialize(again.groupBy("doc_id").agg(F.collect_set("line").alias("starts")), "starts")
    discard(windows)
    return starts


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` shortened, plus ``n_lines`` and ``n_removed``.

    Lines end at a line feed. Removed is each line that a later occurrence of a window
    covers; overlapping occurrences merge. A null text stays null with no lines, a text
    of fewer than three lines stays whole, blank windows never count, and a text may
    become empty. Repeated rows of one id are one document; rows without an id stay
    whole. Other columns pass unchanged.
    """
    dup_id, dup_starts = unused(docs, "dup_id"), unused(docs, "dup_starts")
    starts = repeats(docs).select(F.col("doc_id").alias(dup_id), F.col("starts").alias(dup_starts))
    # Both sides grow with the table, so they are merged at every size.
    joined = docs.join(starts.hint("merge"), F.col("doc_id").cast("long") == F.col(dup_id), "left")
    lines = _lines(F.col("text"))
    n = F.coalesce(F.size(lines), F.lit(0))
    covered = F.flatten(F.transform(dup_starts, lambda s: F.sequence(s, s + (SPAN - 1))))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), covered)
    text = F.when(F.col(dup_starts).isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")
    )
    removed = F.when(F.col(dup_starts).isNull(), 0).otherwise(F.size(F.array_distinct(covered)))
    rest = [docs[c] for c in docs.columns if c.lower() not in ("text", "n_lines", "n_removed")]
    count = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines")
    return joined.select(*rest, text.alias("text"), count, removed.cast("long").alias("n_removed"))


def lines_sql(docs: str) -> str:
    """CTEs of the same rule on a relation ``docs``, ending in ``cleaned``."""
    return f"""cut AS (SELECT DISTINCT doc_id, string_split(text, chr(10)) AS l FROM {docs} WHERE doc_id IS NOT NULL),
windows AS MATERIALIZED (SELECT doc_id, i, concat_ws(chr(10), l[i], l[i + 1], l[i + 2]) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM cut)
  WHERE NOT regexp_full_match(concat(l[i], l[i + 1], l[i + 2]), '\\s*')),
again AS (SELECT doc_id, i FROM
  (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM windows) WHERE k > 1),
covered AS (SELECT doc_id, list(DISTINCT j) AS gone FROM
  (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY doc_id),
cleaned AS (SELECT d.* EXCLUDE (text),
  CASE WHEN c.gone IS NULL THEN d.text ELSE coalesce(array_to_string(list_transform(list_filter(
    range(1, len(string_split(d.text, chr(10))) + 1), lambda j: NOT list_contains(c.gone, j)),
    lambda j: string_split(d.text, chr(10))[j]), chr(10)), '') END AS text,
  coalesce(len(string_split(d.text, chr(10))), 0) AS n_lines, coalesce(len(c.gone), 0) AS n_removed
  FROM {docs} d LEFT JOIN covered c USING (doc_id))"""
