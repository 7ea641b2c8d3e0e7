"""From raw documents to packed sequences: a corpus in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``. All stages but the last return the
columns of ``documents``. Rows with a null id, text, lang or source pass like others:
a null text is rejected by the first stage, a null source is a source of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.llm import langid, lines, minhash, mixing, packing
from flockline.session import discard, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without a letter go, and those that score below all learned from."""
    return langid.known(materialize(langid.identify(docs), "scored", "zstd")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of three-line windows; ``n_chars`` follows the text.

    A document of which nothing is left, such as a whole copy, goes.
    """
    cleaned = lines.dedup_lines(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _named(docs: DataFrame) -> DataFrame:
    """One row of each ``doc_id`` and each row without one, with a ``near_id`` of its own in the order of ids, null last.

    Of the rows of one id the greatest by text stays. Rows without an id follow each other by
    a hash, so that it does not depend on the run which of several near copies stays.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:])
    again = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    again = materialize(again, "again")
    if not again.isEmpty():
        one = F.max(F.struct(*COLUMNS[1:])).alias("row")
        folded = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("doc_id", "row.*")
        docs = docs.join(again, "doc_id", "left_anti").union(folded)
    if docs.filter("doc_id IS NULL").isEmpty():
        return docs.withColumn("near_id", F.col("doc_id"))
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64(*COLUMNS)).alias("near_hash")
    rows = materialize(docs.select("*", tie, F.monotonically_increasing_id().alias("near_row")), "rows", "zstd")
    order = [F.asc_nulls_last("doc_id"), F.asc("near_hash"), F.asc("near_row")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranked = materialize(ranked.select(*COLUMNS, F.monotonically_increasing_id().alias("near_id")), "named", "zstd")
    discard(rows)
    return ranked


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the smallest id, those without an id last.

    Rows without an id are documents of their own, rows of one id are one document and one row.
    """
    named = _named(docs)
    classes = minhash.near_duplicates(named.select(F.col("near_id").alias("doc_id"), "text")).filter("NOT kept")
    return named.join(classes.select(F.col("doc_id").alias("near_id")), "near_id", "left_anti").select(*COLUMNS)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.repeated(docs).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixture", source_mixture),
    ("sequences", sequences),
]

ORACLE_SQL = None  # n-gram profiles, shingle graphs and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name, "zstd")
        discard(before)
    return docs
