"""Posts in and out of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flockline import schemas


MALFORMED = "_corrupt_record"


def read_posts(
    spark: SparkSession, path: str, schema: T.StructType = schemas.POSTS, multiline: bool = False, malformed: bool = False
) -> DataFrame:
    """Posts from JSON with a fixed schema; ``multiline`` reads files that hold one JSON array.

    With ``malformed``, text that is no JSON of this schema is kept in a column of its own,
    by which :func:`ingest_posts` rejects the row; otherwise such rows have null fields.
    """
    if malformed:
        schema = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    reader = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
    return reader.option("multiLine", multiline).json(path)


def write_posts(posts: DataFrame, path: str, mode: str = "errorifexists", compression: str | None = None) -> None:
    """One JSON object per line, UTF-8, so that readers can split the files.

    Times keep their microseconds; the writer's default format would cut them. With a
    ``compression`` (gzip) files are small but are read whole, each by one task.
    """
    writer = posts.write.mode(mode).option("encoding", "UTF-8")
    if compression:
        writer = writer.option("compression", compression)
    writer.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def _with_columns(raw: DataFrame) -> DataFrame:
    have = set(raw.columns)
    for field in schemas.POSTS.fields:
        if field.name not in have:
            raw = raw.withColumn(field.name, F.lit(None).cast(field.dataType))
    return raw


def check_posts(raw: DataFrame, now: Column) -> DataFrame:
    """Fill defaults (time, counts, lists) and add ``is_valid``: all required fields are there and the row could be read."""
    posts = _with_columns(raw)
    valid = F.col(MALFORMED).isNull() if MALFORMED in raw.columns else F.lit(True)
    for name in schemas.REQUIRED_POST_FIELDS:
        valid = valid & F.col(name).isNotNull()
    posts = posts.withColumn("is_valid", valid)
    posts = posts.withColumn("created_at", F.coalesce("created_at", now))
    posts = posts.withColumn("id", F.coalesce(F.col("id").cast("string"), F.col("post_id").cast("string")))
    posts = posts.na.fill(0, list(schemas.COUNT_FIELDS))
    for name in ("hashtags", "mentions", "urls"):
        posts = posts.withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return posts


def ingest_posts(raw: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) posts of a batch."""
    checked = check_posts(raw, now)
    return checked.filter("is_valid").drop("is_valid"), checked.filter("NOT is_valid").drop("is_valid")


def stream_posts(
    spark: SparkSession, path: str, schema: T.StructType = schemas.POSTS, files_per_trigger: int = 1
) -> DataFrame:
    """Posts from a folder of JSON files, a few files per micro-batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )
