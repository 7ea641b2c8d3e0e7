"""Session helpers: defaults, shared scratch folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def local_session(app: str = "flockline", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites cost more than the columns
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names.

    Only a ``local`` master may go without one: it gets a fresh folder of this
    machine. Anywhere else executors would write to disks that others cannot read.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="flockline-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for a small input that arrives in fewer splits than there are cores.

    A large table has more splits than that and is returned as it is, unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def materialize(df: DataFrame, name: str = "stage", compression: str = "snappy") -> DataFrame:
    """Cut lineage by writing ``df`` as a parquet table in the shared folder.

    The table survives lost executors, is computed once, and gives the next
    plan real size statistics. :func:`discard` removes it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that nothing reads any more."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file system holds the path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
