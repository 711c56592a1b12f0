"""Session helpers: table loading and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders made by :func:`new_folder`.
_CUTS: list[str] = []


def local_session(cores: int | str = "*", partitions: int = 8, name: str = "seqloom") -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own settings."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    shared = tempfile.mkdtemp(prefix="seqloom-")
    atexit.register(shutil.rmtree, shared, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def new_folder(spark: SparkSession) -> str:
    """The path of a new folder in the shared folder; nothing is there yet."""
    path = f"{_shared_folder(spark)}/seqloom-{uuid.uuid4().hex}"
    _CUTS.append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from it.

    Used where one result feeds several branches: the branches read the table instead of computing it again, a lost
    executor costs a re-read, not a re-computation, and the size of the table is known to the planner,
    which broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``. :func:`clear_cuts` removes the tables.
    """
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_cuts(spark: SparkSession) -> None:
    """Remove the folders of :func:`new_folder` and :func:`cut`; results that read them must be done with."""
    jvm = spark.sparkContext._jvm
    while _CUTS:
        path = jvm.org.apache.hadoop.fs.Path(_CUTS.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows placed by key for joins and Python steps that follow: later joins on the keys use this shuffle, and its
    partitions aren't merged for being small in bytes, as records cost much to read and write for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def spread(df: DataFrame) -> DataFrame:
    """Give a table of fewer splits than task slots to all slots, before a costly step in Python.

    A table of many files is left as it is: no shuffle where there is anything to shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(slots) if 2 * splits <= slots else df
