"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Session setting: a folder inside the shared one for what runs now.
SCRATCH = "linefold.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own machine.
    """
    path = spark.conf.get(SCRATCH, None) or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="linefold-")
    spark.conf.set(SCRATCH, path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Give a small input, say one file, a partition per core. Large inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back (cuts lineage)."""
    return staged_parts(df.sparkSession, [df], name, partition_by)


def staged_parts(
    spark: SparkSession, parts: Iterable[DataFrame], name: str, partition_by: str | None = None
) -> DataFrame:
    """Write parts of one schema, one job after the other, into one stored table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = None
    for part in parts:
        writer = part.write.mode("append")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        schema = part.schema
    if schema is None:
        raise ValueError("nothing to store")
    return spark.read.schema(schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it doesn't exist."""
    files, place = _file_system(spark, path)
    if not files.exists(place):
        return []
    return [status.getPath().getName() for status in files.listStatus(place) if status.isDirectory()]


def delete_folder(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables of what runs inside go to a folder that is deleted at the end."""
    shared = shared_dir(spark)
    folder = f"{shared}/scratch-{uuid.uuid4().hex}"
    before = spark.conf.get(SCRATCH, None)
    spark.conf.set(SCRATCH, folder)
    try:
        yield
    finally:
        spark.conf.unset(SCRATCH) if before is None else spark.conf.set(SCRATCH, before)
        delete_folder(spark, folder)
