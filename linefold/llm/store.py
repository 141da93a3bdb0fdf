"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.session import shared_dir


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def stage(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back, so that later steps don't compute it again."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        folders = {f.rpartition("/")[0] for f in table.inputFiles()}
        jvm = table.sparkSession.sparkContext._jvm
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of an id as text, modulo ``modulus``; a null id counts as 0."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(modulus))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows; larger ones join by shuffle."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def shared(spark: SparkSession, value: Any) -> Callable[[], Any]:
    """Broadcast a value of this package's types; tasks call the result to get it."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(held.value)
