"""Command outputs from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ("doc_id", "command", "output")


def _named(df: DataFrame, columns: dict[str, str | Column]) -> DataFrame:
    picked = {name: columns.get(name, name) for name in COLUMNS}
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in picked.items()])


def read_outputs(
    spark: SparkSession, path: str, fmt: str = "parquet", text_command: str | None = None, **columns: str | Column
) -> DataFrame:
    """``outputs(doc_id, command, output)`` from parquet or JSON rows, or from text files.

    A text file is one output of ``text_command``. ``columns`` names or computes the three columns
    where the rows call them otherwise; only the columns in use are read.
    """
    if fmt == "text":
        files = spark.read.text(path, wholetext=True)
        return files.select(
            F.xxhash64(F.input_file_name()).alias("doc_id"), F.lit(text_command).alias("command"), F.col("value").alias("output")
        )
    return _named(spark.read.format(fmt).load(path), columns)


def stream_outputs(
    spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet", **columns: str | Column
) -> DataFrame:
    """The same from a folder that files keep arriving in."""
    return _named(spark.readStream.schema(schema).format(fmt).load(path), columns)
