"""Rows behind the watermark, kept aside before a stateful operator would drop them; sessions of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from .lines import seconds
from .sinks import foreach_batch


def split_late(rows: DataFrame, path: str, checkpoint: str, delay: float) -> StreamingQuery:
    """Write a stream of rows with ``ts`` to ``path``: those at most ``delay`` seconds behind the latest time of all batches
    before, and the late ones.

    An operator that reads the rows on time, in any batches in the order they were written, with a watermark of the same delay drops
    none of them. A batch writes folders of its own, so a repeated one replaces its rows. Rows without ``ts`` are on time.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/latest/batch={batch_id - 1}").first()["micros"] if batch_id > 0 else None
        latest = F.timestamp_micros(F.lit(before).cast("long"))
        at = F.col("ts").cast("timestamp")
        late = F.coalesce(at <= latest - seconds(delay), F.lit(False))
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        newest = batch.agg(F.unix_micros(F.greatest(F.max(at), latest)).alias("micros"))
        newest.write.mode("overwrite").parquet(f"{path}/latest/batch={batch_id}")

    return foreach_batch(rows, checkpoint, work)


def on_time(reader: DataStreamReader, path: str) -> DataFrame:
    """The rows on time as a stream; ``reader`` has their schema."""
    return reader.parquet(f"{path}/rows/batch=*/late=false")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows so far."""
    return spark.read.parquet(f"{path}/rows").filter("late = 'true'").drop("late", "batch")


def stall_sessions(chunks: DataFrame, stall: float = 2.0, delay: float | None = None) -> DataFrame:
    """``(run_id, started, ended, first_seq, last_seq, n_chunks, n_bytes)`` of every stretch of a run without a silence of
    ``stall`` seconds, in batch or as a stream with a watermark of ``delay`` seconds.

    Session windows are merged from partial ones, so a busy run isn't one task's.
    """
    df = chunks.filter("run_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is not None:
        df = df.withWatermark("ts", f"{round(delay * 1000)} milliseconds")
    # windows that just touch are merged, so a window a microsecond shorter splits at the full silence
    window = F.session_window("ts", f"{round(stall * 1_000_000) - 1} microseconds")
    found = df.groupBy("run_id", window.alias("w")).agg(
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count("*").alias("n_chunks"),
        F.sum(F.octet_length("chunk")).alias("n_bytes"),
    )
    return found.drop("w")
