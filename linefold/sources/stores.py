"""Registry and history as tables on disk that batch jobs extend.

Every job writes the partition that its ``version`` or ``batch`` names, with Spark's dynamic partition overwrite: the partition
appears when the job commits, and a repeated job replaces its own. What a job starts from has a smaller number, so it is
the same when the job is repeated. Old partitions are dropped as folders.

History is laid out by ranges of ids: a partition column has the range, files inside are sorted by id. A lookup by id reads one
partition, and its filter reaches the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_folder, folders_in
from .history import HISTORY_COLUMNS, numbered
from .registry import merge_registry

IDS = 1 << 20


def _numbers(spark: SparkSession, path: str, column: str) -> list[int]:
    """The values of a table's outer partition column, from its folders."""
    names = [name.removeprefix(f"{column}=") for name in folders_in(spark, path)]
    return sorted(int(name) for name in names if name.isdigit())


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).parquet(path)


def registry_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The registry of a version, by default the latest one; None if there is none."""
    versions = _numbers(spark, path, "version")
    if not versions or (version is not None and version not in versions):
        return None
    wanted = versions[-1] if version is None else version
    return spark.read.parquet(path).filter(F.col("version") == wanted).drop("version")


def merge_into_store(calls: DataFrame, path: str, version: int) -> DataFrame:
    """Fold a call log into the latest registry before ``version`` and write it as that version."""
    spark = calls.sparkSession
    before = [v for v in _numbers(spark, path, "version") if v < version]
    merged = merge_registry(calls, registry_version(spark, path, before[-1]) if before else None)
    _write(merged.withColumn("version", F.lit(version)), path, "version")
    return registry_version(spark, path, version)


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Drop all but the latest ``keep`` versions; the dropped ones."""
    old = _numbers(spark, path, "version")[: -keep or None]
    for version in old:
        delete_folder(spark, f"{path}/version={version}")
    return old


def _range_of(entry_id: Column, width: int) -> Column:
    return F.floor(entry_id / width).cast("long")


def _ranges(spark: SparkSession, path: str, batch: int) -> list[int]:
    return _numbers(spark, f"{path}/batch={batch}", "ids")


def _read_ranges(spark: SparkSession, path: str, wanted: list[tuple[int, int]]) -> DataFrame:
    """The entries of ranges ``(batch, range)``; no other folder of the store is listed."""
    folders = [f"{path}/batch={batch}/ids={i}" for batch, i in wanted]
    return spark.read.option("basePath", path).parquet(*folders or [path])


def _newest_id(spark: SparkSession, path: str, batch: int) -> int:
    """The largest id of a batch, which is in its last range; 0 if it has none."""
    ranges = _ranges(spark, path, batch)
    return _read_ranges(spark, path, [(batch, ranges[-1])]).agg(F.max("id")).first()[0] if ranges else 0


def append_to_store(results: DataFrame, path: str, batch: int, width: int = IDS) -> None:
    """Number a batch's results after those of all smaller batches, and write them in ranges of ``width`` ids."""
    spark = results.sparkSession
    before = [b for b in _numbers(spark, path, "batch") if b < batch]
    first = 1
    if before:
        first += _newest_id(spark, path, before[-1])
    entries = numbered(results, first).withColumns({"batch": F.lit(batch), "ids": _range_of(F.col("id"), width)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _write(entries.repartitionByRange(parts, "id").sortWithinPartitions("ids", "id"), path, "batch", "ids")


def stored_history(spark: SparkSession, path: str, max_entries: int = 0, width: int = IDS) -> DataFrame:
    """All entries, or the newest ``max_entries``: older ranges aren't read."""
    if max_entries <= 0:
        return spark.read.parquet(path).select(*HISTORY_COLUMNS)
    batches = _numbers(spark, path, "batch")
    least = _newest_id(spark, path, batches[-1]) - max_entries + 1 if batches else 0
    wanted = [(b, i) for b in batches for i in _ranges(spark, path, b) if i >= least // width]
    return _read_ranges(spark, path, wanted).filter(F.col("id") >= least).select(*HISTORY_COLUMNS)


def stored_by_id(spark: SparkSession, path: str, ids: list[int], width: int = IDS) -> DataFrame:
    """The entries with these ids: one partition range and a pushed filter each."""
    ranges = {i // width for i in ids}
    wanted = [(b, i) for b in _numbers(spark, path, "batch") for i in _ranges(spark, path, b) if i in ranges]
    return _read_ranges(spark, path, wanted).filter(F.col("id").isin(ids)).select(*HISTORY_COLUMNS)


def expire(spark: SparkSession, path: str, max_entries: int, width: int = IDS) -> int:
    """Drop the ranges of which no entry is among the newest ``max_entries``; how many folders went."""
    batches = _numbers(spark, path, "batch")
    if not batches:
        return 0
    newest = _newest_id(spark, path, batches[-1])
    old = [f"{path}/batch={b}/ids={r}" for b in batches for r in _ranges(spark, path, b) if (r + 1) * width <= newest - max_entries + 1]
    for folder in old:
        delete_folder(spark, folder)
    return len(old)
