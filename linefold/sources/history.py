"""History of raw and condensed outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import number_all

RECENT_COLUMNS = ["id", "command", "strategy", "source", "raw_tokens", "compressed_tokens", "created_at"]
HISTORY_COLUMNS = [
    "id",
    "command",
    "strategy",
    "source",
    "raw_output",
    "compressed_output",
    "raw_tokens",
    "compressed_tokens",
    "created_at",
]


def numbered(results: DataFrame, first_id: int = 1) -> DataFrame:
    """Give results ids in (created_at, doc_id) order."""
    ranked = number_all(results, ["created_at", "doc_id"], "_no")
    return ranked.withColumn("id", F.col("_no") + first_id).select(*HISTORY_COLUMNS)


def newest(history: DataFrame, max_entries: int) -> DataFrame:
    """The last ``max_entries`` entries (all of them for 0). Ids have no gaps, so a filter does it."""
    if max_entries <= 0:
        return history
    last = history.agg(F.max("id")).first()[0] or 0
    return history.filter(F.col("id") > last - max_entries)


def history_append(history: DataFrame | None, results: DataFrame, max_entries: int = 100) -> DataFrame:
    """Old and new entries, cut to the newest ones. With a limit only that many results are
    sorted and numbered, chosen by their keys; their ids still count all of them."""
    top = 0 if history is None else history.agg(F.max("id")).first()[0] or 0
    if max_entries > 0:
        many = results.count()
        if many > max_entries:
            key = F.struct("created_at", "doc_id")
            first = results.select(key.alias("key")).orderBy(F.col("key").desc()).limit(max_entries).agg(F.min("key").alias("first"))
            results = results.join(F.broadcast(first), key >= F.col("first")).drop("first")
        new = numbered(results, top + max(0, many - max_entries) + 1)
    else:
        new = numbered(results, top + 1)
    return newest(new if history is None else history.select(*HISTORY_COLUMNS).unionByName(new), max_entries)


def history_latest(history: DataFrame, command: str | None = None) -> DataFrame:
    """The newest entry, of all or of one command."""
    rows = history if command is None else history.filter(F.col("command") == command)
    return rows.orderBy(F.col("id").desc()).limit(1)


def history_latest_each(history: DataFrame) -> DataFrame:
    """The newest entry of each command."""
    latest = history.groupBy("command").agg(F.max_by(F.struct(*history.columns), "id").alias("row"))
    return latest.select("row.*")


def history_by_id(history: DataFrame, entry_id: int) -> DataFrame:
    return history.filter(F.col("id") == entry_id)


def history_recent(history: DataFrame, limit: int = 10) -> DataFrame:
    return history.select(*RECENT_COLUMNS).orderBy(F.col("id").desc()).limit(max(1, limit))


def restore(
    history: DataFrame, ids: list[int] | None = None, commands: list[str] | None = None, compressed: bool = False
) -> DataFrame:
    """Text of entries by id, else the latest of each command, else the latest of all."""
    if ids is not None:
        rows = history.filter(F.col("id").isin(ids))
    elif commands is not None:
        rows = history_latest_each(history.filter(F.col("command").isin(commands)))
    else:
        rows = history_latest(history)
    text = "compressed_output" if compressed else "raw_output"
    return rows.select("id", "command", F.col(text).alias("text"))
