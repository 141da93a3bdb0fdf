"""Streaming queries with exactly-once sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.condense import Settings, condense_outputs, condense_tool_events
from ..session import scratch, staged


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything available now to a parquet table."""
    return (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def foreach_batch(df: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run ``work`` on every micro-batch; its intermediate tables go when it is done."""

    def tidy(batch: DataFrame, batch_id: int) -> None:
        with scratch(batch.sparkSession):
            work(batch, batch_id)

    return (
        df.writeStream.foreachBatch(tidy).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stream_condense(
    outputs: DataFrame, path: str, checkpoint: str, settings: Settings | None = None, **tables: DataFrame
) -> StreamingQuery:
    """Condense each micro-batch. A batch writes its own folder, so a repeated batch replaces it."""

    def work(batch: DataFrame, batch_id: int) -> None:
        condense_outputs(batch, settings=settings, **tables).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return foreach_batch(outputs, checkpoint, work)


def stream_tool_events(lines: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Answer a stream of JSON lines ``(value)``, one tool event each.

    Each micro-batch writes its JSON answers as text to ``answers`` and the lines that are no JSON objects, blank ones
    aside, to ``corrupt``; a repeated batch replaces both. Events that need no answer get none.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        parsed = F.try_parse_json("value")
        shaped = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
        rows = batch.filter(F.trim("value") != "").select(F.monotonically_increasing_id().alias("doc_id"), "value", shaped.alias("event"))
        rows = staged(rows, "events")
        answers = condense_tool_events(rows.filter("event").drop("event"), **options)
        answers.select("value").write.mode("overwrite").text(f"{path}/answers/batch={batch_id}")
        rows.filter("not event").select("value").write.mode("overwrite").text(f"{path}/corrupt/batch={batch_id}")

    return foreach_batch(lines, checkpoint, work)
