"""Learning as a stream: the registry is the state of a query, one value per command.

A micro-batch costs as much as its own calls; entries that it doesn't touch aren't read or written. The state starts from a
registry table, if one is given, and ``registry_of_state`` exports it as a registry table with Spark's reader of state.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..sources.registry import GAIN, HOT, HOT_CALLS, INITIAL, LOCKED, LOSS
from .runs import use_rocksdb

ENTRY = (
    "source string, strategy string, calls long, confidence double, raw double, comp double, "
    "hot boolean, user_override boolean, micros long, params string"
)
FIELDS = [part.split()[0] for part in ENTRY.split(", ")]


def learnt(strategy: str, confidence: float, shape: str) -> tuple[str, float]:
    """Strategy and confidence after one call."""
    if confidence >= LOCKED:
        return strategy, confidence
    if strategy == shape:
        return strategy, min(1.0, confidence + GAIN)
    if confidence - LOSS < INITIAL:
        return shape, INITIAL
    return strategy, confidence - LOSS


class Learn(StatefulProcessor):
    """Folds a command's calls of a micro-batch into its entry, in the order of ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.entry.update(tuple(initialState[name] for name in FIELDS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls = sorted((r["seq"], r["shape"], r["raw"], r["comp"], r["micros"]) for r in rows)
        new = not self.entry.exists()
        before = ("learned", calls[0][1], 0, INITIAL, 0.0, 0.0, False, False, None, "{}") if new else self.entry.get()
        source, strategy, n, confidence, raw, comp, _, override, _, params = before
        if source != "user" and not override:
            for _, shape, *_ in calls[1:] if new else calls:
                strategy, confidence = learnt(strategy, confidence, shape)
        n += len(calls)
        raw += sum(c[2] for c in calls)
        comp += sum(c[3] for c in calls)
        hot = n >= HOT_CALLS and confidence >= HOT
        latest = max(c[4] for c in calls)
        self.entry.update((source, strategy, n, confidence, raw, comp, hot, override, latest, params))
        yield Row(command=key[0], strategy=strategy, calls=n, confidence=confidence, hot=hot)

    def close(self) -> None:
        pass


def start_of(registry: DataFrame) -> DataFrame:
    """A registry table as the first state of its commands."""
    return registry.select(
        "command",
        "source",
        "strategy",
        "calls",
        "confidence",
        (F.col("avg_raw_tokens") * F.col("calls")).alias("raw"),
        (F.col("avg_compressed_tokens") * F.col("calls")).alias("comp"),
        "hot",
        "user_override",
        F.unix_micros(F.col("last_seen").cast("timestamp")).alias("micros"),
        "params",
    )


def changed_entries(calls: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """``calls(command, seq, shape, raw, comp, ts)`` as a stream to the entries that each micro-batch changes.

    Calls of a command come in the order of ``seq`` from batch to batch. Rows without a command are left out.
    """
    use_rocksdb(calls.sparkSession)
    rows = calls.filter("command is not null").select(
        "command", "seq", "shape", F.col("raw").cast("double"), F.col("comp").cast("double"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros")
    )
    start = None if initial is None else start_of(initial).groupBy("command")
    schema = "command string, strategy string, calls long, confidence double, hot boolean"
    return rows.groupBy("command").transformWithState(Learn(), schema, "Update", "none", initialState=start)


def stream_learn(calls: DataFrame, checkpoint: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Learn from everything available now; the registry is in the state under ``checkpoint``."""
    changed = changed_entries(calls, initial)
    return (
        changed.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def registry_of_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The registry after the last micro-batch."""
    use_rocksdb(spark)
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "entry").load()
    rows = state.select(F.col("key.command").alias("command"), "value.*")
    calls = F.greatest(F.col("calls"), F.lit(1))
    raw, comp = F.col("raw") / calls, F.col("comp") / calls
    return rows.select(
        "command",
        "source",
        "strategy",
        "calls",
        "confidence",
        raw.alias("avg_raw_tokens"),
        comp.alias("avg_compressed_tokens"),
        F.when(raw > 0, comp / raw).otherwise(0.0).alias("compression_ratio"),
        "hot",
        "user_override",
        F.timestamp_micros("micros").alias("last_seen"),
        "params",
    )
