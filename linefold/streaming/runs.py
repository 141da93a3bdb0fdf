"""Stateful streams of terminal runs: chunks to lines and to silent segments, lines to errors and final lines.

Streams have ``(run_id, seq, ts, ..., eof)``; ``eof`` is true on a run's last row. Rows may come late by ``delay`` seconds and in any
order: state per run holds them until the watermark has passed them, and then takes them in the order of ``seq`` (as ``ts`` rises
with ``seq``). Timers of event time tell silences of ``stall`` seconds or more. Rows still later than that are dropped by the watermark;
``late.py`` splits them off beforehand so that none is lost (Spark's first watermark is the start of 1970). Rows without ``run_id``, ``seq`` or ``ts`` have no place in a run and are left out.

State is bounded by the rows of ``delay`` seconds and, for lines, by ``max_line``: longer lines go out in numbered parts. Segments
over ``max_bytes`` go out chunk by chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ..functions.text import MAX_OUTPUT_BYTES, OVERSIZE, is_blank
from ..operators.chunks import MAX_LINE
from ..operators.shapes import is_progress_error
from .lines import is_significant, safe_lines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows in one value of a list state.
PACK = 1000
_ZERO = datetime(1970, 1, 1, tzinfo=UTC)


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors need this state store; queries started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def timestamp(micros: int) -> datetime:
    return _ZERO + timedelta(microseconds=micros)


class InOrder(StatefulProcessor):
    """Takes a run's rows in the order of ``seq`` when the watermark has passed them.

    Rows have ``seq``, ``at`` (microseconds), ``eof`` and the ``payload`` column. Subclasses say what a row (``take``), a silence and the
    end of the run give; their state is read (``load``) and written (``save``) once for all rows that are taken together.

    Every access to state is a round trip to the JVM, so a run costs a few of them a micro-batch, however many rows it has: rows are held in
    packs, and read back when the watermark has passed the earliest; one timer waits for the next row or silence.
    """

    payload = "line"

    def __init__(self, stall: float | None) -> None:
        self.stall = None if stall is None else round(stall * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # time of the last row taken, earliest time of the rows held, next timer (milliseconds)
        self.run = handle.getValueState("run", "last long, first long, wake long")
        self.held = handle.getListState("held", "pack array<struct<seq: long, at: long, value: string, eof: boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(row["seq"], row["at"], row[self.payload], bool(row["eof"])) for row in rows]
        yield from self.release(key, timerValues.getCurrentWatermarkInMs() * 1000, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.release(key, timerValues.getCurrentWatermarkInMs() * 1000, [], expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def release(self, key, passed: int, new: list[tuple], expired: int | None = None) -> Iterator[Row]:
        before = self.run.get() or (None, None, None)
        self.last, first, wake = before
        wake = None if wake == expired else wake
        first = min([row[1] for row in new] + ([] if first is None else [first]), default=None)
        taken = first is not None and first <= passed
        silent = self.is_silent(passed)
        if taken or silent:
            self.load()
        if taken:
            held = {row[0]: tuple(row) for (pack,) in self.held.get() for row in pack}
            held.update((row[0], row) for row in new)
            ordered = [held[seq] for seq in sorted(held)]
            final = max((seq for seq, at, _, _ in ordered if at <= passed), default=None)
            n = 0 if final is None else sum(row[0] <= final for row in ordered)
            for seq, at, value, eof in ordered[:n]:
                yield from self.end_silence(key, at)
                yield from self.take(key, seq, at, value)
                self.last = at if self.last is None else max(at, self.last)
                if eof:
                    yield from self.finish(key, at)
                    self.last = None
            left = ordered[n:]
            first = min((row[1] for row in left), default=None)
            self.held.put(packs(left)) if left else self.held.clear()
        elif new:
            self.held.appendList(packs(new))
        if taken or silent:
            yield from self.end_silence(key, passed)
            self.save()
        due = [] if first is None else [first]
        if self.stall is not None and self.last is not None:
            due.append(self.last + self.stall)
        if due and (wake is None or -(-min(due) // 1000) < wake):
            wake = -(-min(due) // 1000)
            self.handle.registerTimer(wake)
        if (self.last, first, wake) != tuple(before):
            self.run.update((self.last, first, wake))

    def is_silent(self, now: int) -> bool:
        return self.stall is not None and self.last is not None and now - self.last >= self.stall

    def end_silence(self, key, now: int) -> Iterator[Row]:
        """What a silence gives that is over by ``now``."""
        if self.is_silent(now):
            yield from self.finish(key, self.last + self.stall)
            self.last = None

    def load(self) -> None:
        raise NotImplementedError

    def save(self) -> None:
        raise NotImplementedError

    def take(self, key, seq: int, at: int, value: str | None) -> Iterator[Row]:
        raise NotImplementedError

    def finish(self, key, at: int) -> Iterator[Row]:
        raise NotImplementedError


def packs(rows: list[tuple]) -> list[tuple]:
    """Rows as values of a list state."""
    return [(rows[i : i + PACK],) for i in range(0, len(rows), PACK)]


class Kept:
    """Values of a list state that grow at the end; those of earlier micro-batches are read only when needed."""

    def __init__(self, state: ListState, some: bool) -> None:
        self.state, self.some, self.unread, self.new = state, some, some, []

    def add(self, *value) -> None:
        self.new.append(value)

    def all(self) -> list[tuple]:
        if self.unread:
            self.new, self.unread = [*self.state.get(), *self.new], False
        return self.new

    def clear(self) -> None:
        self.new, self.unread = [], False

    def save(self) -> None:
        if self.some and not self.unread:
            self.state.put(self.new) if self.new else self.state.clear()
        elif self.new:
            self.state.appendList(self.new)


class Lines(InOrder):
    """Lines of a run's chunks; the unfinished one is carried as pieces."""

    payload = "chunk"

    def __init__(self, stall: float | None, max_line: int) -> None:
        super().__init__(stall)
        self.max_line = max_line

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "pos long, part long, size long")
        self.rest = handle.getListState("rest", "piece string")

    def load(self) -> None:
        self.pos, self.part, self.size = self.place.get() or (0, 0, 0)
        self.pieces = Kept(self.rest, self.size > 0)

    def save(self) -> None:
        self.pieces.save()
        self.place.update((self.pos, self.part, self.size))

    def row(self, key, pos: int, part: int, at: int, line: str | None, eof: bool) -> Row:
        return Row(run_id=key[0], pos=pos, part=part, ts=timestamp(at), line=line, eof=eof)

    def joined(self) -> str:
        return "".join(piece for (piece,) in self.pieces.all())

    def take(self, key, seq: int, at: int, value: str | None) -> Iterator[Row]:
        first, *others = (value or "").split("\n")
        self.add(first)
        for piece in others:
            for text, number in self.parts(self.joined(), self.part, whole=True):
                yield self.row(key, self.pos, number, at, text, False)
            self.begin(self.pos + 1, piece)
        if self.size > self.max_line:
            text = self.joined()
            part = self.part
            for piece, number in self.parts(text, part, whole=False):
                yield self.row(key, self.pos, number, at, piece, False)
                part = number + 1
            self.begin(self.pos, text[len(text) // self.max_line * self.max_line :], part)

    def begin(self, pos: int, piece: str, part: int = 0) -> None:
        """The unfinished line is ``piece`` so far."""
        self.pieces.clear()
        self.pos, self.part, self.size = pos, part, 0
        self.add(piece)

    def add(self, piece: str) -> None:
        if piece:
            self.pieces.add(piece)
        self.size += len(piece)

    def parts(self, text: str, first: int, whole: bool) -> Iterator[tuple[str, int]]:
        """Parts of a line of at most ``max_line`` characters, the last one too if the line is ``whole``."""
        n = len(text) // self.max_line
        if whole and (n * self.max_line < len(text) or not (n or first)):
            n += 1
        for i in range(n):
            yield text[i * self.max_line : (i + 1) * self.max_line], first + i

    def finish(self, key, at: int) -> Iterator[Row]:
        pos, part = self.pos, self.part
        text = self.joined()
        if text.strip() or (part and text):
            for piece, number in self.parts(text, part, whole=True):
                yield self.row(key, pos, number, at, piece, False)
            pos += 1
        # the end goes on to the next operator as a row without a line
        yield self.row(key, pos, 0, at, None, True)
        self.begin(pos + 1, "")


class Segments(InOrder):
    """The text of a run up to each silence, whole; the chunks themselves once a segment is over the limit."""

    payload = "chunk"

    def __init__(self, stall: float, max_bytes: int) -> None:
        super().__init__(stall)
        self.max_bytes = max_bytes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "segment long, started long, size long, kept boolean")
        self.chunks = handle.getListState("pieces", "seq long, piece string")

    def load(self) -> None:
        self.segment, self.started, self.size, kept = self.place.get() or (0, None, 0, False)
        self.pieces = Kept(self.chunks, kept)

    def save(self) -> None:
        self.pieces.save()
        self.place.update((self.segment, self.started, self.size, bool(self.pieces.unread or self.pieces.new)))

    def row(self, key, segment: int, started: int, part: int, at: int, text: str, reason: str | None) -> Row:
        return Row(run_id=key[0], segment=segment, started=timestamp(started), part=part, ts=timestamp(at), output=text, reason=reason)

    def take(self, key, seq: int, at: int, value: str | None) -> Iterator[Row]:
        self.started = at if self.started is None else self.started
        self.size += len((value or "").encode())
        self.pieces.add(seq, value or "")
        if self.size > self.max_bytes:
            for number, piece in self.pieces.all():
                yield self.row(key, self.segment, self.started, number, at, piece, OVERSIZE)
            self.pieces.clear()

    def finish(self, key, at: int) -> Iterator[Row]:
        if self.size <= self.max_bytes:
            yield self.row(key, self.segment, self.started, 0, at, "".join(piece for _, piece in self.pieces.all()), None)
        self.pieces.clear()
        self.segment, self.started, self.size = self.segment + 1, None, 0


class ErrorsAndFinal(InOrder):
    """Errors when they come, and the last significant line at a silence or the run's end.

    Rows have ``significant`` and ``error`` packed before the line, as the rules for them are Spark columns.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("open", "started long, seq long, line string")

    def load(self) -> None:
        self.open = self.place.get()

    def save(self) -> None:
        self.place.clear() if self.open is None else self.place.update(self.open)

    def take(self, key, seq: int, at: int, value: str | None) -> Iterator[Row]:
        started, best, line = self.open or (at, None, None)
        kind, text = (value[0], value[1:]) if value else ("-", None)
        if kind == "e":
            yield Row(run_id=key[0], kind="error", seq=seq, started=timestamp(at), ts=timestamp(at), line=text)
        elif kind == "s":
            best, line = seq, text
        self.open = (started, best, line)

    def finish(self, key, at: int) -> Iterator[Row]:
        if self.open is not None:
            started, seq, line = self.open
            if line is not None:
                yield Row(run_id=key[0], kind="final", seq=seq, started=timestamp(started), ts=timestamp(at), line=line)
            self.open = None


def _placed(df: DataFrame, delay: float | None, *columns: str) -> DataFrame:
    """Rows that have a place in a run, with their time as ``at`` and, for a ``delay``, a watermark."""
    for key in ("run_id", "seq", "ts"):
        df = df.filter(F.col(key).isNotNull())
    df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is not None:
        df = df.withWatermark("ts", f"{round(delay * 1000)} milliseconds")
    eof = F.coalesce("eof", F.lit(False)) if "eof" in df.columns else F.lit(False)
    return df.select("run_id", F.col("seq").cast("long"), "ts", F.unix_micros("ts").alias("at"), eof.alias("eof"), *columns)


def _key_type(df: DataFrame) -> str:
    return df.schema["run_id"].dataType.simpleString()


def lines_of_chunks(chunks: DataFrame, delay: float = 10.0, stall: float | None = None, max_line: int = MAX_LINE) -> DataFrame:
    """``(run_id, seq, ts, chunk[, eof])`` as a stream to ``(run_id, pos, part, ts, line, eof)``.

    ``pos`` numbers a run's lines from 0, ``part`` the parts of a line that is longer than ``max_line``. The rest goes out at
    the run's ``eof`` or, with ``stall``, at a silence; a blank rest is dropped. Each end gives a row without a line and with ``eof``.
    """
    use_rocksdb(chunks.sparkSession)
    placed = _placed(chunks, delay, "chunk")
    schema = f"run_id {_key_type(placed)}, pos long, part long, ts timestamp, line string, eof boolean"
    return placed.groupBy("run_id").transformWithState(
        Lines(stall, max_line), schema, "Append", "eventTime", eventTimeColumnName="ts"
    )


def segments_of_chunks(chunks: DataFrame, delay: float = 10.0, stall: float = 2.0, max_bytes: int = MAX_OUTPUT_BYTES) -> DataFrame:
    """``(run_id, seq, ts, chunk[, eof])`` as a stream to ``(run_id, segment, started, part, ts, output, reason)``.

    A segment up to ``max_bytes`` is one row at its end, with part 0. A larger one is a row per chunk, unchanged, with ``seq`` as part
    and a reason, from the moment it passes the limit. ``ts`` is the time at which a row goes out.
    """
    use_rocksdb(chunks.sparkSession)
    placed = _placed(chunks, delay, "chunk")
    schema = f"run_id {_key_type(placed)}, segment long, started timestamp, part long, ts timestamp, output string, reason string"
    return placed.groupBy("run_id").transformWithState(
        Segments(stall, max_bytes), schema, "Append", "eventTime", eventTimeColumnName="ts"
    )


def errors_and_final_lines(lines: DataFrame, delay: float | None = 10.0, stall: float | None = 2.0) -> DataFrame:
    """``(run_id, seq, ts, line[, eof])`` as a stream to ``(run_id, kind, seq, started, ts, line)``.

    ``error`` lines come once the watermark has passed them, a ``final`` line at every silence of ``stall`` seconds and at ``eof``: the
    last significant line since the one before, with the times at which its part of the run started and ended. ``delay`` None: the
    lines come from another stateful operator and have its watermark.
    """
    use_rocksdb(lines.sparkSession)
    line = F.col("line")
    kind = F.when(is_blank(line), "-").when(is_progress_error(line), "e").when(is_significant(line), "s").otherwise("-")
    placed = _placed(lines.withColumn("line", F.concat(kind, line)), delay, "line")
    schema = f"run_id {_key_type(placed)}, kind string, seq long, started timestamp, ts timestamp, line string"
    return placed.groupBy("run_id").transformWithState(
        ErrorsAndFinal(stall), schema, "Append", "eventTime", eventTimeColumnName="ts"
    )


def shown_lines(chunks: DataFrame, delay: float = 10.0, stall: float | None = 2.0, extra_patterns: list[str] | None = None) -> DataFrame:
    """The whole streaming run: chunks to lines, errors and final lines of them, those that are safe to show."""
    lines = lines_of_chunks(chunks, delay, stall)
    # parts of a line are lines to the rules; the end of a run has to pass
    lines = lines.withColumn("seq", F.col("pos") * (1 << 20) + F.col("part")).drop("pos", "part")
    # silences of the chunks end lines already
    return safe_lines(errors_and_final_lines(lines, None, None), extra_patterns)
