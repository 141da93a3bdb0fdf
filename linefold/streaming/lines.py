"""Line by line rules for streams ``(run_id, seq, ts, line)``; they take batches as well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.safety import sensitive_text
from ..functions.text import is_blank, strip, strip_ansi
from ..operators.shapes import is_progress_error, is_progress_noise


def progress_errors(lines: DataFrame) -> DataFrame:
    """Error lines, at once and every time; all other lines are held back."""
    return lines.filter(~is_blank(F.col("line")) & is_progress_error(F.col("line")))


def is_significant(line: Column, strip_percentage: bool = True) -> Column:
    noise = is_progress_noise(line, F.length(strip(line)), F.lit(strip_percentage))
    return ~is_blank(line) & ~is_progress_error(line) & ~noise


def seconds(value: float) -> Column:
    return F.make_dt_interval(secs=F.lit(value))


def silences(lines: DataFrame, stall: float) -> DataFrame:
    """``(run_id, started, last, line)``: each run cut at every silence of ``stall`` seconds or more.

    Every line counts for the silence, swallowed ones too; ``line`` is the last significant one or null.
    Partial aggregation of session windows keeps a busy run from reaching one task line by line.
    """
    micros = round(stall * 1_000_000)
    # windows that just touch are merged, so a window a microsecond shorter splits at the full silence
    window = F.session_window("ts", f"{micros - 1} microseconds")
    significant = is_significant(F.col("line"))
    kind = lines.schema["ts"].dataType
    found = lines.groupBy("run_id", window.alias("w")).agg(
        F.max_by(F.when(significant, F.col("line")), F.when(significant, F.col("seq"))).alias("line"),
        F.max("ts").alias("last"),
    )
    return found.select("run_id", F.col("w.start").cast(kind).alias("started"), "last", "line")


def with_end(sessions: DataFrame, stall: float) -> DataFrame:
    """The runs' final lines: ``(run_id, started, ended, line)``."""
    ended = (F.col("last") + seconds(stall)).alias("ended")
    return sessions.filter("line is not null").select("run_id", "started", ended, "line")


def final_lines(lines: DataFrame, stall: float = 2.0) -> DataFrame:
    """Last significant line of each run up to a silence of ``stall`` seconds or its end.

    (A significant line cannot equal an error line, since the same text would have been taken for an error.)
    """
    return with_end(silences(lines, stall), stall)


def safe_lines(lines: DataFrame, extra_patterns: list[str] | None = None) -> DataFrame:
    """Escapes removed; blank and sensitive lines dropped."""
    clean = lines.withColumn("line", strip_ansi(F.col("line")))
    return clean.filter(~is_blank(F.col("line")) & ~sensitive_text(F.col("line"), extra_patterns))
