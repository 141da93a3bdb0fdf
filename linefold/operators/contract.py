"""User contract: lines that must stay and lines that must go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import bad_patterns, java_patterns
from .ordered import carried, cut, is_segmented

KEEP_ORD = 1 << 61
PYTHON_LIKE = "(?Ud)"


def matches_any(line: Column, patterns: list[str], column: Column | None = None) -> Column:
    """``line`` matches a literal pattern, each tested by itself, or one of a pattern column.

    A literal pattern that does not compile is an error of the call, before any job runs."""
    if bad := bad_patterns(patterns):
        raise ValueError(f"patterns do not compile: {bad}")
    hit = F.lit(False)
    for pattern in java_patterns(patterns).values():
        hit = hit | line.rlike(PYTHON_LIKE + pattern)
    if column is not None:
        in_column = F.exists(column, lambda p: F.rlike(line, F.concat(F.lit(PYTHON_LIKE), p)))
        hit = hit | F.coalesce(in_column, F.lit(False))
    return hit


def param(df: DataFrame, name: str, default) -> Column:
    """A rule parameter: the value that came with the document, else the default."""
    if isinstance(default, Column):
        return default
    fallback = F.array().cast("array<string>") if default == [] else F.lit(default)
    if "p" in df.columns and name in df.schema["p"].dataType.names:
        return F.coalesce(F.col("p")[name], fallback)
    return fallback


def _column(df: DataFrame, name: str) -> Column | None:
    return F.col("p")[name] if "p" in df.columns and name in df.schema["p"].dataType.names else None


def _has_rules(df: DataFrame, name: str, patterns: list[str]) -> bool:
    return bool(patterns) or _column(df, name) is not None


def always_strip(rows: DataFrame, strip: list[str] | None = None) -> DataFrame:
    strip = strip or []
    if not _has_rules(rows, "always_strip", strip):
        return rows
    return rows.filter(~matches_any(F.col("line"), strip, _column(rows, "always_strip")))


def kept_lines(lines: DataFrame, keep: list[str] | None = None) -> DataFrame | None:
    """The lines that must stay, or None without such rules."""
    if not _has_rules(lines, "always_keep", keep or []):
        return None
    return lines.filter(matches_any(F.col("line"), keep or [], _column(lines, "always_keep")))


def always_keep(
    result: DataFrame, lines: DataFrame, keep: list[str] | None = None, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Add matching original lines that the result lost: at the end, in order, each text once.

    Both sides are brought to one row per (document, text) before they meet.
    """
    wanted = kept_lines(lines, keep)
    if wanted is None:
        return result
    wanted = wanted.groupBy(*keys, "line").agg(
        (F.min("pos") + F.lit(KEEP_ORD)).alias("ord"), *[F.any_value(c).alias(c) for c in carried(lines)]
    )
    # the result is read twice from here
    result = cut(result, is_segmented(lines))
    lost = wanted.join(result.select(*keys, "line").distinct(), [*keys, "line"], "left_anti")
    return result.unionByName(lost.select(*result.columns))


def apply_contract(
    result: DataFrame, lines: DataFrame, keep: list[str] | None = None, strip: list[str] | None = None
) -> DataFrame:
    """Keep first, then strip (so strip wins)."""
    return always_strip(always_keep(result, lines, keep), strip)
