"""Run collapsing, head and tail, generic and list condensing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip as strip_text
from .contract import always_keep, always_strip, apply_contract, param
from .ordered import SEG, carried, emit, group_keys, is_segmented, ranked_ends, runs

# A directory with more files than this becomes one row.
FILES_SHOWN = 3


def _as_column(value: int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def collapse_runs(
    lines: DataFrame, min_repeats: int | Column = 3, trim: bool = True, fold: Column | None = None
) -> DataFrame:
    """Runs of at least ``min_repeats`` equal lines become ``line [repeated Nx]``; shorter
    runs, and those of documents that are not to ``fold``, stay as they are. Blank lines are dropped, ``trim`` compares stripped lines."""
    rows = lines.filter(~is_blank(F.col("line")))
    if trim:
        rows = rows.withColumn("line", strip_text(F.col("line")))
    found = runs(rows)
    folded = F.col("cnt") >= _as_column(min_repeats)
    folded = folded if fold is None else folded & fold
    copies = F.when(folded, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("cnt") - 1))
    text = F.when(folded, F.concat("line", F.lit(" [repeated "), F.col("cnt").cast("string"), F.lit("x]")))
    extra = [SEG] if is_segmented(found) else []
    return (
        found.withColumn("line", F.coalesce(text, F.col("line")))
        .select("doc_id", *extra, *carried(found), "line", "pos", F.explode(copies).alias("copy"))
        .withColumn("pos", F.col("pos") + F.col("copy"))
        .drop("copy")
    )


def clamp(max_lines: Column, head: Column, tail: Column) -> tuple[Column, Column]:
    """Shrink head and tail, in proportion, to fit ``max_lines``."""
    both = head + tail
    share = F.floor(max_lines * (head.cast("double") / both)).cast("int")
    small_head = F.greatest(F.lit(1), share)
    fits = both <= max_lines
    return (
        F.when(fits, head).otherwise(small_head),
        F.when(fits, tail).otherwise(F.greatest(F.lit(0), max_lines - small_head)),
    )


def head_tail(
    rows: DataFrame,
    max_lines: int | Column = 50,
    head_lines: int | Column = 20,
    tail_lines: int | Column = 10,
    *,
    unit: str = "lines",
    keep_short: bool = False,
    mark_all: bool = False,
    keys: Sequence[str] = ("doc_id",),
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """First and last rows with ``... [N more unit]`` between them.

    ``keep_short`` leaves documents of up to ``max_lines`` rows whole (list rule). Without it
    (generic rule) only head and tail stay, the tail is at least one row, and rows lost from
    a document of up to ``max_lines`` rows are not marked unless ``mark_all`` is set.
    """
    limit, head, tail = _as_column(max_lines), _as_column(head_lines), _as_column(tail_lines)
    head, tail = clamp(limit, head, tail)
    if not keep_short:
        tail = F.greatest(tail, F.lit(1))
    first = F.greatest(limit, head) if keep_short else head
    ranked = ranked_ends(rows, first, tail, keys, order)
    idx, total = F.col("idx"), F.col("total")
    at_ends = (idx <= head) | (idx > total - tail)
    left_out = F.greatest(total - head - tail, F.lit(0))
    shown = ((total <= limit) | at_ends) if keep_short else at_ends
    marked = (left_out > 0) if mark_all and not keep_short else (left_out > 0) & (total > limit)
    marker = F.concat(F.lit("... ["), left_out.cast("string"), F.lit(f" more {unit}]"))
    return emit(ranked, [(shown, 2 * idx, F.col("line")), ((idx == 1) & marked, 2 * head + 1, marker)], keys)


def generic(
    lines: DataFrame,
    max_lines: int = 50,
    head_lines: int = 20,
    tail_lines: int = 10,
    dedup_min_repeats: int = 3,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Collapse runs, strip, show both ends; strip comes first here, so keep wins."""
    emitted = always_strip(
        collapse_runs(lines, param(lines, "dedup_min_repeats", dedup_min_repeats)), strip
    )
    shown = head_tail(
        emitted,
        param(lines, "max_lines", max_lines),
        param(lines, "head_lines", head_lines),
        param(lines, "tail_lines", tail_lines),
    )
    return always_keep(shown, lines, keep)


def dirname(path: Column) -> Column:
    """Part before the last slash, without trailing slashes unless it is all slashes."""
    head = F.regexp_extract(path, "(?s)^.*/", 0)
    return F.when(head.rlike(r"^/*\z"), head).otherwise(F.regexp_replace(head, r"/+\z", ""))


def group_by_directory(rows: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Rows without a slash first, then directories in first-seen order; a directory of more
    than three files becomes one row. Adds ``part`` and ``grp`` to the sort key. Documents that are
    not ``wanted`` keep their rows (whole documents only)."""
    is_path = F.contains("line", F.lit("/")) | F.contains("line", F.lit("\\"))
    if is_segmented(rows):
        return _group_segmented(rows, is_path)
    if wanted is not None:
        is_path = is_path & F.coalesce(wanted, F.lit(False))
    # the documents are together already: look around inside each directory
    rows = rows.withColumn("dir", F.when(is_path, dirname(F.col("line"))))
    near = Window.partitionBy("doc_id", "dir")
    rows = rows.withColumns({"files": F.count("*").over(near), "first": F.min("pos").over(near)})
    in_dir = F.col("dir").isNotNull()
    many = in_dir & (F.col("files") > FILES_SHOWN)
    rows = rows.filter(~many | (F.col("pos") == F.col("first")))
    rows = rows.withColumns(
        {
            "line": F.when(many, _folder_line()).otherwise(F.col("line")),
            "part": in_dir.cast("int"),
            "grp": F.when(in_dir, F.col("first")).otherwise(F.lit(0).cast("bigint")),
        }
    )
    return rows.drop("dir", "files", "first")


def _folder_line() -> Column:
    return F.concat("dir", F.lit("/... ["), F.col("files").cast("string"), F.lit(" files]"))


def _group_segmented(rows: DataFrame, is_path: Column) -> DataFrame:
    """Count files per directory first; only directories with few files are matched with rows."""
    zero = F.lit(0).cast("bigint")
    others = rows.filter(~is_path).withColumns({"part": F.lit(0), "grp": zero})
    paths = rows.filter(is_path).withColumn("dir", dirname(F.col("line")))
    folders = paths.groupBy("doc_id", "dir").agg(
        F.count("*").alias("files"), F.min("pos").alias("grp"), (F.min(SEG) + F.lit(1 << 40)).alias(SEG)
    )
    near = Window.partitionBy(*group_keys(paths, ("doc_id",)), "dir")
    paths = paths.withColumn("_n", F.count("*").over(near)).filter(F.col("_n") <= FILES_SHOWN).drop("_n", SEG)
    few = folders.filter(F.col("files") <= FILES_SHOWN).drop("files")
    listed = paths.join(few, ["doc_id", "dir"]).withColumn("part", F.lit(1)).drop("dir")
    many = folders.filter(F.col("files") > FILES_SHOWN).withColumns(
        {"line": _folder_line(), "part": F.lit(1), "pos": F.col("grp")}
    )
    return others.unionByName(listed).unionByName(many.drop("dir", "files"))


def list_lines(
    lines: DataFrame,
    max_lines: int = 30,
    head_lines: int = 20,
    tail_lines: int = 5,
    group_dirs: bool = False,
    dedup: bool = False,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Drop blanks, fold repeats and directories where asked, show both ends."""
    per_row = "p" in lines.columns
    rows = lines.filter(~is_blank(F.col("line")))
    if per_row:
        rows = collapse_runs(rows, 2, trim=False, fold=param(lines, "dedup", dedup))
        rows = group_by_directory(rows, param(lines, "group_by_directory", group_dirs))
    else:
        rows = collapse_runs(rows, 2, trim=False) if dedup else rows
        rows = group_by_directory(rows) if group_dirs else rows
    order = ("part", "grp", "pos") if "part" in rows.columns else ("pos",)
    shown = head_tail(
        rows,
        param(lines, "max_lines", max_lines),
        param(lines, "head_lines", head_lines),
        param(lines, "tail_lines", tail_lines),
        unit="items",
        keep_short=True,
        order=order,
    )
    return apply_contract(shown, lines, keep, strip)
