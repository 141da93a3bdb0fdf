"""Ordered work inside documents that may be of any size.

A line table is ``lines(doc_id, pos, line)``. Two forms are used throughout:

* *whole*: the lines came out of one text value held under the output size limit, so a
  window over ``doc_id`` has a proven bound;
* *segmented* (a ``seg`` column is present): a document may hold any share of the table.
  Windows then run over (doc_id, seg), at most ``WIDTH`` positions each, and what crosses
  a segment border travels through a summary of one row per segment, joined back on
  (doc_id, seg). No task ever holds a whole document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WIDTH = 1 << 20
SEG = "seg"
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def segment(lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """Mark documents as unbounded: split them by position."""
    return in_segments(lines, F.floor(F.col("pos") / F.lit(width)))


def in_segments(df: DataFrame, segment_no: Column, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Add the segment column. Rows belong to a document and a place; saying so here gives both sides
    of the later join on them the same filter, so that they share one shuffle."""
    df = df.withColumn(SEG, segment_no.cast("bigint"))
    for key in (*keys, SEG):
        df = df.filter(F.col(key).isNotNull())
    return df


def is_segmented(df: DataFrame) -> bool:
    return SEG in df.columns


def carried(df: DataFrame) -> list[str]:
    """Columns that are constant inside a document and follow its lines."""
    return [c for c in ("p",) if c in df.columns]


def group_keys(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*keys, SEG] if is_segmented(df) else list(keys)


def _ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], reverse: bool = False):
    by = [F.col(c).desc() if reverse else F.col(c) for c in order]
    return Window.partitionBy(*group_keys(df, keys)).orderBy(*by)


def scan(
    df: DataFrame,
    *,
    sums: dict[str, Column] | None = None,
    last: dict[str, Column] | None = None,
    nxt: dict[str, Column] | None = None,
    totals: dict[str, Column] | None = None,
    keys: Sequence[str] = ("doc_id",),
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Add columns that look along a document.

    ``sums``: running sum up to and with this row. ``last``: latest non-null value on an
    earlier row. ``nxt``: first non-null value on a later row. ``totals``: sum over the document.
    """
    sums, last, nxt, totals = sums or {}, last or {}, nxt or {}, totals or {}
    forward = _ordered(df, keys, order)
    backward = _ordered(df, keys, order, reverse=True)
    whole = Window.partitionBy(*group_keys(df, keys))
    local = {
        **{n: F.sum(e).over(forward.rowsBetween(*_UPTO)) for n, e in sums.items()},
        **{n: F.last(e, ignorenulls=True).over(forward.rowsBetween(*_BEFORE)) for n, e in last.items()},
        **{n: F.last(e, ignorenulls=True).over(backward.rowsBetween(*_BEFORE)) for n, e in nxt.items()},
    }
    if not is_segmented(df):
        local |= {n: F.sum(e).over(whole) for n, e in totals.items()}
        return df.withColumns({n: F.coalesce(c, F.lit(0)) if n in sums else c for n, c in local.items()})

    position = F.struct(*order)
    summary = df.groupBy(*keys, SEG).agg(
        *[F.sum(e).alias(f"_{n}") for n, e in {**sums, **totals}.items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(f"_{n}") for n, e in last.items()],
        *[F.min_by(e, F.when(e.isNotNull(), position)).alias(f"_{n}") for n, e in nxt.items()],
    )
    segs = Window.partitionBy(*keys).orderBy(SEG)
    segs_back = Window.partitionBy(*keys).orderBy(F.col(SEG).desc())
    border = {
        **{f"_{n}": F.coalesce(F.sum(f"_{n}").over(segs.rowsBetween(*_BEFORE)), F.lit(0)) for n in sums},
        **{f"_{n}": F.last(f"_{n}", ignorenulls=True).over(segs.rowsBetween(*_BEFORE)) for n in last},
        **{f"_{n}": F.last(f"_{n}", ignorenulls=True).over(segs_back.rowsBetween(*_BEFORE)) for n in nxt},
        **{f"_{n}": F.sum(f"_{n}").over(Window.partitionBy(*keys)) for n in totals},
    }
    names = [f"_{n}" for n in (*sums, *last, *nxt, *totals)]
    summary = summary.withColumns(border).select(*keys, SEG, *names)
    joined = df.withColumns(local).join(summary, [*keys, SEG])
    joined = joined.withColumns(
        {
            **{n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"_{n}") for n in sums},
            **{n: F.coalesce(F.col(n), F.col(f"_{n}")) for n in (*last, *nxt)},
            **{n: F.col(f"_{n}") for n in totals},
        }
    )
    return joined.drop(*names)


def cut(df: DataFrame, segmented: bool | None = None) -> DataFrame:
    """Between chained scans of segmented lines: store them once in the shared folder.

    Each segmented scan reads its input twice; without the cut a chain would read it 2^n times.
    Whole documents need no join, so their chain stays one pass and nothing is stored.
    """
    from ..session import shared_dir

    if not (is_segmented(df) if segmented is None else segmented):
        return df
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ranked_ends(
    df: DataFrame,
    first: int | Column,
    last: int | Column,
    keys: Sequence[str] = ("doc_id",),
    order: Sequence[str] = ("pos",),
) -> DataFrame:
    """Add exact ``idx`` (from 1) and ``total`` per key, keeping at least the rows with
    ``idx <= first``, ``idx > total - last`` or ``idx = 1``.

    Segmented input is cut to its first and last rows inside each segment before the
    documents are put together, so a document moves (first + last) rows per segment.
    """
    first, last = (F.lit(v) if isinstance(v, int) else v for v in (first, last))
    rank = F.row_number().over(_ordered(df, keys, order))
    size = F.count(F.lit(1)).over(Window.partitionBy(*group_keys(df, keys)))
    if not is_segmented(df):
        df = df.withColumns({"idx": rank.cast("bigint"), "total": size})
        return df.filter((F.col("idx") == 1) | (F.col("idx") <= first) | (F.col("idx") > F.col("total") - last))
    df = df.withColumns({"_r": rank, "_n": size})
    df = df.filter((F.col("_r") == 1) | (F.col("_r") <= first) | (F.col("_r") > F.col("_n") - last))
    head_size = F.when(F.col("_r") == 1, F.col("_n"))
    along = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*_UPTO)
    df = df.withColumns(
        {
            "idx": F.sum(head_size).over(along) - F.col("_n") + F.col("_r"),
            "total": F.sum(head_size).over(Window.partitionBy(*keys)),
        }
    ).drop("_r", "_n")
    return df.filter((F.col("idx") == 1) | (F.col("idx") <= first) | (F.col("idx") > F.col("total") - last))


def attach(lines: DataFrame, per_doc: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per document to its lines; hot documents are matched segment by segment."""
    if not is_segmented(lines):
        return lines.join(per_doc, "doc_id", how)
    segments = lines.select("doc_id", SEG).distinct().join(per_doc, "doc_id", how)
    return lines.join(segments, ["doc_id", SEG], how)


def runs(df: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Gaps and islands: one row per run of equal consecutive ``line`` values, with
    ``pos`` (first), ``second`` (second position or null) and ``cnt``.

    Segments are reduced to their own runs first; only the first run of a segment can
    continue an earlier one, which the segment summary decides.
    """
    extra = carried(df)
    w = _ordered(df, keys, ("pos",))
    df = df.withColumn("_new", F.coalesce((F.lag("line").over(w) != F.col("line")).cast("int"), F.lit(1)))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(*_UPTO)))
    local = df.groupBy(*group_keys(df, keys), "_run").agg(
        F.min("line").alias("line"),
        F.min("pos").alias("pos"),
        F.min(F.when(F.col("_new") == 0, F.col("pos"))).alias("second"),
        F.count("*").alias("cnt"),
        *[F.any_value(c).alias(c) for c in extra],
    )
    if not is_segmented(df):
        return local.drop("_run")

    segs = Window.partitionBy(*keys).orderBy(SEG)
    summary = (
        local.groupBy(*keys, SEG)
        .agg(
            F.min_by("line", "pos").alias("_first"),
            F.max_by("line", "pos").alias("_last"),
            F.max("pos").alias("_at"),
            F.count("*").alias("_n"),
        )
        .withColumn("_joins", F.coalesce(F.lag("_last").over(segs) == F.col("_first"), F.lit(False)))
        .withColumn("_open", F.when((F.col("_n") > 1) | ~F.col("_joins"), F.col("_at")))
        .withColumn("_carry", F.last("_open", ignorenulls=True).over(segs.rowsBetween(*_BEFORE)))
        .select(*keys, SEG, F.when(F.col("_joins"), F.col("_carry")).alias("_leader"))
    )
    leader = F.when(F.col("_run") == 1, F.col("_leader"))
    joined = local.join(summary, [*keys, SEG]).withColumn("_start", F.coalesce(leader, F.col("pos")))
    return (
        joined.groupBy(*keys, "_start")
        .agg(
            F.min("line").alias("line"),
            F.min(SEG).alias(SEG),
            F.min(F.when(F.col("pos") != F.col("_start"), F.col("pos")).otherwise(F.col("second"))).alias("second"),
            F.sum("cnt").alias("cnt"),
            *[F.any_value(c).alias(c) for c in extra],
        )
        .withColumnRenamed("_start", "pos")
    )


def number_lines(df: DataFrame, key: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """Add ``pos``, the rank of a row inside ``key`` from 0.

    ``bucket`` must rise with ``order`` and bound the rows of one (key, bucket), so that a key
    of any size is ranked in many tasks.
    """
    ranked = scan(in_segments(df, bucket, (key,)), sums={"pos": F.lit(1)}, keys=(key,), order=order)
    return ranked.withColumn("pos", F.col("pos") - 1).drop(SEG)


def number_all(df: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Add the rank of each row in the whole table, from 0.

    The sorted rows are stored with their partition and place in it, which fixes both; the
    offsets are one row per partition.
    """
    from ..session import staged

    placed = df.orderBy(*order).withColumns(
        {"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id()}
    )
    placed = staged(placed, "sorted")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_UPTO)) - F.col("_n")
    offsets = sizes.select("_part", (before - F.col("_low")).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def emit(df: DataFrame, pieces: Sequence[tuple[Column, Column, Column]], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Turn each row into its result rows ``(ord, line)``: one per piece whose condition holds."""
    items = F.array(
        *[
            F.struct(
                F.coalesce(holds, F.lit(False)).alias("ok"), at.cast("bigint").alias("ord"), line.alias("line")
            )
            for holds, at, line in pieces
        ]
    )
    rows = F.transform(F.filter(items, lambda x: x["ok"]), lambda x: F.struct(x["ord"], x["line"]))
    return df.select(*keys, *carried(df), F.inline(rows).alias("ord", "line"))
