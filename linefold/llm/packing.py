"""Packing into optimal length buckets.

The histogram of all lengths is aggregated by Spark; dynamic programming over it chooses the bucket lengths that
minimise total padding, exactly, for at most ``buckets`` buckets. Lengths over ``FINE`` share a histogram cell with those that agree
in their leading 12 bits, so the histogram has a bounded number of cells (under ``FINE`` more per doubling); a cell's
own longest row is its length, and the minimum is exact over these cells.

Inside a bucket, rows are dealt into segments of about ``SEGMENT`` rows, so no bucket is one task, and each segment is cut into
batches of budget // bucket length rows. Only a segment's last batch can be short.

Every row gives a row with all its columns. Null lengths count as 0; null and empty texts have length 0. A row longer than the
budget is a batch alone. Repeated rows are rows like others. Existing columns with the names of new ones are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.llm.store import stage

FINE = 4096
SEGMENT = 8192
ADDED = ("bucket", "bucket_length", "batch_id", "slot", "padding")


@dataclass(frozen=True)
class Cell:
    """Rows of about one length."""

    longest: int
    rows: int
    tokens: int


def cell_of(length: Column) -> Column:
    """The length, or its leading 12 bits for large ones."""
    drop = F.greatest(F.floor(F.log2(F.greatest(length, F.lit(1)))).cast("int") - 11, F.lit(0))
    step = F.pow(F.lit(2.0), drop).cast("long")
    return F.when(length <= FINE, length).otherwise(F.ceil(length / step) * step)


def histogram(lengths: DataFrame) -> list[Cell]:
    """Cells of ``lengths(length)``, shortest first."""
    cells = lengths.groupBy(cell_of(F.col("length")).alias("cell"))
    found = cells.agg(F.max("length").alias("longest"), F.count("*").alias("rows"), F.sum("length").alias("tokens"))
    return sorted((Cell(r.longest, r.rows, r.tokens) for r in found.drop("cell").collect()), key=lambda c: c.longest)


def choose_lengths(cells: list[Cell], buckets: int) -> list[int]:
    """Bucket lengths with the least padding, by dynamic programming; ties go to fewer buckets.

    best[b][j] = min over i < j of best[b - 1][i] + longest[j] * rows(i..j) - tokens(i..j). For fixed i that is a line in
    longest[j], and slopes fall with i, so each layer takes one pass over a hull of lines.
    """
    n = len(cells)
    rows, tokens = [0], [0]
    for cell in cells:
        rows.append(rows[-1] + cell.rows)
        tokens.append(tokens[-1] + cell.tokens)
    best: list[int | None] = [0] + [None] * n
    choices: list[list[int]] = []
    totals: list[int] = []
    for _ in range(min(buckets, n)):
        hull: deque[tuple[int, int, int]] = deque()
        layer: list[int | None] = [None] * (n + 1)
        chosen = [0] * (n + 1)
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-rows[i], best[i] + tokens[i], i)
                while len(hull) > 1 and not needed(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            x = cells[j - 1].longest
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            if hull:
                layer[j] = hull[0][0] * x + hull[0][1] + x * rows[j] - tokens[j]
                chosen[j] = hull[0][2]
        choices.append(chosen)
        totals.append(layer[n])
        best = layer
    if not n:
        return []
    used = totals.index(min(totals)) + 1
    out, j = [], n
    for chosen in reversed(choices[:used]):
        out.append(cells[j - 1].longest)
        j = chosen[j]
    return out[::-1]


def needed(a: tuple, b: tuple, c: tuple) -> bool:
    """Whether line b is below both a and c somewhere."""
    return (b[1] - a[1]) * (b[0] - c[0]) < (c[1] - b[1]) * (a[0] - b[0])


def pack(rows: DataFrame, length_column: str, buckets: int = 16, budget: int = 32_768) -> DataFrame:
    """``rows`` with ``bucket``, ``bucket_length``, ``batch_id``, ``slot`` in the batch and ``padding``."""
    rows = rows.drop(*ADDED)
    names = rows.columns
    length = F.greatest(F.coalesce(F.col(length_column).cast("long"), F.lit(0).cast("long")), F.lit(0))
    held = stage(rows.select(F.struct(*names).alias("row"), length.alias("length")).withColumn("at", F.monotonically_increasing_id()), "lengths")
    cells = histogram(held)
    lengths = choose_lengths(cells, buckets)
    if not lengths:
        lengths, cells = [0], [Cell(0, 0, 0)]
    counts = [0] * len(lengths)
    for cell in cells:
        counts[bisect_left(lengths, cell.longest)] += cell.rows
    per_batch = [max(1, budget // max(1, x)) for x in lengths]
    segments = [max(1, -(-c // SEGMENT)) for c in counts]

    bucket = F.lit(len(lengths) - 1)
    for i in reversed(range(len(lengths) - 1)):
        bucket = F.when(F.col("length") <= lengths[i], i).otherwise(bucket)
    of_bucket = {name: F.array(*map(F.lit, values)) for name, values in
                 (("bucket_length", lengths), ("per_batch", per_batch), ("segments", segments))}
    dealt = held.withColumn("bucket", bucket)
    for name, values in of_bucket.items():
        dealt = dealt.withColumn(name, values[F.col("bucket")].cast("long"))
    dealt = dealt.withColumn("segment", F.pmod(F.xxhash64("at"), F.col("segments")))
    number = F.row_number().over(Window.partitionBy("bucket", "segment").orderBy("at")) - 1
    dealt = dealt.withColumn("number", number)
    batch = F.concat_ws("-", "bucket", "segment", F.floor(F.col("number") / F.col("per_batch")))
    return dealt.select(
        *(F.col("row")[name].alias(name) for name in names),
        F.col("bucket").cast("int").alias("bucket"),
        "bucket_length",
        batch.alias("batch_id"),
        F.pmod("number", "per_batch").cast("int").alias("slot"),
        (F.col("bucket_length") - F.col("length")).alias("padding"),
    )
