"""Terminal chunks: whole lines and silent gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import MAX_OUTPUT_BYTES, OVERSIZE, strip as strip_text
from .ordered import SEG, cut, in_segments, scan

BUCKET = 1 << 16
MAX_LINE = 1 << 20


def assemble_chunks(chunks: DataFrame, bucket: int = BUCKET, max_line: int = MAX_LINE) -> DataFrame:
    """``(run_id, seq, chunk)`` to ``(run_id, pos, part, line)``. Only ``\\n`` ends a line; the rest of a
    chunk goes on in the next one, and a blank rest at the end of the run is dropped.

    ``pos`` numbers a run's lines. A line of more than ``max_line`` characters comes in numbered parts, so a run without line
    ends is put together in many groups; every other line is its part 0.
    """
    df = chunks.select("run_id", "seq", F.split(F.coalesce("chunk", F.lit("")), "\n", -1).alias("pieces"))
    df = in_segments(df, F.floor(F.col("seq") / bucket), ("run_id",))
    along = {"keys": ("run_id",), "order": ("seq",)}
    breaks = F.size("pieces") - 1
    chars = F.aggregate("pieces", F.lit(0).cast("long"), lambda acc, p: acc + F.length(p))
    rest = F.length(F.element_at("pieces", -1))
    df = cut(scan(df, sums={"ended": breaks, "chars": chars}, totals={"all_ended": breaks, "all_chars": chars}, **along))
    # characters before the line that an earlier chunk began
    df = scan(df, last={"began": F.when(breaks > 0, F.col("chars") - rest)}, **along)
    first = F.col("chars") - chars
    rows = df.select(
        "run_id", "seq", "all_ended", "all_chars", F.coalesce("began", F.lit(0)).alias("began"), first.alias("first"),
        (F.col("ended") - breaks).alias("pos"), F.posexplode("pieces").alias("i", "piece"),
    )
    opens = F.col("i") > 0
    offset = F.when(opens, F.lit(0)).otherwise(F.col("first") - F.col("began"))
    length = F.length("piece")
    last = F.col("pos") + F.col("i") == F.col("all_ended")
    # the last line starts with its piece, or where an earlier chunk began it
    size = F.when(opens, length + F.lit(0).cast("long")).otherwise(F.col("all_chars") - F.col("began"))
    rows = rows.select(
        "run_id", "seq", "i", "piece", (F.col("pos") + F.col("i")).alias("pos"), offset.alias("offset"), last.alias("last"), size.alias("size")
    )
    until = F.floor((F.col("offset") + F.greatest(length, F.lit(1)) - 1) / max_line)
    rows = rows.withColumn("part", F.explode(F.sequence(F.floor(F.col("offset") / max_line), until)))
    start = F.greatest(F.col("part") * max_line - F.col("offset"), F.lit(0)).cast("int")
    stop = F.least((F.col("part") + 1) * max_line - F.col("offset"), length.cast("long")).cast("int")
    rows = rows.withColumn("piece", F.substring("piece", start + 1, stop - start)).filter((F.col("piece") != "") | (F.col("offset") == 0))
    parts = F.array_sort(F.collect_list(F.struct("seq", "i", "piece")))
    lines = rows.groupBy("run_id", "pos", "part").agg(
        F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("line"),
        F.any_value("last").alias("last"),
        F.max("size").alias("size"),
    )
    dropped = F.col("last") & (strip_text(F.col("line")) == "") & (F.col("part") == 0) & (F.col("size") <= max_line)
    return lines.filter(~dropped).select("run_id", "pos", "part", "line")


def stall_segments(chunks: DataFrame, gap_seconds: float = 2.0, bucket: int = BUCKET) -> DataFrame:
    """Add ``segment`` to chunks: it rises after every silence of at least the gap.

    Chunks of a run come in ``seq`` order. A run of any length is worked on in buckets of ``seq``.
    """
    df = in_segments(chunks, F.floor(F.col("seq") / bucket), ("run_id",))
    along = {"keys": ("run_id",), "order": ("seq",)}
    df = scan(df, last={"_before": F.col("ts")}, **along)
    silent = F.col("ts") - F.col("_before") >= F.make_dt_interval(secs=F.lit(gap_seconds))
    df = cut(df.withColumn("_stall", F.coalesce(silent, F.lit(False)).cast("int")))
    return scan(df, sums={"segment": F.col("_stall")}, **along).drop("_before", "_stall", SEG)


def segment_report(segments: DataFrame) -> DataFrame:
    """Size and time of every segment."""
    return segments.groupBy("run_id", "segment").agg(
        F.count("*").alias("n_chunks"),
        F.sum(F.octet_length("chunk")).alias("n_bytes"),
        F.min("ts").alias("started"),
        F.max("ts").alias("ended"),
    )


def segment_outputs(segments: DataFrame, max_bytes: int = MAX_OUTPUT_BYTES, bucket: int = BUCKET) -> DataFrame:
    """``(run_id, segment, part, output, reason)``: the text of each segment up to the size limit, with part 0, ready to condense.

    Larger ones pass through unchanged: a row per chunk, with its ``seq`` as part and a ``reason``. A segment of any
    size is matched bucket by bucket before the small ones are put together.
    """
    keys = ["run_id", "segment", SEG]
    rows = segments.withColumn(SEG, F.floor(F.col("seq") / bucket).cast("bigint"))
    report = segment_report(segments).select("run_id", "segment", (F.col("n_bytes") > max_bytes).alias("large"))
    buckets = rows.select(*keys).distinct().join(report, ["run_id", "segment"])
    rows = rows.join(buckets, keys)
    parts = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    texts = rows.filter(~F.coalesce("large", F.lit(False))).groupBy("run_id", "segment").agg(
        F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("output")
    )
    none = F.lit(None).cast("string").alias("reason")
    texts = texts.select("run_id", "segment", F.lit(0).cast("long").alias("part"), "output", none)
    through = rows.filter("large").select(
        "run_id", "segment", F.col("seq").cast("long").alias("part"), F.col("chunk").alias("output"), F.lit(OVERSIZE).alias("reason")
    )
    return texts.unionByName(through)
