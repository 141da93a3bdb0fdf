"""Condensing by shape: progress, test run, diff, table, key-value, error trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, is_blank, is_upper, strip as strip_text
from .contract import apply_contract, param
from .ordered import attach, carried, cut, emit, group_keys, is_segmented, ranked_ends, runs, scan

SECTION = 1 << 58

# The patterns and marker texts of the condensing rules.
PROGRESS_ERROR = r"(?iu)error|fail|exception"
PERCENT_ONLY = rf"(?Ud)^[{SPACES}]*\d+%[{SPACES}]*\z"
SPEED = rf"(?iuU)eta|speed|\d+[{SPACES}]*[kmg]b/s"
PERCENT_LINE_CHARS = 15
TEST_PASS = r"(?U)\b(PASSED|ok|✓)\b"
TEST_FAIL = r"(?U)\b(FAILED|FAIL|ERROR|✗)\b"
TEST_SUMMARY = rf"(?iuUd)^={{3,}}|^-{{3,}}[{SPACES}]*\z|\btotal:|\bpassed:|\bfailed:"
SUMMARY_LINES = 5
TABLE_RULE = rf"^[-{SPACES}|+]+\z"
CELL_GAP = rf"[{SPACES}]{{2,}}|\t"
KEY_COLON = rf"(?Ud)^([{SPACES}]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{SPACES}]*):[{SPACES}]+([^{SPACES}].*)\z"
KEY_EQUALS = rf"(?Ud)^([{SPACES}]*[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_{SPACES}]*)=[{SPACES}]*([^{SPACES}].*)\z"
TIME_KEY = r"(?iu)time|date|at"
LIBRARY_FRAME = (
    r"(?iu)site-packages|dist-packages|/usr/lib/python|/usr/local/lib/python|/python\d+\.\d+/|"
    r"/\.pyenv/|/anaconda\d*/|/miniconda\d*/|/conda/|/\.venv/|/venv/|/\.tox/|<frozen\s"
)
TRACE_CUT = "... [traceback truncated]"
DIFF_SUMMARY = "[Diff too large, summarized by file]"
ROWS_CUT = "... [additional rows omitted]"
PAIRS_CUT = "... [additional pairs omitted]"
TIMES_CUT = "... [timestamp pairs omitted]"
FRAMES_CUT = "... [additional frames omitted]"


def _has(line: Column | str, text: str) -> Column:
    return F.contains(line, F.lit(text))


def _starts(text: str) -> Column:
    return F.startswith("line", F.lit(text))


def is_progress_error(line: Column) -> Column:
    return line.rlike(PROGRESS_ERROR)


def is_progress_noise(line: Column, length: Column, strip_percentage: Column) -> Column:
    """Percent-only, short percent and speed/ETA lines."""
    percent = line.rlike(PERCENT_ONLY) | (_has(line, "%") & (length < PERCENT_LINE_CHARS))
    return (strip_percentage & percent) | line.rlike(SPEED)


def progress(
    lines: DataFrame,
    keep_mode: str = "final_line",
    strip_percentage: bool = True,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Error lines, then the last non-blank line, each text once; other keep modes put all
    remaining lines first. Only aggregations: no document is ordered in one place."""
    line = F.col("line")
    mode = param(lines, "keep", keep_mode)
    rows = lines.filter(~is_blank(line))
    error = is_progress_error(line)
    noise = is_progress_noise(line, F.length(line), param(lines, "strip_percentage", strip_percentage))
    plain = ~error & ~noise & ~mode.isin("final_line", "errors_and_final")
    extra = [F.any_value(c).alias(c) for c in carried(lines)]
    body = rows.filter(error | plain).select(
        "doc_id", *carried(lines), "line", F.when(error, F.col("pos") + SECTION).otherwise(F.col("pos")).alias("ord")
    )
    final = rows.groupBy("doc_id").agg(
        F.max_by("line", "pos").alias("line"), (F.max("pos") + F.lit(2 * SECTION)).alias("ord"), *extra
    )
    result = (
        body.unionByName(final.select(*body.columns)).groupBy("doc_id", "line").agg(F.min("ord").alias("ord"), *extra)
    )
    return apply_contract(result.select("doc_id", *carried(lines), "ord", "line"), lines, keep, strip)


def test_summary(lines: DataFrame) -> DataFrame:
    """Summary rows: matches among the last five non-blank lines, else the last one."""
    line, lower = F.col("line"), F.lower("line")
    tail = ranked_ends(lines.filter(~is_blank(line)), 0, SUMMARY_LINES)
    tail = tail.filter(F.col("idx") > F.col("total") - SUMMARY_LINES)
    hit = line.rlike(TEST_SUMMARY) | ((_has(lower, "failed") | _has(lower, "passed")) & _has(line, "===="))
    row = F.struct("pos", "line", hit.alias("hit"), (F.col("idx") == F.col("total")).alias("is_last"))
    found = tail.groupBy("doc_id").agg(
        F.collect_list(row).alias("tail"), *[F.any_value(c).alias(c) for c in carried(lines)]
    )
    any_hit = F.exists("tail", lambda r: r["hit"])
    return found.select(
        "doc_id",
        *carried(lines),
        F.filter("tail", lambda r: r["hit"] | (~any_hit & r["is_last"])).alias("summary"),
    )


def _first_of_text(rows: DataFrame, repeated: Column) -> DataFrame:
    """Rows whose ``repeated`` test holds stay once per text."""
    if not is_segmented(rows):
        first = F.min("pos").over(Window.partitionBy("doc_id", "line"))
        return rows.withColumn("_first", first).filter(~repeated | (F.col("pos") == F.col("_first"))).drop("_first")
    once = rows.filter(repeated).groupBy("doc_id", "line").agg(F.min("pos").alias("pos"))
    return rows.filter(~repeated).select("doc_id", "pos", "line").unionByName(once.select("doc_id", "pos", "line"))


def test_run(
    lines: DataFrame,
    max_traceback_lines: int = 8,
    keep_mode: str = "failed_only",
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Failures with the lines that follow them, then the summary lines."""
    line = F.col("line")
    extra = carried(lines)
    limit = param(lines, "max_traceback_lines", max_traceback_lines)
    summary = test_summary(lines)
    rows = attach(lines.filter(~is_blank(line)), summary.select("doc_id", F.col("summary.line").alias("last_lines")))
    rows = rows.filter(~F.array_contains("last_lines", line)).drop("last_lines")
    rows = rows.withColumn(
        "kind", F.when(line.rlike(TEST_FAIL), F.lit("f")).when(line.rlike(TEST_PASS), F.lit("p")).otherwise(F.lit("o"))
    )
    opener = F.when(F.col("kind") != "o", F.struct("kind", "pos"))
    rows = scan(rows, last={"opener": opener})
    is_open = (F.col("kind") == "o") & (F.col("opener.kind") == "f")
    passed = (F.col("kind") == "p") & (param(lines, "keep", keep_mode) == "all")
    rows = rows.filter((F.col("kind") == "f") | is_open | passed)
    # a block is a failure and what follows it; its first row is the failure itself
    rows = rows.withColumn("block", F.when(is_open, F.col("opener.pos")).otherwise(F.col("pos")))
    rows = ranked_ends(rows, limit + 2, 0, keys=("doc_id", "block")).filter(F.col("idx") <= limit + 2)
    rows = rows.withColumn("line", F.when(F.col("idx") > limit + 1, F.lit(TRACE_CUT)).otherwise(line))
    asserts = _has("line", "AssertionError:") | _has("line", "expect(")
    body = _first_of_text(rows.select("doc_id", *extra, "pos", "line", *group_keys(rows, ())), asserts)
    closing = summary.select("doc_id", *extra, F.inline("summary")).select(
        "doc_id", *extra, (F.col("pos") + SECTION).alias("ord"), "line"
    )
    result = body.select("doc_id", *extra, F.col("pos").alias("ord"), "line").unionByName(closing)
    return apply_contract(result, lines, keep, strip)


def diff_context(lines: DataFrame, context_lines: int = 2) -> DataFrame:
    """File and hunk headers, changed lines and the lines near them; ``index`` lines go."""
    near = param(lines, "context_lines", context_lines)
    header = _starts("+++") | _starts("---") | _starts("@@")
    changed = ~header & (_starts("+") | _starts("-"))
    at = F.when(changed, F.col("pos"))
    rows = scan(lines, last={"before": at}, nxt={"after": at})
    close = (F.col("pos") - F.col("before") <= near) | (F.col("after") - F.col("pos") <= near)
    kept = header | changed | F.coalesce(close, F.lit(False))
    return rows.filter(kept & ~_starts("index ")).drop("before", "after")


def diff_stat(lines: DataFrame) -> DataFrame:
    """Added and deleted lines per file: a repeated file keeps its first place and last counts."""
    new_file = _starts("+++ b/")
    counted = lines.filter(_starts("+") | _starts("-"))
    numbered = scan(counted, sums={"file_no": new_file.cast("int")}).filter(F.col("file_no") > 0)
    added = (_starts("+") & ~_starts("+++")).cast("int")
    deleted = (_starts("-") & ~_starts("---")).cast("int")
    files = numbered.groupBy("doc_id", "file_no").agg(
        F.max(F.when(new_file, F.substring("line", 7, 2147483647))).alias("file"),
        F.min("pos").alias("pos"),
        F.sum(added).alias("added"),
        F.sum(deleted).alias("deleted"),
        *[F.any_value(c).alias(c) for c in carried(lines)],
    )
    latest = F.max_by(F.struct("added", "deleted"), "file_no").alias("counts")
    return (
        files.filter(F.col("file") != "")
        .groupBy("doc_id", "file")
        .agg(F.min("pos").alias("pos"), latest, *[F.any_value(c).alias(c) for c in carried(lines)])
        .select("doc_id", *carried(lines), "file", "pos", "counts.added", "counts.deleted")
    )


def diff(
    lines: DataFrame,
    max_lines: int = 80,
    context_lines: int = 2,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Changes in context, or one line per file when there are too many of them."""
    extra = carried(lines)
    context = cut(diff_context(lines, context_lines))
    kept = context.groupBy("doc_id").agg(F.count("*").alias("kept"))
    files = diff_stat(lines)
    named = files.groupBy("doc_id").agg(F.count("*").alias("files"))
    # a document either keeps its lines or its file counts
    sizes = kept.join(named, "doc_id", "left")
    limit = param(lines, "max_lines", max_lines)
    too_long = (F.col("kept") > limit) & (F.coalesce("files", F.lit(0)) > 0)
    shown = attach(context, sizes).filter(~too_long).select("doc_id", *extra, F.col("pos").alias("ord"), "line")
    counted = files.join(kept, "doc_id").filter(F.col("kept") > param(files, "max_lines", max_lines))
    stat = F.concat("file", F.lit(": +"), F.col("added").cast("string"), F.lit(" -"), F.col("deleted").cast("string"))
    titles = counted.groupBy("doc_id").agg(
        F.lit(-1).cast("bigint").alias("ord"),
        F.lit(DIFF_SUMMARY).alias("line"),
        *[F.any_value(c).alias(c) for c in extra],
    )
    result = shown.unionByName(counted.select("doc_id", *extra, F.col("pos").alias("ord"), stat.alias("line")))
    return apply_contract(result.unionByName(titles.select(*result.columns)), lines, keep, strip)


def table_header(lines: DataFrame) -> DataFrame:
    """Position of the header: first all-upper line or line before a separator, else 0."""
    rows = scan(lines, nxt={"below": F.col("line")})
    heads = is_upper(F.col("line")) | F.coalesce(F.col("below").rlike(TABLE_RULE), F.lit(False))
    return rows.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(heads, F.col("pos"))), F.lit(0).cast("bigint")).alias("header")
    )


def trim_cells(line: Column, max_columns: Column, max_cell: Column) -> Column:
    """First columns of a row with their separators; long cells are cut."""
    cells = F.split(line, CELL_GAP, -1)
    gaps = F.regexp_extract_all(line, F.lit(CELL_GAP), F.lit(0))
    short = F.transform(
        F.slice(cells, F.lit(1), max_columns),
        lambda cell, i: F.concat(
            F.when(F.length(cell) > max_cell, F.concat(F.substring(cell, F.lit(1), max_cell - 3), F.lit("..."))).otherwise(cell),
            F.coalesce(F.get(gaps, i), F.lit("")),
        ),
    )
    return F.array_join(short, "")


def table(
    lines: DataFrame,
    max_rows: int = 20,
    max_columns: int = 5,
    max_cell_length: int = 40,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Everything up to the header, separators, and the first rows with trimmed cells."""
    line, extra = F.col("line"), carried(lines)
    limit = param(lines, "max_rows", max_rows)
    rows = attach(lines, table_header(lines))
    as_is = (F.col("pos") <= F.col("header")) | line.rlike(TABLE_RULE)
    framed = rows.filter(as_is).select("doc_id", *extra, F.col("pos").alias("ord"), "line")
    body = ranked_ends(rows.filter(~as_is & ~is_blank(line)), limit + 1, 0).filter(F.col("idx") <= limit + 1)
    cut_cells = trim_cells(
        line, param(lines, "max_columns", max_columns), param(lines, "max_cell_length", max_cell_length)
    )
    body = body.select(
        "doc_id",
        *extra,
        F.col("pos").alias("ord"),
        F.when(F.col("idx") > limit, F.lit(ROWS_CUT)).otherwise(cut_cells).alias("line"),
    )
    return apply_contract(framed.unionByName(body), lines, keep, strip)


def keyvalue(
    lines: DataFrame,
    max_lines: int = 20,
    always_strip_keys: list[str] | None = None,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Pairs without stripped keys; long documents lose time-like keys, then all beyond the limit."""
    from .contract import matches_any

    line, extra = F.col("line"), carried(lines)
    limit = param(lines, "max_lines", max_lines)
    colon, equals = line.rlike(KEY_COLON), line.rlike(KEY_EQUALS)
    key = F.when(colon, F.regexp_extract(line, KEY_COLON, 1)).when(equals, F.regexp_extract(line, KEY_EQUALS, 1))
    rows = lines.withColumn("key", strip_text(key))
    in_rule = "p" in lines.columns and "always_strip_keys" in lines.schema["p"].dataType.names
    if always_strip_keys or in_rule:
        column = F.col("p.always_strip_keys") if in_rule else None
        gone = matches_any(F.col("key"), always_strip_keys or [], column)
        rows = rows.filter(~F.coalesce(gone, F.lit(False)))
    important = F.col("key").isNull() | ~F.col("key").rlike(TIME_KEY)
    # whole documents need one window only: rank all rows and the important ones together
    rows = rows.withColumn("important", important)
    counts = rows.groupBy("doc_id").agg(
        F.count("*").alias("pairs"),
        F.sum(F.col("important").cast("int")).alias("kept"),
        *[F.any_value(c).alias(c) for c in extra],
    )
    short = ranked_ends(rows, limit, 0).filter((F.col("total") <= limit) & (F.col("idx") <= limit))
    long = ranked_ends(rows.filter("important"), limit, 0).filter(F.col("idx") <= limit)
    long = long.join(counts.select("doc_id", "pairs"), "doc_id").filter(F.col("pairs") > limit)
    marker = F.when(F.col("kept") > limit, F.lit(PAIRS_CUT)).otherwise(F.lit(TIMES_CUT))
    marks = counts.filter(F.col("pairs") > limit).select(
        "doc_id", *extra, F.lit(SECTION).alias("ord"), marker.alias("line")
    )
    at = ["doc_id", *extra, F.col("pos").alias("ord"), "line"]
    result = short.select(*at).unionByName(long.select(*at)).unionByName(marks)
    return apply_contract(result, lines, keep, strip)


def error_trace(
    lines: DataFrame,
    max_traceback_lines: int = 10,
    strip_stdlib_frames: bool = True,
    keep: list[str] | None = None,
    strip: list[str] | None = None,
) -> DataFrame:
    """Trace headers, the first distinct frames with their code, messages; one marker for the rest.

    State is read off earlier rows: a row is in a trace when the latest header or message
    line before it is a header; a frame counts when it differs from the candidate before it.
    """
    line = F.col("line")
    limit = param(lines, "max_traceback_lines", max_traceback_lines)
    frame = _has("line", 'File "') | _has("line", "at line") | F.startswith(strip_text(line), F.lit("at "))
    rows = lines.filter(~is_blank(line)).withColumn(
        "kind",
        F.when(_has("line", "Traceback") | _has("line", "Exception"), F.lit("header"))
        .when(frame, F.lit("frame"))
        .when(_starts("    ") | _starts("\t"), F.lit("code"))
        .otherwise(F.lit("message")),
    )
    rows = scan(rows, last={"state": F.when(F.col("kind").isin("header", "message"), F.col("kind"))})
    inside = F.coalesce(F.col("state") == "header", F.lit(False)) & (F.col("kind") != "header")
    rows = rows.withColumn("inside", inside).drop("state")
    library = param(lines, "strip_stdlib_frames", strip_stdlib_frames) & line.rlike(LIBRARY_FRAME)
    rows = rows.withColumn("candidate", F.col("inside") & (F.col("kind") == "frame") & ~library)
    rows = cut(scan(rows, last={"frame_before": F.when(F.col("candidate"), line)}))
    new = F.col("candidate") & F.coalesce(F.col("frame_before") != line, F.lit(True))
    rows = rows.withColumn("new", new.cast("int"))
    rows = scan(
        rows, sums={"seen": F.col("new")}, last={"new_before": F.when(F.col("candidate"), F.col("new"))}
    )
    earlier = F.col("seen") - F.col("new")
    shown_frame = (F.col("new") == 1) & (F.col("seen") <= limit)
    marker = F.col("candidate") & (earlier == limit) & (F.coalesce("new_before", F.lit(1)) == 1)
    plain = ~F.col("inside") | (F.col("kind") == "message")
    lead = plain | shown_frame | marker
    rows = rows.withColumn("lead", lead).withColumn("line", F.when(marker, F.lit(FRAMES_CUT)).otherwise(line))
    rows = rows.filter(F.col("lead") | (F.col("inside") & (F.col("kind") == "code")))
    rows = rows.drop("frame_before", "new", "seen", "new_before", "candidate")
    omitted = _has("line", "omitted")
    rows = scan(rows, last={"after_cut": F.when(F.col("lead") | omitted, omitted)})
    rows = cut(rows.filter(F.col("lead") | ~F.coalesce("after_cut", F.lit(False))))
    rows = scan(rows, last={"line_before": F.col("line")})
    repeat = F.coalesce(F.col("line_before") == F.col("line"), F.lit(False)) & _has("line", "Caused by")
    result = rows.filter(~repeat).select("doc_id", *carried(lines), F.col("pos").alias("ord"), "line")
    return apply_contract(result, lines, keep, strip)
