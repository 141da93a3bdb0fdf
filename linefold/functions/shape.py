"""Shape scores of an output, from its first 200 lines.

The sample is bounded, so the scores are plain row expressions: no explode, no shuffle.
Scores are doubles added in a fixed order, since ties hang on the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import is_blank, is_upper, line_array, plain_spaces

# Sample size, shape order (first wins a tie), patterns, least winning score.
SAMPLE_LINES = 200
SHAPES = ("list", "progress", "test", "diff", "table", "keyvalue", "error")
PERCENT = r"\p{Nd}+%"
FRACTION = r"\p{Nd}+/\p{Nd}+"
PROGRESS_WORDS = r"(?iu)downloading|fetching|step|layer"
TEST_WORDS = r"PASSED|FAILED|ERROR|ok|FAIL"
CHANGED_LINE = r"(?md)^[+-](?![+-])"
# possessive: what follows is in none of the classes, so that giving characters back never helps
KEY_COLON = r"(?md)^[\p{L}\p{N}_][\p{L}\p{N}_ \t\n]++:[ \t\n]++[^ \t\n]"
KEY_EQUALS = r"(?md)^[\p{L}\p{N}_][\p{L}\p{N}_ \t\n]++=[ \t\n]*+[^ \t\n]"
TABLE_RULE = r"^[- \t|+]+\z"
COLUMN_GAP = r"[ \t]{2,}|\t|\|"
MIN_SCORE = 0.5


def _points(*rules: tuple[Column, float]) -> Column:
    """0.0 plus the points of each rule that holds, added in the given order."""
    score = F.lit(0.0)
    for holds, points in rules:
        score = score + F.when(holds, F.lit(points)).otherwise(F.lit(0.0))
    return score


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _keys(text: Column, pattern: str, sign: str) -> Column:
    """Hits of a key's pattern; a key goes over lines, so each line would be tried to the end of a text without the sign."""
    return F.when(~F.contains(text, F.lit(sign)), F.lit(0)).otherwise(_hits(text, pattern))


def _near(lines: Column, length: Column) -> Column:
    """Number of lines within 20 characters of a length."""
    # the outer lambda binds the length: inside the inner one it would be computed for every line
    return F.get(F.transform(F.array(length), lambda a: F.size(F.filter(lines, lambda ln: F.abs(F.length(ln) - a) <= 20))), F.lit(0))


def _is_frame(line: Column) -> Column:
    return F.contains(line, F.lit('File "')) | F.contains(line, F.lit("at line"))


def sample_frame(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Add the sample and the counts that the scores are made of."""
    lines = F.slice(line_array(F.col(text)), 1, SAMPLE_LINES)
    df = outputs.withColumn("s_lines", lines)
    df = df.withColumn("s_text", F.array_join("s_lines", "\n")).withColumn("s_n", F.size("s_lines"))
    total_chars = F.aggregate("s_lines", F.lit(0), lambda acc, ln: acc + F.length(ln))
    df = df.withColumn("s_avg", total_chars / F.nullif(F.col("s_n"), F.lit(0)))
    s, spaced = F.col("s_text"), plain_spaces(F.col("s_text"))
    columns = F.transform(
        F.filter(F.slice("s_lines", 1, 10), lambda ln: ~is_blank(ln)), lambda ln: _hits(plain_spaces(ln), COLUMN_GAP) + 1
    )
    pairs = F.greatest(F.lit(0), F.col("s_n") - 1)
    followed = F.exists(
        F.arrays_zip(
            F.slice("s_lines", F.lit(1), pairs).alias("a"),
            F.slice("s_lines", F.lit(2), pairs).alias("b"),
        ),
        lambda pair: _is_frame(pair["a"]) & F.startswith(pair["b"], F.lit("    ")),
    )
    return df.withColumn(
        "s",
        F.struct(
            _near(F.col("s_lines"), F.col("s_avg")).alias("similar"),
            _hits(s, ":").alias("colons"),
            _hits(s, CHANGED_LINE).alias("changed"),
            (_hits(s, PERCENT) + _hits(s, FRACTION)).alias("fractions"),
            _hits(s, PROGRESS_WORDS).alias("progress_words"),
            _hits(s, TEST_WORDS).alias("test_words"),
            _hits(F.lower(s), "test").alias("test_names"),
            _hits(s, "@@").alias("hunks"),
            (_hits(s, "---") + _hits(s, r"\+\+\+")).alias("file_marks"),
            _keys(spaced, KEY_COLON, ":").alias("kv_colon"),
            _keys(spaced, KEY_EQUALS, "=").alias("kv_equals"),
            (_hits(s, 'File "') + _hits(s, "at line")).alias("frames"),
            (F.contains(s, F.lit("Traceback")) | F.contains(s, F.lit("Exception"))).alias("trace_word"),
            F.exists(
                F.slice("s_lines", F.greatest(F.lit(1), F.col("s_n") - 4), F.lit(5)),
                lambda ln: F.contains(ln, F.lit("====")),
            ).alias("summary_rule"),
            F.coalesce(plain_spaces(F.get("s_lines", F.lit(1))).rlike(TABLE_RULE), F.lit(False)).alias("second_is_rule"),
            F.coalesce(is_upper(F.get("s_lines", F.lit(0))), F.lit(False)).alias("first_is_upper"),
            columns.alias("columns"),
            followed.alias("frame_then_code"),
        ),
    )


def shape_scores(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Add ``scores``: a struct of seven doubles, each capped at 1.0 (null for no line)."""
    n, s = F.col("s_n"), F.col("s")
    df = sample_frame(outputs, text)
    columns = s["columns"]
    k = F.size(columns)
    aligned = (
        (n >= 3)
        & (k >= 3)
        & (F.get(columns, k - 1) > 1)
        & (F.get(columns, k - 1) == F.get(columns, k - 2))
        & (F.get(columns, k - 2) == F.get(columns, k - 3))
    )
    progress = _points(
        (s["fractions"] > 0, 0.4),
        (s["progress_words"] > 0, 0.3),
        ((n > 10) & (s["fractions"] > n * F.lit(0.5)), 0.3),
        ((n <= 10) & (s["fractions"] > 0) & (s["progress_words"] > 0), 0.1),
    )
    test = _points(
        (s["test_words"] > 0, 0.5),
        (s["test_names"] / n > F.lit(0.2), 0.3),
        (s["summary_rule"], 0.2),
    )
    raw = {
        "list": _points(
            (n > 20, 0.3),
            ((n >= 5) & (s["similar"] / n > F.lit(0.8)), 0.3),
            ((n >= 5) & (s["colons"] / n < F.lit(0.2)), 0.2),
            ((n >= 5) & (s["changed"] == 0), 0.2),
            ((n < 5) & (s["colons"] == 0) & (s["changed"] == 0), 0.2),
        ),
        "progress": progress,
        "test": test,
        "diff": _points(
            (s["changed"] / n > F.lit(0.1), 0.6), (s["hunks"] > 0, 0.3), (s["file_marks"] > 0, 0.1)
        ),
        "table": _points(
            ((n >= 2) & s["second_is_rule"], 0.5), (F.coalesce(aligned, F.lit(False)), 0.3), (s["first_is_upper"], 0.2)
        ),
        "keyvalue": _points(
            (s["kv_colon"] / n > F.lit(0.6), 0.5),
            (s["kv_equals"] / n > F.lit(0.6), 0.3),
            ((progress < F.lit(0.2)) & (test < F.lit(0.2)), 0.2),
        ),
        "error": _points(
            (s["trace_word"], 0.5), (s["frames"] > 0, 0.3), ((s["frames"] > 0) & s["frame_then_code"], 0.2)
        ),
    }
    scores = F.struct(*[F.least(F.lit(1.0), raw[name]).alias(name) for name in SHAPES])
    return df.withColumn("scores", F.when(n > 0, scores)).drop("s_lines", "s_text", "s_n", "s_avg", "s")


def detect(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Add ``shape`` and ``confidence``: the first best score, or generic below 0.5."""
    df = shape_scores(outputs, text)
    best = F.greatest(*[F.col(f"scores.{name}") for name in SHAPES])
    shape = F.lit(None).cast("string")
    for name in reversed(SHAPES):
        shape = F.when(F.col(f"scores.{name}") == best, F.lit(name)).otherwise(shape)
    won = F.coalesce(best >= F.lit(MIN_SCORE), F.lit(False))
    return (
        df.withColumn("shape", F.when(won, shape).otherwise(F.lit("generic")))
        .withColumn("confidence", F.when(won, F.round(best, 2)).otherwise(F.lit(0.0)))
        .drop("scores")
    )


def shape_profile(outputs: DataFrame, text: str = "output") -> DataFrame:
    """Outputs and mean confidence per command and shape."""
    return (
        detect(outputs.select("command", text), text)
        .groupBy("command", "shape")
        .agg(F.count("*").alias("n_outputs"), F.avg("confidence").alias("avg_confidence"))
    )
