"""Text columns: lines, blanks, ANSI, commands, token counts.

The rules are those of Python text (``str.splitlines``, ``str.strip``, Unicode ``\\s``),
written as Spark expressions, so nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Line terminators, whitespace and token delimiters of the text rules.
# (the class comes first and lists its characters, which Java looks up in one step)
LINE_BREAK = r"[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029](?:(?<=\r)\n)?"
LINE_ENDS = "\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029"
SPACES = r" \t-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
ODD_SPACES = SPACE_CHARS.translate({ord(c): None for c in " \t" + LINE_ENDS})
DELIMITERS = SPACE_CHARS + "/\\_.-:=@()[]{},;!?#&|<>\"'`~^*+"
ANSI_SEQUENCE = r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])"
ESCAPE = "\x1b"

MAX_OUTPUT_BYTES = 10_485_760
OVERSIZE = "output exceeds the size limit"


def line_array(text: Column) -> Column:
    """Lines of a text; one trailing terminator closes the last line, '' has no line."""
    ending = (
        F.when(F.endswith(text, F.lit("\r\n")), F.lit(2))
        .when(F.right(text, F.lit(1)).isin(list(LINE_ENDS)), F.lit(1))
        .otherwise(F.lit(0))
    )
    body = F.when(ending > 0, F.left(text, F.length(text) - ending)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, LINE_BREAK, -1))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def plain_spaces(text: Column) -> Column:
    """Unusual spaces inside a line as blanks, so that patterns need only blank and tab."""
    return F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))


def is_upper(text: Column) -> Column:
    """At least one cased character and no lower-case one."""
    return (F.upper(text) == text) & (F.lower(text) != text)


def has_ansi(text: Column) -> Column:
    return F.contains(text, F.lit(ESCAPE))


def strip_ansi(text: Column) -> Column:
    """Drop escape sequences; the regex only runs on rows that hold an ESC."""
    return F.when(has_ansi(text), F.regexp_replace(text, ANSI_SEQUENCE, "")).otherwise(text)


def normalize_command(command: Column) -> Column:
    return F.regexp_replace(strip(command), f"[{SPACES}]+", " ")


def base_command_key(command: Column) -> Column:
    """First two words of a normalised command."""
    return F.substring_index(command, " ", 2)


def blanked(text: Column) -> Column:
    return F.translate(text, DELIMITERS, " " * len(DELIMITERS))


def first_tokens(text: Column, n: int, rest: str) -> Column:
    """The text up to its ``n``-th token and what ``rest``, a pattern, matches from there; a text with fewer tokens is whole."""
    head = F.length(F.regexp_extract(blanked(text), f"^(?: *+[^ ]++){{{n}}}+", 0))
    part = F.concat(F.left(text, head), F.regexp_extract(F.substring(text, head + 1, F.length(text)), f"^{rest}", 0))
    return F.when(head > 0, part).otherwise(text)


def line_tokens(text: Column) -> Column:
    """Token runs in a piece of text. Line breaks delimit, so counts add over lines.

    Delimiters become blanks first: the count then needs a two-way class only, which is
    several times faster than a class of all Unicode delimiters.
    """
    return F.regexp_count(blanked(text), F.lit("[^ ]+")).cast("bigint")


def count_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), line_tokens(text))


def oversize(text: Column, max_bytes: int = MAX_OUTPUT_BYTES) -> Column:
    return F.octet_length(text) > max_bytes


def explode_lines(outputs: DataFrame, text: str = "output", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``lines(doc_id, pos, line)``: pos counts from 0 without gaps inside a document."""
    return outputs.select(
        *keep, F.posexplode(line_array(F.col(text))).alias("pos", "line")
    ).withColumn("pos", F.col("pos").cast("bigint"))
