import re

from pyspark.sql import functions as F

from linefold.functions import text

SAMPLES = [
    "",
    "\n",
    "one",
    "one\n",
    "one\n\n",
    "a\r\nb\rc\n",
    "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g\u2028h\u2029i",
    "  padded \t\u3000",
    "\x1f\xa0x\u2009 ",
    "/var/www/html foo_bar x=1; y:2 (z) 50% $5",
    "----",
    "\u00e9\u00a0\u00fc\u2003\u00df \u4e2d\u6587",
    "k: v\r\n",
]


def test_lines_blanks_and_tokens_follow_python(spark):
    df = spark.createDataFrame(list(enumerate(SAMPLES)), "i long, s string")
    s = F.col("s")
    rows = df.select(
        "i", text.line_array(s).alias("lines"), text.strip(s).alias("strip"), text.count_tokens(s).alias("tokens")
    ).collect()
    runs = re.compile(r"""[\s/\\_.\-:=@()\[\]{},;!?#&|<>"'`~^*+]+""")
    for row in rows:
        sample = SAMPLES[row.i]
        assert row.lines == sample.splitlines(), repr(sample)
        assert row.strip == sample.strip(), repr(sample)
        assert row.tokens == max(1, len([t for t in runs.split(sample) if t])), repr(sample)


def test_tokens_add_over_lines(spark):
    df = spark.createDataFrame([(1, "a b\nc/d\n\n--\nlast_one")], "doc_id long, output string")
    lines = text.explode_lines(df)
    total = lines.agg(F.sum(text.line_tokens(F.col("line")))).first()[0]
    assert total == df.select(text.count_tokens(F.col("output"))).first()[0] == 6


def test_ansi_and_commands(spark):
    df = spark.createDataFrame([("\x1b[31mred\x1b[0m \x1b]0;title\x07", "  git \t log   -5 ")], "s string, c string")
    command = text.normalize_command(F.col("c"))
    row = df.select(
        text.strip_ansi(F.col("s")), command, text.base_command_key(command), text.base_command_key(F.lit("ls"))
    ).first()
    assert list(row) == ["red 0;title\x07", "git log -5", "git log", "ls"]


def test_upper(spark):
    df = spark.createDataFrame([("NAME  ID",), ("123",), ("Name",), ("",)], "s string")
    assert [r[0] for r in df.select(text.is_upper(F.col("s"))).collect()] == [True, False, False, False]


def test_first_tokens_end_with_a_whole_word_or_line(spark):
    texts = ["a b-c d\ne f", "--x, (y z) w", "one", "", " \n a\n\nb", "中文 k:v w"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for n in (1, 2, 3, 9):
        words = df.select(text.first_tokens(F.col("s"), n, f"[^{text.SPACES}]*+")).collect()
        lines = df.select(text.first_tokens(F.col("s"), n, f"[^{text.LINE_ENDS}]*+")).collect()
        for whole, (by_word,), (by_line,) in zip(texts, words, lines, strict=True):
            tokens = list(re.finditer("[^" + re.escape(text.DELIMITERS) + "]+", whole))
            at = tokens[n - 1].end() if len(tokens) >= n else len(whole)
            rest = whole[at:]
            assert by_word == whole[:at] + re.match(f"[^{text.SPACES}]*", rest)[0] or at == len(whole) and by_word == whole
            assert by_line == whole[:at] + re.match(f"[^{text.LINE_ENDS}]*", rest)[0] or at == len(whole) and by_line == whole
