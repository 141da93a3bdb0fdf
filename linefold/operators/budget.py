"""Cost guards on condensed texts, each text below the output size limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import LINE_ENDS, SPACES, count_tokens, explode_lines, first_tokens, line_array, line_tokens, strip as strip_text
from .contract import KEEP_ORD, always_strip, kept_lines
from .ordered import ranked_ends
from .rows import collapse_runs

# Ladder of line limits, second-chance limits, marker and its tokens.
LADDER = (60, 40, 30, 20, 15, 10)
LADDER_HEAD, LADDER_TAIL = 0.6, 0.3
RUNGS = [(n, max(3, int(n * LADDER_HEAD)), max(2, int(n * LADDER_TAIL))) for n in LADDER]
SECOND_CHANCE = (20, 12, 6)
BUDGET_CUT = "... [token budget reached]"
BUDGET_CUT_TOKENS = 3


def to_text(result: DataFrame, name: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One text per document. Condensed lines of one text value stay below its size limit."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "line")))
    return result.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "\n").alias(name))


def _rung_marker(total: Column, head: int, tail: int) -> Column:
    return F.concat(F.lit("... ["), (total - (head + tail)).cast("string"), F.lit(" more lines]"))


def budget_ladder(
    lines: DataFrame, sizes: DataFrame, target: int, keep: list[str] | None = None, strip: list[str] | None = None
) -> DataFrame:
    """``(doc_id, text, tokens)``: the generic rule at the rung of the ladder with the fewest tokens, ties to the higher one.
    The way down stops at the first rung within ``target``; only documents whose text beats ``sizes(doc_id, tokens)`` are returned.

    A rung shows some of the rows at both ends that the first rung shows, so these rows, at most head and tail of the first rung, and
    lines to keep are all that a document needs. Sums of tokens over them give the size of every rung; one text is put together.
    """
    emitted = always_strip(collapse_runs(lines, 3), strip)
    _, head, tail = RUNGS[0]
    rows = ranked_ends(emitted, head, tail).select("doc_id", "line", "idx", "total", (2 * F.col("idx")).alias("ord"))
    wanted = kept_lines(lines, keep)
    idx, total, line = F.col("idx"), F.col("total"), F.col("line")
    if wanted is not None:
        once = wanted.groupBy("doc_id", "line").agg((F.min("pos") + F.lit(KEEP_ORD)).alias("ord"))
        rows = rows.unionByName(once, allowMissingColumns=True)
        rows = rows.withColumn("total", F.coalesce(F.max("total").over(Window.partitionBy("doc_id")), F.lit(0)))
    shown = []
    for most, head, tail in RUNGS:
        at_ends = F.coalesce((idx <= head) | (idx > total - tail), F.lit(False))
        if wanted is not None:
            seen = F.max(at_ends).over(Window.partitionBy("doc_id", "line"))
            seen = seen | ((total > most) & (line == _rung_marker(total, head, tail)))
            at_ends = at_ends | (idx.isNull() & ~seen)
        shown.append(at_ends)
    rows = rows.withColumns({"cost": line_tokens(line), "at": F.array(*shown)})
    spent = [F.sum(F.when(F.col("at")[i], F.col("cost")).otherwise(0)) for i in range(len(RUNGS))]
    docs = rows.groupBy("doc_id").agg(
        F.max("total").alias("total"), F.array(*spent).alias("spent"), F.collect_list(F.struct("ord", "line", "at")).alias("rows")
    )
    rungs = []
    for i, (most, head, tail) in enumerate(RUNGS):
        marker = _rung_marker(total, head, tail)
        marked = total > most
        tokens = F.greatest(F.lit(1).cast("bigint"), F.col("spent")[i] + F.when(marked, line_tokens(marker)).otherwise(0))
        place = F.struct(F.lit(2 * head + 1).cast("bigint").alias("ord"), F.when(marked, marker).alias("line"))
        rungs.append(F.struct(tokens.alias("tokens"), F.lit(i).alias("rung"), place.alias("marker")))
    docs = docs.withColumn("rungs", F.array(*rungs))
    within = F.transform(F.filter("rungs", lambda r: r["tokens"] <= target), lambda r: r["rung"])
    docs = docs.withColumn("stop", F.coalesce(F.array_min(within), F.lit(len(RUNGS) - 1)))
    docs = docs.withColumn("best", F.array_min(F.filter("rungs", lambda r: r["rung"] <= F.col("stop"))))
    docs = docs.join(sizes.select("doc_id", F.col("tokens").alias("now")), "doc_id").filter(F.col("best.tokens") < F.col("now"))
    picked = F.filter("rows", lambda x: F.element_at(x["at"], F.col("best.rung") + 1))
    parts = F.concat(F.transform(picked, lambda x: F.struct(x["ord"].alias("ord"), x["line"].alias("line"))), F.array("best.marker"))
    text = F.array_join(F.transform(F.array_sort(parts), lambda x: x["line"]), "\n")  # a missing marker is null and left out
    found = docs.select("doc_id", text.alias("text"), F.col("best.tokens").alias("tokens"))
    return found.filter("text <> ''")


def _running(tokens: Column, order: str = "pos") -> Column:
    return F.sum(tokens).over(
        Window.partitionBy("doc_id").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def fit_lines(texts: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Longest line prefix that leaves room for the marker; documents without one are missing."""
    # no line after the first that goes over the budget is kept
    texts = texts.select("doc_id", first_tokens(F.col(text), max(1, budget + 1), f"[^{LINE_ENDS}]*+").alias(text))
    lines = explode_lines(texts, text)
    lines = lines.withColumn("used", _running(line_tokens(F.col("line"))))
    kept = lines.filter(F.col("used") + BUDGET_CUT_TOKENS <= budget)
    parts = F.array_sort(F.collect_list(F.struct("pos", "line")))
    body = F.array_join(F.transform(parts, lambda r: r["line"]), "\n")
    return kept.groupBy("doc_id").agg(F.concat(body, F.lit("\n" + BUDGET_CUT)).alias("text"))


def fit_words(texts: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Longest word prefix within the budget, at least one word."""
    # no word after the first that goes over the budget is kept
    head = first_tokens(strip_text(F.col(text)), max(1, budget + 1), f"[^{SPACES}]*+")
    words = F.split(head, f"[{SPACES}]+", -1)
    rows = texts.filter(strip_text(F.col(text)) != "").select("doc_id", F.posexplode(words).alias("pos", "word"))
    rows = rows.withColumn("used", F.greatest(F.lit(1).cast("bigint"), _running(line_tokens(F.col("word")))))
    kept = rows.filter((F.col("pos") == 0) | (F.col("used") <= budget))
    parts = F.array_sort(F.collect_list(F.struct("pos", "word")))
    return kept.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda r: r["word"]), " ").alias("text"))


def fit_to_budget(texts: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """Texts over the budget, cut by lines, else by words."""
    over = texts.filter(count_tokens(F.col(text)) > budget)
    by_lines = fit_lines(over, budget, text)
    # one line alone may be over the budget: only then are words taken apart
    first = F.coalesce(line_tokens(F.get(line_array(F.col(text)), F.lit(0))), F.lit(0)) + BUDGET_CUT_TOKENS > budget
    by_words = fit_words(over.filter(first), budget, text).withColumnRenamed("text", "words")
    both = over.select("doc_id", F.col(text).alias("full"))
    both = both.join(by_lines, "doc_id", "left").join(by_words, "doc_id", "left")
    return both.select("doc_id", F.coalesce("text", "words", "full").alias("text"))


def regression_guard(raw: Column, condensed: Column, raw_tokens: Column, condensed_tokens: Column) -> Column:
    """The condensed text, unless it grew in characters or tokens."""
    grew = (F.length(condensed) > F.length(raw)) | (condensed_tokens > raw_tokens)
    return F.when(condensed.isNull() | (condensed == "") | grew, raw).otherwise(condensed)


def saved_tokens(raw_tokens: Column, condensed_tokens: Column) -> Column:
    return F.greatest(F.lit(0).cast("bigint"), raw_tokens - condensed_tokens)


def savings(results: DataFrame) -> DataFrame:
    """Tokens before and after per command and strategy."""
    return (
        results.groupBy("command", "strategy")
        .agg(
            F.count("*").alias("n_outputs"),
            F.sum("raw_tokens").alias("raw_tokens"),
            F.sum("compressed_tokens").alias("compressed_tokens"),
            F.sum(saved_tokens(F.col("raw_tokens"), F.col("compressed_tokens"))).alias("saved"),
        )
        .withColumn("ratio", 1 - F.col("compressed_tokens") / F.col("raw_tokens"))
    )
