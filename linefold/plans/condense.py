"""The whole rule: gate, resolve, condense, guard.

Outputs above the size limit pass through before any explode, so every text that is split
into lines is bounded and a window over ``doc_id`` is too. The text is scanned once to gate and
route it; the routed outputs are written per strategy, and each condenser reads its own part.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.safety import gate
from ..functions.patterns import bad_patterns, java_patterns
from ..functions.text import MAX_OUTPUT_BYTES, OVERSIZE, count_tokens, explode_lines, normalize_command, oversize, strip_ansi
from ..operators import budget, rows, shapes
from ..operators.ordered import number_all
from ..session import staged, staged_parts
from ..sources.events import already_transformed, fast_exit, normalize_tool_events, tool_envelopes
from ..sources.rules import match_prefix, merge_contract, merge_params, resolve_strategy, seeds


CONTRACT = ("always_keep", "always_strip")


@dataclass
class Settings:
    min_lines: int = 15
    strip_ansi: bool = True
    pass_errors: bool = False
    max_output_bytes: int = MAX_OUTPUT_BYTES
    target_max_tokens: int = 0
    min_savings_ratio: float = 0.10
    min_raw_tokens: int = 200
    binary_ratio: float = 0.3
    base_keys: bool = False
    security_patterns: list[str] = field(default_factory=list)
    blocklist: list[str] = field(default_factory=list)
    always_keep: list[str] = field(default_factory=list)
    always_strip: list[str] = field(default_factory=list)


CONDENSERS = {
    "generic": rows.generic,
    "list": rows.list_lines,
    "progress": shapes.progress,
    "test": shapes.test_run,
    "diff": shapes.diff,
    "table": shapes.table,
    "keyvalue": shapes.keyvalue,
    "error": shapes.error_trace,
}
BYPASS, BAD_PATTERN = "bypass", "contract pattern does not compile"


def gated(outputs: DataFrame, settings: Settings) -> DataFrame:
    """Outputs with ``reason`` (null to condense), the command normalised, escapes removed."""
    raw = F.col("output")
    passed = F.when(oversize(raw, settings.max_output_bytes), F.lit(OVERSIZE))
    if "bypass" in outputs.columns:
        passed = F.when(F.col("bypass"), F.lit(BYPASS)).otherwise(passed)
    df = outputs.withColumn("_passed", passed)
    if settings.strip_ansi:
        df = df.withColumn("output", F.when(F.col("_passed").isNull(), strip_ansi(raw)).otherwise(raw))
    df = gate(
        df,
        pass_errors=settings.pass_errors,
        blocklist=settings.blocklist,
        extra_patterns=settings.security_patterns,
        binary_ratio=settings.binary_ratio,
        min_lines=settings.min_lines,
    )
    return df.withColumn("reason", F.coalesce("_passed", "reason")).drop("_passed", "bypass")


def runnable(overrides: DataFrame) -> tuple[DataFrame, list[str]]:
    """Overrides with their patterns as Java writes them, and the patterns that don't compile.

    The distinct patterns of the table, which users write by hand, are checked on the driver."""
    used = overrides.select(F.explode(F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in CONTRACT]))).alias("p"))
    patterns = [r.p for r in used.distinct().collect() if r.p is not None]
    bad, java = bad_patterns(patterns), java_patterns(patterns)
    changed = {p: q for p, q in java.items() if p != q}
    if changed:
        names = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
        overrides = overrides.withColumns({c: F.transform(c, lambda p: F.coalesce(names[p], p)) for c in CONTRACT})
    return overrides, bad


def route(
    outputs: DataFrame,
    rules: DataFrame | None = None,
    overrides: DataFrame | None = None,
    registry: DataFrame | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """Gate and resolve: adds reason, strategy, source, parameters ``p`` and raw tokens."""
    settings = settings or Settings()
    rules = seeds(outputs.sparkSession) if rules is None else rules
    df = gated(outputs, settings)
    df = df.withColumn("text", F.col("output"))
    # skipped outputs are neither resolved nor classified
    df = df.withColumn("output", F.when(F.col("reason").isNull(), F.col("text")))
    df = df.withColumn("command", F.when(F.col("reason").isNull(), normalize_command(F.col("command"))).otherwise(F.col("command")))
    df = resolve_strategy(df, rules, registry, settings.base_keys)
    df = df.withColumn("output", F.col("text")).drop("text")
    live = F.col("reason").isNull()
    if bad_patterns([*settings.always_keep, *settings.always_strip]):
        df = df.withColumn("reason", F.coalesce("reason", F.lit(BAD_PATTERN)))
    if overrides is None:
        df = df.withColumn("p", merge_params(F.col("params"), None))
    else:
        overrides, bad = runnable(overrides)
        df = match_prefix(df, overrides, into="user")
        if bad:
            broken = [F.arrays_overlap(F.coalesce(F.col(f"user.{name}"), F.array().cast("array<string>")), F.lit(bad)) for name in CONTRACT]
            df = df.withColumn("reason", F.coalesce("reason", F.when(broken[0] | broken[1], F.lit(BAD_PATTERN))))
        merged = df.withColumn("q", merge_params(F.col("params"), F.col("user.params")))
        contract = [merge_contract([], F.col(f"user.{name}")).alias(name) for name in CONTRACT]
        df = merged.withColumn("p", F.struct("q.*", *contract)).drop("q", "user")
    return df.select(
        *[c for c in df.columns if c not in ("params", "strategy", "source")],
        F.when(live, F.col("strategy")).alias("strategy"),
        F.when(live, F.col("source")).alias("source"),
        F.when(live, count_tokens(F.col("output"))).alias("raw_tokens"),
    )


def condensed_part(routed: DataFrame, strategy: str, settings: Settings) -> DataFrame:
    """``(doc_id, text, tokens)`` of the outputs routed to one strategy."""
    docs = routed.filter((F.col("strategy") == strategy) & F.col("reason").isNull())
    lines = explode_lines(docs, keep=("doc_id", "p"))
    condenser = CONDENSERS.get(strategy, rows.generic)
    text = budget.to_text(condenser(lines, keep=settings.always_keep, strip=settings.always_strip))
    return text.filter("text <> ''").withColumn("tokens", count_tokens(F.col("text")))


def condense(routed: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Every routed output through its condenser: one job per strategy in use, stored as one table.

    A job for all strategies would be re-planned as a whole after each of its many stages.
    """
    settings = settings or Settings()
    used = [row[0] for row in routed.select("strategy").distinct().collect() if row[0] is not None]
    parts = [condensed_part(routed, name, settings) for name in sorted(used) or ["generic"]]
    return staged_parts(routed.sparkSession, parts, "condensed")


def _guarded(routed: DataFrame, condensed: DataFrame, settings: Settings) -> DataFrame:
    """Second chances for outputs that saved too little or exceed the token target."""
    live = routed.filter("reason is null")
    least = settings.min_raw_tokens or 200
    sizes = live.select("doc_id", "raw_tokens").join(condensed.select("doc_id", "tokens"), "doc_id", "left")
    sizes = sizes.withColumn("tokens", F.coalesce("tokens", "raw_tokens")).filter(F.col("raw_tokens") > least)
    keep, strip = settings.always_keep, settings.always_strip
    target = settings.target_max_tokens
    best = condensed
    if target > 0:
        over = sizes.filter((F.col("raw_tokens") > target) & (F.col("tokens") > target))
        lines = explode_lines(live.join(over.select("doc_id"), "doc_id", "left_semi"), keep=("doc_id", "p"))
        found = budget.budget_ladder(lines, over.select("doc_id", "tokens"), target, keep, strip)
        best = staged(_replace(best, found), "laddered")
        sizes = sizes.select("doc_id", "raw_tokens").join(best.select("doc_id", "tokens"), "doc_id", "left")
        sizes = sizes.withColumn("tokens", F.coalesce("tokens", "raw_tokens"))
    if settings.min_savings_ratio > 0:
        reduction = 1 - F.col("tokens") / F.col("raw_tokens")
        low = sizes.filter(reduction < F.lit(settings.min_savings_ratio))
        lines = explode_lines(live.join(low.select("doc_id"), "doc_id", "left_semi"), keep=("doc_id", "p"))
        most, head, tail = budget.SECOND_CHANCE
        again = rows.head_tail(rows.always_strip(rows.collapse_runs(lines, 3), strip), most, head, tail)
        again = budget.to_text(rows.always_keep(again, lines, keep)).filter("text <> ''")
        again = again.withColumn("new", count_tokens(F.col("text")))
        better = again.join(low, "doc_id").filter(
            1 - F.col("new") / F.col("raw_tokens") > 1 - F.col("tokens") / F.col("raw_tokens")
        )
        best = staged(_replace(best, better.select("doc_id", "text", F.col("new").alias("tokens"))), "second")
    if target > 0:
        # a rule that leaves nothing falls back to the output, which has to meet the target too
        empty = live.filter(F.col("raw_tokens") > least).join(best.select("doc_id"), "doc_id", "left_anti")
        best = best.unionByName(empty.select("doc_id", F.col("output").alias("text"), F.col("raw_tokens").alias("tokens")))
        wide = best.filter(F.col("tokens") > target).join(
            live.filter((F.col("raw_tokens") > target) & (F.col("raw_tokens") > least)).select("doc_id"),
            "doc_id",
            "left_semi",
        )
        fitted = budget.fit_to_budget(wide, target).withColumn("tokens", count_tokens(F.col("text")))
        best = _replace(best, fitted)
    return best


def _replace(texts: DataFrame, better: DataFrame) -> DataFrame:
    """``texts`` with the rows of ``better`` put in (both one row per document)."""
    new = better.select("doc_id", F.col("text").alias("_text"), F.col("tokens").alias("_tokens"))
    both = texts.join(new, "doc_id", "full")
    return both.select(
        "doc_id", F.coalesce("_text", "text").alias("text"), F.coalesce("_tokens", "tokens").alias("tokens")
    )


def condense_outputs(
    outputs: DataFrame,
    rules: DataFrame | None = None,
    overrides: DataFrame | None = None,
    registry: DataFrame | None = None,
    settings: Settings | None = None,
) -> DataFrame:
    """One row per output ``(doc_id, command, output, ...)`` with ``result``, why it was passed
    through (``reason``), ``strategy``, ``source`` and token counts."""
    settings = settings or Settings()
    routed = staged(route(outputs, rules, overrides, registry, settings), "routed", partition_by="strategy")
    bad = bad_patterns([*settings.always_keep, *settings.always_strip])
    if bad:  # all outputs pass through by now
        settings = replace(settings, **{c: [p for p in getattr(settings, c) if p not in bad] for c in CONTRACT})
    best = _guarded(routed, condense(routed, settings), settings)
    # outputs that pass through need no join, so their text isn't shuffled
    passed = routed.filter("reason is not null").withColumn("result", F.col("output"))
    passed = passed.withColumn("compressed_tokens", F.lit(None).cast("bigint"))
    live = routed.filter("reason is null").join(best, "doc_id", "left")
    guarded = budget.regression_guard(F.col("output"), F.col("text"), F.col("raw_tokens"), F.col("tokens"))
    live = live.withColumn("result", guarded)
    kept = F.col("text").isNull() | (F.col("result") != F.col("text"))
    live = live.withColumn("compressed_tokens", F.when(kept, F.col("raw_tokens")).otherwise(F.col("tokens")))
    return passed.unionByName(live.drop("text", "tokens")).drop("p")


def condense_segments(segments: DataFrame, **options) -> DataFrame:
    """``(run_id, segment, part, reason, strategy, source, raw_tokens, compressed_tokens, result)``: every silent segment
    condensed by itself.

    ``segments`` has ``(run_id, segment, part, output, reason)`` of ``segment_outputs``, batch or stream, and ``command``. Rows with a reason
    are pieces of segments over the size limit; they pass through. In order of segment and part the results are the run.
    """
    keyed = segments.withColumn("doc_id", F.struct("run_id", "segment"))
    small = keyed.filter("reason is null").select("doc_id", "command", "output")
    columns = ["reason", "strategy", "source", "raw_tokens", "compressed_tokens", "result"]
    found = condense_outputs(small, **options).select("doc_id.*", F.lit(0).cast("long").alias("part"), *columns)
    large = segments.filter("reason is not null").withColumn("result", F.col("output"))
    return found.unionByName(large.select("run_id", "segment", "part", "reason", "result"), allowMissingColumns=True)


def condense_tool_events(events: DataFrame, **options) -> DataFrame:
    """``(doc_id, value)``: the JSON answer to every shell event worth condensing, and envelopes that
    are answers already, unchanged. ``events(doc_id, value)`` in any dialect; others get no answer."""
    calls = normalize_tool_events(events).filter(~fast_exit(F.col("output")))
    results = condense_outputs(calls.select("doc_id", "dialect", "command", "output"), **options)
    answers = tool_envelopes(results.select("doc_id", "dialect", "result")).select("doc_id", "value")
    return answers.unionByName(already_transformed(events).select("doc_id", "value"))


def call_log(results: DataFrame) -> DataFrame:
    """Calls to learn from: condensed outputs that no seed decided, numbered in order of time and id."""
    order = [c for c in ("ts", "doc_id") if c in results.columns]
    calls = results.filter(F.col("reason").isNull() & (F.col("source") != "seed"))
    return number_all(calls.select("command", "strategy", "raw_tokens", "compressed_tokens", *order), order, "seq").select(
        "command",
        "seq",
        F.col("strategy").alias("shape"),
        F.col("raw_tokens").alias("raw"),
        F.col("compressed_tokens").alias("comp"),
        *(["ts"] if "ts" in results.columns else [F.current_timestamp().alias("ts")]),
    )


def history_rows(results: DataFrame) -> DataFrame:
    """Condensed outputs as history entries (skipped ones are not kept)."""
    return results.filter(F.col("reason").isNull()).select(
        "doc_id",
        "command",
        "strategy",
        "source",
        F.col("output").alias("raw_output"),
        F.col("result").alias("compressed_output"),
        "raw_tokens",
        "compressed_tokens",
        *([F.col("ts").alias("created_at")] if "ts" in results.columns else [F.current_timestamp().alias("created_at")]),
    )
