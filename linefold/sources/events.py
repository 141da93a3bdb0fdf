"""Tool events: JSON of three dialects in, result envelopes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shell tools, dialect marks and the size below which nothing is done.
SHELL_TOOL, SHELL_COMMAND_TOOL = "Bash", "run_shell_command"
MIN_CHARS, MIN_BREAKS = 200, 3


def _parsed(events: DataFrame) -> DataFrame:
    """Events that hold a JSON object."""
    df = events.withColumn("v", F.try_parse_json("value"))
    return df.filter(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")))


def _text(path: str) -> Column:
    return F.try_variant_get("v", path, "string")


def _kind(path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.variant_get("v", path, "variant")), F.lit("VOID"))


def _filled(text: Column) -> Column:
    return F.when(text != "", text)


def already_transformed(events: DataFrame) -> DataFrame:
    """Events without a tool that are result envelopes already."""
    done = (_text("$.type") == "tool_result") | _text("$.decision").isin("deny", "block")
    return _parsed(events).filter((_kind("$.tool_name") == "VOID") & done).drop("v")


def normalize_tool_events(events: DataFrame) -> DataFrame:
    """``(…, dialect, command, output)`` of shell events; ``dialect`` names the envelope to answer with."""
    tool = F.when(_kind("$.tool_name") == "STRING", _text("$.tool_name"))
    df = _parsed(events).withColumn("tool", tool).filter(F.col("tool").isin(SHELL_TOOL, SHELL_COMMAND_TOOL))
    has_turn = F.variant_get("v", "$.turn_id", "variant").isNotNull()
    has_use = F.variant_get("v", "$.tool_use_id", "variant").isNotNull()
    by_command = F.col("tool") == SHELL_COMMAND_TOOL
    dialect = (
        F.when(by_command, F.lit("deny")).when(has_turn & has_use, F.lit("block")).otherwise(F.lit("tool_result"))
    )
    parts = F.try_variant_get("v", "$.tool_response.llmContent", "array<variant>")
    part_text = F.transform(
        parts,
        lambda p: F.when(
            F.startswith(F.schema_of_variant(p), F.lit("OBJECT")),
            F.coalesce(F.try_variant_get(p, "$.text", "string"), F.lit("")),
        ).otherwise(F.try_variant_get(p, "$", "string")),
    )
    content = F.when(
        F.startswith(_kind("$.tool_response.llmContent"), F.lit("ARRAY")), F.array_join(part_text, "\n")
    ).otherwise(F.coalesce(_filled(_text("$.tool_response.llmContent")), _text("$.tool_response.returnDisplay")))
    out = F.coalesce(_filled(_text("$.tool_response.output")), _filled(_text("$.tool_response.stdout")))
    err = _filled(_text("$.tool_response.stderr"))
    both = (
        F.when(out.isNull(), err)
        .when(err.isNull() | F.contains(out, err), out)
        .otherwise(F.concat(out, F.lit("\n"), err))
    )
    output = (
        F.when(_kind("$.tool_response") == "STRING", _text("$.tool_response")).when(by_command, content).otherwise(both)
    )
    df = df.withColumns({"dialect": dialect, "command": _text("$.tool_input.command"), "output": output})
    return df.filter((F.col("command") != "") & (F.col("output") != "")).drop("v", "tool", "value")


def fast_exit(output: Column) -> Column:
    """Too small to be worth condensing."""
    return (F.length(output) < MIN_CHARS) & (F.regexp_count(output, F.lit("\n")) < MIN_BREAKS)


def tool_envelopes(results: DataFrame, content: str = "result") -> DataFrame:
    """Replace ``content`` by the JSON answer of the event's dialect, in ``value``."""
    text = F.col(content)
    reply = F.when(
        F.col("dialect") == "tool_result",
        F.to_json(F.struct(F.lit("tool_result").alias("type"), text.alias("content"))),
    ).otherwise(F.to_json(F.struct(F.col("dialect").alias("decision"), text.alias("reason"))))
    return results.withColumn("value", reply).drop(content)
