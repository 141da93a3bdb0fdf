"""Seed rules, user extensions, overrides, and their resolution per command."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shape import SHAPES, detect
from ..functions.text import base_command_key
from ..session import staged
from .registry import usable_entries

PARAMS = T.StructType(
    [
        T.StructField("max_lines", T.IntegerType()),
        T.StructField("head_lines", T.IntegerType()),
        T.StructField("tail_lines", T.IntegerType()),
        T.StructField("dedup_min_repeats", T.IntegerType()),
        T.StructField("dedup", T.BooleanType()),
        T.StructField("group_by_directory", T.BooleanType()),
        T.StructField("keep", T.StringType()),
        T.StructField("strip_percentage", T.BooleanType()),
        T.StructField("max_traceback_lines", T.IntegerType()),
        T.StructField("strip_stdlib_frames", T.BooleanType()),
        T.StructField("context_lines", T.IntegerType()),
        T.StructField("max_rows", T.IntegerType()),
        T.StructField("max_columns", T.IntegerType()),
        T.StructField("max_cell_length", T.IntegerType()),
        T.StructField("always_strip_keys", T.ArrayType(T.StringType())),
    ]
)
RULES = T.StructType(
    [
        T.StructField("prefix", T.StringType()),
        T.StructField("strategy", T.StringType()),
        T.StructField("params", PARAMS),
        T.StructField("streamable", T.BooleanType()),
        T.StructField("user_override", T.BooleanType()),
    ]
)

# The built-in rules (prefix, strategy, parameters, streamable).
SEEDS = [
    ("git status", "keyvalue", {"max_lines": 15}, False),
    ("git diff", "diff", {"max_lines": 80, "context_lines": 2}, False),
    ("git log", "list", {"max_lines": 20}, False),
    ("git push", "progress", {"keep": "final_line"}, False),
    ("git pull", "progress", {"keep": "final_line"}, False),
    ("git stash", "list", {"max_lines": 10}, False),
    ("docker ps", "table", {"max_rows": 15}, False),
    ("docker build", "progress", {"keep": "errors_and_final"}, True),
    ("docker logs", "list", {"dedup": True, "tail_lines": 30}, False),
    ("docker images", "table", {"max_rows": 20}, False),
    ("pytest", "test", {"keep": "failed_only"}, False),
    ("jest", "test", {"keep": "failed_only"}, False),
    ("cargo test", "test", {"keep": "failed_only"}, False),
    ("npm install", "progress", {"keep": "final_line"}, True),
    ("pip install", "progress", {"keep": "final_line"}, True),
    ("cargo build", "progress", {"keep": "errors_and_final"}, True),
    ("npm run build", "progress", {"keep": "errors_and_final"}, True),
    ("ls", "list", {"max_lines": 30}, False),
    ("find", "list", {"group_by_directory": True}, False),
    ("cat", "list", {"max_lines": 50}, False),
]
STRATEGIES = ("generic", *SHAPES)
EXTENSION_KEYS = ["strategy", "params", "streamable", "user_override"]

BROADCAST_BYTES, ROW_BYTES = 64 << 20, 512


def seeds(spark: SparkSession) -> DataFrame:
    rows = [
        (prefix, strategy, tuple(params.get(f) for f in PARAMS.names), stream, False)
        for prefix, strategy, params, stream in SEEDS
    ]
    return spark.createDataFrame(rows, RULES)


def checked_extensions(entries: DataFrame) -> DataFrame:
    """Extension entries ``(file, prefix, body)`` with ``reason`` of rejection (null if valid)."""
    body = F.try_parse_json("body")
    df = entries.withColumn("v", body)

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.variant_get("v", path, "variant"))

    def given(path: str) -> Column:
        return F.variant_get("v", path, "variant").isNotNull() & (kind(path) != "VOID")

    is_map = F.coalesce(F.startswith(F.schema_of_variant("v"), F.lit("OBJECT")), F.lit(False))
    unknown = F.array_except(F.json_object_keys("body"), F.array(*[F.lit(k) for k in EXTENSION_KEYS]))
    strategy = F.try_variant_get("v", "$.strategy", "string")
    reason = (
        F.when(~is_map, F.lit("not a mapping"))
        .when(F.size(unknown) > 0, F.lit("unknown keys"))
        .when(
            given("$.strategy") & ~((kind("$.strategy") == "STRING") & strategy.isin(*STRATEGIES)),
            F.lit("unknown strategy"),
        )
        .when(given("$.params") & ~F.startswith(kind("$.params"), F.lit("OBJECT")), F.lit("params must be a mapping"))
        .when(given("$.streamable") & (kind("$.streamable") != "BOOLEAN"), F.lit("streamable must be a bool"))
    )
    return df.withColumn("reason", reason).drop("v")


def valid_extensions(entries: DataFrame) -> DataFrame:
    """Valid entries as rules; every one counts as set by the user."""
    good = checked_extensions(entries).filter("reason is null")
    return good.select(
        "file",
        "prefix",
        F.get_json_object("body", "$.strategy").alias("strategy"),
        F.from_json(F.get_json_object("body", "$.params"), PARAMS).alias("params"),
        F.coalesce(F.get_json_object("body", "$.streamable").cast("boolean"), F.lit(False)).alias("streamable"),
        F.lit(True).alias("user_override"),
    )


def seed_table(builtin: DataFrame, extensions: DataFrame | None = None) -> DataFrame:
    """One rule per prefix: extensions replace seeds, a later file replaces an earlier one."""
    if extensions is None:
        return builtin
    both = builtin.withColumn("file", F.lit("")).unionByName(extensions)
    rule = F.max_by(F.struct("strategy", "params", "streamable", "user_override"), "file")
    return both.groupBy("prefix").agg(rule.alias("rule")).select("prefix", "rule.*")


def match_prefix(df: DataFrame, rules: DataFrame, command: str = "command", into: str = "rule") -> DataFrame:
    """Add ``into``: the rule with the longest prefix of whole words, or null. Of rules that repeat a
    prefix one counts, the greatest.

    One equi-join per prefix length, longest first, in place of a ``startswith`` join. Rules are broadcast only
    below a checked number of bytes; beyond it the joins are salted by ``doc_id``, so a hot command is split.
    """
    others = [c for c in rules.columns if c != "prefix"]
    single = rules.groupBy("prefix").agg(F.max(F.struct(*others)).alias("_rule"))
    rules = single.select(*[F.col(c) if c == "prefix" else F.col(f"_rule.{c}") for c in rules.columns])
    words = F.size(F.split("prefix", " "))
    size = rules.agg(_bytes(rules).alias("bytes"), F.max(words).alias("words")).first()
    found = []
    for k in range(size["words"] or 0, 0, -1):
        level = rules.filter(words == k).select(F.col("prefix").alias("_prefix"), F.struct(*rules.columns).alias(f"_rule{k}"))
        df = df.withColumn("_prefix", F.substring_index(F.col(command), " ", k))
        if size["bytes"] <= BROADCAST_BYTES:
            df = df.join(F.broadcast(level), "_prefix", "left").drop("_prefix")
        else:
            df = salted_lookup(df, level, "_prefix").drop("_prefix")
        found.append(f"_rule{k}")
    if not found:
        return df.withColumn(into, F.lit(None).cast(T.StructType(rules.schema.fields)))
    return df.withColumn(into, F.coalesce(*[F.col(c) for c in found])).drop(*found)


def merge_params(rule: Column, user: Column | None) -> Column:
    """User parameters over rule parameters, field by field (null: the strategy's default)."""
    if user is None:
        return F.struct(*[rule[f].alias(f) for f in PARAMS.names])
    return F.struct(*[F.coalesce(user[f], rule[f]).alias(f) for f in PARAMS.names])


def merge_contract(global_patterns: list[str], command_patterns: Column) -> Column:
    first = F.array(*[F.lit(p) for p in global_patterns]).cast("array<string>")
    return F.concat(first, F.coalesce(command_patterns, F.array().cast("array<string>")))


def _bytes(table: DataFrame) -> Column:
    """An upper estimate of what the rows take as a hash table: their JSON and a fixed part each."""
    return F.sum(F.octet_length(F.to_json(F.struct(*table.columns))) + ROW_BYTES)


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join to a table with one row per key, stored once. Below a checked number of bytes it is broadcast,
    and the text of ``df`` isn't shuffled."""
    table = staged(table, "lookup")
    if (table.agg(_bytes(table).alias("bytes")).first()["bytes"] or 0) <= BROADCAST_BYTES:
        return df.join(F.broadcast(table), key, "left")
    return salted_lookup(df, table, key)


def salted_lookup(
    df: DataFrame, table: DataFrame, key: str, row_id: str = "doc_id", salts: int = 16
) -> DataFrame:
    """Left join to a table with one row per key. A hot key is spread over ``salts`` tasks;
    only the table side, one row per key, is repeated."""
    left = df.withColumn("_salt", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    right = table.withColumn("_salt", F.explode(every))
    return left.join(right, [key, "_salt"], "left").drop("_salt")


def lookup_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``entry``: the usable registry entry of the exact command, or null."""
    entries = usable_entries(registry).select("command", F.struct("strategy", "source", "params", "user_override", "hot").alias("entry"))
    return lookup(df, entries, "command")


def lookup_base_key(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Add ``base_entry``: the latest hot entry that shares the two-word base key."""
    hot = usable_entries(registry).filter(F.col("hot") | F.col("user_override"))
    entries = (
        hot.withColumn("base_key", base_command_key(F.col("command")))
        .groupBy("base_key")
        .agg(F.max_by(F.struct("strategy", "source", "params"), F.struct("last_seen", "command")).alias("base_entry"))
    )
    keyed = df.withColumn("base_key", base_command_key(F.col("command")))
    return lookup(keyed, entries, "base_key").drop("base_key")


def resolve_strategy(
    outputs: DataFrame,
    rules: DataFrame,
    registry: DataFrame | None = None,
    base_keys: bool = False,
) -> DataFrame:
    """Add ``strategy``, ``source`` and ``params`` to outputs with normalised commands.

    Order: base key (if asked for), seed, registry, classifier. Only outputs that no rule or
    entry covers are classified: the text of all others is blanked for the classifier.
    """
    df = match_prefix(outputs, rules)
    seed = F.col("rule").isNotNull()
    strategy, source = F.when(seed, F.col("rule.strategy")), F.when(seed, F.lit("seed"))
    params, known = F.when(seed, F.col("rule.params")), seed
    if registry is not None:
        df = lookup_registry(df, registry)
        entry = F.col("entry").isNotNull()
        strategy = F.when(seed, strategy).when(entry, F.col("entry.strategy"))
        source = F.when(seed, source).when(entry, F.col("entry.source"))
        params = F.when(seed, params).when(entry, F.from_json("entry.params", PARAMS))
        known = known | entry
        if base_keys:
            df = lookup_base_key(df, registry)
            base = F.col("base_entry").isNotNull()
            strategy = F.when(base, F.col("base_entry.strategy")).otherwise(strategy)
            source = F.when(base, F.col("base_entry.source")).otherwise(source)
            params = F.when(base, F.from_json("base_entry.params", PARAMS)).otherwise(params)
            known = known | base
    df = df.withColumns({"strategy": strategy, "source": source, "params": params, "_known": known})
    df = detect(df.withColumn("_probe", F.when(~F.col("_known"), F.col("output"))), "_probe")
    return (
        df.withColumn("strategy", F.when(F.col("_known"), F.col("strategy")).otherwise(F.col("shape")))
        .withColumn("source", F.when(F.col("_known"), F.col("source")).otherwise(F.lit("classifier")))
        .drop("rule", "entry", "base_entry", "_known", "_probe", "shape", "confidence")
    )


def streamable(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose seed may be condensed line by line."""
    rule = F.col("rule")
    return (
        match_prefix(df, rules)
        .filter(F.coalesce(rule["streamable"], F.lit(False)) & (rule["strategy"] == "progress"))
        .drop("rule")
    )
