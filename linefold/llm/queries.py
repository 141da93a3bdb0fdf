"""The registered queries of the operators, with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm import (
    bit_planes,
    decontamination,
    minhash,
    multi_index,
    packing,
    periodic_runs,
    prefix_trie,
    sharding,
    substring_dedup,
    suffix_tree,
    surrogates,
    toxicity,
)
from linefold.llm import token_counts as tokens
from linefold.llm.store import crc_mod, fresh_path, stage, table

TOKENIZER = "byte_bpe_50k.json"
CONTEXT_TOKENS = 512
END_ID = 2
LEAST_RUN = 24
BUCKETS, BATCH_TOKENS = 16, 32_768
SHARDS = [f"shard-{i:03d}" for i in range(64)]
#: Fixed value: words are what lies between ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"
#: Stands in for a secret that a deployment sets.
PII_KEY = "a key of the deployment"
TOXIC_SCORE = 0.3


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length buckets and token-budget batches of all documents."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokens.token_counts(texts, public_tokenizers.path(TOKENIZER), keep=["doc_id"]).drop("n_bytes")
    return packing.pack(counts, "n_tokens", BUCKETS, BATCH_TOKENS)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document."""
    placed = sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS)
    return placed.select("doc_id", "slot", "shard")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data and secrets replaced."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymised(texts, PII_KEY)


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-tree scores of all documents, learnt from nine tenths of them."""
    found = suffix_tree.scores(table(spark, sf_dir, "documents"), crc_mod("doc_id", 10) != 0)
    return found.withColumn("held_out", ~F.col("learn")).drop("learn")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left when repeated windows of 13 words are removed from all documents."""
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), width=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of three quarters of them."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.toxicity(documents.select("doc_id", "text"), labels, crc_mod("doc_id", 4) != 2)
    return found.select(
        "doc_id",
        (crc_mod("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"),
    )


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector."""
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, k=10)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether they overflow the context."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = tokens.token_counts(texts, public_tokenizers.path(TOKENIZER), keep=["doc_id"])
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents that 13-word windows of the benchmark hit."""
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates on 4-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def with_planted_loops(documents: DataFrame) -> DataFrame:
    """``(doc_id, text)``, where a tenth of the texts repeat a period of theirs to the end; others are as they are."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words, n = F.col("words"), F.size("words").cast("long")
    docs = documents.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"))
    docs = docs.withColumn("words", F.when((F.col("h") % 10 == 0) & (F.col("text") != ""), F.regexp_extract_all("text", F.lit(WORDS), 0)))
    looped = F.size("words") > 0
    docs = docs.withColumn("a", F.when(looped, F.col("g") % n))
    docs = docs.withColumn("p", F.when(looped, 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    text = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: words[at(i)]), " ")
    return docs.select("doc_id", F.when(looped, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of all documents, and digests of all runs and of the texts without repeats."""
    found = periodic_runs.find_runs(with_planted_loops(table(spark, sf_dir, "documents")), LEAST_RUN)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col("best")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as plane files and read back."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = fresh_path(spark, "token-ids")
    bit_planes.write_ids(bit_planes.encoded(documents, public_tokenizers.path(TOKENIZER), END_ID), path)
    found = bit_planes.read_ids(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and ids of conversations that begin as the one with the id a multiple of 5 below theirs does."""
    heads = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(9))
    sizes = turns.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"))
    convs = sizes.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("first"), heads.alias("h"))
    firsts = sizes.select(F.col("conv_id").alias("first"), F.col("n").alias("n_first"))
    convs = convs.join(firsts, "first", "left").withColumn("n_head", F.least("h", F.coalesce("n_first", F.lit(0))))
    begun = turns.filter((F.col("conv_id") % 5 == 0) & (F.col("pos") < 8)).withColumnRenamed("conv_id", "first")
    head = begun.join(convs, "first").filter(F.col("pos") < F.col("n_head"))
    tail = prefix_trie.meet(turns, convs, "conv_id", F.floor(F.col("pos") / 256)).filter(F.col("pos") >= F.col("h"))
    tail = tail.withColumn("pos", F.col("pos") - F.col("h") + F.col("n_head"))
    columns = ["conv_id", "pos", "digest", "bytes"]
    return head.select(columns).unionByName(tail.select(columns)), convs.select("conv_id")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations."""
    turns, convs = rebuilt(stage(prefix_trie.turn_rows(table(spark, sf_dir, "conversations")), "turns"))
    return prefix_trie.prefix_trie(turns, stage(convs, "convs"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_sharding": op3_sharding,
    "op4_multi_index": op4_multi_index,
    "op5_token_counts": op5_token_counts,
    "op6_surrogates": op6_surrogates,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_decontamination": op9_decontamination,
    "op10_minhash": op10_minhash,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_bit_planes": op12_bit_planes,
    "op13_prefix_trie": op13_prefix_trie,
}
