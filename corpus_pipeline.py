"""A training corpus from the documents table: each stage reads all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linefold.llm import decontamination, minhash, packing, surrogates, toxicity
from linefold.llm.queries import BATCH_TOKENS, BUCKETS, PII_KEY, TOKENIZER, TOXIC_SCORE
from linefold.llm.store import crc_mod, stage, table
from linefold.llm.token_counts import token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores below the limit."""
    scored = toxicity.toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return scored.where(F.col("score") < TOXIC_SCORE).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; of rows that repeat an id, the least. Rows without an id stay."""
    docs = docs.select(COLUMNS)
    found = minhash.near_duplicates(docs, width=5, percent=80)
    copies = stage(found.where("not kept").select("doc_id").distinct(), "copies")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    repeated = stage(repeated, "repeated")
    left = docs.join(copies, "doc_id", "left_anti")
    if repeated.isEmpty():
        return left.select(COLUMNS)
    least = left.join(repeated, "doc_id").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    single = left.join(repeated, "doc_id", "left_anti")
    return single.select(COLUMNS).unionByName(least.select("doc_id", "row.*"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows hit less than a twentieth. Of rows without an id all clean ones stay."""
    docs = docs.select(COLUMNS)
    found = decontamination.contamination(docs.where("doc_id is not null"), table(spark, sf_dir, "benchmark"))
    hit = stage(found.where("contaminated").select("doc_id").distinct(), "contaminated")
    return docs.join(hit, "doc_id", "left_anti").select(COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and secrets."""
    found = surrogates.pseudonymised(docs.select(COLUMNS), PII_KEY)
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return found.withColumn("n_chars", length).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their length bucket and batch."""
    counted = token_counts(docs.select(COLUMNS), public_tokenizers.path(TOKENIZER)).drop("n_bytes")
    return packing.pack(counted, "n_tokens", BUCKETS, BATCH_TOKENS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", replace_private),
    ("packing", pack),
]

#: Stages 1, 2 and 4 aren't expressible in SQL; tests hold all stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
