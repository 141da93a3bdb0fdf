"""Token counts by a whole-token shortcut.

A byte-level BPE encodes every pre-token by itself. ``prove_whole_tokens`` runs once, in one task, and finds
the vocabulary strings that are one pre-token and that the tokenizer encodes as exactly one token. Tasks cut
texts into pre-tokens, count 1 for a proven string, and run the merges only for the rest (remembered in a
bounded table). No shuffle; the only broadcast is the tokenizer itself.

Null and empty texts have 0 tokens. Every row gives a row, repeated rows too. Texts of any length are cut as a
stream beyond ``STREAM_CHARS`` characters. Columns of the input stay; those named like new ones are replaced.
"""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from tokenizers import Tokenizer

#: Fixed value: how byte-level BPE cuts text before its merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters up to here are in the same classes in both Unicode versions at work.
SURE = "ԯ"
STREAM_CHARS = 1 << 20
REMEMBERED = 200_000


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next one above 255."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def prove_whole_tokens(spec: str) -> list[str]:
    """Vocabulary strings that are one pre-token and encode, alone, as exactly one token."""
    tokenizer = Tokenizer.from_str(spec)
    tokenizer.encode_special_tokens = True
    of_letter = {letter: byte for byte, letter in byte_letters().items()}
    strings = []
    for letters in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(bytes(of_letter[c] for c in letters).decode())
        except (KeyError, UnicodeDecodeError):
            continue  # part of a character: never a pre-token
    cut = regex.compile(PRE_TOKEN)
    strings = [s for s in strings if s and cut.findall(s) == [s]]
    encoded = tokenizer.encode_batch(strings, add_special_tokens=False)
    return [s for s, e in zip(strings, encoded, strict=True) if len(e.ids) == 1]


class PreTokenCounts(dict):
    """Tokens of a pre-token: 1 for the proven ones, else merged and remembered up to a bound."""

    def __init__(self, proven: list[str], merge) -> None:
        super().__init__(dict.fromkeys(proven, 1))
        self.merge, self.most = merge, len(proven) + REMEMBERED
        self.merged = 0

    def __missing__(self, piece: str) -> int:
        n = self.merge(piece)
        self.merged += 1
        if len(self) < self.most:
            self[piece] = n
        return n


class TokenCounter:
    """Counts tokens of texts as the library for ``spec`` does, without added special tokens."""

    def __init__(self, spec: str, proven: list[str]) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.cut = regex.compile(PRE_TOKEN)
        self.unsure = regex.compile(f"[^\0-{SURE}]")
        added = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, added)) or r"(?!)")
        self.letters = byte_letters()
        self.model = self.tokenizer.model
        self.counts = PreTokenCounts(proven, self.merge)

    def merge(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def ordinary(self, text: str) -> int:
        if len(text) > STREAM_CHARS:
            return sum(self.counts[m.group()] for m in self.cut.finditer(text))
        return sum(map(self.counts.__getitem__, self.cut.findall(text)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.unsure.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.ordinary, parts))


def proven_in_task(spark: SparkSession, spec: str) -> list[str]:
    """``prove_whole_tokens`` in a task, so that the driver holds the strings only, not the tokenizer."""

    def run(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array(prove_whole_tokens(spec), pa.string())], ["piece"])

    return [r.piece for r in spark.range(1, numPartitions=1).mapInArrow(run, "piece string").collect()]


def check_spec(spec: str) -> None:
    """Raise unless the tokenizer is of the kind that the shortcut holds for."""
    whole = json.loads(spec)
    pre, model = whole["pre_tokenizer"] or {}, whole["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix"))
    plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in whole["added_tokens"])
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
    if not (plain and byte_level and whole["normalizer"] is None and model["type"] == "BPE"):
        raise ValueError("the shortcut needs a byte-level BPE without normalizer")


def token_counts(
    docs: DataFrame, tokenizer_file: str, text_column: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``docs``, or its columns ``keep``, with ``n_bytes`` (UTF-8) and ``n_tokens`` of the text."""
    docs = docs.drop("n_bytes", "n_tokens")
    with open(tokenizer_file, encoding="utf-8") as file:
        spec = file.read()
    check_spec(spec)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast({"spec": spec, "proven": proven_in_task(spark, spec)})
    place = docs.columns.index(text_column)
    kept = [i for i, name in enumerate(docs.columns) if keep is None or name in keep]

    def run(batches):
        # a Python worker keeps the value, and so the counts it knows, for its later tasks
        own = held.value
        if "counter" not in own:
            own["counter"] = TokenCounter(own["spec"], own["proven"])
        counter = own["counter"]
        for batch in batches:
            n_bytes, n_tokens = [], []
            for text in batch.column(place):
                text = text.as_py()
                n_bytes.append(len(text.encode()) if text else 0)
                n_tokens.append(counter.count(text))
            columns = [batch.column(i) for i in kept] + [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*(batch.schema.names[i] for i in kept), "n_bytes", "n_tokens"])

    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in kept), *added]))
