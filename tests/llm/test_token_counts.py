"""Token counts against the library itself."""

import random

import public_tokenizers
from linefold.llm.token_counts import TokenCounter, prove_whole_tokens, token_counts
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")


def test_random_texts_and_odd_characters():
    spec = open(FILE, encoding="utf-8").read()
    library, rng = Tokenizer.from_file(FILE), random.Random(3)
    counter = TokenCounter(spec, prove_whole_tokens(spec))
    pieces = ["the", " The", "'s", "  ", "\n\n", "\t", "don't", "<|endoftext|>", "é", "ß", "日本", "🙂", " ", " ", "\x1c", "\x85", "1234", "...",
              "͸", "\U00010940", "​", "Ж", "x" * 50, "!!", "\r\n", "<|endof", "́"]
    for _ in range(1500):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    assert counter.counts.merged < len(counter.counts)


def test_table(spark, docs_of, odd_rows):
    library = Tokenizer.from_file(FILE)
    got = token_counts(docs_of(odd_rows).withColumnRenamed("score", "n_tokens"), FILE)
    rows = got.select("text", "n_bytes", "n_tokens").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        assert r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode())
    assert token_counts(docs_of([]), FILE).collect() == []


def test_long_texts_are_streamed(monkeypatch):
    from linefold.llm import token_counts as module

    spec = open(FILE, encoding="utf-8").read()
    counter = TokenCounter(spec, prove_whole_tokens(spec))
    text = "some words, and 12 more's " * 50
    whole = counter.count(text)
    monkeypatch.setattr(module, "STREAM_CHARS", 10)
    assert counter.count(text) == whole
