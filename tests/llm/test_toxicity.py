"""Decoding of disguised words, and held-out accuracy."""

import random

import numpy as np
import pytest
from linefold.llm.toxicity import SIZE, Decoder, Reader, toxicity, trigram_counts
from pyspark.sql import functions as F

CLEAN = "the idiot said you are a stupid clown and the other one is a good man who reads many books in the old garden".split()


@pytest.fixture(scope="module")
def reader():
    return Reader(Decoder(trigram_counts([" ".join(CLEAN)] * 50)))


@pytest.mark.parametrize(
    ("text", "word"),
    [
        ("1d10t", "idiot"), ("!diot!", "idiot"), ("id1ot,", "idiot"), ("iiidiooot", "idiot"), ("i d i o t", "idiot"), ("i.d.i.o.t", "idiot"),
        ("$tup1d", "stupid"), ("s-t-u-p-i-d", "stupid"), ("cl0wn", "clown"), ("STUUUPID", "stupid"), ("you are a s t u p i d", "stupid"), ("st_up_id", "stupid"),
    ],
)
def test_restored(reader, text, word):
    assert word in reader.features(text)


def test_plain_words_stay(reader):
    assert reader.features("Good books, 1984 and 4026083977531332; see a.b") >= {"good", "books", "and", "see"}
    assert reader.features(None) == reader.features("") == set()


def test_trigrams():
    counts = trigram_counts(["ab", "ab  ab!"]).reshape(SIZE, SIZE, SIZE)
    assert counts[:, 0, 1].sum() == 1 and counts[0, 1, 2] == 3 and counts[1, 2, 0] == 3
    assert trigram_counts([]).sum() == 0 and np.isfinite(np.array(Decoder(trigram_counts([])).log)).all()


def labelled(seed, n):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeiorstnl") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "stupid", "clown"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    return docs, labels


def test_held_out_and_disguised(spark, docs_of):
    docs, labels = labelled(3, 500)
    extra = [(1000, "aeno stol 1d10t rost"), (1001, "nael s t u p i d tore"), (1002, "nael tore rast"), (1003, None), (1004, "")]
    table = spark.createDataFrame([*labels, (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(docs_of(docs + extra), table, F.col("doc_id") % 4 != 2)
    assert got.columns.count("score") == 1
    score = {r.doc_id: r.score for r in got.collect()}
    held = [(score[i] >= 0.3) == bool(t) for i, _, t in labels if i % 4 == 2]
    assert sum(held) >= 0.97 * len(held)
    assert score[1000] > 0.5 and score[1001] > 0.5 and max(score[1002], score[1003], score[1004]) < 0.3


def test_odd_rows(spark, docs_of, odd_rows):
    table = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity(docs_of(odd_rows), table, F.lit(True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    unlabelled = toxicity(docs_of(odd_rows), table.limit(0), F.lit(True)).collect()
    assert len({r.score for r in unlabelled}) == 1 and unlabelled[0].score < 0.3
    assert toxicity(docs_of([]), table, F.lit(True)).collect() == []


@pytest.mark.parametrize("text", ["st" + "u" * 40 + "pid", "1d10t.y0u.4r3.4.cl0wn.s7up1d", " ".join("theotheroneisagoodmanstupidman")])
def test_long_tokens_and_runs(reader, text):
    assert "stupid" in reader.features(text)


def test_pieces_are_joined(reader, monkeypatch):
    token = ".".join(["1d10t", "cl0wn", "s7up1d"] * 40)
    want = reader.decoder.restore(token), reader.decoder.restore(" ".join(token), gaps=True)
    monkeypatch.setattr("linefold.llm.toxicity.JOINED", 7)
    assert (reader.decoder.restore(token), reader.decoder.restore(" ".join(token), gaps=True)) == want
    assert want[0].count("stupid") > 30
