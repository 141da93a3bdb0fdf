"""Hits of benchmark windows against brute force; proximity search."""

import random
import re

import pytest
from linefold.llm.decontamination import build_index, contamination, proximity_matches
from pyspark.sql import functions as F

CUT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return CUT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(rows, items, window):
    out = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for item, test in items:
            test = words_of(test)
            n = min(window, len(test))
            for s in range(len(test) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == test[s : s + n]:
                        hit |= set(range(p, p + n))
                        found |= {str(item)} - {"None"}
        out.append((i, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=repr)


def test_planted_passages(spark, docs_of, prose):
    rng = random.Random(2)
    items = [(k, t) for k, t in enumerate(prose(2, 12, 40, 30))] + [(50, "Only three words"), (51, ""), (52, None), (None, "no id here at all")]
    items += [(53, items[0][1])]
    rows = []
    for i, text in enumerate(prose(3, 40, 200, 30)):
        words = text.split()
        test = (rng.choice(items)[1] or "").split()
        at, cut = rng.randint(0, len(words)), rng.randint(0, max(0, len(test) - 13))
        rows.append((i, " ".join([*words[:at], *test[cut:], *words[at:]]).replace(" ", rng.choice([" ", ", ", "\n"])).title()))
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert result(contamination(docs_of(rows), tests)) == expected(rows, items, 13)
    assert result(contamination(docs_of(rows), tests, window=4)) == expected(rows, items, 4)


def test_odd_rows(spark, docs_of, odd_rows):
    items = [(1, "b c d"), (2, "same id"), (3, None)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_rows[:8]
    assert result(contamination(docs_of(rows), tests)) == expected(rows, items, 13)
    assert len(contamination(docs_of(odd_rows), tests).collect()) == len(odd_rows)
    assert contamination(docs_of([]), tests).collect() == []
    assert {r.n_hit for r in contamination(docs_of(rows), tests.limit(0)).collect()} == {0}


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "a x x x x x b"), (3, "c b a")], "doc long, text string")
    queries = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["q"])], "query int, words array<string>")
    found = proximity_matches(build_index(docs), queries, 3).select("query", "doc").distinct().orderBy("query", "doc")
    assert [tuple(r) for r in found.collect()] == [(1, 1), (1, 3), (2, 3)]
    assert build_index(docs).where(F.col("word") == "x").count() == 8


@pytest.mark.parametrize("n", [7, 13, 20_000])
def test_repetitive_texts(spark, docs_of, n):
    """An item and a document of one repeated phrase: every place is an alignment."""
    words = ["spam", "ham"] * n
    docs = docs_of([(1, " ".join(words)), (2, "ham " * 12 + "spam"), (3, "x " + " ".join(words[:30]) + " y z")])
    items = spark.createDataFrame([("a", "spam ham " * 100), ("b", "ham spam ham"), ("c", "ham " * 40)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(docs, items).collect()}
    assert got[1] == (2 * n, 2 * n, ["a", "b"] if n > 6 else ["b"])
    assert got[2] == (13, 0, [])
    assert got[3] == (3 + min(30, 2 * n), min(30, 2 * n), ["a", "b"])
