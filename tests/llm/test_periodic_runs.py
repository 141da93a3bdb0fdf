"""Runs against comparing all words at all periods; transforms against plain sums."""

import hashlib
import random
import re
import zlib

import numpy as np
from linefold.llm.convolution import PRIME, mismatches, zero_mismatches
from linefold.llm.periodic_runs import find_runs, greatest, kept_words, runs_of
from linefold.llm.queries import op11_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=24):
    n, found = len(words), {}
    for period in range(1, n // 3 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if (length := j - i + period) >= max(least, 3 * period) and j > i:
                found.setdefault((i, length), period)
            i = j + 1
    return sorted((start, length, period) for (start, length), period in found.items())


def random_words(rng):
    words, letters = [], rng.choice([1, 2, 3, 30])
    for _ in range(rng.randint(0, 5)):
        period = [str(rng.randrange(letters)) for _ in range(rng.randint(1, 60))]
        words += (period * 6)[: rng.randint(0, 5 * len(period))]
    return words


def test_sums_are_exact():
    rng = np.random.default_rng(0)
    for length in (2, 8, 64):
        blocks = rng.integers(0, 50, (5, length)).astype(np.uint64)
        windows = rng.integers(0, 50, (5, 2 * length)).astype(np.uint64)
        got = mismatches(blocks, windows)
        for row in range(5):
            for t in range(length):
                difference = blocks[row].astype(np.int64) - windows[row, t : t + length].astype(np.int64)
                assert got[row, t] == (difference**2).sum() % PRIME


def test_occurrences_at_the_end():
    values = np.array([1, 2, 3, 4, 9, 1, 2, 3, 4], np.uint64)
    start, distance = zero_mismatches(values, np.array([0]), 4, 4)
    assert list(zip(start.tolist(), distance.tolist(), strict=True)) == [(0, 5)]


def test_against_all_periods():
    rng = random.Random(1)
    for _ in range(150):
        texts = [random_words(rng) for _ in range(rng.randint(1, 6))]
        for words, runs in zip(texts, runs_of(texts), strict=True):
            assert [tuple(r) for r in runs.tolist()] == plain_runs(words)
    assert [r.tolist() for r in runs_of([["a", "b"] * 2, [], ["a"] * 9], least=4)] == [[], [], [[0, 9, 1]]]


def test_words_of_one_text_are_not_those_of_the_next():
    assert [len(r) for r in runs_of([["a"] * 20, ["a"] * 20, ["a"] * 30])] == [0, 0, 1]


def test_kept_and_greatest():
    runs = np.array([(0, 30, 10), (5, 24, 2), (5, 48, 4)])
    kept = np.flatnonzero(kept_words(60, runs)).tolist()
    assert kept == [0, 1, 2, 3, 4, 5, 6, 53, 54, 55, 56, 57, 58, 59]
    assert greatest(runs) == (5, 24, 2) and greatest(runs[:0]) is None


def test_long_periodic_texts_take_little_more_than_linear_time():
    many = ["spam", "ham"] * 50_000
    assert runs_of([many])[0].tolist() == [[0, 100_000, 2]]
    steps = (["a"] * 3000 + ["b"]) * 20
    assert [0, len(steps), 3001] in runs_of([steps])[0].tolist()


def test_table(spark, docs_of, odd_rows):
    rows = [*odd_rows, (8, "again and " * 30), (9, "x " + "a b c " * 9 + "y")]
    table = docs_of(rows).withColumnRenamed("slot", "runs").withColumnRenamed("bucket", "collapsed")
    got = find_runs(table).collect()
    assert len(got) == len(rows) and got[0].lang == "en"
    expected = sorted(
        ((i, len(w := re.findall("[^\x20\x09-\x0D]+", t or "")), plain_runs(w) if len(w) < 9000 else [(0, 80_000, 2)]) for i, t in rows), key=repr
    )
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in got), key=repr) == expected
    assert {r.collapsed for r in got if r.doc_id == 9} == {"x a b c y"}
    assert {r.collapsed for r in got if r.doc_id == 6} == {"long words"}
    assert find_runs(docs_of([])).collect() == []


def test_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op11_periodic_runs(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    n_runs = 0
    for row in got:
        words = re.findall("[^\x20\x09-\x0D]+", texts[row.doc_id] or "")
        n, h = len(words), zlib.crc32(str(row.doc_id).encode())
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 2500:
            continue
        runs = plain_runs(words)
        dropped = {i for s, length, p in runs for i in range(s + p, s + length)}
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        left = " ".join(w for i, w in enumerate(words) if i not in dropped)
        assert row.n_runs == len(runs)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(left.encode()).hexdigest()
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        assert (row.start, row.length, row.period) == (best or (None,) * 3)
        assert row.exponent_milli == (best and 1000 * best[1] // best[2])
        n_runs += len(runs)
    assert n_runs > 5
