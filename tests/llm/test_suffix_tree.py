"""Suffix-tree scores against a direct restatement, and held-out gain."""

import math
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from linefold.llm import suffix_tree
from linefold.llm.suffix_tree import ALPHA, DISCOUNT, scores
from pyspark.sql import functions as F


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def restated(rows, learn, depth, context_share, follower_share):
    """The same model by dictionaries of contexts, given as tuples of words."""
    train = [tokens(t) for i, t in rows if learn(i)]
    c = Counter(w for t in train for w in t)
    total, distinct = sum(c.values()), len(c)
    root = lambda w: (c[w] + ALPHA) / (total + ALPHA * (distinct + 1))
    levels, retained = [], {}

    def p(context, w, most):
        out = root(w)
        for k in range(1, most + 1):
            own = context[-k:] if len(context) >= k else None
            if own in retained:
                rest, share = retained[own]
                out = share.get(w, 0) + rest * out
        return out

    candidates = {(w,) for w in c if c[w] >= max(2, context_share * total)}
    for k in range(1, depth + 1):
        after = defaultdict(Counter)
        for t in train:
            line = [None, *t]
            for i in range(k, len(line)):
                if tuple(line[i - k : i]) in candidates:
                    after[tuple(line[i - k : i])][line[i]] += 1
        new, more = {}, set()
        for context, follows in after.items():
            n = sum(follows.values())
            shown = {w: x for w, x in follows.items() if x >= max(2, follower_share * total)}
            more |= {(*context, w) for w, x in shown.items() if x >= max(2, context_share * total)}
            others, parents = n - sum(shown.values()), {w: p(context, w, k - 1) for w in shown}
            ratio = sum(x * math.log(x / n / parents[w]) for w, x in shown.items())
            if others:
                ratio += others * math.log(others / n / (1 - min(sum(parents.values()), 1 - 1e-9)))
            if shown and 2 * ratio >= (len(shown) + 1) * math.log(n):
                share = {w: (x - DISCOUNT) / n for w, x in shown.items()}
                new[context] = (1 - sum(share.values()), share)
        levels.append(new)
        retained.update(new)
        candidates = more
    out = []
    for i, t in rows:
        line = [None, *tokens(t)]
        score = sum(math.log10(p(tuple(line[max(0, j - depth) : j]), line[j], depth)) for j in range(1, len(line)))
        base = sum(math.log10(root(w)) for w in line[1:])
        out.append((i, len(line) - 1, sum(c[w] > 0 for w in line[1:]), round(base, 6), round(score, 6)))
    return sorted(out, key=repr), sum(map(len, levels))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += rng.choice([["to", "be", "or", "not"], ["new", "york"], [f"w{rng.randrange(300)}"], ["The"], ["be"]])
        rows.append((i, " ".join(words)))
    return rows


def result(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=repr)


def test_against_restatement(spark, docs_of):
    rows = corpus(1, 150)
    for depth, hot in ((3, 1e-6), (2, 0.002)):
        want, contexts = restated(rows, lambda i: i % 5, depth, 0.004, 0.002)
        got = scores(docs_of(rows), F.col("doc_id") % 5 != 0, depth=depth, hot_share=hot, context_share=0.004, follower_share=0.002)
        assert contexts > 3 and result(got) == want


def test_held_out_texts_gain(spark, docs_of):
    got = scores(docs_of(corpus(2, 300)), F.col("doc_id") % 10 != 0).where(~F.col("learn")).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.9 * got[1] and got[0] - got[1] > 100


def test_odd_rows(spark, docs_of, odd_rows):
    want, _ = restated(odd_rows, lambda i: i is not None, 0, 1, 1)
    got = scores(docs_of(odd_rows), F.col("doc_id").isNotNull())
    assert [r[:4] for r in result(got)] == [r[:4] for r in want]
    assert all(math.isfinite(r.score) for r in got.collect())
    untrained = scores(docs_of(odd_rows), F.lit(False)).collect()
    assert len(untrained) == len(odd_rows) and all(r.base_score == r.score == 0 and r.train_tokens == 0 for r in untrained)
    assert scores(docs_of([]), F.lit(True)).collect() == []


def test_model_grows_with_the_text(spark, docs_of):
    rows = corpus(3, 60) + [(100 + i, " ".join(f"r{j}" for j in range(i % 40, i % 40 + 3))) for i in range(400)]
    # Counted least values, whatever the share of the text: the restatement with the same counts.
    total = sum(len(tokens(t)) for _, t in rows)
    want, contexts = restated(rows, lambda i: True, 3, 8 / total, 2 / total)
    filler = [(9000, " ".join(f"f{j}" for j in range(600_000)))]
    few = scores(docs_of(rows), F.lit(True))
    assert contexts > 30 and result(few) == want
    assert result(scores(docs_of(rows), F.lit(True), hot_share=0.01, part_share=0.01)) == want  # nearly all parts joined
    total += 600_001
    want, many = restated(rows + filler, lambda i: True, 3, 8 / total, 2 / total)
    assert many >= contexts and result(scores(docs_of(rows + filler), F.lit(True))) == want


def test_tables_of_the_model_are_gone_when_scores_are_read(spark, tmp_path):
    spark.conf.set("linefold.scratch.dir", str(tmp_path))
    try:
        texts = [(i, " ".join(f"w{(i * 7 + j) % 5} r{i}-{j % 3}" for j in range(40))) for i in range(60)]
        docs = spark.createDataFrame(texts, "doc_id long, text string")
        found = scores(docs, F.col("doc_id") % 10 != 0)
        assert found.count() == 60
    finally:
        spark.conf.unset("linefold.scratch.dir")
    left = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert left.isdisjoint({"encoded", "words", "level", "retained"})


def test_a_level_is_gone_when_the_next_is_made(spark, docs_of, tmp_path, monkeypatch):
    seen, stage = [], suffix_tree.stage

    def spy(df, tag):
        out = stage(df, tag)
        seen.append((tag, [p.name.split("-")[0] for p in tmp_path.iterdir()]))
        return out

    monkeypatch.setattr(suffix_tree, "stage", spy)
    spark.conf.set("linefold.scratch.dir", str(tmp_path))
    try:
        scores(docs_of(corpus(5, 150)), F.col("doc_id") % 10 != 0)
    finally:
        spark.conf.unset("linefold.scratch.dir")
    assert sum(tag == "level" for tag, _ in seen) == 3
    assert all(there.count("level") <= 1 for tag, there in seen if tag != "level")
    last = next(there for tag, there in seen if tag == "scored")
    assert set(last) <= {"encoded", "found", "scored"}


def test_lookup_finds_what_a_search_finds():
    rng = np.random.default_rng(4)
    for low, high in ((-(2**63), 2**63 - 1), (2**56, 2**57), (2**63 - 10_000, 2**63 - 1), (-(2**63), 10_000 - 2**63)):
        for n in (0, 1, 2, 1000):
            ordered = np.unique(rng.integers(low, high, n))
            ends = np.array([-(2**63), -1, 0, 2**63 - 1])
            wanted = np.concatenate([ordered, rng.integers(low, high, 500), rng.integers(-(2**63), 2**63 - 1, 500), ends])
            places = {int(v): i for i, v in enumerate(ordered)}
            assert suffix_tree.Lookup(ordered).find(wanted).tolist() == [places.get(int(v), -1) for v in wanted]


def test_tokens_of_odd_texts():
    texts = [None, "", " \t\x0b\x0c\r\n", " A b\x0bÀ\x1cB\x85 b\xa0a ", "x" * 50, "a  b\u2028c"] * 3
    for split in (1, 60, 10_000):
        suffix_tree.SPLIT, before = split, suffix_tree.SPLIT
        try:
            found = list(suffix_tree.tokenized(pa.array(texts, pa.string())))
        finally:
            suffix_tree.SPLIT = before
        assert [s[0] for s in found] == [0, *(s[1] for s in found)][:-1] and found[-1][1] == len(texts)
        values = np.concatenate([v[p] for _, _, v, p, _ in found]).tolist()
        want = [[suffix_tree.xxh3_64_intdigest(w) for w in tokens(t)[:-1]] for t in texts]
        want = [[*np.array(w, np.uint64).view(np.int64).tolist(), int(suffix_tree.END)] for w in want]
        assert values == sum(want, []) and np.concatenate([s[4] for s in found]).tolist() == [len(w) for w in want]


def test_lookups_hold_little_beside_what_they_find():
    rng, n = np.random.default_rng(5), 1_000_000
    ordered, wanted = np.unique(rng.integers(-(2**63), 2**63 - 1, 1000)), rng.integers(-(2**63), 2**63 - 1, n)
    lookup, sieve = suffix_tree.Lookup(ordered), object.__new__(suffix_tree.Sieve)
    sieve.size, sieve.bits = 10, rng.integers(-(2**63), 2**63 - 1, 16)
    for call in (lambda: lookup.find(wanted), lambda: sieve.passes(wanted)):
        tracemalloc.start()
        try:
            call()
            assert tracemalloc.get_traced_memory()[1] < 20 * n
        finally:
            tracemalloc.stop()


def test_batches_are_bounded(spark, docs_of, tmp_path, monkeypatch):
    seen, stage = [], suffix_tree.stage

    def spy(df, tag):
        seen.append(df.sparkSession.conf.get(suffix_tree.BATCH_CONF))
        return stage(df, tag)

    monkeypatch.setattr(suffix_tree, "stage", spy)
    before = spark.conf.get(suffix_tree.BATCH_CONF, None)
    scores(docs_of(corpus(6, 60)), F.col("doc_id") % 10 != 0)
    assert set(seen) == {str(suffix_tree.BATCH_BYTES)} and spark.conf.get(suffix_tree.BATCH_CONF, None) == before
    rows = pa.record_batch({"a": pa.array([b"x" * 100_000] * 100, pa.binary())})
    found = list(suffix_tree.parted(rows))
    assert pa.Table.from_batches(found).equals(pa.Table.from_batches([rows]))
    assert len(found) > 1 and max(f.nbytes for f in found) <= suffix_tree.BATCH_BYTES
    assert list(suffix_tree.parted(rows.slice(0, 0))) == []
