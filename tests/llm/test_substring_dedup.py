"""Repeated spans against a brute-force dictionary of windows."""

import random

from linefold.llm import substring_dedup
from linefold.llm.substring_dedup import SuffixAutomaton, remove_repeats


def expected(rows, width):
    low = {}
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for p in range(len(w) - width + 1):
            gram = tuple(w[p : p + width])
            if i is not None:
                low[gram] = min(low.get(gram, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - width + 1):
            if i is not None and low[tuple(w[p : p + width])] < i:
                gone |= set(range(p, p + width))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=repr)


def shared_passages(seed):
    rng = random.Random(seed)
    passages = [[f"p{k}.{i}" for i in range(rng.randint(8, 40))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.5 else [f"n{rng.randrange(40)}" for _ in range(20)]
        rows.append((i, " ".join(words)))
    rng.shuffle(rows)
    return rows


def test_removed_words(spark, docs_of):
    rows = shared_passages(3)
    assert result(remove_repeats(docs_of(rows))) == expected(rows, 13)


def test_small_pieces_shards_and_tasks(spark, docs_of, monkeypatch):
    for name, value in (("PIECE", 8), ("SHARD_WORDS", 50), ("STREAM_WORDS", 40)):
        monkeypatch.setattr(substring_dedup, name, value)
    rows = shared_passages(4)
    assert result(remove_repeats(docs_of(rows), width=6)) == expected(rows, 6)


def test_odd_rows(spark, docs_of, odd_rows):
    rows = odd_rows + [(8, "x y " * 20), (9, "x y " * 20), (None, "x y " * 20)]
    assert result(remove_repeats(docs_of(rows))) == expected(rows, 13)
    assert remove_repeats(docs_of([])).collect() == []


def test_automaton_knows_the_smallest_document():
    automaton = SuffixAutomaton()
    automaton.add("a b c d".split(), 3)
    automaton.add("x b c d e".split(), 5)
    assert automaton.ends("z b c d e".split(), 4, 3) == [3]
    assert automaton.ends("z b c d e".split(), 6, 3) == [3, 4]
    assert automaton.ends("z b c d e".split(), 3, 3) == []
