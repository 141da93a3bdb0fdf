"""Nearest neighbours against brute force, recall, and vectors that take no part."""

import numpy as np
import pytest
from linefold.llm import multi_index
from linefold.llm.multi_index import blocks, search, walk
from pyspark.sql import functions as F


def brute(rows, queries, k):
    out = {}
    for q in queries:
        own = rows[q]
        near = sorted((float(np.sqrt(((np.array(v, float) - np.array(own, float)) ** 2).sum())), i) for i, v in rows.items() if i != q)
        out[q] = [(i, d) for d, i in near[:k]]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, v string")


def test_whole_share_is_exact_and_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(0)
    rows = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(300)}
    rows = {i: v if any(v) else [1.0, 0, 0, 0] for i, v in rows.items()}
    got = result(search(table(spark, rows.items()), F.col("id") % 20 == 0, share=1.0))
    assert got == brute(rows, range(0, 300, 20), 10)


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 150)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(10, 64))
    rows = {i: (centres[i % 10] * 0.3 + rng.normal(size=64)).astype(np.float32).tolist() for i in range(3000)}
    same = rows[5]
    rows |= {i: same for i in range(1000, 1900)}
    queries = [i for i in rows if i % 100 == 0]
    got, want = result(search(table(spark, rows.items()), F.col("id") % 100 == 0, least=100)), brute(rows, queries, 10)
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    assert got[1000] == [(i, 0.0) for i in [5, *range(1001, 1010)]]


def test_small_tables_go_through_the_index(spark, monkeypatch):
    held = []
    monkeypatch.setattr(multi_index, "blocks", lambda sizes: held.append(sizes) or blocks(sizes))
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(size=8).tolist() for i in range(400)}
    got, want = result(search(table(spark, rows.items()), F.col("id") % 5 == 0)), brute(rows, range(0, 400, 5), 10)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 10 for q in want])
    assert 0.9 <= recall < 1
    assert (held[0] > 0).sum() > 50


def test_small_distances_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    rows = {i: (10_000 + 0.01 * rng.normal(size=64)).tolist() for i in range(600)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    assert result(search(df, F.col("id") % 20 == 0, share=1.0)) == brute(rows, range(0, 600, 20), 10)


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(1, 9, 3).astype(float).tolist()) for i in rng.integers(0, 60, 300)]
    want = {}
    for q in {i for i, _ in rows if i % 10 == 0}:
        near = {}
        for own in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    d = float(np.sqrt(((np.array(v) - np.array(own)) ** 2).sum()))
                    near[i] = min(d, near.get(i, d))
        want[q] = [(i, d) for d, i in sorted((d, i) for i, d in near.items())[:10]]
    assert result(search(table(spark, rows), F.col("id") % 10 == 0, share=1.0)) == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]),
            (7, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    got = result(search(table(spark, rows), F.col("id") >= 0))
    assert got == {0: [(7, 1.0)], 7: [(0, 1.0)]}
    assert search(table(spark, [(1, None)]), F.lit(True)).collect() == []
    assert search(table(spark, []), F.lit(True)).collect() == []


def test_walk_is_in_order_of_the_sums():
    rng = np.random.default_rng(2)
    first, second = rng.random(6), rng.random(5)
    cells = walk(first, second, np.ones(30, int), 30)
    sums = [first[c // 5] + second[c % 5] for c in cells]
    assert sums == pytest.approx(sorted((first[:, None] + second).ravel()))
    assert walk(first, second, np.ones(30, int), 4) == cells[:4]


def test_blocks_hold_all_cells(monkeypatch):
    monkeypatch.setattr(multi_index, "BLOCK", 10)
    places = blocks(np.array([3, 0, 4, 35, 2, 9]))
    assert places == {0: (0, 1), 2: (0, 1), 3: (1, 4), 4: (5, 1), 5: (6, 1)}
