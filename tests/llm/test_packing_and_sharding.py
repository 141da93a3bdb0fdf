"""Length buckets against exhaustive search, batches, and the lookup table."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from linefold.llm import packing
from linefold.llm.packing import Cell, choose_lengths, histogram, pack
from linefold.llm.sharding import fill, place
from pyspark.sql import functions as F


def padding(lengths, bounds):
    return sum(min(b for b in bounds if b >= x) - x for x in lengths)


def test_least_padding_of_all_choices():
    rng = random.Random(0)
    for _ in range(60):
        lengths = [rng.randint(0, 30) for _ in range(rng.randint(1, 25))]
        cells = [Cell(x, n, x * n) for x, n in sorted(Counter(lengths).items())]
        for buckets in (1, 2, 3, 4):
            distinct = sorted(set(lengths))
            best = min(
                padding(lengths, [*c, distinct[-1]]) for k in range(min(buckets, len(distinct))) for c in itertools.combinations(distinct, k)
            )
            found = choose_lengths(cells, buckets)
            assert len(found) <= buckets and padding(lengths, found) == best


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 50)
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1, 5, 30, 200, 201, 5000, 70000]), "x") for i in range(600)] + [(None, None, "y"), (7, 5, "x"), (7, 5, "x")]
    table = spark.createDataFrame(rows, "doc_id long, n_tokens long, padding string")
    got = pack(table, "n_tokens", buckets=4, budget=1000).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == sorted((r[:2] for r in rows), key=repr)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch_id].append(r)
    for batch in batches.values():
        length = batch[0].bucket_length
        assert all(r.bucket_length == length >= (r.n_tokens or 0) and r.padding == length - (r.n_tokens or 0) for r in batch)
        assert len(batch) == 1 or len(batch) * length <= 1000 or length == 0
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
    lengths = [r[1] or 0 for r in rows]
    assert sum(r.padding for r in got) == padding(lengths, choose_lengths([Cell(x, n, x * n) for x, n in sorted(Counter(lengths).items())], 4))
    assert pack(table.limit(0), "n_tokens").collect() == []


def test_cells_of_long_rows_are_bounded(spark):
    table = spark.range(200_000).select((F.col("id") * 7).alias("length"))
    cells = histogram(table)
    assert sum(c.rows for c in cells) == 200_000 and sum(c.tokens for c in cells) == 7 * 199_999 * 100_000
    assert len(cells) < 4096 // 7 + 2048 * 9 and cells[-1].longest == 7 * 199_999


def brute_fill(shards, size):
    from linefold.llm.sharding import preference

    order = {s: [(o + i * k) % size for i in range(size)] for s in shards for o, k in [preference(s, size)]}
    table, turn = {}, 0
    while len(table) < size:
        shard = sorted(shards)[turn % len(shards)]
        table[next(x for x in order[shard] if x not in table)] = shard
        turn += 1
    return [table[i] for i in range(size)]


def test_table_against_turns():
    for shards, size in ((["a", "b", "c"], 13), (["s1"], 7), ([f"n{i}" for i in (3, 1, 4, 9, 5)], 101)):
        assert [shards[i] for i in fill(shards, size)] == brute_fill(shards, size)


def test_even_and_stable():
    shards = [f"shard-{i}" for i in range(10)]
    table = fill(shards)
    sizes = Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = fill(shards[:-1])
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 9)
    assert moved < 0.1 * len(table)
    for wrong in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            fill(wrong)
    with pytest.raises(ValueError):
        fill(["a"], 12)


def test_placement(spark, docs_of, odd_rows):
    shards = ["a", "b", "c"]
    table = fill(shards, 101)
    got = place(docs_of(odd_rows + [(i, "t") for i in range(100, 400)]), "doc_id", shards, 101)
    assert got.columns.count("slot") == 1 and got.columns.count("shard") == 1
    rows = got.collect()
    assert len(rows) == len(odd_rows) + 300
    assert all(r.shard == shards[table[r.slot]] for r in rows)
    assert len({r.slot for r in rows if r.doc_id == 1}) == 1
    nulls = place(docs_of([(None, f"t{i}") for i in range(60)]), "doc_id", shards, 101)
    assert nulls.select("shard").distinct().count() == 3
    assert place(docs_of([]), "doc_id", shards).collect() == []
