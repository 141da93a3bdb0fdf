"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately, so K centroids each give K * K cells. A query walks the pairs of centroids by
summed squared distance with a heap until the cells hold ``share`` of all distinct vectors (and ``least`` at
least); all vectors of these cells are reranked by their exact distance.

Spark work: equal vectors become one entry with its k + 1 smallest ids (no other copy can be among the k nearest), so
a frequent vector is one row. Entries lie in blocks of neighbouring cells, at most about ``BLOCK`` rows; a cell beyond that is
split. Queries come in blocks too and only visit entry blocks that hold one of their cells. Each task has one pair of blocks,
the best of each query there go on to the final ranking.

``share`` is high because neighbours in high dimensions spread over many cells: recall is measured in the tests and
stated in the README. Codebooks are fitted on ``TRAIN`` distinct vectors, those with the smallest hashes; every vector is
indexed.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without an id, nor
vectors of another length than the most frequent one. Repeated rows count once; rows with a query's id are no candidates
of it. An id with several vectors is one query and one candidate, by the pair of vectors that lie nearest. Ties go to the
smaller id. Other columns aren't read.
"""

from __future__ import annotations

import heapq
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linefold.llm.store import stage

TRAIN, CENTROIDS, ROUNDS = 20_000, 64, 12
BLOCK, QUERY_BLOCK = 8192, 2048


def centroids(half: np.ndarray, many: int) -> np.ndarray:
    """Lloyd's algorithm from a fixed start."""
    many = min(many, len(half))
    at = half[np.random.default_rng(0).choice(len(half), many, replace=False)].copy()
    for _ in range(ROUNDS):
        owner = nearest(half, at)
        sums = np.zeros_like(at)
        np.add.at(sums, owner, half)
        sizes = np.bincount(owner, minlength=many)
        at = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], at)
    return at


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, up to ``tolerance``. Both sides are moved to the middle of ``b``: far from the origin the
    difference of the large norms would lose the digits of small distances."""
    middle = b.mean(0)
    a, b = a - middle, b - middle
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def tolerance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bound of the rounding of ``squared`` for each row of ``a``, by the norms after the move."""
    middle = b.mean(0)
    norms = ((a - middle) ** 2).sum(1) + ((b - middle) ** 2).sum(1).max()
    return 8 * (a.shape[1] + 8) * np.finfo(np.float64).eps * norms


def nearest(a: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return squared(a, centres).argmin(1)


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells by rising ``first[i] + second[j]`` until they hold ``wanted`` vectors."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    heap, seen, cells, held = [(a[0] + b[0], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(rows[i]) * len(b) + int(columns[j])
        if sizes[cell]:
            cells.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return cells


def matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v) of the distinct rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v")).where("id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = stage(rows.where((F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0)).distinct(), "vectors")
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (lengths.n if lengths else 0))


def entries_of(rows: DataFrame, k: int) -> DataFrame:
    """(v, ids): distinct vectors and their k + 1 smallest ids."""
    low = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("at", F.row_number().over(low)).where(F.col("at") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, share: float = 0.65, least: int | None = None,
    id_column: str = "vec_id", vector_column: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` nearest found of each row that ``is_query`` (on ``id``) holds for.

    Cells are visited until they hold ``share`` of the distinct vectors and ``least`` of them (4 * ``k`` if not given)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_column, vector_column)
    entries = stage(entries_of(rows, k), "entries")
    train = entries.select("v").orderBy(F.xxhash64("v"), "v").limit(TRAIN).toArrow().column("v")
    result = f"query_id long, rank int, `{id_column}` long, score double"
    if not len(train):
        return spark.createDataFrame([], result)
    train = matrix(train)
    half = max(1, train.shape[1] // 2)
    many = max(1, min(CENTROIDS, int(len(train) ** 0.5) // 2))
    books = centroids(train[:, :half], many), centroids(train[:, half:], many)
    across = len(books[1])
    shared = spark.sparkContext.broadcast(books)

    def to_cells(batches):
        one, two = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(0))
            cell = nearest(v[:, :half], one) * across + nearest(v[:, half:], two)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], ["v", "ids", "cell"])

    v_type = entries.schema["v"].dataType.simpleString()
    celled = stage(entries.mapInArrow(to_cells, f"v {v_type}, ids array<long>, cell int"), "cells")
    sizes = np.zeros(len(books[0]) * across, np.int64)
    for row in celled.groupBy("cell").count().collect():  # at most CENTROIDS^2 rows
        sizes[row.cell] = row["count"]
    places = blocks(sizes)
    wanted = max(4 * k if least is None else least, int(np.ceil(share * sizes.sum())))
    queries = rows.where(is_query)
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    plan = spark.sparkContext.broadcast((books, sizes, places, wanted))

    def to_visits(batches):
        (one, two), sizes, places, wanted = plan.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(1))
            first, second = squared(v[:, :half], one), squared(v[:, half:], two)
            at, visits, marks = [], [], []
            for i in range(len(v)):
                cells = walk(first[i], second[i], sizes, wanted)
                bits = np.zeros(len(sizes), np.uint8)
                bits[cells] = 1
                mark = np.packbits(bits).tobytes()
                visited = {b for c in cells for b in range(places[c][0], places[c][0] + places[c][1])}
                at += [i] * len(visited)
                visits += sorted(visited)
                marks += [mark] * len(visited)
            taken = batch.take(pa.array(at, pa.int64()))
            columns = [taken.column(0), taken.column(1), pa.array(visits, pa.int32()), pa.array(marks, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "q", "block", "cells"])

    visits = queries.select("id", "v").mapInArrow(to_visits, f"query_id long, q {v_type}, block int, cells binary")
    visits = visits.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    base = spark.createDataFrame([(c, *places[c]) for c in places], "cell int, base int, split int")
    placed = celled.join(F.broadcast(base), "cell").select(
        "v", "ids", "cell", (F.col("base") + F.pmod(F.xxhash64("v"), F.col("split"))).cast("int").alias("block")
    )
    placed = placed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def best(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        return best_of(entry, query, k)

    pairs = placed.groupBy("block", "part").cogroup(visits.groupBy("block", "part"))
    found = pairs.applyInPandas(best, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "id")
    found = found.repartition("query_id").groupBy("query_id", "id").agg(F.min("score").alias("score"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_column), "score")


def blocks(sizes: np.ndarray) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of every cell in use; neighbouring cells share a block."""
    out, block, held = {}, 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        size = int(sizes[cell])
        split = max(1, -(-size // BLOCK))
        if held and held + size > BLOCK:
            block, held = block + 1, 0
        out[cell] = (block, split)
        held += size
        if split > 1:
            block, held = block + split, 0
    return out


def best_of(entry: pd.DataFrame, query: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest (id, score) of each query among the entries in its cells, ties to smaller ids."""
    out: list[tuple[int, int, float]] = []
    if len(entry) and len(query):
        vectors = np.array(entry["v"].tolist(), dtype=np.float64)
        cells, ids = entry["cell"].to_numpy(), entry["ids"].tolist()
        asked = np.array(query["q"].tolist(), dtype=np.float64)
        again = len({x for some in ids for x in some}) < sum(map(len, ids))  # an id has several vectors here
        for start in range(0, len(asked), 256):
            rough = squared(asked[start : start + 256], vectors)
            slack = tolerance(asked[start : start + 256], vectors)
            for i, row in enumerate(rough, start):
                inside = np.unpackbits(np.frombuffer(query["cells"].iloc[i], np.uint8))[cells] > 0
                at = np.flatnonzero(inside)
                if len(at) > k + 1 and not again:
                    edge = np.partition(row[at], k)[k]
                    at = at[~(row[at] > edge + 2 * slack[i - start])]
                exact = np.sqrt(((vectors[at] - asked[i]) ** 2).sum(1))
                own = int(query["query_id"].iloc[i])
                near = sorted((float(d), int(x)) for a, d in zip(at, exact, strict=True) for x in ids[a] if x != own)
                best: dict[int, float] = {}
                for d, x in near:
                    best.setdefault(x, d)
                out += [(own, x, best[x]) for x in islice(best, k)]
    return pd.DataFrame(out, columns=["query_id", "id", "score"]).astype({"query_id": "int64", "id": "int64", "score": "float64"})
