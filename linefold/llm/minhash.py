"""Near duplicates by tensored minhash banding.

``SIDES`` smaller collections of ``TABLES`` short keys (``ROWS`` minhashes each) are computed per document; the keys of
the TABLES x TABLES hash tables are all pairs of a key of the first and one of the second collection. That takes
SIDES * TABLES * ROWS minhashes where separate tables would take TABLES^2 * SIDES * ROWS.

1. Documents with equal shingle sets form a class, its smallest id stands for it (aggregation, no pairs).
2. Short keys that only one class has can't lead to a bucket and go; the rest are paired into buckets. Shingles are counted over the
   classes in buckets: one of which less than ``percent`` % is found in others has no link.
3. Each class proposes one link, to the smallest class of all its buckets; links are confirmed on the full sets and
   joined to components.
4. Buckets that still hold several components: all their members are compared with the bucket's smallest class.
5. What is left of a bucket then: pairs of two classes of different components. A pair is passed over only if it is ruled out
   exactly, by the most that two sets can have in common inside and outside of the bucket's smallest class.

So every pair that meets in a bucket is confirmed on full sets, is ruled out exactly, or already is in one component;
no bucket is capped. A group of n near copies costs about n comparisons.

Missing a pair of similarity s: 2 (1 - s^ROWS)^TABLES; at s = 0.8 that is under 4 in 10,000, at 0.85 under 3 in 100,000.

Results: one row per input row: id, ``n_shingles``, ``component_id``, ``kept``. Null and empty texts have no shingles, are
linked with nothing and are their own component. Fewer words than a shingle: the whole sequence is the only shingle.
Rows without an id take part in nothing: ``component_id`` null, ``kept`` true. Rows that repeat an id are
one document that each of their texts may link. Other columns aren't read.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from linefold.llm.components import components, merged
from linefold.llm.store import stage

TABLES, ROWS, SIDES = 12, 3, 2
REMEMBERED_SETS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit values (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit values of the word shingles; words are cut at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, len(words[:width]), np.uint64)
    for i in range(min(width, len(words))):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[i : i + n])
    return np.unique(out)


def hash_params(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of ``count`` hash functions."""
    seeds = mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:count] | np.uint64(1), seeds[count:]


def short_keys(values: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The SIDES * TABLES short keys of a set: side by side, ROWS minhashes mixed into each."""
    lows = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 1024):
        block = values[None, start : start + 1024] * factors[:, None] + offsets[:, None]
        block ^= block >> np.uint64(29)
        block *= np.uint64(0xBF58476D1CE4E5B9)
        lows = np.minimum(lows, block.min(axis=1))
    lows = lows.reshape(SIDES * TABLES, ROWS)
    keys = np.arange(1, SIDES * TABLES + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + lows[:, i])
    return keys.view(np.int64)


def sketches(docs: DataFrame, width: int, with_keys: bool = True) -> DataFrame:
    """(id, n, same, keys): set size, a 128-bit value of the whole set, and the short keys."""

    def run(batches):
        factors, offsets = hash_params(SIDES * TABLES * ROWS)
        for batch in batches:
            sizes, same, keys = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                same.append(xxh3_128_digest(found.tobytes()))
                keys.append(short_keys(found, factors, offsets) if len(found) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "same", "keys"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, same binary, keys array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """(id, bucket) of the tensored tables that two or more classes share."""
    sided = classes.select("id", F.posexplode("keys").alias("at", "key"))
    shared = sided.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    some = sided.join(shared.select("key"), "key")
    first = F.array_sort(F.collect_list(F.when(F.col("at") < TABLES, F.col("key"))))
    second = F.array_sort(F.collect_list(F.when(F.col("at") >= TABLES, F.col("key"))))
    each = some.groupBy("id").agg(first.alias("first"), second.alias("second"))
    pairs = each.select("id", F.explode("first").alias("a"), "second").select("id", "a", F.explode("second").alias("b"))
    return pairs.select("id", F.xxhash64("a", "b").alias("bucket"))


def confirmed(texts: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs(a, b)`` with the size of the intersection of the full sets, ``common``, and whether they are ``linked``."""

    def run(batches):
        known: OrderedDict[str, np.ndarray] = OrderedDict()

        def of(text: str) -> np.ndarray:
            if text not in known:
                known[text] = shingles(text, width)
                if len(known) > REMEMBERED_SETS:
                    known.popitem(last=False)
            return known[text]

        for batch in batches:
            common, linked = [], []
            for text_a, text_b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = of(text_a.as_py()), of(text_b.as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - both
                common.append(both)
                linked.append(0 < both and 100 * both >= percent * either)
            columns = [batch.column(0), batch.column(1), pa.array(common, pa.int64()), pa.array(linked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "common", "linked"])

    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    rows = rows.select("a", "b", "text_a", "text_b")
    found = rows.mapInArrow(run, "a long, b long, common long, linked boolean")
    return found.groupBy("a", "b").agg(F.max("common").alias("common"), F.max("linked").alias("linked"))


def with_component(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component, with their component ``c``."""
    named = members.join(labels, "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
    split = named.groupBy("bucket").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("bucket")
    return named.join(split, "bucket")


def shared_sizes(texts: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(id, shared): how many shingles of each class some other class has too, null for an id with several texts.

    Shingles are counted over all ``texts(id, text)``.
    """

    def run(batches):
        for batch in batches:
            found = [shingles(t.as_py(), width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], ["id", "shingles"])

    sets = texts.select("id", "text").mapInArrow(run, "id long, shingles array<long>")
    counted = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle")
    own = counted.agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    sizes = classes.groupBy("id").agg(F.max("n").alias("n"))
    # an id's texts, of its own class or not, are counted together
    several = texts.groupBy("id").agg((F.min(F.xxhash64("text")) < F.max(F.xxhash64("text"))).alias("several"))
    shared = F.when(~F.col("several"), F.col("n") - F.coalesce("own", F.lit(0)))
    return sizes.join(several, "id").join(own, "id", "left").select("id", shared.alias("shared"))


def crossing_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(a, b) of ``left(bucket, id, c, n, shared, common, keys)`` to compare: members of a bucket in different components that could be
    linked; each pair in one bucket only.

    Inside the bucket's smallest class two sets have at most the smaller of what each has in common with it; outside,
    at most the smaller of what else each shares with any class.
    """
    right = left.select("bucket", *(F.col(x).alias(f"{x}_b") for x in ("id", "c", "n", "shared", "common", "keys")))
    outside = F.least(F.col("shared") - F.col("common"), F.col("shared_b") - F.col("common_b"))
    most = F.least("common", "common_b") + outside
    possible = 100 * most >= percent * (F.col("n") + F.col("n_b") - most)
    known = F.col("shared").isNotNull() & F.col("shared_b").isNotNull()

    def first_common(start: int) -> Column:
        both = F.array_intersect(F.slice("keys", start, TABLES), F.slice("keys_b", start, TABLES))
        return F.array_min(both)

    first = F.col("bucket") == F.xxhash64(first_common(1), first_common(TABLES + 1))
    pairs = left.join(right, "bucket").where((F.col("id") > F.col("id_b")) & (F.col("c") != F.col("c_b")) & (~known | possible) & first)
    return pairs.select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()


def links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """(id, component) of the classes that are linked with another one."""
    met = stage(buckets(classes), "met")
    texts = stage(docs.join(met.select("id").distinct(), "id", "left_semi"), "texts")
    shared = stage(shared_sizes(texts, classes, width), "shared")
    # a class of which too little is shared has no link at all
    able = classes.select("id", "n").join(shared, "id").where(F.coalesce(100 * F.col("shared") >= percent * F.col("n"), F.lit(True)))
    members = stage(met.join(able.select("id").distinct(), "id", "left_semi"), "members")
    lows = members.groupBy("bucket").agg(F.min("id").alias("low"))

    proposed = members.join(lows, "bucket").groupBy("id").agg(F.min("low").alias("b")).where("b < id")
    known = stage(confirmed(texts, proposed.withColumnRenamed("id", "a"), width, percent), "links")
    labels = stage(components(known.where("linked").select("a", "b")), "labels")

    held = stage(with_component(members, labels).drop("c"), "held")
    if held.isEmpty():
        return labels
    to_low = held.join(lows, "bucket").where("low < id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    more = stage(confirmed(texts, to_low.distinct().join(known, ["a", "b"], "left_anti"), width, percent), "links")
    labels = merged(labels, more.where("linked"))

    common = known.unionByName(more).select(F.col("a").alias("id"), F.col("b").alias("low"), "common")
    left = with_component(held, labels).join(lows, "bucket").join(common, ["id", "low"]).drop("low")
    left = left.join(classes.select("id", "n", "keys"), "id").join(shared, "id")
    pairs = stage(crossing_pairs(left, percent), "pairs")
    if pairs.isEmpty():
        return labels
    return merged(labels, confirmed(texts, pairs, width, percent).where("linked"))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Components of documents whose sets of ``width``-word shingles have ``percent`` % or more in common."""
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = stage(sketches(docs, width), "sketches")
    full = rows.where("id is not null and n > 0")
    classes = full.groupBy("same").agg(F.min("id").alias("class"), F.first("keys").alias("keys"), F.first("n").alias("n"))
    classes = stage(classes, "classes")
    # an id whose texts are several smallest ones is one class with the keys of each
    single = classes.select(F.col("class").alias("id"), "keys", "n").dropDuplicates(["id", "keys"])
    labels = links(docs.where("id is not null"), single, width, percent)
    named = rows.select("id", "n", "same").join(classes.select("same", "class"), "same", "left")
    own = F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class")
    named = stage(named.select("id", F.col("n").alias("n_shingles"), own), "named")
    several = named.groupBy("id").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    if not several.isEmpty():  # ids with texts of several classes link these
        across = named.join(several, "id").select(F.col("class").alias("a"), F.col("low").alias("b"))
        labels = merged(labels, across.distinct())
    labels = labels.select(F.col("id").alias("class"), "component")
    component = F.coalesce("component", "class")
    return named.join(labels, "class", "left").select(
        F.col("id").alias(id_column), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
