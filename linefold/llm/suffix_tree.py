"""Language-model scores from a probabilistic suffix tree.

Training counts words and, level by level, what follows a context. A context of k words is a candidate if it occurs
``least_context`` times; it is retained if what follows it diverges from what follows its suffix (likelihood ratio against
the number of distinct followers times the log of its count). Followers that occur ``least_follower`` times are explicit.
Contexts, followers and words are Spark tables of any size, so the model grows with the text.

Smoothing: P(s | context) = (n - DISCOUNT) / c + rest * P(s | suffix), down to the root
P(s) = (n + ALPHA) / (N + ALPHA (V + 1)). Every position is scored at its longest retained suffix. Its log10 is a sum: that
of the root, of the rest of every retained context, and, for an explicit follower, of P(s | context) / (rest * P(s | suffix)).
So every part is looked up by itself, a level at a time, and a level's tables go when the next one has been made from them.
Parts with ``part_share`` of all tokens are broadcast, all others are joined.

What is counted or looked up travels as arrays: a task sorts some ``HELD`` tokens, sums what is alike and deals it to buckets by the
leading bits of its code. Buckets are as many as the text asks for, one for ``HELD`` tokens, or for some four times as many in lookups;
a bucket's arrays meet the table's rows of that bucket.

Positions whose context is surely no candidate, or whose part surely isn't in a table, are left out early by a ``Sieve``: a
bit array of bounded size. What it lets through is compared with the tables themselves, so results don't depend on it.

The root holds every word. Words with ``hot_share`` of all tokens (at most 1 / hot_share) are broadcast; occurrences of
all others are joined with their counts.

Words and contexts are told apart by 64-bit hashes. A text ends with one end token, and starts after one; null and empty texts have only
the end. Every row gives a row, repeated rows and ids too; a null id counts as empty text. Without training rows
every root probability is 1. Columns of the input other than id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from linefold.llm.store import drop, shared, small, stage

ALPHA, DISCOUNT = 0.1, 0.5
#: Tokens that a task works on at a time.
HELD = 1_000_000
#: The end token: a value of something that is no word.
END = np.uint64(xxh3_64_intdigest(b" end ")).view(np.int64)
#: Tells followers from contexts of the same words.
FOLLOWER = 0x5DEECE66D1234567
#: A sieve has 16 bits a code, up to 2^SIEVE_BITS. Tasks exchange it in segments of so many numbers of 64 bits.
SIEVE_BITS, SEGMENT = 27, 1 << 13
#: Values that are looked up at a time.
BLOCK = 1 << 16
#: Bytes of text that are split at a time.
SPLIT = 8_000_000
#: Spark settings: delete the shuffle files of a query at its end; bytes of a batch that tasks get.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22


def tokenized(texts: pa.Array):
    """Slices of the texts: where they start and stop, values of the distinct tokens, the place of each token among them, tokens per text.

    Words are cut at ASCII white space, A-Z lower-cased; every text ends with the end token.
    """
    bounds = np.append(0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)))
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + SPLIT, "right")) - 1)
        words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts[start:stop], "")))
        found = words.flatten().dictionary_encode()
        distinct = found.dictionary.cast(pa.binary()).to_pylist()
        place = found.indices.to_numpy()
        # white space at either end of a text leaves an empty word
        real = place != (distinct.index(b"") if b"" in distinct else -1)
        sizes = np.add.reduceat(real, words.offsets.to_numpy()[:-1], dtype=np.int64) + 1
        places = np.full(int(sizes.sum()), len(distinct), np.int64)
        word = np.ones(len(places), bool)
        word[np.cumsum(sizes) - 1] = False
        places[word] = place[real]
        values = np.fromiter(map(xxh3_64_intdigest, distinct), np.uint64, len(distinct)).view(np.int64)
        yield start, stop, np.append(values, END), places, sizes
        start = stop


def written(df: DataFrame, tag: str) -> DataFrame:
    """A staged table, without the shuffle files that it was made from. Its tasks get rows in batches of bounded size."""
    conf = df.sparkSession.conf
    own = {CLEANUP: "true", BATCH_CONF: str(BATCH_BYTES)}
    before = {name: conf.get(name, None) for name in own}
    for name, value in own.items():
        conf.set(name, value)
    try:
        return stage(df, tag)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


class Lookup:
    """Finds values in an ordered array of hashes: each stands at the slot its place in their range names, or at the next free one."""

    def __init__(self, ordered: np.ndarray) -> None:
        span = int(ordered[-1]) - int(ordered[0]) if len(ordered) else 0
        self.shift = max(0, span.bit_length() - (2 * len(ordered)).bit_length())
        self.low = ordered[0] >> self.shift if len(ordered) else 0
        at = np.arange(len(ordered))
        slot = np.maximum.accumulate((ordered >> self.shift) - self.low - at) + at
        size = int(slot[-1]) + 2 if len(slot) else 1
        self.keys, self.places = np.zeros(size, np.int64), np.full(size, -1, np.int32)
        self.keys[slot], self.places[slot] = ordered, at

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the values, -1 for others."""
        return np.concatenate([np.zeros(0, np.int32), *(self.found(wanted[i : i + BLOCK]) for i in range(0, len(wanted), BLOCK))])

    def found(self, wanted: np.ndarray) -> np.ndarray:
        out, left = np.full(len(wanted), -1, np.int32), np.arange(len(wanted))
        slot = np.clip(wanted >> self.shift, self.low, self.low + len(self.keys) - 1) - self.low
        while len(left):
            place, key = self.places[slot], self.keys[slot]
            hit = (key == wanted) & (place >= 0)
            out[left[hit]] = place[hit]
            more = np.flatnonzero((place >= 0) & (key < wanted))
            left, slot, wanted = left[more], slot[more] + 1, wanted[more]
        return out


def alike(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the codes, and where in it each distinct one starts."""
    order = np.argsort(codes)
    codes = codes[order]
    return order, np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])


def chained(codes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Codes of the contexts that end with one word more."""
    x = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x += words.view(np.uint64)
    for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(32)
    return x.view(np.int64)


def context(values: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the contexts of one length before each position, and where there is one. ``first``: where texts start."""
    before = np.empty_like(values)
    before[1:] = values[:-1]
    before[first] = END
    at = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    there = at >= length - 1
    del at
    codes = before
    for _ in range(length - 1):
        longer = np.zeros_like(codes)
        longer[1:] = chained(codes[:-1], values[:-1])
        codes = longer
    return codes, there


@dataclass
class Root:
    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def logs(self) -> np.ndarray:
        """log10 of the probabilities of the hot words, and at the end that of an unknown one."""
        return np.log10((np.append(self.counts, 0) + ALPHA) / (self.total + ALPHA * (self.distinct + 1)))

    def bits(self) -> int:
        """Leading bits of a code that name its bucket."""
        return max(1, (self.total // HELD).bit_length())


class Sieve:
    """Bits of codes, two each. It lets every code of its table through, and few others as long as it isn't full."""

    def __init__(self, table: DataFrame) -> None:
        self.size = size = min(SIEVE_BITS, max(10, (16 * table.count()).bit_length()))
        length = 1 << size - 6

        def run(batches):
            bits = np.zeros(length, np.int64)
            for batch in batches:
                for place in Sieve.places(batch.column(0).to_numpy(), size):
                    np.bitwise_or.at(bits, place >> 6, 1 << (place & 63))
            for segment, start in enumerate(range(0, length, SEGMENT)):
                if (own := bits[start : start + SEGMENT]).any():
                    yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([own.tobytes()], pa.binary())], ["segment", "bits"])

        def joined(segment: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(b, np.int64) for b in segment.column("bits").to_pylist()])
            return pa.table({"segment": segment.column("segment")[:1], "bits": pa.array([bits.tobytes()], pa.binary())})

        kind = "segment long, bits binary"
        found = table.select("code").mapInArrow(run, kind).groupBy("segment").applyInArrow(joined, kind).toArrow()
        self.bits = np.zeros(length, np.int64)
        for segment, bits in zip(*(found.column(c).to_pylist() for c in ("segment", "bits"))):
            own = np.frombuffer(bits, np.int64)
            self.bits[segment * SEGMENT : segment * SEGMENT + len(own)] = own

    @staticmethod
    def places(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        most = (1 << size) - 1
        return codes & most, (codes.view(np.uint64) >> np.uint64(SIEVE_BITS)).view(np.int64) & most

    def passes(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones(len(codes), bool)
        for start in range(0, len(codes), BLOCK):
            for place in Sieve.places(codes[start : start + BLOCK], self.size):
                out[start : start + BLOCK] &= (self.bits[place >> 6] >> (place & 63)) & 1 == 1
        return out


def flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and where its rows start."""
    column = batch.column(batch.schema.get_field_index(name))
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    return values, (offsets - offsets[0])[:-1]


def slices(offsets: np.ndarray):
    """Where to cut rows whose values have these offsets, so that about ``HELD`` values are together, at least a row each."""
    start = 0
    while start < len(offsets) - 1:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + HELD, "right")) - 1)
        yield start, stop
        start = stop


def pieces(batch: pa.RecordBatch, name: str):
    """The batch in slices by the values of a list column."""
    for start, stop in slices(batch.column(batch.schema.get_field_index(name)).offsets.to_numpy()):
        yield batch.slice(start, stop - start)


def dealt(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of ordered buckets and offsets of their lists."""
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])[: len(buckets)])
    return buckets[starts], np.append(starts, len(buckets)).astype(np.int32)


def blobs(offsets: np.ndarray, *values: np.ndarray) -> list[pa.Array]:
    """Lists of numbers as binary values, which Spark moves as they are."""
    return [
        pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * v.itemsize).astype(np.int32)), pa.py_buffer(v)])
        for v in map(np.ascontiguousarray, values)
    ]


def parted(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``BATCH_BYTES``, at least a row each."""
    step = max(1, rows.num_rows * BATCH_BYTES // max(1, rows.nbytes))
    for start in range(0, rows.num_rows, step):
        yield rows.slice(start, step)


def unpacked(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a binary column, one row after the other, and how many each row has."""
    column = table.column(name)
    values = [np.frombuffer(x.as_buffer(), kind) for x in column if x.is_valid]
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy() // np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *values]), sizes


def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(code, n) of several counts."""
    codes, n = map(np.concatenate, zip(*held))
    order, starts = alike(codes)
    return pa.RecordBatch.from_arrays([pa.array(codes[order][starts]), pa.array(np.add.reduceat(n[order], starts))], ["code", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all texts, ends included."""

    def run(batches):
        held, many = [], 0
        for batch in batches:
            for _, _, values, places, _ in tokenized(batch.column(0)):
                n = np.bincount(places, minlength=len(values))
                held.append((values[n > 0], n[n > 0]))
                many += len(values)
                if many >= HELD:
                    yield merged(held)
                    held, many = [], 0
        if held:
            yield merged(held)

    found = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    return written(found.withColumnRenamed("code", "word"), "words")


def encoded(docs: DataFrame, root: Root) -> DataFrame:
    """(row, id, learn, n_tokens, hot, base, ids, cold): places of the hot words or -1, and the values of the others.

    ``hot`` counts hot words, and ``base`` is the root's log10, with all others as unknown. The texts are read once more.
    """
    held = shared(docs.sparkSession, root)

    def run(batches):
        root = held()
        words, logs = Lookup(root.words), root.logs()
        for batch in batches:
            for start, stop, values, places, sizes in tokenized(batch.column(2)):
                ids = words.find(values)[places]
                first = np.cumsum(sizes) - sizes
                cold = np.cumsum(ids < 0)
                hot = sizes - np.diff(cold[first + sizes - 1], prepend=0)
                offsets = np.append(first, len(ids))
                ends = np.append(0, cold)[offsets].astype(np.int32)
                sums = [pa.array(sizes), pa.array(hot), pa.array(np.add.reduceat(logs[ids], first))]
                own = batch.slice(start, stop - start).columns[:2]
                arrays = [
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(values[places[ids < 0]])),
                ]
                yield pa.RecordBatch.from_arrays([*own, *sums, *arrays], ["id", "learn", "n_tokens", "hot", "base", "ids", "cold"])

    kind = "id long, learn boolean, n_tokens long, hot long, base double, ids array<int>, cold array<long>"
    return written(docs.mapInArrow(run, kind).withColumn("row", F.monotonically_increasing_id()), "encoded")


def values_of(piece: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word values of encoded rows, where rows start, and the places of hot words or -1."""
    ids, first = flat(piece, "ids")
    values = np.append(words, 0)[ids]
    values[ids < 0] = flat(piece, "cold")[0]
    return values, first, ids


def ordered(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns in the order of the first."""
    columns = [table.column(n).to_numpy() for n in names]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


def bucket_of(code: str, bits: int) -> Column:
    return F.shiftright(code, 64 - bits).alias("bucket")


def follower_counts(corpus: DataFrame, root: Root, known: DataFrame, length: int, least: float) -> DataFrame:
    """(context, total, n, code, shorter) of what follows the ``known(context, suffix, total)`` at least so often.

    ``code`` tells the context and the word, ``shorter`` its suffix and the word, or the word alone.
    """
    bits = root.bits()
    broadcast = corpus.sparkSession.sparkContext.broadcast
    hot_words, let_through = broadcast(root.words), broadcast(Sieve(known.select(F.col("context").alias("code"))))

    def run(batches):
        words, sieve = hot_words.value, let_through.value
        for batch in batches:
            for piece in pieces(batch, "ids"):
                values, first, ids = values_of(piece, words)
                codes, there = context(values, first, length)
                at = np.flatnonzero(there & sieve.passes(codes))
                codes, values, ids = codes[at], values[at], ids[at]
                order, starts = alike(chained(codes, values))
                one, n = order[starts], np.diff(np.append(starts, len(order)))
                order = np.argsort(codes[one])  # packs well, and orders the buckets
                one, n = one[order], n[order].astype(np.int32)
                del at, there, order, starts
                buckets, offsets = dealt(codes[one] >> (64 - bits))
                hot = ids[one].astype(np.int32)
                cold = blobs(np.append(0, np.cumsum(hot < 0))[offsets], values[one][hot < 0])
                yield from parted(
                    pa.RecordBatch.from_arrays(
                        [pa.array(buckets), *blobs(offsets, codes[one], hot, n), *cold], ["bucket", "contexts", "words", "n", "cold"]
                    )
                )

    def count(found: pa.Table, known: pa.Table) -> pa.Table:
        words = hot_words.value
        kinds = {"contexts": np.int64, "words": np.int32, "n": np.int32, "cold": np.int64}
        context, hot, n, cold = (unpacked(found, name, kind)[0] for name, kind in kinds.items())
        word = np.append(words, 0)[hot]
        word[hot < 0] = cold
        first = pa.array(np.argsort(known.column("context").to_numpy()))
        known = known.take(first)
        place = Lookup(known.column("context").to_numpy()).find(context)
        there = place >= 0
        context, word, n, place = context[there], word[there], n[there], place[there]
        code = chained(context, word)
        order, starts = alike(code)
        n = np.add.reduceat(n[order], starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        one = order[starts][n >= least]
        n = n[n >= least]
        order = np.argsort(context[one])
        one, n = one[order], n[order]
        suffix = known.column("suffix").combine_chunks()
        longer, suffix = suffix.is_valid().to_numpy(False)[place[one]], suffix.fill_null(0).to_numpy()[place[one]]
        shorter = np.where(longer, chained(suffix, word[one]), word[one])
        total = known.column("total").to_numpy()[place[one]]
        rows = pa.record_batch({"context": context[one], "total": total, "n": n, "code": code[one], "shorter": shorter})
        return pa.Table.from_batches(parted(rows), rows.schema)

    found = corpus.select("ids", "cold").mapInArrow(run, "bucket long, contexts binary, words binary, n binary, cold binary")
    known = known.select("context", "suffix", "total", bucket_of("context", bits))
    kind = "context long, total long, n long, code long, shorter long"
    return found.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(count, kind)


def looked_up(corpus: DataFrame, root: Root, parts: DataFrame, length: int, least: float | None) -> DataFrame:
    """(row, part, known): the sum of the ``parts(code, part, n)`` that a row's positions have, and their number.

    Length 0 looks up the words that aren't hot, others the contexts of that length and their followers. Parts with at least the given
    n are broadcast.
    """
    bits = max(1, root.bits() - 2)  # few of a text's positions are asked for
    hot, sieve = (np.zeros(0, np.int64), np.zeros(0)), None
    if length:
        hot, sieve = arrays_of(parts.where(F.col("n") >= least), "code", "part"), Sieve(parts)
        parts = parts.where(F.col("n") < least)
    held = corpus.sparkSession.sparkContext.broadcast((root.words, hot, sieve))

    def run(batches):
        words, (hot, shares), sieve = held.value
        hot = Lookup(hot)
        for batch in batches:
            for piece in pieces(batch, "ids"):
                values, first, ids = values_of(piece, words)
                if length:
                    codes, there = context(values, first, length)
                    at = np.flatnonzero(there & sieve.passes(codes))
                    codes = codes[at]
                    follower = chained(codes, values[at]) ^ FOLLOWER
                    passes = sieve.passes(follower)
                    codes, at = np.append(codes, follower[passes]), np.append(at, at[passes])
                    del there, follower, passes
                else:
                    at = np.flatnonzero(ids < 0)
                    codes = values[at]
                places = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(ids))))[at]
                del values, ids, at
                place = hot.find(codes)
                found = place >= 0
                sums = np.bincount(places[found], shares[place[found]], len(first)).astype(np.float64)
                codes, places = codes[~found], places[~found]
                bucket = codes >> (64 - bits)
                order = np.argsort(bucket.astype(np.int16) if bits < 16 else bucket, kind="stable")
                buckets, offsets = dealt(bucket[order])
                # the rows themselves come first, in some bucket
                rows = piece.column("row").to_numpy()
                own = np.append(0, np.full(len(buckets) + 1, len(rows))).astype(np.int32)
                buckets = np.append(rows[0] % (1 << bits) - (1 << bits - 1), buckets)
                arrays = [pa.array(buckets), pa.array(np.full(len(buckets), rows[0])), *blobs(own, rows, sums)]
                arrays += blobs(np.append(0, offsets), places[order], codes[order])
                yield from parted(pa.RecordBatch.from_arrays(arrays, ["bucket", "piece", "rows", "sums", "places", "codes"]))

    def look(wanted: pa.Table, parts: pa.Table) -> pa.Table:
        known, shares = ordered(parts, "code", "part")
        lookup = Lookup(known)
        piece = wanted.column("piece").to_numpy()
        sizes = pc.fill_null(pc.binary_length(wanted.column("codes")), 0).to_numpy() // 8
        found = [wanted.filter(pc.greater(pc.binary_length(wanted.column("rows")), 0)).select(["piece", "rows", "sums"])]
        for start, stop in slices(np.append(0, np.cumsum(sizes, dtype=np.int64))):
            own = wanted.slice(start, stop - start)
            place = lookup.find(unpacked(own, "codes", np.int64)[0])
            at = np.flatnonzero(place >= 0)
            part, places = shares[place[at]], unpacked(own, "places", np.int32)[0][at]
            line = np.repeat(np.arange(start, stop), sizes[start:stop])[at]
            order, starts = alike(line << 32 | places)
            one = order[starts]
            lines, offsets = dealt(line[one])
            part = np.add.reduceat(part[order], starts) if len(starts) else np.zeros(0)
            n = np.diff(np.append(starts, len(order))).astype(np.int32)
            counts = [offsets, n] if not length else [offsets * 0, n[:0]]
            answers = [pa.array(piece[lines]), *blobs(offsets, places[one], part), *blobs(*counts)]
            found.append(pa.table(answers, ["piece", "places", "sums", "known"]))
        return pa.concat_tables(found, promote_options="default").select(["piece", "rows", "places", "sums", "known"])

    def gather(piece: pa.Table) -> pa.Table:
        own = pc.is_valid(piece.column("rows"))
        others, own = piece.filter(pc.invert(own)), piece.filter(own)
        rows, sums = unpacked(own, "rows", np.int64)[0], unpacked(own, "sums", np.float64)[0]
        places, part = unpacked(others, "places", np.int32)[0], unpacked(others, "sums", np.float64)[0]
        n, _ = unpacked(others, "known", np.int32)
        known = np.bincount(places, n, len(rows)) if len(n) else np.zeros(len(rows))
        return pa.table({"row": rows, "part": sums + np.bincount(places, part, len(rows)), "known": known.astype(np.int64)})

    found = corpus.select("row", "ids", "cold").mapInArrow(
        run, "bucket long, piece long, rows binary, sums binary, places binary, codes binary"
    )
    parts = parts.select("code", "part", bucket_of("code", bits))
    found = found.groupBy("bucket").cogroup(parts.groupBy("bucket")).applyInArrow(
        look, "piece long, rows binary, places binary, sums binary, known binary"
    )
    return written(found.groupBy("piece").applyInArrow(gather, "row long, part double, known long"), "found")


def arrays_of(rows: DataFrame, *names: str) -> list[np.ndarray]:
    """Columns of a table of proven size, ordered by the first."""
    return ordered(rows.select(*names).toArrow(), *names)


def retained(followers: DataFrame) -> DataFrame:
    """(context, total, rest) of the contexts that diverge from their suffix."""
    n, total, parent = F.col("n"), F.col("total"), F.col("parent")
    rows = followers.groupBy("context").agg(
        F.first("total").alias("total"), F.count("*").alias("explicit"), F.sum("n").alias("held"), F.sum("parent").alias("held_parent"),
        F.sum(n * F.log(n / total / parent)).alias("ratio"), F.sum((n - DISCOUNT) / total).alias("share"),
    )
    others = F.col("total") - F.col("held")
    left = 1 - F.least("held_parent", F.lit(1 - 1e-9))
    ratio = F.col("ratio") + F.when(others > 0, others * F.log(others / F.col("total") / left)).otherwise(0)
    rows = rows.where(2 * ratio >= (F.col("explicit") + 1) * F.log("total"))
    return rows.select("context", "total", (1 - F.col("share")).alias("rest"))


def learn(counts: DataFrame, hot_share: float) -> Root:
    """The root."""
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    hot = counts.where(F.col("n") >= hot_share * (total or 0))
    return Root(*arrays_of(hot, "word", "n"), total or 0, distinct)


def grow(
    root: Root, counts: DataFrame, corpus: DataFrame, depth: int, least_context: float, least_follower: float, least_part: float
) -> Iterator[DataFrame]:
    """For each level, (row, part, known): what its contexts and followers add to a row's log10. Each level is counted over the whole corpus.

    A context is followed as often as it occurs, unless it ends with the end; then nothing follows, and none is counted.
    """
    p = (F.col("n") + ALPHA) / F.lit(root.total + ALPHA * (root.distinct + 1))
    former, parents = counts, counts.select(F.col("word").alias("shorter"), p.alias("parent"))
    known = counts.where(F.col("n") >= least_context)
    known = known.select(F.col("word").alias("context"), F.lit(None).cast("long").alias("suffix"), F.col("n").alias("total"))
    for length in range(1, depth + 1):
        if known.isEmpty():
            break
        rows = follower_counts(corpus.where("learn"), root, known, length, least_follower)
        rows = written(rows.join(small(parents), "shorter"), "explicit")
        drop(former)
        kept = written(retained(rows), "retained")
        share, below = (F.col("n") - DISCOUNT) / F.col("total"), F.col("rest") * F.col("parent")
        explicit = rows.join(small(kept.select("context", "rest")), "context", "left")
        own = F.coalesce(share + below, "parent")
        level = written(explicit.select("code", "shorter", "n", own.alias("p"), F.log10(own / below).alias("part")), "level")
        drop(rows)
        follower = F.col("code").bitwiseXOR(F.lit(FOLLOWER)).alias("code")
        parts = kept.select(F.col("context").alias("code"), F.log10("rest").alias("part"), F.col("total").alias("n"))
        parts = parts.unionByName(level.where("part is not null").select(follower, "part", "n"))
        yield looked_up(corpus, root, parts, length, least_part)
        drop(kept)
        former, parents = level, level.select(F.col("code").alias("shorter"), F.col("p").alias("parent"))
        known = level.where(F.col("n") >= least_context)
        known = known.select(F.col("code").alias("context"), F.col("shorter").alias("suffix"), F.col("n").alias("total"))
    drop(former)


def scores(
    docs: DataFrame, may_learn: Column, depth: int = 3, hot_share: float = 1e-6, context_share: float = 0.0,
    follower_share: float = 0.0, id_column: str = "doc_id", text_column: str = "text", least_context: int = 8, least_follower: int = 2,
    part_share: float = 2e-7,
) -> DataFrame:
    """id, ``learn``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (root only) and ``score`` of each row.

    ``may_learn`` says which rows the model learns from. ``depth`` is the longest context. ``context_share`` and
    ``follower_share`` of all tokens, if given, are further least counts, for smaller models.
    """
    learn_from = F.coalesce(may_learn, F.lit(False)).alias("learn")
    rows = docs.select(F.col(id_column).cast("long").alias("id"), learn_from, F.col(text_column).cast("string").alias("text"))
    counts = word_counts(rows.where("learn"))
    root = learn(counts, hot_share)
    corpus = encoded(rows, root)
    # against an unknown word, as which ``encoded`` takes them
    cold = counts.where(F.col("n") < hot_share * root.total)
    cold = cold.select(F.col("word").alias("code"), F.log10((F.col("n") + ALPHA) / ALPHA).alias("part"))
    words = looked_up(corpus, root, cold, 0, None)
    least = max(least_context, context_share * root.total), max(least_follower, follower_share * root.total)
    found = list(grow(root, counts, corpus, depth, *least, part_share * root.total))
    found = [words.select("row", F.col("part").alias("log"), "part", "known"), *(f.select("row", F.lit(0.0), "part", F.lit(0)) for f in found)]
    sums = reduce(DataFrame.union, found).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("log", "part", "known")))
    found = corpus.select("row", "id", "learn", "n_tokens", "hot", "base").join(sums, "row").select(
        F.col("id").alias(id_column), "learn", "n_tokens", (F.col("hot") + F.col("known")).alias("n_known"),
        F.lit(root.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("log")).alias("base_score"),
        (F.col("base") + F.col("part")).alias("score"),
    )
    found = written(found, "scored")
    drop(corpus)
    return found
