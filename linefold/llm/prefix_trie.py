"""The trie of conversations' prefixes, by digests of blocks of turns.

A node is a distinct sequence of first d turns. Nodes are told apart by 128-bit digests: a turn's digest covers role and text; a block
is ``block`` turns at fixed places, and its end digest covers the digest at its start and its turns. Conversations are grouped by the
digests at block starts first. Where all that go on have one next block, the nodes inside it come from one of them; only in blocks in which
siblings diverge are the turns of every conversation looked at.

Nothing walks the tree. A conversation's turns from the first node on whose smallest member it is are its own; those before it shares. So
the saved bytes of a subtree are sums over its members: the bytes each shares, less what lies before the subtree. Leaves are counted by
their smallest members in the same way.

Long conversations are cut into segments of ``SEGMENT`` blocks, which are what groups collect; a list per conversation has one digest a segment.
Digests that many rows have (the root's first of all) meet their groups in buckets. The list of a node's conversations is put together
from pieces of sorted ranges. Everything else is partial sums.

Rows without ``conv_id`` belong to no conversation. Null roles and texts are empty ones. Turns are ordered by ``turn``, null first; ties
by digest. Repeated rows are turns like others. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linefold.llm.store import drop, stage
from linefold.operators.ordered import number_lines

BLOCK, SEGMENT = 4, 64
BUCKETS = 1024
PIECE = 4096
ROOT = bytes(16)
TURNS = "array<struct<digest: binary, bytes: long>>"


def short_digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def short_sha(data: Column) -> Column:
    """``short_digest`` in Spark."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, bytes)``: turns numbered from 0, without their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", short_sha(framed).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    # the sorted table fixes partitions, each a bounded part of a conversation of any size
    placed = turns.orderBy("conv_id", F.col("turn").asc_nulls_first(), "digest").withColumns(
        {"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()}
    )
    numbered = number_lines(stage(placed.drop("turn"), "turns"), "conv_id", ["place"], F.col("part"))
    return numbered.select("conv_id", "pos", "digest", "bytes")


def meet(rows: DataFrame, per_key: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """Join one row per ``key`` to ``rows``; a frequent key meets it once per bucket of ``by``."""
    bucketed = rows.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(BUCKETS)))
    buckets = bucketed.select(key, "bucket").distinct().join(per_key, key, how)
    return bucketed.join(buckets, [key, "bucket"], how).drop("bucket")


def segments(turns: DataFrame, block: int, segment: int) -> DataFrame:
    """``(conv_id, seg, turns)``, with a segment's turns in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "digest", "bytes")))
    grouped = turns.groupBy("conv_id", F.floor(F.col("pos") / (block * segment)).alias("seg")).agg(listed.alias("turns"))
    return grouped.withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"], t["bytes"])))


def segment_starts(segs: DataFrame) -> DataFrame:
    """``(conv_id, seg, start, before)``: digest and bytes before each later segment of long conversations."""
    long = segs.filter("seg > 0").select("conv_id").distinct()
    joined = F.aggregate("turns", F.lit("").cast("binary"), lambda acc, t: F.concat(acc, t["digest"]))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda acc, t: acc + t["bytes"])
    parts = segs.join(long, "conv_id", "left_semi").select("conv_id", "seg", short_sha(joined).alias("digest"), size.alias("size"))
    lists = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seg", "digest", "size"))).alias("parts"))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, parts in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                start, before, rows = ROOT, 0, []
                for part in parts[:-1]:
                    start, before = short_digest(start + part["digest"]), before + part["size"]
                    rows.append((conv, part["seg"] + 1, start, before))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "seg", "start", "before"])

    return lists.mapInArrow(chain, "conv_id long, seg long, start binary, before long")


def turn_keys(start: bytes, turns: list[dict], full_end: bytes | None = None) -> list[bytes]:
    """Digests after each turn of a block that starts at ``start``; ``full_end`` stands for the last one."""
    state, keys = hashlib.sha256(start), []
    for turn in turns:
        state.update(turn["digest"])
        keys.append(state.digest()[:16])
    return keys if full_end is None else [*keys[:-1], full_end]


def block_rows(segs: DataFrame, starts: DataFrame, block: int, segment: int) -> DataFrame:
    """One row per conversation and block: digest at its start and end, depth and bytes before it, its turns."""
    joined = segs.join(starts, ["conv_id", "seg"], "left").select("conv_id", "seg", "start", "before", "turns")
    turn = pa.struct([("digest", pa.binary()), ("bytes", pa.int64())])
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(turn)]
    names = ["conv_id", "depth", "start", "end", "closes", "before", "after", "turns"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, seg, start, before, turns in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first, before = start or ROOT, before or 0
                at = first
                for i in range(0, len(turns), block):
                    part = turns[i : i + block]
                    # the end of a full segment is the start of the next one
                    closes = i + block == block * segment and len(part) == block
                    whole = b"".join(t["digest"] for t in turns) if closes else b""
                    end = short_digest(first + short_digest(whole)) if closes else turn_keys(at, part)[-1]
                    after = before + sum(t["bytes"] for t in part)
                    rows.append((conv, seg * block * segment + i, at, end, closes, before, after, part))
                    at, before = end, after
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "conv_id long, depth long, start binary, end binary, closes boolean, before long, after long"
    return joined.mapInArrow(cut, f"{kinds}, turns {TURNS}")


def moves(blocks: DataFrame) -> DataFrame:
    """Turns of the blocks in which siblings diverge, and of one conversation of every other block, with the number they stand for."""
    groups = blocks.groupBy("start").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("low"), (F.min("end") == F.max("end")).alias("alike")
    )
    found = meet(blocks, groups, "start", F.col("conv_id")).filter("not alike or conv_id = low")
    found = found.select("conv_id", "depth", "start", "end", "closes", "before", "turns", "alike", F.when(F.col("alike"), F.col("n")).otherwise(1))
    types = [pa.binary(), pa.binary(), pa.binary(), pa.bool_(), *[pa.int64()] * 5]
    names = ["key", "parent", "start", "alike", "conv_id", "n", "depth", "before", "bytes"]

    def turn_by_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, depth, start, end, closes, before, turns, alike, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = turn_keys(start, turns, end if closes else None)
                for i, (key, turn) in enumerate(zip(keys, turns, strict=True)):
                    rows.append((key, keys[i - 1] if i else start, start, alike, conv, n, depth + i + 1, before, turn["bytes"]))
                    before += turn["bytes"]
            if rows:
                arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    kinds = "key binary, parent binary, start binary, alike boolean, conv_id long, n long, depth long, before long, bytes long"
    return found.mapInArrow(turn_by_turn, kinds)


def lists_sha(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the ascending, comma-joined ``conv_id`` of each ``key``, in pieces."""
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[bytes, int, list[str]]] = []
            for key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not rows or rows[-1][0] != key or len(rows[-1][2]) == PIECE:
                    rows.append((key, conv, []))
                rows[-1][2].append(str(conv))
            if rows:
                keys, firsts, texts = zip(*rows, strict=True)
                arrays = [pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array([",".join(t) for t in texts])]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "first", "piece"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            done = []
            for next_key, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if next_key != key:
                    done += [(key, state.hexdigest())] if key is not None else []
                    key, state = next_key, hashlib.sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    joined = ranges.select("key", "conv_id").mapInArrow(pieces, "key binary, first long, piece string")
    return joined.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, segment: int = SEGMENT) -> DataFrame:
    """Nodes of the trie: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (bytes) and ``ends_sha256``.

    ``turns`` has ``(conv_id, pos, digest, bytes)`` with ``pos`` from 0 without gaps; ``convs`` every ``conv_id`` once, turnless ones too.
    """
    convs = convs.select("conv_id")
    segs = stage(segments(turns, block, segment), "segments")
    blocks = stage(block_rows(segs, segment_starts(segs), block, segment), "blocks")
    drop(segs)
    moved = stage(moves(blocks), "moves")

    inner = moved.groupBy("key").agg(
        F.any_value("parent").alias("parent"),
        F.any_value("start").alias("start"),
        F.any_value("alike").alias("alike"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n").alias("n_convs"),
        F.any_value("depth").alias("depth"),
        F.any_value("before").alias("before"),
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.withColumns({"key": F.lit(ROOT), "depth": F.lit(0).cast("long"), "before": F.lit(0).cast("long")})
    nodes = stage(inner.unionByName(root, allowMissingColumns=True), "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").fillna(0, ["n_children"])

    # what a conversation shares, and whether it stands for a leaf
    own = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    last = blocks.groupBy("conv_id").agg(F.max_by(F.struct("end", "after"), "depth").alias("last"))
    members = convs.join(last, "conv_id", "left").join(own, "conv_id", "left")
    members = stage(
        members.select(
            "conv_id",
            F.coalesce("last.end", F.lit(ROOT)).alias("key"),
            F.coalesce("own", "last.after", F.lit(0)).alias("shared"),
            F.coalesce("leaf", F.lit(0)).alias("leaf"),
        ),
        "members",
    )
    sums = [F.sum("shared").alias("shared"), F.min_by("shared", "conv_id").alias("of_low"), F.sum("leaf").alias("n_leaves")]
    each = members.select("conv_id", "shared", "leaf")
    by_start = meet(blocks.select("conv_id", "start", "depth"), each, "conv_id", F.col("depth")).groupBy("start").agg(*sums)
    by_key = meet(moved.filter("not alike").select("conv_id", "key", "depth"), each, "conv_id", F.col("depth")).groupBy("key").agg(*sums)
    whole = members.agg(*sums).withColumn("key", F.lit(ROOT))
    alike = nodes.filter("alike").join(by_start, "start")
    others = nodes.filter("alike is null or not alike").join(by_key.unionByName(whole), "key")
    summed = alike.unionByName(others, allowMissingColumns=True)
    summed = summed.withColumn("saved_tokens", F.col("shared") - F.col("of_low") - (F.col("n_convs") - 1) * F.col("before"))

    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    summed = meet(summed, parents, "parent", F.col("key"), "left")
    summed = summed.join(lists_sha(members.select("key", "conv_id")), "key", "left")
    return summed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
