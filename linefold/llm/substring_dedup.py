"""Removal of repeated word spans with suffix automata of reference shards.

A word goes if a window of ``width`` words around it also starts in a document with a smaller id.

1. Documents with equal word sequences: all but the smallest id go whole, if they hold a window.
2. Routing. Each window is filed under its minimizer (least value of its short word groups), so equal windows are filed
   alike, at about a fifth of the rows. Windows under minimizers of two or more documents are
   hashed; their first owner (smallest id and place) is found by aggregation. Nothing unbounded is gathered.
3. First occurrences of repeated windows are the reference text. It is cut into pieces of ``PIECE`` words and the pieces are dealt
   into shards of about ``SHARD_WORDS`` words.
4. A task builds the suffix automaton of its shard and streams the passages routed to it. Matching
   statistics give, at each word, the longest match and the smallest document it occurs in. Spans of matches of
   ``width`` or more words in a smaller document are the result; hashes decide only what is compared with what.
   A shard that many passages are routed to is given to as many tasks, each with the whole automaton.

Documents are keyed by a 64-bit hash of id and text. Null and empty texts have no words. Rows without an id keep all
words and remove nothing elsewhere. Rows that repeat an id are told apart by their text and never remove words of
each other; equal rows have equal results. Other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from linefold.llm.minhash import mixed
from linefold.llm.store import drop, stage

GROUP = 5
PIECE, SHARD_WORDS, STREAM_WORDS = 4096, 100_000, 200_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged."""
    return (text or "").encode().split()


def grams(values: np.ndarray, width: int) -> np.ndarray:
    """64-bit values of all groups of ``width`` words."""
    n = len(values) - width + 1
    out = np.full(max(n, 0), width, np.uint64)
    for i in range(width if n > 0 else 0):
        out = mixed(out * STEP + values[i : i + n])
    return out


def minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """For each window, the least value of its short groups."""
    short = grams(values, min(GROUP, width))
    n, out = max(0, len(values) - width + 1), short[: max(0, len(values) - width + 1)]
    for i in range(1, len(short) - n + 1):
        out = np.minimum(out, short[i : i + n])
    return out


def word_values(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def surveyed(docs: DataFrame, width: int) -> DataFrame:
    """(doc, id, n, same, keys): number of words, a value of their whole sequence, the distinct minimizers."""

    def run(batches):
        for batch in batches:
            n, same, keys = [], [], []
            for text in batch.column(2):
                words = words_of(text.as_py())
                n.append(len(words))
                same.append(xxh3_128_digest(b" ".join(words)))
                keys.append(np.unique(minimizers(word_values(words), width)).view(np.int64))
            arrays = [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(keys, pa.list_(pa.int64()))], ["doc", "id", "n", "same", "keys"])

    return docs.mapInArrow(run, "doc long, id long, n long, same binary, keys array<long>")


def repeated_windows(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc, id, window, pos) of the windows filed under the ``wanted(doc, keys)``."""

    def run(batches):
        for batch in batches:
            values, places = [], []
            for text, keys in zip(batch.column(2), batch.column(3), strict=True):
                word = word_values(words_of(text.as_py()))
                found = keys.values.to_numpy().view(np.uint64)
                at = np.flatnonzero(np.isin(minimizers(word, width), found))
                values.append(grams(word, width)[at].view(np.int64))
                places.append(at.astype(np.int32))
            arrays = [*batch.columns[:2], pa.array(values, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "id", "windows", "places"])

    rows = docs.join(wanted, "doc").select("doc", "id", "text", "keys")
    found = stage(rows.mapInArrow(run, "doc long, id long, windows array<long>, places array<int>"), "windows")
    return found.select("doc", "id", F.explode(F.arrays_zip("windows", "places")).alias("x")).select(
        "doc", "id", F.col("x.windows").alias("window"), F.col("x.places").alias("pos")
    )


def owned(windows: DataFrame) -> DataFrame:
    """(doc, at): places of windows that two documents have, with the first owner's id and place."""
    owner = windows.groupBy("window").agg(F.min(F.struct("id", "pos")).alias("owner"), F.max("id").alias("last"))
    # stored, so that both sides of the join are dealt anew and a frequent window can be split
    owner = stage(owner.where(F.col("owner.id") < F.col("last")).select("window", "owner"), "owners")
    found = windows.join(owner, "window").where((F.col("id") > F.col("owner.id")) | (F.col("pos") == F.col("owner.pos")))
    place = F.struct("pos", F.col("owner.id").alias("owner"), F.col("owner.pos").alias("owner_pos"))
    return found.groupBy("doc").agg(F.array_sort(F.collect_list(place)).alias("at"))


def runs(places: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of consecutive numbers, as (first, last)."""
    ends = np.flatnonzero(np.diff(places) > 1)
    return list(zip(places[np.r_[0, ends + 1]].tolist(), places[np.r_[ends, len(places) - 1]].tolist(), strict=True))


def passages(docs: DataFrame, plan: DataFrame, width: int, shards: int) -> DataFrame:
    """(shard, streamed, doc, id, start, words) of reference pieces and of the passages to compare with them."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for doc, own, text, at in zip(*(batch.column(i) for i in range(4)), strict=True):
                words = words_of(text.as_py())
                struct = at.values
                pos, owner, owner_pos = (struct.field(i).to_numpy() for i in range(3))
                doc, own = doc.as_py(), own.as_py()
                with np.errstate(over="ignore"):
                    piece = mixed(owner.astype(np.uint64) * STEP + (owner_pos // PIECE).astype(np.uint64))
                shard = (piece % np.uint64(shards)).astype(np.int64)
                refers = owner == own
                for streamed in (False, True):
                    role = refers != streamed
                    # pieces of one shard that lie side by side must not run together on the reference side
                    for group in np.unique(shard[role] if streamed else owner_pos[role] // PIECE):
                        here = role & ((shard if streamed else owner_pos // PIECE) == group)
                        for first, last in runs(np.unique(pos[here])):
                            cut = b" ".join(words[first : last + width]).decode()
                            out.append((int(shard[here][0]), streamed, doc, own, first, cut))
            names = ["shard", "streamed", "doc", "id", "start", "words"]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*out, strict=True)) or [()] * 6
            arrays = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.join(plan, "doc").select("doc", "id", "text", "at")
    return rows.mapInArrow(run, "shard long, streamed boolean, doc long, id long, start long, words string")


class SuffixAutomaton:
    """Of word passages, added in rising order of their documents' ids, so that a state's first document is its smallest."""

    def __init__(self) -> None:
        self.go: list[dict[str | int, int]] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0
        self.passages = 0

    def state(self, length: int, link: int, go: dict, first: int) -> int:
        self.go.append(go)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.go) - 1

    def extend(self, word: str | int, document: int) -> None:
        go, link, length = self.go, self.link, self.length
        new = self.state(length[self.last] + 1, 0, {}, document)
        at = self.last
        while at >= 0 and word not in go[at]:
            go[at][word] = new
            at = link[at]
        if at >= 0:
            to = go[at][word]
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = self.state(length[at] + 1, link[to], dict(go[to]), self.first[to])
                while at >= 0 and go[at].get(word) == to:
                    go[at][word] = copy
                    at = link[at]
                link[to] = link[new] = copy
        self.last = new

    def add(self, words: list[str], document: int) -> None:
        for word in words:
            self.extend(word, document)
        self.passages += 1
        self.extend(self.passages, document)  # a number: no match runs across passages

    def ends(self, words: list[str], document: int, width: int) -> list[int]:
        """Places of words that end a match of ``width`` or more words with a smaller document."""
        go, link, length, first = self.go, self.link, self.length, self.first
        out, at, matched = [], 0, 0
        for place, word in enumerate(words):
            while at and word not in go[at]:
                at = link[at]
                matched = length[at]
            if word in go[at]:
                at, matched = go[at][word], matched + 1
            if matched >= width:
                low = at
                while first[low] >= document and length[link[low]] >= width:
                    low = link[low]
                if first[low] < document:
                    out.append(place)
        return out


def spans_of(reference: pd.DataFrame, streamed: pd.DataFrame, width: int) -> pd.DataFrame:
    """(doc, start, stop): maximal spans of the passages that the reference holds in smaller documents."""
    automaton, out = SuffixAutomaton(), []
    for row in reference.sort_values(["id", "doc", "start"]).itertuples():
        automaton.add(row.words.split(" "), row.id)
    for row in streamed.itertuples():
        ends = automaton.ends(row.words.split(" "), row.id, width)
        if ends:
            found = runs(np.array(ends))
            out += [(row.doc, row.start + a - width + 1, row.start + b + 1) for a, b in found]
    return pd.DataFrame(out, columns=["doc", "start", "stop"]).astype("int64")


def repeated_spans(docs: DataFrame, width: int) -> DataFrame:
    """(doc, spans): the spans [start, stop) of words to remove from ``docs(doc, id, text)``."""
    rows = stage(surveyed(docs.where("id is not null"), width).where(F.col("n") >= width), "survey")
    lowest = rows.groupBy("same").agg(F.min("id").alias("low"))
    marked = stage(rows.select("doc", "id", "n", "same").join(lowest, "same"), "marked")
    copies = marked.where("id > low").select("doc", F.lit(0).cast("long").alias("start"), F.col("n").alias("stop")).distinct()
    single = marked.where("id = low").select("doc").distinct()

    filed = stage(rows.select("doc", "keys").join(single, "doc").dropDuplicates(["doc"]), "filed")
    drop(rows)
    keys = filed.select("doc", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    wanted = stage(keys.join(shared, "key").groupBy("doc").agg(F.collect_list("key").alias("keys")), "wanted")
    drop(filed)
    windows = repeated_windows(docs, wanted, width)
    plan = stage(owned(windows), "plan")
    drop(windows, wanted)

    words = plan.select(F.explode("at").alias("x")).agg(F.count("*")).first()[0]
    shards = max(1, -(-words // SHARD_WORDS))
    cut = stage(passages(docs, plan, width, shards).distinct(), "passages")
    size = F.length("words") / 4
    tasks = cut.where("streamed").groupBy("shard").agg(F.ceil(F.sum(size) / STREAM_WORDS).cast("int").alias("tasks"))
    dealt = cut.join(tasks, "shard")
    task = F.when(F.col("streamed"), F.array(F.pmod(F.xxhash64("doc", "start"), F.col("tasks")).cast("int")))
    dealt = dealt.withColumn("task", F.explode(task.otherwise(F.sequence(F.lit(0), F.col("tasks") - 1))))

    def compare(reference: pd.DataFrame, streamed: pd.DataFrame) -> pd.DataFrame:
        return spans_of(reference, streamed, width)

    reference = dealt.where(~F.col("streamed")).drop("streamed", "tasks")
    streamed = dealt.where("streamed").drop("streamed", "tasks")
    streamed = streamed.toDF(*streamed.columns)  # columns of its own, both come from one table
    both = reference.groupBy("shard", "task").cogroup(streamed.groupBy("shard", "task"))
    found = both.applyInPandas(compare, "doc long, start long, stop long")
    found = copies.unionByName(found).groupBy("doc")
    return stage(found.agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, width: int = 13, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: id, ``n_words``, ``n_removed``, ``spans`` and the ``kept`` words, joined by blanks."""
    text = F.col(text_column).cast("string")
    docs = docs.select(F.xxhash64(id_column, text).alias("doc"), F.col(id_column).cast("long").alias("id"), text.alias("text"))
    spans = repeated_spans(docs, width)
    kind = "array<struct<start:long,stop:long>>"

    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = words_of(text.as_py())
                left = words
                if found:
                    stay = np.ones(len(words), bool)
                    for span in found:
                        stay[span["start"] : span["stop"]] = False
                    left = [words[i] for i in np.flatnonzero(stay)]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            names = [id_column, "n_words", "n_removed", "spans", "kept"]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column(2), pa.array(kept, pa.string())], names)

    rows = docs.join(spans, "doc", "left").select("id", "text", "spans")
    return rows.mapInArrow(run, f"`{id_column}` long, n_words long, n_removed long, spans {kind}, kept string")
