"""Toxicity by a noisy channel: restore the text that was written, then score it.

Channel: a writer replaces letters by look-alike digits and signs, repeats letters, puts signs between them or spells
words out. For a suspicious token (or a run of single characters) the possible readings form a character
lattice; ``Decoder`` finds the likeliest one by Viterbi under a character trigram model learnt from all training texts.

Score: words and word beginnings of the restored text that are significantly more frequent in toxic documents carry a
log-odds weight, less its standard error. Copies would fake that significance, so most are left out by sketches. Labels are learnt
from a bounded sample of labelled rows (``max_labelled``); all else is computed over all rows.

Null and empty texts score as a text without any such word: the prior. Every row gives a row, repeated rows
too. A document with several labels counts as toxic if one says so; null labels are left out. Rows without an id are
scored and never learnt from. Tokens and runs of single characters are restored whole, whatever their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from linefold.llm.minhash import hash_params, mixed, shingles
from linefold.llm.store import shared, stage

#: Letters that digits and signs are read as.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
SIZE = len(LETTERS) + 1
SINGLE = {*LETTERS, *LOOK_ALIKE}
#: Characters after which the decoder joins the pieces of its readings.
JOINED = 1024
BEGINNINGS = (4, 5)
#: Costs (log e) of the channel: a sign for a letter, a letter written again, a sign between letters, a dropped gap.
SWAP, AGAIN, SIGN, GAP = math.log(0.2), math.log(0.3), math.log(0.5), math.log(0.05)
REMEMBERED = 200_000
#: Features that a task holds before it hands their counts on.
HELD = 500_000
SKETCHES = 3

WORD = re.compile(r"[^\W\d_]+")
PUNCTUATION = ".,;:?()[]{}\"'*#%&"
#: The same sign twice or more at either end, or one exclamation mark after a word.
DECORATION = re.compile(r"^(?:([^\w\s])\1+)+|(?:(?:([^\w\s])\2+)+|!)$")
THRICE = re.compile(r"([^\W\d_])\1\1")
#: What may hide letters: a look-alike next to a letter, a letter three times, signs between single letters.
ODD = re.compile(
    r"[^\W\d_][\d@$!|+(€£¡]|[\d@$!|+(€£¡][^\W\d_]|([^\W\d_])\1\1|(?<![^\W_])\w[^\w\s]\w[^\w\s]\w(?![^\W_])|_"
)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of letter trigrams, anything else being a gap; a flat array of SIZE^3."""
    index = np.zeros(0x110000, np.uint8)
    for i, letter in enumerate(LETTERS):
        index[ord(letter)] = i + 1
    out = np.zeros(SIZE**3, np.int64)
    for text in texts:
        codes = np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        at = index[codes].astype(np.int32)
        at = at[np.concatenate(([True], (at[1:] > 0) | (at[:-1] > 0)))]  # gaps count once
        out += np.bincount((at[:-2] * SIZE + at[1:-1]) * SIZE + at[2:], minlength=SIZE**3)
    return out


#: Back pointer and last piece of a reading.
Reading = tuple


def written(reading: Reading) -> str:
    """The text of a reading."""
    pieces = []
    while reading is not None:
        pieces.append(reading[1])
        reading = reading[0]
    return "".join(reversed(pieces))


def shortened(reading: Reading, joined: set[int]) -> Reading:
    """The reading with the pieces since one of ``joined`` in one."""
    pieces = []
    while id(reading) not in joined:
        pieces.append(reading[1])
        reading = reading[0]
    return (reading, "".join(reversed(pieces))) if pieces else reading


class Decoder:
    """Viterbi decoding under log probabilities of letters after two letters."""

    def __init__(self, counts: np.ndarray) -> None:
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two = three.sum(0)
        one = two.sum(0) + 1
        p1 = one / one.sum()
        p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
        p3 = (three + 20 * p2) / (three.sum(2, keepdims=True) + 20)
        self.log = np.log(p3).tolist()
        self.of = {letter: i + 1 for i, letter in enumerate(LETTERS)}

    def restore(self, token: str, gaps: bool = False) -> str:
        """The likeliest words behind ``token``; with ``gaps``, blanks inside are spelling and words may end anywhere."""
        start: Reading = (None, "")
        states: dict[tuple[int, int], tuple[float, Reading]] = {(0, 0): (0.0, start)}
        joined = {id(start)}
        log = self.log
        for n, char in enumerate(token, 1):
            after: dict[tuple[int, int], tuple[float, Reading]] = {}

            def reach(state: tuple[int, int], score: float, text: Reading) -> None:
                if state not in after or after[state][0] < score:  # noqa: B023
                    after[state] = (score, text)  # noqa: B023

            letters = [(self.of[char], char, 0.0)] if char in self.of else []
            letters += [(self.of[c], c, SWAP) for c in LOOK_ALIKE.get(char, "")]
            for (x, y), (score, text) in states.items():
                if not letters or not char.isalnum():
                    reach((x, y), score + SIGN, text)
                    if y and (char != " " or not gaps):
                        reach((y, 0), score + log[x][y][0], (text, " "))
                for z, letter, cost in letters:
                    reach((y, z), score + cost + log[x][y][z], (text, letter))
                    if y == z:
                        reach((x, y), score + AGAIN, text)
                    if gaps and y:
                        end = score + log[x][y][0] + GAP
                        reach((0, z), end + cost + log[y][0][z], (text, f" {letter}"))
            states = after
            if n % JOINED == 0:
                states = {at: (score, shortened(text, joined)) for at, (score, text) in states.items()}
                joined = {id(text) for _, text in states.values()}
        ends = [(s + (self.log[x][y][0] if y else 0), t) for (x, y), (s, t) in states.items()]
        best = max((s for s, _ in ends), default=0)
        return max((written(t) for s, t in ends if s == best), default="").strip()


class Known(dict):
    """Features of tokens, found when first asked for and remembered up to a bound."""

    def __init__(self, find) -> None:
        super().__init__()
        self.find = find

    def __missing__(self, token: str) -> tuple[str, ...]:
        found = self.find(token)
        if len(self) < REMEMBERED:
            self[token] = found
        return found


class Reader:
    """Features of a text: its restored words, and their beginnings. With ``wanted`` only those in it."""

    def __init__(self, decoder: Decoder, wanted: dict[str, float] | None = None) -> None:
        self.decoder, self.wanted = decoder, wanted
        self.known = Known(self.features_of)

    def words(self, token: str) -> list[str]:
        core = token.strip(PUNCTUATION)
        if not core.isalpha():
            core = DECORATION.sub("", core)
        if core.isalpha() and not THRICE.search(core):
            return [core]
        found = WORD.findall(core)
        if ODD.search(core):
            found += self.decoder.restore(core).split()
        return found

    def features_of(self, token: str) -> tuple[str, ...]:
        words, wanted = self.words(token), self.wanted
        found = words + [f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n]
        return tuple(found) if wanted is None else tuple([f for f in found if f in wanted])

    def spelt(self, tokens: list[str]) -> list[str]:
        """Words that runs of three or more single characters spell."""
        out, run = [], []
        for token in [*tokens, "  "]:
            if len(token) == 1:
                run.append(token)
                continue
            if len(run) >= 3:
                out += self.decoder.restore(" ".join(run), gaps=True).split()
            run = []
        return out

    def features(self, text: str | None) -> set[str]:
        tokens = (text or "").lower().split()
        seen, find = set(tokens), self.known.__getitem__
        out: set[str] = set().union(*map(find, seen))
        if len(seen & SINGLE) >= 2:
            out.update(*map(find, self.spelt(tokens)))
        return out


def without_copies(texts: DataFrame) -> DataFrame:
    """(id, toxic) of ``texts(id, toxic, text)`` without most near copies: those that share a sketch with a smaller id.

    A sketch is the least value of a word shingle under one of ``SKETCHES`` hash functions.
    """

    def run(batches):
        factors, offsets = hash_params(SKETCHES)
        for batch in batches:
            keys = []
            for text in batch.column(2):
                found = shingles(text.as_py(), 3)
                keys.append([int((mixed(found * a + b)).min() >> np.uint64(1)) if len(found) else -1 for a, b in zip(factors, offsets)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(keys, pa.list_(pa.int64()))], ["id", "toxic", "keys"])

    rows = texts.mapInArrow(run, "id long, toxic int, keys array<long>").distinct()
    keys = stage(rows.select("id", "toxic", F.posexplode("keys").alias("at", "key")), "sketches")
    low = keys.groupBy("toxic", "at", "key").agg(F.min("id").alias("low"))
    marked = keys.join(low, ["toxic", "at", "key"]).groupBy("id", "toxic").agg(F.min(F.col("low") == F.col("id")).alias("first"))
    return stage(marked.where("first").select("id", "toxic"), "sample")


def learn_letters(docs: DataFrame) -> Decoder:
    """The character model of all given texts. At most SIZE^3 counts come to the driver."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in batches:
            total += trigram_counts([t for t in batch.column(0).to_pylist() if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    found = docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3, np.int64)
    for row in found:
        counts[row.at] = row.n
    return Decoder(counts)


def labelled_sample(labels: DataFrame, may_learn: Column, max_labelled: int) -> DataFrame:
    """At most about ``max_labelled`` labelled ids, chosen by a hash of the id."""
    rows = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    toxic = F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic")
    rows = rows.groupBy("doc_id").agg(toxic)
    many = rows.count()
    if many > max_labelled:
        parts = 1 << 20
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < int(parts * max_labelled / many))
    return rows.withColumnRenamed("doc_id", "id")


def learn_weights(docs: DataFrame, sample: DataFrame, decoder: Decoder, least: int, odds: float) -> tuple[dict[str, float], float]:
    """Weights of telling features, and the prior log-odds, from the documents of ``sample``."""
    held = shared(docs.sparkSession, decoder)

    def run(batches):
        read = Reader(held())
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def table() -> pa.RecordBatch:
            features = list(counts[0].keys() | counts[1].keys())
            columns = [features, [counts[1][f] for f in features], [counts[0][f] for f in features]]
            kinds = [pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            counts[0].clear(), counts[1].clear()
            return pa.RecordBatch.from_arrays(arrays, ["feature", "toxic", "clean"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[toxic].update(read.features(text.as_py()))
                counts[toxic][""] += 1
                if len(counts[0]) + len(counts[1]) > HELD:
                    yield table()
        yield table()

    rows = docs.join(F.broadcast(sample), "id")
    rows = docs.join(F.broadcast(without_copies(rows.select("id", "toxic", "text"))), "id").select("text", "toxic")
    found = rows.mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature")
    found = found.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    all_rows = found.where("feature = ''").first()
    n_toxic, n_clean = (all_rows.toxic, all_rows.clean) if all_rows else (0, 0)
    prior = math.log((n_toxic + 0.1) / (n_clean + 1))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    weight = F.log(t / c) - prior - F.sqrt(1 / t + 1 / c)
    chosen = found.where((F.col("feature") != "") & (F.col("toxic") >= least)).withColumn("weight", weight)
    return {r.feature: r.weight for r in chosen.where(F.col("weight") >= odds).collect()}, prior


def toxicity(
    docs: DataFrame, labels: DataFrame, may_learn: Column, max_labelled: int = 100_000, least: int = 5, odds: float = 2.5
) -> DataFrame:
    """``docs`` with ``score`` (0 to 1): the chance of label 1 given all telling features of the restored text.

    ``may_learn`` says, by ``doc_id``, which rows of documents and labels may be learnt from. A feature needs ``least`` toxic
    documents and a weight of ``odds``.
    """
    spark, docs = docs.sparkSession, docs.drop("score")
    training = docs.where(may_learn).select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    decoder = learn_letters(training)
    sample = labelled_sample(labels, may_learn, max_labelled)
    weights, prior = learn_weights(training, sample, decoder, least, odds)
    model = shared(spark, (decoder, weights, prior))

    def run(batches):
        decoder, weights, prior = model()
        read = Reader(decoder, weights)
        for batch in batches:
            scores = []
            for text in batch.column(batch.schema.get_field_index("text")):
                odds = prior + math.fsum(weights[f] for f in read.features(text.as_py()))
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
