"""Periodic runs of words, by block convolution.

A run is a stretch with smallest period q, of at least max(``least``, 3 q) words, that no neighbouring word extends. At every dyadic
scale L, texts are cut into blocks of L words. If a run's period is in L ... 2 L - 1 (for the smallest scale: below 2 L), one of its
blocks occurs again exactly one period on, for its first n - q >= 2 L - 1 words hold a whole block. ``convolution.zero_mismatches`` finds
the distances at which a block occurs again; each is extended to both sides as far as the words agree, and of equal stretches the one
with the smallest distance is the run. All lengths are exact: extensions compare names of words and of groups of 2^k words (equal
names, equal words), not hashes.

A block with a word that does not come back within 2 L words occurs in no such window and isn't transformed. Work and memory are n log n
for n words whatever they are; many texts are worked on together, each word of one text being another code than in the next. No
shuffle, no broadcast. The rows of a text, however long, are one row of the input.

Null and blank texts have no words and no run. Every row gives a row, repeated rows too; other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from linefold.llm.convolution import zero_mismatches

#: Fixed value: words are what lies between ASCII white space.
WORD = re.compile("[^\x20\x09-\x0D]+")
SMALLEST = 8
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
ADDED = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("best", RUN), T.StructField("collapsed", T.StringType())]
#: Words of texts that are worked on together; a longer text is worked on alone.
TOGETHER = 1 << 18


def coded(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' words one after the other, equal for equal words of one text only, and where texts end."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    words = np.empty(ends[-1] if len(ends) else 0, object)
    words[:] = [w for t in texts for w in t]
    codes = pd.factorize(words)[0].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return pd.factorize(owner * (len(codes) + 1) + codes)[0].astype(np.int64), ends


def next_places(codes: np.ndarray) -> np.ndarray:
    """Words up to the next place of the same code (the number of all words if there is none)."""
    order = np.argsort(codes, kind="stable")
    gaps = np.full(len(codes), len(codes), np.int64)
    same = codes[order[1:]] == codes[order[:-1]]
    gaps[order[:-1][same]] = (order[1:] - order[:-1])[same]
    return gaps


def group_names(codes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the 2^k words from each place, for all k up to ``longest`` words: equal where the words are."""
    names = [codes.astype(np.int32)]
    while 2 ** len(names) <= longest:
        half, last = 2 ** (len(names) - 1), names[-1].astype(np.int64)
        names.append(pd.factorize(last[:-half] * (len(codes) + 1) + last[half:])[0].astype(np.int32))
    return names


def agreement(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words from places ``a`` and ``b`` (a < b) on."""
    n, out = len(names[0]), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            fits = np.flatnonzero(b + out + 2**k <= n)
            same = names[k][(a + out)[fits]] == names[k][(b + out)[fits]]
            out[fits[same]] += 2**k
    return out


def agreement_back(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal words before places ``a`` and ``b`` (a < b)."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            fits = np.flatnonzero(a - out - 2**k >= 0)
            same = names[k][(a - out)[fits] - 2**k] == names[k][(b - out)[fits] - 2**k]
            out[fits[same]] += 2**k
    return out


def seeds(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) at which a block of some scale occurs again in its text."""
    begins = np.concatenate([[0], ends[:-1]])
    sizes, values = ends - begins, codes.astype(np.uint64)
    gaps = next_places(codes)
    found, length = [], SMALLEST
    while 3 * length <= sizes.max(initial=0) or length == SMALLEST:
        # blocks from which at least the smallest distance fits into the text
        aheads = (0, length) if length == SMALLEST else (length,)
        per_text = np.maximum(0, (sizes - aheads[-1]) // length if length > SMALLEST else sizes // length)
        text = np.repeat(np.arange(len(sizes)), per_text)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        starts = begins[text] + nth * length
        if len(starts):
            back_soon = np.concatenate([[0], np.cumsum(gaps < 2 * length)])
            starts = starts[back_soon[starts + length] - back_soon[starts] == length]
        for ahead in aheads if len(starts) else ():
            start, distance = zero_mismatches(values, starts, length, ahead)
            place = distance * len(codes) + start
            # the block before has the same distance, and so the same stretch
            first = (distance > 0) & ~np.isin(place - length, place)
            found.append((start[first], distance[first]))
        length *= 2
    start, distance = (np.concatenate([np.zeros(0, np.int64), *part]) for part in zip(*found, strict=True)) if found else (gaps[:0],) * 2
    return start, distance


def runs_of(texts: list[list], least: int = 24) -> list[np.ndarray]:
    """The runs of each text (a list of words), as rows (start, length, period) by start and period."""
    codes, ends = coded(texts)
    none = np.zeros((0, 3), np.int64)
    start, distance = seeds(codes, ends) if len(codes) else (none[:, 0],) * 2
    if not len(start):
        return [none] * len(texts)
    # only texts with seeds are named
    owner = np.searchsorted(ends, start, side="right")
    begins = np.concatenate([[0], ends[:-1]])
    kept = np.unique(owner)
    pieces = [codes[begins[t] : ends[t]] for t in kept]
    shift = np.zeros(len(texts), np.int64)
    shift[kept] = np.cumsum([0, *map(len, pieces[:-1])]) - begins[kept]
    names = group_names(np.concatenate(pieces), max(map(len, pieces)))
    a = start + shift[owner]
    right = agreement(names, a, a + distance)
    left = agreement_back(names, a, a + distance)
    first, size = start - left, left + right + distance
    long = size >= np.maximum(least, 3 * distance)
    rows = np.stack([owner, first - begins[owner], size, distance], axis=1)[long]
    rows = rows[np.lexsort(rows.T[::-1])]
    # a multiple of a run's period has the run's stretch
    smallest = np.ones(len(rows), bool)
    smallest[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[i:j, 1:] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def in_lists(texts: Iterable[list]) -> Iterator[list[list]]:
    """Texts, as their words, in lists of about ``TOGETHER`` words."""
    held, size = [], 0
    for words in texts:
        if held and size + len(words) > TOGETHER:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:n]) == 0


def greatest(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length / period; of equal ones the first, then that of the smallest period."""
    best = None
    for start, length, period in runs.tolist():
        if best is None or length * best[2] > best[1] * period:
            best = (start, length, period)
    return best


def find_runs(docs: DataFrame, least: int = 24, text_column: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (by start and period; words are numbered from 0), ``best`` (the run of greatest
    length / period or null) and ``collapsed``: the words, joined by spaces, without those that repeat a run's first period.

    Existing columns with these names are replaced; the text column goes, as ``collapsed`` stands for it.
    """
    names = [f.name for f in ADDED]
    kept = [c for c in docs.columns if c not in (*names, text_column)]
    docs = docs.select(text_column, *kept)
    types = [pa.int64(), pa.list_(pa.struct([(f.name, pa.int64()) for f in RUN])), pa.struct([(f.name, pa.int64()) for f in RUN]), pa.string()]
    parts = tuple(f.name for f in RUN)

    def run(batches):
        for batch in batches:
            place = 0
            for texts in in_lists(WORD.findall(t.as_py() or "") for t in batch.column(0)):
                rows = []
                for words, runs in zip(texts, runs_of(texts, least), strict=True):
                    keep = kept_words(len(words), runs)
                    left = words if keep.all() else [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    best = greatest(runs)
                    found = [dict(zip(parts, r, strict=True)) for r in runs.tolist()]
                    rows.append((len(words), found, best and dict(zip(parts, best, strict=True)), " ".join(left)))
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
                same = [batch.column(i).slice(place, len(rows)) for i in range(1, len(kept) + 1)]
                yield pa.RecordBatch.from_arrays([*same, *arrays], [*kept, *names])
                place += len(rows)

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in kept), *ADDED]))
