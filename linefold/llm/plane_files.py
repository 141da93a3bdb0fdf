"""The file format of token ids: blocks of ids as bit or byte planes, each compressed with zstandard.

A file is ``MAGIC``, the blocks, the footer and the trailer. A block, and every array of the footer, is a *section*: the number
of values, bytes a value, planes, the compressed size of each plane, then the planes, lowest first. Plane k holds bit (byte) k of
all values, so planes above the largest value are not stored, and the high ones, which hardly change, shrink to nothing. The footer
has the chunk index (offset and number of ids of each block) and the documents (id, whether the id is null, number of ids); the
trailer has the footer's place, its crc32 and ``MAGIC`` again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import zstandard

#: Fixed values of the format.
MAGIC = b"IDPLANE1"
HEAD, SIZE, TRAILER = "<QBBB", "<I", "<QI8s"
BIT, BYTE = "bit", "byte"
LEVEL = 3


def to_planes(values: np.ndarray, kind: str) -> list[np.ndarray]:
    """Planes of unsigned values, lowest first, without the empty ones on top."""
    if not len(values):
        return []
    width = values.dtype.itemsize
    used = int(values.max()).bit_length()
    table = np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    if kind == BYTE:
        return list(np.ascontiguousarray(table[:, : -(-used // 8)].T))
    bits = np.unpackbits(table[:, : -(-used // 8)], axis=1, bitorder="little")[:, :used]
    return list(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little"))


def from_planes(planes: list[np.ndarray], n: int, width: int, kind: str) -> np.ndarray:
    """The values of ``to_planes``."""
    table = np.zeros((n, width), np.uint8)
    if planes and kind == BYTE:
        table[:, : len(planes)] = np.stack(planes, axis=1)
    elif planes:
        bits = np.unpackbits(np.stack(planes), axis=1, count=n, bitorder="little")
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        table[:, : packed.shape[1]] = packed
    return table.reshape(-1).view(f"<u{width}")


def section(values: np.ndarray, kind: str, squeeze: zstandard.ZstdCompressor) -> bytes:
    planes = [squeeze.compress(p.tobytes()) for p in to_planes(values, kind)]
    head = struct.pack(HEAD, len(values), values.dtype.itemsize, kind == BIT, len(planes))
    return b"".join([head, *(struct.pack(SIZE, len(p)) for p in planes), *planes])


def take(file: BinaryIO, form: str) -> tuple:
    return struct.unpack(form, file.read(struct.calcsize(form)))


def read_section(file: BinaryIO) -> np.ndarray:
    """The values of the section that starts here."""
    n, width, bit, n_planes = take(file, HEAD)
    sizes = [take(file, SIZE)[0] for _ in range(n_planes)]
    expand = zstandard.ZstdDecompressor()
    planes = [np.frombuffer(expand.decompress(file.read(s)), np.uint8) for s in sizes]
    return from_planes(planes, n, width, BIT if bit else BYTE)


class PlaneFileWriter:
    """Writes documents' ids, in the order they come, to an open file."""

    def __init__(self, file: BinaryIO, block: int, kind: str) -> None:
        self.file, self.block, self.kind = file, block, kind
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.offsets, self.counts = [], []
        self.doc_ids, self.lengths = [], []
        self.at = self.put(MAGIC, 0)

    def put(self, data: bytes, at: int) -> int:
        self.file.write(data)
        return at + len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.block:
            self.flush(self.n_waiting // self.block * self.block)

    def flush(self, n: int) -> None:
        """Write the first ``n`` waiting ids in blocks."""
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for start in range(0, n, self.block):
            part = ids[start : min(start + self.block, n)]
            self.offsets.append(self.at)
            self.counts.append(len(part))
            self.at = self.put(section(part, self.kind, self.squeeze), self.at)
        self.waiting, self.n_waiting = [ids[n:].copy()], len(ids) - n

    def close(self) -> None:
        self.flush(self.n_waiting)
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        docs = np.array([d or 0 for d in self.doc_ids], "<i8").view("<u8")
        arrays = [np.array(a, "<u8") for a in (self.offsets, self.counts)] + [docs, null, np.array(self.lengths, "<u8")]
        footer = b"".join(section(a, self.kind, self.squeeze) for a in arrays)
        self.put(footer + struct.pack(TRAILER, self.at, zlib.crc32(footer), MAGIC), self.at)


class PlaneFile:
    """Reads a file: its documents, and any range of its ids by the chunk index."""

    def __init__(self, file: BinaryIO) -> None:
        self.file = file
        end = file.seek(-struct.calcsize(TRAILER), 2)
        footer, crc, magic = take(file, TRAILER)
        file.seek(footer)
        if magic != MAGIC or zlib.crc32(file.read(end - footer)) != crc:
            raise ValueError("not a whole file of token ids")
        file.seek(footer)
        self.offsets, counts, docs, self.null, self.lengths = (read_section(file) for _ in range(5))
        self.doc_ids = docs.view("<i8")
        self.ends = np.cumsum(counts, dtype=np.int64)

    def block(self, k: int) -> np.ndarray:
        self.file.seek(int(self.offsets[k]))
        return read_section(self.file)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` up to ``stop``; only their blocks are read."""
        parts = [np.zeros(0, "<u4")]
        k = int(np.searchsorted(self.ends, start, side="right"))
        while start < stop and k < len(self.ends):
            first = int(self.ends[k - 1]) if k else 0
            parts.append(self.block(k)[start - first : stop - first])
            start, k = int(self.ends[k]), k + 1
        return np.concatenate(parts)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, place of its first id, ids) of each document, each block read once."""
        waiting, held, k, place = [], 0, 0, 0
        for doc, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lengths.tolist(), strict=True):
            while held < n:
                waiting.append(self.block(k))
                held, k = held + len(waiting[-1]), k + 1
            ids = waiting[0] if len(waiting) == 1 else np.concatenate([np.zeros(0, "<u4"), *waiting])
            yield None if null else doc, place, ids[:n]
            waiting, held, place = [ids[n:]], held - n, place + n
