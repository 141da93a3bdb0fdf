"""Token ids as binary files of bit or byte planes.

``encoded`` range-partitions documents by id, so that tasks hold them in order, and encodes them; ``write_ids`` writes each task's ids
to files of its own (``plane_files.py`` has the format), and ``read_ids`` reads them back with every document's place in the whole
sequence. Reading and writing are a Spark data source, so its protocol holds: tasks write files under names nobody else uses, only
the manifest that the commit writes makes them part of the table, and files of lost or repeated tasks are never read. The
manifest has one line per file of ``FILE_IDS`` ids.

A byte-level BPE never joins characters over the start of white space. Tasks cut texts there, encode each piece once with the
tokenizers library's model, pre-token by pre-token, and remember short ones in a bounded table. Texts that hold a special string or
characters that Unicode versions may class apart, and other kinds of tokenizers, go to the library whole.

Null and empty texts have no ids but the end id. Rows with one id keep the order of the input, rows without id come first. Every row
gives a row. Other columns of the input don't matter and aren't kept.
"""

from __future__ import annotations

import json
import re
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from tokenizers import Tokenizer

from linefold.llm.plane_files import BYTE, PlaneFile, PlaneFileWriter
from linefold.llm.token_counts import PRE_TOKEN, SURE, byte_letters, check_spec

#: Fixed value: the white space of the Unicode standard.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Marks that are pre-tokens of their own after a letter.
MARKS = frozenset(".,;:!?")
BLOCK = 1 << 16
#: A file is closed after the document that brings it to so many ids, or documents.
FILE_IDS, FILE_DOCS = 1 << 24, 1 << 20
#: Pieces in each of two generations, and their longest.
REMEMBERED, SHORT = 600_000, 48
BATCH_BYTES = 1 << 22
#: Fixed value: array code of unsigned 32-bit integers.
WORD = "I"
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
MANIFEST = "manifest.json"
SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


class Encoder:
    """Token ids of texts, as little-endian unsigned 32-bit integers, as the library gives them for ``spec``."""

    def __init__(self, spec: str) -> None:
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        try:
            check_spec(spec)
        except ValueError:
            self.pieces_hold = False
        else:
            self.pieces_hold = True
        self.special = re.compile("|".join(re.escape(t["content"]) for t in json.loads(spec)["added_tokens"]) or "(?!)")
        self.unsure = re.compile(f"[^\0-{SURE}]")
        # a mark between a letter or number and white space is a piece, so that words with and without one are the same piece;
        # most words have none, and are found in one pass
        marks, ends = "".join(sorted(MARKS)), f"(?=[{WHITE}]|\\Z)"
        word = f"[{WHITE}]*+[^{WHITE}{marks}]++(?:{ends}|(?<=[^\\W_])(?=[{marks}]{ends}))"
        mark = f"(?<=[^\\W_])[{marks}]{ends}"
        self.cut = re.compile(f"{word}|{mark}|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.pre_tokens, self.letters = regex.compile(PRE_TOKEN).findall, byte_letters()
        self.space = " ".translate(self.letters)
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        self.aged: dict[str, bytes] = {}

    def library(self, text: str) -> bytes:
        return array(WORD, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, letters: str) -> bytes:
        """Ids of a pre-token, given by the letters that stand for its bytes."""
        return array(WORD, [token.id for token in self.model.tokenize(letters)]).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of a piece, merged inside its pre-tokens."""
        spaced = text[0] == " "
        word = text[1:] if spaced else text
        # letters after at most one space are one pre-token; ASCII letters stand for themselves
        if word.isalpha():
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.letters)
            return self.merged(self.space + word if spaced else word)
        if text[-1] in MARKS and text[-2:-1].isalpha():
            return self.of(text[:-1]) + self.of(text[-1])
        if text[0] == "\n" and text[1:2].isalpha():
            return self.of("\n") + self.of(text[1:])
        parts = self.pre_tokens(text)
        return b"".join([self.merged(part.encode().decode("latin-1").translate(self.letters)) for part in parts])

    def of(self, piece: str) -> bytes:
        """Ids of a piece; short ones are remembered while they are met again."""
        # pieces that come here are rarely among the latest
        ids = self.aged.get(piece) or self.known.get(piece) or self.piece(piece)
        if len(piece) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.known, self.aged = {}, self.known
            self.known[piece] = ids
        return ids

    def goes_whole(self, text: str) -> bool:
        if not self.pieces_hold or self.special.search(text):
            return True
        return not text.isascii() and bool(self.unsure.search(text)) and any(unicodedata.category(c) == "Cn" for c in set(text))

    def encode(self, text: str) -> bytes:
        if self.goes_whole(text):
            return self.library(text)
        pieces = self.cut(text)
        ids = list(map(self.known.get, pieces))
        at = -1
        for _ in range(ids.count(None)):
            at = ids.index(None, at + 1)
            ids[at] = self.of(pieces[at])
        return b"".join(ids)


def encoded(docs: DataFrame, tokenizer_file: str, end_id: int | None = None, text_column: str = "text") -> DataFrame:
    """``(doc_id, ids)`` in ascending order of ``doc_id`` over the partitions and inside them."""
    with open(tokenizer_file, encoding="utf-8") as file:
        held = docs.sparkSession.sparkContext.broadcast({"spec": file.read()})
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text_column).alias("text"))
    # the place in the input parts rows of one id, however many there are
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (F.col("doc_id").asc_nulls_first(), F.col("row"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches):
        # a Python worker keeps the value, and so the pieces it knows, for its later tasks
        if "encoder" not in held.value:
            held.value["encoder"] = Encoder(held.value["spec"])
        encoder = held.value["encoder"]
        for batch in batches:
            ids, size, place = [], 0, 0
            for i, text in enumerate(batch.column(1), 1):
                ids.append(encoder.encode(text.as_py() or "") + end)
                size += len(ids[-1])
                if size >= BATCH_BYTES or i == len(batch):
                    arrays = [batch.column(0).slice(place, len(ids)), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "ids"])
                    ids, size, place = [], 0, i

    return rows.mapInArrow(run, "doc_id long, ids binary")


def at(path: str) -> tuple[fs.FileSystem, str]:
    """File system and folder of a path or URI that all executors reach."""
    for scheme, plain in (("file:///", "/"), ("file:/", "/"), ("s3a://", "s3://")):
        if path.startswith(scheme):
            path = plain + path[len(scheme) :]
    return fs.FileSystem.from_uri(path)


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its partition, and (name, ids, documents) of its files in order."""

    partition: int
    files: list[tuple[str, int, int]]


@dataclass
class FilePart(InputPartition):
    name: str
    first: int


class PlanesSource(DataSource):
    """Format ``id_planes``. Options: ``path``; for writing ``block`` (ids a block) and ``planes`` (``bit`` or ``byte``)."""

    @classmethod
    def name(cls) -> str:
        return "id_planes"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PlanesReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        block, planes = int(self.options.get("block", BLOCK)), self.options.get("planes", BYTE)
        return PlanesWriter(self.options["path"], block, planes, overwrite)


class PlanesWriter(DataSourceArrowWriter):
    """Writes ``(doc_id, ids)`` rows; the order of partitions and rows is the order of the sequence."""

    def __init__(self, path: str, block: int, planes: str, overwrite: bool) -> None:
        self.path, self.block, self.planes, self.overwrite = path, block, planes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = at(self.path)
        store.create_dir(folder, recursive=True)
        partition, files = TaskContext.get().partitionId(), []
        file = writer = None
        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    name = f"ids-{partition:06d}-{len(files):04d}-{uuid.uuid4().hex}"
                    file = store.open_output_stream(f"{folder}/{name}")
                    writer = PlaneFileWriter(file, self.block, self.planes)
                buffer = ids.as_buffer()
                writer.add(doc_id, np.frombuffer(buffer, "<u4") if buffer else np.zeros(0, "<u4"))
                if writer.n_ids >= FILE_IDS or len(writer.lengths) >= FILE_DOCS:
                    files.append(self.closed(name, file, writer))
                    writer = None
        if writer is not None:
            files.append(self.closed(name, file, writer))
        return Written(partition, files)

    @staticmethod
    def closed(name: str, file, writer: PlaneFileWriter) -> tuple[str, int, int]:
        writer.close()
        file.close()
        return name, writer.n_ids, len(writer.lengths)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = at(self.path)
        store.create_dir(folder, recursive=True)
        place = f"{folder}/{MANIFEST}"
        if not self.overwrite and store.get_file_info(place).type != fs.FileType.NotFound:
            raise FileExistsError(f"{self.path} has a table already")
        files, first = [], 0
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for name, n_ids, n_docs in message.files:
                files.append({"name": name, "first": first, "ids": n_ids, "docs": n_docs})
                first += n_ids
        with store.open_output_stream(place) as out:
            out.write(json.dumps({"block": self.block, "planes": self.planes, "files": files}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = at(self.path)
        for message in messages:
            for name, _, _ in message.files if message else ():
                store.delete_file(f"{folder}/{name}")


class PlanesReader(DataSourceReader):
    """Reads the files that the manifest names, one task each."""

    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[FilePart]:
        store, folder = at(self.path)
        with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
            return [FilePart(f["name"], f["first"]) for f in json.loads(file.read())["files"]]

    def read(self, partition: FilePart | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # the table has no files
            return
        store, folder = at(self.path)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "start", "n_tokens", "ids"]

        def batch(rows):
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        rows, size = [], 0
        with store.open_input_file(f"{folder}/{partition.name}") as file:
            for doc_id, place, ids in PlaneFile(file).documents():
                rows.append((doc_id, partition.first + place, len(ids), ids.tobytes()))
                size += 4 * len(ids) + 24
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)


def write_ids(rows: DataFrame, path: str, block: int = BLOCK, planes: str = BYTE) -> None:
    """Write ``(doc_id, ids)`` rows in the order of their partitions."""
    spark = rows.sparkSession
    spark.dataSource.register(PlanesSource)
    writer = rows.select("doc_id", "ids").write.format("id_planes").options(path=path, block=block, planes=planes)
    before = spark.conf.get(BATCH_CONF, None)
    # texts differ a lot in length, so batches are bounded by bytes
    spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    try:
        writer.mode("append").save()
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)``: ``start`` counts all ids before the document, ``ids`` are ``<u4`` bytes."""
    spark.dataSource.register(PlanesSource)
    return spark.read.format("id_planes").load(path)
