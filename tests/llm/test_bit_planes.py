"""Plane files: exact round trips, ranges by the chunk index, and ids against the library."""

import io
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from linefold.llm import bit_planes
from linefold.llm.bit_planes import Encoder, encoded, read_ids, write_ids
from linefold.llm.plane_files import PlaneFile, PlaneFileWriter, from_planes, to_planes
from linefold.llm.queries import op12_bit_planes
from linefold.llm.store import fresh_path
from tokenizers import Tokenizer

FILE = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes(kind):
    rng = np.random.default_rng(0)
    for top in (1, 2, 255, 256, 50_000, 2**31, 2**32):
        for n in (0, 1, 7, 8, 100):
            values = rng.integers(0, top, n).astype("<u4")
            planes = to_planes(values, kind)
            bits = int(values.max(initial=0)).bit_length()
            assert len(planes) == (bits if kind == "bit" else -(-bits // 8))
            assert (from_planes(planes, n, 4, kind) == values).all()
    wide = np.array([0, 2**63 + 5, 17], "<u8")
    assert (from_planes(to_planes(wide, kind), 3, 8, kind) == wide).all()


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_file(kind):
    rng = random.Random(1)
    docs = [(rng.choice([None, -5, i, 2**62]), np.array([rng.randrange(2**17) for _ in range(rng.choice([0, 1, 5, 300]))], "<u4")) for i in range(80)]
    file = io.BytesIO()
    writer = PlaneFileWriter(file, 64, kind)
    for doc_id, ids in docs:
        writer.add(doc_id, ids)
    writer.close()
    stored, place, flat = PlaneFile(file), 0, np.concatenate([ids for _, ids in docs])
    for (doc_id, start, ids), (wanted, theirs) in zip(stored.documents(), docs, strict=True):
        assert doc_id == wanted and start == place and (ids == theirs).all()
        place += len(ids)
    for _ in range(50):
        a, b = sorted(rng.randint(0, len(flat)) for _ in range(2))
        assert (stored.ids(a, b) == flat[a:b]).all()
    assert stored.ids(3, 3).size == 0 and len(stored.offsets) == -(-len(flat) // 64)


def test_damaged_file():
    file = io.BytesIO()
    writer = PlaneFileWriter(file, 8, "byte")
    writer.add(1, np.arange(20, dtype="<u4"))
    writer.close()
    data = bytearray(file.getvalue())
    data[-30] ^= 1
    with pytest.raises(ValueError):
        PlaneFile(io.BytesIO(bytes(data)))


def test_ids_of_the_library():
    spec = open(FILE, encoding="utf-8").read()
    library, encoder, rng = Tokenizer.from_file(FILE), Encoder(spec), random.Random(3)
    pieces = ["the", " The", "'s", " ", "  ", "\n\n", "\t", "don't", "<|endoftext|>", "é", "日本", "🙂", " ", " ", "\x1c", "\x85",
              "1234", "...", "͸", "​", "x" * 60, "!!", "\r\n", "<|endof", "́"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(2000)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert max(map(len, encoder.known)) <= bit_planes.SHORT


def test_forgetting(monkeypatch):
    monkeypatch.setattr(bit_planes, "REMEMBERED", 3)
    spec, library = open(FILE, encoding="utf-8").read(), Tokenizer.from_file(FILE)
    encoder = Encoder(spec)
    for text in ("one two three four", "three four five", "", "six one"):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_take_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = Encoder(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    text = "Some  words, and\nmore"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_table(spark, docs_of, odd_rows, kind):
    library = Tokenizer.from_file(FILE)
    path = fresh_path(spark, "ids")
    table = docs_of(odd_rows).withColumnRenamed("slot", "ids").withColumnRenamed("bucket", "row")
    write_ids(encoded(table, FILE, 2), path, block=1000, planes=kind)
    got = sorted(read_ids(spark, path).collect(), key=lambda r: r.start)
    order = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    place = 0
    for row, (_, text) in zip(got, order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.start, row.n_tokens, np.frombuffer(row.ids, "<u4").tolist()) == (place, len(ids), ids)
        place += len(ids)
    with pytest.raises(Exception, match="has a table already"):
        write_ids(encoded(table, FILE), path)
    assert read_ids(spark, path).count() == len(odd_rows)


def test_no_documents(spark, docs_of):
    path = fresh_path(spark, "ids")
    write_ids(encoded(docs_of([]), FILE, 2), path)
    assert read_ids(spark, path).collect() == []


def test_many_files(spark):
    """Partitions without rows, and tasks with several files."""
    rows = spark.range(0, 30, 1, 3).filter("id < 10 or id >= 20").selectExpr("id doc_id", "unhex('0100000002000000') ids")
    path = fresh_path(spark, "ids")
    write_ids(rows, path, block=1)
    assert [tuple(r)[:3] for r in sorted(read_ids(spark, path).collect())] == [(i if i < 10 else i + 10, 2 * i, 2) for i in range(20)]


def test_query_by_the_library(spark):
    library = Tokenizer.from_file(FILE)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    place, got = 0, {r.doc_id: r for r in op12_bit_planes(spark, SF).collect()}
    assert len(got) == len(texts)
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        row = got[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (place, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        place += len(ids)


def test_words_with_and_without_a_mark_are_one_piece():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = Encoder(file.read())
    for text in ("one, two. one two! 7: x2; ab.c, (d), café. \n\nEnd.\nnext, a,, b², , !", "a.", ".", " .", "a .b", "it's, _x_, 中文. ½;"):
        assert encoder.encode(text) == encoder.library(text)
    assert encoder.cut("one, two. one") == ["one", ",", " two", ".", " one"]


def test_half_a_million_words_are_merged_once():
    with open(FILE, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    merged, piece = [], encoder.piece
    encoder.piece = lambda text: merged.append(text) or piece(text)
    texts = [" ".join(f"w{i}" for i in range(k, k + 1000)) for k in range(0, 500_000, 1000)]
    first = [encoder.encode(text) for text in texts]
    once = len(merged)
    assert [encoder.encode(text) for text in texts] == first and len(merged) == once
    assert first[7] == encoder.library(texts[7])


def test_most_words_are_cut_in_one_pass():
    """A word without a mark is found by the first alternative, and so is one before a mark."""
    with open(FILE, encoding="utf-8") as file:
        encoder = Encoder(file.read())
    first = re.compile(encoder.cut.__self__.pattern.partition("|(?<=[^\\W_])[")[0])
    for piece in ("one", " two", " -three-", "\n\nfour"):
        assert first.match(piece + " x").group() == piece and first.match(piece).group() == piece
    assert first.match(" two, x").group() == " two" and not first.match("(d), x")
