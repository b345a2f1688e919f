"""Bit packing by round trips and against shifts of whole numbers; token files against the library."""

from __future__ import annotations

import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import bit_packing, token_files
from kindred.llm.queries import QUERIES
from kindred.session import work_folder

SF_DIR = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("width", range(1, 33))
def test_packing(width):
    draw = random.Random(width)
    for size in (0, 1, 7, 8, 9, 100, 1000):
        ids = [draw.randrange(1 << width) for _ in range(size)]
        packed = bit_packing.pack(np.array(ids, np.uint32), width)
        # Lowest bit first: the bytes are one whole number in which id k stands at bit k * width.
        assert int.from_bytes(packed, "little") == sum(n << (k * width) for k, n in enumerate(ids))
        assert len(packed) == -(-size // 8) * width
        assert bit_packing.unpack(packed, width)[:size].tolist() == ids


def test_packing_refuses_large_ids():
    with pytest.raises(ValueError, match="more than 3 bits"):
        bit_packing.pack(np.array([8], np.uint32), 3)


@pytest.mark.parametrize("size, bits", [(1, 1), (2, 1), (3, 2), (49_408, 16), (65_536, 16), (65_537, 17)])
def test_width(size, bits):
    assert bit_packing.width_of(size) == bits


@pytest.mark.parametrize("width, block", [(16, 64), (11, 8), (17, 1 << 16)])
def test_file(width, block):
    draw = random.Random(width)
    docs = [
        (None if n % 9 == 4 else n - 5, [draw.randrange(1 << width) for _ in range(draw.choice([0, 1, 5, 300]))])
        for n in range(50)
    ]
    stream = io.BytesIO()
    writer = bit_packing.Writer(stream, width, block)
    for doc_id, ids in docs:
        writer.add(doc_id, np.array(ids, np.uint32))
    writer.close()
    reader = bit_packing.Reader(stream)
    everything = [i for _, ids in docs for i in ids]
    assert reader.n_ids == len(everything) and reader.n_docs == len(docs)
    for at_once in (1, 100, 1 << 20):
        found = [(doc_id, ids.tolist()) for doc_id, _, ids in reader.documents(at_once)]
        assert found == docs
    for _ in range(200):
        first = draw.randrange(len(everything))
        count = draw.randrange(len(everything) - first + 1)
        assert reader.ids(first, count).tolist() == everything[first : first + count]
    assert reader.document(7).tolist() == docs[7][1]
    with pytest.raises(IndexError):
        reader.ids(len(everything), 1)


def test_random_access_reads_only_the_blocks_asked_for():
    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            self.taken += size
            return super().read(size)

    stream = Counting()
    writer = bit_packing.Writer(stream, 16, 1024)
    writer.add(1, np.arange(60_000, dtype=np.uint32))
    writer.close()
    reader = bit_packing.Reader(stream)
    stream.taken = 0
    assert reader.ids(30_000, 10).tolist() == list(range(30_000, 30_010))
    assert stream.taken == 1024 * 2


def test_cut_file():
    stream = io.BytesIO()
    writer = bit_packing.Writer(stream, 16)
    writer.add(1, np.arange(100, dtype=np.uint32))
    writer.close()
    with pytest.raises(ValueError, match="cut off"):
        bit_packing.Reader(io.BytesIO(stream.getvalue()[:-3]))
    with pytest.raises(ValueError, match="cut off"):
        bit_packing.Reader(io.BytesIO())


def expected(rows, end_id=1):
    """start, n_tokens and crc32 of every (doc_id, text) in the order of ids."""
    tokenizer, start, out = Tokenizer.from_file(VOCABULARY), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id")
    found = QUERIES["op11_token_files"].build(spark, SF_DIR).orderBy("start").collect()
    assert [tuple(row) for row in found] == expected([(r["doc_id"], r["text"]) for r in docs.collect()])


ODD = [
    "", None, " ", "\n\t\r ", "a\x1fb\x85c d", "İΣς é é 漢字 각 각", "don't they're I'LL", "<|endoftext|> x<|startoftext|>",
    "<|endof text|>", "word " * 5000, "x" * 3000, "漢" * 2000, "a  b c　d", "́ ́", "\x00 a", "😀 1234",
]


@pytest.mark.parametrize("file_chars", [1 << 25, 40])
def test_odd_texts(spark, file_chars, monkeypatch):
    """However the documents are dealt into files, and whatever the table of pieces holds."""
    monkeypatch.setattr(token_files, "RECENT_PARTS", 8 if file_chars == 40 else 1 << 18)
    rows = [(3 * n - 9, text) for n, text in enumerate(ODD)]
    frame = spark.createDataFrame(rows[::-1], SCHEMA).withColumns({n: F.lit("x") for n in ("row", "digest", "ids")})
    folder = work_folder(spark, "odd")
    token_files.write_tokens(frame, VOCABULARY, folder, end_id=1, block_ids=16, file_chars=file_chars)
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    got = [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found]
    assert got == expected(rows)
    assert spark.read.parquet(f"{folder}/manifest").count() == (1 if file_chars > 40 else len(rows))


def test_encoder():
    """Any mix of letters, signs, spaces and special tokens, at any size of the table of parts."""
    with open(VOCABULARY, encoding="utf-8") as file:
        encoder = token_files.Encoder(file.read())
    tokenizer, draw = Tokenizer.from_file(VOCABULARY), random.Random(6)
    pieces = ["don", "'", "t", "'re", "S", " ", " ", "\n", "\t", "\x0b", "\x1c", "é", "İ", "Σ", "12", "!", "...", "<|", "|>",
              "<|endoftext|>", "ENDOFTEXT", "漢", "\u3000", "'", "_", "~", "\x7f", "\u0301", "thousand"]
    for _ in range(3000):
        text = "".join(draw.choices(pieces, k=draw.randint(0, 30)))
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_recent_parts(monkeypatch):
    monkeypatch.setattr(token_files, "RECENT_PARTS", 10)
    asked = []
    recent = token_files.Recent(lambda part: asked.append(part) or part.encode())
    for n in range(100):
        assert recent["usual"] == b"usual" and recent[str(n)] == str(n).encode()
    assert asked.count("usual") == 1 and len(recent) + len(recent.older) <= 21
    assert recent["x" * 65] == b"x" * 65 and "x" * 65 not in recent


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "one two")] * 3 + [(5, "three"), (None, "no id"), (None, "no id"), (-2, None)]
    folder = work_folder(spark, "repeated")
    token_files.write_tokens(spark.createDataFrame(rows, SCHEMA), VOCABULARY, folder, file_chars=5)
    found = token_files.read_tokens(spark, folder).orderBy("start", "n_tokens").collect()
    assert [r["doc_id"] for r in found] == [None, None, -2, 5, 5, 5, 5]
    starts = np.cumsum([0, *(r["n_tokens"] for r in found)])
    assert [r["start"] for r in found if r["n_tokens"]] == [s for s, r in zip(starts, found) if r["n_tokens"]]
    tokenizer = Tokenizer.from_file(VOCABULARY)
    sizes = [len(tokenizer.encode(text or "", add_special_tokens=False).ids) for _, text in rows]
    assert sorted(r["n_tokens"] for r in found) == sorted(sizes)


def test_empty_table(spark):
    folder = work_folder(spark, "empty")
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), VOCABULARY, folder)
    assert token_files.read_tokens(spark, folder).count() == 0


def test_files_of_lost_tasks_are_not_read(spark):
    """A file that no row of the manifest names is not part of the result."""
    folder = work_folder(spark, "lost")
    token_files.write_tokens(spark.createDataFrame([(1, "a b")], SCHEMA), VOCABULARY, folder)
    with open(f"{folder}/000000-lost.bits", "wb") as file:
        file.write(b"half a file")
    assert token_files.read_tokens(spark, folder).count() == 1


def test_vocabularies_that_keep_spaces_are_refused(spark):
    with pytest.raises(ValueError, match="white space"):
        token_files.write_tokens(
            spark.createDataFrame([(1, "a b")], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"), "/nowhere"
        )
