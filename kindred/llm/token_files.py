"""Token ids of a corpus in files of fixed-width bits, in the order of document ids.

``write_tokens`` deals the texts into ranges of ids, sorts each and streams it through the public
tokenizer into one file per range (``bit_packing`` has the format). Every task writes a file with a
name of its own and returns it as a row of the manifest, a table that Spark commits; a task that is
lost leaves a file that no manifest names, and its second run writes another. ``read_tokens`` reads
the files named there.

Texts are cut at spaces and line ends before they are encoded: neither is ever part of a token in
vocabularies that drop white space, so the ids of the pieces in order are those of the text. Ids
of recent short parts are kept in a table of bounded size. A vocabulary that keeps white space is
refused.

At scale: texts are shuffled once, by (id, digest of the text, row), so that a hot id is spread;
the number of ranges follows from the characters of all texts. A task holds one batch of texts, one
block of ids and the index of its file. ``folder`` is read and written by the tasks themselves, by
any URI that pyarrow's file systems know (file, hdfs, s3, …), and must be shared.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.llm.bit_packing import BLOCK_IDS, Reader, Writer, width_of
from kindred.llm.bpe import byte_alphabet

FILE_CHARS = 1 << 25  # characters of text per file
FILE_ROWS = 1 << 20
PIECE = re.compile(r"[^ \n]+")
# ASCII, Latin letters and signs, dashes, quotes and other marks, without spaces.
FAMILIAR = ((0x21, 0x7F), (0xA1, 0x250), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD))
LONGEST_KEPT, RECENT_PARTS = 64, 1 << 18
MANIFEST = "shard long, file string, n_docs long, n_ids long, n_bytes long"
TOKENS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class Recent(dict):
    """Ids of recent parts, in two halves: when one is full, it becomes the older one, whose parts
    move back as they are met, and what was not met since is dropped."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = self.encode(part)
            if len(part) > LONGEST_KEPT:
                return ids
        if len(self) >= RECENT_PARTS:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids


def plain_characters() -> str:
    """Familiar characters that are in NFC and whose lower case is one familiar character, so that
    the form in which the library reads them is that lower case."""
    familiar = {chr(code) for first, end in FAMILIAR for code in range(first, end)}
    return "".join(
        c
        for c in sorted(familiar)
        if c.lower() in familiar
        and unicodedata.normalize("NFC", c) == c
        and unicodedata.category(c)[0] in "LNPS"
    )


def _class_of(characters: str, kind: str) -> str:
    """The characters of a Unicode category, as the inside of a class of a pattern."""
    return "".join(re.escape(c) for c in characters if unicodedata.category(c).startswith(kind))


class Encoder:
    """Ids of texts as the tokenizers library gives them, with those of recent parts kept.

    Plain text is cut by the vocabulary's own splitting pattern, and each part goes to the
    library's model as it is. Any other piece between spaces goes through the whole library.
    """

    def __init__(self, file_text: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file_text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.symbols = dict(enumerate(byte_alphabet()))
        spec, plain = json.loads(file_text), plain_characters()
        self.lowercase = any(step["type"] == "Lowercase" for step in spec["normalizer"]["normalizers"])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

        def cut(characters: str):
            """What tells text of these characters, and what cuts it into parts."""
            own = pattern.replace(r"\s", r" \n")
            for kind in "LN":
                own = own.replace(f"\\p{{{kind}}}", _class_of(characters, kind))
            return re.compile(f"[ \n{re.escape(characters)}]*").fullmatch, re.compile(own).findall

        self.ascii = cut("".join(c for c in plain if c.isascii()))
        self.wide = cut(plain)
        # A text with the start of a special token, whole or not, is left to the library.
        self.starts = {token["content"][:2] for token in spec.get("added_tokens", [])}
        self.plain = Recent(self._part)
        self.pieces = Recent(self._piece)

    def _part(self, part: str) -> bytes:
        symbols = part if part.isascii() else part.encode().decode("latin-1").translate(self.symbols)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(symbols)])

    def _piece(self, piece: str) -> bytes:
        ids = self._plain_ids(piece)
        if ids is None:
            ids = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()
        return ids

    def _plain_ids(self, text: str) -> bytes | None:
        is_plain, parts_of = self.ascii if text.isascii() else self.wide
        if any(start in text for start in self.starts) or not is_plain(text):
            return None
        parts = parts_of(text.lower() if self.lowercase else text)
        return b"".join(map(self.plain.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        ids = self._plain_ids(text)
        if ids is None:
            ids = b"".join(map(self.pieces.__getitem__, PIECE.findall(text)))
        return ids


def can_be_cut(file_text: str) -> bool:
    """Whether the ids of a text are those of its pieces between spaces, one after the other: white
    space becomes single spaces and is dropped by the split, and nothing else looks across it."""
    spec = json.loads(file_text)
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return (
        spec["model"]["type"] == "BPE"
        and {step["type"] for step in steps} <= {"NFC", "Replace", "Lowercase"}
        and [s["content"] for s in steps if s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"}] == [" "]
        and (split.get("type"), split.get("invert"), split.get("behavior")) == ("Split", True, "Removed")
        and all(s["type"] == "ByteLevel" and not s["add_prefix_space"] and not s["use_regex"] for s in rest)
    )


def _file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    folder: str,
    end_id: int | None = None,
    block_ids: int = BLOCK_IDS,
    file_chars: int = FILE_CHARS,
) -> None:
    """Write the ids of all documents in ascending order of doc_id into ``folder``.

    ``end_id`` is appended to every document. NULL and empty texts have no other ids. A NULL
    doc_id comes first and is read back as NULL; rows with one id lie in the order of their texts'
    digests, repeated rows each keep their place. An empty table gives a folder with an empty
    manifest. Other columns are not read. A row of the manifest that was written says that its
    file is whole.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as file:
        file_text = file.read()
    if not can_be_cut(file_text):
        raise ValueError("a vocabulary that keeps white space can't be encoded piece by piece")
    shared = spark.sparkContext.broadcast(file_text)
    # The end id counts as one of the vocabulary, whose ids are given in its file.
    width = width_of(1 + max(_ids_of(file_text) | {end_id or 0}))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_rows, n_chars = texts.agg(F.count("*"), F.sum(F.length("text"))).first()
    shards = max(1, -(-(n_chars or 0) // file_chars), -(-n_rows // FILE_ROWS))
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        shard = TaskContext.get().partitionId()
        writer = None
        for batch in batches:
            if writer is None and batch.num_rows:
                encoder, (system, root) = Encoder(shared.value), _file_system(folder)
                name = f"{shard:06}-{uuid.uuid4().hex}.bits"
                stream = system.open_output_stream(f"{root}/{name}")
                writer = Writer(stream, width, block_ids)
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for doc_id, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist()):
                    writer.add(doc_id, np.frombuffer(encoder.ids(text or "") + end, "<u4"))
        if writer is None:
            return
        writer.close()
        size = stream.tell()
        stream.close()
        row = (shard, name, len(writer.doc_ids), writer.starts[-1], size)
        names = [part.split()[0] for part in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([value]) for value in row], names=names)

    keys = ["doc_id", "digest", "row"]
    dealt = (
        texts.withColumn("digest", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shards, *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    # The folder has to be there before a task writes into it.
    spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    dealt.mapInArrow(run, MANIFEST).write.mode("append").parquet(f"{folder}/manifest")


def _ids_of(file_text: str) -> set[int]:
    spec = json.loads(file_text)
    return {*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))}


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian 32-bit
    integers) of every document in the files that the manifest names."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # One row per file: the ids of all files before it.
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        names = [part.split()[0] for part in TOKENS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(list(column), kind) for column, kind in zip(zip(*found), kinds)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{root}/{row['file']}") as stream:
                    reader, found, size = Reader(stream), [], 0
                    if reader.n_ids != row["n_ids"] or reader.n_docs != row["n_docs"]:
                        raise ValueError(f"{row['file']} isn't the file that the manifest names")
                    for doc_id, first, ids in reader.documents():
                        found.append((doc_id, row["before"] + first, ids.size, ids.astype("<u4").tobytes()))
                        size += ids.size
                        if size > 1 << 20 or len(found) > 1 << 12:
                            yield rows(found)
                            found, size = [], 0
                    if found:
                        yield rows(found)

    return files.repartition(max(1, manifest.count()), "shard").mapInArrow(run, TOKENS)
