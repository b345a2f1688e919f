"""A file of token ids in fixed-width bits, written as a stream and read at any place.

    magic | blocks | footer | trailer

Every block holds ``block_ids`` ids (the last one what is left) of ``width`` bits each, lowest bit
first. Eight ids fill exactly ``width`` bytes, so a block is packed and unpacked eight columns at a
time in numpy. The footer holds the byte offset of every block, and of every document its id,
whether it has one, and its first id in the file. The trailer has a fixed size and says where the
footer is, so a writer only appends and a reader needs two small reads before it can seek.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"KINDBITS"
TRAILER = "<QQQIB8s"  # ids, documents, footer's offset, ids of a block, width, magic
TRAILER_SIZE = struct.calcsize(TRAILER)
BLOCK_IDS = 1 << 16


def width_of(vocabulary_size: int) -> int:
    """The fewest bits that tell the ids of a vocabulary apart."""
    return max(1, (vocabulary_size - 1).bit_length())


def _columns(width: int) -> Iterator[tuple[int, int, int]]:
    """For each of eight ids: its first byte, its first bit in there and the bytes it touches."""
    for number in range(8):
        first, bit = divmod(number * width, 8)
        yield first, bit, (bit + width + 7) // 8


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids as ``width`` bits each, filled up with zeros to a multiple of eight ids."""
    if ids.size and int(ids.max()) >> width:
        raise ValueError(f"id {int(ids.max())} has more than {width} bits")
    eights = np.zeros((-(-ids.size // 8), 8), np.uint64)
    eights.reshape(-1)[: ids.size] = ids
    out = np.zeros((len(eights), width), np.uint8)
    for number, (first, bit, touched) in enumerate(_columns(width)):
        shifted = eights[:, number] << np.uint64(bit)
        for byte in range(touched):
            out[:, first + byte] |= (shifted >> np.uint64(8 * byte)).astype(np.uint8)
    return out.tobytes()


def unpack(packed: bytes, width: int) -> np.ndarray:
    """All ids of packed bytes, those that fill up included."""
    rows = np.frombuffer(packed, np.uint8).reshape(-1, width)
    ids = np.empty((len(rows), 8), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for number, (first, bit, touched) in enumerate(_columns(width)):
        value = np.zeros(len(rows), np.uint64)
        for byte in range(touched):
            value |= rows[:, first + byte].astype(np.uint64) << np.uint64(8 * byte)
        ids[:, number] = (value >> np.uint64(bit)) & mask
    return ids.reshape(-1)


class Writer:
    """Appends documents to a stream of bytes; holds at most a block and the newest document."""

    def __init__(self, stream, width: int, block_ids: int = BLOCK_IDS):
        if not 1 <= width <= 32 or block_ids % 8:
            raise ValueError("the width is 1 to 32 bits, and a block a multiple of eight ids")
        self.stream, self.width, self.block_ids = stream, width, block_ids
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.offsets, self.doc_ids, self.starts = [len(MAGIC)], [], [0]
        stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + ids.size)
        self.waiting.append(ids)
        self.n_waiting += ids.size
        if self.n_waiting >= self.block_ids:
            ready = np.concatenate(self.waiting)
            whole = ready.size // self.block_ids * self.block_ids
            for start in range(0, whole, self.block_ids):
                self._block(ready[start : start + self.block_ids])
            self.waiting, self.n_waiting = [ready[whole:]], ready.size - whole

    def _block(self, ids: np.ndarray) -> None:
        packed = pack(ids, self.width)
        self.stream.write(packed)
        self.offsets.append(self.offsets[-1] + len(packed))

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.concatenate(self.waiting))
        known = np.array([doc_id is not None for doc_id in self.doc_ids], np.uint8)
        numbers = np.array([doc_id or 0 for doc_id in self.doc_ids], "<i8")
        for part in (np.array(self.offsets, "<u8"), np.array(self.starts, "<u8"), numbers, known):
            self.stream.write(part.tobytes())
        sizes = (self.starts[-1], len(self.doc_ids), self.offsets[-1], self.block_ids, self.width)
        self.stream.write(struct.pack(TRAILER, *sizes, MAGIC))


class Reader:
    """Reads ids and documents of one file at any place.

    ``stream`` can seek. Only the footer and the blocks that hold the ids asked for are read.
    """

    def __init__(self, stream):
        self.stream = stream
        end = stream.seek(0, 2)
        trailer = self._read(end - TRAILER_SIZE, TRAILER_SIZE) if end >= TRAILER_SIZE else b""
        if not trailer.endswith(MAGIC):
            raise ValueError("no file of packed ids, or one that is cut off")
        self.n_ids, self.n_docs, footer, self.block_ids, self.width, _ = struct.unpack(TRAILER, trailer)
        self.offsets, self.starts, self.numbers, known = self._parts(footer)
        self.known = known.astype(bool)

    def _parts(self, footer: int) -> Iterator[np.ndarray]:
        blocks = -(-self.n_ids // self.block_ids)
        for count, kind in ((blocks + 1, "<u8"), (self.n_docs + 1, "<u8"), (self.n_docs, "<i8"), (self.n_docs, "u1")):
            size = count * np.dtype(kind).itemsize
            yield np.frombuffer(self._read(footer, size), kind)
            footer += size

    def _read(self, at: int, size: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(size)

    def ids(self, first: int, count: int) -> np.ndarray:
        """``count`` ids from number ``first`` of the file on."""
        if not 0 <= first <= first + count <= self.n_ids:
            raise IndexError(f"ids {first} to {first + count} of {self.n_ids}")
        if not count:
            return np.empty(0, np.uint32)
        low, high = first // self.block_ids, (first + count - 1) // self.block_ids
        begin, end = int(self.offsets[low]), int(self.offsets[high + 1])
        found = unpack(self._read(begin, end - begin), self.width)
        skip = first - low * self.block_ids
        return found[skip : skip + count]

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, by its place in the file."""
        first = int(self.starts[number])
        return self.ids(first, int(self.starts[number + 1]) - first)

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id, ids) of all documents in order, read in runs of about ``at_once`` ids."""
        number = 0
        while number < self.n_docs:
            first = int(self.starts[number])
            last = int(np.searchsorted(self.starts, first + at_once, "right")) - 1
            last = min(max(last, number + 1), self.n_docs)
            run = self.ids(first, int(self.starts[last]) - first)
            for place in range(number, last):
                begin, end = int(self.starts[place]), int(self.starts[place + 1])
                doc_id = int(self.numbers[place]) if self.known[place] else None
                yield doc_id, begin, run[begin - first : end - first]
            number = last
