"""BPE with a bounded-lookahead streaming transducer, and an incremental decoder.

A merge that starts at some position depends on what stands to the right of it only up to a
distance that the merge list itself bounds. ``lookahead`` computes that bound: rules are visited in
the order of their ranks, and for each token the furthest position is kept that a rule of lower
rank using or making it can depend on. A token boundary further than the lookahead from the end of
what has been read is final, whatever follows, and what stands right of a final boundary can be
encoded on its own. So tokens leave as soon as they are stable, and memory stays constant however
long a text or a word is.

Documents are encoded by a map without any shuffle. Each task keeps the ids of recent words in a
table of bounded size. The vocabulary file is read on the driver from a path given by the caller
and broadcast; its size is that of the file.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kindred.llm.arrow import map_slices

CHUNK = 1 << 16  # characters read at a time
LONG_WORD = 1 << 10  # of a word that may go on, more than this waits in the window of symbols
RECENT_WORDS, LONGEST_KEPT = 1 << 18, 64
NEVER = 1 << 60  # rank of pairs that are not merged
RESULT = "doc_id bigint, n_tokens bigint, ids binary, decoded string"
# Before one of these characters, text can be cut without changing its NFC form.
CUT = regex.compile(r"[\x00-˿Ͱ-҂Ґ-ԯぁ-ゖ一-鿿가-힣]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    it is printable Latin-1, else the next free character from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(0x100, 0x200))
    return [chr(byte) if byte in printable else chr(next(free)) for byte in range(256)]


def lookahead(merges: Iterable[tuple[str, str]], suffix: str) -> int:
    """How many symbols to the right of a position decide whether a merge spans it."""
    reach: dict[str, int] = {}

    def size(token: str) -> int:
        return len(token.removesuffix(suffix)) if suffix else len(token)

    for left, right in merges:
        far = max(size(left) + reach.get(right, size(right)), reach.get(left, size(left)))
        reach[left] = max(reach.get(left, 0), far)
        reach[right] = max(reach.get(right, 0), far - size(left))
        reach[left + right] = max(reach.get(left + right, 0), far)
    return max(reach.values(), default=1)


class _Recent(dict):
    """Ids of recent short words as bytes, dropped all at once when there are too many."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= RECENT_WORDS:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """A byte-level BPE vocabulary with word suffixes, from the text of its JSON file."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.id_bytes = {t: number.to_bytes(4, "little") for t, number in self.vocab.items()}
        self.suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.lookahead = lookahead(merges, self.suffix)
        self.window = 2 * self.lookahead + 512
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        steps = spec["normalizer"]["normalizers"]
        known = {"NFC", "Replace", "Lowercase"}
        if {step["type"] for step in steps} - known:
            raise ValueError("normalizer steps other than NFC, Replace and Lowercase")
        self.nfc, self.lowercase = (
            any(step["type"] == name for step in steps) for name in ("NFC", "Lowercase")
        )
        split, *_ = spec["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.runs = (regex.compile(r"\p{L}+"), regex.compile(r"[^\s\p{L}\p{N}]+"))
        self.to_symbols = dict(enumerate(byte_alphabet()))
        self.special = (
            regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))))
            if self.specials
            else None
        )
        self.tokens = {number: token for token, number in self.vocab.items()}
        self.tokens |= {number: token for token, number in self.specials.items()}
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.recent = _Recent(self._word_bytes)

    # Merging

    def merge(self, symbols: list[str]) -> list[str]:
        """All merges by rank, leftmost first."""
        if len(symbols) > 128:
            return self._merge_long(symbols)
        rank = self.ranks.get
        ranks = [rank(pair, NEVER) for pair in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            symbols[at] += symbols.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = rank((symbols[at - 1], symbols[at]), NEVER)
            if at < len(ranks):
                ranks[at] = rank((symbols[at], symbols[at + 1]), NEVER)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        ranks, count = self.ranks, len(symbols)
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        queue = [
            (ranks[pair], at, pair) for at, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks
        ]
        heapq.heapify(queue)
        while queue:
            _, at, pair = heapq.heappop(queue)
            right = after[at]
            if symbols[at] != pair[0] or right >= count or symbols[right] != pair[1]:
                continue
            symbols[at], symbols[right] = pair[0] + pair[1], ""
            after[at] = after[right]
            if after[at] < count:
                before[after[at]] = at
            for first in (before[at], at):
                if first >= 0 and after[first] < count:
                    new = (symbols[first], symbols[after[first]])
                    if new in ranks:
                        heapq.heappush(queue, (ranks[new], first, new))
        return [symbol for symbol in symbols if symbol]

    def _symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.to_symbols)

    def _ids(self, tokens: list[str]) -> bytes:
        return b"".join([self.id_bytes.get(token, b"") for token in tokens])

    def _finished(self, symbols: str) -> bytes:
        return self._ids(self.merge([*symbols[:-1], symbols[-1] + self.suffix])) if symbols else b""

    def _word_bytes(self, word: str) -> bytes:
        return self._finished(self._symbols(word))

    # Streaming

    def normal(self, text: str) -> str:
        if self.nfc:
            import unicodedata

            text = unicodedata.normalize("NFC", text)
        # Each character on its own: no special form of sigma at word ends.
        return text.replace("Σ", "σ").lower() if self.lowercase else text

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian 32-bit integers, piece by piece."""
        at = 0
        for found in self.special.finditer(text) if self.special else ():
            yield from self._stream(text, at, found.start())
            yield self.specials[found[0]].to_bytes(4, "little")
            at = found.end()
        yield from self._stream(text, at, len(text))

    def _stream(self, text: str, start: int, end: int) -> Iterator[bytes]:
        transducer = Transducer(self)
        while end - start > CHUNK:
            cut = start + CHUNK
            while cut < end and not CUT.match(text, cut):
                cut += 1
            yield from transducer.feed(self.normal(text[start:cut]))
            start = cut
        yield from transducer.feed(self.normal(text[start:end]), last=True)

    # Decoding

    def decode(self, ids: Iterable[bytes]) -> Iterator[str]:
        """Text of a stream of ids. Byte-level decoders keep the bytes of an unfinished character;
        without a decoder, tokens are joined by spaces."""
        if self.byte_decoder:
            to_byte = {symbol: byte for byte, symbol in self.to_symbols.items()}
            machine = codecs.getincrementaldecoder("utf-8")("replace")
            for piece in ids:
                tokens = map(self.tokens.__getitem__, np.frombuffer(piece, "<u4").tolist())
                yield machine.decode(bytes(map(to_byte.__getitem__, "".join(tokens))))
            yield machine.decode(b"", final=True)
            return
        separator = ""
        for piece in ids:
            if piece:
                tokens = map(self.tokens.__getitem__, np.frombuffer(piece, "<u4").tolist())
                yield separator + " ".join(tokens)
                separator = " "


class Transducer:
    """Encodes normal text that arrives in chunks. State: characters of a word that may go on, or
    the unstable end of a long run."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.rest = ""  # characters not yet split into words
        self.run: regex.Pattern | None = None  # what a long run consists of
        self.tail = ""  # its symbols that are not stable

    def feed(self, text: str, last: bool = False) -> Iterator[bytes]:
        codec, text = self.codec, self.rest + text
        at = 0
        if self.run:
            more = self.run.match(text)
            at = more.end() if more else 0
            yield from self._push(text[:at])
            if at == len(text) and not last:
                self.rest = ""
                return
            yield self._finish()
        # No word goes on over white space.
        whole = len(text) if last else max(at, text.rfind(" ") + 1, text.rfind("\n") + 1)
        yield b"".join(map(codec.recent.__getitem__, codec.pattern.findall(text, at, whole)))
        self.rest = text[whole:]
        if len(self.rest) > LONG_WORD:
            yield from self._long_rest()

    def _long_rest(self) -> Iterator[bytes]:
        """What of a rest without white space is certain: all words but one that two characters
        more may change; of that, if it is long, the symbols go to the window."""
        codec, text, at = self.codec, self.rest, 0
        for found in codec.pattern.finditer(text):
            begin, end = found.span()
            if end <= len(text) - 3:
                yield codec.recent[found[0]]
                at = end
                continue
            if end == len(text) and end - begin > LONG_WORD:
                self.run = codec.runs[0] if codec.runs[0].match(found[0]) else codec.runs[1]
                yield from self._push(found[0])
                at = end
            break
        self.rest = text[at:]

    def _push(self, characters: str) -> Iterator[bytes]:
        codec = self.codec
        symbols = codec._symbols(characters)
        for start in range(0, len(symbols), codec.window):
            self.tail += symbols[start : start + codec.window]
            stable = len(self.tail) - codec.lookahead - 1
            tokens, end = [], 0
            if stable > codec.lookahead:
                for token in codec.merge([*self.tail]):
                    if end + len(token) > stable:
                        break
                    tokens.append(token)
                    end += len(token)
            self.tail = self.tail[end:]
            yield codec._ids(tokens)

    def _finish(self) -> bytes:
        ids = self.codec._finished(self.tail)
        self.run, self.tail = None, ""
        return ids


def encode_documents(docs: DataFrame, vocabulary_path: str, decode: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian 32-bit integers) and, if
    asked for, the decoded text.

    NULL and empty texts have no tokens and decode to an empty text. Special tokens that occur in
    a text get their ids. Repeated rows are encoded alike, an empty table gives an empty result,
    other columns are not read.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        codec = Codec(shared.value)

        def encode(batch: pa.RecordBatch) -> dict:
            ids = [b"".join(codec.encode(text or "")) for text in batch["text"].to_pylist()]
            return {
                "doc_id": batch["doc_id"],
                "n_tokens": [len(row) // 4 for row in ids],
                "ids": ids,
                "decoded": ["".join(codec.decode([row])) for row in ids] if decode else [None] * len(ids),
            }

        return encode

    return map_slices(docs.select("doc_id", "text"), make, RESULT)
