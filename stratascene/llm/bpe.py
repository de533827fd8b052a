"""Byte-level BPE through sentencepiece: the model file is serialised straight from a vocabulary of ranks.

Each byte stands for one printable character, so a token's bytes are a *piece*, and a piece's score is its negative rank:
sentencepiece merges the pair with the highest score first, which is the pair with the lowest rank. The model has identity
normalisation. A text is cut into pre-tokens by the vocabulary's pattern and each is encoded by itself; a pre-token that is
itself in the vocabulary is that token. Decoding maps ids back to their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ship_package, small_batches

#: Pre-tokens whose ids a worker remembers, of so many characters at most; a full memory is emptied, which costs time only, and so is one of more than ``KEPT`` after a task.
MEMORY, REMEMBERED, KEPT = 600_000, 100, 50_000
#: The same where a stage follows others, whose workers wait.
SHORT_MEMORY = 100_000
#: Characters of one text that are cut into pre-tokens at once; bounds the memory for very long texts.
SPAN = 1 << 18
#: Parts the pre-tokens that one call encodes; stands for no byte.
SEPARATOR = "\u2028"
#: Patterns that match the same in less time: nothing but a letter can start what the first alternative matches after its space, so it may come before the contractions.
SAME = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r" ?\p{L}+|'(?:[stmd]|re|ve|ll)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"}

#: The same for texts of ASCII characters only, for the standard library's faster engine; its white space is another, so that the class is spelled out.
ASCII = {r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": r" ?[A-Za-z]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"}


def byte_chars() -> list[str]:
    """One printable character for each byte: itself where printable, else the next character from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shifted = (chr(256 + n) for n in range(256))
    return [chr(b) if b in plain else next(shifted) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a rank file: base64 of the token's bytes, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def serialise_model(ranks: dict[bytes, int]) -> tuple[bytes, list[bytes]]:
    """A sentencepiece model (protobuf wire format) whose piece 0 is <unk> and piece ``n + 1`` the n-th token by rank; and the tokens by rank."""
    chars = byte_chars()
    tokens = sorted(ranks, key=ranks.get)
    pieces = [_field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + b"\x18\x02"]  # piece, score, type UNKNOWN
    pieces += [_field(1, "".join(chars[b] for b in t).encode()) + b"\x15" + struct.pack("<f", -ranks[t]) + b"\x18\x01" for t in tokens]
    trainer = b"\x18\x02" + _varint(4 << 3) + _varint(len(pieces)) + b"".join(_varint(n << 3) + _varint(v) for n, v in ((40, 0), (41, (1 << 64) - 1), (42, (1 << 64) - 1), (43, (1 << 64) - 1)))  # model type BPE; vocabulary size; unk 0, no bos, eos, pad
    normaliser = _field(1, b"identity") + b"".join(_varint(n << 3) + b"\x00" for n in (3, 4, 5))  # no dummy prefix, kept white space, no escapes
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser), tokens


def newer_characters() -> frozenset[str]:
    """Characters that the ``regex`` library counts as letters or digits and tiktoken's older Unicode tables don't."""
    both = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000))))
    only_bytes = tiktoken.Encoding("classes", pat_str=r"[\p{L}\p{N}]", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    older = bytes(only_bytes.encode_ordinary("".join(both))).decode()  # what the pattern doesn't match is left out
    return frozenset(both) - frozenset(older)


class _Known(dict):
    """Ids of pre-tokens; one that isn't known is noted in ``new`` for the caller to fill in."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> bytes:
        self.new.append(word)
        self[word] = b""
        return b""


class ByteBpe:
    def __init__(self, path: str, pattern: str) -> None:
        ranks = read_ranks(path)
        model, tokens = serialise_model(ranks)
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.ids = np.array([ranks[t] for t in tokens], dtype="<u4")
        self.bytes_of = {ranks[t]: t for t in tokens}
        self.ranks = ranks
        self.largest = max(ranks.values())
        self.split = regex.compile(SAME.get(pattern, pattern))
        self.ascii = re.compile(ASCII[pattern]) if pattern in ASCII else self.split
        self.chars = byte_chars()
        self.to_chars = dict(enumerate(self.chars)) | {255: SEPARATOR}
        self.whole = {t: struct.pack("<I", n) for t, n in ranks.items()}
        self.known = _Known()
        self.memory = MEMORY
        self.newer = newer_characters()

    def _ids(self, words: list[str]) -> dict[str, bytes]:
        """The ids (little-endian, 4 bytes each) of pre-tokens."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        out = {w: whole for w, d in zip(words, data) if (whole := self.whole.get(d))}
        if len(out) < len(words):  # one call for all: the separator, here the byte 255, is in no UTF-8 and no piece, so that it parts them and comes out as <unk>
            rest = [(w, d) for w, d in zip(words, data) if w not in out]
            got = np.array(self.pieces.encode(b"\xff".join([d for _, d in rest]).decode("latin-1").translate(self.to_chars)), dtype=np.int64)
            ids = self.ids[np.maximum(got, 1) - 1].tobytes()
            at = 0
            for (w, _), end in zip(rest, [*(4 * np.flatnonzero(got == 0)).tolist(), len(ids)], strict=True):
                out[w] = ids[at:end]
                at = end + 4
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text, 4 bytes each, little-endian."""
        out = []
        known = self.known
        for words in self._pretokens(text):
            if len(known) > self.memory:
                known.clear()
            ids = b"".join(map(known.__getitem__, words))
            if known.new:
                new, known.new = known.new, []
                if not text.isascii() and any(not w.isascii() and not self.newer.isdisjoint(w) for w in new):
                    for w in new:
                        del known[w]
                    return self._encode_newer(text)
                known |= self._ids(new)
                ids = b"".join(map(known.__getitem__, words))
                for w in new:
                    if len(w) > REMEMBERED:
                        known.pop(w, None)
            out.append(ids)
        return b"".join(out)

    def _encode_newer(self, text: str) -> bytes:
        """As ``encode``, for a text with characters that only ``regex`` calls letters or digits: an unassigned one stands in for them while the text is cut."""
        words = [text[m.start() : m.end()] for m in self.split.finditer(text.translate(dict.fromkeys(map(ord, self.newer), "\ue000")))]
        ids = self._ids(list({*words}))
        return b"".join(map(ids.__getitem__, words))

    def _pretokens(self, text: str) -> Iterator[list[str]]:
        """All pre-tokens in turn; a long text in spans, each of which starts where a match of the whole text starts."""
        if len(text) <= SPAN:
            yield (self.ascii if text.isascii() else self.split).findall(text)
            return
        words, size = [], 0
        for m in self.split.finditer(text):
            words.append(m[0])
            size += len(m[0])
            if size >= SPAN:
                yield words
                words, size = [], 0
        yield words

    def rest(self) -> None:
        """After a task: the worker waits for another, of this stage or the next."""
        if len(self.known) > KEPT:
            self.known.clear()
        give_back()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBpe:
    """The codec of a worker process, built once; what building it took goes back, since it would stay for the worker's life."""
    made = ByteBpe(path, pattern)
    give_back()
    return made


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, ids`` (binary, 4 bytes an id, little-endian), ``decoded`` (binary, from the ids).

    A null text is empty and has no ids; a null identifier stays null; repeated rows are encoded each; an empty table gives an
    empty table. Other columns are ignored.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        bpe.memory = SHORT_MEMORY
        for batch in small_batches(batches):
            ids = [bpe.encode(x) if x else b"" for x in (y.as_py() for y in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array([bpe.decode(x) for x in ids], pa.binary())], ["id", "ids", "decoded"])
        bpe.rest()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, "id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens, ids_sha256, decoded_sha256``, the digests of what ``encode_documents`` returns.

    The ids and bytes are hashed in the task that makes them, so that they needn't travel.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        bpe.memory = SHORT_MEMORY
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in (y.as_py() for y in batch.column(1)):
                ids = bpe.encode(text) if text else b""
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.rest()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("body")).mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
