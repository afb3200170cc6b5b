"""Byte-level BPE by a sentencepiece model that is written directly from a rank file.

Each byte is mapped to one printable character; the vocabulary's byte strings, so mapped, become pieces with the negative
rank as score, so that the best-scored merge is the one of lowest rank. The normaliser is the identity. Pre-tokens (the
matches of a pattern) are encoded one by one; a pre-token that is itself in the vocabulary is one id, as the rank-file
library has it. Ids are decoded through the inverse mapping.

Edge cases: a null or empty text has no ids; null ids of rows, repeated rows and very long texts need no special care;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kerbside.llm import common as C

#: Code points with the Unicode property White_Space (fixed values): what \s means in the patterns.
WHITE = r"\x09-\x0d\x20\x85\xa0  -     　"
#: The Latin-1 characters of the classes \\s, \\p{L} and \\p{N} (fixed values).
LATIN_WHITE = r"\x09-\x0d\x20\x85\xa0"
LATIN_LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Pre-tokens kept in each worker; beyond that the table starts anew (results don't depend on it).
CACHE_TOKENS = 500_000
LONG_TOKEN = 64


@cache
def byte_characters() -> tuple[str, ...]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next unused one from U+0100."""
    own = {b for lo, hi in (("!", "~"), ("\xa1", "\xac"), ("\xae", "\xff")) for b in range(ord(lo), ord(hi) + 1)}
    rest = iter(range(256, 512))
    return tuple(chr(b) if b in own else chr(next(rest)) for b in range(256))


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """A protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece model: pieces in the order of their ranks, then the unknown piece."""
    letters = byte_characters()
    out = bytearray()
    for raw, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(letters[b] for b in raw).encode()
        out += _field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, 1))
    out += _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    unknown = len(ranks)
    trainer = _field(3, 2) + _field(4, unknown + 1) + _field(40, unknown) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return bytes(out + _field(2, trainer) + _field(3, normaliser))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec(dict):
    """Pre-token to (number of ids, decimal ids joined by commas, decoded bytes)."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.ranks = read_ranks(path)
        if sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError("ranks aren't gapless")
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        # the characters of \s are named, since libraries differ over some control characters
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]"))
        self.letters = byte_characters()
        self.to_letters = {b: c for b, c in enumerate(self.letters)}
        self.to_byte = {c: b for b, c in enumerate(self.letters)}
        # the inverse mapping of each piece
        self.raw = [bytes(map(self.to_byte.__getitem__, self.model.id_to_piece(i))) for i in range(len(self.ranks))]
        self.latin = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{LATIN_WHITE}{LATIN_LETTERS}{LATIN_NUMBERS}]").replace(r"\p{L}", f"[{LATIN_LETTERS}]").replace(r"\p{N}", f"[{LATIN_NUMBERS}]").replace(r"(?!\S)", f"(?![^{LATIN_WHITE}])").replace(r"\s", f"[{LATIN_WHITE}]"))

    def encode_token(self, token: str) -> list[int]:
        raw = token.encode()
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else self.model.encode(self.mapped(token))

    def mapped(self, token: str) -> str:
        if token.isascii() and token.isprintable():
            return token.replace(" ", self.letters[32])
        return token.encode().decode("latin-1").translate(self.to_letters)

    def split(self, text: str) -> list[str]:
        """The pre-tokens; texts of Latin-1 characters go by a pattern with explicit classes, which is faster."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.raw[i] for i in ids])

    def learn(self, tokens: list[str]) -> None:
        """Encodes new pre-tokens together."""
        plain = [t for t in tokens if len(t) <= LONG_TOKEN and t.encode() not in self.ranks]
        coded = self.model.encode([*map(self.mapped, plain)], num_threads=1)
        for token, ids in zip(plain, coded, strict=True):
            self[token] = len(ids), ",".join(map(str, ids)), self.decode(ids)

    def __missing__(self, token: str) -> tuple[int, str, bytes]:
        ids = self.encode_token(token)
        found = len(ids), ",".join(map(str, ids)), self.decode(ids)
        if len(token) <= LONG_TOKEN:
            self[token] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [i for token in self.split(text) for i in self.encode_token(token)]

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids and the digests of the ids and of the bytes that they decode to."""
        tokens = self.split(text)
        if new := [t for t in dict.fromkeys(tokens) if t not in self]:
            self.learn(new)
        found = [self[t] for t in tokens]
        if not found:
            return 0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest()
        counts, ids, raw = zip(*found, strict=True)
        return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(b"".join(raw)).hexdigest()


@cache
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `ids`, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        own = codec(path, pattern)
        for batch in batches:
            ids = pa.array([own.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return C.with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and `raw`, the bytes of the ids (null ids: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        own = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), C.binary([own.decode(x or []) for x in batch.column(1).to_pylist()])], ["doc_id", "raw"])

    return C.with_defaults(encoded, doc_id="bigint", ids="array<int>").mapInArrow(run, "doc_id bigint, raw binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256: ids need not leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        own = codec(path, pattern)
        for batch in batches:
            texts, found = batch.column(1), []
            for first in range(0, len(texts), 256):
                if len(own) > CACHE_TOKENS:
                    own.clear()
                found += [own.digest(t or "") for t in texts[first : first + 256].to_pylist()]
            n, ids, raw = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(raw, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return C.with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(C.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
