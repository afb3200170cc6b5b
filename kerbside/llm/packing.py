"""Packing by power-of-two decomposition.

Each document's token ids (its text's and an end id) are cut into pieces of power-of-two lengths: as many of the full
length as fit, then one piece for each bit of the rest, longest first. A piece is a sequence of its own, so none crosses
documents and none needs padding. No row meets another, so there is no shuffle: the sequences are numbered by Spark's
per-partition counter. `batches` puts pieces of one length together, as many as make a full length, so that a batch is a
rectangle without padding; each task fills its own, and only the last batch of a length in it may be short.

Edge cases: a null or empty text is the end id alone; null ids, repeated rows and very long texts need no special care
(each row gives its own pieces and sequences); an empty table gives no pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from kerbside.llm import common as C

FULL = 4096
END_ID = 2
#: Words kept with their ids in each worker; beyond that the table starts anew (results don't depend on it).
CACHE_WORDS = 500_000
LONG_WORD = 48
#: Words that are cut and merged here: printable ASCII and Latin letters, which normalisation leaves as they are.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: The vocabulary's pattern over such lower-cased words (a fixed value).
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")
WORD_END = "\0"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else the next unused one from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class WordIds(dict):
    """Word to place in a table of token ids, filled as words come up.

    The tokenizer's own encoder takes some 15 microseconds a word, and a corpus has millions of rare ones. A plain word is
    therefore merged by the same vocabulary in the rank-file library: its word end is a byte of its own, which the
    first-ranked merges join to the last letter. Any other word goes to the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # such tokens in a text are found in it by the tokenizer alone
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        byte_of = {c: bytes([b]) for b, c in enumerate(byte_characters())}
        ranks, self.token_id = {bytes([b]): b for b in range(256)}, [0] * (1 << 16)
        for token, i in sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
            body, end = (token[:-4], WORD_END.encode()) if token.endswith("</w>") else (token, b"")
            raw = b"".join(map(byte_of.__getitem__, body)) + end
            rank = ranks.setdefault(raw, i + 256)
            self.token_id[rank] = i
        self.merge = tiktoken.Encoding("word-ends", pat_str="[^\\x00]*\\x00", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids = array("I")
        self.begins = array("q", [0])

    def word(self, word: str) -> list[int]:
        if word.isascii() and word.isalpha():
            return [self.token_id[i] for i in self.merge(word.lower() + WORD_END)]
        if PLAIN.fullmatch(word) and not any(t in word.lower() for t in self.added):
            return [self.token_id[i] for i in self.merge(WORD_END.join([*PARTS.findall(word.lower()), ""]))]
        return self.tokenizer.encode(word, add_special_tokens=False).ids if word else []

    def __missing__(self, word: str) -> int:
        self.ids.extend(self.word(word))
        self.begins.append(len(self.ids))
        place = len(self.begins) - 2
        if len(word) <= LONG_WORD:
            self[word] = place
        return place

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of texts. White space ends a token and is dropped, so the words between blanks are encoded one by one."""
        if len(self.begins) > CACHE_WORDS:
            self.clear()
        found = [np.array(itemgetter("", *text.replace("\n", " ").split(" "))(self), np.int64) for text in texts]
        ids, begins = np.frombuffer(self.ids.tobytes(), np.uint32), np.frombuffer(self.begins.tobytes(), np.int64)
        for places in found:
            first, n = begins[places], begins[places + 1] - begins[places]
            ends = np.cumsum(n)
            yield ids[np.arange(ends[-1]) + np.repeat(first - ends + n, n)]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cuts(n: int, full: int = FULL) -> np.ndarray:
    """Starts of the pieces of n ids, and n."""
    rest = n % full
    bits = [1 << b for b in range(full.bit_length() - 2, -1, -1) if rest >> b & 1]
    return np.concatenate(([0], np.cumsum([full] * (n // full) + bits))).astype(np.int64)


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID, full: int = FULL) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id and offset (always 0)."""
    schema = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        table = word_ids(tokenizer_path)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for first in range(0, len(texts), 256):
                starts, lengths, blobs, rows, totals = [], [], [], [], []
                for i, ids in enumerate(table.encode([t or "" for t in texts[first : first + 256].to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    at = cuts(len(ids), full)
                    starts.append(at[:-1])
                    lengths.append(np.diff(at))
                    raw = ids.tobytes()
                    ends = (at * 4).tolist()
                    blobs += [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    rows += [first + i] * (len(at) - 1)
                    totals += [len(ids)] * (len(at) - 1)
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lengths)), C.binary(blobs), pa.array(totals, pa.int64())],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    made = C.with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, schema)
    return made.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("bigint"))


def batches(made: DataFrame, full: int = FULL) -> DataFrame:
    """Adds batch_id and batch_row: the bucket of equal lengths that a piece is in, and its row there. A batch has full // length rows."""
    schema = StructType([*made.schema.fields]).add("batch_id", LongType()).add("batch_row", LongType())
    place, names = made.columns.index("length"), schema.names

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, begun, open_ = TaskContext.get().partitionId() << 33, 0, {}
        for batch in parts:
            lengths = batch.column(place).to_numpy()
            ids, rows = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                own, per = np.flatnonzero(lengths == length), full // length
                number, filled = open_.get(length, (0, 0))
                n = filled + np.arange(len(own))
                k = n // per - (1 if filled else 0)  # -1: the batch that is open
                ids[own], rows[own] = np.where(k < 0, number, begun + k), n % per
                begun += int(k[-1]) + 1
                open_[length] = int(ids[own[-1]]), int(n[-1] + 1) % per
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base + ids), pa.array(rows)], names)

    return made.mapInArrow(run, schema)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    made = pieces(C.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
