"""Helpers of the text operators: chunks of Arrow text as bytes, word boundaries and rolling hashes in numpy.

All of them work on UTF-8 bytes. A null text counts as an empty one throughout.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the numpy kernels take at once (a longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
#: The multiplier of the rolling hashes modulo 2^64, and what mixes their bits; any odd numbers would do.
BASE = 0x9E3779B97F4A7C15
MIX = 0xD6E8FEB86659FD93
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Code points that separate words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spread(df: DataFrame, *columns) -> int:
    """The number of partitions for a hash exchange of a whole table."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if len(column) and buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of a column with at most so many bytes, or of one longer text."""
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        x = np.ones(n, np.uint64)
        x[1:] = np.uint64(base)
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^0, BASE^1, ... and the inverses, modulo 2^64, for n places at least."""
    return _powers(max(20, int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(MIX)
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX)
    x ^= x >> np.uint64(32)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums of (byte + 1) * BASE^place, modulo 2^64: the hashes of all slices come from two entries."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of slices."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the place of its first word (n + 1 entries)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[begins[1:] - 1] = inside[begins[1:] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """The row of each element, from n + 1 bounds."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, and n + 1 bounds.

    A-Z are lower-cased. A text with fewer words than `size` has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, bounds = words(data, offsets)
    hashed = slice_hash(prefix_hash(LOWER[data]), starts, ends)
    n = len(hashed)
    counts = np.diff(bounds)
    rolled = np.zeros(n, np.uint64)
    for j in range(min(size, n)):  # a chunk may have fewer words
        rolled[: n - j] = rolled[: n - j] * np.uint64(BASE) + hashed[j:]
    whole = np.flatnonzero((counts > 0) & (counts < size))
    for i in whole:  # few short texts
        x = 0
        for h in hashed[bounds[i] : bounds[i + 1]].tolist():
            x = (x * BASE + h) & 0xFFFFFFFFFFFFFFFF
        rolled[bounds[i]] = (x + int(counts[i])) & 0xFFFFFFFFFFFFFFFF
    kept = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    new = np.concatenate(([0], np.cumsum(kept)))
    picked = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], kept)
    return distinct(mix(rolled[picked]), new)


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values of each row and drops repeats; the new bounds."""
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    if not len(values):
        return values, bounds
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    total = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], total[bounds]


def reduced(ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """ufunc over each row's values; `empty` where a row has none."""
    out = np.full(len(bounds) - 1, empty, dtype=values.dtype)
    full = np.flatnonzero(bounds[:-1] < bounds[1:])
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[:-1][full])
    return out


def digests(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128-bit digests of whole texts, as two longs each (rows x 2)."""
    view, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
    out = b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(ends[:-1], ends[1:], strict=True))
    return np.frombuffer(out, np.int64).reshape(-1, 2)


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def with_defaults(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast; a missing one is null. Other columns (with names that may clash) don't matter."""
    return df.select(*[(F.col(f"`{c}`") if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()])


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of tables made within go as soon as the table is on disk, and not only when the driver's memory is cleared.

    Tables that outlast the block are to be made after it: they may be read more than once.
    """
    had = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, had)


def settled(df: DataFrame) -> DataFrame:
    """Writes a table of texts to a folder of its own in the shared checkpoint folder, and reads it again."""
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def steady() -> None:
    """For tasks that hold large tables of small objects without cycles: the garbage collector would walk them in vain."""
    gc.disable()
