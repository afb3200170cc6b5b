"""Links between near-duplicate items: band buckets, exact verification on full sets, and an exact way for large buckets.

Items have a 64-bit id and band keys from MinHash. Band keys travel as packed arrays, one row for each (batch, part). A
bucket of up to `small` members (SMALL, if the operator names no other number) proposes all its pairs. A larger one proposes stars around CENTRES members; this happens
within each batch first, so that a key that very many items share brings only a few members of each batch to the task of
its part. Entries may carry marks, bits of minima of other bands: then a bucket's pairs are compared by them where they meet, so that
unlike items that share a key by chance are no candidates, and of a larger bucket only dense clumps of like marks count as large buckets. Once the links are verified and joined into components, what is left are large buckets that still hold several
components. In those with up to `middle` members (none, if the operator names no number), packed bits tell which pairs across components are to be verified; members of
the larger ones are joined by their rarest shingles: two sets with a Jaccard similarity of t share one of the
first (1 - t) n + 1 shingles in any common order, and in an order by frequency those of unlike members are nearly all their
own. So no bucket is capped, none emits all its pairs, and no pair of a bucket is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import common as C
from kerbside.llm.components import SALTS, components, hot, labelled, packed_edges, salted_join

SMALL, CENTRES = 6, 3
#: Numbers of parts by which band keys are dealt, for each of Spark's shuffle partitions; a task holds one part at a time.
SHARES = 4
#: Items whose band keys are dealt at once.
DEALT = 8192
#: Kinds of rows: band entries to be gathered, such of centres of a batch's large buckets, a proposed pair, a member of a large bucket.
BAND, CENTRE, PAIR, MEMBER = 0, 1, 2, 3
#: Minima kept as b-bit values, how many bits of each, and longs that hold them.
N_BITS, BITS = 128, 4
LONGS = N_BITS // 64 * BITS
#: Bits of each of the 64 minima in a mark, and the largest bucket whose marks are all compared.
MARK_BITS, CLOSE = 2, 4096
#: Shingle sets are compared by size classes, a class holding sizes up to a twentieth apart.
CLASS = 1.05

Sets = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Gives columns of a table of ids, or of more ids.
Texts = Callable[[DataFrame], DataFrame]


def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of n permutations of 32-bit numbers."""
    x = C.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(C.BASE)).astype(np.uint32)
    return x[:n] | np.uint32(1), x[n:]


def minima(values: np.ndarray, bounds: np.ndarray, n: int, first: int = 0) -> np.ndarray:
    """n minima of each row's values (rows x n), or those from the first-th on; the largest number for an empty row."""
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(bounds) - 1, n - first), np.uint32)
    buffer = np.empty_like(x)
    for k, (a, b) in enumerate(zip(*multipliers(n), strict=True)):
        if first <= k:
            np.add(np.multiply(x, a, out=buffer), b, out=buffer)
            out[:, k - first] = C.reduced(np.minimum, buffer, bounds, np.uint32(0xFFFFFFFF))
    return out


def band_keys(mins: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band (rows x bands)."""
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(mins), bands)).copy()
    by_band = mins.reshape(len(mins), bands, rows).astype(np.uint64)
    for r in range(rows):
        x = C.mix(x * np.uint64(C.BASE) + by_band[:, :, r])
    return x


def marks_of(mins: np.ndarray, rows: int) -> np.ndarray:
    """A mark for each band of `rows` minima: MARK_BITS bits of each of the 64 minima that follow the band's own, in turn (rows x bands x MARK_BITS).

    The bits are of mixed minima, so that unlike ones agree by chance and in each place anew, however few shingles a text has.
    """
    items, n = mins.shape
    if n - rows < 64:
        raise ValueError("a mark needs 64 minima beside its band's")
    x = mins ^ (mins >> np.uint32(16))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    out = np.empty((items, n // rows, MARK_BITS), np.uint64)
    bits = np.zeros((items, -(-2 * n // 64) * 64), bool)
    for plane in range(MARK_BITS):
        bits[:, :n] = bits[:, n : 2 * n] = x >> np.uint32(31 - plane) & np.uint32(1)
        words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        for band in range(n // rows):
            at, shift = divmod(rows * (band + 1), 64)
            out[:, band, plane] = words[:, at] if not shift else words[:, at] >> np.uint64(shift) | words[:, at + 1] << np.uint64(64 - shift)
    return out


def most_differ(percent: int) -> int:
    """In how many of its 64 places a mark may differ from that of a partner: 3.5 standard errors more than is expected at the threshold."""
    q = (1 - percent / 100) * (1 - 2.0**-MARK_BITS)
    return int(64 * q + 3.5 * (64 * q * (1 - q)) ** 0.5)


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places in which marks differ."""
    return np.bitwise_count(np.bitwise_or.reduce(x ^ y, axis=-1))


def pack_bits(mins: np.ndarray) -> np.ndarray:
    """The low bits of N_BITS minima in planes: of each 64 minima a long for every bit (rows x LONGS)."""
    planes = mins.reshape(len(mins), -1, 1, 64) >> np.arange(BITS, dtype=np.uint32)[:, None] & np.uint32(1)
    return np.packbits(planes.astype(bool), axis=3, bitorder="little").reshape(len(mins), LONGS * 8).view(np.int64)


def bits_column(mins: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(mins) * LONGS + 1, LONGS), pa.int32()), pa.array(pack_bits(mins).ravel()))


def estimate(x: str, y: str):
    """The similarity by equal groups of bits, corrected for chance: a native expression over two arrays of longs, each named once a plane, as the compiler leaves long methods alone."""
    differ = F.lit(0)
    for first in range(0, LONGS, BITS):
        planes = [F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))) for i in range(first, first + BITS)]
        differ = differ + F.bit_count(reduce(lambda a, z: a.bitwiseOR(z), planes))
    chance = 2.0**-BITS
    return (1 - differ / N_BITS - chance) / (1 - chance)


def least_estimate(percent: int) -> float:
    """Pairs whose estimate is below this aren't verified: 6 standard errors under the threshold."""
    t = percent / 100
    return t - 6 * (t * (1 - t) / N_BITS) ** 0.5


def runs(ids: np.ndarray) -> Iterator[slice]:
    """Slices of ascending ids that are less than 65,536 apart."""
    first = 0
    while first < len(ids):
        end = int(np.searchsorted(ids, ids[first] + 65_536))
        yield slice(first, end)
        first = end


def joint(part, low):
    """A bucket's key: the part and the lower half of the band key."""
    return (np.asarray(part).astype(np.int64) << 32) | low.astype(np.int64)


def deal(ids: np.ndarray, keys: np.ndarray, parts: int, small: int, marks: np.ndarray | None = None) -> Iterator[tuple[int, int, int, bytes, bytes, bytes]]:
    """Rows (kind, part, base, a, b, marks) of items' band keys (items x bands). BAND and CENTRE rows have 4 bytes of each key and 2 of each id, as the distance from base, and the marks, if there are any.

    A key that more than `small` of these items share proposes stars here (PAIR and MEMBER rows of longs) and sends only its centres on.
    """
    order = np.argsort(ids)
    ids, keys = ids[order], keys[order]
    marks = np.zeros((*keys.shape, 0), np.uint64) if marks is None else marks[order]
    for run in runs(ids):
        base, bands = int(ids[run.start]), keys.shape[1]
        key, near = keys[run].ravel(), np.repeat(ids[run] - base, bands)
        part = ((key >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)
        low, mark = key.astype(np.uint32), marks[run].reshape(len(key), -1)
        groups = [(BAND, np.arange(len(key)))]
        in_order = np.sort(key)
        many = np.unique(in_order[small:][in_order[small:] == in_order[:-small]])
        if len(many):
            often = many[np.minimum(np.searchsorted(many, key), len(many) - 1)] == key
            at = np.flatnonzero(often)
            a, b, members, sent = stars(joint(part[at], low[at]), near[at])
            where = int(C.mix(np.array([base], np.uint64))[0] % np.uint64(parts))
            yield MEMBER, where, 0, joint(part[at], low[at])[members].tobytes(), (near[at][members] + base).tobytes(), b""
            yield PAIR, where, 0, (a + base).tobytes(), (b + base).tobytes(), b""
            groups = [(BAND, np.flatnonzero(~often)), (CENTRE, at[sent])]
        for kind, picked in groups:
            by_part = picked[np.argsort(part[picked], kind="stable")]
            bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
            k, x, m = low[by_part], near[by_part].astype(np.uint16), mark[by_part]
            for p in np.flatnonzero(np.diff(bounds)).tolist():
                own = slice(bounds[p], bounds[p + 1])
                yield kind, p, base, k[own].tobytes(), x[own].tobytes(), m[own].tobytes()


def stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b) of each bucket's members with its centres, and the places of the members and of the centres."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, int)
    left, right, sent = [ids[:0]], [ids[:0]], []
    for s, e in zip(starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True):
        members = ids[order[s:e]]
        for c in range(CENTRES):
            at = int(np.argmin(members if c == 0 else C.mix(members.astype(np.uint64) + np.uint64(c))))
            sent.append(order[s + at])
            left.append(np.full(e - s, members[at]))
            right.append(members)
    a, b = np.concatenate(left), np.concatenate(right)
    a, b = packed_edges(a[a != b], b[a != b])
    return a, b, order, np.unique(np.array(sent, np.int64))


def clumps(marks: np.ndarray, most: int, small: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's members: for each the first of its clump, joined by chains of marks that differ in at most `most` places, and whether the clump is dense, with
    more than small / 2 pairs of such marks for each member; and the pairs (a, b) within the others."""
    n = len(marks)
    clump, sizes = np.arange(n), np.zeros(n, np.int64)
    left, right = [np.zeros(0, np.uint16)], [np.zeros(0, np.uint16)]
    for i in range(n - 1):
        near = i + 1 + np.flatnonzero(differ(marks[i], marks[i + 1 :]) <= most)
        if len(near):
            names = np.unique(np.append(clump[near], clump[i]))
            if len(names) > 1:
                clump[np.isin(clump, names)] = names[0]
            sizes[i] = len(near)
            left.append(np.full(len(near), i, np.uint16))
            right.append(near.astype(np.uint16))
            if sizes.sum() > small // 2 * n and not clump.any():  # one clump, and a dense one
                return clump, np.ones(n, bool), left[0], right[0]
    a, b = np.concatenate(left), np.concatenate(right)
    dense = (np.bincount(clump, sizes, n) > small // 2 * np.bincount(clump, minlength=n))[clump]
    return clump, dense, a[~dense[a]], b[~dense[a]]


def bucket_pairs(keys: np.ndarray, ids: np.ndarray, centre: np.ndarray, small: int, marks: np.ndarray | None = None, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a, b) of the buckets, and the (key, id) members of the large ones: those with more than `small` members, or with a centre of a batch.

    With marks, only pairs that differ in at most `most` places are candidates, and buckets of up to CLOSE members without a centre fall into
    clumps: a dense one is treated as a large bucket, all pairs of like marks of the others are proposed.
    """
    order = np.argsort(keys)
    k, x, centre = keys[order], ids[order], centre[order]
    marks = None if marks is None else marks[order]
    first = np.append(True, k[1:] != k[:-1])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(k)))
    sent = np.logical_or.reduceat(centre, starts)
    large = np.repeat((sizes > small) | sent, sizes)
    left, right = [x[:0]], [x[:0]]
    ends = np.repeat(starts + sizes, sizes)
    at = np.flatnonzero(~large)
    for d in range(1, small):
        at = at[at + d < ends[at]]
        if not len(at):
            break
        like = at if marks is None else at[differ(marks[at], marks[at + d]) <= most]
        left.append(x[like])
        right.append(x[like + d])
    group = np.repeat(starts, sizes)
    if marks is not None:
        for s, e in zip(*(y[(sizes > small) & (sizes <= CLOSE) & ~sent].tolist() for y in (starts, starts + sizes)), strict=True):
            clump, dense, a, b = clumps(marks[s:e], most, small)
            left.append(x[s:e][a])
            right.append(x[s:e][b])
            group[s:e] = s + clump
            large[s:e] = dense
    a, b, members, _ = stars(group[large], x[large])
    a, b = np.concatenate((*left, a)), np.concatenate((*right, b))
    a, b = packed_edges(a[a != b], b[a != b])
    return a, b, k[large][members], x[large][members]


def dealt(items: DataFrame, keys: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray | None]], small: int = SMALL) -> DataFrame:
    """Packed rows of a table whose first column is the items' id; keys: gives a batch's band keys (items x bands) and their marks (items x bands x MARK_BITS), if it has any."""
    parts = SHARES * C.spread(items)

    def packed(ids: list[np.ndarray], band: list[np.ndarray], mark: list[np.ndarray | None]) -> pa.RecordBatch:
        marks = None if mark[0] is None else np.concatenate(mark)
        kind, part, base, a, b, m = zip(*deal(np.concatenate(ids), np.concatenate(band), parts, small, marks), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(part, pa.int32()), pa.array(base, pa.int64()), C.binary(a), C.binary(b), C.binary(m)], ["kind", "part", "base", "a", "b", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, band, mark = [], [], []
        for batch in batches:
            if batch.num_rows:
                own, its = keys(batch)
                ids.append(np.asarray(batch.column(0)))
                band.append(own)
                mark.append(its)
                if sum(map(len, ids)) >= DEALT:
                    yield packed(ids, band, mark)
                    ids, band, mark = [], [], []
        if ids:
            yield packed(ids, band, mark)

    return items.mapInArrow(run, "kind int, part int, base bigint, a binary, b binary, marks binary")


def candidates(rows: DataFrame, small: int = SMALL, most: int | None = None) -> DataFrame:
    """(kind, a, b) of dealt rows: PAIR with two ids, MEMBER with a key and an id. A task holds one part's entries at a time. most: places in which marks may differ, if there are any."""

    def found(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, len(a), 50_000):
            x, y = a[first : first + 50_000], b[first : first + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x), pa.array(y)], ["kind", "a", "b"])

    def gathered(part: int | None, keys: list[np.ndarray], ids: list[np.ndarray], centre: list[np.ndarray], marks: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if keys:
            own = (None, 0) if most is None else (np.concatenate(marks), most)
            a, b, key, member = bucket_pairs(np.concatenate(keys), np.concatenate(ids), np.concatenate(centre), small, *own)
            yield from found(PAIR, a, b)
            yield from found(MEMBER, joint(part, key), member)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, ids, centre, marks = None, [], [], [], []
        for batch in batches:
            for kind, part, base, a, b, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    yield from gathered(at, keys, ids, centre, marks)
                    at, keys, ids, centre, marks = part, [], [], [], []
                if kind in (BAND, CENTRE):
                    keys.append(np.frombuffer(a, np.uint32))
                    ids.append(np.frombuffer(b, np.uint16).astype(np.int64) + base)
                    centre.append(np.full(len(keys[-1]), kind == CENTRE))
                    if most is not None:
                        marks.append(np.frombuffer(m, np.uint64).reshape(-1, MARK_BITS))
                else:
                    yield from found(kind, np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))
        yield from gathered(at, keys, ids, centre, marks)

    return rows.repartition(C.spread(rows), "part").sortWithinPartitions("part").mapInArrow(run, "kind int, a bigint, b bigint")


def sets_of(blobs: list[bytes], sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of compressed texts, with bounds."""
    undo = zstandard.ZstdDecompressor()
    values, sizes = [], []
    for _, _, data, offsets in C.chunks(C.binary([undo.decompress(x) for x in blobs])):
        v, bounds = sets(data, offsets)
        values.append(v)
        sizes.append(np.diff(bounds))
    return np.concatenate(values) if values else np.zeros(0, np.uint64), np.concatenate(([0], *map(np.cumsum, [np.concatenate(sizes)] if sizes else []))).astype(np.int64)


def slices(batch: pa.RecordBatch, *columns: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose compressed texts have some 2^18 bytes, or one longer row."""
    sizes = sum(np.diff(C.text_bytes(batch.column(c))[1]) for c in columns)
    ends = np.cumsum(sizes)
    first = 0
    while first < batch.num_rows:
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(first, end - first)
        first = end


Hot = tuple[list[int], list[int]]


def with_both(pairs: DataFrame, texts: DataFrame, often: Hot, column: str, x: str, y: str) -> DataFrame:
    """pairs with a column of both ends' texts."""
    left, right = texts.select(F.col("id").alias("a"), F.col(column).alias(x)), texts.select(F.col("id").alias("b"), F.col(column).alias(y))
    return salted_join(salted_join(pairs, left, "a", "b", often[0]), right, "b", "a", often[1]).select("a", "b", x, y)


def verify(pairs: DataFrame, texts: DataFrame, often: Hot, sets: Sets, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union. texts: id and z, its compressed text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 3):
                (va, ba), (vb, bb) = (sets_of(part.column(c).to_pylist(), sets) for c in (2, 3))
                na, nb = np.diff(ba), np.diff(bb)
                bounds = np.concatenate(([0], np.cumsum(na + nb)))
                both = np.empty(bounds[-1], np.uint64)
                both[np.arange(len(va)) + np.repeat(bounds[:-1] - ba[:-1], na)] = va
                both[np.arange(len(vb)) + np.repeat(bounds[:-1] + na - bb[:-1], nb)] = vb
                union = np.diff(C.distinct(both, bounds)[1])
                linked = pa.array((100 * (na + nb - union) >= percent * union) & (union > 0))
                yield part.select(["a", "b"]).filter(linked)

    return with_both(pairs, texts, often, "z", "za", "zb").mapInArrow(run, "a bigint, b bigint")


def plausible(pairs: DataFrame, texts: DataFrame, often: Hot, percent: int) -> DataFrame:
    """Drops pairs that the estimate from their packed bits rules out."""
    return with_both(pairs, texts, often, "bits", "x", "y").where(estimate("x", "y") >= least_estimate(percent)).select("a", "b")


def linked(pairs: DataFrame, bits: DataFrame | None, texts: Texts, sets: Sets, percent: int) -> DataFrame:
    """The candidate pairs, which are on disk already, that are links, on disk. Without bits all of them are verified."""
    often = hot(pairs, "a"), hot(pairs, "b")
    likely = pairs if bits is None else C.settled(plausible(pairs, bits, often, percent))
    known = C.settled(texts(ends(likely).distinct()))
    return C.settled(verify(likely, known, often, sets, percent))


def open_buckets(members: DataFrame, found: DataFrame, middle: int) -> tuple[DataFrame, DataFrame]:
    """What large buckets (key, id) with several components are left with: the rows (key, id, component) of those with up to `middle` members, and
    of the larger ones the members (id, query, component) at once; query: outside the largest component of such a bucket.

    The latter is told by component, so a few members more than needed may come along.
    """
    m = labelled(members, found).checkpoint()
    counted = m.groupBy("key", "component").agg(F.count("*").alias("n")).checkpoint()
    buckets = counted.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1")
    large = hot(members, "key", middle)
    close = m.where(~F.col("key").isin(large)).join(buckets.where(F.col("n") <= middle).select("key"), "key", "left_semi")
    comps = counted.join(buckets.where(F.col("n") > middle), "key").groupBy("component").agg(F.max(F.col("component") != F.col("main")).alias("query"))
    comps = comps.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    once = m.select("id", "component").distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return close.select("key", "id", "component"), once.join(comps, ["component", "salt"]).select("id", "query", "component")


def bucket_estimates(close: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket (key, id, component) that their packed bits don't rule out."""
    least = least_estimate(percent)

    def run(group: pa.Table) -> pa.Table:
        ids, comp = np.asarray(group["id"]), np.asarray(group["component"])
        bits = np.asarray(group["bits"].combine_chunks().flatten()).view(np.uint64).reshape(-1, LONGS)
        left, right = [ids[:0]], [ids[:0]]
        for i in range(len(ids) - 1):
            planes = (bits[i] ^ bits[i + 1 :]).reshape(-1, LONGS // BITS, BITS)
            differ = np.bitwise_count(np.bitwise_or.reduce(planes, axis=2)).sum(1, dtype=np.int64)
            fits = (1 - differ / N_BITS - 2.0**-BITS) / (1 - 2.0**-BITS) >= least
            at = i + 1 + np.flatnonzero(fits & (comp[i + 1 :] != comp[i]))
            left.append(np.full(len(at), ids[i]))
            right.append(ids[at])
        a, b = packed_edges(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return close.join(texts.select("id", "bits"), "id").groupBy("key").applyInArrow(run, "a bigint, b bigint").distinct()


def rare_pairs(opened: DataFrame, texts: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """Pairs (a, b) of open members, one of them a query, of different components, that may have the similarity by their rarest shingles.

    In each set the shingles are ordered by frequency among the members. A pair with sizes n and m needs an intersection of o = t / (1 + t) (n + m), so
    it has a common shingle after which either has o - 1 more; with n <= m the smaller one's places and the larger one's are
    both bounded, and the larger one looks only into the size classes that its place allows.
    """
    t = percent / 100

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 3):
                values, bounds = sets_of(part.column(3).to_pylist(), sets)
                row = C.rows_of(bounds)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in range(3)), pa.array(np.diff(bounds)[row]), pa.array(values.view(np.int64))], ["id", "query", "component", "n", "token"])

    def size_class(n):
        return F.floor(F.log(n) / float(np.log(CLASS))).cast("int")

    each = opened.join(texts, "id").select("id", "query", "component", "z").mapInArrow(tokens, "id bigint, query boolean, component bigint, n bigint, token bigint")
    often = each.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    # a set's own shingles come first, so its shared ones begin at the number of its own; no more than a text's shingles are collected
    shared = each.join(often, "token").groupBy("id", "query", "component", "n").agg(F.array_sort(F.collect_list(F.struct("times", "token"))).alias("s"))
    placed = shared.select("id", "query", "component", "n", F.posexplode("s").alias("i", "s"), (F.col("n") - F.size("s")).alias("own")).select("id", "query", "component", "n", F.col("s.token").alias("token"), (F.col("own") + F.col("i")).alias("place"))
    left = F.col("n") - F.col("place")  # this shingle and all after it
    most = F.floor(left * ((1 + t) / t) - F.col("n") + 1e-6)  # the largest partner that this place allows
    placed = placed.withColumn("most", most).where(F.col("most") >= F.ceil(F.col("n") * t - 1e-6)).checkpoint()
    smaller = placed.where("most >= n").select(F.col("id").alias("a"), F.col("query").alias("qa"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), "token", size_class(F.col("n")).alias("class"))
    top = F.least("n", "most")
    larger = placed.select(F.col("id").alias("b"), F.col("query").alias("qb"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), "token", F.explode(F.sequence(size_class(F.ceil(F.col("n") * t - 1e-6)), size_class(top))).alias("class"))
    fits = (F.col("na") <= F.col("mb")) & (F.col("nb") <= F.col("ma")) & ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") != F.col("b"))))
    pairs = smaller.join(larger, ["token", "class"]).where(fits & (F.col("qa") | F.col("qb")) & (F.col("ca") != F.col("cb")))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b"))


def link(found: DataFrame, bits: Texts, texts: Texts, sets: Sets, percent: int, middle: int = 0, marked: bool = False) -> DataFrame:
    """Components (id, component) of the candidates (kind, a, b), which are on disk already.

    bits: gives (id, bits); texts: gives (id, z). middle: members of a bucket whose packed bits are compared in one task. marked: the
    candidates' marks were alike, so that packed bits are asked for only by members of open buckets.
    """
    pairs = C.settled(found.where(F.col("kind") == PAIR).select("a", "b").distinct())
    members = found.where(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("id"))
    packed = None if marked else C.settled(bits(ends(pairs).union(members.select("id")).distinct()))
    links = linked(pairs, packed, texts, sets, percent)
    comps = components(links)
    if members.isEmpty():
        return comps
    close, larger = (x.checkpoint() for x in open_buckets(members, comps, middle))
    if packed is None:
        packed = C.settled(bits(close.select("id").union(larger.select("id")).distinct()))
    parts = [] if larger.isEmpty() else [rare_pairs(larger, texts(larger.select("id").distinct()), sets, percent)]
    if middle:
        parts.append(bucket_estimates(close, packed, percent))
    if not parts:
        return comps
    more = C.settled(reduce(DataFrame.union, parts).distinct())
    if more.isEmpty():
        return comps
    more = linked(more, packed, texts, sets, percent)
    # every pair across components of a bucket has now been compared
    return comps if more.isEmpty() else components(comps.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def compressed(docs: DataFrame, named: Callable[[pa.RecordBatch], np.ndarray], schema: str) -> DataFrame:
    """Names of rows (rows x columns of longs, as in the schema) and z, their last column as compressed text: texts that are to be shuffled travel so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, offsets = C.text_bytes(batch.column(batch.num_columns - 1))
            view = memoryview(np.ascontiguousarray(data))
            ends, names = offsets.tolist(), named(batch)
            z = C.binary([pack.compress(view[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)])
            yield pa.RecordBatch.from_arrays([*(pa.array(names[:, i]) for i in range(names.shape[1])), z], [*(x.split()[0] for x in schema.split(",")), "z"])

    return docs.mapInArrow(run, f"{schema}, z binary")
