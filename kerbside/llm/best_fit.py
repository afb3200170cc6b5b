"""Best-fit packing of documents into sequences, with a swap-based local search.

A document is its text's token ids and an end id. One that is longer than a sequence is cut into full pieces, of which the
first may be shorter; all others stay whole. Pieces are packed in groups of GROUP, which tasks form from their own rows:
best fit in falling order first, then the search, which takes the emptiest bins in turn. Of all moves of one or two of its
pieces into another underfull bin, against none, one or two of that bin's pieces, it makes the one that carries most tokens
over. Each such exchange raises the sum of squared fills, as the receiver is the fuller one, so the search ends; a bin whose
last piece has gone is dropped. It stops as well when there are no more bins than the tokens need.

Well-filled bins are sequences then. The pieces of the others, a few bins of each group, are dealt into new groups, until
one group holds them all or a round saves next to nothing. So rounds work on some thousandth of the round before, no row of
a well-filled bin is shuffled, and a task holds GROUP pieces at most.

Edge cases: a null or empty text is the end id alone; null ids of rows, repeated rows and very long texts need no special
care; other columns of `pack`'s input are kept, but for its own two names; an empty table gives no pieces.
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
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StructType

from kerbside.llm import common as C
from kerbside.llm.byte_bpe import read_ranks

FULL, END_ID = 2048, 0
#: Pieces of a group.
GROUP = 8192
#: A bin with more than this share of its room free goes to the next round.
OPEN = 1 / 64
#: Bins of a group that the search tries in turn, emptiest first, since its last exchange.
TRIES = 8
#: Rounds end when one saves less than this share of its bins.
GAIN = 0.001
CACHE_UNITS, LONG_UNIT = 500_000, 48
#: White space other than blanks and line ends (fixed values: the property White_Space), and the separator used here.
OTHER_WHITE = re.compile("[\t\r\x0b\x0c\x00\x85\xa0  -     　]")


class UnitIds(dict):
    """Token ids by unit: a run of other characters with the blank before it, or a line end.

    Where no white space follows other white space, a new token begins at each blank and line end, so units are encoded apart
    and repeated ones come from a table. Any other text goes to the library as a whole.
    """

    def __init__(self, path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}).encode_ordinary
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.ids, self.begins = array("I"), array("q", [0])

    def whole(self, text: str) -> list[int]:
        """The rank library has the same merges and is faster. It doesn't know the added tokens, nor need it class all characters alike."""
        if max(text, default="") < "\u0100" and not any(t in text for t in self.added):
            return self.plain(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, unit: str) -> int:
        self.ids.extend(self.whole(unit))
        self.begins.append(len(self.ids))
        place = len(self.begins) - 2
        if len(unit) <= LONG_UNIT:
            self[unit] = place
        return place

    def units(self, text: str) -> list[str]:
        if any(pair in text for pair in ("  ", "\n\n", " \n", "\n ", *self.added)) or OTHER_WHITE.search(text):
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.begins) > CACHE_UNITS:
            self.clear()
        found = [np.array(itemgetter("", *self.units(text))(self), np.int64) for text in texts]
        ids, begins = np.frombuffer(self.ids.tobytes(), np.uint32), np.frombuffer(self.begins.tobytes(), np.int64)
        for places in found:
            first, n = begins[places], begins[places + 1] - begins[places]
            ends = np.cumsum(n)
            yield ids[np.arange(ends[-1]) + np.repeat(first - ends + n, n)]


@cache
def unit_ids(path: str, ranks_path: str, pattern: str) -> UnitIds:
    return UnitIds(path, ranks_path, pattern)


def pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, end_id: int = END_ID, full: int = FULL) -> DataFrame:
    """doc_id, piece (from 0), start, length and ids (little-endian, 32 bits each) of all documents' pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        table = unit_ids(path, ranks_path, pattern)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for first in range(0, len(texts), 256):
                rows, numbers, starts, lengths, blobs = [], [], [], [], []
                for i, ids in enumerate(table.encode([t or "" for t in texts[first : first + 256].to_pylist()])):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    n = -(-len(ids) // full)
                    at = np.maximum(0, len(ids) - full * np.arange(n, -1, -1))  # the first piece has what is over
                    raw, ends = ids.tobytes(), (at * 4).tolist()
                    blobs += [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    rows += [first + i] * n
                    numbers += range(n)
                    starts.append(at[:-1])
                    lengths.append(np.diff(at))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lengths)), C.binary(blobs)],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return C.with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


def best_fit(lengths: list[int], full: int) -> list[list[int]]:
    """Bins of places in `lengths`: longest first, each into the fullest bin that has room for it."""
    by_room: list[list[int]] = [[] for _ in range(full + 1)]
    rooms, bins = 0, []  # bit r of `rooms`: some bin has room for r
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        fitting = rooms >> lengths[i]
        if fitting:
            room = lengths[i] + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = full, len(bins)
            bins.append([])
        bins[b].append(i)
        room -= lengths[i]
        if room:
            by_room[room].append(b)
            rooms |= 1 << room
    return bins


class Bin:
    """A bin's pieces, and the sums of none, one and two of them, with the pieces behind each sum; equal lengths once."""

    def __init__(self, items: list[int], lengths: list[int]):
        self.items = items
        self.fill = sum(lengths[i] for i in items)
        by_length: dict[int, list[int]] = {}
        for i in items:
            by_length.setdefault(lengths[i], []).append(i)
        kinds = sorted(by_length)
        self.sums, self.behind = [0], [()]
        for k, a in enumerate(kinds):
            self.sums.append(a)
            self.behind.append((by_length[a][0],))
            for b in kinds[k:]:
                if a != b or len(by_length[a]) > 1:
                    self.sums.append(a + b)
                    self.behind.append((by_length[a][0], by_length[b][-1]))
        self.counts = np.array([len(x) for x in self.behind])
        self.sums = np.array(self.sums)


def exchange(giver: Bin, others: list[Bin], full: int) -> tuple[int, int, int] | None:
    """(bin, its sum's place, the giver's): the exchange into a fuller bin that carries most over, if there is one.

    One for one, one or two for none, two for one and one for two; not two for two.
    """
    sums = np.concatenate([b.sums for b in others])
    counts = np.concatenate([b.counts for b in others])
    size = [len(b.sums) for b in others]
    room = np.repeat([full - b.fill if b.fill >= giver.fill else 0 for b in others], size)
    carried = giver.sums[:, None] - sums
    carried[(carried > room) | (carried <= 0) | (giver.counts[:, None] + counts > 3)] = 0
    best = int(carried.argmax())
    if not carried.flat[best]:
        return None
    mine, at = divmod(best, len(sums))
    ends = np.cumsum(size)
    b = int(np.searchsorted(ends, at, "right"))
    return b, at - int(ends[b]) + size[b], mine


def improve(bins: list[list[int]], lengths: list[int], full: int) -> list[list[int]]:
    """Empties bins by exchanges, until there are no more than the tokens need or the emptiest ones can't be emptied."""
    need = -(-sum(lengths) // full)
    fills = [sum(lengths[i] for i in b) for b in bins]
    closed = [b for b, f in zip(bins, fills, strict=True) if f >= full]
    under = [Bin(b, lengths) for b, f in zip(bins, fills, strict=True) if f < full]
    stuck = 0
    while len(closed) + len(under) > need and stuck < min(TRIES, len(under) - 1):
        under.sort(key=lambda b: b.fill)
        giver, stuck = under.pop(stuck), stuck + 1
        while giver.items and (found := exchange(giver, under, full)):
            b, theirs, mine = found
            there, here = under[b].behind[theirs], giver.behind[mine]
            under[b] = Bin([i for i in under[b].items if i not in there] + [*here], lengths)
            giver, stuck = Bin([i for i in giver.items if i not in here] + [*there], lengths), 0
        if giver.items:
            under.append(giver)
    return closed + [b.items for b in under]


def packed(lengths: np.ndarray, full: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, room left in it) of each piece."""
    own = lengths.tolist()
    number, offset, room = (np.zeros(len(own), np.int64) for _ in range(3))
    for b, items in enumerate(improve(best_fit(own, full), own, full)):
        ends = np.cumsum(lengths[items])
        number[items], offset[items], room[items] = b, ends - lengths[items], full - ends[-1]
    return number, offset, room


def pack_round(rows: DataFrame, turn: int, full: int) -> DataFrame:
    """sequence_id, offset and whether the sequence is open, for each row, by groups of each partition's rows."""
    schema = StructType([*rows.schema.fields]).add("sequence_id", LongType()).add("offset", LongType()).add("open", BooleanType())
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        base, made, waiting, n = (turn << 58) + (TaskContext.get().partitionId() << 32), 0, [], 0

        def group() -> Iterator[pa.RecordBatch]:
            nonlocal made
            table = pa.Table.from_batches(waiting)
            number, offset, room = packed(table.column("length").to_numpy(), full)
            new = pa.array(base + made + number), pa.array(offset), pa.array(room > full * OPEN)
            made += int(number.max()) + 1
            yield from pa.Table.from_arrays([*table.columns, *new], names=arrow.names).to_batches()

        for batch in batches:
            while batch.num_rows:
                take = min(GROUP - n, batch.num_rows)
                waiting.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == GROUP:
                    yield from group()
                    waiting, n = [], 0
        if n:
            yield from group()

    return rows.mapInArrow(run, schema)


def pack(rows: DataFrame, full: int = FULL) -> DataFrame:
    """The pieces (a column `length`, at most `full`) with sequence_id and offset."""
    columns = [c for c in rows.columns if c not in ("sequence_id", "offset", "open")]
    left, done, turn, groups, before = rows.select(*columns), None, 0, None, None
    while True:
        made = C.settled(pack_round(left, turn, full))
        n, bins = made.where("open").agg(F.count("*"), F.count_distinct("sequence_id")).first()
        last = n == 0 or groups == 1 or (before is not None and before - bins < GAIN * before)
        part = made if last else made.where("not open")
        done = part if done is None else done.unionByName(part)
        if last:
            return done.select(*columns, "sequence_id", "offset")
        turn, groups, before = turn + 1, -(-n // GROUP), bins
        left = made.where("open").select(*columns).repartition(groups)


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    made = pieces(C.documents(spark, sf_dir), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    return pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
