"""Source divergence audit: how far the word shares of a language's sources lie from each other and from the language's.

Terms are maximal runs of letters and of characters from U+0080 on, A-Z lower-cased. A language keeps the terms that at
least `least_docs` of its documents hold (V of them). A group is a (lang, source); it gives each kept term with `count`
occurrences the share p = 1 + (SCALE * (count + 1)) div (N + V), N its occurrences of kept terms, so a term that it lacks
has a share too. One share differs from another by f = ((p - q) * (p - q)) div q.

`pairs` is a sparse merge by pair tasks. The kept terms are numbered, and a block is a run of at most BLOCK numbers of one
language; each group has in each block its sorted array of term ids with their counts. Sources are dealt into tiles of TILE,
and a task co-groups the arrays of two tiles in one block, so an array is sent to each tile and not to each other source.
Within the task each unordered pair of groups is merged once: a galloping intersection finds the overlap, and overlaps,
one-sided terms and terms that both lack are priced in both directions. The blocks' parts are then summed. Memory is bounded
by 2 * TILE * BLOCK entries whatever the number of documents, and no group of rows lands in one task: counting is by term.

`terms` ranks the terms that a group uses more than its language does.

Edge cases: null text, lang or source is ''; repeated rows count each; ids don't matter, so null ids do no harm; a group
without terms takes part with count 0 throughout; a language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs; ties rank by the item's UTF-8 bytes; an empty table gives no rows. Counts up to
9 * 10^15 a group are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm import common as C
from kerbside.llm import terms as T

SCALE = 1_000_000_000
LEAST_DOCS = 3
TOP_TERMS = 200
#: Term numbers of a block, and sources of a tile: a task merges at most 2 * TILE arrays of at most BLOCK entries.
BLOCK, TILE = 1 << 15, 16
#: Bytes of text that are counted together.
TOGETHER = 8 << 20
#: Keys between two places from which the search gallops.
STRIDE = 64


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        C.steady()
        for batch in batches:
            groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
            for first, end, data, offsets in C.chunks(batch.column(2), TOGETHER):
                found, bounds = T.terms(data, offsets, T.LETTERS)
                coded = found.dictionary_encode()
                own, width = groups.slice(first, end - first).to_pylist(), len(coded.dictionary)
                known: dict[tuple, int] = {}
                group = np.array([known.setdefault((g["lang"], g["source"]), len(known)) for g in own], np.int64)
                keys, n = T.tally(C.rows_of(bounds) * width + np.asarray(coded.indices, np.int64))
                keys = group[keys // max(1, width)] * width + keys % max(1, width)  # of the group, not of the row
                order = np.argsort(keys, kind="stable")
                keys, n = keys[order], n[order]
                start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys
                labels, place = [*known], pa.array(keys[start] // max(1, width), pa.int32())
                names = [pa.DictionaryArray.from_arrays(place, pa.array([x[i] for x in labels], pa.string())).cast(pa.string()) for i in (0, 1)]
                term = coded.dictionary.take(pa.array(keys[start] % max(1, width))).cast(pa.binary()).cast(pa.string())
                total = np.add.reduceat(n, start) if len(start) else n
                yield pa.RecordBatch.from_arrays([*names, term, pa.array(total, pa.int64()), pa.array(np.diff(np.append(start, len(keys))), pa.int64())], ["lang", "source", "term", "n", "docs"])

    parts = named(docs).mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def named(docs: DataFrame) -> DataFrame:
    rows = C.with_defaults(docs, lang="string", source="string", text="string")
    return rows.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")


class Audit:
    """The tables that both reports need, each written once: groups (N, V), kept terms and the groups' counts of them."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        with C.tidy(docs.sparkSession):
            every = C.settled(counts(docs))
        # numbers rise with the term within a partition, and a block never spans two partitions
        kept = every.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        numbered = kept.drop("docs").sortWithinPartitions("lang", "term").withColumn("id", F.monotonically_increasing_id())
        self.kept = C.settled(numbered.withColumn("block", F.shiftright("id", BLOCK.bit_length() - 1)))
        languages = self.kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
        sizes = every.join(self.kept.select("lang", "term"), ["lang", "term"], "left_semi").groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
        groups = named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
        groups = groups.na.fill(0, ["group_n", "v", "lang_n"])
        # one row for each source of a language, as in the report itself
        own = Window.partitionBy("lang")
        place = F.row_number().over(own.orderBy("source")) - 1
        self.groups = C.settled(groups.withColumn("place", place).withColumn("tile", F.floor(F.col("place") / TILE).cast("int")).withColumn("tiles", F.max("tile").over(own) + 1))
        self.own = every.select("lang", "source", "term", "n").join(self.kept, ["lang", "term"])

    def pairs(self) -> DataFrame:
        """lang, source, item (the other source), value: for each ordered pair of a language's sources."""
        arrays = self.own.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("terms"))
        blocks = self.kept.groupBy("lang", "block").agg(F.count("*").alias("width"))
        # a language without kept terms has one block of width 0
        none = self.groups.where("v = 0").select("lang", F.lit(-1).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("width")).distinct()
        grid = self.groups.join(blocks.unionByName(none), "lang").join(arrays, ["lang", "source", "block"], "left")
        grid = C.settled(grid.select("lang", "source", "block", "width", "place", "tile", "tiles", (F.col("group_n") + F.col("v")).alias("whole"), "terms.id", "terms.n"))
        left = grid.withColumn("other", F.explode(F.sequence("tile", F.col("tiles") - 1))).withColumn("mine", F.col("tile"))
        right = grid.select(*[F.col(c).alias(c) for c in grid.columns]).withColumn("mine", F.explode(F.sequence(F.lit(0), "tile"))).withColumn("other", F.col("tile"))
        key = ["lang", "block", "mine", "other"]
        priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_merge_tiles, "lang string, a string, b string, ab bigint, ba bigint")
        total = priced.groupBy("lang", "a", "b").agg(F.sum("ab").alias("ab"), F.sum("ba").alias("ba"))
        sides = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value")))
        return total.select("lang", F.inline(sides))

    def terms(self, top: int = TOP_TERMS) -> DataFrame:
        """lang, source, item (the term), value and rank: each group's `top` terms that it uses more than its language."""
        rows = self.own.join(self.groups.select("lang", "source", "group_n", "v", "lang_n"), ["lang", "source"])
        p, q = share(F.col("n"), F.col("group_n") + F.col("v")), share(F.col("total"), F.col("lang_n") + F.col("v"))
        above = rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
        return ranked(above.select("lang", "source", "item", F.expr("(p - q) * (p - q) div q").alias("value"))).where(F.col("rank") <= top)


def share(n: Column, whole: Column) -> Column:
    """1 + (SCALE * (n + 1)) div whole, three digits at a time, so that no product leaves 64 bits."""
    rest, digits = n + 1, F.lit(0).cast("bigint")
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return digits + 1


def shares(n: np.ndarray, whole: int) -> np.ndarray:
    """As `share`, over an array."""
    rest, digits = n + 1, np.zeros_like(n)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // max(1, whole)
        rest = rest % max(1, whole)
    return digits + 1


def price(p: np.ndarray, q: np.ndarray) -> int:
    return int(((p - q) * (p - q) // q).sum())


def gallop(few: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The place of the first of `many` not under each of `few`; both sorted.

    Every STRIDE-th key is placed by bisection; the others start at the place of the key before them, double their steps
    until they have passed, and bisect the last step. All keys move at once.
    """
    anchors = np.searchsorted(many, few[::STRIDE])
    low = np.repeat(anchors, STRIDE)[: len(few)]
    step, high = np.ones(len(few), np.int64), low.copy()
    moving = np.flatnonzero(high < len(many))
    moving = moving[many[high[moving]] < few[moving]]
    while len(moving):
        low[moving] = high[moving] + 1
        high[moving] += step[moving]
        step[moving] *= 2
        moving = moving[high[moving] < len(many)]
        moving = moving[many[high[moving]] < few[moving]]
    high = np.minimum(high, len(many))
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        under = many[middle] < few[open_]
        low[open_[under]] = middle[under] + 1
        high[open_[~under]] = middle[~under]
    return low


def overlap(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the values that both have."""
    if len(a) > len(b):
        return overlap(b, a)[::-1]
    if not len(a):
        return a, a
    at = gallop(a, b)
    hit = np.flatnonzero(at < len(b))
    hit = hit[b[at[hit]] == a[hit]]
    return hit, at[hit]


class Prices:
    """A group's array in one block, with the shares of its terms and of a term that it lacks."""

    def __init__(self, place: int, source: str, width: int, whole: int, ids: pa.Array | None, n: pa.Array | None):
        empty = np.zeros(0, np.int64)
        self.place, self.source, self.width = place, source, width
        self.ids = empty if ids is None else ids.to_numpy(zero_copy_only=False)
        self.p = shares(empty if n is None else n.to_numpy(zero_copy_only=False), whole)
        self.p0 = shares(np.zeros(1, np.int64), whole)

    def against(self, other: Prices) -> tuple[int, int]:
        """The block's part of the sums of f(own, other) and of f(other, own)."""
        mine, theirs = overlap(self.ids, other.ids)
        sides = [(self.p[mine], other.p[theirs], 1), (np.delete(self.p, mine), other.p0, 1), (self.p0, np.delete(other.p, theirs), 1)]
        sides.append((self.p0, other.p0, self.width - sum(max(len(p), len(q)) for p, q, _ in sides if len(p) and len(q))))
        return sum(k * price(p, q) for p, q, k in sides), sum(k * price(q, p) for p, q, k in sides)


def _prices(rows: pa.Table) -> list[Prices]:
    plain = [rows.column(c).to_pylist() for c in ("place", "source", "width", "whole")]
    lists = [[x.values for x in rows.column(c)] for c in ("id", "n")]
    return sorted((Prices(*x) for x in zip(*plain, *lists, strict=True)), key=lambda x: x.place)


def _merge_tiles(left: pa.Table, right: pa.Table) -> pa.Table:
    found = [(a.source, b.source, *a.against(b)) for rows in (_prices(right),) for a in _prices(left) for b in rows if a.place < b.place]
    a, b, ab, ba = zip(*found, strict=True) if found else ((), (), (), ())
    lang = left.column("lang").slice(0, 1).to_pylist() * len(found)
    return pa.table({"lang": pa.array(lang, pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "ab": pa.array(ab, pa.int64()), "ba": pa.array(ba, pa.int64())})


def ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank."""
    own = Audit(docs, least_docs)
    parts = [x.withColumn("part", F.lit(part)) for part, x in (("pair", ranked(own.pairs())), ("term", own.terms(top)))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(C.documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM s GROUP BY ALL),
p AS (SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000::HUGEINT * (s.n + 1)) // (t.n + v.v) AS p FROM s JOIN t ON s.lang = t.lang AND s.source = t.source JOIN v ON v.lang = s.lang),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (v.total + v.v) AS q FROM k JOIN v ON k.lang = v.lang),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
words AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM words)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
QUALIFY part = 'pair' OR rank <= 200
"""
