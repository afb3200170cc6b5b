"""Ranked lexical search by exact sparse ball trees.

A document's vector has for each term tf of it the integer (10^9 * tf) div (1000 * tf + 8 * m), where m grows with the
document's length; an item's vector has each of its terms' integer weight times its occurrences. The score is their inner
product, in 64-bit integers throughout.

One pass over the texts writes, for the terms that the items ask for, each document's counts and length to disk, and the
global statistics come from that table. Tasks then take its rows in shards of SHARD. A shard's vectors are split at the median
along the line between two far ones until LEAF are left; each node keeps its centroid, the radius of the ball around it
that holds its vectors, and the radius in each term alone, upwards. For an item q no vector of the node scores more than
<q, centroid> + |q| * radius, nor more than the sum of q * (centroid + radius) over q's terms; the smaller of the two, rounded up by
more than the error of the doubles it is computed in, is the node's bound. The ball alone prunes nothing in text, where most of
a radius lies in terms that the item lacks: on 8,192 given documents all leaves were opened with it, 23 % with both. Nodes are
opened best first, and all others are left as soon as the best bound is under the k-th best score of the task's shards so
far; documents in opened leaves get their exact integer scores, a few leaves at once. The tasks' best are merged by score and
then by the smaller id.

Items are taken in blocks of at most BLOCK_BYTES of text; a block's terms and weights are what is broadcast.

Edge cases: null or empty texts have no terms, count for nothing and find nothing; rows with a null id count in the
statistics but aren't found; repeated rows are found each; each row of items is an item, with a null id too; ties go to the
smaller id; items without any document over 0, and empty tables, give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm import common as C
from kerbside.llm import terms as T

SHARD, LEAF, TOP = 8192, 8, 10
#: Leaves that are scored together: so many first, then twice as many each time, up to the second number.
WAVE = 8, 256
BLOCK_BYTES = 16 << 20
#: More than the relative error of a sum of some 10^5 products of doubles.
SLACK = 1e-9


def vectors(column: pa.Array, known: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of a text column: first row, end row, (row, place in `known`, count) of known terms, lengths in terms."""
    for first, end, data, offsets in C.chunks(column):
        found, bounds = T.terms(data, offsets, T.LETTERS_DIGITS)
        place = np.asarray(pc.index_in(found, known).fill_null(-1), np.int64)
        hit = np.flatnonzero(place >= 0)
        width = max(1, len(known))
        keys, count = T.tally(C.rows_of(bounds)[hit] * width + place[hit])
        yield first, end, keys // width, keys % width, count, np.diff(bounds)


def project(docs: DataFrame, known: pa.Array) -> DataFrame:
    """doc_id, n (terms with repeats), and the places and counts of the known terms."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, row, place, count, n in vectors(batch.column(1), shared.value):
                starts = pa.array(np.searchsorted(row, np.arange(end - first + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (place, count)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<int>")


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The entries of document vectors; n: the length of each entry's document."""
    kinds, at = np.unique(n, return_inverse=True)
    m = np.array([25 + 75 * x * documents // length for x in kinds.tolist()], np.int64)  # Python's integers: the product is long
    return 1_000_000_000 * tf // (1000 * tf + 8 * m[at])


class Tree:
    """Balls over the vectors of a shard. Each vector has an entry at least; node 0 is the root, children come in pairs."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, term: np.ndarray, value: np.ndarray, n_terms: int):
        self.low, self.high, self.child, self.radius = [], [], [], []
        centroids, leaves, todo = [], [], [(0, np.arange(len(ids)), size, term, value)]
        self.add(0, len(ids))
        while todo:
            node, rows, size, term, value = todo.pop()
            x, ends = value.astype(float), np.cumsum(size)
            begins = ends - size
            norms = np.add.reduceat(x * x, begins)
            centre = np.bincount(term, x, n_terms) / len(rows)
            self.radius[node] = self.far(norms, np.add.reduceat(x * centre[term], begins), float(centre @ centre)).max()
            by = np.argsort(term, kind="stable")
            first = np.flatnonzero(np.append(True, term[by][1:] != term[by][:-1]))
            support = term[by][first]
            reach = np.maximum.reduceat(x[by], first) - centre[support]
            centroids.append((np.full(len(support), node, np.int32), support, centre[support], reach))
            if len(rows) <= LEAF:
                leaves.append((self.low[node], ids[rows], size, term, value))
                continue
            one = self.dense(int((norms - 2 * np.add.reduceat(x * centre[term], begins)).argmax()), begins, ends, term, x, n_terms)
            along = np.add.reduceat(x * one[term], begins)
            two = self.dense(int((norms - 2 * along).argmax()), begins, ends, term, x, n_terms)
            along -= np.add.reduceat(x * two[term], begins)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            self.child[node] = len(self.low)
            for part, low in ((order[:half], self.low[node]), (order[half:], self.low[node] + half)):
                at = np.arange(size[part].sum()) + np.repeat(begins[part] - np.cumsum(size[part]) + size[part], size[part])
                todo.append((len(self.low), rows[part], size[part], term[at], value[at]))
                self.add(low, low + len(part))
        leaves.sort(key=lambda x: x[0])
        self.ids, size, self.term, self.value = (np.concatenate(x) for x in list(zip(*leaves, strict=True))[1:])
        self.start = np.concatenate(([0], np.cumsum(size)))
        self.radius = np.array(self.radius)
        node, term, centre, reach = (np.concatenate(x) for x in zip(*centroids, strict=True))
        by = np.argsort(term, kind="stable")
        self.node, self.centre, self.reach = node[by], centre[by], reach[by]
        self.bounds = np.searchsorted(term[by], np.arange(n_terms + 1))

    def add(self, low: int, high: int) -> None:
        self.low.append(low)
        self.high.append(high)
        self.child.append(0)
        self.radius.append(0.0)

    @staticmethod
    def dense(row: int, begins: np.ndarray, ends: np.ndarray, term: np.ndarray, x: np.ndarray, n_terms: int) -> np.ndarray:
        out = np.zeros(n_terms)
        out[term[begins[row] : ends[row]]] = x[begins[row] : ends[row]]
        return out

    @staticmethod
    def far(norms: np.ndarray, along: np.ndarray, own: float) -> np.ndarray:
        """Distances from a centre, rounded up: the squares cancel, so the error is measured by what was added."""
        return np.sqrt(np.maximum(0.0, norms - 2 * along + own) + SLACK * (norms + own)) * (1 + SLACK)

    def limits(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What no vector of each node can exceed."""
        low, n = self.bounds[terms], self.bounds[terms + 1] - self.bounds[terms]
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        node, weight, nodes = self.node[at], np.repeat(weights, n), len(self.radius)
        along = np.bincount(node, weight * self.centre[at], nodes)
        ball = along + math.sqrt(float(weights @ weights)) * self.radius
        by_term = along + np.bincount(node, weight * self.reach[at], nodes)
        return np.ceil(np.minimum(ball, by_term) * (1 + SLACK)) + 1

    def scores(self, leaves: list[int], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores and ids of the leaves' documents. own: the item's weights by term."""
        rows = np.concatenate([np.arange(self.low[x], self.high[x]) for x in leaves])
        size = self.start[rows + 1] - self.start[rows]
        begins = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(self.start[rows] - begins, size)
        return np.add.reduceat(own[self.term[at]] * self.value[at], begins), self.ids[rows]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, best: tuple[np.ndarray, np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best of `best` and this shard. own: zeros for all terms, left as such."""
        limits = self.limits(terms, weights.astype(float)).tolist()
        own[terms] = weights
        heap, wave = [(-limits[0], 0)], WAVE[0]
        scores, ids = best
        floor = int(scores[-1]) if len(scores) >= k else 1
        while heap and -heap[0][0] >= floor:
            leaves: list[int] = []
            while heap and -heap[0][0] >= floor and len(leaves) < wave:
                node = heapq.heappop(heap)[1]
                if child := self.child[node]:
                    for x in (child, child + 1):
                        if limits[x] >= floor:
                            heapq.heappush(heap, (-limits[x], x))
                else:
                    leaves.append(node)
            if not leaves:
                break
            wave = min(2 * wave, WAVE[1])
            new, where = self.scores(leaves, own)
            if (high := np.flatnonzero(new >= floor)).size:
                scores, ids = np.concatenate((scores, new[high])), np.concatenate((ids, where[high]))
                order = np.lexsort((ids, -scores))[:k]
                scores, ids = scores[order], ids[order]
                floor = int(scores[-1]) if len(scores) >= k else 1
        own[terms] = 0
        return scores, ids


def search_shards(index: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], n_terms: int, documents: int, length: int, k: int) -> DataFrame:
    """item (place in `items`), doc_id and score of each task's best."""
    shared = index.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = shared.value, np.zeros(n_terms, np.int64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked)
        waiting, n = [], 0

        def shard() -> None:
            parts = pa.Table.from_batches(waiting).combine_chunks()
            lists = parts.column("term").combine_chunks()
            size = np.diff(np.asarray(lists.offsets))
            term, tf = (np.asarray(parts.column(c).combine_chunks().flatten(), np.int64) for c in ("term", "tf"))
            value = impacts(tf, np.repeat(parts.column("n").to_numpy(), size), documents, length)
            tree = Tree(parts.column("doc_id").to_numpy(), size, term, value, n_terms)
            for i, (terms, weights) in enumerate(asked):
                if len(terms):
                    best[i] = tree.search(terms, weights, k, best[i], own)

        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            if n >= SHARD:
                shard()
                waiting, n = [], 0
        if n:
            shard()
        size = [len(x[0]) for x in best]
        scores, ids = (np.concatenate([x[i] for x in best] or [np.zeros(0, np.int64)]) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(best)), size), pa.int64()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item bigint, doc_id bigint, score bigint")


def search_block(docs: DataFrame, texts: list[str | None], k: int) -> DataFrame:
    """item (place in `texts`), rank, doc_id and score."""
    data, offsets = C.text_bytes(pa.array(texts, pa.large_string()))
    known = T.terms(data, offsets, T.LETTERS_DIGITS)[0].unique()
    asked = [(row + first, place, count) for first, _, row, place, count, _ in vectors(pa.array(texts, pa.large_string()), known)]
    row, place, count = (np.concatenate(x) for x in zip(*asked, strict=True))
    index = C.settled(project(docs, known))
    documents, length = index.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(known), np.int64)
    for r in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # a row for each term of the block at most
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    items = [(place[a:b][df[place[a:b]] > 0], (count * weight[place])[a:b][df[place[a:b]] > 0]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    found = search_shards(index.where("doc_id is not null and size(term) > 0"), items, len(known), documents, length, k)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id and score. docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    rows = C.with_defaults(docs, doc_id="bigint", text="string")
    kind = dict(items.dtypes).get("item_id", "bigint")
    asked = C.with_defaults(items, item_id=kind, text="string").withColumn("place", F.xxhash64("item_id", "text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, found = max(1, -(-int(size) // BLOCK_BYTES)), []
    for part in range(parts):
        block = asked.where(F.pmod("place", F.lit(parts)) == part).select("item_id", "text").toArrow()  # about BLOCK_BYTES
        if block.num_rows:
            names = spark.createDataFrame(list(enumerate(block["item_id"].to_pylist())), f"item bigint, item_id {kind}")
            best = search_block(rows, block["text"].to_pylist(), k)
            found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return rows.select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("bigint").alias("score")).limit(0)
    for more in found[1:]:
        found[0] = found[0].unionByName(more)
    return found[0]


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
b AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT i, item_id, t, count(*) AS c FROM (SELECT i, item_id, unnest(w) AS t FROM b) GROUP BY ALL),
tf AS (SELECT r, doc_id, m, t, count(*) AS tf FROM (SELECT r, doc_id, 25 + (75 * len(w) * n) // l AS m, unnest(w) AS t FROM d, s) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
df AS (SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, n),
x AS (SELECT i, item_id, doc_id, r, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN df USING (t) JOIN tf USING (t) WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0 QUALIFY rank <= 10
"""
