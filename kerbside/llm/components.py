"""Connected components by distributed union-find.

Each partition first contracts its own edges by a local union-find, which leaves a forest; then alternating large-star and
small-star steps hook every tree to the smallest id reachable until nothing changes. A node with very many larger
neighbours isn't dealt to one task: at most HOT_NODES of them are told to all tasks with their smallest neighbours, and their
edges are rewritten where they lie. Exchanges name no number of partitions, so that the adaptive plan fits it to the edges left. Each round is cut by a checkpoint; the driver sees that bounded table and one number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys are the HOT_NODES most frequent ones of those with more than HOT_EDGES rows; all others have less than 1 in HOT_NODES of the rows.
HOT_NODES, HOT_EDGES = 512, 256
SALTS = 32


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local union-find: the edges (a, b) of a partition become edges to the smallest id of their local component."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x] = top
            x = up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                parent.setdefault(min(x, y), min(x, y))
    nodes = [x for x in parent if parent[x] != x]
    for first in range(0, len(nodes), 100_000):
        part = nodes[first : first + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Distinct rows (a, b) of sorted batches with the first b of each a, and whether the row is marked; a group may go on over batches."""
    last: tuple[int, int, int] | None = None  # a, its first b, the b before
    for batch in batches:
        a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        if not len(a):
            continue
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        fresh = new.copy()
        fresh[1:] |= b[1:] != b[:-1]
        first = b[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        if last is not None and a[0] == last[0]:
            own = int(np.argmax(a != a[0])) if (a != a[0]).any() else len(a)
            first = first.copy()
            first[:own] = last[1]
            fresh[0] = b[0] != last[2]
        last = int(a[-1]), int(first[-1]), int(b[-1])
        marked = np.asarray(batch.column(2)) if batch.num_columns > 2 else np.zeros(len(a), bool)
        yield a[fresh], b[fresh], first[fresh], marked[fresh]


def large_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All larger neighbours of a node are linked to the smallest node near it."""
    for a, b, first, _ in _sorted_groups(batches):
        least, up = np.minimum(a, first), b > a
        yield pa.RecordBatch.from_arrays([pa.array(b[up]), pa.array(least[up]), pa.array((least < a)[up])], ["a", "b", "changed"])


def small_star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A node and its smaller neighbours are linked to the smallest of them."""
    for a, b, first, marked in _sorted_groups(batches):
        other = b != first
        yield pa.RecordBatch.from_arrays([pa.array(np.where(other, b, a)), pa.array(first), pa.array(other | marked)], ["a", "b", "changed"])


def hot(rows: DataFrame, key: str, least: int = HOT_EDGES) -> list[int]:
    """The values of a column that the most rows have, more than `least`, and HOT_NODES of them at most. rows: on disk already."""
    found = rows.groupBy(key).count().where(F.col("count") > least).orderBy(F.desc("count"), key).limit(HOT_NODES).collect()
    return [r[0] for r in found if r[0] is not None]


def salted_join(rows: DataFrame, side: DataFrame, keys: str | list[str], other: str, often: list[int]) -> DataFrame:
    """rows joined with `side`, which has one row for each key: rows of the hot keys (`often`, by the first of them) are spread by `other`, and these few rows of `side` repeated."""
    keys = [keys] if isinstance(keys, str) else keys
    if not often:
        return rows.join(side, keys)
    is_hot = F.col(keys[0]).isin(often)
    spread_rows = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64(other), F.lit(SALTS))).otherwise(0).cast("int"))
    spread_side = side.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return spread_rows.join(spread_side, [*keys, "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id that an edge (a, b) of longs names and that isn't its component's smallest.

    Null ends and loops link nothing; repeated edges do no harm; without edges the result is empty.
    """
    schema = "a bigint, b bigint, changed boolean"
    e = edges.select("a", "b").where("a <> b").mapInArrow(contract, "a bigint, b bigint").withColumn("changed", F.lit(False)).checkpoint()
    while True:
        often, moved, turns = hot(e, "b"), None, F.array(F.lit(False), F.lit(True))
        if often:
            # the larger neighbours of a hot node go to its smallest neighbour without an exchange
            least = {h: h for h in often} | {r["a"]: r["m"] for r in e.where(F.col("a").isin(often)).groupBy("a").agg(F.min("b").alias("m")).collect()}
            to = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("b"))
            moved = e.where(F.col("b").isin(often)).select("a", to.alias("to"), "b").select("a", F.col("to").alias("b"), (F.col("to") != F.col("b")).alias("changed"))
            turns = F.when(F.col("b").isin(often), F.array(F.lit(False))).otherwise(turns)
        turned = e.select("a", "b", F.explode(turns).alias("turned"))
        both = turned.select(F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("a"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("b"))
        large = both.repartition("a").sortWithinPartitions("a", "b").mapInArrow(large_star, schema)
        large = large if moved is None else large.union(moved)
        e = large.repartition("a").sortWithinPartitions("a", "b", F.desc("changed")).mapInArrow(small_star, schema).checkpoint()
        if not e.agg(F.max("changed")).first()[0]:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).distinct()


def labelled(ids: DataFrame, found: DataFrame) -> DataFrame:
    """Adds `component` to rows with `id`: an id without links is its own."""
    return ids.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def packed_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (smaller, larger) pairs."""
    if not len(a):
        return a, b
    low, high = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    return low[keep], high[keep]
