"""Shards of near-equal bytes by k-d tree partitioning.

Rows with equal texts are one point, so copies share a shard; its weight is their bytes and its metadata dimensions are
text length, first id, source and language. All nodes of a level are split together, each along its widest dimension (by
the share of the whole range) at the weighted median, until every leaf holds one shard's share. The medians come from
histograms that Spark fills and the driver narrows: at most BINS counts for each node and pass, whatever the input's size.
Equal values along a dimension are ordered by a hash of the text, so that no value is too heavy to split.

Edge cases: a null text is an empty one; null ids, languages and sources are ordinary values; repeated rows are rows of
their own; a single text heavier than a shard stays whole, which makes its shard larger; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kerbside.llm import common as C

BINS = 1024
#: A median is searched no further once its bin has this share of the node's bytes.
TOLERANCE = 1 / 4096
HASH_BITS = 40
ROWS_PER_CELL = 20_000
DIMENSIONS = ("n_bytes", "first_id", "source", "lang")


def _code(column: str):
    return F.coalesce(F.crc32(F.col(column)), F.lit(-1)).cast("bigint")


def points(rows: DataFrame) -> DataFrame:
    """One row for each distinct text: digest, weight, array of dimensions, tie-break."""
    return rows.groupBy("digest").agg(F.sum("size").alias("w"), F.max("size").alias("n_bytes"), F.coalesce(F.min("doc_id"), F.lit(-1)).alias("first_id"), F.min(_code("source")).alias("source"), F.min(_code("lang")).alias("lang")).select(
        "digest", "w", F.array(*DIMENSIONS).alias("v"), F.pmod(F.xxhash64("digest"), F.lit(1 << HASH_BITS)).alias("h")
    )


def _small(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A table of one row for each node (as many as there are shards at most)."""
    values = ", ".join("(" + ", ".join(f"{x}L" for x in row) + ")" for row in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})"))


def _medians(nodes: DataFrame, asked: dict[int, tuple[int, int, int, float]]) -> dict[int, tuple[int, int, int]]:
    """For each node (dimension, low, high, bytes wanted on the left) the cut (dimension, value, hash): what is below goes left."""
    spark, cuts = nodes.sparkSession, {}
    # node -> dimension (-1: the hash among points with the value), value, low, high, wanted, tolerated
    state = {n: [d, None, lo, hi, want, want * TOLERANCE] for n, (d, lo, hi, want) in asked.items()}
    dims = {n: d for n, (d, *_) in asked.items()}
    while state:
        steps = {n: -(-(s[3] - s[2] + 1) // BINS) for n, s in state.items()}
        known = _small(spark, [(n, dims[n], s[1] if s[1] is not None else -1, int(s[1] is not None), s[2], s[3], steps[n]) for n, s in state.items()], ["node", "d", "value", "by_hash", "low", "high", "step"])
        value = F.element_at("v", (F.col("d") + 1).cast("int"))
        x = F.when(F.col("by_hash") == 1, F.col("h")).otherwise(value)
        inside = nodes.join(known, "node").where((F.col("by_hash") == 0) | (value == F.col("value"))).withColumn("x", x).where(F.col("x").between(F.col("low"), F.col("high")))
        counts = inside.groupBy("node", F.floor((F.col("x") - F.col("low")) / F.col("step")).alias("bin")).agg(F.sum("w").alias("w")).collect()
        by_node: dict[int, list[tuple[int, int]]] = {n: [] for n in state}
        for r in counts:
            by_node[r["node"]].append((r["bin"], r["w"]))
        for n, bins in by_node.items():
            s, step = state[n], steps[n]
            total, place = 0, s[2]
            for b, w in sorted(bins):
                place = s[2] + b * step
                if total + w >= s[4]:
                    break
                total += w
            left, over = s[4] - total, total + w - s[4]
            s[4] = left
            if min(left, over) <= s[5] or (s[1] is not None and step == 1):
                end = place if left <= over else place + step  # the nearer edge of the bin
                cuts[n] = (dims[n], end, 0) if s[1] is None else (dims[n], s[1], end)
            elif step > 1:
                s[2], s[3] = place, min(s[3], place + step - 1)
            else:
                s[1], s[2], s[3] = place, 0, (1 << HASH_BITS) - 1
        state = {n: s for n, s in state.items() if n not in cuts}
    return cuts


def assign(rows: DataFrame, n_shards: int) -> DataFrame:
    """digest and shard of each distinct text."""
    spark = rows.sparkSession
    nodes = points(rows).withColumn("node", F.lit(1).cast("bigint")).checkpoint()
    share = {1: (0, n_shards)}  # node -> first shard, shards
    whole: list[tuple[int, int]] = []
    while any(k > 1 for _, k in share.values()):
        stats = nodes.groupBy("node").agg(F.sum("w").alias("w"), *[f(F.element_at("v", i + 1)).alias(f"{a}{i}") for i in range(len(DIMENSIONS)) for a, f in (("lo", F.min), ("hi", F.max))]).collect()
        whole = whole or [(r[f"lo{i}"], r[f"hi{i}"]) for r in stats for i in range(len(DIMENSIONS))]
        asked = {}
        for r in stats:
            if share[r["node"]][1] > 1:
                wide = [(r[f"hi{i}"] - r[f"lo{i}"]) / max(1, whole[i][1] - whole[i][0]) for i in range(len(DIMENSIONS))]
                d = wide.index(max(wide))
                k = share[r["node"]][1]
                asked[r["node"]] = (d, r[f"lo{d}"], r[f"hi{d}"], r["w"] * (k // 2) / k)
        cuts = _medians(nodes, asked)
        if not cuts:
            break
        known = _small(spark, [(n, *cut) for n, cut in cuts.items()], ["node", "d", "value", "hash"])
        value = F.element_at("v", (F.col("d") + 1).cast("int"))
        right = (value > F.col("value")) | ((value == F.col("value")) & (F.col("h") >= F.col("hash")))
        split = F.when(F.col("d").isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))
        nodes = nodes.join(known, "node", "left").select("digest", "w", "v", "h", split.alias("node"))
        new = {n: s for n, s in share.items() if n not in cuts}
        for n in cuts:
            first, k = share[n]
            new |= {2 * n: (first, k // 2), 2 * n + 1: (first + k // 2, k - k // 2)}
        share = new
    return nodes.join(_small(spark, [(n, first) for n, (first, _) in share.items()], ["node", "shard"]), "node").select("digest", F.col("shard").cast("int"))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """Adds `slot`, gapless from 0 for each value of `key`: rows are counted in small cells, and each cell starts where the earlier ones end."""
    cells = max(1, -(-rows.count() // ROWS_PER_CELL))
    celled = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(cells)))
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = celled.groupBy(key, "cell").agg(F.count("*").alias("n")).select(key, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy(key, "cell").orderBy("doc_id", "size", "text_crc32"))
    return celled.withColumn("rank", within).join(starts, [key, "cell"]).withColumn("slot", (F.col("base") + F.col("rank") - 1).cast("bigint")).drop("cell", "rank", "base")


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard; the texts themselves are never shuffled."""
    source = C.with_defaults(docs, doc_id="bigint", text="string", lang="string", source="string")
    text = F.coalesce("text", F.lit(""))
    rows = source.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"), F.unhex(F.md5(text)).alias("digest"), "lang", "source").checkpoint()
    placed = rows.join(assign(rows, n_shards), "digest").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard").checkpoint()
    return numbered(placed, "shard").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(C.documents(spark, sf_dir))
