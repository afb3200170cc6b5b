"""Near-duplicate documents by b-bit MinHash.

A document's set holds the hashes of its distinct word shingles. Documents with the same set are one class, told by a 128-bit
digest of the set, and only classes go on. Each class has minima; bands of ROWS of them propose candidate pairs, and of each
minimum the low bits are kept, packed in longs: the share of equal groups, corrected for chance collisions, estimates
the similarity and rules out hopeless pairs. The rest is confirmed on the full sets. Components come from a distributed
union-find.

At a similarity of exactly 0.75, all 32 bands miss a pair in 5 of a million cases.

Edge cases: a null, empty or blank text has an empty set and links with nothing; a row with a null doc_id is returned with
a null component and kept; repeated rows share the class of their set, and rows with one doc_id but different texts are told apart by their sets: each
has the component of its own text; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from kerbside.llm import common as C
from kerbside.llm.components import hot, labelled, salted_join
from kerbside.llm.neardup import N_BITS, band_keys, bits_column, candidates, compressed, dealt, link, minima

SIZE, PERCENT = 5, 75
BANDS, ROWS = 32, 4


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, the set's digest (d1, d2), the text's (t1, t2), packed bits and minima of each row."""
    schema = "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, t1 bigint, t2 bigint, bits array<bigint>, mins binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in C.chunks(batch.column(1)):
                values, bounds = C.shingles(data, offsets, SIZE)
                mins = minima(values, bounds, max(N_BITS, BANDS * ROWS))
                d1, d2 = (C.reduced(np.add, C.mix(values + np.uint64(salt)), bounds, np.uint64(0)).view(np.int64) for salt in (1, 2))
                t = C.digests(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(np.diff(bounds)), *map(pa.array, (d1, d2, t[:, 0], t[:, 1])), bits_column(mins[:, :N_BITS]), C.binary([m.tobytes() for m in mins[:, : BANDS * ROWS]])], ["doc_id", "n_shingles", "d1", "d2", "t1", "t2", "bits", "mins"])

    return C.with_defaults(docs, doc_id="bigint", text="string").mapInArrow(run, schema)


def compressed_texts(docs: DataFrame) -> DataFrame:
    """(first, t1, t2, z): the compressed texts with their doc_id and digest."""

    def named(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack((np.asarray(batch.column(0)), C.digests(*C.text_bytes(batch.column(1)))))

    own = C.with_defaults(docs, doc_id="bigint", text="string").where("doc_id is not null")
    return compressed(own, named, "first bigint, t1 bigint, t2 bigint")


def labelled_classes(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """d1, d2 and component_id of each class of `rows`, the signatures of docs. On disk."""
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.min_by(F.struct("t1", "t2", "bits", "mins"), F.struct("doc_id", "t1", "t2")).alias("s"))
    # classes are numbered in the order of their first documents, so a component's smallest number is its smallest document
    classes = classes.select("d1", "d2", "first", "s.*").repartitionByRange(C.spread(docs), "first", "d1", "d2").sortWithinPartitions("first", "d1", "d2").withColumn("id", F.monotonically_increasing_id()).checkpoint()

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, None]:
        return band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS), BANDS, ROWS), None

    found = C.settled(candidates(dealt(classes.select("id", "mins"), keys)))

    def bits(ids: DataFrame) -> DataFrame:
        return classes.join(ids, "id", "left_semi").select("id", "bits")

    def texts(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids, "id").select("first", "t1", "t2", "id")
        return compressed_texts(docs).join(wanted, ["first", "t1", "t2"]).dropDuplicates(["id"]).select("id", "z")

    comps = link(found, bits, texts, lambda data, offsets: C.shingles(data, offsets, SIZE), PERCENT)
    named = labelled(classes.select("id", "d1", "d2", "first"), comps).select("id", "d1", "d2", "component").where("id <> component").checkpoint()
    first = named.select("component").distinct().join(classes.select(F.col("id").alias("component"), F.col("first").alias("least")), "component")
    labels = salted_join(named, first, "component", "id", hot(named, "component")).select("d1", "d2", "least")
    return classes.join(labels, ["d1", "d2"], "left").select("d1", "d2", F.coalesce("least", "first").alias("component_id")).checkpoint()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and the text's digest (t1, t2) of each row."""
    with C.tidy(docs.sparkSession):
        rows = signatures(docs).checkpoint()
        labels = labelled_classes(docs, rows)
    own = rows.select("doc_id", "n_shingles", "d1", "d2", "t1", "t2")
    full = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    found = salted_join(own.where(full), labels, ["d1", "d2"], "doc_id", hot(own, "d1")).select("doc_id", "n_shingles", "component_id", "t1", "t2")
    alone = own.where(~full).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "t1", "t2")
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are told by id and text: another text under the same id has a fate of its own."""
    schema = StructType([*docs.schema.fields]).add("_t1", LongType()).add("_t2", LongType())
    place, names = docs.columns.index("text"), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = C.digests(*C.text_bytes(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t[:, 0]), pa.array(t[:, 1])], names)

    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id", F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    return docs.mapInArrow(run, schema).join(gone, ["doc_id", "_t1", "_t2"], "left_anti").select(*docs.columns)


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.documents(spark, sf_dir)).drop("t1", "t2")
