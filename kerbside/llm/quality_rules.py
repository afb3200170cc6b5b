"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once for each text and stores the measurements and one bit for each rule that failed.
A policy is a named, versioned mask of the bits that reject; `apply_policy` is one bitwise test, and `ablation` finds by
bitwise aggregation what each rule of a policy rejects in total, alone, and on top of the others. New policies need no
second pass over the texts.

Edge cases: a null or empty text has no words and fails the word-count rule; null ids and repeated rows are kept as
they are, each with its own result; an empty table gives an empty ledger; other columns are passed through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import common as C

#: The rules' bits, in order. A rule that is added takes the next bit; none is ever given another meaning.
RULES = ("few_words", "repeat_words", "word_length_low", "word_length_high", "symbol_words", "dup_lines")
#: Version 1 rejects by the base rules and by extreme shapes only: plain prose in any language passes.
POLICIES = {"v1": RULES, "base": ("few_words", "repeat_words"), "lenient": ("few_words",)}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
WINDOW = 8


def bit(rule: str) -> int:
    return 1 << RULES.index(rule)


def mask(policy: str) -> int:
    return sum(bit(rule) for rule in POLICIES[policy])


def _repeats(values: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each value its group's number within (row, value), as the place of the group's first element in order."""
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))
    size = np.bincount(np.cumsum(new) - 1) if len(v) else np.zeros(0, int)
    out_start, out_size = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    out_start[order] = order[start]  # a stable sort: the first in the text
    out_size[order] = size[np.cumsum(new) - 1] if len(v) else size
    return out_start, out_size


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    n = len(offsets) - 1
    starts, ends, bounds = C.words(data, offsets)
    counts = np.diff(bounds)
    row = C.rows_of(bounds)
    # code points: bytes that don't continue one
    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.bincount(row, heads[ends] - heads[starts], n).astype(np.int64)
    symbols = np.concatenate(([0], np.cumsum(SYMBOL[data])))
    prefix = C.prefix_hash(data)
    hashed = C.slice_hash(prefix, starts, ends)
    # words in windows that occur twice or more in the text
    rolled = np.zeros(len(hashed), np.uint64)
    for j in range(min(WINDOW, len(hashed))):  # a chunk may have fewer words
        rolled[: len(hashed) - j] = rolled[: len(hashed) - j] * np.uint64(C.BASE) + hashed[j:]
    at = np.flatnonzero(np.arange(len(hashed)) + WINDOW <= np.repeat(bounds[1:], counts))
    _, size = _repeats(rolled[at], row[at])
    cover = np.zeros(len(hashed) + 1, np.int64)
    found = at[size > 1]
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    repeated = np.bincount(row, np.cumsum(cover[:-1]) > 0, n).astype(np.int64)
    # lines: the text is cut at \n; those with a word count
    cut = np.flatnonzero(data == 10)
    begins = np.union1d(offsets[:-1][np.diff(offsets) > 0], cut + 1)
    begins = begins[begins < len(data)]
    line_row = np.searchsorted(offsets, begins, "right") - 1
    stop = np.minimum(np.append(begins[1:], len(data)), offsets[line_row + 1])
    stop = np.where((stop > begins) & (data[stop - 1] == 10), stop - 1, stop) if len(begins) else stop
    has = np.searchsorted(starts, stop) > np.searchsorted(starts, begins)
    begins, stop, line_row = begins[has], stop[has], line_row[has]
    first, _ = _repeats(C.slice_hash(prefix, begins, stop), line_row)
    dup = np.bincount(line_row, first != np.arange(len(begins)), n).astype(np.int64)
    return {
        "n_words": counts.astype(np.int64),
        "word_chars": chars,
        "n_symbols": (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeated,
        "n_lines": np.bincount(line_row, minlength=n).astype(np.int64),
    }


def judge(m: dict[str, np.ndarray]) -> np.ndarray:
    """The failure bits; all tests are on integers."""
    n, chars = m["n_words"], m["word_chars"]
    failed = {
        "few_words": n < 20,
        "repeat_words": 100 * m["n_repeat_words"] > 30 * n,
        "word_length_low": chars < 2 * n,
        "word_length_high": chars > 25 * n,
        "symbol_words": m["n_symbols"] > n,
        "dup_lines": 2 * m["n_dup_lines"] > m["n_lines"],
    }
    return sum(np.where(failed[rule], bit(rule), 0) for rule in RULES).astype(np.int64)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input with the measurements and `fail_bits`. Names that clash with these are replaced."""
    own = [*MEASURES, "fail_bits"]
    keep = [c for c in docs.columns if c not in own]
    source = docs.select(*[F.col(f"`{c}`") for c in keep])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema), *(f"{c} bigint" for c in own)])
    place = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in C.chunks(batch.column(place)):
                m = measure(data, offsets)
                parts.append(m | {"fail_bits": judge(m)})
            made = [pa.array(np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)) for c in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*keep, *own])

    return source.mapInArrow(run, schema)


def apply_policy(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """Adds `kept`: no bit of the policy's mask is set."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0)


def ablation(rows: DataFrame, policy: str = "v1") -> DataFrame:
    """For each rule of a policy: texts that fail it, that it alone rejects, and that stay rejected without it.

    The ledger is first counted by its bits (at most 2^rules rows), so the rules cost no further pass.
    """
    by_bits = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(bit(r)).alias("bit")) for r in POLICIES[policy]]))
    counted = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", F.col("r.bit").cast("bigint").alias("bit"))
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return counted.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when((F.col("bits") != 0) & ~alone, F.col("n")).otherwise(0)).alias("n_rejected_without"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(ledger(C.documents(spark, sf_dir).select("doc_id", "text")))
    base = F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "fail_bits")


#: Lists of words and lines by the same rules; the 8-word windows are compared as text.
OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id),
b AS (
  SELECT *, ((n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT + 4 * (word_chars < 2 * n_words)::BIGINT
    + 8 * (word_chars > 25 * n_words)::BIGINT + 16 * (n_symbols > n_words)::BIGINT + 32 * (2 * n_dup_lines > n_lines)::BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) != 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""
