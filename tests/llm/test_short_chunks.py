"""Chunks with fewer words than a window: tables of one short row, and a short text between two long ones."""

from __future__ import annotations

import pytest

from kerbside.llm import minhash_dedup, quality_rules

SCHEMA = "doc_id bigint, text string"


@pytest.mark.parametrize("n", range(1, 9))
def test_one_short_row(spark, n):
    docs = spark.createDataFrame([(1, " ".join(["ab"] * n))], SCHEMA)
    (row,) = quality_rules.ledger(docs).collect()
    assert (row["n_words"], row["word_chars"], row["n_repeat_words"], row["n_lines"]) == (n, 2 * n, 0, 1)
    (row,) = minhash_dedup.near_duplicates(docs).collect()
    assert (row["n_shingles"], row["component_id"], row["kept"]) == (1, 1, True)


def test_short_text_between_long_ones(spark):
    long = "word " * 300_000
    docs = spark.createDataFrame([(1, long), (2, "a b c"), (3, long)], SCHEMA).coalesce(1)
    got = {r["doc_id"]: r for r in quality_rules.ledger(docs).collect()}
    assert [(got[i]["n_words"], got[i]["n_repeat_words"]) for i in (1, 2, 3)] == [(300_000, 300_000), (3, 0), (300_000, 300_000)]
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs).collect()}
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in (1, 2, 3)] == [(1, 1), (1, 2), (1, 1)]
