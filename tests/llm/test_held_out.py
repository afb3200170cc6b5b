"""Toxicity on the given labels: trained on the rows outside the held-out fifth, judged on those in it."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kerbside.llm import toxicity as T

SF = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


def test_held_out_labels():
    duck = pytest.importorskip("duckdb").connect()
    rows = duck.sql(f"SELECT l.doc_id, any_value(text) AS text, max(toxic) AS toxic FROM '{SF}/labels.parquet' l JOIN '{SF}/documents.parquet' d ON l.doc_id = d.doc_id WHERE toxic IS NOT NULL GROUP BY 1 ORDER BY hash(l.doc_id)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % T.FOLDS == 0]
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % T.FOLDS]
    sample = [r for y in (1, 0) for r in [x for x in known if x[2] == y][: T.SAMPLE]]
    model = T.train(pa.array([r[1] for r in sample]), np.array([r[2] for r in sample]))
    score = np.concatenate([T.scores(model, pa.array([r[1] for r in held[i : i + 100]])) for i in range(0, len(held), 100)])
    toxic = np.array([r[2] for r in held]) == 1
    assert toxic.sum() > 80 and (score[toxic] >= 0.5).mean() > 0.8 and (score[~toxic] >= 0.5).mean() < 0.04
