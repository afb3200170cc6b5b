"""The driver's contract: queries against DuckDB on the smallest tables, and what is left without the text operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from kerbside.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str(list(v))
    if v is None or v != v:
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", ["wrong_way", "local_fit", "direction_share", "runs", "hysteresis", "trailing_minimum", "nearest_asof", "forward_asof_clamped", "merge_segments", "overlap_join", "finalize", "in_zone", "box_pairs", "average_precision", "alarm_starts", "otsu_threshold", "violations", "match_candidates", "heat_strip", "counts_per_second", "heatmap", "greedy_thinned", "sanitised", "user_tiles", "risk_curve", "risk_percentiles", "context_grid", "context_votes", "zone_visits", "stability", "lamp_scores", "image_recall", "false_alarms", "alarm_runs", "dataset_stats", "drawn_tracks", "timeline_strip"])
def test_query_is_its_sql(spark, duck, name):
    want = duck.sql(registry.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = registry.QUERIES[name](spark, SF).select(*columns).collect()
    rows = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert rows and sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert len(__spark_entry__.entry(spark).columns) == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "tests"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'wrong_way' in q and not any(x.startswith('op') or x == 'pipeline' for x in q)"], cwd=tmp_path / "copy", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
