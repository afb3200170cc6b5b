"""What only larger tables showed: rows that differ from SQL, plans that take a whole side through the driver."""

from __future__ import annotations

import pytest

from kerbside.plans import registry


def test_box_edges_are_rounded_as_in_sql(spark, tmp_path):
    duck = pytest.importorskip("duckdb").connect()
    # -0.2765 is a float just above -276.5 thousandths; times 1000 it is that half as a float
    duck.execute(f"COPY (SELECT * FROM (VALUES (1, [0.1, -0.2765, 0.3, -0.1]::FLOAT[], 7), (2, [0.1, -0.2, 0.3, -0.1]::FLOAT[], 7)) v(vec_id, embedding, label)) TO '{tmp_path}/embeddings.parquet'")
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    want = duck.sql(registry.ORACLE_SQL["box_pairs"])
    rows = registry.QUERIES["box_pairs"](spark, str(tmp_path)).select(*want.columns).collect()
    assert [tuple(r) for r in rows] == want.fetchall() != []


def test_spark_knows_how_many_samples_there_are(spark):
    from kerbside.plans.derived import SAMPLES, trajectories

    rows = trajectories(spark, "/root/testdata/sf0.001")
    least = rows.count() * 8  # bytes: less than one of its columns
    assert rows.count() == 150 * SAMPLES
    assert int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= least


def test_rules_on_pairs_have_plans_that_a_driver_can_hold(spark):
    found = registry.QUERIES["rule_accident"](spark, "/root/testdata/sf0.001")
    # cached tables kept their whole plans in each branch: 1.3 million characters
    assert len(found._jdf.queryExecution().executedPlan().toString()) < 200_000


def test_aligned_samples_take_the_nearest_the_earlier_of_two(spark):
    from kerbside.operators.pairs import VALUES, pair_series

    row = lambda tid, t: ("v", tid, t, *[float(tid + i + t) for i in range(9)], True)
    times = {1: (0.0, 0.125, 0.25, 0.375), 2: (0.0625, 0.1875, 0.34375, 0.34375)}  # 0.125 lies midway; one row comes twice
    obs = spark.createDataFrame([row(k, t) for k, ts in times.items() for t in ts], "video_id string, tid bigint, t double, " + ", ".join(f"{c} {'boolean' if c == 'is_vehicle' else 'double'}" for c in VALUES))
    pairs = spark.createDataFrame([("v", 1, 2)], "video_id string, a bigint, b bigint")
    rows = pair_series(obs, pairs, least=1, reach=1e9).orderBy("t").collect()
    assert [(r["t"], r["t_b"], r["x_b"]) for r in rows] == [(0.125, 0.0625, 2.0625), (0.25, 0.1875, 2.1875)]


def test_samples_of_one_small_file_are_many_tasks(spark):
    from kerbside.plans.derived import trajectories

    rows = trajectories(spark, "/root/testdata/sf0.001")
    assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
