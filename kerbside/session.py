"""Session helpers shared by the queries, the tests and the benchmark."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def local_session(cpus: str | int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kerbside")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and make sure that checkpoints have a folder.

    The checkpoint folder is the cluster's (spark.checkpoint.dir). Where there is none, it is with a local master a temporary folder, and
    on a cluster one in the warehouse if that is on a file system that the machines share; a local warehouse is an error. Arrow batches, which Spark bounds by rows, are made small enough for rows that hold long texts.
    """
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's own default
        spark.conf.set(ARROW_ROWS, "1000")
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        context.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    if context.getCheckpointDir() is None:
        own = spark.conf.get("spark.checkpoint.dir", None)
        if not own:
            own = tempfile.mkdtemp(prefix="kerbside-") if re.match(r"local(\[|$)", context.master) else shared_folder(spark.conf.get("spark.sql.warehouse.dir"))
        context.setCheckpointDir(own)
    return spark


def shared_folder(warehouse: str) -> str:
    """A folder for checkpoints in the warehouse of a cluster; a warehouse on the driver's own disk won't do."""
    if not re.match(r"(?!file:)[a-z][a-z0-9+.-]*:", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return warehouse.rstrip("/") + "/_checkpoints"


def settled(df: DataFrame) -> DataFrame:
    """Writes a table to a folder of its own in the shared checkpoint folder, and reads it again.

    For tables that many branches of a query read: a cached one keeps its whole plan in each of them, and the driver plans and prints all of these.
    """
    spark = prepare(df.sparkSession)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Few rows that many others are made of, dealt out by a key first: a small file is one task's, and windows by the key need no further exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
