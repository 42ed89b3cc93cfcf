"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a side may have, by proof, before a broadcast hint is dropped and Spark plans a shuffle join instead.
BROADCAST_ROWS = 1_000_000

SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Per-group limits are applied before the shuffle up to this N (Spark's default is 1000).
    "spark.sql.optimizer.windowGroupLimitThreshold": "100000",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("postgrain")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the session names, else (local sessions only) a fresh one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
            folder = "file://" + tempfile.mkdtemp(prefix="postgrain-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def stage(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` as a table in the shared folder, with a folder for each value of ``by``, and read it back.

    Cuts lineage, survives lost executors, and gives the planner real sizes for the next join.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy row work a task per core where a read has fewer splits (a gzip file, one large row group).

    A plain read of many files already has more splits than cores and is returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # After a shuffle the plan knows its partitions (nothing runs); a plain read counts its splits.
    known = df._jdf.queryExecution().executedPlan().outputPartitioning().numPartitions()
    return df.repartition(cores) if (known or df.rdd.getNumPartitions()) < cores else df


def broadcast_bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a side proven to have at most ``rows`` rows; larger bounds keep the shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
