"""Access to the Parquet tables of a data directory, and the session settings the plans rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of a data directory (one Parquet file or a folder of them)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    On a cluster this is `spark.checkpoint.dir`, which the operator of the cluster points at storage that all
    executors share.  Only a local session without that setting (tests, a laptop) gets a temporary folder.
    """
    sc = spark.sparkContext
    there = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not there:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="graphloom-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame) -> DataFrame:
    """`df` in at least as many partitions as there are cores, for work that is heavy per row.

    A large table has more splits than that already and stays as it is, without a shuffle; only a table of a few row
    groups is dealt out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single-machine runs."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("graphloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRAPHLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
