"""Session defaults shared by tests, the bench and scripts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A local session in UTC with adaptive execution; on a cluster callers bring their own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plexigraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. One is made only for a local session without it."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (held.get() if held.isDefined() else None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="plexigraph-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def by_exchange(df: DataFrame) -> DataFrame:
    """df as a side that its join never broadcasts.

    Spark takes the size of generated rows from the small table that they come from, so rows that grow with the input may
    pass for a small table and be gathered by the driver.
    """
    return df.hint("merge")


def hold(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, in the folder that the session names."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def store(df: DataFrame) -> DataFrame:
    """df written once, in the folder that the session names, and read back: what Python makes is made once, and takes little room."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/plexigraph/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
