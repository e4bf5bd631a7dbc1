"""Where shared files live, and how lineage is cut.

Everything that must outlive one executor (checkpoints, scratch tables) goes to the folder
named by ``spark.checkpoint.dir``.  Only a local session without that setting gets a
temporary folder; on a cluster a missing setting is an error, because a machine-local path
would vanish with the machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldtally-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/fieldtally/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write a stage's result to the shared folder and go on from the file.

    Later stages then read only the columns they use, know the table's size, and do not
    repeat the work after a lost executor.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store_for_fits(df: DataFrame, label: str, rows_per_task: int = 50_000) -> DataFrame:
    """Stored like :func:`store` and kept by the executors in partitions of about ``rows_per_task`` rows.

    A fit runs hundreds of short jobs over the same rows; with many near-empty partitions these are all overhead.
    """
    stored = store(df, label)
    parts = max(1, -(-stored.count() // rows_per_task))
    return stored.repartition(parts).cache()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the next stages start from files instead of a growing plan."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)
