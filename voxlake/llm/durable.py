"""Cut lineage with reliable checkpoints in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session; only where it is unset (local tests) make one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-ckpt-"))


def durable(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder now and read from there later, also after an executor is lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_for(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions of the session."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def broadcast_few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df, which is read twice, marked for broadcast if it has no more rows than most (of a few numbers each)."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
