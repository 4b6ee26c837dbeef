"""Tables between the steps of a long computation, written to the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to spark.checkpoint.dir now and read from there by whatever follows, also after an executor is lost."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by key to as many tasks as a shuffle has, however few its bytes: for rows that are short but cost much."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4, 2 * spark.sparkContext.defaultParallelism), *by)


def tasks(rows: int, each: int = 1 << 18) -> int:
    """Tasks for so many rows, each of some rows at most, so that no task's sort grows with the table."""
    return max(32, -(-rows // each))
