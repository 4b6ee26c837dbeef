"""Pairings by rank, overlaps between frames, and pairs of lattice points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def jaccard(rows: DataFrame) -> DataFrame:
    """rows(c, t, y, x): (c, t, jaccard) of a colour's places in frame t and the next, where it is in both."""
    n = rows.groupBy("c", "t").agg(F.count("*").alias("n"))
    after = rows.select("c", (F.col("t") - 1).alias("t"), "y", "x")
    shared = rows.join(after, ["c", "t", "y", "x"]).groupBy("c", "t").agg(F.count("*").alias("o"))
    both = n.join(n.select("c", (F.col("t") - 1).alias("t"), F.col("n").alias("m")), ["c", "t"]).join(shared, ["c", "t"], "left")
    o = F.coalesce("o", F.lit(0))
    return both.select("c", "t", (o / (F.col("n") + F.col("m") - o)).alias("jaccard"))


def lattice_pairs(spark: SparkSession) -> DataFrame:
    """(a, b, d2, k) of all pairs a < b of the 256 lattice points: squared distance and number of differing axes."""
    pairs = spark.range(1 << 16).select(F.expr("id div 256").alias("a"), (F.col("id") % 256).alias("b")).where("a < b")
    gaps = [F.expr(f"(a div {4**k}) % 4 - (b div {4**k}) % 4") for k in range(4)]
    d2, k = F.lit(0), F.lit(0)
    for g in gaps:
        d2, k = d2 + g * g, k + F.when(g != 0, 1).otherwise(0)
    return pairs.select("a", "b", d2.cast("int").alias("d2"), k.alias("k"))


def paired(rows: DataFrame, by: str, item: str, measure: str) -> DataFrame:
    """(by, asc_idx, desc_idx, rank): items by rising measure beside items by falling measure; ties by item."""
    up = rows.select(by, F.col(item).alias("asc_idx"), F.row_number().over(Window.partitionBy(by).orderBy(measure, item)).alias("rank"))
    down = rows.select(by, F.col(item).alias("desc_idx"), F.row_number().over(Window.partitionBy(by).orderBy(F.desc(measure), item)).alias("rank"))
    return up.join(down, [by, "rank"]).select(by, "asc_idx", "desc_idx", "rank")
