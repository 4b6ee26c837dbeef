"""Connected components of a link table by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable


def connected_components(links: DataFrame, rows_per_task: int | None = None) -> DataFrame:
    """(node, component) of every node in links(a, b): component is the smallest node that can be reached.

    Links may repeat, run both ways or join a node to itself; nulls are ignored. An empty table gives an empty one.
    Each round is two joins on node ids, written to the checkpoint folder, so that lost executors cost one round.
    The number of rounds grows with the logarithm of the longest path. rows_per_task: links that a task should have at
    least; without it as many tasks write each shuffle as the session has partitions, however few the links.
    """
    edges = (
        links.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    edges = durable(edges)
    few = (lambda df: df) if rows_per_task is None else (lambda df, n=max(1, edges.count() // rows_per_task): df.coalesce(n))
    edges = few(edges)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = few(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))
        large = few(large.distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        )
        edges = durable(few(few(small.where("a != b")).distinct()))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").unionByName(
        roots.select(F.col("component").alias("node"), "component").distinct()
    )
