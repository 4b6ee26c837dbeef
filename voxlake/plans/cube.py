"""Cubes as DataFrames: one row per cell, keyed (t, y, x), with channels r, g, b, depth s and a palette index idx."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxlake.functions import lattice

#: lineitem's columns in an order that no two rows share.
LINE_ORDER = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")

_cubes: dict[tuple[str, str, int], DataFrame] = {}


def numbered(df: DataFrame, order: tuple[str, ...], name: str = "v") -> DataFrame:
    """df with the row's place (from 0) in the given total order.

    Rows are dealt out by range and sorted where they lie; a place is the partition's offset plus the place within it, so
    no task sees more than its range. Only one count a partition is gathered.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_s"))
    return ranged.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")


#: Cells along a frame, and frames in a capture.
SIDE = 16


def cube(spark: SparkSession, sf_dir: str, side: int = SIDE) -> DataFrame:
    """lineitem as frames of side x side cells: cell v of the order is (v div side^2, v div side mod side, v mod side).

    All rows are used: side frames make a capture, captures follow one another along t (so capture() is a cell's capture,
    whatever the size of the table), and the last frame can be part-filled.
    """
    key = (spark.sparkContext.applicationId, sf_dir, side)
    if key not in _cubes:
        lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*LINE_ORDER, "l_quantity", "l_discount", "l_tax")
        cells = numbered(lines, LINE_ORDER)
        n = F.lit(side)
        cells = cells.select(
            F.expr(f"v div {side * side}").cast("int").alias("t"),
            (F.expr(f"v div {side}") % n).cast("int").alias("y"),
            (F.col("v") % n).cast("int").alias("x"),
            (F.col("l_quantity") / 50).alias("r"),
            F.least(F.lit(1.0), F.col("l_extendedprice") / 105000).alias("g"),
            (F.col("l_discount") / 0.1).alias("b"),
            (F.col("l_tax") / 0.08).alias("s"),
            n.alias("side"),
        )
        level = lambda c: lattice.bin_to_level(lattice.value_to_bin(F.col(c)))
        idx = lattice.compose_index(lattice.nearest_epoch(F.col("t") % side, side), level("r"), level("g"), level("b"))
        _cubes[key] = cells.withColumn("idx", idx).persist(StorageLevel.MEMORY_AND_DISK)
    return _cubes[key]


def capture(side: int = SIDE) -> Column:
    """The capture that a frame belongs to."""
    return F.expr(f"t div {side}").alias("capture")


def blocks(k: int) -> list[Column]:
    """Key of the k x k x k block of a cell."""
    return [F.expr(f"{c} div {k}").alias(f"b{c}") for c in ("t", "y", "x")]


#: The same cube in SQL, as common table expressions.
CUBE_SQL = f"""
side AS (SELECT {SIDE} AS n),
numbered AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice) - 1 AS v,
  l_quantity / 50 AS r, least(1.0, l_extendedprice / 105000) AS g, l_discount / 0.1::DOUBLE AS b, l_tax / 0.08::DOUBLE AS s FROM lineitem),
cells AS (SELECT CAST(v // (n * n) AS INT) AS t, CAST((v // n) % n AS INT) AS y, CAST(v % n AS INT) AS x, r, g, b, s, n AS side
  FROM numbered, side),
binned AS (SELECT *, least(13, greatest(0, CAST(floor(r * 14) AS INT))) AS br, least(13, greatest(0, CAST(floor(g * 14) AS INT))) AS bg,
  least(13, greatest(0, CAST(floor(b * 14) AS INT))) AS bb, 8.0 * (t % side) / (side - 1) AS u FROM cells),
cube AS (SELECT t, y, x, r, g, b, s, side, (CASE WHEN u <= 2 THEN 0 WHEN u <= 4 THEN 64 WHEN u <= 6 THEN 128 ELSE 192 END)
  + 16 * (CASE WHEN br <= 3 THEN 0 WHEN br <= 6 THEN 1 WHEN br <= 10 THEN 2 ELSE 3 END)
  + 4 * (CASE WHEN bg <= 3 THEN 0 WHEN bg <= 6 THEN 1 WHEN bg <= 10 THEN 2 ELSE 3 END)
  + (CASE WHEN bb <= 3 THEN 0 WHEN bb <= 6 THEN 1 WHEN bb <= 10 THEN 2 ELSE 3 END) AS idx FROM binned)"""
