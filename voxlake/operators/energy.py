"""Histograms of palette indices, and the entropies and energies that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxlake.functions.lattice import binary_entropy

COLOURS = 256


def histogram(cells: DataFrame, by: list[str], value: str = "idx", bins: int = COLOURS) -> DataFrame:
    """(by, value, n) with a row for every bin, empty ones too."""
    n = cells.groupBy(*by, value).agg(F.count("*").alias("n"))
    groups = cells.select(*by).distinct() if by else cells.sparkSession.range(1).select()
    dense = groups.withColumn(value, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return dense.join(n, [*by, value], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def counts(cells: DataFrame, by: list[str], value: str = "idx") -> DataFrame:
    """(by, value, n) of the bins that are not empty: all that measures() and level_energies() need. A dense histogram that
    is filtered again becomes an inner join, whose exploded side adaptive execution takes for small and gathers in the driver."""
    return cells.groupBy(*by, value).agg(F.count("*").alias("n"))


def log_factorials(spark, most: int) -> DataFrame:
    """(k, log2 k!) for k up to most."""
    up = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    k = spark.range(most + 1).select(F.col("id").alias("k"))
    return k.select("k", F.sum(F.log2(F.greatest(F.col("k"), F.lit(1)))).over(up).alias("bits"))


def measures(hist: DataFrame, by: list[str], value: str = "idx") -> DataFrame:
    """(by, cells, used, h0, energy, per_cell, phi) of a histogram, dense or without its empty bins. h0 and energy in bits;
    phi: share of the upper half."""
    some = hist.where("n > 0")
    total = F.sum("n").over(Window.partitionBy(*by)) if by else hist.agg(F.sum("n")).scalar()
    some = some.withColumn("cells", total)
    p = F.col("n") / F.col("cells")
    out = some.groupBy(*by).agg(
        F.first("cells").alias("cells"), F.count("*").alias("used"), F.sum(-p * F.log2(p)).alias("h0"),
        F.sum(F.col("n") * F.log2(F.col("n") / (F.col("cells") / COLOURS))).alias("energy"),
        (F.sum(F.when(F.col(value) >= COLOURS // 2, F.col("n")).otherwise(0)) / F.first("cells")).alias("phi"),
    )
    return out.withColumn("per_cell", F.col("energy") / F.col("cells"))


def level_energies(hist: DataFrame, by: list[str], value: str = "idx", bits: int = 8) -> DataFrame:
    """(by, level, energy): bits saved at each binary split of the index, from the top bit down; they add up to the energy.
    Empty bins may be left out of hist."""
    prefixes = hist.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
    shift = lambda e: F.expr(f"cast({value} as int) div cast(pow(2, {bits - 1} - level + {e}) as int)")
    halves = prefixes.groupBy(*by, "level", shift(1).alias("node")).agg(
        F.sum(F.when(shift(0) % 2 == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(shift(0) % 2 == 1, F.col("n")).otherwise(0)).alias("b")
    )
    return halves.groupBy(*by, "level").agg(F.sum((F.col("a") + F.col("b")) * (1 - binary_entropy(F.col("a"), F.col("b")))).alias("energy"))


def multinomial_bits(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, bits): log2 of the number of arrangements that have the histogram."""
    per = hist.groupBy(*by).agg(F.sum("n").alias("cells"))
    most = int(per.agg(F.max("cells")).first()[0] or 0)
    logs = F.broadcast(log_factorials(hist.sparkSession, most)) if most <= 1 << 20 else log_factorials(hist.sparkSession, most)
    parts = hist.join(logs, hist.n == logs.k).groupBy(*by).agg(F.sum("bits").alias("parts"))
    return per.join(logs, per.cells == logs.k).join(parts, by).select(*by, (F.col("bits") - F.col("parts")).alias("bits"))


def wall_bits(walls: Column, bonds: Column) -> Column:
    """Bits saved by knowing how many of the bonds are walls; order and anti-order score the same."""
    return bonds * (1 - binary_entropy(walls, bonds - walls))


def birkhoff(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, order, complexity, manifold_dim, beauty, colours_used): natural logarithms, scaled by ln 256."""
    total = hist.groupBy(*by).agg(F.sum("n").alias("cells"))
    p = F.col("n") / F.col("cells")
    some = hist.join(total, by).groupBy(*by).agg(
        F.sqrt(F.sum(F.pow(F.col("n") - F.col("cells") / COLOURS, 2))).alias("order"),
        F.sum(F.when(F.col("n") > 0, -p * F.ln(p)).otherwise(0.0)).alias("h"), F.sum(p * p).alias("pp"), F.count_if(F.col("n") > 0).alias("colours_used"),
    )
    top = F.ln(F.lit(float(COLOURS)))
    complexity = F.col("h") / top
    dim = (complexity * 0.6 + F.ln(F.greatest(F.lit(1.0), 1 / F.col("pp"))) / top * 0.4) * 3
    return some.select(*by, "order", complexity.alias("complexity"), dim.alias("manifold_dim"), (F.col("order") / F.greatest(complexity, F.lit(0.001))).alias("beauty"), "colours_used")


def earth_movers(hist: DataFrame, other: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, emd): distance in bins between two dense histograms of equal mass."""
    up = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    both = hist.select(*by, value, F.col("n").alias("_a")).join(other.select(*by, value, F.col("n").alias("_b")), [*by, value])
    gaps = both.select(*by, F.abs(F.sum(F.col("_a") - F.col("_b")).over(up)).alias("gap"), "_a")
    return gaps.groupBy(*by).agg((F.sum("gap") / F.sum("_a")).alias("emd"))
