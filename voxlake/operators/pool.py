"""Block pooling, rungs and rollups of cubes keyed (t, y, x)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("t", "y", "x")


def block(k: int, axes=AXES) -> list[Column]:
    return [F.expr(f"{c} div {k}").cast("int").alias(c) for c in axes]


def pool(cells: DataFrame, channels: list[str], k: int = 2, axes=AXES) -> DataFrame:
    """Mean of each channel over blocks of side k; NaN counts as 0.5."""
    mean = [F.avg(F.when(F.isnan(c), F.lit(0.5)).otherwise(F.col(c))).alias(c) for c in channels]
    rest = [c for c in AXES if c not in axes]
    return cells.groupBy(*[F.col(c) for c in rest], *block(k, axes)).agg(*mean)


def lift(coarse: DataFrame, k: int = 2) -> DataFrame:
    """Each row's k^3 children, with the row's values."""
    steps = F.sequence(F.lit(0), F.lit(k - 1))
    out = coarse
    for c in AXES:
        out = out.withColumn("_d", F.explode(steps)).withColumn(c, F.col(c) * k + F.col("_d")).drop("_d")
    return out


def pool_sums(cells: DataFrame, channels: list[str], k: int = 2) -> DataFrame:
    """Exact block sums of integer channels: mass is kept."""
    return cells.groupBy(*block(k)).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in channels])


def free_blocks(cells: DataFrame, channels: list[str], k: int = 2) -> DataFrame:
    """How many blocks hold at most one cell that is not zero in every channel."""
    loud = F.greatest(*[F.when(F.col(c) != 0, 1).otherwise(0) for c in channels]) if len(channels) > 1 else F.when(F.col(channels[0]) != 0, 1).otherwise(0)
    per = cells.groupBy(*block(k)).agg(F.sum(loud).alias("n"))
    return per.agg(F.count_if(F.col("n") <= 1).alias("free_blocks"), F.count("*").alias("blocks"))


def within_variance(cells: DataFrame, channel: str, k: int = 4) -> DataFrame:
    """Mean over blocks of the variance inside a block, never below 0."""
    per = cells.groupBy(*block(k)).agg((F.avg(F.col(channel) * F.col(channel)) - F.avg(channel) * F.avg(channel)).alias("v"))
    return per.agg(F.avg(F.greatest(F.lit(0.0), F.col("v"))).alias("within"))


def pyramid(cells: DataFrame, channels: list[str], rungs: tuple[int, ...] = (1, 2, 4)) -> DataFrame:
    """All rungs at once, one row for each block of side k and rung."""
    out = None
    for k in rungs:
        part = (pool(cells, channels, k) if k > 1 else cells.select(*AXES, *channels)).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def bands(errors: DataFrame, channels: list[str]) -> DataFrame:
    """Energies of an error field that survive pooling: at full, half and quarter resolution, and their differences."""
    def projected(k: int) -> DataFrame:
        sums = errors.groupBy(*block(k)).agg(*[F.sum(c).alias(c) for c in channels])
        square = sum((F.col(c) * F.col(c) for c in channels[1:]), F.col(channels[0]) * F.col(channels[0]))
        return sums.agg((F.sum(square) / k**3).alias("p"), F.lit(k).alias("k"))

    levels = projected(1).unionByName(projected(2)).unionByName(projected(4))
    p = levels.groupBy().pivot("k", [1, 2, 4]).agg(F.first("p"))
    n = errors.agg(F.count("*")).scalar()
    one, two, four = F.col("`1`"), F.col("`2`"), F.col("`4`")
    return p.select((four / n).alias("d16"), (two / n).alias("d32"), (one / n).alias("d64"), four.alias("u4"), (two - four).alias("u2"), (one - two).alias("u1"))


def haar(cells: DataFrame, channel: str) -> DataFrame:
    """Signed means over the 8 corners of each 2^3 block: mode w has sign (-1)^popcount(w & corner)."""
    corner = (F.col("x") % 2) + (F.col("y") % 2) * 2 + (F.col("t") % 2) * 4
    modes = cells.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(7))))
    sign = 1 - 2 * (F.bit_count(F.col("w").bitwiseAND(corner.cast("int"))) % 2)
    return modes.groupBy(*block(2), "w").agg((F.sum(sign * F.col(channel)) / 8).alias("coef"))


def block_share(cells: DataFrame, value: Column, k: int) -> DataFrame:
    """Share of the blocks of side k over which value is constant."""
    per = cells.groupBy(*block(k)).agg((F.min(value) == F.max(value)).cast("int").alias("same"))
    return per.agg(F.avg("same").alias("share"))


def projected(cells: DataFrame, channel: str, k: int) -> DataFrame:
    """Each cell's channel replaced by its block's mean."""
    return cells.withColumn(channel, F.avg(channel).over(Window.partitionBy(*[F.expr(f"{c} div {k}") for c in AXES])))
