"""One-dimensional transport between histograms of equal mass: barycentres by quantiles, and coordinates in a dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 16


def quantiles(values: DataFrame, by: list[str], value: str, ties: list[str]) -> DataFrame:
    """(by, j, k): each group's values in order, as its inverse distribution at rank j from 0."""
    order = Window.partitionBy(*by).orderBy(value, *ties)
    return values.select(*by, (F.row_number().over(order) - 1).alias("j"), F.col(value).alias("k"))


def barycentre(tables: DataFrame, by: list[str], weights: tuple[int, ...]) -> DataFrame:
    """(by, k, n): the histogram of the weighted mean of inverse distributions, floored; tables(by, j, k0, k1, ...) holds one
    column for each of the weights, whose sum divides."""
    mean = reduce(lambda a, b: a + b, [F.col(f"k{i}") * w for i, w in enumerate(weights)])
    return tables.groupBy(*by, F.floor(mean / sum(weights)).cast("int").alias("k")).agg(F.count("*").alias("n"))


def simplex(parts: int) -> list[tuple[int, int, int]]:
    """All weights of three atoms in so many parts, the first atom's slowest."""
    return [(i, j, parts - i - j) for i in range(parts + 1) for j in range(parts + 1 - i)]


def running(counts: DataFrame, by: list[str], bins: int = BINS) -> DataFrame:
    """(by, cdf): running counts of counts(by, k, n) over all bins."""
    held = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("m"))
    each = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.aggregate(F.sequence(F.lit(0), k), F.lit(0).cast("long"), lambda z, i: z + F.coalesce(F.try_element_at("m", i), F.lit(0))))
    return held.select(*by, each.alias("cdf"))


def distance(p: Column, q: Column, mass: int) -> Column:
    """Earth mover's distance of two running counts."""
    return F.aggregate(F.zip_with(p, q, lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda z, d: z + d) / mass


def coordinates(targets: DataFrame, atoms: DataFrame, group: str, key: str, mass: int, parts: int = 10) -> DataFrame:
    """(group, key, w0, w1, w2, d): of all weights in so many parts, the first that bring the barycentre of a group's three
    atoms nearest to each target. targets(group, key, cdf); atoms(group, j, k0, k1, k2)."""
    grid = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(f"w{a}") for a, v in enumerate(w)]) for i, w in enumerate(simplex(parts))])
    each = atoms.withColumn("g", F.explode(grid))
    k = F.floor((F.col("k0") * F.col("g.w0") + F.col("k1") * F.col("g.w1") + F.col("k2") * F.col("g.w2")) / parts).cast("int")
    centres = running(each.groupBy(group, "g", k.alias("k")).agg(F.count("*").alias("n")), [group, "g"]).withColumnRenamed("cdf", "centre")
    held = centres.groupBy(group).agg(F.collect_list(F.struct("g", "centre")).alias("centres"))  # as many as the grid has points
    best = F.array_min(F.transform("centres", lambda c: F.struct(distance(c["centre"], F.col("cdf"), mass).alias("d"), c["g"].alias("g"))))
    return targets.join(held, group).withColumn("x", best).select(group, key, "x.g.w0", "x.g.w1", "x.g.w2", "x.d")
