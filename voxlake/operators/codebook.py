"""Nearest codewords, retrieval and palette lookups. Codebooks are small tables of stated size."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

LATTICE = [(a, b, c) for a in range(4) for b in range(4) for c in range(4)]


def lattice_book() -> list[tuple[int, float, float, float]]:
    """The 64 colours of the lattice, each at the centre of its cell."""
    return [(16 * a + 4 * b + c, (a + 0.5) / 4, (b + 0.5) / 4, (c + 0.5) / 4) for a, b, c in LATTICE]


def nearest(book: list[tuple[int, float, float, float]], r: Column, g: Column, b: Column) -> Column:
    """struct(d, i) of the nearest codeword, the lowest index on ties, without a join: the book is a literal array."""
    words = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(v).alias(n) for v, n in zip(w, "rgb")]) for i, *w in book])
    d = lambda w: (r - w["r"]) * (r - w["r"]) + (g - w["g"]) * (g - w["g"]) + (b - w["b"]) * (b - w["b"])
    return F.array_min(F.transform(words, lambda w: F.struct(d(w).alias("d"), w["i"].alias("i"))))


def k_nearest(store: DataFrame, probes: DataFrame, dims: list[str], key: str, k: int) -> DataFrame:
    """(probe, key, d2, rank): exact retrieval of the k nearest rows of store for each probe; ties by key. Rows and probes
    without a place (null or NaN) are left out.

    Of rows at one place the k smallest keys can be nearest. Places are cut into boxes at quantiles of the first two
    dimensions; a box of k rows bounds a probe's distances from above, and only boxes that begin within the least such bound
    are joined with it. Rounding is monotone, so bounds hold for the computed distances too, and nothing is lost.
    """
    for d in dims:
        store, probes = (df.where(F.col(d).isNotNull() & ~F.isnan(F.col(d).cast("double"))) for df in (store, probes))
    first = F.row_number().over(Window.partitionBy(*dims).orderBy(key))
    points = cut(store.select(key, *dims).withColumn("_k", first).where(F.col("_k") <= k).drop("_k"))
    n = points.count()
    boxes = max(1, n // max(256, math.isqrt(n)))
    points = points.withColumn("_box", F.lit(0))
    for d, parts in zip(dims, (math.isqrt(boxes), None)):
        made = points.select("_box").distinct().count() if parts is None else 1
        parts = parts or -(-boxes // max(1, made))
        edges = points.groupBy("_box").agg(F.percentile_approx(d, [i / parts for i in range(1, parts)] or [1.0]).alias("_edges"))
        below = F.aggregate("_edges", F.lit(0), lambda z, e: z + (e < F.col(d)).cast("int"))  # noqa: B023  called at once
        points = points.join(F.broadcast(edges), "_box").withColumn("_box", F.col("_box") * (parts + 1) + below).drop("_edges")
    points = cut(points)
    box = points.groupBy("_box").agg(F.count("*").alias("_n"), *[f(d).alias(f"_{n}{d}") for d in dims for f, n in ((F.min, "lo"), (F.max, "hi"))])
    box = F.broadcast(cut(box))
    p = probes.select("probe", *[F.col(d).alias(f"_{d}") for d in dims])
    square = lambda gaps: reduce(lambda a, b: a + b, [g * g for g in gaps])
    most = square([F.greatest(F.abs(F.col(f"_lo{d}") - F.col(f"_{d}")), F.abs(F.col(f"_hi{d}") - F.col(f"_{d}"))) for d in dims])
    least = square([F.greatest(F.col(f"_lo{d}") - F.col(f"_{d}"), F.col(f"_{d}") - F.col(f"_hi{d}"), F.lit(0.0)) for d in dims])
    bound = p.join(box).groupBy("probe", *[f"_{d}" for d in dims]).agg(F.min(F.when(F.col("_n") >= k, most)).alias("_bound"))
    near = bound.join(box, (least <= F.col("_bound")) | F.col("_bound").isNull()).select("probe", "_box", *[f"_{d}" for d in dims])
    d2 = square([F.col(d) - F.col(f"_{d}") for d in dims])
    scored = near.join(points, "_box").select("probe", key, d2.alias("d2"))
    rank = F.row_number().over(Window.partitionBy("probe").orderBy("d2", key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def largest_remainder(shares: DataFrame, by: list[str], item: str, weight: str, total: Column) -> DataFrame:
    """(by, item, quota): total dealt in proportion to weight; what truncation leaves goes to the largest remainders, the
    first item on ties."""
    all_of = Window.partitionBy(*by)
    exact = total * F.col(weight) / F.sum(weight).over(all_of)
    cut = shares.withColumn("_exact", exact).withColumn("_base", F.floor("_exact"))
    cut = cut.withColumn("_left", total - F.sum("_base").over(all_of))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(F.round(F.col("_exact") - F.col("_base"), 9)), item))
    return cut.withColumn("quota", (F.col("_base") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("long")).drop("_exact", "_base", "_left")


def pareto(rows: DataFrame, key: str, senses: dict[str, bool]) -> DataFrame:
    """Rows that no other dominates; senses: column to whether more is better. Equal rows do not dominate each other.

    Candidates are first thinned by the running best along one axis, so the anti join sees few rows.
    """
    first, *rest = senses
    up = {c: (F.col(c) if more else -F.col(c)) for c, more in senses.items()}
    flat = rows.select("*", *[v.alias(f"_{c}") for c, v in up.items()])
    points = flat.groupBy(*[f"_{c}" for c in senses]).agg(F.count("*").alias("count of equals"))
    if len(rest) == 1:
        best = F.max(f"_{rest[0]}").over(Window.orderBy(F.desc(f"_{first}"), F.desc(f"_{rest[0]}")).rowsBetween(Window.unboundedPreceding, -1))
        # The best by the second axis at each value of the first is all that can be on the front.
        ridge = points.groupBy(f"_{first}").agg(F.max(f"_{rest[0]}").alias(f"_{rest[0]}"))
        front = ridge.withColumn("_best", best).where(F.col("_best").isNull() | (F.col(f"_{rest[0]}") > F.col("_best"))).drop("_best")
        return flat.join(front, [f"_{c}" for c in senses], "left_semi").select(*rows.columns)
    other = points.select(*[F.col(f"_{c}").alias(f"o_{c}") for c in senses])
    no_worse = [F.col(f"o_{c}") >= F.col(f"_{c}") for c in senses]
    better = [F.col(f"o_{c}") > F.col(f"_{c}") for c in senses]
    dominated = no_worse[0]
    for c in no_worse[1:]:
        dominated &= c
    any_better = better[0]
    for c in better[1:]:
        any_better |= c
    front = points.join(other, dominated & any_better, "left_anti").drop("count of equals")
    return flat.join(front, [f"_{c}" for c in senses], "left_semi").select(*rows.columns)
