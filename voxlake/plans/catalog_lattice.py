"""Queries of colour clamps, lattice indices, roles, bit and torus expressions over every cell, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxlake.functions import colour, lattice

from .catalog import LAB_SQL, query, rgb, rounded, unit
from .catalog_more import lab_cells

_level = "(CASE WHEN {b} <= 3 THEN 0 WHEN {b} <= 6 THEN 1 WHEN {b} <= 10 THEN 2 ELSE 3 END)"
_bin = "least(13, greatest(0, CAST(floor({c} * 14) AS INT)))"


@query("SELECT t, y, x, " + ", ".join(_level.format(b=_bin.format(c=c)) + f" AS {c}" for c in "rgb") + " FROM cube")
def c202_bin_to_level(cells):
    return cells.select("t", "y", "x", *[lattice.bin_to_level(lattice.value_to_bin(F.col(c))).alias(c) for c in "rgb"])


@query("SELECT t, y, x, CAST(64 * (idx // 64) + 16 * (idx // 16 % 4) + 4 * (idx // 4 % 4) + idx % 4 AS INT) AS idx FROM cube")
def c205_coordinate_to_index(cells):
    return cells.select("t", "y", "x", lattice.compose_index(*lattice.split_index(F.col("idx"))).alias("idx"))


@query("+ p AS (SELECT t, y, x, idx AS p, lead(idx) OVER (PARTITION BY t, y ORDER BY x) AS q FROM cube) SELECT t, y, x, round(sqrt(pow(p // 64 - q // 64, 2) + pow(p // 16 % 4 - q // 16 % 4, 2) + pow(p // 4 % 4 - q // 4 % 4, 2) + pow(p % 4 - q % 4, 2)), 6) AS d FROM p WHERE q IS NOT NULL")
def c207_lattice_distance(cells):
    q = F.lead("idx").over(Window.partitionBy("t", "y").orderBy("x"))
    pairs = cells.select("t", "y", "x", F.col("idx").alias("p"), q.alias("q")).where("q is not null")
    d2 = sum((F.pow(a - b, F.lit(2)) for a, b in zip(lattice.split_index(F.col("p")), lattice.split_index(F.col("q")))), F.lit(0.0))
    return rounded(pairs.select("t", "y", "x", F.sqrt(d2).alias("d")))


@query(f"+ {LAB_SQL} SELECT t, y, x, round(least(1, greatest(0, ll * 1.2::DOUBLE - 0.1::DOUBLE)), 6) AS l FROM lab")
def c10_lightness_clamp(cells):
    light = F.col("ll") * 1.2 - 0.1
    return rounded(lab_cells(cells).select("t", "y", "x", F.least(F.lit(1.0), F.greatest(F.lit(0.0), light)).alias("l")))


@query(f"+ {LAB_SQL}, n AS (SELECT *, sqrt(la * la + lb * lb) AS m FROM lab) SELECT t, y, x, round(CASE WHEN m > 1e-12 THEN la / m ELSE 1 END, 6) AS c, round(CASE WHEN m > 1e-12 THEN lb / m ELSE 0 END, 6) AS s FROM n")
def c14_hue_direction(cells):
    m = F.sqrt(F.col("la") * F.col("la") + F.col("lb") * F.col("lb"))
    some = m > 1e-12
    return rounded(lab_cells(cells).select("t", "y", "x", F.when(some, F.col("la") / m).otherwise(1.0).alias("c"), F.when(some, F.col("lb") / m).otherwise(0.0).alias("s")))


@query(f"+ {LAB_SQL} SELECT t, y, x, round(0.6::DOUBLE * la - 0.8::DOUBLE * lb, 6) AS a, round(0.8::DOUBLE * la + 0.6::DOUBLE * lb, 6) AS b FROM lab")
def c13_hue_rotation(cells):
    """Each colour turned by the rotation (0.6, 0.8)."""
    a, b = F.col("la"), F.col("lb")
    return rounded(lab_cells(cells).select("t", "y", "x", (a * 0.6 - b * 0.8).alias("a"), (a * 0.8 + b * 0.6).alias("b")))


@query("SELECT t, y, x, round(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b, 6) AS luma FROM cube")
def c23_luma(cells):
    return rounded(cells.select("t", "y", "x", colour.luma(rgb()).alias("luma")))


@query("SELECT t, y, x, round((side - 1) / 8.0::DOUBLE * (2 - s), 6) AS sigma FROM cube")
def c212_depth_to_sigma(cells):
    return rounded(cells.select("t", "y", "x", ((F.col("side") - 1) / 8.0 * (2 - F.col("s"))).alias("sigma")))


@query("SELECT t, y, x, CAST(t AS BIGINT) * side * side + y * side + x AS v FROM cube")
def c229_cell_linearise(cells):
    return cells.select("t", "y", "x", (F.col("t").cast("long") * F.col("side") * F.col("side") + F.col("y") * F.col("side") + F.col("x")).alias("v"))


@query("SELECT t, y, x, idx >= 128 AS spin FROM cube")
def c223_spin(cells):
    return cells.select("t", "y", "x", (F.col("idx") >= 128).alias("spin"))


@query("SELECT t // 2 AS bt, y // 2 AS \"by\", x // 2 AS bx, round(avg(ll), 6) AS l, round(avg(la), 6) AS a, round(avg(lb), 6) AS b FROM lab GROUP BY ALL".join([f"+ {LAB_SQL} ", ""]))
def f34_oklab_pool(cells):
    key = [F.expr(f"cast({c} div 2 as int)").alias(f"b{c}") for c in ("t", "y", "x")]
    return rounded(lab_cells(cells).groupBy(*key).agg(*[F.avg(c).alias(n) for c, n in zip(("ll", "la", "lb"), "lab")]))


@query(f"+ {LAB_SQL} SELECT t, round(sum(abs(ll) + abs(la) + abs(lb)), 4) AS mass FROM lab GROUP BY t")
def n22_l1_mass(cells):
    return rounded(lab_cells(cells).groupBy("t").agg(F.sum(F.abs("ll") + F.abs("la") + F.abs("lb")).alias("mass")), 4)


@query("SELECT t, idx, count(*) AS cells, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM cube GROUP BY t, idx")
def f73_centroid_and_box(cells):
    box = (F.max("x") - F.min("x") + 1) * (F.max("y") - F.min("y") + 1)
    return rounded(cells.groupBy("t", "idx").agg(F.count("*").alias("cells"), box.alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy")))


@query("SELECT idx, t, count(*) AS cells, min(y * side + x) AS first, max(y * side + x) AS last FROM cube GROUP BY idx, t")
def n70_colour_trajectories(cells):
    at = F.col("y") * F.col("side") + F.col("x")
    return cells.groupBy("idx", "t").agg(F.count("*").alias("cells"), F.min(at).alias("first"), F.max(at).alias("last"))


@query("SELECT t, count(DISTINCT idx) AS used, round(avg(sqrt(pow(r - (idx // 16 % 4) / 3.0::DOUBLE, 2) + pow(g - (idx // 4 % 4) / 3.0::DOUBLE, 2) + pow(b - (idx % 4) / 3.0::DOUBLE, 2))), 6) AS error FROM cube GROUP BY t")
def f74_palette_fidelity(cells):
    """Entries that a frame uses, and the mean distance of its cells from their entries' levels."""
    levels = lattice.split_index(F.col("idx"))[1:]
    d2 = sum((F.pow(c - v / 3.0, F.lit(2)) for c, v in zip(unit("r", "g", "b"), levels)), F.lit(0.0))
    return rounded(cells.groupBy("t").agg(F.count_distinct("idx").alias("used"), F.avg(F.sqrt(d2)).alias("error")))
