"""Neighbour bonds of dense cubes: open along an axis by lead(), cyclic by a shifted key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pool import AXES

Weight = Callable[[Column, Column], Column]

DIFFERS: Weight = lambda p, q: F.when(p != q, 1).otherwise(0)
SPREAD: Weight = lambda p, q: (p - q) * (p - q)


def bonds(cells: DataFrame, value: str, axes=AXES, frames: int = 16) -> DataFrame:
    """(t, y, x, axis, p, q): each cell's value and its next neighbour's along each axis, inside its capture of so many frames.

    No window is longer than a capture's side, and none holds the history of a place over captures.
    """
    out = None
    for axis in axes:
        own = [F.expr(f"t div {frames}")] if axis == "t" else []
        line = Window.partitionBy(*own, *[c for c in AXES if c != axis]).orderBy(axis)
        part = cells.select(*AXES, F.lit(axis).alias("axis"), F.col(value).alias("p"), F.lead(value).over(line).alias("q")).where("q is not null")
        out = part if out is None else out.unionByName(part)
    return out


def energy(cells: DataFrame, value: str, weight: Weight = DIFFERS, axes=AXES) -> DataFrame:
    """Sum of a weight over bonds, by axis."""
    return bonds(cells, value, axes).groupBy("axis").agg(F.count("*").alias("bonds"), F.sum(weight(F.col("p"), F.col("q"))).alias("energy"))


def split_by_tile(cells: DataFrame, value: str, k: int, weight: Weight = DIFFERS) -> DataFrame:
    """Energy of bonds inside tiles of side k, and of those that cross a wall."""
    own = F.when(F.col("axis") == "t", F.col("t")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("x"))
    wall = ((own + 1) % k == 0).alias("wall")
    return bonds(cells, value).groupBy(wall).agg(F.count("*").alias("bonds"), F.sum(weight(F.col("p"), F.col("q"))).alias("energy"))


def plane_walls(cells: DataFrame, value: str) -> DataFrame:
    """(t, walls, bonds): differing bonds, and all, in each frame's plane, open."""
    return bonds(cells, value, ("y", "x")).groupBy("t").agg(F.sum(DIFFERS(F.col("p"), F.col("q"))).alias("walls"), F.count("*").alias("bonds"))


def cyclic_walls(cells: DataFrame, value: str, frames: int) -> DataFrame:
    """Differing bonds along t, the last frame of each capture of so many frames bonded to its first."""
    after = cells.select((F.col("t") - F.col("t") % frames + F.pmod(F.col("t") % frames - 1, F.lit(frames))).alias("t"), "y", "x", F.col(value).alias("_q"))
    joined = cells.select(*AXES, F.col(value).alias("_p")).join(after, list(AXES))
    return joined.agg(F.sum(DIFFERS(F.col("_p"), F.col("_q"))).alias("walls"), F.count("*").alias("bonds"))


def liberties(board: DataFrame, colour: int, empty: int = 2) -> DataFrame:
    """board(board, y, x, stone): empty places with a neighbour of the colour, by board, each once."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    near = board.where(F.col("stone") == colour).select("board", "y", "x", F.explode(steps).alias("d"))
    near = near.select("board", (F.col("y") + F.col("d.dy")).alias("y"), (F.col("x") + F.col("d.dx")).alias("x"))
    return board.where(F.col("stone") == empty).join(near, ["board", "y", "x"], "left_semi").groupBy("board").agg(F.count("*").alias("liberties"))
