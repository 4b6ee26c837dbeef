"""Moments of a frame's background and the ground colours that follow from them, in OKLab columns ll, la, lb."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake.functions import colour

# Fixed value: the slope of log chroma where a frame's primaries have no spread.
PRIOR_SLOPE = 0.7469411483195036


def chroma2() -> Column:
    return F.col("la") * F.col("la") + F.col("lb") * F.col("lb")


def ln_chroma() -> Column:
    return F.when(chroma2() > 0, F.ln(F.sqrt(chroma2())))


def direction(a: Column, b: Column, otherwise: tuple[float, float]) -> tuple[Column, Column]:
    """(a, b) at unit length; a vector of no length becomes otherwise."""
    m = F.sqrt(a * a + b * b)
    return F.when(m > 0, a / m).otherwise(otherwise[0]), F.when(m > 0, b / m).otherwise(otherwise[1])


def background_sums(weight: Column) -> list[Column]:
    """The aggregates that background() takes; cells of no positive weight do not count."""
    w = F.when(weight > 0, weight)
    tinted = F.when(chroma2() > 0, w)
    return [
        (F.sum(w * F.col("ll")) / F.sum(w)).alias("mean_l"), (F.sum(tinted * ln_chroma()) / F.sum(tinted)).alias("mean_ln_c"),
        (F.sum(tinted * ln_chroma() * ln_chroma()) / F.sum(tinted)).alias("_m2"), F.sum(tinted * F.col("la")).alias("_a"), F.sum(tinted * F.col("lb")).alias("_b"),
    ]


def background() -> list[Column]:
    """mean_l, mean_ln_c, sd_ln_c, hue_a and hue_b of background_sums(); without chromatic weight mean_ln_c is null."""
    a, b = direction(F.col("_a"), F.col("_b"), (0.0, 0.0))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("mean_ln_c") * F.col("mean_ln_c")))
    return [F.col("mean_l"), F.col("mean_ln_c"), spread.alias("sd_ln_c"), a.alias("hue_a"), b.alias("hue_b")]


def background_moments(cells: DataFrame, weight: Column, by: list[str]) -> DataFrame:
    """(by, mean_l, mean_ln_c, sd_ln_c, hue_a, hue_b): weighted lightness, log chroma of chromatic cells, and mean hue.

    Cells of no positive weight do not count; groups without chromatic weight are left out.
    """
    return cells.groupBy(*by).agg(*background_sums(weight)).where("mean_ln_c is not null").select(*by, *background())


def ground_moments(primaries: DataFrame, background: DataFrame, by: list[str]) -> DataFrame:
    """(by, delta_l, alpha, beta, rot_a, rot_b): what takes the primaries' lightness, log chroma and hue to the background's."""
    sums = primaries.groupBy(*by).agg(
        F.avg("ll").alias("_l"), F.avg(ln_chroma()).alias("_m"), F.avg(ln_chroma() * ln_chroma()).alias("_m2"), F.sum("la").alias("_a"), F.sum("lb").alias("_b")
    )
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("_m2") - F.col("_m") * F.col("_m")))
    beta = F.when(spread > 0, F.col("sd_ln_c") / spread).otherwise(PRIOR_SLOPE)
    a = F.col("hue_a") * F.col("_a") + F.col("hue_b") * F.col("_b")
    b = F.col("hue_b") * F.col("_a") - F.col("hue_a") * F.col("_b")
    rot_a, rot_b = direction(a, b, (1.0, 0.0))
    joined = sums.join(background, by).withColumn("beta", beta)
    alpha = F.col("mean_ln_c") - F.col("beta") * F.coalesce("_m", F.lit(0.0))
    return joined.select(*by, (F.col("mean_l") - F.col("_l")).alias("delta_l"), alpha.alias("alpha"), "beta", rot_a.alias("rot_a"), rot_b.alias("rot_b"))


def balanced_ground(lab: colour.Colour) -> colour.Colour:
    """The partner about neutral, at the background's lightness; takes the columns of ground_moments."""
    return lab[0] + F.col("delta_l"), -lab[1], -lab[2]


def fitted_ground(lab: colour.Colour) -> colour.Colour:
    """Log chroma by an affine law and hue by a rotation; takes the columns of ground_moments. Grey stays grey."""
    c2 = lab[1] * lab[1] + lab[2] * lab[2]
    c = F.sqrt(c2)
    scale = F.when(c2 > 0, F.exp(F.col("alpha") + F.col("beta") * F.ln(c)) / c).otherwise(0.0)
    a, b = F.col("rot_a"), F.col("rot_b")
    return lab[0] + F.col("delta_l"), (lab[1] * a - lab[2] * b) * scale, (lab[1] * b + lab[2] * a) * scale


def kept_chroma(ll: np.ndarray, la: np.ndarray, lb: np.ndarray, steps: int = 40) -> np.ndarray:
    """The share of each colour's chroma that the gamut holds: all of it, or what bisection finds.

    Each linear channel is a cubic in the share; its coefficients are found once a colour.
    """
    base = [ll * m[0] for m in colour.OKLAB_LMS_BACK]
    slope = [la * m[1] + lb * m[2] for m in colour.OKLAB_LMS_BACK]
    terms = [[b * b * b, b * b * s * 3, b * s * s * 3, s * s * s] for b, s in zip(base, slope)]
    cubics = [[sum((terms[i][k] * row[i] for i in range(3)), 0.0) for k in range(4)] for row in colour.OKLAB_RGB_BACK]

    def fits(share: np.ndarray, rows: slice | np.ndarray) -> np.ndarray:
        out = np.ones(len(share), bool)
        for q in cubics:
            c = ((q[3][rows] * share + q[2][rows]) * share + q[1][rows]) * share + q[0][rows]
            out &= (c >= -1e-6) & (c <= 1 + 1e-6)
        return out

    found = np.ones(len(ll))
    outside = np.flatnonzero(~fits(found, slice(None)))
    low = np.zeros(len(outside))
    for k in range(1, steps + 1):
        low = np.where(fits(low + 0.5**k, outside), low + 0.5**k, low)
    found[outside] = low
    return found


def chroma_clamp(colours: DataFrame, steps: int = 40) -> DataFrame:
    """colours(ll, la, lb, ...), their chroma scaled down to the gamut's edge by bisection where they lie outside. The column
    _clamp is taken."""

    @F.pandas_udf("double")
    def share(ll: pd.Series, la: pd.Series, lb: pd.Series) -> pd.Series:
        return pd.Series(kept_chroma(*(v.to_numpy(np.float64) for v in (ll, la, lb)), steps))

    shares = colours.withColumn("_clamp", share("ll", "la", "lb"))
    return shares.withColumns({c: F.col(c) * F.col("_clamp") for c in ("la", "lb")}).drop("_clamp")
