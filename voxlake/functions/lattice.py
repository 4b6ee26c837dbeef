"""Lattice, bit and geometry expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Factor, summand and modulus of the generator; and the rates and the critical-band law of the dissonance curve
# (Plomp and Levelt, 1965; Sethares, 1993).
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 1 << 31
RATES = (3.51, 5.75)
BAND = (0.24, 0.0207, 18.96)


def lcg(s: Column) -> Column:
    """One step of the linear congruential generator; the product stays below 2^62."""
    return (s.cast("long") * LCG_A + LCG_C) % LCG_M


def value_to_bin(v: Column) -> Column:
    """14 bins of [0, 1]: truncated, then kept in 0..13."""
    return F.least(F.lit(13), F.greatest(F.lit(0), F.floor(v * 14).cast("int")))


def bin_to_level(b: Column) -> Column:
    """Bins 0-3, 4-6, 7-10 and 11-13 are levels 0 to 3."""
    return F.when(b <= 3, 0).when(b <= 6, 1).when(b <= 10, 2).otherwise(3)


def compose_index(epoch: Column, a: Column, b: Column, c: Column) -> Column:
    return (epoch * 64 + a * 16 + b * 4 + c).cast("int")


def split_index(i: Column) -> list[Column]:
    """(d, a, b, c), each 0..3."""
    return [F.shiftright(i, s).bitwiseAND(3).alias(n) for n, s in zip("dabc", (6, 4, 2, 0))]


def epoch_centres(frames: int) -> list[float]:
    return [k * (frames - 1) / 8 for k in (1, 3, 5, 7)]


def nearest_epoch(t: Column, frames: int) -> Column:
    """The epoch of greatest probability, whatever the depth: all four share one width; the lowest on ties."""
    c = epoch_centres(frames)
    out = F.lit(3)
    for k in (2, 1, 0):
        out = F.when(t <= (c[k] + c[k + 1]) / 2, k).otherwise(out)
    return out


def sigma_of_depth(s: Column, frames: int) -> Column:
    return (2 - s) * ((frames - 1) / 8)


def epoch_probabilities(t: Column, s: Column, frames: int) -> list[Column]:
    """Four Gaussians over the frame, normalised; their sum is at least 1e-10."""
    var = F.pow(sigma_of_depth(s, frames), 2) * 2
    raw = [F.exp(-F.pow(t - c, 2) / var) for c in epoch_centres(frames)]
    total = F.greatest(raw[0] + raw[1] + raw[2] + raw[3], F.lit(1e-10))
    return [p / total for p in raw]


def stone(a: Column, b: Column, gap: float = 0.08) -> Column:
    """0 where a leads by more than gap, 1 where b does, 2 between."""
    return F.when(a - b > gap, 0).when(b - a > gap, 1).otherwise(2)


def binary_entropy(a: Column, b: Column) -> Column:
    """Bits of a split into a and b; 0 if one side is empty."""
    p, q = a / (a + b), b / (a + b)
    return F.when((a > 0) & (b > 0), -(p * F.log2(p) + q * F.log2(q))).otherwise(F.lit(0.0))


def rung(coverage: Column) -> Column:
    """Resolution by coverage: 64 at the ends, 32 next to them, 16 between."""
    return F.when((coverage < 1 / 32) | (coverage > 31 / 32), 64).when((coverage < 3 / 32) | (coverage > 29 / 32), 32).otherwise(16)


def metres_to_signal(m: Column) -> Column:
    """Inverse depth between 1.5 m (0) and 0.25 m (1), clamped; what is not a positive number is 0.5."""
    v = (1 / m - 1 / 1.5) / (1 / 0.25 - 1 / 1.5)
    return F.when(F.isnan(m) | m.isNull() | (m <= 0), F.lit(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v)))


def dissonance(x: Column) -> Column:
    return F.exp(x * -RATES[0]) - F.exp(x * -RATES[1])


def pair_dissonance(f1: Column, w1: Column, f2: Column, w2: Column) -> Column:
    scale = F.lit(BAND[0]) / (F.least(f1, f2) * BAND[1] + BAND[2])
    return w1 * w2 * dissonance(scale * F.abs(f2 - f1))
