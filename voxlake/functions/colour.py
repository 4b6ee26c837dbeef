"""Colour expressions on columns. A colour is a tuple of three columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Colour = tuple[Column, Column, Column]

# The published matrices of OKLab (Ottosson, 2020), of sRGB's primaries, and the D65 white.
OKLAB_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
OKLAB_LMS_BACK = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
OKLAB_RGB_BACK = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def _times(m, v: Colour) -> Colour:
    return tuple(v[0] * r[0] + v[1] * r[1] + v[2] * r[2] for r in m)


def to_byte(v: Column) -> Column:
    """Unit to byte, halves to even, clamped."""
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(v * 255).cast("int")))


def srgb_to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(c, F.lit(1 / 2.4)) * 1.055 - 0.055)


def oklab(unit: Colour) -> Colour:
    """sRGB in [0, 1] to OKLab."""
    lms = _times(OKLAB_LMS, tuple(srgb_to_linear(c) for c in unit))
    return _times(OKLAB_LAB, tuple(F.cbrt(c) for c in lms))


LINEAR = np.array([c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4 for c in (k / 255 for k in range(256))])  # of bytes


def oklab_of(rgb: np.ndarray) -> np.ndarray:
    """(..., 3) OKLab of colours whose bytes are the low 24 bits of a number each."""
    lms = _times(OKLAB_LMS, tuple(LINEAR[rgb >> k & 255] for k in (16, 8, 0)))
    return np.stack(_times(OKLAB_LAB, tuple(np.cbrt(c) for c in lms)), -1)


def linear_rgb(lab: Colour) -> Colour:
    cube = tuple(c * c * c for c in _times(OKLAB_LMS_BACK, lab))
    return _times(OKLAB_RGB_BACK, cube)


def in_gamut(lab: Colour, slack: float = 1e-6) -> Column:
    r, g, b = (c.between(-slack, 1 + slack) for c in linear_rgb(lab))
    return r & g & b


def srgb8(lab: Colour) -> Colour:
    return tuple(to_byte(linear_to_srgb(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))) for c in linear_rgb(lab))


def complement(lab: Colour) -> Colour:
    return lab[0], -lab[1], -lab[2]


def distance2(p: Colour, q: Colour) -> Column:
    d = [a - b for a, b in zip(p, q)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def cielab(byte: Colour) -> Colour:
    """sRGB bytes to CIELAB under D65."""
    xyz = _times(XYZ, tuple(srgb_to_linear(c / 255) for c in byte))
    knee = (6 / 29) ** 3
    f = [F.when(t > knee, F.cbrt(t)).otherwise(t * (1 / (3 * (6 / 29) ** 2)) + 4 / 29) for t in (c / w for c, w in zip(xyz, WHITE))]
    return f[1] * 116 - 16, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def luma(unit: Colour) -> Column:
    return unit[0] * 0.2126 + unit[1] * 0.7152 + unit[2] * 0.0722


def hue_effect(lab: Colour) -> Column:
    """The hue term of the two-colour harmony model of Ou and Luo (2006)."""
    light, a, b = lab
    h = F.degrees(F.atan2(b, a))
    h = F.when(h < 0, h + 360).otherwise(h)
    strong = F.tanh(F.sqrt(a * a + b * b) * 0.5 - 2) * 0.5 + 0.5
    wave = -0.08 - F.sin(F.radians(h + 50)) * 0.14 - F.sin(F.radians(h * 2 + 90)) * 0.07
    t = (90 - h) / 10
    return strong * (wave + (light * 0.22 - 12.8) / 10 * F.exp(t - F.exp(t)))


def harmony(p: Colour, q: Colour) -> Column:
    """Harmony of two CIELAB colours: chromatic, lightness and hue terms (Ou and Luo, 2006)."""
    d_chroma = F.sqrt(p[1] * p[1] + p[2] * p[2]) - F.sqrt(q[1] * q[1] + q[2] * q[2])
    d_hue2 = F.greatest(F.lit(0.0), F.pow(p[1] - q[1], 2) + F.pow(p[2] - q[2], 2) - d_chroma * d_chroma)
    chromatic = F.tanh(0.8 - F.sqrt(d_hue2 + F.pow(d_chroma / 1.46, 2)) * 0.045) * 0.53 + 0.04
    lightness = F.tanh((p[0] + q[0]) * 0.029 - 3.88) * 0.54 + 0.28 + F.tanh(F.abs(p[0] - q[0]) * 0.2 - 2) * 0.15 + 0.14
    return chromatic + lightness + hue_effect(p) + hue_effect(q)
