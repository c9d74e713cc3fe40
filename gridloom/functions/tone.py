"""Tone functions of one pixel, as column expressions.

Every function takes and returns columns; a neutral parameter returns its argument, so that no expression is built
for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

#: Luma weights.
LUMA = (0.299, 0.587, 0.114)

RGB = tuple[Column, Column, Column]


def lit(x: float) -> Column:
    return F.lit(float(x))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(lit(low), F.least(lit(high), v))


DEPTHS = {"uint8": 255.0, "uint16": 65535.0}


def normalise(v: Column, dtype: str, low: Column | None = None, high: Column | None = None) -> Column:
    """To [0, 1]: by depth, or between the image's least and greatest value; a flat image is 0."""
    if dtype in DEPTHS:
        return v.cast("double") / lit(DEPTHS[dtype])
    v, low, high = (c.cast("double") for c in (v, low, high))
    return F.when(high > low, (v - low) / (high - low)).otherwise(0.0)


def denormalise(v: Column, dtype: str, rescale: tuple[Column, Column] | None = None) -> Column:
    """Back, cut off to whole numbers. Other types stay in [0, 1], unless rescale gives their range."""
    if dtype in DEPTHS:
        return (clip(v) * lit(DEPTHS[dtype])).cast("int")
    if rescale:
        return clip(v) * (rescale[1] - rescale[0]) + rescale[0]
    return clip(v) if dtype.startswith("float") else clip(v).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return lit(LUMA[0]) * r + lit(LUMA[1]) * g + lit(LUMA[2]) * b


def brightness(v: Column, b: float) -> Column:
    return v if b == 1 else clip(v * lit(b))


def contrast(v: Column, c: float) -> Column:
    return v if c == 1 else clip((v - lit(0.5)) * lit(c) + lit(0.5))


def saturation(rgb: RGB, s: float) -> RGB:
    if s == 1:
        return rgb
    y = luma(*rgb)
    return tuple(clip(y * lit(1 - s) + v * lit(s)) for v in rgb)


def gamma(v: Column, b: float) -> Column:
    g = min(8.0, max(0.125, 2.0**-b))
    return clip(F.pow(clip(v, 1e-6), lit(g)))


def s_curve(v: Column, c: float) -> Column:
    if c == 0:
        return v
    if c < 0:
        return clip(v * lit(1 + c) + lit(-0.5 * c))
    k = 5 + 20 * c
    low, high = 1 / (1 + math.exp(0.5 * k)), 1 / (1 + math.exp(-0.5 * k))
    curved = (lit(1) / (lit(1) + F.exp(lit(-k) * (v - lit(0.5)))) - lit(low)) / lit(high - low)
    return clip(v * lit(1 - c) + curved * lit(c))


def more_saturated(s: Column, x: float) -> Column:
    return s if x == 0 else clip(s * lit(1 + x))


def _byte(v: Column) -> Column:
    return (clip(v) * lit(255)).cast("int")


def to_hsv(r: Column, g: Column, b: Column) -> RGB:
    """Hue, saturation and value in 8 bits, hue from 0 to 179, each by 255: with the fixed-point division of common libraries."""
    r, g, b = map(_byte, (r, g, b))
    v = F.greatest(r, g, b)
    d = v - F.least(r, g, b)
    fixed = lambda n, by: F.when(by > 0, F.rint(lit(n) / by.cast("double"))).otherwise(0.0)
    s = F.floor((d * fixed(255 * 4096, v) + lit(2048)) / lit(4096))
    turn = F.when(v == r, g - b).when(v == g, b - r + 2 * d).otherwise(r - g + 4 * d)
    h = F.floor((turn * fixed(30 * 4096, d) + lit(2048)) / lit(4096))
    h = F.when(h < 0, h + 180).otherwise(h)
    return tuple(x.cast("double") / lit(255) for x in (h, s, v))


def from_hsv(h: Column, s: Column, v: Column) -> RGB:
    """The inverse, in 8 bits again."""
    h, s, v = (_byte(x).cast("double") for x in (h, s, v))
    h, s, v = h / lit(30), s / lit(255), v / lit(255)
    k = F.floor(h)
    f = h - k
    k = (k % 6).cast("int")
    p, q, t = v * (lit(1) - s), v * (lit(1) - s * f), v * (lit(1) - s * (lit(1) - f))
    out = []
    for order in ((v, q, p, p, t, v), (t, v, v, q, p, p), (p, p, t, v, v, q)):
        x = order[5]
        for i in range(4, -1, -1):
            x = F.when(k == i, order[i]).otherwise(x)
        out.append(F.rint(x * lit(255)) / lit(255))
    return tuple(out)


def chain(rgb: RGB, b: float = 1.0, c: float = 1.0, s: float = 1.0) -> RGB:
    """Brightness, contrast and saturation, in this order."""
    return saturation(tuple(contrast(brightness(v, b), c) for v in rgb), s)


def gli(r: Column, g: Column, b: Column) -> Column:
    """Green leaf index."""
    return (lit(2) * g - r - b) / (lit(2) * g + r + b + lit(1e-8))


def is_water(r: Column, g: Column, b: Column, s: Column, v: Column) -> Column:
    return (b > r) & (b > g) & (v < 0.5) & (s < 0.3)


def region(boost: Column, suppress: Column, mask: Column, factor: float, up: float, down: float) -> tuple[Column, Column]:
    return clip(boost * (lit(1) + mask * lit(factor) * lit(up))), clip(suppress * (lit(1) - mask * lit(factor) * lit(down)))
