"""Colour arithmetic on pixel tables: stain separation, CIE Lab, colour differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optical densities of haematoxylin, eosin and DAB in red, green, blue, and the inverse of that matrix.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def _inverse(m: tuple) -> list[list[float]]:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return [[(e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det], [(f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det], [(d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det]]


def stains(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Haematoxylin, eosin and DAB of an 8-bit colour; darkness is measured in units of the darkest value."""
    logs = [F.ln(F.greatest(c / 255.0, F.lit(1e-6))) / F.lit(-13.815510557964274) for c in (r, g, b)]
    inv = _inverse(STAINS)
    return tuple(F.greatest(sum(logs[k] * inv[k][j] for k in range(3)), F.lit(0.0)) for j in range(3))


def unstain(h: Column, e: Column, d: Column) -> tuple[Column, Column, Column]:
    """The 8-bit colour (as double, clipped) of stain amounts."""
    parts = (h, e, d)
    return tuple(F.least(F.greatest(F.exp(sum(parts[j] * STAINS[j][k] for j in range(3)) * -13.815510557964274), F.lit(0.0)), F.lit(1.0)) * 255.0 for k in range(3))


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*, a*, b* (D65) of an 8-bit sRGB colour."""

    def linear(c: Column) -> Column:
        u = c / 255.0
        return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, 2.4))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856451679035631, F.pow(t, 1.0 / 3.0)).otherwise(t / 0.12841854934601665 + 0.13793103448275862)

    lr, lg, lb = linear(r), linear(g), linear(b)
    x, y, z = (f((p * lr + q * lg + s * lb) / white) for p, q, s, white in ((0.4124564, 0.3575761, 0.1804375, 0.95047), (0.2126729, 0.7151522, 0.0721750, 1.0), (0.0193339, 0.1191920, 0.9503041, 1.08883)))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def difference_76(a: tuple, b: tuple) -> Column:
    return F.sqrt(sum(F.pow(x - y, 2) for x, y in zip(a, b)))


def difference_2000(p: tuple, q: tuple) -> Column:
    """CIEDE2000 of two Lab colours."""
    (l1, a1, b1), (l2, a2, b2) = p, q
    c7 = F.pow((F.sqrt(a1 * a1 + b1 * b1) + F.sqrt(a2 * a2 + b2 * b2)) / 2, 7)
    g = 0.5 * (1 - F.sqrt(c7 / (c7 + 6103515625.0)))
    a1p, a2p = (1 + g) * a1, (1 + g) * a2
    c1, c2 = F.sqrt(a1p * a1p + b1 * b1), F.sqrt(a2p * a2p + b2 * b2)

    def hue(a: Column, b: Column) -> Column:
        h = F.degrees(F.atan2(b, a))
        return F.when((a == 0) & (b == 0), F.lit(0.0)).when(h < 0, h + 360.0).otherwise(h)

    h1, h2 = hue(a1p, b1), hue(a2p, b2)
    flat = c1 * c2 == 0
    dh = F.when(flat, F.lit(0.0)).when(F.abs(h2 - h1) <= 180, h2 - h1).when(h2 > h1, h2 - h1 - 360.0).otherwise(h2 - h1 + 360.0)
    hm = F.when(flat, h1 + h2).when(F.abs(h1 - h2) <= 180, (h1 + h2) / 2).when(h1 + h2 < 360, (h1 + h2 + 360.0) / 2).otherwise((h1 + h2 - 360.0) / 2)
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    t = 1 - 0.17 * F.cos(F.radians(hm - 30)) + 0.24 * F.cos(F.radians(2 * hm)) + 0.32 * F.cos(F.radians(3 * hm + 6)) - 0.20 * F.cos(F.radians(4 * hm - 63))
    sl = 1 + 0.015 * F.pow(lm - 50, 2) / F.sqrt(20 + F.pow(lm - 50, 2))
    sc, sh = 1 + 0.045 * cm, 1 + 0.015 * cm * t
    cm7 = F.pow(cm, 7)
    rt = -F.sin(F.radians(60.0 * F.exp(-F.pow((hm - 275) / 25, 2)))) * 2 * F.sqrt(cm7 / (cm7 + 6103515625.0))
    dc, dhh = (c2 - c1) / sc, 2 * F.sqrt(c1 * c2) * F.sin(F.radians(dh / 2)) / sh
    return F.sqrt(F.pow((l2 - l1) / sl, 2) + F.pow(dc, 2) + F.pow(dhh, 2) + rt * dc * dhh)


def wrap_add(a: Column, b: Column) -> Column:
    """Sum of 8-bit values that runs over at 256."""
    return F.pmod(a + b, F.lit(256))
