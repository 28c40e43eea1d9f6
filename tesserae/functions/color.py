"""Colour arithmetic on columns of channels 0 to 255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column | int) -> Column:
    """Integer quotient, towards zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def clamp(v: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """0xAARRGGBB as a non-negative number."""
    return F.shiftleft(a.cast("long"), 24).bitwiseOR(F.shiftleft(r.cast("long"), 16)).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def channel(packed: Column, shift: int) -> Column:
    return F.shiftright(packed, shift).bitwiseAND(F.lit(255))


def average(a: Column, b: Column) -> Column:
    """Mean of two channels without their lowest bits."""
    return F.shiftright(a, 1) + F.shiftright(b, 1)


def intensity(r: Column, g: Column, b: Column) -> Column:
    """0 to 2040."""
    return 3 * r + 4 * g + b


def saturated(r: Column, g: Column, b: Column) -> list[Column]:
    """Twice as far from the perceived brightness, truncated."""
    p = F.sqrt(r * r * 0.299 + g * g * 0.587 + b * b * 0.144)
    return [F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), p + (c - p) * 2.0))) for c in (r, g, b)]


def normalized(c: Column, low: Column, high: Column) -> Column:
    """A channel stretched by an image's intensity bounds; equal bounds leave it."""
    factor = F.floor(F.lit(2047 * 4096) / F.greatest(high - low, F.lit(1)))
    moved = (c - F.shiftright(low, 3)) * factor
    return F.when(low == high, c).otherwise(clamp(F.when(moved < 0, -F.shiftright(-moved, 12)).otherwise(F.shiftright(moved, 12))))


def squared_error(a: tuple[Column, Column, Column], b: tuple) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)), (a[0] - b[0]) * (a[0] - b[0]))


#: Fixed values of the DIN99d conversion: the companding divisor and the matrix rows are the
#: reference's, the others the standard's.
COMPANDING = 1.044
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def din99d(r: Column, g: Column, b: Column) -> list[Column]:
    """Three coordinates 0 to 255 of a colour in DIN99d, truncated."""
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / COMPANDING, F.lit(2.4))) for c in (r, g, b)]
    x, y, z = (sum((k * c for k, c in zip(row[1:], linear[1:], strict=True)), row[0] * linear[0]) for row in XYZ)
    x = 1.12 * x - 0.12 * z
    f = lambda v: F.when(v > 216.0 / 24389.0, F.cbrt(v)).otherwise((24389.0 / 27.0 * v + 16.0) / 116.0)
    fx, fy, fz = (f(v / w) for v, w in zip((x, y, z), WHITE, strict=True))
    light, red, yellow = 116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz)
    e = 0.6427876096865393 * red + 0.766044443118978 * yellow
    q = 1.14 * (0.6427876096865393 * yellow - 0.766044443118978 * red)
    chroma = 22.5 * F.log(1.0 + 0.06 * F.sqrt(e * e + q * q))
    hue = F.atan2(q, e) + 0.8726646
    return [F.floor(325.22 * F.log(1.0 + 0.0036 * light) * 2.5), F.floor(chroma * F.cos(hue) * 2.5 + 128.0), F.floor(chroma * F.sin(hue) * 2.5 + 128.0)]


def opaque(a: Column, threshold: int) -> Column:
    return F.when(a < threshold, 0).otherwise(255)


def differentiated(c: Column, reference: Column, least: int) -> Column:
    """A channel pushed at least that far from a reference, on its own side, within range."""
    near = F.abs(c - reference) < least
    return F.when(near & (c <= reference), F.greatest(reference - least, F.lit(0))).when(near, F.least(reference + least, F.lit(255))).otherwise(c)


def premultiplied(c: Column, a: Column) -> Column:
    """c and a each one higher, multiplied, less one, over 256."""
    return F.shiftright(c * a + c + a, 8)


def unpremultiplied(c: Column, a: Column) -> Column:
    return F.when(a == 0, 0).otherwise(F.least(F.lit(255), F.floor((c * 255 + F.floor(a / 2)) / a)))


def linear_light(c: Column) -> Column:
    """sRGB channel to linear light, 0 to 2047."""
    v = c / 255.0
    return F.floor(F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))) * 2047 + 0.5)


def over(c: Column, a: Column, under: Column, opacity: int = 256) -> Column:
    """Source over an opaque colour, with a layer opacity of 0 to 256."""
    alpha = F.shiftright(a * opacity, 8)
    return F.floor((c * alpha + under * (255 - alpha) + 127) / 255)


def cube_index(r: Column, g: Column, b: Column) -> Column:
    """Pen of the 6 by 6 by 6 cube nearest in every channel; ties go to the lower level."""
    level = lambda c: F.when(c <= 47, 0).when(c <= 115, 1).otherwise(F.ceil((c - 115) / 40) + 1)
    return (16 + 36 * level(r) + 6 * level(g) + level(b)).cast("long")
