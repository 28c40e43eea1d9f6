"""Cells of 8 by 8 pixels: blocking, means, medians, bitmaps and errors.

A cell keeps its 64 pixels, row by row, as an array, so work within a cell needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C

SIDE = 8
PIXELS = SIDE * SIDE


def cell_blocks(pixels: DataFrame) -> DataFrame:
    """image_id, cx, cy, px: cells with their 64 pixels in row order; what an image lacks is clear black."""
    i = (F.col("y") % SIDE) * SIDE + F.col("x") % SIDE
    i_type = pixels.select(i.alias("i")).schema["i"].dataType
    at = F.struct(i.alias("i"), "r", "g", "b", "a")
    grouped = pixels.groupBy("image_id", C.div(F.col("x"), SIDE).alias("cx"), C.div(F.col("y"), SIDE).alias("cy"))
    zero = [F.lit(0).cast(pixels.schema[c].dataType).alias(c) for c in "rgba"]
    lacking = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(PIXELS - 1).cast("long")), F.transform("px", lambda p: p["i"].cast("long")))
    more = F.concat("px", F.transform(lacking, lambda k: F.struct(k.cast(i_type).alias("i"), *zero)))
    cells = grouped.agg(F.collect_list(at).alias("px"))
    return cells.withColumn("px", F.array_sort(F.when(F.size("px") == PIXELS, F.col("px")).otherwise(more)))


def total(px: Column, field: str, keep=None) -> Column:
    """Sum of a channel over the pixels that keep holds for."""
    some = F.filter(px, keep) if keep is not None else px
    return F.aggregate(some, F.lit(0).cast("long"), lambda acc, p: acc + p[field])


def mean_color(px: Column) -> list[Column]:
    return [C.div(total(px, c), PIXELS) for c in "rgb"]


def masked_means(px: Column, on) -> tuple[list[Column], list[Column]]:
    """Mean colour of pixels inside and outside a mask, truncated; 0 where there are none."""
    n = F.size(F.filter(px, on))
    outside = lambda p: ~on(p)
    inner = [F.when(n > 0, C.div(total(px, c, on), F.greatest(n, F.lit(1)))).otherwise(0) for c in "rgb"]
    outer = [F.when(n < PIXELS, C.div(total(px, c, outside), F.greatest(PIXELS - n, F.lit(1)))).otherwise(0) for c in "rgb"]
    return inner, outer


def spread(px: Column, c: str) -> Column:
    values = F.transform(px, lambda p: p[c])
    return F.array_max(values) - F.array_min(values)


def dominant_channel(px: Column) -> Column:
    """0, 1 or 2: the channel with the widest spread, the first of equals."""
    r, g, b = (spread(px, c) for c in "rgb")
    return F.when((r >= g) & (r >= b), 0).when(g >= b, 1).otherwise(2)


def channel_sorted(px: Column, channel: Column) -> Column:
    """Pixels by one channel, equal ones in row order.  The channel is bound once for the cell."""

    def ordered(cell: Column) -> Column:
        value = lambda p: F.when(cell["ch"] == 0, p["r"]).when(cell["ch"] == 1, p["g"]).otherwise(p["b"])
        return F.array_sort(F.transform(cell["px"], lambda p: F.struct(value(p).alias("v"), *(p[c].alias(c) for c in "irgba"))))

    return F.element_at(F.transform(F.array(F.struct(px.alias("px"), channel.alias("ch"))), ordered), 1)


def median_pixel(px: Column) -> Column:
    """The pixel of rank n / 2 on the dominant channel."""
    return F.element_at(channel_sorted(px, dominant_channel(px)), C.div(F.size(px), 2).cast("int") + 1)


def contrast_pair(px: Column) -> tuple[Column, Column]:
    """Pixels at the first minimum and the last maximum of the dominant channel."""
    ordered = channel_sorted(px, dominant_channel(px))
    return F.element_at(ordered, 1), F.element_at(ordered, -1)


def error_to(p: Column, color: Column) -> Column:
    return C.squared_error((p["r"], p["g"], p["b"]), (color["r"], color["g"], color["b"]))


def halves(bits: Column) -> tuple[Column, Column]:
    """The upper and lower 32 of an array of 64 bits."""
    fold = lambda a: F.aggregate(F.slice(bits, a, 32), F.lit(0).cast("long"), lambda acc, b: acc * 2 + b)
    return fold(1), fold(33)


def color_bitmap(px: Column, bg: Column, fg: Column) -> tuple[Column, Column]:
    """hi, lo of the cell: a bit is set where the pixel is nearer to fg than to bg."""
    return halves(F.transform(px, lambda p: F.when(error_to(p, fg) < error_to(p, bg), 1).otherwise(0)))


def expanded(hi: Column, lo: Column) -> Column:
    """64 numbers 0 or 1."""
    one = lambda half: F.transform(F.reverse(F.sequence(F.lit(0), F.lit(31))), lambda k: C.div(half, F.element_at(_POWERS(), k + 1)) % 2)
    return F.concat(one(hi), one(lo))


def _POWERS() -> Column:
    return F.array(*(F.lit(1 << k).cast("long") for k in range(32)))


def assigned_error(px: Column, hi: Column, lo: Column, bg: Column, fg: Column) -> Column:
    """Squared distance of every pixel to the colour that a bitmap gives it, summed."""
    each = F.zip_with(px, expanded(hi, lo), lambda p, bit: F.when(bit == 1, error_to(p, fg)).otherwise(error_to(p, bg)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda acc, e: acc + e)


def popcount(hi: Column, lo: Column) -> Column:
    return F.bit_count(hi) + F.bit_count(lo)


def hamming(hi: Column, lo: Column, g_hi, g_lo) -> Column:
    return F.bit_count(hi.bitwiseXOR(g_hi)) + F.bit_count(lo.bitwiseXOR(g_lo))
