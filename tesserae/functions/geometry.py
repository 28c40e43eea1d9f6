"""Sizes and places of images on canvases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import div

ORIGIN = {"start": 0, "center": 1, "end": 2}


def rounded_up(v: Column, m: int) -> Column:
    return v + (m - 1) - (v + (m - 1)) % m


def buffer_size(w: Column, h: Column, channels: Column, most: int) -> Column:
    """Bytes of an image, or null if a side is zero or it is over the limit."""
    wide = lambda c: c.cast("decimal(20,0)")
    size = (wide(w) * wide(h)).cast("decimal(38,0)")
    fits = (w > 0) & (h > 0) & (channels > 0) & (size <= F.lit(most)) & (size * channels <= F.lit(most))
    return F.when(fits, F.when(fits, (size * channels).cast("decimal(38,0)")).cast("long"))


def aligned(src: Column, dest: Column, align: str) -> Column:
    return {"start": F.lit(0), "center": div(dest - src, 2), "end": dest - src}[align].cast("long")


def tucked(src: tuple[Column, Column], dest: tuple[Column, Column], tuck: str, halign: str = "start", valign: str = "start") -> list[Column]:
    """x, y, width and height of an image within a canvas: stretch, fit or shrink (which never enlarges)."""
    if tuck == "stretch":
        w, h = dest
    else:
        across = dest[0] * src[1] <= dest[1] * src[0]  # the width binds
        up = lambda a, b: F.ceil(a / b)
        w = F.when(across, dest[0]).otherwise(F.least(dest[0], up(src[0] * dest[1], src[1])))
        h = F.when(across, F.least(dest[1], up(src[1] * dest[0], src[0]))).otherwise(dest[1])
        if tuck == "shrink":
            inside = (src[0] <= dest[0]) & (src[1] <= dest[1])
            w, h = F.when(inside, src[0]).otherwise(w), F.when(inside, src[1]).otherwise(h)
    w, h = w.cast("long"), h.cast("long")
    return [aligned(w, dest[0], halign), aligned(h, dest[1], valign), w, h]


def canvas_geometry(src: tuple[Column, Column], dest: tuple[Column, Column], font_ratio: float, zoom: bool = False, stretch: bool = False) -> list[Column]:
    """Cells of a canvas for an image; -1 in dest leaves a side open, 0 anywhere gives 0 by 0."""
    sw, sh = src
    dw, dh = dest
    open_w, open_h = dw < 0, dh < 0
    w = dw if zoom else F.when(open_w, dw).otherwise(F.least(dw, sw))
    h = dh if zoom else F.when(open_h, dh).otherwise(F.least(dh, sh))
    ratio = F.lit(float(font_ratio))
    aspect = sw / sh
    by_width, by_height = F.ceil((w / aspect) * ratio), F.ceil(h * (aspect / ratio))
    wide = aspect > (w / h) * ratio
    if stretch:
        fit_w, fit_h = w, h
    else:
        fit_w, fit_h = F.when(wide, w).otherwise(by_height), F.when(wide, F.ceil(w * (ratio / aspect))).otherwise(h)
    out_w = F.when(open_w, by_height).when(open_h, w).otherwise(fit_w)
    out_h = F.when(open_w, h).when(open_h, by_width).otherwise(fit_h)
    bound = lambda v, d: F.when(d > 0, F.least(F.greatest(v, F.lit(1)), d)).otherwise(F.greatest(v, F.lit(1)))
    none = (sw == 0) | (sh == 0) | (dw == 0) | (dh == 0)
    eighth = lambda v: div(v + 7, 8)
    free_w, free_h = F.greatest(eighth(sw), F.lit(1)), F.greatest(F.floor(eighth(sh) * ratio + 0.5), F.lit(1))
    pick = lambda free, v, d: F.when(none, 0).when(open_w & open_h, free).otherwise(bound(v, d)).cast("long")
    return [pick(free_w, out_w, dw), pick(free_h, out_h, dh)]


def cells_of(pixels: Column, cell: int) -> Column:
    """Cells that hold so many pixels, the last one perhaps in part; an open side (-1) stays open."""
    return F.when(pixels < 0, pixels).otherwise(div(pixels + cell - 1, cell))


def cell_dimensions(width: Column, height: Column, scale: Column | float, cell: tuple[int, int]) -> list[Column]:
    """Cells that a scaled image of pixels takes, at least one a side; unknown cells are 10 by 20."""
    cw, ch = cell[0] if cell[0] >= 1 else 10, cell[1] if cell[1] >= 1 else 20
    factor = F.greatest(F.lit(scale) if isinstance(scale, int | float) else scale, F.lit(0.00001))
    return [F.greatest(div(F.floor(v * factor) + c - 1, c), F.lit(1)).cast("long") for v, c in ((width, cw), (height, ch))]


def prescale_size(width: Column, height: Column, view: tuple[int, int], cell: tuple[int, int]) -> list[Column]:
    """Pixels to draw a shape without a size of its own in: the wanted cells (or the view's), at least 160 a side."""
    cw, ch = cell if cell[0] > 0 and cell[1] > 0 else (10, 20)
    return [F.greatest(F.when(v > 0, v).otherwise(w) * c, F.lit(160)).cast("long") for v, w, c in ((width, view[0], cw), (height, view[1], ch))]
