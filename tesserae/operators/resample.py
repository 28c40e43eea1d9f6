"""Resampling of images: sharpening, scaling and rotation, as joins of grids and taps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color as C

BOX_FROM, BOX128_FROM = 14, 255


def filter_for(src: int, dest: int) -> str:
    """The scaler for one side: one, copy, box128, box, or bilinear with up to three halvings."""
    if src == 1:
        return "one"
    if src == dest:
        return "copy"
    ratio = src / dest
    if ratio > BOX128_FROM:
        return "box128"
    if ratio >= BOX_FROM:
        return "box"
    halvings = 3 if ratio > 8 else 2 if ratio > 4 else 1 if ratio > 2 else 0
    return f"bilinear{halvings}"


def scaled_nearest(pixels: DataFrame, src: tuple[int, int], dest: tuple[int, int]) -> DataFrame:
    """Each output pixel takes the source pixel under its place; only wanted source pixels are kept before the spread."""
    out = pixels
    for axis, s, d in (("x", src[0], dest[0]), ("y", src[1], dest[1])):
        first = C.div(F.col(axis) * d + s - 1, s)
        last = C.div((F.col(axis) + 1) * d + s - 1, s) - 1
        out = out.where(first <= last).withColumn(axis, F.explode(F.sequence(first, last)))
    return out


def box_taps(src: int, dest: int) -> list[tuple[int, int, int]]:
    """(source, output, weight): the overlap of source and output spans, in units of 1 / (src * dest)."""
    out = []
    for o in range(dest):
        low, high = o * src, (o + 1) * src
        for s in range(low // dest, -(-high // dest)):
            w = min(high, (s + 1) * dest) - max(low, s * dest)
            if w > 0:
                out.append((s, o, w))
    return out


def bilinear_taps(src: int, dest: int) -> list[tuple[int, int, int]]:
    """(source, output, weight of 256): the two source centres around an output centre, halved
    outputs averaged."""
    kind = filter_for(src, dest)
    fine = dest << int(kind[-1]) if kind.startswith("bilinear") else dest
    weights: dict[tuple[int, int], int] = {}
    share = 256 // (fine // dest)
    for o in range(fine):
        at = max(0, min((src - 1) * 256, ((2 * o + 1) * src * 256 // fine - 256) // 2))
        s, f = divmod(at, 256)
        for k, w in ((s, 256 - f), (min(s + 1, src - 1), f)):
            if w:
                weights[k, o * dest // fine] = weights.get((k, o * dest // fine), 0) + w * share
    return [(s, o, w) for (s, o), w in sorted(weights.items())]


def _axis(pixels: DataFrame, axis: str, taps: list[tuple[int, int, int]]) -> DataFrame:
    """One axis through its taps: the tap table has a few rows an output place and is part of the plan."""
    by_source: dict[int, list] = {}
    for s, o, w in taps:
        by_source.setdefault(s, []).append((o, w))
    sides = max(by_source) + 1
    table = F.array(*(F.array(*(F.struct(F.lit(o).alias("o"), F.lit(w).alias("w")) for o, w in by_source.get(s, []))) if s in by_source else F.array().cast("array<struct<o:int,w:int>>") for s in range(sides)))
    other, channels = "y" if axis == "x" else "x", [c for c in "rgba" if c in pixels.columns]
    spread = pixels.where(F.col(axis) < sides).select("image_id", other, *channels, F.explode(F.element_at(table, F.col(axis).cast("int") + 1)).alias("t"))
    return spread.groupBy("image_id", other, F.col("t.o").cast("long").alias(axis)).agg(*(C.div(F.sum(F.col(c) * F.col("t.w")), F.sum("t.w")).alias(c) for c in channels))


def scaled_box(pixels: DataFrame, src: tuple[int, int], dest: tuple[int, int]) -> DataFrame:
    """Area average, by columns then by rows, truncated after each."""
    return _axis(_axis(pixels, "x", box_taps(src[0], dest[0])), "y", box_taps(src[1], dest[1]))


def scaled_bilinear(pixels: DataFrame, src: tuple[int, int], dest: tuple[int, int]) -> DataFrame:
    return _axis(_axis(pixels, "x", bilinear_taps(src[0], dest[0])), "y", bilinear_taps(src[1], dest[1]))


def scaled(pixels: DataFrame, src: tuple[int, int], dest: tuple[int, int], fast: bool = False) -> DataFrame:
    """The filter that the ratio of sizes asks for; fast samples instead, and a side of one pixel is copied."""
    columns = ["image_id", "x", "y", *(c for c in "rgba" if c in pixels.columns)]
    if src == dest:
        return pixels.select(*columns)
    if fast or src == (1, 1):
        return scaled_nearest(pixels, src, dest).select(*columns)
    taps = [box_taps(s, d) if filter_for(s, d).startswith(("box", "one", "copy")) else bilinear_taps(s, d) for s, d in zip(src, dest, strict=True)]
    return _axis(_axis(pixels, "x", taps[0]), "y", taps[1])


def sharpened(cells: DataFrame, column: str = "intensity") -> DataFrame:
    """3 by 3 kernel of 6 amid minus ones at the four sides, borders repeated, on arrays of 64."""
    at = lambda y, x: F.element_at(column, (F.greatest(F.lit(0), F.least(F.lit(7), y)) * 8 + F.greatest(F.lit(0), F.least(F.lit(7), x))).cast("int") + 1)

    def one(i):
        y, x = C.div(i, 8), i % 8
        around = sum((at(y + dy, x + dx) for dy, dx in ((-1, 0), (0, -1), (0, 1), (1, 0))), F.lit(0))
        return C.clamp(6 * at(y, x) - around)

    return cells.withColumn(column, F.transform(F.sequence(F.lit(0), F.lit(63)), one))


def rotated(pixels: DataFrame, width: int, height: int, orientation: int) -> DataFrame:
    """The eight EXIF orientations, 1 (none) to 8."""
    x, y = F.col("x"), F.col("y")
    right, down = F.lit(width - 1) - x, F.lit(height - 1) - y
    nx, ny = {1: (x, y), 2: (right, y), 3: (right, down), 4: (x, down), 5: (y, x), 6: (down, x), 7: (down, right), 8: (y, right)}[orientation]
    return pixels.withColumns({"x": nx, "y": ny})
