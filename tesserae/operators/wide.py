"""Wide glyphs over two cells, and fills between two colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from .nearest import RANKS

def pair_errors(cells: DataFrame) -> DataFrame:
    """cells with pair_err: what a wide glyph costs over a cell and the one before it, null in the first column.

    cells: image_id, cy, cx, wide_left_err and wide_right_err, a cell's error as either half.
    """
    w = Window.partitionBy("image_id", "cy").orderBy("cx")
    return cells.withColumn("pair_err", F.lag("wide_left_err").over(w) + F.col("wide_right_err"))


def wide_lookback(cells: DataFrame) -> DataFrame:
    """image_id, cy, cx, kind (narrow, left or right): cells from left to right, where a wide glyph takes the
    place of two if its error is lower and the left one isn't already a right half.

    cells: image_id, cy, cx, err, pair_err.  Whether a pair is taken depends on the pair before it
    alone: of a run of cheaper pairs the first, third and so on are taken.  So a cell's
    place in its run decides, and no row of a canvas is folded.
    """
    w = Window.partitionBy("image_id", "cy").orderBy("cx")
    cheap = F.coalesce(F.col("pair_err") < F.lag("err").over(w) + F.col("err"), F.lit(False))
    runs = cells.select("image_id", "cy", F.col("cx").cast("long").alias("cx"), cheap.alias("cheap"))
    # Cells that start no pair end a run; a run's first cheap cell is its number 1.
    marked = runs.withColumn("run", F.sum(F.when(F.col("cheap"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("image_id", "cy", "run").orderBy("cx")
    numbered = marked.withColumn("right", F.col("cheap") & (F.sum(F.when(F.col("cheap"), 1).otherwise(0)).over(in_run) % 2 == 1))
    left = F.coalesce(F.lead("right").over(w), F.lit(False))
    kind = F.when(F.col("right"), "right").when(left, "left").otherwise("narrow")
    return numbered.select("image_id", "cy", "cx", kind.alias("kind"))


def fill_step(mean: tuple[Column, Column, Column], bg: tuple, fg: tuple) -> Column:
    """0 to 64: how much foreground, in 64ths, comes nearest to a mean colour; the least of equals."""
    ramp = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda n: C.squared_error(mean, tuple(C.div(b * (64 - n) + f * n, 64) for b, f in zip(bg, fg, strict=True))) * RANKS + n)
    return F.array_min(ramp) % RANKS


def filled(mean: tuple[Column, Column, Column], bg: tuple, fg: tuple, glyphs: list[tuple[int, int]]) -> Column:
    """ord of the glyph (ord, popcount) whose share of set pixels is nearest to the fill."""
    dense = [min(glyphs, key=lambda g: (abs(g[1] - n), g[0]))[0] for n in range(65)]
    return F.element_at(F.array(*(F.lit(o) for o in dense)), (fill_step(mean, bg, fg) + 1).cast("int"))
