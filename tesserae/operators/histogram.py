"""Histograms of images and their trimmed bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C

BINS = 2048


def intensity_histogram(pixels: DataFrame) -> DataFrame:
    """image_id, v, n: pixels with alpha above 127 by intensity; partial sums meet by (image, v)."""
    v = C.intensity(F.col("r"), F.col("g"), F.col("b"))
    return pixels.where("a > 127").groupBy("image_id", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))


def histogram_bounds(hist: DataFrame, crop_percent: int, keys: tuple[str, ...] = ("image_id",), bins: int = BINS) -> DataFrame:
    """low and high bin of each image after crop_percent of its pixels are trimmed at either end.

    The scan stops at the first bin where the trimmed count is used up; an image's
    histogram has at most `bins` rows, so the windows stay small.
    """
    total = F.sum("n").over(Window.partitionBy(*keys))
    crop = C.div(total * ((crop_percent * 1024) // 100), 1024)
    up = F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    down = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("v")))
    seen = hist.select(*keys, "v", crop.alias("crop"), up.alias("up"), down.alias("down"))
    low = F.when(F.max("crop") <= 0, F.lit(0)).otherwise(F.min(F.when(F.col("up") >= F.col("crop"), F.col("v"))))
    high = F.when(F.max("crop") <= 0, F.lit(bins - 1)).otherwise(F.max(F.when(F.col("down") >= F.col("crop"), F.col("v"))))
    return seen.groupBy(*keys).agg(low.alias("low"), high.alias("high"))


def normalize(pixels: DataFrame, bounds: DataFrame) -> DataFrame:
    """Channels stretched to their image's bounds; bounds is one row an image."""
    joined = pixels.join(bounds, "image_id")
    return joined.withColumns({c: C.normalized(F.col(c), F.col("low"), F.col("high")) for c in "rgb"}).drop("low", "high")


def small_quantiles(values: DataFrame, key: str, value: str) -> DataFrame:
    """key, q1, q7: first value of -128..127 at which an eighth, or seven eighths, of the rows are reached."""
    counts = values.where(F.col(value).between(-128, 127)).groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(key)
    at = counts.select(key, value, F.sum("n").over(w.orderBy(value)).alias("up"), F.sum("n").over(w).alias("total"))
    reach = lambda k: F.min(F.when(F.col("up") * 8 >= F.col("total") * k, F.col(value)))
    return at.groupBy(key).agg(reach(1).alias("q1"), reach(7).alias("q7"))


def measure_glyphs(glyphs: DataFrame) -> DataFrame:
    """pass_no, advance, ascent, descent: the seventh octile of each measure of a pass's glyphs."""
    out = None
    for name in ("advance", "ascent", "descent"):
        one = small_quantiles(glyphs, "pass_no", name).select("pass_no", F.col("q7").alias(name))
        out = one if out is None else out.join(one, "pass_no", "full")
    return out
