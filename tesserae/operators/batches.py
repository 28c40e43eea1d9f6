"""Callbacks over rows of images, and glyph import, export and clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C


def process_rows(rows: DataFrame, callback: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A callback on batches of rows, as they lie in partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield callback(batch)

    return rows.mapInPandas(run, schema)


def first_handled(events: DataFrame, handlers: list, name: str = "handled") -> DataFrame:
    """events with the result of the first handler (a column expression, null to pass) that takes each."""
    return events.withColumn(name, F.coalesce(*handlers))


def imported_glyphs(cells: DataFrame, threshold: int = 127) -> DataFrame:
    """cells (code_point, coverage of 64 pixels) as glyph bitmaps."""
    from .cells import halves
    from .resample import sharpened

    hi, lo = halves(F.transform("coverage", lambda v: F.when(v > threshold, 1).otherwise(0)))
    return sharpened(cells, "coverage").select("code_point", hi.alias("hi"), lo.alias("lo"))


def exported_glyphs(glyphs: DataFrame) -> DataFrame:
    """code_point and its 64 pixels as opaque white or clear."""
    from .cells import expanded

    return glyphs.select("code_point", F.transform(expanded(F.col("hi"), F.col("lo")), lambda b: b * 255).alias("coverage"))


def clustered_glyphs(vectors: DataFrame, clusters: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """hi, lo, n: distinct binary glyphs from the centres of clusters of 8 by 8 vectors (column v, 64 numbers)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from .cells import halves

    data = vectors.select(array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=clusters, seed=seed, maxIter=iterations).fit(data)
    sizes = model.transform(data).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    spark = vectors.sparkSession
    centres = spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())], "prediction int, c array<double>")
    hi, lo = halves(F.transform("c", lambda x: F.when(x > 0.5, 1).otherwise(0)))
    return centres.join(sizes, "prediction").select(hi.alias("hi"), lo.alias("lo"), "n").groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def crops(pixels: DataFrame, width: int, height: int, n: int, seed: int = 1, threshold: int = 1020) -> DataFrame:
    """image_id, crop_no, hi, lo: n crops of 8 by 8 an image, at places drawn by a hash, as bits of brightness.

    Each crop takes its own pixels by their place, so an image's pixels are read once.
    """
    from .cells import halves

    draws = pixels.select("image_id").distinct().withColumn("crop_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    spot = lambda k, top: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "image_id", "crop_no"), F.lit(top))
    draws = draws.withColumns({"left": spot(0, width - 7), "top": spot(1, height - 7)})
    inside = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.struct(k.alias("k"), (F.col("left") + k % 8).alias("px"), (F.col("top") + C.div(k, 8)).alias("py")))
    wanted = draws.select(F.col("image_id").alias("c_image"), "crop_no", F.explode(inside).alias("p")).select("c_image", "crop_no", "p.k", "p.px", "p.py")
    bright = F.when(C.intensity(F.col("r"), F.col("g"), F.col("b")) > threshold, 1).otherwise(0)
    hit = pixels.join(wanted, (F.col("image_id") == F.col("c_image")) & (F.col("x") == F.col("px")) & (F.col("y") == F.col("py")))
    bits = hit.groupBy("image_id", "crop_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", bright.alias("v")))), lambda x: x["v"]).alias("bits"))
    hi, lo = halves(F.col("bits"))
    return bits.select("image_id", "crop_no", hi.alias("hi"), lo.alias("lo"))


def bdf_glyphs(glyphs: DataFrame) -> DataFrame:
    """code_point and text, a glyph as an entry of a bitmap font file."""
    row = lambda half, k: F.lpad(F.hex(F.shiftright(half, 24 - 8 * k).bitwiseAND(F.lit(255))), 2, "0")
    rows = [row(F.col(h), k) for h in ("hi", "lo") for k in range(4)]
    c = F.col("code_point")
    head = F.concat_ws("\n", F.concat(F.lit("STARTCHAR U+"), F.when(c > 0xFFFF, F.hex(c)).otherwise(F.lpad(F.hex(c), 4, "0"))), F.concat(F.lit("ENCODING "), c.cast("string")), F.lit("SWIDTH 1000 0"), F.lit("DWIDTH 8 0"), F.lit("BBX 8 8 0 0"), F.lit("BITMAP"))
    return glyphs.select("code_point", F.concat_ws("\n", head, *rows, F.lit("ENDCHAR")).alias("text"))


def font_lines(glyphs: DataFrame, name: str = "tesserae") -> DataFrame:
    """place and line of a whole bitmap font: its head, the glyphs in order of code points, its end."""
    spark = glyphs.sparkSession
    head = ["STARTFONT 2.1", f"FONT {name}", "SIZE 8 75 75", "FONTBOUNDINGBOX 8 8 0 0", f"CHARS {glyphs.count()}"]
    ends = spark.createDataFrame([(-len(head) + k, x) for k, x in enumerate(head)] + [(1 << 40, "ENDFONT")], "place long, line string")
    body = bdf_glyphs(glyphs).select(F.col("code_point").cast("long").alias("place"), F.col("text").alias("line"))
    return ends.unionByName(body).orderBy("place")


def c_table(glyphs: DataFrame, name: str = "glyphs") -> DataFrame:
    """code_point and line, a glyph as an entry of a table in C."""
    return glyphs.select("code_point", F.format_string("{ 0x%x, 0x%08x%08xULL },", F.col("code_point"), F.col("hi"), F.col("lo")).alias("line"))


def svg_glyphs(glyphs: DataFrame) -> DataFrame:
    """code_point and text, a glyph's set pixels as squares of a drawing."""
    from .cells import expanded

    square = lambda b, i: F.when(b == 1, F.concat(F.lit('<rect width="1" height="1" x="'), (i % 8).cast("string"), F.lit('" y="'), C.div(i, 8).cast("string"), F.lit('"/>'))).otherwise("")
    body = F.concat_ws("", F.transform(expanded(F.col("hi"), F.col("lo")), square))
    return glyphs.select("code_point", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 8 8">'), body, F.lit("</svg>")).alias("text"))


def font_of(pixels: DataFrame, width: int, height: int, clusters: int, n: int = 64, first: int = 0xE000) -> DataFrame:
    """code_point, hi, lo: glyphs learned from images, from crops over clusters to code points by popcount."""
    from .cells import expanded

    vectors = crops(pixels, width, height, n).select(expanded(F.col("hi"), F.col("lo")).alias("v"))
    found = clustered_glyphs(vectors, clusters)
    order = Window.orderBy(F.bit_count("hi") + F.bit_count("lo"), "hi", "lo")  # at most `clusters` rows
    return found.select((F.row_number().over(order) - 1 + first).cast("int").alias("code_point"), "hi", "lo")
