"""Grids of images, labels, ordered output, playback times and exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.text import ellipsized, flattened


def grid_lines(lines: DataFrame, columns: int, tile_width: int, label: Column | None = None) -> DataFrame:
    """grid_row, row_no, line: items side by side, `columns` to a grid row.

    lines: item_no, row_no, line (and what label needs).  Lines are padded to the tile, and a
    label stands below the last line.
    """
    if label is not None:
        last = lines.groupBy("item_no").agg((F.max("row_no") + 1).alias("row_no"), F.first(label).alias("line"))
        lines = lines.select("item_no", "row_no", "line").unionByName(last)
    at = F.struct((F.col("item_no") % columns).alias("c"), F.rpad("line", tile_width, " ").alias("t"))
    grouped = lines.groupBy(C.div(F.col("item_no"), columns).alias("grid_row"), "row_no")
    return grouped.agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(at)), lambda x: x["t"])).alias("line"))


def square_grid(n: Column, columns: Column, rows: Column) -> list[Column]:
    """Columns and rows for n items; a side that is null follows from the other, both make a square."""
    side = F.ceil(F.sqrt(n))
    c = F.coalesce(columns, F.when(rows.isNotNull(), F.ceil(n / rows)).otherwise(side))
    return [c.cast("long"), F.coalesce(rows, F.ceil(n / c)).cast("long")]


def label_text(path: Column, width: int, align: str = "center", link: bool = False) -> Column:
    """The last part of a path, cleaned, cut and aligned to a width; with link, hyperlinked."""
    name = ellipsized(flattened(F.regexp_extract(path, "([^/]*)/*$", 1)), width - 1)
    n = F.char_length(name)
    left = {"start": F.lit(0), "end": F.greatest(width - n, F.lit(0)), "center": C.div(F.greatest(width - n, F.lit(0)), 2)}[align]
    shown = F.concat(F.lit("\x1b]8;;"), path, F.lit("\x1b\\"), name, F.lit("\x1b]8;;\x1b\\")) if link else name
    blank = lambda k: F.repeat(F.lit(" "), k.cast("int"))
    return F.concat(blank(left), shown, blank(F.greatest(width - n - left, F.lit(0))))


def in_order(items: DataFrame) -> DataFrame:
    """Results in the order of their input, whatever order they were made in."""
    return items.orderBy("src_no", "item_no")


def presentation_times(frames: DataFrame, speed: float = 1.0, fps: float | None = None, duration: float | None = None) -> DataFrame:
    """frames (image_id, frame_no, delay_ms) with start_ms, when each is shown; those after the duration go."""
    delay = F.lit(1000.0 / fps) if fps else F.col("delay_ms")
    w = Window.partitionBy("image_id").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    timed = frames.withColumn("start_ms", F.coalesce(F.sum(delay / speed).over(w), F.lit(0.0)))
    return timed if duration is None else timed.where(F.col("start_ms") < duration * 1000)


def exit_code(results: DataFrame) -> DataFrame:
    """code: 2 if all items failed (or there are none), 1 if some did, 0 otherwise."""
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("ok"))
    return results.agg(F.when(n == bad, 2).when(bad > 0, 1).otherwise(0).alias("code"))


def edited(cells: DataFrame, edits: DataFrame) -> DataFrame:
    """cells (image_id, cx, cy, ch, width) after point writes (image_id, cx, cy, ch, width).

    Writing a wide character empties the cell to its right; writing over half of one turns
    its other half into a space.
    """
    key = ["image_id", "cx", "cy"]
    e = edits.select(*key, F.col("ch").alias("new_ch"), F.col("width").alias("new_width"))
    w = Window.partitionBy("image_id", "cy").orderBy("cx")
    joined = cells.join(e, key, "left")
    under = F.lag(F.coalesce("new_width", F.lit(0))).over(w) == 2
    torn_left = (F.col("width") == 0) & F.lag("new_ch").over(w).isNotNull() & ~under
    torn_right = (F.col("width") == 2) & F.lead("new_ch").over(w).isNotNull()
    own = F.col("new_ch").isNotNull()
    ch = F.when(own, F.col("new_ch")).when(under, "").when(torn_left | torn_right, " ").otherwise(F.col("ch"))
    width = F.when(own, F.col("new_width")).when(under, 0).when(torn_left | torn_right, 1).otherwise(F.col("width"))
    return joined.select(*key, ch.alias("ch"), width.alias("width"))
