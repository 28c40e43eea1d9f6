"""A canvas from image to text: scaling, preparation, dithering, glyphs and colours, and printing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CROP_PERCENT, DITHER_BASE, CanvasConfig
from ..functions import color as C
from ..plans import glyphs as G
from ..plans.palettes import BG, FG, TRANSPARENT, palette16, palette256
from . import emit
from .cells import PIXELS, cell_blocks, color_bitmap, contrast_pair, total
from .dither import diffusion, grain_diffusion
from .formats import dithered
from .histogram import histogram_bounds, intensity_histogram, normalize
from .nearest import RANKS, best_scored, glyph_candidates, nearest_of, set_places
from .resample import scaled
from .symbols import chosen
from .wide import filled

Glyph = tuple[int, int, int]  # place in the set, upper and lower half of the bitmap


def prepared(pixels: DataFrame, config: CanvasConfig) -> DataFrame:
    """Pixels stretched to their image's bounds where a mode has few colours, and more saturated for 16 and 8."""
    if not config.preprocess or config.mode not in CROP_PERCENT:
        return pixels
    if config.mode in ("16", "16/8", "8"):
        pixels = pixels.withColumns(dict(zip("rgb", C.saturated(*map(F.col, "rgb")), strict=True)))
    return normalize(pixels, histogram_bounds(intensity_histogram(pixels), CROP_PERCENT[config.mode]))


def fixed_palette(config: CanvasConfig) -> list[tuple[int, int, int, int]]:
    if config.mode in ("fgbg", "fgbg_bgfg"):
        return [(pen, v >> 16 & 255, v >> 8 & 255, v & 255) for pen, v in ((FG, config.fg), (BG, config.bg))]
    if config.mode in ("256", "240"):
        return [p for p in palette256() if p[0] >= 16 or config.mode == "256"]
    return palette16()[: 8 if config.mode == "8" else 16]


def with_dither(pixels: DataFrame, config: CanvasConfig) -> DataFrame:
    strength = config.dither_intensity * DITHER_BASE[config.mode]
    if config.dither == "diffusion":
        return grain_diffusion(pixels, fixed_palette(config), config.dither_grain, config.dither_intensity)
    return dithered(pixels, config.dither, strength, config.dither_grain)


def best_by_means(px: Column, hi: Column, lo: Column, glyphs: list[Glyph], k: int | None) -> Column:
    """error * RANKS + place of the glyph that, in the mean colours of its set and clear pixels, is nearest.

    With sums S over n pixels and the truncated mean m, the squares left are Q - 2 m S + n m m,
    so a glyph needs the sums over its set places only.
    """
    table = F.array(*(F.struct(F.lit(int(o)).cast("long").alias("k"), F.lit(len(at)).alias("n"), F.array(*(F.lit(p) for p in at)).cast("array<int>").alias("at")) for o, at in ((o, set_places(h, b)) for o, h, b in glyphs)))
    zero = F.lit(0).cast("long")
    sums = F.struct(*(total(px, c).alias(c) for c in "rgb"))
    squares = F.aggregate(px, zero, lambda acc, p: acc + p["r"] * p["r"] + p["g"] * p["g"] + p["b"] * p["b"])
    near = F.array().cast("array<bigint>") if k is None else F.transform(glyph_candidates(hi, lo, glyphs, k), lambda c: c["ord"])
    empty = F.struct(*(zero.alias(c) for c in "rgb"))

    def found(cell: Column) -> Column:
        def cost(g: Column) -> Column:
            add = lambda acc, p: F.struct(*((acc[c] + F.element_at(cell["px"], p)[c].cast("long")).alias(c) for c in "rgb"))

            def left(s: Column) -> Column:
                out = cell["q"]
                for c in "rgb":
                    for part, n in ((s[c], g["n"]), (cell["s"][c] - s[c], PIXELS - g["n"])):
                        mean = C.div(part, F.greatest(n, F.lit(1)))
                        out = out - 2 * mean * part + n * mean * mean
                return out

            return F.aggregate(g["at"], empty, add, left) * RANKS + g["k"]

        if k is None:
            return F.array_min(F.transform(table, cost))
        return F.array_min(F.transform(cell["near"], lambda o: cost(F.element_at(table, o.cast("int") + 1))))

    bound = F.struct(px.alias("px"), sums.alias("s"), squares.alias("q"), near.alias("near"))
    return F.element_at(F.transform(F.array(bound), found), 1)


def _sum_at(px: Column, places: Column, field: str) -> Column:
    """Sum of a channel over pixels at places from 1."""
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: acc + F.element_at(px, p)[field].cast("long"))


def colors_of(px: Column, bits: Column) -> Column:
    """Struct of the truncated mean colours of set (fg_) and clear (bg_) pixels; bits: set places from 1.
    A side without pixels takes the other's."""
    fields = []
    n = F.size(bits)
    for c in "rgb":
        inner, whole = _sum_at(px, bits, c), total(px, c)
        fg, bg = C.div(inner, F.greatest(n, F.lit(1))), C.div(whole - inner, F.greatest(PIXELS - n, F.lit(1)))
        fields += [F.when(n > 0, fg).otherwise(bg).alias(f"fg_{c}"), F.when(n < PIXELS, bg).otherwise(fg).alias(f"bg_{c}")]
    return F.struct(*fields)


def blank_and_solid(symbols: list[tuple], fill: list[tuple]) -> tuple[int, int]:
    """Code points for an empty and a full cell from (code point, bitmap) of both sets, 0 for no full one.

    A space and U+2588 come first; else the fill glyph nearest by popcount, else the symbol
    nearest by bits, and for a full cell only within 32 of it.
    """
    have = {c for c, _ in symbols + fill}
    pick = lambda rows, target: min(rows, key=lambda g: ((g[1] ^ target).bit_count(), g[0]))
    by_count = lambda n: min(fill, key=lambda g: (abs(g[1].bit_count() - n), g[0]))
    blank = 0x20
    if 0x20 not in have and symbols + fill:
        blank = by_count(0)[0] if fill else pick(symbols, 0)[0]
    solid, full = 0, (1 << 64) - 1
    if 0x2588 in have:
        solid = 0x2588
    elif fill and 64 - by_count(64)[1].bit_count() <= 32:
        solid = by_count(64)[0]
    elif symbols and (pick(symbols, full)[1] ^ full).bit_count() <= 32:
        solid = pick(symbols, full)[0]
    return blank, solid


def pens_of(fg: tuple[Column, Column, Column], bg: tuple[Column, Column, Column], ch: Column, config: CanvasConfig, solid: int) -> list[Column]:
    """ch, fg and bg of a cell in the canvas's mode: colours for truecolor, else pens.

    In 16/8 a pair that is one bright colour can't be a background: the full block stands
    for it if there is one, else the nearest dark pen for both.
    """
    clear = emit.clear_of(config.mode)
    if config.mode == "truecolor":
        as_rgb = lambda c: F.shiftleft(c[0].cast("long"), 16) + F.shiftleft(c[1].cast("long"), 8) + c[2]
        out = [ch, as_rgb(fg), as_rgb(bg)]
    elif config.mode == "16/8":
        f, b, dark, dark_b = nearest_of(fg, "16"), nearest_of(bg, "16"), nearest_of(fg, "8"), nearest_of(bg, "8")
        same = (f == b) & f.between(8, 15)
        if solid:
            out = [F.when(same, F.lit(chr(solid))).otherwise(ch), f, F.when(same, dark).otherwise(dark_b)]
        else:
            out = [ch, F.when(same, dark).otherwise(f), F.when(same, dark).otherwise(dark_b)]
    else:
        out = [ch, *(nearest_of(c, config.mode, config.fg, config.bg) for c in (fg, bg))]
    if config.fg_only:
        out[2] = F.lit(clear).cast("long")
    return out


def canvas_cells(pixels: DataFrame, src: tuple[int, int], config: CanvasConfig, fast: bool = False) -> DataFrame:
    """image_id, cy, cx, ch, fg, bg of images of src pixels (image_id, x, y, r, g, b, a).

    The glyph set, at most some hundred bitmaps, is part of the plan.  With fixed colours a
    glyph's error is against them; else it is against the mean colours that it would get.
    """
    rows = chosen(config.symbols)
    fill_rows = chosen(config.fill) if config.fill else []
    blank, solid = blank_and_solid([(r[1], r[4] << 32 | r[5]) for r in rows], [(r[1], r[4] << 32 | r[5]) for r in fill_rows])
    glyphs = [(k, r[4], r[5]) for k, r in enumerate(rows)]
    chars = F.array(*(F.lit(r[2]) for r in rows))
    moved = with_dither(prepared(scaled(pixels, src, (config.width * 8, config.height * 8), fast), config), config)
    cells = cell_blocks(moved)
    px, key = F.col("px"), ("image_id", "cy", "cx")
    if config.mode in ("fgbg", "fgbg_bgfg"):
        pair = [F.struct(*(F.lit(v >> s & 255).cast("long").alias(c) for c, s in zip("rgb", (16, 8, 0), strict=True))) for v in (config.bg, config.fg)]
        cells = cells.withColumns({"low": pair[0], "high": pair[1]})
        hi, lo = color_bitmap(px, F.col("low"), F.col("high"))
        best = best_scored(px, F.col("low"), F.col("high"), hi, lo, glyphs, config.candidates) % RANKS
        return cells.select(*key, F.element_at(chars, best.cast("int") + 1).alias("ch"), F.lit(FG).cast("long").alias("fg"), F.lit(TRANSPARENT if config.fg_only else BG).cast("long").alias("bg"))
    low, high = contrast_pair(px)
    cells = cells.withColumns({"low": low, "high": high})
    hi, lo = color_bitmap(px, F.col("low"), F.col("high"))
    cells = cells.withColumns({"hi": hi, "lo": lo})
    cells = cells.withColumn("best", (best_by_means(px, F.col("hi"), F.col("lo"), glyphs, config.candidates) % RANKS).cast("int"))
    places = F.array(*(F.array(*(F.lit(p) for p in set_places(h, b))).cast("array<int>") for _, h, b in glyphs))
    cells = cells.withColumn("c", colors_of(px, F.element_at(places, F.col("best") + 1)))
    side = lambda s: tuple(F.col(f"c.{s}_{c}") for c in "rgb")
    ch = F.element_at(chars, F.col("best") + 1)
    if fill_rows:
        counts = [(k, r[6]) for k, r in enumerate(fill_rows)]
        mean = tuple(C.div(total(px, c), PIXELS) for c in "rgb")
        wanted = F.element_at(F.array(*(F.lit(r[2]) for r in fill_rows)), filled(mean, side("bg"), side("fg"), counts).cast("int") + 1)
        ch = F.when(ch == chr(blank), wanted).otherwise(ch)
    shown, fg, bg = pens_of(side("fg"), side("bg"), ch, config, solid)
    return cells.select(*key, shown.alias("ch"), fg.alias("fg"), bg.alias("bg"))


def canvas_rows(pixels: DataFrame, src: tuple[int, int], config: CanvasConfig) -> DataFrame:
    """image_id, cy, line of a canvas in symbols."""
    have = {r[1] for r in chosen(config.symbols)}
    blank = " " if 0x20 in have else emit.FULL if 0x2588 in have else None
    return emit.rows_of(canvas_cells(pixels, src, config), config.mode, FG, blank)


def canvas_text(pixels: DataFrame, src: tuple[int, int], config: CanvasConfig, passthrough: str = "none") -> DataFrame:
    """image_id, text: the canvas as the pixel mode prints it, rows joined by line feeds, none after the last."""
    if config.pixel_mode == "symbols":
        return emit.printed(canvas_rows(pixels, src, config))
    size = (config.width * config.cell_width, config.height * config.cell_height)
    image = scaled(pixels, src, size)
    if config.pixel_mode == "sixels":
        palette = palette256()
        pens = diffusion(image, palette, even_forward=False) if config.dither == "diffusion" else image.withColumn("pen", nearest_of(tuple(map(F.col, "rgb")), "256"))
        text = emit.sixel_text(emit.sixel_rows(pens.where("pen >= 0").select("image_id", "x", "y", "pen")), palette)
        return text.select("image_id", emit.passthrough(F.col("text"), passthrough).alias("text"))
    at = F.struct((F.col("y") * size[0] + F.col("x")).alias("i"), *(F.col(c).cast("int").alias(c) for c in "rgba"))
    pixel = lambda p: F.concat(*(F.lpad(F.hex(p[c]), 2, "0") for c in "rgba"))
    raw = F.unhex(F.concat_ws("", F.transform(F.array_sort(F.collect_list(at)), pixel)))
    images = image.groupBy("image_id").agg(raw.alias("raw"))
    args = (F.col("raw"), *size, config.width, config.height)
    if config.pixel_mode == "iterm2":
        return images.select("image_id", emit.passthrough(emit.iterm2_text(*args), passthrough).alias("text"))
    if passthrough == "none":
        return images.select("image_id", emit.kitty_text(*args).alias("text"))
    return images.select("image_id", emit.kitty_virtual_text(*args, F.col("image_id") + 1, passthrough).alias("text"))
