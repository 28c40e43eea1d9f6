"""Nearest palette colours and glyphs.

The lookup side is a fixed table of at most some thousand rows, so it goes into the
plan as a literal array: no join, no shuffle of pairs.  An error and a rank are packed
into one number, so ties go to the lower rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from ..plans.palettes import BG, FG, palette16
from .cells import hamming, popcount

RANKS = 4096


def _literal(rows: list[tuple], names: tuple[str, ...]) -> Column:
    return F.array(*(F.struct(*(F.lit(int(v)).cast("long").alias(n) for n, v in zip(names, row, strict=True))) for row in rows))


def packed_errors(rgb: tuple[Column, Column, Column], palette: list[tuple[int, int, int, int]]) -> Column:
    """error * RANKS + rank for every palette row, in the palette's order."""
    table = _literal([(k, *p[1:]) for k, p in enumerate(palette)], ("k", "r", "g", "b"))
    return F.transform(table, lambda p: C.squared_error(rgb, (p["r"], p["g"], p["b"])) * RANKS + p["k"])


def nearest_pen(rgb: tuple[Column, Column, Column], palette: list[tuple[int, int, int, int]]) -> Column:
    pens = F.array(*(F.lit(p[0]) for p in palette))
    return F.element_at(pens, (F.array_min(packed_errors(rgb, palette)) % RANKS).cast("int") + 1)


def nearest_pens(rgb: tuple[Column, Column, Column], palette: list[tuple[int, int, int, int]], k: int = 2) -> Column:
    """The k nearest as structs of err and pen, nearest first."""
    pens = F.array(*(F.lit(p[0]) for p in palette))
    best = F.slice(F.array_sort(packed_errors(rgb, palette)), 1, k)
    return F.transform(best, lambda x: F.struct(C.div(x, RANKS).alias("err"), F.element_at(pens, (x % RANKS).cast("int") + 1).alias("pen")))


def _packed(rgb: tuple, palette: list[tuple[int, int, int, int]], first: int = 0) -> list[Column]:
    """The same as columns of their own, for a palette of few rows: they stay in compiled code."""
    return [C.squared_error(rgb, tuple(F.lit(int(v)).cast("long") for v in p[1:])) * RANKS + (first + k) for k, p in enumerate(palette)]


def gray_step(rgb: tuple[Column, Column, Column]) -> Column:
    """0 to 23: the nearest gray, the darker one of two as near.  Its error is least where three
    times the gray is nearest to the channels' sum."""
    total = rgb[0] + rgb[1] + rgb[2]
    return F.greatest(F.lit(0), F.least(F.lit(23), C.div(F.greatest(total - 39, F.lit(0)) + 29, 30))).cast("long")


def nearest_gray(rgb: tuple[Column, Column, Column]) -> Column:
    """Pen of the nearest of 24 grays; a true minimum, the lowest pen of equals."""
    return gray_step(rgb) + 232


def packed_cube_and_grays(rgb: tuple[Column, Column, Column]) -> list[Column]:
    """error * RANKS + rank of the nearest of the cube and of the grays, ranked in that order."""
    cube = C.cube_index(*rgb) - 16
    level = lambda n: F.when(n == 0, 0).otherwise(n * 40 + 55)
    near = tuple(level(C.div(cube, d) % 6) for d in (36, 6, 1))
    gray = gray_step(rgb)
    shade = gray * 10 + 8
    return [C.squared_error(rgb, near) * RANKS + cube, C.squared_error(rgb, (shade,) * 3) * RANKS + gray + 216]


def nearest_256(rgb: tuple[Column, Column, Column]) -> Column:
    """The nearest of 256 pens: cube, grays, then the first 16 win ties, by arithmetic."""
    best = F.least(*packed_cube_and_grays(rgb), *_packed(rgb, palette16(), 240)) % RANKS
    return F.when(best < 240, best + 16).otherwise(best - 240)


def nearest_240(rgb: tuple[Column, Column, Column]) -> Column:
    """The nearest of the cube and the grays."""
    return F.least(*packed_cube_and_grays(rgb)) % RANKS + 16


def nearest_of(rgb: tuple[Column, Column, Column], mode: str, fg: int = 0xFFFFFF, bg: int = 0) -> Column:
    """Pen of a colour in a canvas mode: 256, 240, 16, 8, or the pens of foreground and background."""
    if mode == "256":
        return nearest_256(rgb)
    if mode == "240":
        return nearest_240(rgb)
    if mode in ("fgbg", "fgbg_bgfg"):
        pens = [(pen, v >> 16 & 255, v >> 8 & 255, v & 255) for pen, v in ((FG, fg), (BG, bg))]
    else:
        pens = palette16()[: 16 if mode.startswith("16") else 8]
    best = F.least(*_packed(rgb, pens)) % RANKS
    return F.element_at(F.array(*(F.lit(p[0]) for p in pens)), best.cast("int") + 1).cast("long")


def with_nearest(pixels: DataFrame, palette: list[tuple[int, int, int, int]], name: str = "pen") -> DataFrame:
    """pixels with the nearest pen of any palette of up to 256 colours, pixel by pixel; null
    channels give a null pen.  No pixel leaves its partition."""
    return pixels.withColumn(name, nearest_pen((F.col("r"), F.col("g"), F.col("b")), palette))


def glyph_candidates(hi: Column, lo: Column, glyphs: list[tuple[int, int, int]], k: int = 8, inverse: bool = False) -> Column:
    """The k nearest of (ord, hi, lo) by Hamming distance: structs of dist, ord and inverted.

    With inverse, a glyph also stands for its complement, at 64 minus the distance; the
    plain form wins a tie.
    """
    table = _literal([(o, h, w) for o, h, w in glyphs], ("k", "hi", "lo"))

    def found(cell: Column) -> Column:
        dist = lambda g: hamming(cell["hi"], cell["lo"], g["hi"], g["lo"]).cast("long")
        plain = lambda g: dist(g) * RANKS * 2 + g["k"]
        turned = lambda g: F.least(plain(g), (64 - dist(g)) * RANKS * 2 + RANKS + g["k"])
        best = F.slice(F.array_sort(F.transform(table, turned if inverse else plain)), 1, k)
        return F.transform(best, lambda x: F.struct(C.div(x, RANKS * 2).alias("dist"), (x % RANKS).alias("ord"), (C.div(x, RANKS) % 2 == 1).alias("inverted")))

    # Bound once as an element, so that a long expression for the bitmap isn't evaluated for every glyph.
    return F.element_at(F.transform(F.array(F.struct(hi.alias("hi"), lo.alias("lo"))), found), 1)


def wide_candidates(halves: tuple[Column, Column, Column, Column], glyphs: list[tuple[int, int, int, int, int]], k: int = 8) -> Column:
    """The same over 128 bits: (ord, hi, lo, hi1, lo1)."""
    table = _literal(glyphs, ("k", "hi", "lo", "hi1", "lo1"))

    def found(cell: Column) -> Column:
        dist = lambda g: (hamming(cell["hi"], cell["lo"], g["hi"], g["lo"]) + hamming(cell["hi1"], cell["lo1"], g["hi1"], g["lo1"])).cast("long")
        best = F.slice(F.array_sort(F.transform(table, lambda g: dist(g) * RANKS + g["k"])), 1, k)
        return F.transform(best, lambda x: F.struct(C.div(x, RANKS).alias("dist"), (x % RANKS).alias("ord")))

    cell = F.struct(*(h.alias(n) for h, n in zip(halves, ("hi", "lo", "hi1", "lo1"), strict=True)))
    return F.element_at(F.transform(F.array(cell), found), 1)


def fill_glyph(hi: Column, lo: Column, glyphs: list[tuple[int, int]]) -> Column:
    """ord of the glyph (ord, popcount) whose popcount is nearest, from a table of 65 entries."""
    dense = [min(glyphs, key=lambda g: (abs(g[1] - n), g[0]))[0] for n in range(65)]
    return F.element_at(F.array(*(F.lit(o) for o in dense)), (popcount(hi, lo) + 1).cast("int"))


def set_places(hi: int, lo: int) -> list[int]:
    """Places from 1 of the set bits of a bitmap, row by row."""
    return [k + 1 for k in range(64) if (hi << 32 | lo) >> (63 - k) & 1]


def best_symbol(px: Column, bg: Column, fg: Column, hi: Column, lo: Column, glyphs: list[tuple[int, int, int]], k: int | None = 8) -> Column:
    """ord of the glyph with the least colour error: of the k nearest bitmaps, or (None) of all.

    What every pixel gains by the foreground is bound once; a glyph's cost is the sum over its
    own set places, which are part of the plan.
    """
    return best_scored(px, bg, fg, hi, lo, glyphs, k) % RANKS


def best_scored(px: Column, bg: Column, fg: Column, hi: Column, lo: Column, glyphs: list[tuple[int, int, int]], k: int | None = 8) -> Column:
    """error * RANKS + ord of that glyph."""
    from .cells import error_to

    table = F.array(*(F.struct(F.lit(int(o)).cast("long").alias("k"), F.array(*(F.lit(p) for p in set_places(h, b))).cast("array<int>").alias("at")) for o, h, b in glyphs))
    gain = F.transform(px, lambda p: error_to(p, fg) - error_to(p, bg))
    base = F.aggregate(px, F.lit(0).cast("long"), lambda acc, p: acc + error_to(p, bg))
    near = F.array().cast("array<bigint>") if k is None else F.transform(glyph_candidates(hi, lo, glyphs, k), lambda c: c["ord"])
    zero = F.lit(0).cast("long")

    def found(cell: Column) -> Column:
        cost = lambda g: (cell["base"] + F.aggregate(g["at"], zero, lambda acc, p: acc + F.element_at(cell["gain"], p))) * RANKS + g["k"]
        if k is None:
            return F.array_min(F.transform(table, cost))
        return F.array_min(F.transform(cell["near"], lambda o: cost(F.element_at(table, o.cast("int") + 1))))  # ord is the place in the table

    return F.element_at(F.transform(F.array(F.struct(gain.alias("gain"), base.alias("base"), near.alias("near"))), found), 1)


def best_wide_symbol(left: Column, right: Column, bg: Column, fg: Column, bits: tuple[Column, Column, Column, Column], glyphs: list[tuple[int, int, int, int, int]], k: int | None = 8) -> Column:
    """The same over a pair of cells with one pair of colours: glyphs are (ord, hi, lo, hi1, lo1).

    The right cell's pixels stand behind the left one's.
    """
    from .cells import error_to

    px = F.concat(left, right)
    table = F.array(*(F.struct(F.lit(int(o)).cast("long").alias("k"), F.array(*(F.lit(p) for p in set_places(h, b) + [q + 64 for q in set_places(h1, b1)])).cast("array<int>").alias("at")) for o, h, b, h1, b1 in glyphs))
    gain = F.transform(px, lambda p: error_to(p, fg) - error_to(p, bg))
    base = F.aggregate(px, F.lit(0).cast("long"), lambda acc, p: acc + error_to(p, bg))
    near = F.array().cast("array<bigint>") if k is None else F.transform(wide_candidates(bits, glyphs, k), lambda c: c["ord"])
    zero = F.lit(0).cast("long")

    def found(cell: Column) -> Column:
        cost = lambda g: (cell["base"] + F.aggregate(g["at"], zero, lambda acc, p: acc + F.element_at(cell["gain"], p))) * RANKS + g["k"]
        if k is None:
            return F.array_min(F.transform(table, cost))
        return F.array_min(F.transform(cell["near"], lambda o: cost(F.element_at(table, o.cast("int") + 1))))

    return F.element_at(F.transform(F.array(F.struct(gain.alias("gain"), base.alias("base"), near.alias("near"))), found), 1)
