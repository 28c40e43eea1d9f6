"""Queries over the operators, on views of the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import geometry as G
from .functions import text as T
from .operators import batches, cells, dither, emit, grid, histogram, nearest, quantize, resample, symbols, terminal, wide
from .plans import glyphs, palettes
from .plans.views import EVENT_PIXELS_SQL as EP
from .plans.views import FULL_PIXELS_SQL as FP
from .plans.views import VEC_BITS_SQL as VB
from .plans.views import VEC_CELLS_SQL as VC
from .plans.views import event_pixels, padded, table, vec_cells
from .sources import decoders, paths

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
BRAILLE = [(o, h, w) for o, _, h, w, _ in glyphs.braille_rows()]
BRAILLE_COUNTS = [(o, n) for o, _, _, _, n in glyphs.braille_rows()]


def rgb() -> tuple:
    return tuple(map(F.col, "rgb"))


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


def palette_sql(palette) -> str:
    return f"(VALUES {values([(k, *p) for k, p in enumerate(palette)])}) pal(k, pen, pr, pg, pb)"


KEY = ("image_id", "x", "y")
IDS = "image_id, x, y"


# --- pixels -----------------------------------------------------------------------------------


@query(f"SELECT {IDS}, (a::BIGINT << 24) | (r << 16) | (g << 8) | b AS packed, r AS r2, g AS g2, b AS b2, a::BIGINT AS a2 FROM {EP} p")
def pack_roundtrip(spark, d):
    p = event_pixels(spark, d).withColumn("packed", C.pack(*rgb(), F.col("a")))
    return p.select(*KEY, "packed", *(C.channel(F.col("packed"), s).alias(n) for s, n in ((16, "r2"), (8, "g2"), (0, "b2"), (24, "a2"))))


@query(f"SELECT {IDS}, 3 * r + 4 * g + b AS v, r // 2 + g // 2 AS mean_rg, (r - g) * (r - g) + (g - b) * (g - b) + (b - r) * (b - r) AS diff, CASE WHEN a < 128 THEN 0 ELSE 255 END AS opaque FROM {EP} p")
def intensity(spark, d):
    p = event_pixels(spark, d)
    r, g, b = rgb()
    return p.select(*KEY, C.intensity(r, g, b).alias("v"), C.average(r, g).alias("mean_rg"), C.squared_error((r, g, b), (g, b, r)).alias("diff"), C.opaque(F.col("a"), 128).alias("opaque"))


@query(f"""SELECT {IDS}, {", ".join(f"CAST(floor(greatest(0.0, least(255.0, p + ({c} - p) * 2.0))) AS BIGINT) AS {c}" for c in "rgb")}
FROM (SELECT *, sqrt(r * r * 0.299::DOUBLE + g * g * 0.587::DOUBLE + b * b * 0.144::DOUBLE) AS p FROM {EP} q) z""")
def saturation_boost(spark, d):
    p = event_pixels(spark, d)
    return p.select(*KEY, *(v.alias(c) for v, c in zip(C.saturated(*rgb()), "rgb", strict=True)))


HIST = f"(SELECT image_id, 3 * r + 4 * g + b AS v, count(*) AS n FROM {EP} p WHERE a > 127 GROUP BY 1, 2)"
BOUNDS = f"""(SELECT image_id, min(CASE WHEN up >= crop THEN v END) AS low, max(CASE WHEN down >= crop THEN v END) AS high FROM (
  SELECT image_id, v, (sum(n) OVER (PARTITION BY image_id) * 51)::BIGINT // 1024 AS crop, sum(n) OVER (PARTITION BY image_id ORDER BY v) AS up,
    sum(n) OVER (PARTITION BY image_id ORDER BY v DESC) AS down FROM {HIST} h) GROUP BY image_id)"""


@query(f"SELECT * FROM {HIST} h")
def hist_intensity(spark, d):
    return histogram.intensity_histogram(event_pixels(spark, d))


@query(f"SELECT * FROM {BOUNDS} h")
def hist_bounds(spark, d):
    return histogram.histogram_bounds(histogram.intensity_histogram(event_pixels(spark, d)), 5)


_MOVED = "({c} - low // 8) * (8384512 // greatest(high - low, 1))"


@query(f"SELECT {IDS}, {', '.join(f'CASE WHEN low = high THEN {c} ELSE greatest(0, least(255, {_MOVED.format(c=c)} // 4096)) END AS {c}' for c in 'rgb')} FROM {EP} p JOIN {BOUNDS} h USING (image_id)")
def normalize(spark, d):
    p = event_pixels(spark, d)
    bounds = histogram.histogram_bounds(histogram.intensity_histogram(p), 5)
    return histogram.normalize(p, bounds).select(*KEY, *"rgb")


@query("""SELECT n::BIGINT AS n, x, y, CASE WHEN v < 0 THEN -CAST(floor(-v) AS BIGINT) ELSE CAST(floor(v) AS BIGINT) END AS value FROM (
SELECT n, x, y, (rank - n * n / 2.0) * (256.0 / (n * n)) + 0.5 AS v FROM (
SELECT n, x, y, sum(CASE WHEN n > h THEN ((CASE WHEN x // h % 2 = 1 AND y // h % 2 = 1 THEN 1 WHEN x // h % 2 = 1 THEN 2 WHEN y // h % 2 = 1 THEN 3 ELSE 0 END) * ((n // 2 // h) * (n // 2 // h))) ELSE 0 END) AS rank
FROM (VALUES (2), (4), (8), (16)) s(n), range(16) a(x), range(16) b(y), (VALUES (1), (2), (4), (8)) t(h) WHERE x < n AND y < n GROUP BY n, x, y))""")
def bayer_tables(spark, d):
    rows = [(n, k % n, k // n, v) for n in (2, 4, 8, 16) for k, v in enumerate(dither.bayer(n))]
    return spark.createDataFrame(rows, "n long, x long, y long, value long")


@query(f"SELECT {IDS}, {', '.join(f'greatest(0, least(255, {c} + t.v)) AS {c}' for c in 'rgb')} FROM {EP} p JOIN (VALUES {values(list(enumerate(dither.bayer(8, 0.5))))}) t(k, v) ON t.k = y // 2 % 8 * 8 + x // 2 % 8")
def ordered_dither(spark, d):
    return dither.ordered(event_pixels(spark, d), 0.5, (2, 2), 8).select(*KEY, *"rgb")


_NOISE = """(SELECT k, CAST(trunc(((h2 >> 24) - 128) * 0.25) AS BIGINT) AS v FROM (SELECT k, (xor(h, h >> 15) * 2246822519::HUGEINT % 4294967296)::BIGINT AS h2 FROM (SELECT k, (k * 2654435761) % 4294967296 AS h FROM range(12288) t(k))))"""


@query(f"SELECT {IDS}, {', '.join(f'greatest(0, least(255, {c} + n{k}.v)) AS {c}' for k, c in enumerate('rgb'))} FROM {EP} p " + " ".join(f"JOIN {_NOISE} n{k} ON n{k}.k = (y % 64 * 64 + x % 64) * 3 + {k}" for k in range(3)))
def noise_dither(spark, d):
    return dither.noisy(event_pixels(spark, d), 0.25).select(*KEY, *"rgb")


@query(f"""SELECT {IDS}, pr, CASE WHEN al = 0 THEN 0 ELSE least(255, (pr * 255 + al // 2) // al) END AS ur, (r * ((al * 128) >> 8) + 40 * (255 - ((al * 128) >> 8)) + 127) // 255 AS mixed,
CASE WHEN abs(g - b) < 60 AND g <= b THEN greatest(b - 60, 0) WHEN abs(g - b) < 60 THEN least(b + 60, 255) ELSE g END AS pushed
FROM (SELECT *, (r + g) % 256 AS al, (r * ((r + g) % 256) + r + (r + g) % 256) >> 8 AS pr FROM {EP} p) z""")
def alpha_math(spark, d):
    p = event_pixels(spark, d).withColumn("al", (F.col("r") + F.col("g")) % 256)
    p = p.withColumn("pr", C.premultiplied(F.col("r"), F.col("al")))
    mixed = C.over(F.col("r"), F.col("al"), F.lit(40), 128)
    return p.select(*KEY, "pr", C.unpremultiplied(F.col("pr"), F.col("al")).cast("long").alias("ur"), mixed.alias("mixed"), C.differentiated(F.col("g"), F.col("b"), 60).alias("pushed"))


@query(f"SELECT image_id, o, x, y, r FROM (SELECT image_id, 1 AS o, x, y, r FROM {FP} p " + " ".join(f"UNION ALL SELECT image_id, {o}, {x}, {y}, r FROM {FP} p" for o, x, y in ((2, "63 - x", "y"), (3, "63 - x", "63 - y"), (4, "x", "63 - y"), (5, "y", "x"), (6, "63 - y", "x"), (7, "63 - y", "63 - x"), (8, "y", "63 - x"))) + ") z")
def rotate(spark, d):
    p = padded(event_pixels(spark, d))
    out = [resample.rotated(p, 64, 64, o).select("image_id", F.lit(o).alias("o"), "x", "y", "r") for o in range(1, 9)]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


_LIN = "floor(CASE WHEN v / 255.0::DOUBLE <= 0.04045 THEN v / 255.0::DOUBLE / 12.92 ELSE pow((v / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * 2047 + 0.5)::BIGINT"


@query(f"SELECT v, {_LIN} AS linear FROM range(256) t(v)")
def linear_light(spark, d):
    return spark.range(256).select(F.col("id").alias("v"), C.linear_light(F.col("id")).alias("linear"))


@query()
def din99d(spark, d):
    return event_pixels(spark, d).select(*KEY, *(v.alias(n) for v, n in zip(C.din99d(*rgb()), ("l", "u", "v"), strict=True)))


_W, _H, _DW, _DH = "p_partkey % 640 + 1", "p_size * 7 % 480 + 1", "p_partkey % 79 + 1", "p_size % 23 + 1"
_FIT_W = "CASE WHEN dw * h <= dh * w THEN dw ELSE least(dw, CAST(ceil((w * dh) / h::DOUBLE) AS BIGINT)) END"
_FIT_H = "CASE WHEN dw * h <= dh * w THEN least(dh, CAST(ceil((h * dw) / w::DOUBLE) AS BIGINT)) ELSE dh END"
_PART = f"(SELECT p_partkey AS k, ({_W})::BIGINT AS w, ({_H})::BIGINT AS h, ({_DW})::BIGINT AS dw, ({_DH})::BIGINT AS dh FROM part)"


def sizes(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), *(F.expr(e).cast("long").alias(n) for e, n in ((_W, "w"), (_H, "h"), (_DW, "dw"), (_DH, "dh"))))


@query(f"""SELECT k, fw, fh, (dw - fw) // 2 AS fx, dh - fh AS fy, CASE WHEN w <= dw AND h <= dh THEN w ELSE fw END AS sw, CASE WHEN w <= dw AND h <= dh THEN h ELSE fh END AS sh,
(w + 7) - (w + 7) % 8 AS up8, (w + 7) // 8 AS cw FROM (SELECT *, {_FIT_W} AS fw, {_FIT_H} AS fh FROM {_PART} z) q""")
def tuck_fit(spark, d):
    s, dest = (F.col("w"), F.col("h")), (F.col("dw"), F.col("dh"))
    x, y, w, h = G.tucked(s, dest, "fit", "center", "end")
    _, _, sw, sh = G.tucked(s, dest, "shrink")
    return sizes(spark, d).select("k", w.alias("fw"), h.alias("fh"), x.alias("fx"), y.alias("fy"), sw.alias("sw"), sh.alias("sh"), G.rounded_up(F.col("w"), 8).alias("up8"), G.cells_of(F.col("w"), 8).alias("cw"))


@query(f"""SELECT k, CASE WHEN k % 7 = 0 THEN greatest((w + 7) // 8, 1) WHEN k % 7 = 1 THEN greatest(CAST(ceil(least(dh, h) * (w / h::DOUBLE / 0.5)) AS BIGINT), 1) ELSE greatest(least(CASE WHEN asp > (least(dw, w) / least(dh, h)::DOUBLE) * 0.5 THEN least(dw, w) ELSE CAST(ceil(least(dh, h) * (asp / 0.5)) AS BIGINT) END, dw), 1) END AS cw,
CASE WHEN k % 7 = 0 THEN greatest(CAST(floor(((h + 7) // 8) * 0.5 + 0.5) AS BIGINT), 1) WHEN k % 7 = 1 THEN greatest(least(dh, h), 1) ELSE greatest(least(CASE WHEN asp > (least(dw, w) / least(dh, h)::DOUBLE) * 0.5 THEN CAST(ceil(least(dw, w) * (0.5 / asp)) AS BIGINT) ELSE least(dh, h) END, dh), 1) END AS ch
FROM (SELECT *, w / h::DOUBLE AS asp FROM {_PART} z) q""")
def canvas_geometry(spark, d):
    dw = F.when(F.col("k") % 7 < 2, -1).otherwise(F.col("dw"))
    dh = F.when(F.col("k") % 7 == 0, -1).otherwise(F.col("dh"))
    w, h = G.canvas_geometry((F.col("w"), F.col("h")), (dw, dh), 0.5)
    return sizes(spark, d).select("k", w.alias("cw"), h.alias("ch"))


@query(f"SELECT k, CASE WHEN w * h * 4 <= 300000 THEN w * h * 4 ELSE 0 END AS size, w > 0 AND h > 0 AND w * h * 4 <= 300000 AS ok FROM {_PART} z")
def buffer_size(spark, d):
    size = G.buffer_size(F.col("w"), F.col("h"), F.lit(4), 300000)
    return sizes(spark, d).select("k", F.coalesce(size, F.lit(0)).alias("size"), size.isNotNull().alias("ok"))


# --- palettes ---------------------------------------------------------------------------------

_LEVEL = "(CASE WHEN {c} <= 47 THEN 0 WHEN {c} <= 115 THEN 1 ELSE CAST(ceil(({c} - 115) / 40.0) AS BIGINT) + 1 END)"


@query(f"SELECT {IDS}, 16 + 36 * {_LEVEL.format(c='r')} + 6 * {_LEVEL.format(c='g')} + {_LEVEL.format(c='b')} AS pen FROM {EP} p")
def cube216(spark, d):
    return event_pixels(spark, d).select(*KEY, C.cube_index(*rgb()).alias("pen"))


def nearest_sql(palette, kind: str = "BIGINT") -> str:
    return f"""SELECT {IDS}, arg_min(pen, ((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 4096 + k)::{kind} AS pen
FROM {EP} p, {palette_sql(palette)} GROUP BY {IDS}"""


@query(nearest_sql(palettes.palette16()))
def nearest_fixed16(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_of(rgb(), "16").alias("pen"))


@query(nearest_sql(palettes.in_tie_order(palettes.palette256())))
def nearest_fixed256(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_256(rgb()).alias("pen"))


@query(nearest_sql([p for p in palettes.palette256() if p[0] >= 16]))
def nearest_fixed240(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_240(rgb()).alias("pen"))


@query(nearest_sql(palettes.palette16()[:8]))
def nearest_fixed8(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_of(rgb(), "8").alias("pen"))


@query(nearest_sql([(257, 255, 255, 255), (258, 0, 0, 0)]))
def nearest_fgbg(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_of(rgb(), "fgbg").alias("pen"))


@query(nearest_sql(palettes.palette16(), "INT"))
def nearest_any_palette(spark, d):
    return nearest.with_nearest(event_pixels(spark, d), palettes.palette16()).select(*KEY, "pen")


@query(nearest_sql([(232 + k, *(8 + 10 * k,) * 3) for k in range(24)]))
def nearest_gray24(spark, d):
    return event_pixels(spark, d).select(*KEY, nearest.nearest_gray(rgb()).alias("pen"))


_TOP2 = f"""(SELECT {IDS}, pen, (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb) AS err, row_number() OVER (PARTITION BY {IDS} ORDER BY (r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb), k) AS n FROM {EP} p, {palette_sql(palettes.palette16())})"""


@query(f"SELECT {IDS}, max(CASE WHEN n = 1 THEN pen END) AS pen1, max(CASE WHEN n = 1 THEN err END) AS err1, max(CASE WHEN n = 2 THEN pen END) AS pen2, max(CASE WHEN n = 2 THEN err END) AS err2 FROM {_TOP2} z GROUP BY {IDS}")
def nearest_top2(spark, d):
    p = event_pixels(spark, d).withColumn("best", nearest.nearest_pens(rgb(), palettes.palette16(), 2))
    return p.select(*KEY, *(F.col("best")[k][f].alias(f"{f}{k + 1}") for k in range(2) for f in ("pen", "err")))


@query(f"""SELECT image_id, (r >> 4) * 256 + (g >> 4) * 16 + (b >> 4) AS bin, count(*) AS n, CAST(sum(r) AS BIGINT) AS sum_r, CAST(sum(g) AS BIGINT) AS sum_g, CAST(sum(b) AS BIGINT) AS sum_b
FROM {EP} p WHERE a > 127 AND (y * 65536 + x) % 3 = 0 GROUP BY 1, 2""")
def color_bins(spark, d):
    return quantize.color_bins(event_pixels(spark, d), 4, 3)


@query()
def palette_generate(spark, d):
    return quantize.generated_palette(event_pixels(spark, d), 32, 4)


@query()
def error_diffusion(spark, d):
    return dither.diffusion(padded(event_pixels(spark, d)), palettes.palette16())


# --- cells ------------------------------------------------------------------------------------

CELL = f"(SELECT image_id, x // 8 AS cx, y // 8 AS cy, (y % 8) * 8 + x % 8 AS i, r, g, b, a FROM {FP} f)"
CIDS = "image_id, cx, cy"
CKEY = ("image_id", "cx", "cy")


def blocks(spark, d):
    return cells.cell_blocks(padded(event_pixels(spark, d)))


@query(f"SELECT {CIDS}, {', '.join(f'CAST(sum({c}) AS BIGINT) // 64 AS {c}' for c in 'rgb')} FROM {CELL} c GROUP BY {CIDS}")
def cell_mean(spark, d):
    return blocks(spark, d).select(*CKEY, *(v.alias(c) for v, c in zip(cells.mean_color(F.col("px")), "rgb", strict=True)))


@query(f"SELECT {CIDS}, " + ", ".join(f"coalesce(CAST(sum(CASE WHEN b {op} 128 THEN {c} END) AS BIGINT) // greatest(count(CASE WHEN b {op} 128 THEN 1 END), 1), 0) AS {side}_{c}" for side, op in (("in", ">="), ("out", "<")) for c in "rgb") + f" FROM {CELL} c GROUP BY {CIDS}")
def cell_mean_by_mask(spark, d):
    inner, outer = cells.masked_means(F.col("px"), lambda p: p["b"] >= 128)
    return blocks(spark, d).select(*CKEY, *(v.cast("long").alias(f"in_{c}") for v, c in zip(inner, "rgb", strict=True)), *(v.cast("long").alias(f"out_{c}") for v, c in zip(outer, "rgb", strict=True)))


DOMINANT = f"""(SELECT {CIDS}, CASE WHEN sr >= sg AND sr >= sb THEN 0 WHEN sg >= sb THEN 1 ELSE 2 END AS ch FROM (SELECT {CIDS}, max(r) - min(r) AS sr, max(g) - min(g) AS sg, max(b) - min(b) AS sb FROM {CELL} c GROUP BY {CIDS}))"""
RANKED = f"""(SELECT c.*, ch, row_number() OVER (PARTITION BY c.image_id, c.cx, c.cy ORDER BY CASE ch WHEN 0 THEN r WHEN 1 THEN g ELSE b END, i) AS rank FROM {CELL} c JOIN {DOMINANT} m USING ({CIDS}))"""


@query(f"SELECT {CIDS}, ch AS channel, r, g, b FROM {RANKED} z WHERE rank = 33")
def cell_median(spark, d):
    px = F.col("px")
    b = blocks(spark, d).select(*CKEY, cells.dominant_channel(px).alias("channel"), cells.median_pixel(px).alias("m"))
    return b.select(*CKEY, "channel", "m.r", "m.g", "m.b")


PAIR = f"(SELECT {CIDS}, " + ", ".join(f"max(CASE WHEN rank = {n} THEN {c} END) AS {s}_{c}" for n, s in ((1, "bg"), (64, "fg")) for c in "rgb") + f" FROM {RANKED} z GROUP BY {CIDS})"


@query(f"SELECT * FROM {PAIR} z")
def contrast_pair(spark, d):
    low, high = cells.contrast_pair(F.col("px"))
    b = blocks(spark, d).select(*CKEY, low.alias("bg"), high.alias("fg"))
    return b.select(*CKEY, *(F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("bg", "fg") for c in "rgb"))


def bitmapped(spark, d):
    low, high = cells.contrast_pair(F.col("px"))
    b = blocks(spark, d).select(*CKEY, "px", low.alias("bg"), high.alias("fg"))
    hi, lo = cells.color_bitmap(F.col("px"), F.col("bg"), F.col("fg"))
    return b.withColumns({"hi": hi, "lo": lo})


_ERR = lambda s: f"(r - {s}_r) * (r - {s}_r) + (g - {s}_g) * (g - {s}_g) + (b - {s}_b) * (b - {s}_b)"
BITS = f"(SELECT c.*, CASE WHEN {_ERR('fg')} < {_ERR('bg')} THEN 1 ELSE 0 END AS bit, {_ERR('fg')} AS efg, {_ERR('bg')} AS ebg FROM {CELL} c JOIN {PAIR} z USING ({CIDS}))"
BITMAP = f"(SELECT {CIDS}, CAST(sum(CASE WHEN i < 32 THEN bit * (1::BIGINT << (31 - i)) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN i >= 32 THEN bit * (1::BIGINT << (63 - i)) ELSE 0 END) AS BIGINT) AS lo FROM {BITS} z GROUP BY {CIDS})"


@query(f"SELECT {CIDS}, hi, lo, err FROM {BITMAP} z JOIN (SELECT {CIDS}, CAST(sum(CASE WHEN bit = 1 THEN efg ELSE ebg END) AS BIGINT) AS err FROM {BITS} q GROUP BY {CIDS}) w USING ({CIDS})")
def cell_bitmap(spark, d):
    b = bitmapped(spark, d)
    return b.select(*CKEY, "hi", "lo", cells.assigned_error(F.col("px"), F.col("hi"), F.col("lo"), F.col("bg"), F.col("fg")).alias("err"))


GBITS = f"(SELECT ord, i, CASE WHEN i < 32 THEN (hi >> (31 - i)) & 1 ELSE (lo >> (63 - i)) & 1 END AS gbit FROM {glyphs.BRAILLE_SQL} g, range(64) t(i))"


@query(f"""SELECT {CIDS}, arg_min(ord, err * 4096 + ord)::BIGINT AS ord FROM (SELECT {CIDS}, ord, sum(CASE WHEN gbit = 1 THEN efg ELSE ebg END) AS err FROM {BITS} z JOIN {GBITS} g USING (i) GROUP BY {CIDS}, ord) GROUP BY {CIDS}""")
def best_symbol(spark, d):
    b = bitmapped(spark, d)
    return b.select(*CKEY, nearest.best_symbol(F.col("px"), F.col("bg"), F.col("fg"), F.col("hi"), F.col("lo"), BRAILLE, None).alias("ord"))


@query()
def best_symbol_fast(spark, d):
    b = bitmapped(spark, d)
    return b.select(*CKEY, nearest.best_symbol(F.col("px"), F.col("bg"), F.col("fg"), F.col("hi"), F.col("lo"), BRAILLE, 8).alias("ord"))


@query(f"SELECT vec_id, hi, lo, (bit_count(hi) + bit_count(lo))::INT AS popcount FROM {VC} v")
def cell_popcount(spark, d):
    v = vec_cells(spark, d)
    return v.select("vec_id", "hi", "lo", cells.popcount(F.col("hi"), F.col("lo")).alias("popcount"))


_DIST = "bit_count(xor(v.hi, g.hi)) + bit_count(xor(v.lo, g.lo))"


@query(f"SELECT vec_id, rank::INT AS rank, dist::BIGINT AS dist, ord::BIGINT AS ord FROM (SELECT vec_id, ord, {_DIST} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {_DIST}, ord) AS rank FROM {VC} v, {glyphs.BRAILLE_SQL} g) WHERE rank <= 8")
def hamming_top8(spark, d):
    v = vec_cells(spark, d).withColumn("c", nearest.glyph_candidates(F.col("hi"), F.col("lo"), BRAILLE, 8))
    return v.select("vec_id", F.posexplode("c").alias("p", "c")).select("vec_id", (F.col("p") + 1).alias("rank"), "c.dist", "c.ord")


@query(f"SELECT code_point, count(*) AS n FROM (SELECT vec_id, arg_min(code_point, ({_DIST}) * 4096 + ord) AS code_point FROM {VC} v, {glyphs.BRAILLE_SQL} g GROUP BY vec_id) GROUP BY code_point")
def glyph_usage(spark, d):
    """Flagship: vectors as cells, their nearest Braille glyphs, and how often each is used."""
    codes = F.array(*(F.lit(c) for _, c, *_ in glyphs.braille_rows()))
    best = nearest.glyph_candidates(F.col("hi"), F.col("lo"), BRAILLE, 1)[0]["ord"]
    v = vec_cells(spark, d).select(F.element_at(codes, best.cast("int") + 1).alias("code_point"))
    return v.groupBy("code_point").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT vec_id, arg_min(ord, abs((bit_count(v.hi) + bit_count(v.lo)) - g.popcount) * 4096 + ord) AS ord FROM {VC} v, {glyphs.BRAILLE_SQL} g GROUP BY vec_id")
def fill_by_popcount(spark, d):
    return vec_cells(spark, d).select("vec_id", nearest.fill_glyph(F.col("hi"), F.col("lo"), BRAILLE_COUNTS).alias("ord"))


@query(f"SELECT vec_id, string_agg(CASE WHEN bit = 1 THEN 'X' ELSE '.' END || CASE WHEN i % 8 = 7 AND i < 63 THEN chr(10) ELSE '' END, '' ORDER BY i) AS dump FROM {VB} z GROUP BY vec_id")
def glyph_dump(spark, d):
    return vec_cells(spark, d).select("vec_id", symbols.glyph_dump(cells.expanded(F.col("hi"), F.col("lo")), "X", ".").alias("dump"))


@query(f"""WITH q AS MATERIALIZED (SELECT * FROM {VB} z) SELECT vec_id, CAST(sum(s) AS BIGINT) AS total, CAST(sum(s * (i + 1)) AS BIGINT) AS weighted FROM (
SELECT q.vec_id, q.i, greatest(0, least(255, any_value(6 * q.v) - sum(n.v))) AS s
FROM q JOIN (SELECT a.vec_id, t.i, a.v FROM range(64) t(i), (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx), q a WHERE a.i = greatest(0, least(7, t.i // 8 + dy)) * 8 + greatest(0, least(7, t.i % 8 + dx))) n
ON n.vec_id = q.vec_id AND n.i = q.i GROUP BY q.vec_id, q.i) GROUP BY vec_id""")
def sharpen(spark, d):
    v = resample.sharpened(vec_cells(spark, d))
    at = F.posexplode("intensity").alias("i", "s")
    return v.select("vec_id", at).groupBy("vec_id").agg(F.sum("s").alias("total"), F.sum(F.col("s") * (F.col("i") + 1)).alias("weighted"))


# --- resampling -------------------------------------------------------------------------------


@query(f"SELECT image_id, ox AS x, oy AS y, r, g, b FROM {FP} p JOIN range(48) a(ox) ON p.x = ox * 64 // 48 JOIN range(100) b2(oy) ON p.y = oy * 64 // 100")
def scale_nearest(spark, d):
    p = padded(event_pixels(spark, d))
    return resample.scaled_nearest(p, (64, 64), (48, 100)).select(*KEY, *"rgb")


def scaled_sql(t: str) -> str:
    """Two passes over (source, output, weight), by columns, then by rows."""
    one = lambda src, axis, other: f"(SELECT image_id, {other}, o AS {axis}, {', '.join(f'CAST(sum({c} * w) AS BIGINT) // CAST(sum(w) AS BIGINT) AS {c}' for c in 'rgb')} FROM {src} q JOIN {t} t(s, o, w) ON t.s = q.{axis} GROUP BY image_id, {other}, o)"
    return f"SELECT image_id, x::BIGINT AS x, y::BIGINT AS y, r, g, b FROM {one(one(FP, 'x', 'y'), 'y', 'x')} z"


@query(scaled_sql("(SELECT s, s // 16, 1 FROM range(64) u(s))"))
def scale_box(spark, d):
    return resample.scaled_box(padded(event_pixels(spark, d)), (64, 64), (4, 4)).select(*KEY, *"rgb")


_FINE = "(SELECT o, greatest(0, least(63 * 256, ((2 * o + 1) * 64 * 256 // 40 - 256) // 2)) AS spot FROM range(40) u(o))"


@query(scaled_sql(f"(SELECT s, o, sum(w) FROM (SELECT spot // 256 AS s, o // 2 AS o, (256 - spot % 256) * 128 AS w FROM {_FINE} a UNION ALL SELECT least(spot // 256 + 1, 63), o // 2, spot % 256 * 128 FROM {_FINE} b) WHERE w > 0 GROUP BY s, o)"))
def scale_bilinear(spark, d):
    return resample.scaled_bilinear(padded(event_pixels(spark, d)), (64, 64), (20, 20)).select(*KEY, *"rgb")


# --- text of a canvas -------------------------------------------------------------------------

_CH = "CASE WHEN b < 64 THEN ' ' WHEN r < 90 THEN '.' WHEN r < 170 THEN 'a' ELSE 'Q' END"
_FG, _BG = "CASE WHEN g % 5 = 0 THEN -1 ELSE (g // 64) * 4194304 END", "CASE WHEN g % 7 = 0 THEN -1 ELSE (g // 128) * 32768 END"
CANVAS = f"(SELECT image_id, y AS cy, x AS cx, {_CH} AS ch, {_FG} AS fg, {_BG} AS bg FROM {EP} p)"


def canvas(spark, d):
    e = lambda s: F.expr(s.replace("//", "div")).alias
    return event_pixels(spark, d).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), e(_CH)("ch"), e(_FG)("fg"), e(_BG)("bg"))


@query(f"SELECT image_id, cy, string_agg(ch, '' ORDER BY cx) AS line FROM {CANVAS} c GROUP BY image_id, cy")
def print_rows(spark, d):
    return emit.fgbg_rows(canvas(spark, d))


@query(f"SELECT image_id, string_agg(line, chr(10) ORDER BY cy) AS text FROM (SELECT image_id, cy, string_agg(ch, '' ORDER BY cx) AS line FROM {CANVAS} c GROUP BY image_id, cy) GROUP BY image_id")
def print_text(spark, d):
    return emit.printed(emit.fgbg_rows(canvas(spark, d)))


def sgr_sql(source: str, clear: int, code, bold: str = "false") -> str:
    """Attributes before each cell of (image_id, cy, cx, ch, fg, bg); code(base, v): the attribute of a colour."""
    return f"""(SELECT image_id, cy, cx, ch, CASE WHEN cleared THEN chr(27) || '[0m' ELSE '' END || CASE WHEN inv AND (cleared OR NOT oi) THEN chr(27) || '[7m' ELSE '' END
 || CASE WHEN bold AND (cleared OR NOT obold) THEN chr(27) || '[1m' ELSE '' END || CASE WHEN s <> '' THEN chr(27) || '[' || s || 'm' ELSE '' END AS sgr FROM (
 SELECT *, concat_ws(';', CASE WHEN f <> wf AND f <> {clear} THEN {code(30, 'f')} END, CASE WHEN b <> wb AND b <> {clear} THEN {code(40, 'b')} END) AS s FROM (
 SELECT *, CASE WHEN cleared THEN {clear} ELSE of END AS wf, CASE WHEN cleared THEN {clear} ELSE ob END AS wb FROM (
 SELECT *, (oi AND NOT inv) OR (obold AND NOT bold) OR (of <> {clear} AND f = {clear}) OR (ob <> {clear} AND b = {clear}) AS cleared FROM (
 SELECT *, coalesce(lag(f) OVER w, {clear}) AS of, coalesce(lag(b) OVER w, {clear}) AS ob, coalesce(lag(inv) OVER w, false) AS oi, coalesce(lag(bold) OVER w, false) AS obold FROM (
 SELECT *, {bold} AS bold FROM (
 SELECT image_id, cy, cx, CASE WHEN fg = {clear} AND bg = {clear} THEN ' ' ELSE ch END AS ch, CASE WHEN fg = {clear} THEN bg ELSE fg END AS f, CASE WHEN fg = {clear} THEN fg ELSE bg END AS b, fg = {clear} AND bg <> {clear} AS inv
 FROM {source} c)) WINDOW w AS (PARTITION BY image_id, cy ORDER BY cx))))))"""


SGR = sgr_sql(CANVAS, -1, lambda base, v: f"'{base + 8};2;' || ({v} >> 16 & 255) || ';' || ({v} >> 8 & 255) || ';' || ({v} & 255)")


@query(f"SELECT * FROM {SGR} z")
def sgr_reuse(spark, d):
    return emit.sgr_changes(canvas(spark, d)).drop("fg", "bg")


def runs_sql(sgr: str) -> str:
    return f"""(SELECT image_id, cy, min(cx) AS cx, arg_min(sgr, cx) || CASE WHEN count(*) > 1 AND count(*) * strlen(any_value(ch)) > strlen(any_value(ch)) + 4 THEN any_value(ch) || chr(27) || '[' || (count(*) - 1) || 'b' ELSE repeat(any_value(ch), count(*)) END AS text
FROM (SELECT *, sum(st) OVER (PARTITION BY image_id, cy ORDER BY cx) AS run FROM (SELECT *, CASE WHEN sgr <> '' OR lag(ch) OVER (PARTITION BY image_id, cy ORDER BY cx) IS DISTINCT FROM ch THEN 1 ELSE 0 END AS st FROM {sgr} z)) GROUP BY image_id, cy, run)"""


def lines_sql(sgr: str) -> str:
    return f"(SELECT image_id, cy, CASE WHEN cy = 0 THEN chr(27) || '[0m' ELSE '' END || string_agg(text, '' ORDER BY cx) || chr(27) || '[0m' AS line FROM {runs_sql(sgr)} r GROUP BY image_id, cy)"


@query(f"SELECT * FROM {runs_sql(SGR)} z")
def rep_runs(spark, d):
    return emit.repeat_runs(emit.sgr_changes(canvas(spark, d)))


@query(f"SELECT image_id, string_agg(line, chr(10) ORDER BY cy) AS text FROM {lines_sql(SGR)} z GROUP BY image_id")
def truecolor_text(spark, d):
    return emit.printed(emit.truecolor_rows(canvas(spark, d)))


@query(f"SELECT image_id, cy, cx, ch, bg, CASE WHEN ch = ' ' THEN coalesce(last_value(CASE WHEN ch <> ' ' THEN fg END IGNORE NULLS) OVER (PARTITION BY image_id, cy ORDER BY cx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), fg) ELSE fg END AS fg FROM {CANVAS} c")
def blank_foreground(spark, d):
    return emit.blank_foreground(canvas(spark, d))


PENS = f"(SELECT image_id, x, y, r // 64 AS pen FROM {FP} p)"


def penned(spark, d):
    return padded(event_pixels(spark, d)).select(*KEY, C.div(F.col("r"), 64).alias("pen"))


SIX = f"(SELECT image_id, y // 6 AS band, pen, x, CAST(sum(1 << (y % 6)::INT) AS BIGINT) AS bits FROM {PENS} p GROUP BY 1, 2, 3, 4)"


@query(f"SELECT * FROM {SIX} z")
def sixel_chars(spark, d):
    return emit.sixel_columns(penned(spark, d))


@query(f"SELECT image_id, y // 6 AS band, x // 16 AS bank, string_agg(DISTINCT pen::VARCHAR, ',' ORDER BY pen::VARCHAR) AS pens FROM {PENS} p GROUP BY 1, 2, 3")
def pen_presence(spark, d):
    return emit.pen_presence(penned(spark, d), 16).withColumn("pens", F.array_join(F.col("pens").cast("array<string>"), ","))


_RUN = lambda c, n: f"(repeat('!255' || {c}, ({n}) // 255) || CASE WHEN ({n}) % 255 = 0 THEN '' WHEN ({n}) % 255 < 4 THEN repeat({c}, ({n}) % 255) ELSE '!' || ({n}) % 255 || {c} END)"


@query(f"""SELECT image_id, band, string_agg('#' || pen || t, '$' ORDER BY pen) AS line FROM (SELECT image_id, band, pen, string_agg(CASE WHEN gap > 0 THEN {_RUN("'?'", 'gap')} ELSE '' END || {_RUN('chr((63 + bits)::INT)', 'n')}, '' ORDER BY run) AS t FROM (
SELECT image_id, band, pen, run, any_value(bits) AS bits, count(*) AS n, max(gap) AS gap FROM (SELECT *, sum(st) OVER (PARTITION BY image_id, band, pen ORDER BY x) AS run FROM (
SELECT *, x - coalesce(lag(x) OVER w, -1) - 1 AS gap, CASE WHEN x - coalesce(lag(x) OVER w, -1) - 1 > 0 OR lag(bits) OVER w IS DISTINCT FROM bits THEN 1 ELSE 0 END AS st FROM {SIX} z WINDOW w AS (PARTITION BY image_id, band, pen ORDER BY x))) GROUP BY image_id, band, pen, run) GROUP BY image_id, band, pen) GROUP BY image_id, band""")
def sixel_rle(spark, d):
    return emit.sixel_rows(penned(spark, d))


@query()
def sixel_image(spark, d):
    return emit.sixel_text(emit.sixel_rows(penned(spark, d)), palettes.palette16()[:4])


@query(f"SELECT event_id AS k, chr(27) || 'Ptmux;' || replace(s, chr(27), chr(27) || chr(27)) || chr(27) || chr(92) AS tmux, length(s)::INT AS n FROM (SELECT event_id, event_type || chr(27) || '[' || user_id || 'm' AS s FROM events)")
def passthrough(spark, d):
    s = F.concat("event_type", F.lit("\x1b["), F.col("user_id").cast("string"), F.lit("m"))
    return table(spark, d, "events").select(F.col("event_id").alias("k"), emit.passthrough(s, "tmux").alias("tmux"), F.length(s).alias("n"))


@query("SELECT page_id AS k, to_base64(encode(url)) AS b64, length(to_base64(encode(html))) AS n FROM pages")
def base64_text(spark, d):
    b = lambda c: T.base64_plain(F.col(c).cast("binary"))
    return table(spark, d, "pages").select(F.col("page_id").alias("k"), b("url").alias("b64"), F.length(b("html")).cast("long").alias("n"))


# --- grids, order, results --------------------------------------------------------------------


@query("SELECT (n_nationkey // 4)::BIGINT AS grid_row, string_agg(rpad(n_name, 16, ' '), '' ORDER BY n_nationkey % 4) AS line FROM nation GROUP BY 1")
def grid_layout(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("item_no"), F.lit(0).alias("row_no"), F.col("n_name").alias("line"))
    return grid.grid_lines(n, 4, 16).select(F.col("grid_row"), "line")


@query("SELECT page_id, rpad(repeat(' ', (24 - length(s)) // 2) || s, 24, ' ') AS label FROM (SELECT page_id, CASE WHEN length(s) <= 24 THEN s ELSE substr(s, 1, 23) || '…' END AS s FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS s FROM pages))")
def labels_text(spark, d):
    return table(spark, d, "pages").select("page_id", grid.label_text(F.col("url"), 24).alias("label"))


@query("SELECT c_custkey * 977 AS k, (row_number() OVER (ORDER BY c_custkey) + 65529) % 65535 + 1 AS placement_id FROM customer")
def placement_counter(spark, d):
    return emit.placement_ids(table(spark, d, "customer").select((F.col("c_custkey") * 977).alias("k")), "k", 65531)


@query("SELECT CASE WHEN count(*) = sum(bad) THEN 2 WHEN sum(bad) > 0 THEN 1 ELSE 0 END AS code FROM (SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS bad FROM events)")
def exit_code(spark, d):
    return grid.exit_code(table(spark, d, "events").select((F.col("event_type") != "error").alias("ok")))


@query("SELECT user_id AS image_id, event_id AS frame_no, coalesce(sum((event_id % 90 + 10) / 2.0) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS start_ms FROM events")
def presentation_times(spark, d):
    f = table(spark, d, "events").select(F.col("user_id").alias("image_id"), F.col("event_id").alias("frame_no"), (F.col("event_id") % 90 + 10).alias("delay_ms"))
    return grid.presentation_times(f, 2.0).select("image_id", "frame_no", "start_ms")


@query("SELECT session_id, seq, arg_max(value, seq_no) AS value FROM (SELECT user_id AS session_id, event_id AS seq_no, event_type AS seq, value, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last_no FROM events) WHERE last_no IS NULL OR seq_no <= last_no GROUP BY session_id, seq")
def folded_replies(spark, d):
    seq = F.when(F.col("event_type") == "purchase", "primary_device_attributes").otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq_no"), seq.alias("seq"), "value")
    out = terminal.folded_replies(e)
    return out.withColumn("seq", F.when(F.col("seq") == "primary_device_attributes", "purchase").otherwise(F.col("seq")))


_QUEUE = "(SELECT 0 AS src_no, i::BIGINT AS item_no, p AS path FROM (VALUES (0, 'z.png'), (1, 'a.gif')) t(i, p) UNION ALL SELECT 1, c_custkey * 10 + 1, c_name || '.png' FROM customer UNION ALL SELECT 2, page_id, url FROM pages WHERE url <> '')"


def queue(spark, d):
    """A list of paths, tokens of a stream of texts, and a table of paths."""
    texts = table(spark, d, "customer").select(F.concat(F.lit("\n"), "c_name", F.lit(".png\r\n")).alias("t"), F.col("c_custkey").alias("k"))
    parts = texts.select("k", F.posexplode(F.split("t", "\n", -1)).alias("n", "path"))
    tokens = parts.select(F.lit(1).alias("src_no"), (F.col("k") * 10 + F.col("n")).alias("item_no"), F.regexp_replace("path", "\r$", "").alias("path")).where("path <> ''")
    pages = table(spark, d, "pages").select(F.lit(2).alias("src_no"), F.col("page_id").alias("item_no"), F.regexp_replace("url", "\r$", "").alias("path")).where("path <> ''")
    return paths.queued(paths.from_list(spark, ["z.png", "a.gif"]), tokens, pages)


@query(f"SELECT * FROM {_QUEUE} q")
def path_queue(spark, d):
    return queue(spark, d)


@query(f"SELECT *, row_number() OVER (ORDER BY src_no, item_no)::INT AS turn FROM {_QUEUE} q ORDER BY src_no, item_no LIMIT 12")
def paths_taken(spark, d):
    return paths.taken(queue(spark, d), 12)


@query(f"SELECT greatest(count(*) - 12, 0) AS n_left, least(count(*), 12) AS n_done FROM {_QUEUE} q")
def paths_left(spark, d):
    return paths.left(queue(spark, d), 12)


@query("SELECT * FROM (VALUES ('GIF'), ('PNG'), ('QOI'), ('TIFF'), ('XWD')) t(name)")
def loader_names(spark, d):
    return decoders.loader_names(spark)


# --- glyph sets -------------------------------------------------------------------------------

GLYPHS = [(c, t) for _, c, _, t, *_ in glyphs.glyph_rows()]
_T = glyphs.TAG_BITS


@query(f"SELECT code_point FROM (VALUES {values(GLYPHS)}) g(code_point, tags) WHERE CASE WHEN code_point = 10495 THEN false WHEN (tags & {_T['half']}) <> 0 THEN false WHEN code_point BETWEEN 9617 AND 9619 THEN true WHEN (tags & {_T['braille']}) <> 0 THEN true WHEN (tags & {_T['block']}) <> 0 THEN true ELSE false END")
def selector_fold(spark, d):
    return symbols.symbol_map(glyphs.glyph_table(spark), "block+braille+2591..2593-half-[⣿]").select("code_point")


@query("SELECT code_point, hi, lo, popcount FROM " + glyphs.BRAILLE_SQL + " g")
def glyph_braille(spark, d):
    g = glyphs.glyph_table(spark).where(F.col("tags").bitwiseAND(F.lit(_T["braille"])) != 0)
    return g.select("code_point", "hi", "lo", "popcount")


@query(f"SELECT code_point, (row_number() OVER (ORDER BY popcount, code_point) - 1)::INT AS ord, popcount FROM {glyphs.BRAILLE_SQL} g")
def glyphs_by_popcount(spark, d):
    rows = [(c, o, n) for o, c, _, _, n in glyphs.braille_rows()]
    return spark.createDataFrame(rows, "code_point int, ord int, popcount int").orderBy("popcount", "code_point")


@query(f"SELECT code_point, coalesce(u.hi, g.hi) AS hi FROM {glyphs.BRAILLE_SQL} g FULL JOIN (SELECT (10240 + vec_id)::INT AS code_point, hi FROM {VC} v) u USING (code_point)")
def glyph_override(spark, d):
    own = vec_cells(spark, d).select((F.col("vec_id") + 10240).cast("int").alias("code_point"), "hi")
    builtin = glyphs.glyph_table(spark).where(F.col("tags").bitwiseAND(F.lit(_T["braille"])) != 0).select("code_point", "hi")
    return symbols.overridden(builtin, own)


@query(f"SELECT vec_id, (10240 + vec_id)::INT AS code_point FROM embeddings WHERE 10240 + vec_id <= 10495")
def has_symbol(spark, d):
    c = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") + 10240).cast("int").alias("code_point"))
    return symbols.with_symbol(c, glyphs.glyph_table(spark).where(F.col("code_point").between(0x2800, 0x28FF)))


_RANGES = f"""CASE WHEN c BETWEEN 33 AND 126 THEN {_T['ascii']} ELSE 0 END + CASE WHEN c BETWEEN 48 AND 57 THEN {_T['digit']} ELSE 0 END
 + CASE WHEN c BETWEEN 65 AND 90 OR c BETWEEN 97 AND 122 THEN {_T['alpha']} ELSE 0 END + CASE WHEN c BETWEEN 33 AND 591 THEN {_T['latin']} ELSE 0 END
 + CASE WHEN c BETWEEN 9472 AND 9599 THEN {_T['border']} WHEN c BETWEEN 9600 AND 9631 THEN {_T['block']} WHEN c BETWEEN 9632 AND 9727 THEN {_T['geometric']} WHEN c BETWEEN 8960 AND 9215 THEN {_T['technical']} WHEN c BETWEEN 10240 AND 10495 THEN {_T['braille']} ELSE 0 END
 + CASE WHEN c BETWEEN 4352 AND 4447 OR c BETWEEN 11904 AND 42191 OR c BETWEEN 44032 AND 55203 OR c BETWEEN 127744 AND 128591 THEN {_T['wide']} ELSE 0 END"""


@query(f"SELECT c AS code_point, CASE WHEN (t & {_T['wide']}) = 0 THEN t | {_T['narrow']} ELSE t END::BIGINT AS tags FROM (SELECT c, {_RANGES} AS t FROM (SELECT p_partkey, p_partkey * 37 AS c FROM part))")
def tags_for_char(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") * 37).alias("code_point"))
    return p.select("code_point", symbols.tags_of(F.col("code_point")).alias("tags"))


# --- terminals --------------------------------------------------------------------------------

_RULES = [("alpha", "mktsegment", "BUILDING", 5), ("beta", "mktsegment", None, 5), ("gamma", "nation", None, 7), ("delta", "nation", "3", 7), ("base", "mktsegment", None, 1)]
_ENV = "(SELECT c_custkey AS session_id, 'mktsegment' AS name, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::VARCHAR FROM customer WHERE c_custkey % 3 = 0)"


@query(f"""SELECT session_id, term FROM (SELECT session_id, term, row_number() OVER (PARTITION BY session_id ORDER BY priority DESC, CASE WHEN r.value IS NULL THEN 0 ELSE 1 END DESC, term DESC) AS n
FROM {_ENV} e JOIN (VALUES {values(_RULES)}) r(term, name, value, priority) ON e.name = r.name AND (r.value IS NULL OR r.value = e.value)) WHERE n = 1""")
def term_match(spark, d):
    c = table(spark, d, "customer")
    one = c.select(F.col("c_custkey").alias("session_id"), F.lit("mktsegment").alias("name"), F.col("c_mktsegment").alias("value"))
    two = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("session_id"), F.lit("nation").alias("name"), F.col("c_nationkey").cast("string").alias("value"))
    rules = spark.createDataFrame(_RULES, "term string, name string, value string, priority int")
    return terminal.matched_terminals(one.union(two), rules)


@query("SELECT seq, coalesce(i, o) AS template, CASE WHEN i IS NULL THEN 'outer' ELSE 'inner' END AS origin FROM (SELECT p_partkey AS seq, p_name AS o FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT p_partkey AS seq, p_brand AS i FROM part WHERE p_partkey % 3 = 0) b USING (seq)")
def term_chain(spark, d):
    p = table(spark, d, "part")
    side = lambda m, c: p.where(f"p_partkey % {m} = 0").select(F.col("p_partkey").alias("seq"), F.col(c).alias("template"))
    return terminal.chained(side(2, "p_name"), side(3, "p_brand"))


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'truecolor' WHEN p_partkey % 5 = 0 THEN '240' WHEN p_partkey % 7 = 0 THEN 'fgbg_bgfg' ELSE 'fgbg' END AS mode FROM part")
def mode_ladder(spark, d):
    k = F.col("p_partkey")
    has = lambda m, *n: F.when(k % m == 0, F.array(*map(F.lit, n))).otherwise(F.array().cast("array<string>"))
    seqs = F.concat(has(2, "set_color_fg_direct", "set_color_fgbg_direct"), has(3, "set_color_bg_direct"), has(5, "set_color_fg_256", "set_color_bg_256", "set_color_fgbg_256"), has(7, "invert_colors", "reset_attributes"))
    return table(spark, d, "part").select(k.alias("k"), terminal.best_mode(seqs).alias("mode"))


@query("""SELECT event_id AS k, CASE WHEN user_id % 300 <= 255 THEN 'fg-' || (user_id % 300) || '-' || (event_id % 256) || ',' END AS direct, 'to-' || (event_id % 60000 + 1) || ';' || (user_id % 300 + 1) AS pos,
CASE WHEN event_id % 20 < 16 THEN 'aix' || (event_id % 20 + 30 + CASE WHEN event_id % 20 >= 8 THEN 52 ELSE 0 END) END AS aix, 'h-' || lower(lpad(to_hex(event_id % 65536), 4, '0')) AS hex FROM events""")
def emit_seq(spark, d):
    e, u = F.col("event_id"), F.col("user_id") % 300
    s = terminal.Sequence
    return table(spark, d, "events").select(e.alias("k"), terminal.emitted(s("f", "fg-%1-%2,", 2), [u, e % 256]).alias("direct"), terminal.emitted(s("p", "to-%1;%2", 2, "pos"), [e % 60000, u]).alias("pos"), terminal.emitted(s("a", "aix%1", 1, "aix_fg"), [e % 20]).alias("aix"), terminal.emitted(s("h", "h-%1", 1, "u16hex"), [e % 65536]).alias("hex"))


# --- text and numbers -------------------------------------------------------------------------


@query("SELECT page_id AS k, CASE WHEN length(url) <= 13 THEN url ELSE substr(url, 1, 12) || '…' END AS cut, 'a?b' || url AS flat, repeat('=', (page_id % 9)::INT) AS rep, page_id::VARCHAR AS dec, lower(lpad(to_hex(page_id), 4, '0')) AS hex FROM pages")
def text_functions(spark, d):
    k = F.col("page_id")
    return table(spark, d, "pages").select(k.alias("k"), T.ellipsized(F.col("url"), 12).alias("cut"), T.flattened(F.concat(F.lit("a\x01b"), "url")).alias("flat"), F.repeat(F.lit("="), (k % 9).cast("int")).alias("rep"), T.decimal(k).alias("dec"), T.hex4(k).alias("hex"))


_OPTIONS = ["1/2", "16:9", "0.25", "x", "3/0", "80x25", "80x", "x25", "80", "80x25x", "#ff8000", "0xABCDEF", "12345", "ff", "on", "No", "AUTO", "maybe", "1.5s", "max", "v1.18.2", "", "007abc", "7fzz", None]
_OPT = f"(SELECT i, s FROM (VALUES {values(list(enumerate(_OPTIONS)))}) t(i, s))"


@query(f"""SELECT i, CASE WHEN regexp_full_match(s, '[0-9]+([.][0-9]+)?') THEN s::DOUBLE WHEN regexp_full_match(s, '[0-9]+([.][0-9]+)?[/:][0-9]+([.][0-9]+)?') THEN regexp_extract(s, '^([0-9.]+)', 1)::DOUBLE / nullif(regexp_extract(s, '([0-9.]+)$', 1)::DOUBLE, 0) END AS fraction,
CASE WHEN regexp_full_match(s, '(#|0[xX])?[0-9a-fA-F]{{6,}}') THEN ('0x' || right(s, 6))::BIGINT END AS color,
CASE WHEN lower(trim(s)) IN ('on', 'yes', 'true', '1') THEN true WHEN lower(trim(s)) IN ('off', 'no', 'false', '0') THEN false END AS flag,
CASE WHEN lower(trim(s)) IN ('auto', 'default') THEN 'auto' WHEN lower(trim(s)) IN ('on', 'yes', 'true', '1') THEN 'on' WHEN lower(trim(s)) IN ('off', 'no', 'false', '0') THEN 'off' END AS state,
CASE WHEN regexp_full_match(s, '[0-9]+x?|[0-9]*x[0-9]+') THEN nullif(regexp_extract(s, '^([0-9]*)', 1), '')::INT END AS w, CASE WHEN regexp_full_match(s, '[0-9]+x?|[0-9]*x[0-9]+') THEN nullif(regexp_extract(s, 'x([0-9]+)$', 1), '')::INT END AS h,
CASE WHEN s IS NULL THEN -1 ELSE coalesce(nullif(regexp_replace(s, '[^0-9]', '', 'g'), '')::BIGINT, 0) END AS version, coalesce(nullif(regexp_extract(s, '^([0-9]+)', 1), '')::BIGINT, CASE WHEN s IS NOT NULL THEN 0 END) AS lead FROM {_OPT} o""")
def option_parsing(spark, d):
    o = spark.createDataFrame(list(enumerate(_OPTIONS)), "i int, s string")
    s = F.col("s")
    w, h = T.size2d(s)
    return o.select("i", T.fraction(s).alias("fraction"), T.hex_color(s).alias("color"), T.boolean(s).alias("flag"), T.tristate(s).alias("state"), w.alias("w"), h.alias("h"), T.version(s).alias("version"), T.leading_decimal(s).alias("lead"))


@query("SELECT n_nationkey AS k, CASE WHEN n_nationkey < 21 THEN ((n_nationkey * 5 * 255 + 50) // 100 * 65793)::BIGINT WHEN n_nationkey = 21 THEN 128 WHEN n_nationkey = 22 THEN 16766720 WHEN n_nationkey = 23 THEN 6591981 END AS rgb FROM nation")
def named_colors(spark, d):
    key = F.col("n_nationkey")
    name = F.when(key < 21, F.concat(F.element_at(F.array(F.lit("Gray"), F.lit("GREY ")), (key % 2 + 1).cast("int")), (key * 5).cast("string"))).when(key == 21, "NA vy").when(key == 22, "Gold").when(key == 23, "cornflower Blue").otherwise("none")
    return paths.named_color(table(spark, d, "nation").select(key.alias("k"), name.alias("n")), "n").select("k", "rgb")


@query("SELECT v.vec_id, list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE)) > 0 AS positive, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE * embedding[i]::DOUBLE))), 6) AS norm FROM embeddings v")
def vector_norms(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", (T.vec_dot(v, v) > 0).alias("positive"), F.round(T.vec_norm(v), 6).alias("norm"))


@query("SELECT page_id AS k, (ascii(url[1 + i // 8]) >> (i % 8)::INT) & 1 AS bit FROM (SELECT page_id, url, page_id % 40 AS i FROM pages)")
def bit_fields(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("k"), T.bit_set(F.col("url").cast("binary"), F.col("page_id") % 40).alias("bit"))


@query("""WITH c AS (SELECT event_id AS k, user_id AS g, event_id % 200 - 100 AS v FROM events), n AS (SELECT g, v, count(*) AS n FROM c WHERE v BETWEEN -128 AND 127 GROUP BY 1, 2)
SELECT g, min(CASE WHEN up * 8 >= total THEN v END) AS q1, min(CASE WHEN up * 8 >= total * 7 THEN v END) AS q7 FROM (SELECT g, v, sum(n) OVER (PARTITION BY g ORDER BY v) AS up, sum(n) OVER (PARTITION BY g) AS total FROM n) GROUP BY g""")
def small_quantiles(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("g"), (F.col("event_id") % 200 - 100).alias("v"))
    return histogram.small_quantiles(e, "g", "v")


@query("SELECT vec_id, hi, lo FROM " + f"(SELECT vec_id, CAST(sum(CASE WHEN i < 32 AND v > 127 THEN 1::BIGINT << (31 - i) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN i >= 32 AND v > 127 THEN 1::BIGINT << (63 - i) ELSE 0 END) AS BIGINT) AS lo FROM {VB} z GROUP BY vec_id) q")
def coverage_bitmap(spark, d):
    hi, lo = cells.halves(F.transform("intensity", lambda v: F.when(v > 127, 1).otherwise(0)))
    return vec_cells(spark, d).select("vec_id", hi.alias("hi"), lo.alias("lo"))


_SHARP = f"""(WITH q AS MATERIALIZED (SELECT * FROM {VB} z) SELECT q.vec_id, q.i, greatest(0, least(255, any_value(6 * q.v) - sum(n.v))) AS s
FROM q JOIN (SELECT a.vec_id, t.i, a.v FROM range(64) t(i), (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dy, dx), q a WHERE a.i = greatest(0, least(7, t.i // 8 + dy)) * 8 + greatest(0, least(7, t.i % 8 + dx))) n
ON n.vec_id = q.vec_id AND n.i = q.i GROUP BY q.vec_id, q.i)"""


@query(f"SELECT vec_id AS code_point, string_agg(CASE WHEN s > 127 THEN '255' ELSE '0' END, ',' ORDER BY i) AS pixels FROM {_SHARP} z GROUP BY vec_id")
def imported_glyphs(spark, d):
    v = vec_cells(spark, d).select(F.col("vec_id").alias("code_point"), F.col("intensity").alias("coverage"))
    out = batches.exported_glyphs(batches.imported_glyphs(v))
    return out.select("code_point", F.array_join(F.col("coverage").cast("array<string>"), ",").alias("pixels"))


@query()
def clustered_glyphs(spark, d):
    v = table(spark, d, "embeddings").select(F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("v"))
    return batches.clustered_glyphs(v, 32, iterations=5)


@query(f"""SELECT {CIDS}, arg_min(n, ((r - n * 255 // 64) * (r - n * 255 // 64) + (g - n * 255 // 64) * (g - n * 255 // 64) + (b - n * 255 // 64) * (b - n * 255 // 64)) * 4096 + n) AS fill
FROM (SELECT {CIDS}, {', '.join(f'CAST(sum({c}) AS BIGINT) // 64 AS {c}' for c in 'rgb')} FROM {CELL} c GROUP BY {CIDS}) m, range(65) t(n) GROUP BY {CIDS}""")
def fill_ramp(spark, d):
    mean = cells.mean_color(F.col("px"))
    b = blocks(spark, d).select(*CKEY, *(v.alias(c) for v, c in zip(mean, "rgb", strict=True)))
    return b.select(*CKEY, wide.fill_step(rgb(), (F.lit(0),) * 3, (F.lit(255),) * 3).alias("fill"))


@query(f"SELECT image_id, y AS cy, x AS cx, CASE WHEN (x * 7 + y) % 9 = 0 THEN '#' ELSE 'a' END AS ch, 1 AS width FROM {EP} p")
def cell_edits(spark, d):
    p = event_pixels(spark, d).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"))
    base = p.select("image_id", "cx", "cy", F.lit("a").alias("ch"), F.lit(1).alias("width"))
    edits = p.where("(cx * 7 + cy) % 9 = 0").select("image_id", "cx", "cy", F.lit("#").alias("ch"), F.lit(1).alias("width"))
    return grid.edited(base, edits)
