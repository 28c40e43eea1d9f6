"""Queries over canvases, glyph sets, terminals, pixel formats and options, and the same in DuckDB SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from .config import CanvasConfig
from .functions import color as C
from .functions import geometry as G
from .functions import text as T
from .operators import batches, canvas, cells, emit, formats, grid, histogram, nearest, quantize, resample, symbols, terminal, wide
from .plans import glyphs, palettes, sequences
from .plans.views import EVENT_PIXELS_SQL as EP
from .plans.views import VEC_CELLS_SQL as VC
from .plans.views import event_pixels, padded, table, vec_cells
from .queries import CELL, CIDS, CKEY, GBITS, IDS, KEY, PAIR, blocks, lines_sql, query, rgb, sgr_sql, values
from .sources import decoders
from .streaming.fifo import ByteFifo
from .streaming.parser import parse_batch

# --- pixel formats and encodings ------------------------------------------------------------------

_ORDERS = {"RGBA": ("r", "g", "b", "a"), "BGRA": ("b", "g", "r", "a"), "ARGB": ("a", "r", "g", "b"), "ABGR": ("a", "b", "g", "r")}
_HALF = "(SELECT image_id, x, y, r, g, b, (r + g) % 256 AS a FROM " + EP + " p)"


def half_clear(spark, d):
    """event_pixels with alphas of all values."""
    return event_pixels(spark, d).withColumn("a", (F.col("r") + F.col("g")) % 256)


def _byte_sql(c: str, premultiplied: bool) -> str:
    v = f"(({c} * a + {c} + a) >> 8)" if premultiplied and c != "a" else c
    return f"lpad(to_hex(({v})::BIGINT), 2, '0')"


@query("SELECT " + IDS + ", " + ", ".join(f"{' || '.join(_byte_sql(c, k == 'PREMULTIPLIED') for c in o)} AS {n.lower()}8_{k.lower()}" for k in ("PREMULTIPLIED", "UNASSOCIATED") for n, o in _ORDERS.items()) + f", {' || '.join(_byte_sql(c, False) for c in 'rgb')} AS rgb8, {' || '.join(_byte_sql(c, False) for c in 'bgr')} AS bgr8 FROM {_HALF} h")
def pixel_formats(spark, d):
    p = half_clear(spark, d)
    hexed = lambda kind: F.concat(*(F.lpad(F.hex(c), 2, "0") for c in formats.bytes_of(tuple(map(F.col, "rgba")), kind)))
    return p.select(*KEY, *(hexed(kind).alias(kind.lower()) for kind in formats.PIXEL_TYPES))


_PACKED = "((r::BIGINT << 16) | (g << 8) | b)"


@query(f"SELECT {IDS}, CASE WHEN a < 128 THEN -1 ELSE {_PACKED} END AS rgb, CASE WHEN a < 128 THEN 8421504 ELSE (255::BIGINT << 24) | {_PACKED} END AS rgba, CASE WHEN a < 128 THEN -1 ELSE {_PACKED} END AS back FROM {_HALF} h")
def color_encodings(spark, d):
    p = half_clear(spark, d).withColumn("rgb", formats.rgb_or_clear(*map(F.col, "rgba"), 128))
    p = p.withColumn("rgba", formats.rgba_of_rgb(F.col("rgb")))
    return p.select(*KEY, "rgb", "rgba", formats.rgb_of_rgba(F.col("rgba"), 128).alias("back"))


_LINEAR = "floor(CASE WHEN r / 255.0::DOUBLE <= 0.04045 THEN r / 255.0::DOUBLE / 12.92 ELSE pow((r / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END * 2047 + 0.5)::BIGINT"


@query(f"SELECT {IDS}, r * (a + 1) AS p16, r AS back16, ({_LINEAR} * (a + 1)) >> 8 AS linear8, {_LINEAR} * (a + 1) AS linear16 FROM {_HALF} h")
def deep_alpha(spark, d):
    r, a = F.col("r"), F.col("a")
    p16, light = formats.premultiplied16(r, a), C.linear_light(r)
    return half_clear(spark, d).select(*KEY, p16.alias("p16"), formats.unpremultiplied16(p16, a).alias("back16"), formats.premultiplied_linear8(light, a).alias("linear8"), formats.premultiplied16(light, a).alias("linear16"))


@query("SELECT v, floor(CASE WHEN v / 2047.0::DOUBLE <= 0.0031308 THEN v / 2047.0::DOUBLE * 12.92 ELSE 1.055 * pow(v / 2047.0::DOUBLE, (1.0::DOUBLE / 2.4)) - 0.055 END * 255 + 0.5)::BIGINT AS srgb FROM range(2048) t(v)")
def compressed_light(spark, d):
    return spark.range(2048).select(F.col("id").alias("v"), formats.compressed_light(F.col("id")).alias("srgb"))


@query(f"SELECT {IDS}, CASE WHEN x % 3 < 2 THEN (r + g + b) // 3 ELSE a END AS coverage FROM {_HALF} h")
def glyph_coverage(spark, d):
    kind = F.element_at(F.array(F.lit("RGB8"), F.lit("BGR8"), F.lit("RGBA8_UNASSOCIATED")), (F.col("x") % 3).cast("int") + 1)
    return half_clear(spark, d).select(*KEY, formats.coverage_of(kind, *map(F.col, "rgba")).alias("coverage"))


_VBIT = lambda side, i: f"CASE WHEN {i} < 32 THEN ({side}hi >> (31 - {i})) & 1 ELSE ({side}lo >> (63 - {i})) & 1 END"


@query(f"SELECT vec_id, list_sum(list_transform(range(64), lambda i: ({_VBIT('', 'i::INT')}) * 4294967295 * (i + 1)))::BIGINT AS narrow, list_sum(list_transform(range(128), lambda i: (CASE WHEN i % 16 < 8 THEN {_VBIT('', '(i // 16 * 8 + i % 8)::INT')} ELSE 1 - ({_VBIT('', '(i // 16 * 8 + i % 8)::INT')}) END) * 4294967295 * (i + 1)))::BIGINT AS wide FROM {VC} v")
def bitmap_argb(spark, d):
    v = vec_cells(spark, d).withColumn("bits", cells.expanded(F.col("hi"), F.col("lo")))
    weighed = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda acc, x: acc + x)
    other = F.transform("bits", lambda b: 1 - b)
    return v.select("vec_id", weighed(formats.argb_of_bits(F.col("bits"))).alias("narrow"), weighed(formats.argb_of_two(F.col("bits"), other)).alias("wide"))


_W, _H = "(p_partkey % 640 + 1)", "(p_size * 7 % 480 + 1)"


@query(f"SELECT p_partkey AS k, greatest((floor({_W} * 0.75)::BIGINT + 7) // 8, 1) AS cw, greatest((floor({_H} * 0.75)::BIGINT + 19) // 20, 1) AS ch, greatest(CASE WHEN p_size % 3 > 0 THEN p_size % 3 ELSE 80 END * 10, 160)::BIGINT AS pw, greatest(CASE WHEN p_partkey % 40 > 0 THEN p_partkey % 40 ELSE 24 END * 20, 160)::BIGINT AS ph FROM part")
def cell_sizes(spark, d):
    p, e = table(spark, d, "part"), F.expr
    cw, _ = G.cell_dimensions(e(_W), e(_H), 0.75, (8, 0))
    _, ch = G.cell_dimensions(e(_W), e(_H), 0.75, (8, 0))
    pw, ph = G.prescale_size(e("p_size % 3"), e("p_partkey % 40"), (80, 24), (0, 0))
    return p.select(F.col("p_partkey").alias("k"), cw.alias("cw"), ch.alias("ch"), pw.alias("pw"), ph.alias("ph"))


# --- glyph sets -----------------------------------------------------------------------------------

_ELSEWHERE = f"(VALUES {values(list(glyphs.OCTANTS_ELSEWHERE.items()))}) e(bits, code)"
_GRID = lambda n, inside: f"""(SELECT {n} AS n, CAST(sum(CASE WHEN y < 4 THEN s * (1::BIGINT << (31 - 8 * y - x)) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN y >= 4 THEN s * (1::BIGINT << (63 - 8 * y - x)) ELSE 0 END) AS BIGINT) AS lo
  FROM (SELECT {n}, x, y, {inside} AS s FROM range(256) a({n}), range(8) b(x), range(8) c(y)) GROUP BY {n})"""  # noqa: E731


@query(f"SELECT n::INT AS bits, coalesce(code, 118016 + n - (SELECT count(*) FROM {_ELSEWHERE} WHERE e.bits < n))::INT AS code_point, hi, lo FROM {_GRID('n', '(n >> (2 * (y // 2) + x // 4)::INT) & 1')} g LEFT JOIN {_ELSEWHERE} ON bits = n")
def glyph_octants(spark, d):
    rows = [(k, c, b >> 32, b & 0xFFFFFFFF) for k, (c, b) in enumerate(glyphs.octants())]
    return spark.createDataFrame(rows, "bits int, code_point int, hi long, lo long")


@query(f"SELECT (129792 + n - 1 - CASE WHEN n > 21 THEN 1 ELSE 0 END - CASE WHEN n > 42 THEN 1 ELSE 0 END)::INT AS code_point, hi, lo FROM {_GRID('n', '(n >> (2 * CASE WHEN y < 3 THEN 0 WHEN y < 5 THEN 1 ELSE 2 END + x // 4)::INT) & 1')} g WHERE n BETWEEN 1 AND 62 AND n NOT IN (21, 42)")
def glyph_sextants(spark, d):
    g = glyphs.glyph_table(spark).where(F.col("tags").bitwiseAND(F.lit(glyphs.TAG_BITS["sextant"])) != 0)
    return g.select("code_point", "hi", "lo")


_FACE = f"(VALUES {values([(32 + k, x) for k, x in enumerate(glyphs.FACE.split())])}) f(code, face)"


@query(f"SELECT code::INT AS code_point, sum(CASE WHEN x BETWEEN 1 AND 5 AND y < 7 THEN (('0x' || substr(face, 2 * x::INT - 1, 2))::INT >> y::INT) & 1 ELSE 0 END)::INT AS popcount FROM {_FACE}, range(8) a(x), range(8) b(y) WHERE code > 32 GROUP BY code")
def glyph_face(spark, d):
    g = glyphs.glyph_table(spark).where((F.col("tags").bitwiseAND(F.lit(glyphs.TAG_BITS["ascii"])) != 0) & (F.col("code_point") > 32))
    return g.select("code_point", "popcount")


@query("SELECT 'octant' AS tag, 239::BIGINT AS n UNION ALL SELECT 'braille', 256 UNION ALL SELECT 'sextant', 60 UNION ALL SELECT 'border', 128 UNION ALL SELECT 'alpha', 52 UNION ALL SELECT 'digit', 10 UNION ALL SELECT 'diagonal', 3 UNION ALL SELECT 'ascii', 95")
def glyph_tags(spark, d):
    g = glyphs.glyph_table(spark)
    has = lambda t: F.count_if(F.col("tags").bitwiseAND(F.lit(glyphs.TAG_BITS[t])) != 0).alias(t)
    names = ("octant", "braille", "sextant", "border", "alpha", "digit", "diagonal", "ascii")
    one = g.agg(*(has(t) for t in names))
    return one.select(F.explode(F.array(*(F.struct(F.lit(t).alias("tag"), F.col(t).alias("n")) for t in names))).alias("x")).select("x.tag", "x.n")


_SETS = (("block+border", ""), ("[.Q]", ""), ("[.Q]", "[ ]"), ("[ab]", "[.M]"), ("braille", ""), ("[.]", "[█]"), ("sextant", ""))


@query("SELECT * FROM (VALUES (0, 9480, 9608), (1, 46, 0), (2, 32, 0), (3, 46, 0), (4, 10240, 10495), (5, 9608, 9608), (6, 129795, 129844)) t(k, blank, solid)")
def blank_solid(spark, d):
    rows = []
    for k, (a, b) in enumerate(_SETS):
        bits = lambda text: [(r[1], r[4] << 32 | r[5]) for r in (symbols.chosen(text) if text else [])]
        rows.append((k, *canvas.blank_and_solid(bits(a), bits(b))))
    return spark.createDataFrame(rows, "k int, blank int, solid int")


# --- symbols and colours --------------------------------------------------------------------------

WIDE = glyphs.wide_rows()
_WIDE_SQL = f"(VALUES {values([(r[0], *r[2:]) for r in WIDE])}) g(ord, hi, lo, hi1, lo1)"
_WDIST = "bit_count(xor(v.hi, g.hi)) + bit_count(xor(v.lo, g.lo)) + bit_count(xor(v.lo, g.hi1)) + bit_count(xor(v.hi, g.lo1))"


@query(f"SELECT vec_id, rank::INT AS rank, dist::BIGINT AS dist, ord::BIGINT AS ord FROM (SELECT vec_id, ord, {_WDIST} AS dist, row_number() OVER (PARTITION BY vec_id ORDER BY {_WDIST}, ord) AS rank FROM {VC} v, {_WIDE_SQL}) WHERE rank <= 8")
def wide_top8(spark, d):
    table_ = [(r[0], *r[2:]) for r in WIDE]
    halves = tuple(map(F.col, ("hi", "lo", "lo", "hi")))
    v = vec_cells(spark, d).withColumn("c", nearest.wide_candidates(halves, table_, 8))
    return v.select("vec_id", F.posexplode("c").alias("p", "c")).select("vec_id", (F.col("p") + 1).alias("rank"), "c.dist", "c.ord")


_WBITS = f"(SELECT ord, i, CASE WHEN i < 32 THEN (hi >> (31 - i)::INT) & 1 WHEN i < 64 THEN (lo >> (63 - i)::INT) & 1 WHEN i < 96 THEN (hi1 >> (95 - i)::INT) & 1 ELSE (lo1 >> (127 - i)::INT) & 1 END AS bit FROM {_WIDE_SQL}, range(128) t(i))"
_TWO = f"(SELECT image_id, cx // 2 AS cx, cy, i + 64 * (cx % 2) AS i, r, g, b FROM {CELL} c)"
_TO = lambda v: f"(r - {v}) * (r - {v}) + (g - {v}) * (g - {v}) + (b - {v}) * (b - {v})"


@query(f"SELECT {CIDS}, min(err * 4096 + ord)::BIGINT // 4096 AS err, min(err * 4096 + ord)::BIGINT % 4096 AS ord FROM (SELECT {CIDS}, ord, sum(CASE WHEN bit = 1 THEN {_TO(255)} ELSE {_TO(0)} END) AS err FROM {_TWO} z JOIN {_WBITS} w USING (i) GROUP BY {CIDS}, ord) GROUP BY {CIDS}")
def best_wide_symbol(spark, d):
    b = blocks(spark, d)
    left, right = (b.where(F.col("cx") % 2 == k).select("image_id", C.div(F.col("cx"), 2).alias("cx"), "cy", F.col("px").alias(n)) for k, n in ((0, "left_px"), (1, "right_px")))
    one = lambda v: F.struct(*(F.lit(v).cast("long").alias(c) for c in "rgb"))
    zero = F.lit(0).cast("long")
    best = nearest.best_wide_symbol(F.col("left_px"), F.col("right_px"), one(0), one(255), (zero,) * 4, [(r[0], *r[2:]) for r in WIDE], None)
    found = left.join(right, list(CKEY)).withColumn("best", best)
    return found.select(*CKEY, C.div(F.col("best"), nearest.RANKS).alias("err"), (F.col("best") % nearest.RANKS).alias("ord"))


_SIDES = ", ".join(f"sum(CASE WHEN gbit = 1 THEN {c} ELSE 0 END)::BIGINT AS s1{c}, sum(CASE WHEN gbit = 0 THEN {c} ELSE 0 END)::BIGINT AS s0{c}" for c in "rgb")
_LEFT = " ".join(f"- 2 * (s{k}{c} // greatest(n{k}, 1)) * s{k}{c} + n{k} * (s{k}{c} // greatest(n{k}, 1)) * (s{k}{c} // greatest(n{k}, 1))" for c in "rgb" for k in (1, 0))


@query(f"""SELECT {CIDS}, min(err * 4096 + ord)::BIGINT // 4096 AS err, min(err * 4096 + ord)::BIGINT % 4096 AS ord FROM (SELECT {CIDS}, ord, q {_LEFT} AS err FROM (
SELECT {CIDS}, ord, {_SIDES}, sum(gbit)::BIGINT AS n1, 64 - sum(gbit)::BIGINT AS n0, sum(r * r + g * g + b * b)::BIGINT AS q FROM {CELL} z JOIN {GBITS} k USING (i) GROUP BY {CIDS}, ord)) GROUP BY {CIDS}""")
def best_symbol_by_means(spark, d):
    table_ = [(o, h, w) for o, _, h, w, _ in glyphs.braille_rows()]
    zero = F.lit(0).cast("long")
    b = blocks(spark, d).withColumn("best", canvas.best_by_means(F.col("px"), zero, zero, table_, None))
    return b.select(*CKEY, C.div(F.col("best"), nearest.RANKS).alias("err"), (F.col("best") % nearest.RANKS).alias("ord"))


def _pen_sql(side: str, palette) -> str:
    rows = values([(k, *p) for k, p in enumerate(palette)])
    return f"(SELECT arg_min(pen::BIGINT, (({side}_r - pr) * ({side}_r - pr) + ({side}_g - pg) * ({side}_g - pg) + ({side}_b - pb) * ({side}_b - pb)) * 4096 + k) FROM (VALUES {rows}) pal(k, pen, pr, pg, pb))"


_P16, _P8 = palettes.palette16(), palettes.palette16()[:8]


@query(f"""SELECT {CIDS}, CASE WHEN same THEN '█' ELSE 'x' END AS ch, f AS fg, CASE WHEN same THEN fd ELSE bd END AS bg, CASE WHEN same THEN fd ELSE f END AS fg_plain
FROM (SELECT *, f = b AND f BETWEEN 8 AND 15 AS same FROM (SELECT {CIDS}, {_pen_sql('fg', _P16)} AS f, {_pen_sql('bg', _P16)} AS b, {_pen_sql('fg', _P8)} AS fd, {_pen_sql('bg', _P8)} AS bd FROM {PAIR} z))""")
def bright_pairs(spark, d):
    low, high = cells.contrast_pair(F.col("px"))
    b = blocks(spark, d).select(*CKEY, low.alias("bg"), high.alias("fg"))
    side = lambda s: tuple(F.col(f"{s}.{c}") for c in "rgb")
    config = CanvasConfig(mode="16/8")
    with_block = canvas.pens_of(side("fg"), side("bg"), F.lit("x"), config, 0x2588)
    without = canvas.pens_of(side("fg"), side("bg"), F.lit("x"), config, 0)
    return b.select(*CKEY, with_block[0].alias("ch"), with_block[1].alias("fg"), with_block[2].alias("bg"), without[1].alias("fg_plain"))


_M = ("256", "240", "16", "8")
_PALETTES = {"256": palettes.in_tie_order(palettes.palette256()), "240": [p for p in palettes.palette256() if p[0] >= 16], "16": _P16, "8": _P8}


@query(f"SELECT {CIDS}, " + ", ".join(f"{_pen_sql('fg', _PALETTES[m])} AS fg_{m}, {_pen_sql('bg', _PALETTES[m])} AS bg_{m}" for m in _M) + f", (fg_r << 16) + (fg_g << 8) + fg_b AS fg_direct, -1::BIGINT AS bg_direct FROM {PAIR} z")
def cell_colors(spark, d):
    low, high = cells.contrast_pair(F.col("px"))
    b = blocks(spark, d).select(*CKEY, low.alias("bg"), high.alias("fg"))
    side = lambda s: tuple(F.col(f"{s}.{c}") for c in "rgb")
    out = []
    for m in _M:
        _, fg, bg = canvas.pens_of(side("fg"), side("bg"), F.lit("x"), CanvasConfig(mode=m), 0)
        out += [fg.alias(f"fg_{m}"), bg.alias(f"bg_{m}")]
    _, fg, bg = canvas.pens_of(side("fg"), side("bg"), F.lit("x"), CanvasConfig(fg_only=True), 0)
    return b.select(*CKEY, *out, fg.alias("fg_direct"), bg.alias("bg_direct"))


_DYNAMIC = "(SELECT image_id, k AS pen, (k * 53 + image_id * 7) % 256 AS pr, (k * 101) % 256 AS pg, (k * 29 + image_id) % 256 AS pb FROM range(32) t(k), (SELECT DISTINCT image_id FROM " + EP + " e))"


@query(f"SELECT p.image_id, x, y, arg_max(pen, -((r - pr) * (r - pr) + (g - pg) * (g - pg) + (b - pb) * (b - pb)) * 4096 + pen) AS pen FROM {EP} p JOIN {_DYNAMIC} t ON t.image_id = p.image_id GROUP BY p.image_id, x, y")
def nearest_dynamic(spark, d):
    p = event_pixels(spark, d)
    pens = p.select("image_id").distinct().withColumn("pen", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    pens = pens.select("image_id", "pen", ((F.col("pen") * 53 + F.col("image_id") * 7) % 256).alias("r"), (F.col("pen") * 101 % 256).alias("g"), ((F.col("pen") * 29 + F.col("image_id")) % 256).alias("b"))
    return quantize.with_own_palette(p, pens).select(*KEY, "pen")


@query()
def pens_in_order(spark, d):
    return quantize.pens_by_axis(quantize.generated_palette(padded(event_pixels(spark, d)), 16, 4)).select("image_id", "pen", "place")


_GREY = f"(SELECT {CIDS}, " + ", ".join(f"CAST(sum({c}) AS BIGINT) // 64 AS m{c}" for c in "rgb") + f" FROM {CELL} c GROUP BY {CIDS})"
_FILLS = [(0, 0), (1, 8), (2, 20), (3, 40), (4, 64)]


@query(f"""SELECT {CIDS}, arg_min(k, abs(n - c) * 4096 + k) AS ord FROM (SELECT {CIDS}, arg_min(n, ((mr - n * 255 // 64) * (mr - n * 255 // 64) + (mg - n * 255 // 64) * (mg - n * 255 // 64) + (mb - n * 255 // 64) * (mb - n * 255 // 64)) * 4096 + n) AS n
FROM {_GREY} m, range(65) t(n) GROUP BY {CIDS}), (VALUES {values(_FILLS)}) f(k, c) GROUP BY {CIDS}""")
def fill_glyphs(spark, d):
    mean = cells.mean_color(F.col("px"))
    b = blocks(spark, d).select(*CKEY, *(v.alias(c) for v, c in zip(mean, "rgb", strict=True)))
    return b.select(*CKEY, wide.filled(rgb(), (F.lit(0),) * 3, (F.lit(255),) * 3, _FILLS).alias("ord"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT image_id, y AS cy, x AS cx, coalesce(lag(g) OVER w + b < lag(r) OVER w + r, false) AS cheap FROM {EP} p WINDOW w AS (PARTITION BY image_id, y ORDER BY x)),
t AS (SELECT image_id, cy, cx, false AS taken FROM e WHERE cx = 0 UNION ALL SELECT e.image_id, e.cy, e.cx, e.cheap AND NOT t.taken FROM t JOIN e ON e.image_id = t.image_id AND e.cy = t.cy AND e.cx = t.cx + 1)
SELECT image_id, cy, cx, CASE WHEN taken THEN 'right' WHEN coalesce(lead(taken) OVER (PARTITION BY image_id, cy ORDER BY cx), false) THEN 'left' ELSE 'narrow' END AS kind FROM t""")
def wide_pairs(spark, d):
    p = event_pixels(spark, d).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("r").alias("err"), F.col("g").alias("wide_left_err"), F.col("b").alias("wide_right_err"))
    return wide.wide_lookback(wide.pair_errors(p))


# --- printing -------------------------------------------------------------------------------------

_CH = "CASE WHEN b < 64 THEN ' ' WHEN r < 90 THEN '.' WHEN r < 170 THEN 'a' ELSE 'Q' END"


def _penned_sql(n: int) -> str:
    return f"(SELECT image_id, y AS cy, x AS cx, {_CH} AS ch, CASE WHEN g % 5 = 0 THEN 256 ELSE g // 16 % {n} END AS fg, CASE WHEN g % 7 = 0 THEN 256 ELSE r // 32 % 8 END AS bg FROM {EP} p)"


def penned_canvas(spark, d, n: int):
    e = lambda s: F.expr(s.replace("//", "div")).cast("long").alias
    p = event_pixels(spark, d)
    return p.select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.expr(_CH).alias("ch"), e(f"CASE WHEN g % 5 = 0 THEN 256 ELSE g // 16 % {n} END")("fg"), e("CASE WHEN g % 7 = 0 THEN 256 ELSE r // 32 % 8 END")("bg"))


@query(f"SELECT * FROM {lines_sql(sgr_sql(_penned_sql(16), 256, lambda base, v: f'{chr(39)}{base + 8};5;{chr(39)} || {v}'))} z")
def rows_256(spark, d):
    return emit.rows_of(penned_canvas(spark, d, 16), "256")


@query(f"SELECT * FROM {lines_sql(sgr_sql(_penned_sql(16), 256, lambda base, v: f'(CASE WHEN {v} < 8 THEN {v} + {base} ELSE {v} + {base + 52} END)::VARCHAR'))} z")
def rows_16(spark, d):
    return emit.rows_of(penned_canvas(spark, d, 16), "16")


@query(f"SELECT * FROM {lines_sql(sgr_sql(_penned_sql(16), 256, lambda base, v: f'({v} % 8 + {base})::VARCHAR', 'f > 7 AND f < 256'))} z")
def rows_16_8(spark, d):
    return emit.rows_of(penned_canvas(spark, d, 16), "16/8")


_TURNED = f"""(SELECT image_id, cy, cx, ch, CASE WHEN t AND NOT o THEN chr(27) || '[7m' WHEN o AND NOT t THEN chr(27) || '[0m' ELSE '' END AS sgr FROM (SELECT *, coalesce(lag(t) OVER (PARTITION BY image_id, cy ORDER BY cx), false) AS o FROM (
SELECT image_id, y AS cy, x AS cx, CASE WHEN (r < 128) = (g < 128) THEN ' ' ELSE {_CH} END AS ch, g < 128 AS t FROM {EP} p)))"""


@query(f"SELECT * FROM {lines_sql(_TURNED)} z")
def rows_inverted(spark, d):
    pen = lambda c: F.when(F.col(c) < 128, palettes.FG).otherwise(palettes.BG)
    p = event_pixels(spark, d).select("image_id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.expr(_CH).alias("ch"), pen("r").alias("fg"), pen("g").alias("bg"))
    return emit.rows_of(p, "fgbg_bgfg")


# One-pixel images in two colours, and the character that every cell must be.
BLACK_AND_WHITE = (
    ("fgbg_bgfg", True, 10, "[ a]", " ", "a", 0.5),
    ("fgbg_bgfg", True, 17, "[ .]", " ", ".", 0.2),
    ("fgbg_bgfg", True, 1, "[.Q]", ".", "Q", 0.8),
    ("fgbg", False, 10, "[ ']", " ", "'", 1.0),
    ("fgbg", True, 23, "[ .]", " ", ".", 0.05),
    ("fgbg", False, 3, "[ /]", " ", "/", 0.2),
    ("fgbg_bgfg", True, 41, "[ .Q]", " ", "Q", 0.5),
    ("fgbg_bgfg", True, 100, "[ a]", " ", "a", 0.2),
)


@query(f"SELECT k::INT AS k, v::BIGINT AS image_id, CASE WHEN v = 0 THEN black ELSE white END AS ch, (n * n)::BIGINT AS cells FROM (VALUES {values([(k, r[2], r[4], r[5]) for k, r in enumerate(BLACK_AND_WHITE)])}) t(k, n, black, white), range(2) u(v)")
def canvas_black_and_white(spark, d):
    pixels = spark.range(2).select(F.col("id").alias("image_id"), *(F.lit(0).cast("long").alias(c) for c in "xy"), *((F.col("id") * 255).alias(c) for c in "rgb"), F.lit(255).alias("a"))
    out = None
    for k, (mode, fg_only, n, text, _, _, work) in enumerate(BLACK_AND_WHITE):
        config = CanvasConfig(width=n, height=n, mode=mode, fg_only=fg_only, symbols=text, work=max(1, round(work * 8) + 1))
        found = canvas.canvas_cells(pixels, (1, 1), config).groupBy("image_id", "ch").agg(F.count(F.lit(1)).alias("cells"))
        found = found.select(F.lit(k).alias("k"), "image_id", "ch", "cells")
        out = found if out is None else out.union(found)
    return out


@query()
def canvas_truecolor(spark, d):
    config = CanvasConfig(width=16, height=8, symbols="block+space-wide", work=9)
    return canvas.canvas_text(padded(event_pixels(spark, d)), (64, 64), config)


@query()
def canvas_240(spark, d):
    config = CanvasConfig(width=8, height=8, mode="240", symbols="block+border+space-wide", dither="ordered")
    return canvas.canvas_text(padded(event_pixels(spark, d)), (64, 64), config)


@query()
def canvas_sixels(spark, d):
    config = CanvasConfig(width=6, height=6, mode="256", pixel_mode="sixels")
    return canvas.canvas_text(padded(event_pixels(spark, d)), (64, 64), config)


_TAIL = lambda w, h: emit.tiff_header(w, h)
_BLOB = lambda raw: f"unhex('{raw.hex()}')"
_LONG = "repeat(url, 12)"


@query(f"""SELECT page_id, chr(27) || '_Ga=T,f=32,s=2,v=2,c=1,r=1,m=1,q=2' || chr(27) || chr(92) || array_to_string(list_transform(range(0, length(url), 12), lambda o: chr(27) || '_Gm=1;' || to_base64(encode(substr(url, o::INT + 1, 12))) || chr(27) || chr(92)), '') || chr(27) || '_Gm=0' || chr(27) || chr(92) AS kitty,
chr(27) || ']1337;File=inline=1;width=1;height=1;preserveAspectRatio=0:' || to_base64({_BLOB(_TAIL(2, 2)[0])} || encode(url) || {_BLOB(_TAIL(2, 2)[1])}) || chr(7) AS iterm2,
array_to_string(list_transform(range(0, length({_LONG}), 200), lambda o: chr(27) || 'P' || substr({_LONG}, o::INT + 1, 200) || chr(27) || chr(92)), '') AS screen FROM pages""")
def image_texts(spark, d):
    rgba = F.col("url").cast("binary")
    p = table(spark, d, "pages")
    return p.select("page_id", emit.kitty_text(rgba, 2, 2, 1, 1, 12).alias("kitty"), emit.iterm2_text(rgba, 2, 2, 1, 1).alias("iterm2"), emit.passthrough(F.repeat("url", F.lit(12)), "screen").alias("screen"))


# --- terminals and streams ------------------------------------------------------------------------

# Variables of a session, and the terminal, canvas mode, pixel mode and passthrough they lead to.
SESSIONS = (
    ({"TERM": "xterm-kitty"}, "kitty", "truecolor", "kitty", "none"),
    ({"TERM": "xterm-256color", "VTE_VERSION": "7200"}, "vte-*-5202", "truecolor", "symbols", "none"),
    ({"TERM": "xterm-256color", "VTE_VERSION": "4000"}, "vte", "truecolor", "symbols", "none"),
    ({"TERM": "xterm-256color"}, "xterm-256color", "truecolor", "symbols", "none"),
    ({"TERM": "linux", "COLORTERM": "1"}, "linux", "16", "symbols", "none"),
    ({"TERM": "foot-extra"}, "foot", "truecolor", "sixels", "none"),
    ({"TERM": "something"}, "vt220", "16/8", "symbols", "none"),
    ({"TERM": "screen.xterm-256color"}, "xterm-256color/screen", "240", "symbols", "none"),
    ({"TERM": "xterm-kitty", "TMUX": "x"}, "kitty/tmux", "truecolor", "kitty", "tmux"),
    ({"TERM": "mlterm", "TERM_PROGRAM": "tmux", "TERM_PROGRAM_VERSION": "3.4a"}, "mlterm/tmux-*-3.4", "truecolor", "sixels", "none"),
    ({"TERM": "mlterm", "TERM_PROGRAM": "tmux", "TERM_PROGRAM_VERSION": "3.1"}, "mlterm/tmux", "truecolor", "sixels", "tmux"),
    ({"KONSOLE_VERSION": "220401"}, "konsole-*-220370", "truecolor", "sixels", "none"),
    ({"TERM_PROGRAM": "iTerm.app"}, "iterm", "truecolor", "iterm2", "none"),
    ({"ComSpec": "C:\\Windows\\System32\\CMD.EXE"}, "windows-console", "truecolor", "symbols", "none"),
    ({"TERM": "hurd"}, "hurd", "16/8", "symbols", "none"),
    ({"SHELL": "sh"}, "dumb", "fgbg", "symbols", "none"),
)


@query(f"SELECT c_custkey AS session_id, identifier, mode, pixel_mode, passthrough FROM customer JOIN (VALUES {values([(k, *s[1:]) for k, s in enumerate(SESSIONS)])}) t(k, identifier, mode, pixel_mode, passthrough) ON k = c_custkey % {len(SESSIONS)}")
def terminals_found(spark, d):
    rows = [(k, n, v) for k, (env, *_) in enumerate(SESSIONS) for n, v in env.items()]
    env = spark.createDataFrame(rows, "k long, name string, value string")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), (F.col("c_custkey") % len(SESSIONS)).alias("k"))
    found = terminal.identified(terminal.detected(c.join(F.broadcast(env), "k").select("session_id", "name", "value")))
    return found.select("session_id", "identifier", "mode", "pixel_mode", "passthrough")


# Input, template, number of arguments, kind, result and arguments.
PARSES = (
    ("def-fg-ffff-0000-1234,x", "def-fg-%1-%2-%3,", 3, "u16hex", "success", "65535,0,4660"),
    ("def-fg-ffff-00", "def-fg-%1-%2-%3,", 3, "u16hex", "again", None),
    ("def-fh-ffff", "def-fg-%1-%2-%3,", 3, "u16hex", "failure", None),
    ("attr-255;0;4660,", "attr-%v,", 0, "u16", "success", "255,0,4660"),
    ("attr-255;0", "attr-%v,", 0, "u16", "again", None),
    ("\x1b[6;20;10t", "\x1b[6;%1;%2t", 2, "u16", "success", "20,10"),
    ("\x1b[12;40H", "\x1b[%1;%2H", 2, "pos", "success", "11,39"),
    ("\x1b", "\x1b[c", 0, "u8", "again", None),
    ("", "\x1b[c", 0, "u8", "again", None),
    ("\x1bX", "\x1b[c", 0, "u8", "failure", None),
)


@query(f"SELECT k::INT AS k, result, args FROM (VALUES {values([(k, p[4], p[5]) for k, p in enumerate(PARSES)])}) t(k, result, args)")
def sequences_parsed(spark, d):
    out = None
    for k, (text, template, n, kind, *_) in enumerate(PARSES):
        result, args = terminal.parsed(terminal.Sequence("s", template, n, kind), F.col("s"))
        one = spark.createDataFrame([(k, text)], "k int, s string").select("k", result.alias("result"), F.array_join(args.cast("array<string>"), ",").alias("args"))
        out = one if out is None else out.union(one)
    return out


_KEYS = (("up_key", "\x1b[A"), ("f5_shift_key", "\x1b[15;2~"), ("cell_size_px", "\x1b[6;20;10t"), ("delete_ctrl_key", "\x1b[3;5~"))


@query(f"""SELECT user_id AS stream_id, seq, count(*)::BIGINT AS n FROM (SELECT user_id, CASE event_id % 6 {' '.join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(_KEYS))} WHEN 4 THEN 'ö' ELSE 'q' END AS seq FROM events UNION ALL SELECT DISTINCT user_id, 'eof' FROM events) GROUP BY 1, 2""")
def input_events(spark, d):
    e = table(spark, d, "events")
    text = F.element_at(F.array(*(F.lit(s) for _, s in _KEYS), F.lit("ö"), F.lit("q")), (F.col("event_id") % 6).cast("int") + 1)
    chunks = e.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("part_no"), text.cast("binary").alias("data"))
    found = parse_batch(chunks).select("stream_id", F.when(F.col("kind") == "eof", "eof").otherwise(F.coalesce("seq", "ch")).alias("seq"))
    return found.groupBy("stream_id", "seq").agg(F.count(F.lit(1)).alias("n"))


# Steps of a byte queue (what, bytes, times), and where a search then finds its text.
FIFO_STEPS = (
    (("push", "abc", 1),), ("abc", 0),
    (("drop", "", 3),), ("abc", -1),
    (("push", "ababababcababab", 1),), ("abc", 6),
    (("drop", "", 1),), ("abc", 5),
    (("push", "x", 30000),), ("abc", 5),
    (("drop", "", 10),), ("abc", -1),
    (("push", "abc", 1),), ("abc", 30004),
    (("drop", "", 100000),), ("abc", -1),
    (("push", "x", 16380), ("push", "abracadabra", 1)), ("abracadabra", 16380),
    (("drop", "", 100000), ("push", "x", 16380), ("push", "abracadfrumpy", 1)), ("abracadabra", -1),
    (("push", "abracadabra", 1),), ("abracadabra", 16393),
)


@query(f"SELECT r_regionkey AS queue_id, step::INT AS step, place::INT AS place FROM region, (VALUES {values([(k // 2, FIFO_STEPS[k][1]) for k in range(1, len(FIFO_STEPS), 2)])}) t(step, place)")
def fifo_steps(spark, d):
    ops = [(k // 2, i, *op) for k in range(0, len(FIFO_STEPS), 2) for i, op in enumerate((*FIFO_STEPS[k], ("search", FIFO_STEPS[k + 1][0], 1)))]
    steps = spark.createDataFrame(ops, "step int, part int, op string, data string, n int")
    queues = table(spark, d, "region").select(F.col("r_regionkey").alias("queue_id"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        fifo, out = ByteFifo(), []
        for s in pdf.sort_values(["step", "part"]).itertuples():
            if s.op == "push":
                fifo.push(s.data.encode() * s.n)
            elif s.op == "drop":
                fifo.drop(s.n)
            else:
                out.append((s.queue_id, s.step, fifo.search(s.data.encode())))
        return pd.DataFrame(out, columns=["queue_id", "step", "place"])

    joined = queues.withColumn("one", F.lit(1)).join(F.broadcast(steps.withColumn("one", F.lit(1))), "one").drop("one")
    return joined.groupBy("queue_id").applyInPandas(one, "queue_id int, step int, place int")


@query(f"SELECT count(*)::BIGINT AS n, count(DISTINCT name)::BIGINT AS names, sum(n_args)::BIGINT AS args FROM (VALUES {values([(n, a) for n, _, a, _ in sequences.ALL])}) t(name, n_args)")
def sequence_table(spark, d):
    rows = spark.createDataFrame([(n, a) for n, _, a, _ in sequences.ALL], "name string, n_args int")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.sum("n_args").alias("args"))


# --- options, vectors, grids, callbacks -----------------------------------------------------------

# A text, and what it is as an alignment, a grid, a scale, an opacity threshold and a speed.
OPTIONS = (
    ("left", "start", None, None, None, None, None, None, None),
    ("center", "center", None, None, None, None, None, None, None),
    ("center,left", "start", "center", None, None, None, None, None, None),
    ("mid,mid", "center", "center", None, None, None, None, None, None),
    ("top,right", "end", "start", None, None, None, None, None, None),
    ("bottom,vmid", None, "center", None, None, None, None, None, None),
    ("left,top,right", None, None, None, None, None, None, None, None),
    ("4x3", None, None, 4, 3, None, None, None, None),
    ("x3", None, None, None, 3, None, None, None, None),
    ("2", None, None, 2, None, 2.0, None, None, 2.0),
    ("1/4", None, None, None, None, 0.25, 0.25, None, None),
    ("0.5", None, None, None, None, 0.5, 0.5, None, 0.5),
    ("12fps", None, None, None, None, None, None, 12.0, None),
    ("7.5 FPS", None, None, None, None, None, None, 7.5, None),
    ("0", None, None, None, None, None, 0.0, None, None),
    ("what", None, None, None, None, None, None, None, None),
)


@query(f"SELECT k::INT AS k, h, v, c::INT AS c, r::INT AS r, scale::DOUBLE AS scale, threshold::DOUBLE AS threshold, fps::DOUBLE AS fps, speed::DOUBLE AS speed FROM (VALUES {values([(k, *o[1:]) for k, o in enumerate(OPTIONS)])}) t(k, h, v, c, r, scale, threshold, fps, speed)")
def layout_options(spark, d):
    o = spark.createDataFrame([(k, x[0]) for k, x in enumerate(OPTIONS)], "k int, s string")
    s = F.col("s")
    (h, v), (c, r), (fps, speed) = T.alignment(s), T.grid_size(s), T.anim_speed(s)
    return o.select("k", h.alias("h"), v.alias("v"), c.alias("c"), r.alias("r"), T.scale_factor(s).alias("scale"), T.threshold(s).alias("threshold"), fps.alias("fps"), speed.alias("speed"))


_A, _B = "[embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE]", "[embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE]"
_E = lambda k: f"embedding[{k}]::DOUBLE"
_R = lambda x: f"CASE WHEN {x} < 0 THEN ceil({x} - 0.5) ELSE floor({x} + 0.5) END"


@query("SELECT vec_id, " + ", ".join([*(f"{_E(k)} + {_E(k + 3)} AS add{k}, {_E(k)} - {_E(k + 3)} AS sub{k}, {_E(k)} * {_E(k + 3)} AS mul{k}, {_E(k)} * 2.5 AS scaled{k}, {_R(f'({_E(k)} * 10)')} AS rounded{k}, ({_E(k)} + {_E(k + 3)}) / 2 AS mean{k}" for k in (1, 2, 3))]) + " FROM embeddings")
def vector_algebra(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    a, b = F.slice(v, 1, 3), F.slice(v, 4, 3)
    found = {"add": T.vec_add(a, b), "sub": T.vec_sub(a, b), "mul": T.vec_mul(a, b), "scaled": T.vec_scale(a, 2.5), "rounded": T.vec_round(T.vec_scale(a, 10)).cast("array<double>"), "mean": T.vec_mean(F.array(a, b))}
    return table(spark, d, "embeddings").select("vec_id", *(x[k - 1].alias(f"{n}{k}") for n, x in found.items() for k in (1, 2, 3)))


@query(f"SELECT image_id, sum(r * 3 + g)::BIGINT AS total, count(*)::BIGINT AS n FROM {EP} p GROUP BY image_id")
def batch_totals(spark, d):
    def batch(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(total=pdf["r"] * 3 + pdf["g"], n=1).groupby("image_id", as_index=False)[["total", "n"]].sum()

    parts = batches.process_rows(event_pixels(spark, d).select("image_id", "r", "g"), batch, "image_id long, total long, n long")
    return parts.groupBy("image_id").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'probe' WHEN event_id % 2 = 0 THEN 'keys' ELSE 'echo' END AS handled FROM events")
def handler_chain(spark, d):
    e = table(spark, d, "events")
    return batches.first_handled(e, [F.when(F.col("event_type") == "error", "probe"), F.when(F.col("event_id") % 2 == 0, "keys"), F.lit("echo")]).select("event_id", "handled")


@query("SELECT user_id % 3 AS pass_no, " + ", ".join(f"(SELECT min(v) FROM (SELECT v, sum(n) OVER (ORDER BY v) AS up, sum(n) OVER () AS total FROM (SELECT {e} AS v, count(*) AS n FROM events i WHERE i.user_id % 3 = o.k GROUP BY 1)) WHERE up * 8 >= total * 7) AS {n}" for n, e in (("advance", "event_id % 100"), ("ascent", "event_id % 37"), ("descent", "event_id % 11 - 5"))) + " FROM (SELECT user_id, user_id % 3 AS k FROM events) o GROUP BY 1, o.k")
def glyph_measures(spark, d):
    e = table(spark, d, "events")
    return histogram.measure_glyphs(e.select((F.col("user_id") % 3).alias("pass_no"), (F.col("event_id") % 100).alias("advance"), (F.col("event_id") % 37).alias("ascent"), (F.col("event_id") % 11 - 5).alias("descent")))


@query("SELECT n, CASE WHEN n % 4 = 1 THEN 3 WHEN n % 4 = 2 THEN ceil(n / 2.0)::BIGINT ELSE ceil(sqrt(n))::BIGINT END::BIGINT AS c, CASE WHEN n % 4 = 1 THEN ceil(n / 3.0)::BIGINT WHEN n % 4 = 2 THEN 2 ELSE ceil(n / ceil(sqrt(n)))::BIGINT END AS r FROM range(1, 200) t(n)")
def square_grids(spark, d):
    n = F.col("n")
    c, r = grid.square_grid(n, F.when(n % 4 == 1, 3), F.when(n % 4 == 2, 2))
    return spark.range(1, 200).select(F.col("id").alias("n")).select("n", c.alias("c"), r.alias("r"))


@query(f"SELECT image_id, ox AS x, oy AS y, r, g, b FROM {EP} p, range(3) a(ox), range(2) b2(oy) WHERE p.x = 0 AND p.y = 0")
def scale_one_pixel(spark, d):
    p = event_pixels(spark, d).where("x = 0 and y = 0")
    return resample.scaled(p, (1, 1), (3, 2)).select(*KEY, *"rgb")


@query(f"SELECT {IDS}, r, g, b, a FROM {EP} p")
def scale_copy(spark, d):
    return resample.scaled(event_pixels(spark, d), (64, 64), (64, 64)).select(*KEY, *"rgba")


@query("SELECT page_id, substr(url, 5, 6) AS part, CASE WHEN length(url) >= 10 THEN substr(url, 5, 6) END AS whole, starts_with(url, 'http') AS web FROM pages")
def byte_ranges(spark, d):
    p, data = table(spark, d, "pages"), F.col("url").cast("binary")
    at = lambda whole: decoders.bytes_at(data, F.lit(4), F.lit(6), whole).cast("string")
    return p.select("page_id", at(False).alias("part"), at(True).alias("whole"), decoders.has_magic(data, 0, b"http").alias("web"))


@query(f"""SELECT code_point::INT AS code_point, 'STARTCHAR U+' || upper(lpad(to_hex(code_point), 4, '0')) || chr(10) || 'ENCODING ' || code_point || chr(10) || 'SWIDTH 1000 0' || chr(10) || 'DWIDTH 8 0' || chr(10) || 'BBX 8 8 0 0' || chr(10) || 'BITMAP' || chr(10)
|| array_to_string(list_transform(range(8), lambda y: upper(lpad(to_hex(CASE WHEN y < 4 THEN (hi >> (24 - 8 * y)::INT) & 255 ELSE (lo >> (56 - 8 * y)::INT) & 255 END), 2, '0'))), chr(10)) || chr(10) || 'ENDCHAR' AS text FROM {glyphs.BRAILLE_SQL} g""")
def font_glyphs(spark, d):
    g = glyphs.glyph_table(spark).where(F.col("tags").bitwiseAND(F.lit(glyphs.TAG_BITS["braille"])) != 0)
    return batches.bdf_glyphs(g)


@query()
def crop_dataset(spark, d):
    return batches.crops(padded(event_pixels(spark, d)), 64, 64, 40).select("image_id", "crop_no", "hi", "lo")


@query("SELECT session_id, seq, arg_max(value, seq_no) AS value FROM (SELECT user_id AS session_id, event_id AS seq_no, event_type AS seq, value, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last_no FROM events WHERE event_id % 10 < 7) WHERE last_no IS NULL OR seq_no <= last_no GROUP BY session_id, seq")
def replies_in_time(spark, d):
    marker = "primary_device_attributes"
    seq = F.when(F.col("event_type") == "purchase", marker).otherwise(F.col("event_type"))
    e = table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq_no"), seq.alias("seq"), "value")
    out = terminal.folded_replies(e, F.col("seq_no") % 10 < 7)
    return out.withColumn("seq", F.when(F.col("seq") == marker, "purchase").otherwise(F.col("seq")))


@query("SELECT user_id % 4 AS src_no, event_id AS item_no, event_type AS text FROM events")
def ordered_output(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("src_no"), F.col("event_id").alias("item_no"), F.col("event_type").alias("text"))
    return grid.in_order(e)


@query(f"SELECT {IDS}, {', '.join(f'greatest(0, least(255, {c} + CASE WHEN y % 2 = 0 THEN CASE WHEN x % 2 = 0 THEN -63 ELSE 0 END ELSE CASE WHEN x % 2 = 0 THEN 32 ELSE -31 END END)) AS {c}' for c in 'rgb')} FROM {EP} p")
def small_dither(spark, d):
    from .operators import dither

    return dither.ordered(event_pixels(spark, d), 0.5, (1, 1), 2).select(*KEY, *"rgb")


@query()
def dither_to_din99d(spark, d):
    """Ordered dithering, then the other colour space."""
    return formats.in_space(formats.dithered(event_pixels(spark, d), "ordered", 0.25, (2, 2)), "din99d").select(*KEY, *"rgb")
