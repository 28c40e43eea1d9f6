"""Glyph tables from the geometry of their code blocks.

A bitmap is 64 bits, the top left pixel highest, kept as two non-negative halves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tags of glyphs, one bit each.
TAGS = ("space", "solid", "block", "half", "quad", "braille", "sextant", "octant", "stipple", "ascii", "alpha", "digit", "latin", "narrow", "wide", "ugly", "bad", "extra", "hhalf", "vhalf", "inverted", "border", "diagonal", "dot", "geometric", "technical", "wedge", "legacy", "imported")
TAG_BITS = {t: 1 << k for k, t in enumerate(TAGS)} | {"all": (1 << len(TAGS)) - 1, "none": 0}
SCHEMA = "ord int, code_point int, ch string, tags long, hi long, lo long, popcount int"


def bitmap(inside: Callable[[int, int], bool]) -> int:
    """The 64 bits of a predicate on (x, y)."""
    out = 0
    for y in range(8):
        for x in range(8):
            out = out << 1 | bool(inside(x, y))
    return out


def braille() -> list[tuple[int, int]]:
    """U+2800 on: dots 1 to 8, down the left then the right column, 7 and 8 last."""
    place = {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (1, 0), 4: (1, 1), 5: (1, 2), 6: (0, 3), 7: (1, 3)}
    spots = {k: (1 + 4 * cx, 2 * cy) for k, (cx, cy) in place.items()}
    out = []
    for bits in range(256):
        dots = [spots[k] for k in range(8) if bits >> k & 1]
        out.append((0x2800 + bits, bitmap(lambda x, y, dots=dots: any(dx <= x < dx + 2 and dy <= y < dy + 2 for dx, dy in dots))))
    return out


def sextants() -> list[tuple[int, int]]:
    """U+1FB00 on: 2 by 3 blocks; the empty, left, right and full ones are elsewhere."""
    rows = (0, 3, 5, 8)
    out, at = [], 0x1FB00
    for bits in range(1, 63):
        if bits in (21, 42):
            continue
        out.append((at, bitmap(lambda x, y, bits=bits: bits >> (2 * next(k for k in range(3) if rows[k] <= y < rows[k + 1]) + (x >= 4)) & 1)))
        at += 1
    return out


# Patterns of 2 by 4 blocks that have a code of their own elsewhere (bit 2 * row + column).
OCTANTS_ELSEWHERE = {
    0x00: 0x00A0, 0x01: 0x1CEA8, 0x02: 0x1CEAB, 0x03: 0x1FB82, 0x05: 0x2598, 0x0A: 0x259D, 0x0F: 0x2580, 0x14: 0x1FBE6, 0x28: 0x1FBE7,
    0x3F: 0x1FB85, 0x40: 0x1CEA3, 0x50: 0x2596, 0x55: 0x258C, 0x5A: 0x259E, 0x5F: 0x259B, 0x80: 0x1CEA0, 0xA0: 0x2597, 0xA5: 0x259A,
    0xAA: 0x2590, 0xAF: 0x259C, 0xC0: 0x2582, 0xF0: 0x2584, 0xF5: 0x2599, 0xFA: 0x259F, 0xFC: 0x2586, 0xFF: 0x2588,
}


def octant_code(bits: int) -> int:
    """Code point of a pattern: its own, or U+1CD00 on by rank among the patterns without one."""
    return OCTANTS_ELSEWHERE.get(bits) or 0x1CD00 + bits - sum(b < bits for b in OCTANTS_ELSEWHERE)


def octants() -> list[tuple[int, int]]:
    """All 256 patterns of 2 by 4 blocks."""
    return [(octant_code(bits), bitmap(lambda x, y, bits=bits: bits >> (2 * (y // 2) + (x >= 4)) & 1)) for bits in range(256)]


# A dot-matrix face of 5 by 7 for U+0020 to U+007E; each glyph's columns from the left in hex,
# the lowest bit on top.
FACE = """
0000000000 00005F0000 0007000700 147F147F14 242A7F2A12 2313086462 3649552250 0005030000 001C224100 0041221C00 082A1C2A08 08083E0808
0050300000 0808080808 0060600000 2010080402 3E5149453E 00427F4000 4261514946 2141454B31 1814127F10 2745454539 3C4A494930 0171090503
3649494936 064949291E 0036360000 0056360000 0814224100 1414141414 0041221408 0201510906 324979413E 7E1111117E 7F49494936 3E41414122
7F4141221C 7F49494941 7F09090901 3E4149497A 7F0808087F 00417F4100 2040413F01 7F08142241 7F40404040 7F020C027F 7F0408107F 3E4141413E
7F09090906 3E4151215E 7F09192946 4649494931 01017F0101 3F4040403F 1F2040201F 3F4038403F 6314081463 0708700807 6151494543 007F414100
0204081020 0041417F00 0402010204 4040404040 0001020400 2054545478 7F48444438 3844444420 384444487F 3854545418 087E090102 0C5252523E
7F08040478 00447D4000 2040443D00 7F10284400 00417F4000 7C04180478 7C08040478 3844444438 7C14141408 081414187C 7C08040408 4854545420
043F444020 3C4040207C 1C2040201C 3C4030403C 4428102844 0C5050503C 4464544C44 0008364100 00007F0000 0041360800 1008081008
"""


def ascii_glyphs() -> list[tuple[int, int]]:
    """U+0021 to U+007E, one column in from the left."""
    columns = [bytes.fromhex(x) for x in FACE.split()]
    return [(0x20 + k, bitmap(lambda x, y, c=c: 1 <= x <= 5 and y < 7 and c[x - 1] >> y & 1)) for k, c in enumerate(columns) if k]


def wide_glyphs() -> list[tuple[int, int, int]]:
    """Full-width forms U+FF01 to U+FF5E, left and right half: the same face, twice as wide."""
    out = []
    for c, bits in ascii_glyphs():
        on = lambda x, y, bits=bits: bits >> (63 - 8 * y - x) & 1
        out.append((c - 0x20 + 0xFF00, bitmap(lambda x, y, on=on: on(x // 2, y)), bitmap(lambda x, y, on=on: on(4 + x // 2, y))))
    return out


def borders() -> list[tuple[int, int, bool]]:
    """U+2500 to U+257F by their names: arms from the middle to each side, light, heavy or double; and
    whether a glyph is a diagonal."""
    import unicodedata

    sides = {"UP": "u", "DOWN": "d", "LEFT": "l", "RIGHT": "r", "VERTICAL": "ud", "HORIZONTAL": "lr"}
    weights = {"LIGHT": 1, "HEAVY": 2, "DOUBLE": 3, "SINGLE": 1}
    out = []
    for c in range(0x2500, 0x2580):
        name = unicodedata.name(chr(c)).removeprefix("BOX DRAWINGS ")
        if "DIAGONAL" in name:
            rising, falling = "UPPER RIGHT TO" in name or "CROSS" in name, "UPPER LEFT TO" in name or "CROSS" in name
            out.append((c, bitmap(lambda x, y, r=rising, f=falling: r and x + y == 7 or f and x == y), True))
            continue
        parts = [p.split() for p in name.split(" AND ")]
        usual = next((weights[w] for p in parts for w in p if w in weights), 1)
        arms: dict[str, int] = {}
        for p in parts:
            weight = next((weights[w] for w in p if w in weights), usual)
            arms |= {side: weight for w in p if w in sides for side in sides[w]}
        gaps = {"DOUBLE DASH": 4, "TRIPLE DASH": 3, "QUADRUPLE DASH": 2}
        gap = next((n for words, n in gaps.items() if words in name), 0)

        def drawn(x: int, y: int, arms=arms, gap=gap) -> bool:
            for side, weight in arms.items():
                along, across = (y, x) if side in "ud" else (x, y)
                if not (along <= 4 if side in "ul" else along >= 3) or gap and along % gap == gap - 1:
                    continue
                if across in {1: (3,), 2: (3, 4), 3: (2, 4)}[weight]:
                    return True
            return False

        out.append((c, bitmap(drawn), False))
    return out


def geometric() -> list[tuple[int, int, str]]:
    """Some dots, squares, triangles, circles and technical marks, by geometry: code point, bitmap, tag."""
    ring = lambda x, y: (2 * x - 7) ** 2 + (2 * y - 7) ** 2
    return [
        (0x00B7, bitmap(lambda x, y: x in (3, 4) and y in (3, 4)), "dot"),
        (0x2022, bitmap(lambda x, y: 2 <= x <= 5 and 2 <= y <= 5 and ring(x, y) < 18), "dot"),
        (0x25A0, bitmap(lambda x, y: 1 <= x <= 6 and 1 <= y <= 6), "geometric"),
        (0x25A1, bitmap(lambda x, y: 1 <= x <= 6 and 1 <= y <= 6 and (x in (1, 6) or y in (1, 6))), "geometric"),
        (0x25AA, bitmap(lambda x, y: 2 <= x <= 5 and 2 <= y <= 5), "geometric"),
        (0x25B2, bitmap(lambda x, y: abs(2 * x - 7) <= y), "geometric"),
        (0x25BC, bitmap(lambda x, y: abs(2 * x - 7) <= 7 - y), "geometric"),
        (0x25C6, bitmap(lambda x, y: abs(2 * x - 7) + abs(2 * y - 7) <= 8), "geometric"),
        (0x25CB, bitmap(lambda x, y: 26 <= ring(x, y) <= 50), "geometric"),
        (0x25CF, bitmap(lambda x, y: ring(x, y) <= 50), "geometric"),
        (0x25E2, bitmap(lambda x, y: x + y >= 7), "geometric"),
        (0x25E3, bitmap(lambda x, y: x <= y), "geometric"),
        (0x25E4, bitmap(lambda x, y: x + y <= 7), "geometric"),
        (0x25E5, bitmap(lambda x, y: x >= y), "geometric"),
        (0x2302, bitmap(lambda x, y: y >= 3 and (x in (1, 6) or y == 7) and 1 <= x <= 6 or y < 3 and abs(2 * x - 7) == 2 * y + 1), "technical"),
        (0x23BA, bitmap(lambda x, y: y == 0), "technical"),
        (0x23BB, bitmap(lambda x, y: y == 2), "technical"),
        (0x23BC, bitmap(lambda x, y: y == 5), "technical"),
        (0x23BD, bitmap(lambda x, y: y == 7), "technical"),
        (0x1FB3C, bitmap(lambda x, y: y >= 5 and x <= (y - 5) * 2 - 1), "wedge"),
        (0x1FB57, bitmap(lambda x, y: y <= 2 and x <= 3 - 2 * y), "wedge"),
    ]


def blocks() -> list[tuple[int, int, int]]:
    """Spaces, halves, eighths, quadrants and shades: code point, bitmap, tags."""
    t, out = TAG_BITS, []
    out.append((0x20, 0, t["space"] | t["ascii"]))
    out.append((0x2588, (1 << 64) - 1, t["solid"] | t["block"]))
    out.append((0x2580, bitmap(lambda x, y: y < 4), t["block"] | t["half"] | t["hhalf"] | t["inverted"]))
    for k in range(1, 8):
        out.append((0x2580 + k, bitmap(lambda x, y, k=k: y >= 8 - k), t["block"] | (t["half"] | t["hhalf"]) * (k == 4)))
        out.append((0x2588 + k, bitmap(lambda x, y, k=k: x < 8 - k), t["block"] | (t["half"] | t["vhalf"]) * (k == 4)))
    out.append((0x2590, bitmap(lambda x, y: x >= 4), t["block"] | t["half"] | t["vhalf"] | t["inverted"]))
    for k, step in enumerate((4, 2, 1)):
        out.append((0x2591 + k, bitmap(lambda x, y, s=step: (x + 2 * y) % 4 == 0 if s == 4 else (x + y) % 2 == 0 if s == 2 else (x + 2 * y) % 4 != 0), t["stipple"]))
    quads = ((0x2596, 4), (0x2597, 8), (0x2598, 1), (0x2599, 13), (0x259A, 9), (0x259B, 7), (0x259C, 11), (0x259D, 2), (0x259E, 6), (0x259F, 14))
    for c, bits in quads:
        out.append((c, bitmap(lambda x, y, bits=bits: bits >> (2 * (y >= 4) + (x >= 4)) & 1), t["block"] | t["quad"]))
    return out


def glyph_rows() -> list[tuple]:
    """All glyphs by (popcount, code point)."""
    t = TAG_BITS
    found = {c: (b, g) for c, b, g in blocks()}
    sets = (("braille", t["braille"], braille()), ("sextant", t["sextant"] | t["legacy"], sextants()), ("octant", t["octant"] | t["legacy"], octants()))
    for _, tags, made in sets:
        for c, b in made:
            found.setdefault(c, (b, tags))
    for c, b in ascii_glyphs():
        kind = t["alpha"] if chr(c).isalpha() else t["digit"] if chr(c).isdigit() else 0
        found[c] = (b, t["ascii"] | t["latin"] | kind)
    for c, b, slanted in borders():
        found[c] = (b, t["border"] | t["diagonal"] * slanted)
    for c, b, tag in geometric():
        found[c] = (b, t[tag] | t["legacy"] * (tag == "wedge"))
    order = sorted(found.items(), key=lambda x: (x[1][0].bit_count(), x[0]))
    return [(k, c, chr(c), g | t["narrow"], b >> 32, b & 0xFFFFFFFF, b.bit_count()) for k, (c, (b, g)) in enumerate(order)]


def glyph_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(glyph_rows(), SCHEMA)


def wide_rows() -> list[tuple]:
    """(ord, code point, hi, lo, hi1, lo1) of wide glyphs by (popcount, code point)."""
    order = sorted(wide_glyphs(), key=lambda g: (g[1].bit_count() + g[2].bit_count(), g[0]))
    return [(k, c, a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF) for k, (c, a, b) in enumerate(order)]


def braille_rows() -> list[tuple]:
    order = sorted(braille(), key=lambda x: (x[1].bit_count(), x[0]))
    return [(k, c, b >> 32, b & 0xFFFFFFFF, b.bit_count()) for k, (c, b) in enumerate(order)]


#: The Braille glyphs in SQL, from the same geometry: (ord, code_point, hi, lo, popcount).
BRAILLE_SQL = """(SELECT CAST(row_number() OVER (ORDER BY popcount, code_point) - 1 AS INT) AS ord, code_point, hi, lo, popcount FROM (
  SELECT CAST(10240 + n AS INT) AS code_point, CAST(sum(CASE WHEN y < 4 THEN s * (1::BIGINT << (31 - 8 * y - x)) ELSE 0 END) AS BIGINT) AS hi,
    CAST(sum(CASE WHEN y >= 4 THEN s * (1::BIGINT << (63 - 8 * y - x)) ELSE 0 END) AS BIGINT) AS lo, CAST(sum(s) AS INT) AS popcount
  FROM (SELECT n, x, y, CASE WHEN x % 4 IN (1, 2) THEN (n >> (CASE WHEN y // 2 < 3 THEN (x // 4) * 3 + y // 2 ELSE 6 + x // 4 END)) & 1 ELSE 0 END AS s
        FROM range(256) a(n), range(8) b(x), range(8) c(y)) GROUP BY n))"""
