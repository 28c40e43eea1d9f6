"""Glyph sets: selection by tags and ranges, lookups and overrides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.glyphs import TAG_BITS, glyph_rows


@dataclass(frozen=True)
class Selector:
    """Adds or removes code points by tags or by a range."""

    add: bool
    tags: int = 0
    first: int = -1
    last: int = -1


def parse_selectors(text: str) -> list[Selector]:
    """Items with + or - before them: tag names, hex code points or ranges, [literal characters].

    An item without a sign at the start clears what was there.  A text that can't be
    read raises ValueError and selects nothing.
    """
    out: list[Selector] = []
    at, add = 0, True
    item = re.compile(r"[ ,]*([+-]?)[ ,]*(?:\[((?:[^\]\\]|\\.)*)\]|([0-9a-fA-FuU+xX]+\.\.[0-9a-fA-FuU+xX]+)|([A-Za-z0-9]+))[ ,]*")
    first = True
    while at < len(text):
        m = item.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read {text[at:]!r}")
        sign, literal, span, word = m.groups()
        if sign:
            add = sign == "+"
        elif first:
            out.append(Selector(False, TAG_BITS["all"]))
        first = False
        if literal is not None:
            out += [Selector(add, 0, ord(c), ord(c)) for c in re.sub(r"\\(.)", r"\1", literal)]
        elif span:
            a, b = (int(re.sub(r"^(0x|u\+?)", "", x.lower()), 16) for x in span.split(".."))
            out.append(Selector(add, 0, a, b))
        elif word.lower() in TAG_BITS:
            out.append(Selector(add, TAG_BITS[word.lower()]))
        elif re.fullmatch(r"[0-9a-fA-F]{1,6}", word):
            out.append(Selector(add, 0, int(word, 16), int(word, 16)))
        else:
            raise ValueError(f"unknown tag {word!r}")
        at = m.end()
    return out


def selected(code_point: Column, tags: Column, selectors: list[Selector]) -> Column:
    """Whether the last selector that matches adds; "bad" glyphs match only selectors that name them."""
    bad = TAG_BITS["bad"] | TAG_BITS["ugly"]
    out = F.lit(False)
    for s in selectors:
        if s.tags:
            hit = tags.bitwiseAND(F.lit(s.tags)) != 0
            if s.add and not (s.tags & bad and s.tags != TAG_BITS["all"]):
                hit = hit & (tags.bitwiseAND(F.lit(bad)) == 0)
        else:
            hit = code_point.between(s.first, s.last)
        out = F.when(hit, F.lit(s.add)).otherwise(out)
    return out


def symbol_map(glyphs: DataFrame, text: str) -> DataFrame:
    return glyphs.where(selected(F.col("code_point"), F.col("tags"), parse_selectors(text)))


def matches(code_point: int, tags: int, selectors: list[Selector]) -> bool:
    """The same for one glyph."""
    bad, out = TAG_BITS["bad"] | TAG_BITS["ugly"], False
    for s in selectors:
        if s.tags:
            hit = bool(tags & s.tags)
            if s.add and not (s.tags & bad and s.tags != TAG_BITS["all"]):
                hit = hit and not tags & bad
        else:
            hit = s.first <= code_point <= s.last
        if hit:
            out = s.add
    return out


def chosen(text: str) -> list[tuple]:
    """Rows of the glyph table that a selector text picks, in the order that ties are decided by."""
    selectors = parse_selectors(text)
    return [r for r in glyph_rows() if matches(r[1], r[3], selectors)]


def by_popcount(glyphs: DataFrame) -> DataFrame:
    """Glyphs in the order that ties are decided by."""
    return glyphs.orderBy("popcount", "code_point")


def overridden(builtin: DataFrame, own: DataFrame) -> DataFrame:
    """Glyphs with the user's in place of those with the same code point."""
    b, u = builtin.alias("b"), own.alias("u")
    columns = [c for c in builtin.columns if c != "code_point"]
    return b.join(u, "code_point", "full").select("code_point", *(F.coalesce(f"u.{c}", f"b.{c}").alias(c) for c in columns))


def with_symbol(cells: DataFrame, glyphs: DataFrame) -> DataFrame:
    """Cells whose character is in the glyph set."""
    return cells.join(glyphs.select("code_point"), "code_point", "left_semi")


#: Tags that follow from the code point alone: (first, last, tags).
TAG_RANGES = ((0x21, 0x7E, "ascii"), (0x30, 0x39, "digit"), (0x41, 0x5A, "alpha"), (0x61, 0x7A, "alpha"), (0x21, 0x24F, "latin"), (0x2500, 0x257F, "border"), (0x2580, 0x259F, "block"), (0x25A0, 0x25FF, "geometric"), (0x2300, 0x23FF, "technical"), (0x2800, 0x28FF, "braille"), (0x1100, 0x115F, "wide"), (0x2E80, 0xA4CF, "wide"), (0xAC00, 0xD7A3, "wide"), (0x1F300, 0x1F64F, "wide"))


def tags_of(code_point: Column) -> Column:
    """Tags of a code point by ranges; narrow unless wide."""
    out = F.lit(0).cast("long")
    for first, last, tag in TAG_RANGES:
        out = out.bitwiseOR(F.when(code_point.between(first, last), F.lit(TAG_BITS[tag]).cast("long")).otherwise(F.lit(0).cast("long")))
    return F.when(out.bitwiseAND(F.lit(TAG_BITS["wide"])) == 0, out.bitwiseOR(F.lit(TAG_BITS["narrow"]).cast("long"))).otherwise(out)


def glyph_dump(bits: Column, on: str = "X", off: str = " ") -> Column:
    """A bitmap of 64 numbers as eight lines."""
    row = lambda y: F.concat_ws("", F.transform(F.slice(bits, y * 8 + 1, 8), lambda b: F.when(b == 1, on).otherwise(off)))
    return F.concat_ws("\n", F.transform(F.sequence(F.lit(0), F.lit(7)), row))
