"""Canvas rows as terminal text: attribute reuse, repeats, sixels and image protocols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C
from ..functions.text import base64_plain, chunks
from ..plans.palettes import FG, TRANSPARENT

ESC = "\x1b"
FULL = "\u2588"
ROW = ("image_id", "cy")


def fgbg_rows(cells: DataFrame) -> DataFrame:
    """Characters alone: image_id, cy, line; the right halves of wide characters are skipped."""
    at = F.array_sort(F.collect_list(F.struct("cx", "ch")))
    return cells.where("ch <> ''").groupBy(*ROW).agg(F.concat_ws("", F.transform(at, lambda c: c["ch"])).alias("line"))


def printed(lines: DataFrame) -> DataFrame:
    """One text an image: its lines in order, a line feed between."""
    at = F.array_sort(F.collect_list(F.struct("cy", "line")))
    return lines.groupBy("image_id").agg(F.concat_ws("\n", F.transform(at, lambda x: x["line"])).alias("text"))


def clear_of(mode: str) -> int:
    """What a transparent colour is: -1 among colours, 256 among pens."""
    return -1 if mode == "truecolor" else TRANSPARENT


def color_code(pen: Column, mode: str, background: bool = False) -> Column:
    """The attribute that sets a colour: direct, of 256, of 16 (bright ones apart), or of 8."""
    base = 40 if background else 30
    if mode == "truecolor":
        return F.format_string(f"{base + 8};2;%d;%d;%d", *(F.shiftright(pen, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)))
    if mode in ("256", "240"):
        return F.concat(F.lit(f"{base + 8};5;"), pen.cast("string"))
    if mode == "16/8":
        return (pen % 8 + base).cast("string")
    return F.when(pen < 8, pen + base).otherwise(pen + base + 52).cast("string")


def sgr_changes(cells: DataFrame, mode: str = "truecolor") -> DataFrame:
    """cells (image_id, cy, cx, ch, fg, bg) with sgr, the attributes sent before each: only what differs
    from the cell before it in its row.

    A row starts from reset attributes; fg and bg are 0xRRGGBB or pens, transparent as in
    clear_of.  With a transparent foreground alone the colours are sent the other way
    round, inverted; a cell with both transparent is a space.  Bright foregrounds of 16/8
    are bold.  Right halves of wide characters (empty ch) are skipped.
    """
    row = Window.partitionBy(*ROW).orderBy("cx")
    clear, fg, bg = F.lit(clear_of(mode)), F.col("fg"), F.col("bg")
    turned = (fg == clear) & (bg != clear)
    front, back = F.when(turned, bg).otherwise(fg), F.when(turned, fg).otherwise(bg)
    bold = (front > 7) & (front < TRANSPARENT) if mode == "16/8" else F.lit(False)
    blank = F.when(F.lead("ch").over(row) == "", "  ").otherwise(" ")
    shown = F.when((fg == clear) & (bg == clear) & (F.col("ch") != ""), blank).otherwise(F.col("ch"))
    state = cells.withColumns({"ch": shown, "s_now": F.struct(front.alias("f"), back.alias("b"), turned.alias("turned"), bold.alias("bold"))}).where("ch <> ''")
    first = F.struct(clear.cast("long").alias("f"), clear.cast("long").alias("b"), F.lit(False).alias("turned"), F.lit(False).alias("bold"))
    state = state.withColumn("s_now", F.col("s_now").cast(first_type := "struct<f:bigint,b:bigint,turned:boolean,bold:boolean>"))
    state = state.withColumn("s_was", F.coalesce(F.lag("s_now").over(row), first.cast(first_type)))
    now, was = (lambda k: F.col(f"s_now.{k}")), (lambda k: F.col(f"s_was.{k}"))
    cleared = (was("turned") & ~now("turned")) | (was("bold") & ~now("bold")) | ((was("f") != clear) & (now("f") == clear)) | ((was("b") != clear) & (now("b") == clear))
    old = lambda k, none: F.when(cleared, none).otherwise(was(k))
    lead = F.concat(
        F.when(cleared, f"{ESC}[0m").otherwise(""),
        F.when(now("turned") & ~old("turned", F.lit(False)), f"{ESC}[7m").otherwise(""),
        F.when(now("bold") & ~old("bold", F.lit(False)), f"{ESC}[1m").otherwise(""),
    )
    new = F.concat_ws(";", *(F.when((now(k) != old(k, clear)) & (now(k) != clear), color_code(now(k), mode, k == "b")) for k in "fb"))
    sgr = F.concat(lead, F.when(new != "", F.concat(F.lit(f"{ESC}["), new, F.lit("m"))).otherwise(""))
    return state.withColumn("sgr", sgr).drop("s_now", "s_was")


def inverted_cells(cells: DataFrame, foreground: int, blank: str | None = " ") -> DataFrame:
    """cells with sgr for a terminal that can only invert: a cell whose background is the foreground
    pen is inverted; one of two equal pens becomes the blank (a space, inverted if it is a full block).

    blank: a space or U+2588, whichever the glyph set has, or none.
    """
    row = Window.partitionBy(*ROW).orderBy("cx")
    plain = (F.col("fg") == F.col("bg")) & (F.coalesce(F.lead("ch").over(row), F.lit("?")) != "") & F.lit(blank is not None)
    turned = (plain & F.lit(blank == FULL)) != (F.col("bg") == foreground)
    state = cells.withColumns({"ch": F.when(F.col("ch") == "", "").when(plain, F.lit(blank or "")).otherwise(F.col("ch")), "s_now": turned}).where("ch <> ''")
    was = F.coalesce(F.lag("s_now").over(row), F.lit(False))
    sgr = F.when(F.col("s_now") & ~was, f"{ESC}[7m").when(~F.col("s_now") & was, f"{ESC}[0m").otherwise("")
    return state.withColumn("sgr", sgr).drop("s_now")


def repeat_runs(cells: DataFrame) -> DataFrame:
    """Runs of one character without attributes between: image_id, cy, cx, text; a long run is sent once
    with a repeat sequence if that is shorter."""
    w = Window.partitionBy(*ROW).orderBy("cx")
    starts = F.when((F.col("sgr") != "") | F.lag("ch").over(w).isNull() | (F.lag("ch").over(w) != F.col("ch")), 1).otherwise(0)
    runs = cells.withColumn("starts", starts).withColumn("run", F.sum("starts").over(w))
    one = runs.groupBy(*ROW, "run").agg(F.min("cx").alias("cx"), F.min_by("sgr", "cx").alias("sgr"), F.first("ch").alias("ch"), F.count(F.lit(1)).alias("n"))
    size = F.octet_length("ch")
    again = F.when((F.col("n") > 1) & (F.col("n") * size > size + 4), F.concat("ch", F.lit(f"{ESC}["), (F.col("n") - 1).cast("string"), F.lit("b"))).otherwise(F.expr("repeat(ch, int(n))"))
    return one.select(*ROW, "cx", F.concat("sgr", again).alias("text"))


def joined_rows(runs: DataFrame) -> DataFrame:
    """Lines of runs; attributes are reset before the first row and after each."""
    at = F.array_sort(F.collect_list(F.struct("cx", "text")))
    lines = runs.groupBy(*ROW).agg(F.concat_ws("", F.transform(at, lambda x: x["text"])).alias("body"))
    reset = F.lit(f"{ESC}[0m")
    return lines.select(*ROW, F.concat(F.when(F.col("cy") == 0, reset).otherwise(""), "body", reset).alias("line"))


def truecolor_rows(cells: DataFrame) -> DataFrame:
    """Lines of 24-bit attributes and characters."""
    return joined_rows(repeat_runs(sgr_changes(cells)))


def rows_of(cells: DataFrame, mode: str, foreground: int = FG, blank: str | None = " ") -> DataFrame:
    """image_id, cy, line of a canvas in any mode."""
    if mode == "fgbg":
        return fgbg_rows(cells)
    if mode == "fgbg_bgfg":
        return joined_rows(repeat_runs(inverted_cells(cells, foreground, blank)))
    return joined_rows(repeat_runs(sgr_changes(cells, mode)))


def blank_foreground(cells: DataFrame) -> DataFrame:
    """A blank cell takes the foreground of the last cell before it in its row that isn't blank."""
    w = Window.partitionBy(*ROW).orderBy("cx").rowsBetween(Window.unboundedPreceding, 0)
    kept = F.last(F.when(F.col("ch") != " ", F.col("fg")), ignorenulls=True).over(w)
    return cells.withColumn("fg", F.when(F.col("ch") == " ", F.coalesce(kept, F.col("fg"))).otherwise(F.col("fg")))


def sixel_columns(pixels: DataFrame) -> DataFrame:
    """image_id, band, pen, x, bits: which of a band's six rows have the pen in a column."""
    return pixels.groupBy("image_id", C.div(F.col("y"), 6).alias("band"), "pen", "x").agg(F.sum(F.expr("shiftleft(1, int(y % 6))")).alias("bits"))


def pen_presence(pixels: DataFrame, bank: int = 64) -> DataFrame:
    """image_id, band, bank, pens: pens found in each bank of columns."""
    return pixels.groupBy("image_id", C.div(F.col("y"), 6).alias("band"), C.div(F.col("x"), bank).alias("bank")).agg(F.array_sort(F.collect_set("pen")).alias("pens"))


def repeated_sixel(ch: Column, n: Column) -> Column:
    """A run of one sixel: up to 3 as they are, up to 254 counted, longer ones in parts of 255."""
    parts, rest = C.div(n, 255), n % 255
    few = lambda k: F.when(k < 4, F.repeat(ch, k.cast("int"))).otherwise(F.concat(F.lit("!"), k.cast("string"), ch))
    return F.concat(F.repeat(F.concat(F.lit("!255"), ch), parts.cast("int")), F.when(rest > 0, few(rest)).otherwise(""))


def sixel_rows(pixels: DataFrame) -> DataFrame:
    """image_id, band, line: for each pen of the band in order its runs of sixels, `$` between pens.

    Columns without the pen are empty sixels; trailing ones aren't sent.
    """
    columns = sixel_columns(pixels)
    w = Window.partitionBy("image_id", "band", "pen").orderBy("x")
    gap = F.col("x") - F.coalesce(F.lag("x").over(w), F.lit(-1)) - 1
    starts = F.when((gap > 0) | F.lag("bits").over(w).isNull() | (F.lag("bits").over(w) != F.col("bits")), 1).otherwise(0)
    marked = columns.withColumns({"gap": gap, "starts": starts}).withColumn("run", F.sum("starts").over(w))
    runs = marked.groupBy("image_id", "band", "pen", "run").agg(F.first("bits").alias("bits"), F.count(F.lit(1)).alias("n"), F.max("gap").alias("gap"))
    char = F.expr("char(63 + bits)")
    text = F.concat(F.when(F.col("gap") > 0, repeated_sixel(F.lit("?"), F.col("gap"))).otherwise(""), repeated_sixel(char, F.col("n")))
    at = F.array_sort(F.collect_list(F.struct("run", text.alias("t"))))
    pens = runs.groupBy("image_id", "band", "pen").agg(F.concat(F.lit("#"), F.col("pen").cast("string"), F.concat_ws("", F.transform(at, lambda x: x["t"]))).alias("t"))
    at = F.array_sort(F.collect_list(F.struct("pen", "t")))
    return pens.groupBy("image_id", "band").agg(F.concat_ws("$", F.transform(at, lambda x: x["t"])).alias("line"))


def sixel_palette(palette: list[tuple[int, int, int, int]]) -> str:
    """Colour definitions on a scale of 0 to 100."""
    return "".join(f"#{p};2;{r * 100 // 255};{g * 100 // 255};{b * 100 // 255}" for p, r, g, b in palette)


def sixel_text(rows: DataFrame, palette: list[tuple[int, int, int, int]]) -> DataFrame:
    at = F.array_sort(F.collect_list(F.struct("band", "line")))
    body = F.concat_ws("-", F.transform(at, lambda x: x["line"]))
    return rows.groupBy("image_id").agg(F.concat(F.lit(f"{ESC}P0;1;0q{sixel_palette(palette)}"), body, F.lit(f"{ESC}\\")).alias("text"))


def _kitty_chunks(rgba: Column, size: int, wrap) -> Column:
    """Chunks of raw RGBA in base64, then the end mark, each wrapped for the multiplexer."""
    parts = F.transform(chunks(rgba, size), lambda p: wrap(F.concat(F.lit(f"{ESC}_Gm=1;"), base64_plain(p), F.lit(f"{ESC}\\"))))
    return F.concat(F.concat_ws("", parts), wrap(F.lit(f"{ESC}_Gm=0{ESC}\\")))


def kitty_text(rgba: Column, width: int, height: int, columns: int, rows: int, chunk: int = 510) -> Column:
    """Immediate placement."""
    head = f"{ESC}_Ga=T,f=32,s={width},v={height},c={columns},r={rows},m=1,q=2{ESC}\\"
    return F.concat(F.lit(head), _kitty_chunks(rgba, chunk, lambda x: x))


def row_column_marks() -> list[str]:
    """Diacritics that number rows and columns: combining marks above (class 230) of Unicode 6.0
    that no canonical composition uses."""
    import unicodedata

    # Ranges that later versions filled.
    later = ((0x7FD, 0x7FD), (0x898, 0x8FF), (0x9FE, 0x9FE), (0xC00, 0xC04), (0x1AB0, 0x1AFF), (0x1CF4, 0x1CF4), (0x1CF8, 0x1CF9), (0x1DF5, 0x1DFB), (0xA674, 0xA67B), (0xA69E, 0xA69F), (0xFE27, 0xFE2F), (0x10376, 0x1037A), (0x10AE5, 0x10AE6), (0x10D24, 0x10FFF), (0x11100, 0x11102), (0x11366, 0x11FFF), (0x16B30, 0x16B36), (0x1E000, 0x1FFFF))
    used = set()
    for c in range(0x20000):
        parts = unicodedata.decomposition(chr(c)).split()
        if parts and parts[0][0] != "<":
            used |= {int(x, 16) for x in parts[1:]} | ({c} if len(parts) == 1 else set())
    return [chr(c) for c in range(0x20000) if unicodedata.combining(chr(c)) == 230 and c not in used and not any(a <= c <= b for a, b in later)]


def kitty_virtual_text(rgba: Column, width: int, height: int, columns: int, rows: int, placement: Column, kind: str) -> Column:
    """Placement by placeholder characters inside a multiplexer (tmux or screen)."""
    n = F.when(placement < 1, 1).when(placement > 255, 1 + placement % 255).otherwise(placement).cast("string")
    wrap = lambda x: passthrough(x, kind)
    head = F.concat(F.lit(f"{ESC}_Ga=T,U=1,q=2,f=32,s={width},v={height},c={columns},r={rows},i="), n, F.lit(f",m=1{ESC}\\"))
    marks, cell = row_column_marks(), "\U0010eeee"
    columns, rows = min(columns, len(marks) - 1), min(rows, len(marks) - 1)
    parts = []
    for y in range(rows):
        more = kind == "screen" and y in (35, 61, 62)  # screen moves one too far there
        if y:
            parts.append(F.lit(f"{ESC}[{columns + more}D{ESC}D"))
        body = "".join(cell + (marks[y] if kind != "screen" or x == 0 else "") + (marks[x] if kind != "screen" else "") for x in range(columns))
        parts += [F.lit(f"{ESC}[38;5;"), n, F.lit("m" + body)]
    return F.concat(wrap(head), _kitty_chunks(rgba, 63 if kind == "screen" else 510, wrap), *parts, F.lit(f"{ESC}[39m"))


def tiff_header(width: int, height: int) -> tuple[bytes, bytes]:
    """What stands before and after the pixels of a little-endian RGBA TIFF of one strip."""
    import struct

    size, n_tags = width * height * 4, 11
    after = 8 + size + 2 + 12 * n_tags + 4  # four samples of 8 bits are named behind the directory
    tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 4, after), (262, 3, 1, 2), (273, 4, 1, 8), (274, 3, 1, 1), (277, 3, 1, 4), (278, 4, 1, height), (279, 4, 1, size), (284, 3, 1, 1), (338, 3, 1, 2)]
    body = b"".join(struct.pack("<HHII", *t) for t in tags)
    return b"II*\0" + struct.pack("<I", 8 + size), struct.pack("<H", n_tags) + body + b"\0\0\0\0" + struct.pack("<4H", 8, 8, 8, 8)


def iterm2_text(rgba: Column, width: int, height: int, columns: int, rows: int) -> Column:
    head, tail = tiff_header(width, height)
    file = F.concat(F.lit(head), rgba, F.lit(tail))
    return F.concat(F.lit(f"{ESC}]1337;File=inline=1;width={columns};height={rows};preserveAspectRatio=0:"), base64_plain(file), F.lit("\x07"))


#: Bytes in a packet for a multiplexer.
PACKET = {"screen": 200, "tmux": 1_000_000}


def passthrough_bytes(data: Column, kind: str) -> Column:
    """Bytes wrapped for a multiplexer, in packets; tmux takes escapes doubled."""
    if kind not in PACKET:
        return data
    if kind == "tmux":
        data = _doubled(data)
    lead = f"{ESC}Ptmux;" if kind == "tmux" else f"{ESC}P"
    wrap = lambda p: F.concat(F.lit(lead.encode()), p, F.lit(f"{ESC}\\".encode()))
    return F.aggregate(F.transform(chunks(data, PACKET[kind]), wrap), F.lit(b""), lambda acc, p: F.concat(acc, p))


def _doubled(data: Column) -> Column:
    """Bytes with every escape doubled: as Latin-1 text, a character is a byte."""
    return F.encode(F.replace(F.decode(data, "ISO-8859-1"), F.lit(ESC), F.lit(ESC * 2)), "ISO-8859-1")


def passthrough(text: Column, kind: str) -> Column:
    """The same of text; a packet may end within a character, so the packets belong together."""
    return passthrough_bytes(F.encode(text, "UTF-8"), kind).cast("string") if kind in PACKET else text


def placement_ids(items: DataFrame, order: str, start: int = 1, block: int = 1 << 16) -> DataFrame:
    """items with placement_id, 1 to 65535 and around again in order of an integer key.

    Keys may have gaps and repeat: rows are counted by block of keys, the counts are added up in
    order, and each row is numbered within its block, so no task orders all rows.
    """
    blk = C.div(F.col(order), block)
    counts = items.groupBy(blk.alias("p_block")).agg(F.count(F.lit(1)).alias("p_n"))
    before = F.coalesce(F.sum("p_n").over(Window.orderBy("p_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("p_block").alias("b_block"), before.alias("p_base"))
    numbered = items.withColumn("p_block", blk).withColumn("p_place", F.row_number().over(Window.partitionBy("p_block").orderBy(order)) - 1)
    out = numbered.join(bases, F.col("p_block") == F.col("b_block"))
    return out.withColumn("placement_id", F.pmod(F.col("p_base") + F.col("p_place") + start - 1, F.lit(65535)) + 1).drop("p_block", "b_block", "p_place", "p_base")


def next_placement(items: DataFrame, start: int = 1) -> int:
    """The id to start from after these items."""
    return (start - 1 + items.count()) % 65535 + 1
