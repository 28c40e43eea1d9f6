"""Text and number functions of the command line and of terminal sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64_plain(data: Column) -> Column:
    """Base64 without line breaks."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def chunks(data: Column, size: int) -> Column:
    """Pieces of at most size bytes or characters, in order; none of an empty value."""
    n = F.length(data)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda o: F.substring(data, o + 1, F.lit(size)))).otherwise(F.slice(F.array(data), 1, 0))


def decimal(n: Column) -> Column:
    return n.cast("string")


def hex4(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 4, "0"))


def flattened(s: Column) -> Column:
    """Control characters as question marks."""
    return F.regexp_replace(s, "\\p{Cc}", "?")


def ellipsized(s: Column, n: int, unicode: bool = True) -> Column:
    """At most n characters and a mark; a text one character longer stays whole; nothing of nothing."""
    if n <= 0:
        return F.when(s.isNotNull() | s.isNull(), F.lit(""))
    mark = "…" if unicode else ">"
    return F.coalesce(F.when(F.char_length(s) <= n + 1, s).otherwise(F.concat(F.substring(s, 1, n), F.lit(mark))), F.lit(""))


def fraction(s: Column) -> Column:
    """"a/b", "a:b" or a real number; null for anything else and for division by zero."""
    number = r"[0-9]+(?:\.[0-9]+)?"
    top, bottom = (F.regexp_extract(s, f"^({number})[/:]({number})$", k) for k in (1, 2))
    quotient = F.try_divide(F.when(top != "", top).cast("double"), F.when(bottom != "", bottom).cast("double"))
    return F.when(s.rlike(f"^{number}$"), F.when(s.rlike(f"^{number}$"), s).cast("double")).otherwise(quotient)


def hex_color(s: Column) -> Column:
    """0xRRGGBB of the last six hex digits, behind an optional # or 0x; null for anything else."""
    digits = F.regexp_extract(s, "^(?:#|0[xX])?([0-9a-fA-F]{6,})$", 1)
    return F.conv(F.when(digits != "", F.substring(digits, -6, 6)), 16, 10).cast("long")


YES, NO, AUTO = ("on", "yes", "true", "1"), ("off", "no", "false", "0"), ("auto", "default")


def boolean(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def tristate(s: Column) -> Column:
    t = F.lower(F.trim(s))
    return F.when(t.isin(*AUTO), "auto").when(t.isin(*YES), "on").when(t.isin(*NO), "off")


def size2d(s: Column) -> tuple[Column, Column]:
    """Width and height of "WxH", "Wx", "xH" or "W"; null where not given or the text is none of these."""
    good = s.rlike("^([0-9]+x?|[0-9]*x[0-9]+)$")
    w = F.regexp_extract(s, "^([0-9]*)", 1)
    h = F.regexp_extract(s, "x([0-9]+)$", 1)
    return F.when(good & (w != ""), w).cast("int"), F.when(good & (h != ""), h).cast("int")


def duration(s: Column) -> Column:
    """Seconds; "max" and "infinite" have no end; null for anything else."""
    t = F.lower(F.trim(s))
    plain = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)s?$", 1)
    return F.when(t.isin("max", "infinite"), F.lit(float("inf"))).otherwise(F.when(plain != "", plain).cast("double"))


def version(s: Column) -> Column:
    """All digits as one number; 0 without digits, -1 for null."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when(s.isNull(), F.lit(-1)).when(digits == "", F.lit(0)).otherwise(F.when(digits != "", digits).cast("long"))


def leading_decimal(s: Column) -> Column:
    digits = F.regexp_extract(s, "^([0-9]+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(F.when(digits != "", digits).cast("long"))


def leading_hex(s: Column) -> Column:
    digits = F.regexp_extract(s, "^([0-9a-fA-F]{1,4})", 1)
    return F.when(digits == "", F.lit(0)).otherwise(F.conv(digits, 16, 10).cast("long"))


def bit_set(data: Column, i: Column) -> Column:
    """Bit i of a byte string, the lowest bit of the first byte first."""
    byte = F.conv(F.hex(F.substring(data, F.shiftright(i, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.pmod(F.floor(byte / F.pow(F.lit(2), i % 8)), F.lit(2)).cast("int")


def vec_add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def vec_sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def vec_mul(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def vec_scale(a: Column, k: float) -> Column:
    return F.transform(a, lambda x: x * k)


def vec_dot(a: Column, b: Column) -> Column:
    return F.aggregate(vec_mul(a, b), F.lit(0.0), lambda acc, x: acc + x)


def vec_norm(a: Column) -> Column:
    return F.sqrt(vec_dot(a, a))


def vec_round(a: Column) -> Column:
    """Each number to the nearest whole one, halves away from zero."""
    return F.transform(a, lambda x: F.when(x < 0, F.ceil(x - 0.5)).otherwise(F.floor(x + 0.5)))


def vec_mean(vectors: Column) -> Column:
    """The mean of an array of vectors of three."""
    component = lambda k: F.aggregate(vectors, F.lit(0.0), lambda acc, v: acc + v[k]) / F.size(vectors)
    return F.array(*map(component, range(3)))


def grid_size(s: Column) -> tuple[Column, Column]:
    """Columns and rows of a grid: like a size, "auto" leaves both open; null twice for anything else."""
    w, h = size2d(s)
    return F.when(w > 0, w), F.when(h > 0, h)


def scale_factor(s: Column) -> Column:
    """A positive number or fraction; "max" and "fill" have no bound; null for anything else."""
    value = fraction(s)
    return F.when(F.lower(s).isin("max", "fill"), F.lit(float("inf"))).when(value > 0, value)


def threshold(s: Column) -> Column:
    """A number or fraction of 0 to 1; null for anything else."""
    value = fraction(s)
    return F.when((value >= 0) & (value <= 1), value)


def anim_speed(s: Column) -> tuple[Column, Column]:
    """Frames a second, and the factor of speed: "12fps", "2" or "max" (no bound); null twice for anything else."""
    t = F.lower(s)
    number = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*(?:fps)?$", 1)
    value = F.when(number != "", number).cast("double")
    good = value > 0
    fps = F.when(t.isin("max", "maximum"), F.lit(float("inf"))).when(good & t.endswith("fps"), value)
    return fps, F.when(good & ~t.endswith("fps"), value)


def alignment(s: Column) -> tuple[Column, Column]:
    """Horizontal and vertical place (start, center, end) of up to two words between commas; null where
    not given.  "center" goes to the side that the other word leaves open, the first of both.
    A word that isn't known, or a third one, gives null twice.
    """
    words = F.split(F.lower(s), ",", -1)
    # Words and what they place.
    across = {"left": "start", "right": "end", "hcenter": "center", "hmid": "center"}
    down = {"top": "start", "up": "start", "bottom": "end", "down": "end", "vcenter": "center", "vmid": "center"}
    amid = ("center", "mid")
    known = F.forall(words, lambda w: w.isin(*across, *down, *amid)) & (F.size(words) <= 2)

    def said(table: dict[str, str]) -> Column:
        last = F.element_at(F.filter(words, lambda w: w.isin(*table)), -1)
        found = F.lit(None).cast("string")
        for word, place in table.items():
            found = F.when(last == word, place).otherwise(found)
        return F.when(F.exists(words, lambda w: w.isin(*table)), found)

    h, v = said(across), said(down)
    n = F.size(F.filter(words, lambda w: w.isin(*amid)))
    h2 = F.when((n > 0) & h.isNull(), "center").otherwise(h)
    v2 = F.when((n > 1) | (n > 0) & h.isNotNull(), "center").otherwise(v)
    return F.when(known, h2), F.when(known, v2)
