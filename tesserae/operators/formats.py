"""Pixel formats, colour encodings, alpha in 8 and 16 bits, and what glyph pixels cover."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C
from .dither import noisy, ordered

#: Order of channels in memory, and whether colours are multiplied by alpha.
PIXEL_TYPES = {f"{o}8_{k}": (o, k == "PREMULTIPLIED") for k in ("PREMULTIPLIED", "UNASSOCIATED") for o in ("RGBA", "BGRA", "ARGB", "ABGR")} | {"RGB8": ("RGB", False), "BGR8": ("BGR", False)}


def premultiplied16(c: Column, a: Column) -> Column:
    """c (8 bits, or 11 in linear light) times alpha + 1, nothing lost."""
    return c * (a + 1)


def unpremultiplied16(p: Column, a: Column) -> Column:
    return C.div(p, a + 1)


def premultiplied_linear8(v: Column, a: Column) -> Column:
    return F.shiftright(v * (a + 1), 8)


def compressed_light(v: Column) -> Column:
    """Linear light 0 to 2047 back to an sRGB channel."""
    x = v / 2047.0
    return F.floor(F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) * 255 + 0.5)


def bytes_of(rgba: tuple[Column, Column, Column, Column], kind: str) -> list[Column]:
    """The bytes of an unassociated colour in a pixel format, in memory order."""
    order, multiplied = PIXEL_TYPES[kind]
    named = dict(zip("RGBA", rgba, strict=True))
    return [C.premultiplied(named[c], rgba[3]) if multiplied and c != "A" else named[c] for c in order]


def rgba_of(data: np.ndarray, kind: str) -> np.ndarray:
    """(n, 4) unassociated RGBA of the pixels of a byte array."""
    order, multiplied = PIXEL_TYPES[kind]
    raw = data.reshape(-1, len(order)).astype(np.int64)
    out = np.full((len(raw), 4), 255, np.int64)
    for k, c in enumerate(order):
        out[:, "RGBA".index(c)] = raw[:, k]
    if multiplied:
        a = np.maximum(out[:, 3:], 1)
        out[:, :3] = np.where(out[:, 3:] == 0, 0, np.minimum(255, (out[:, :3] * 255 + a // 2) // a))
    return out


PIXELS = "path string, frame_no int, x long, y long, r long, g long, b long, a long"


def frame_pixels(frames: DataFrame, block: int = 1 << 16) -> DataFrame:
    """PIXELS of decoded frames in any pixel format, `block` pixels at a time; failed files have none."""
    names = [c.split()[0] for c in PIXELS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, frame, width, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rgba = rgba_of(np.frombuffer(data, np.uint8), kind)
                for at in range(0, len(rgba), block):
                    part, i = rgba[at : at + block], np.arange(at, min(at + block, len(rgba)))
                    columns = [pa.array([path] * len(part), pa.string()), pa.array(np.full(len(part), frame, np.int32)), i % width, i // width, *part.T]
                    yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c)) for c in columns], names=names)

    return frames.where("data is not null").select("path", "frame_no", "width", "pixel_type", "data").mapInArrow(run, PIXELS)


# --- colours as one number ----------------------------------------------------------------------


def rgb_or_clear(r: Column, g: Column, b: Column, a: Column, threshold: int) -> Column:
    """0xRRGGBB, or -1 where alpha is below the threshold."""
    packed = F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))
    return F.when(a < threshold, F.lit(-1).cast("long")).otherwise(packed)


def channels_of_rgb(rgb: Column) -> list[Column]:
    """r, g, b, a of 0xRRGGBB; a negative number is a clear middle gray."""
    return [F.when(rgb < 0, 0x80).otherwise(C.channel(rgb, s)) for s in (16, 8, 0)] + [F.when(rgb < 0, 0).otherwise(255)]


def rgba_of_rgb(rgb: Column) -> Column:
    """0xRRGGBB (or -1) as 0xAARRGGBB."""
    return C.pack(*channels_of_rgb(rgb))


def rgb_of_rgba(rgba: Column, threshold: int) -> Column:
    return rgb_or_clear(*(C.channel(rgba, s) for s in (16, 8, 0, 24)), threshold)


# --- coverage -----------------------------------------------------------------------------------


def coverage_of(kind: Column, r: Column, g: Column, b: Column, a: Column) -> Column:
    """Coverage of a glyph pixel: mean brightness where there is no alpha, else alpha."""
    return F.when(kind.isin("RGB8", "BGR8"), C.div(r + g + b, 3)).otherwise(a)


def argb_of_bits(bits: Column) -> Column:
    """0xFFFFFFFF or 0 for each of a bitmap's pixels."""
    return F.transform(bits, lambda b: b * F.lit(0xFFFFFFFF))


def argb_of_two(left: Column, right: Column) -> Column:
    """The pixels of a wide glyph: rows of 16, the left half's eight first."""
    row = lambda y: F.concat(F.slice(left, y * 8 + 1, 8), F.slice(right, y * 8 + 1, 8))
    return argb_of_bits(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), row)))


# --- dithering and colour space in one step -------------------------------------------------------


def dithered(pixels: DataFrame, mode: str, intensity: float, grain: tuple[int, int] = (1, 1)) -> DataFrame:
    """Pixels moved by the table of a dither mode (ordered, noise or none)."""
    if mode == "ordered":
        return ordered(pixels, intensity, grain)
    if mode == "noise":
        return noisy(pixels, intensity, grain)
    return pixels


def in_space(pixels: DataFrame, space: str) -> DataFrame:
    """Pixels with their channels in a colour space (rgb or din99d)."""
    if space == "rgb":
        return pixels
    found = C.din99d(*map(F.col, "rgb"))
    return pixels.withColumns({c: C.clamp(v) for c, v in zip("rgb", found, strict=True)})
