"""Dithering: ordered and noise tables as expressions, error diffusion one image a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color as C


def bayer(size: int, magnitude: float = 1.0) -> list[int]:
    """Threshold table of size 2, 4, 8 or 16, row by row, around 0 within 128 * magnitude.

    The rank of a place interleaves the bits of its coordinates: the lowest bits of x and y
    weigh most.
    """
    n = size * size
    out = []
    for y in range(size):
        for x in range(size):
            rank, weight, half = 0, 1, size // 2
            while half:
                right, down = bool(x & half), bool(y & half)
                rank += weight * {(False, False): 0, (True, True): 1, (True, False): 2, (False, True): 3}[right, down]
                weight, half = weight * 4, half // 2
            out.append(int((rank - n / 2) * (256 / n) * magnitude + 0.5))
    return out


def noise(size: int = 64, channels: int = 3, magnitude: float = 0.25) -> list[int]:
    """A tile of hashed noise, channels together, around 0 within 128 * magnitude."""
    out = []
    for k in range(size * size * channels):
        h = (k * 2654435761) % (1 << 32)
        h = ((h ^ (h >> 15)) * 2246822519) % (1 << 32)
        out.append(int(((h >> 24) - 128) * magnitude))
    return out


def _at(table: list[int], index: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v) for v in table)), index.cast("int") + 1)


def ordered(pixels: DataFrame, intensity: float = 1.0, grain: tuple[int, int] = (1, 1), size: int = 16) -> DataFrame:
    """Each channel moved by the table's entry at the pixel's grain, within 0 to 255; alpha stays."""
    spot = (C.div(F.col("y"), grain[1]) % size) * size + C.div(F.col("x"), grain[0]) % size
    move = _at(bayer(size, intensity), spot)
    return pixels.withColumns({c: C.clamp(F.col(c) + move) for c in "rgb"})


def noisy(pixels: DataFrame, intensity: float = 0.25, grain: tuple[int, int] = (1, 1), size: int = 64) -> DataFrame:
    """The same with a noise tile, each channel by its own entry."""
    spot = (C.div(F.col("y"), grain[1]) % size) * size + C.div(F.col("x"), grain[0]) % size
    table = noise(size, 3, intensity)
    return pixels.withColumns({c: C.clamp(F.col(c) + _at(table, spot * 3 + k)) for k, c in enumerate("rgb")})


BLOCK = 32  # images that one task diffuses at a time


def _nearest(colors: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """The first nearest row of the palette to each colour."""
    return ((colors[:, None, :] - palette[None]) ** 2).sum(axis=2).argmin(axis=1)


def diffused_pens(images: np.ndarray, palette: np.ndarray, even_forward: bool = True, carry: float = 0.9) -> np.ndarray:
    """Pens of images (n, h, w, 4) by serpentine error diffusion: 7, 3, 5 and 1 sixteenths of the carried share.

    A pixel is worked on in all images at a time.  One of alpha 0 gets pen -1 and passes no error on.
    """
    n, h, w = images.shape[:3]
    work = images[:, :, :, :3].astype(np.float64).copy()
    solid = images[:, :, :, 3] > 0
    pens = np.full((n, h, w), -1, np.int64)
    for y in range(h):
        step = 1 if (y % 2 == 0) == even_forward else -1
        for x in range(w) if step > 0 else range(w - 1, -1, -1):
            on = solid[:, y, x]
            if not on.any():
                continue
            c = np.clip(work[on, y, x], 0, 255)
            k = _nearest(c, palette)
            pens[on, y, x] = k
            e = (c - palette[k]) * carry / 16
            for dx, dy, weight in ((step, 0, 7), (-step, 1, 3), (0, 1, 5), (step, 1, 1)):
                if 0 <= x + dx < w and y + dy < h:
                    work[on, y + dy, x + dx] += e * weight
    return pens


def _share(error: np.ndarray, weight: int) -> np.ndarray:
    """Sixteenths of an error, towards zero."""
    return np.sign(error) * (np.abs(error) * weight // 16)


def diffused_grains(images: np.ndarray, palette: np.ndarray, grain: tuple[int, int] = (1, 1), intensity: float = 1.0) -> np.ndarray:
    """Images (n, h, w, 3) of whole numbers after serpentine error diffusion by grains, even rows forward.

    Every pixel of a grain takes in its error; what leaves 0 to 255 is passed on with the
    distance of the grain's mean to the palette, 7, 1, 5 and 3 sixteenths, each cut to a whole number.
    """
    n, h, w = images.shape[:3]
    gw, gh = grain
    out = images.astype(np.int64).copy()
    rows, columns, size = h // gh, w // gw, gw * gh
    shift = size.bit_length() - 1
    errors = np.zeros((2, n, columns + 2, 3), np.int64)
    for y in range(rows):
        now, later = errors[y % 2], errors[(y + 1) % 2]
        later[:] = 0
        step = 1 if y % 2 == 0 else -1
        for x in range(columns) if step > 0 else range(columns - 1, -1, -1):
            block = out[:, y * gh : (y + 1) * gh, x * gw : (x + 1) * gw].reshape(n, size, 3) + now[:, None, x + 1]
            held = np.clip(block, 0, 255)
            out[:, y * gh : (y + 1) * gh, x * gw : (x + 1) * gw] = held.reshape(n, gh, gw, 3)
            mean = held.sum(axis=1) >> shift
            near = palette[_nearest(mean, palette)].astype(np.int64)
            error = np.trunc(((block - held).sum(axis=1) >> shift) + (mean - near) * intensity).astype(np.int64)
            now[:, x + 1 + step] += _share(error, 7)
            later[:, x + 1 + step] += _share(error, 1)
            later[:, x + 1] += _share(error, 5)
            later[:, x + 1 - step] += _share(error, 3)
    return out


def _stacked(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Images of a block as one array, and each row's image, y and x."""
    ids, k = np.unique(pdf["image_id"].to_numpy(), return_inverse=True)
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    images = np.zeros((len(ids), y.max() + 1, x.max() + 1, 4), np.int64)
    images[k, y, x] = pdf[["r", "g", "b", "a"]].to_numpy()
    return images, k, y, x


def diffusion(pixels: DataFrame, palette: list[tuple[int, int, int, int]], even_forward: bool = True, carry: float = 0.9) -> DataFrame:
    """image_id, x, y, pen: error diffusion, in order within an image and parallel over images.

    even_forward: symbols go forward on even rows, indexed images on odd ones.  A group is a
    block of images, so frames should be of some megapixels at most.
    """
    table = np.array([p[1:] for p in palette], np.float64)
    names = np.array([p[0] for p in palette])

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        images, k, y, x = _stacked(pdf)
        pens = diffused_pens(images, table, even_forward, carry)[k, y, x]
        return pd.DataFrame({"image_id": pdf["image_id"], "x": x, "y": y, "pen": np.where(pens < 0, -1, names[pens])})

    return pixels.groupBy(C.div(F.col("image_id"), BLOCK)).applyInPandas(some, "image_id long, x long, y long, pen long")


def grain_diffusion(pixels: DataFrame, palette: list[tuple[int, int, int, int]], grain: tuple[int, int] = (1, 1), intensity: float = 1.0) -> DataFrame:
    """Pixels after error diffusion by grains; widths and heights are multiples of the grain's."""
    table = np.array([p[1:] for p in palette], np.int64)

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        images, k, y, x = _stacked(pdf)
        moved = diffused_grains(images[:, :, :, :3], table, grain, intensity)[k, y, x]
        return pd.DataFrame({"image_id": pdf["image_id"], "x": x, "y": y, "r": moved[:, 0], "g": moved[:, 1], "b": moved[:, 2], "a": pdf["a"].to_numpy()})

    return pixels.groupBy(C.div(F.col("image_id"), BLOCK)).applyInPandas(some, "image_id long, x long, y long, r long, g long, b long, a long")
