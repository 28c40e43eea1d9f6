"""Dynamic palettes: colour bins, greedy pairwise merging, and clean-up."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color as C

# Samples and bits a channel by quality 1 to 9.
QUALITY = {1: (1 << 14, 3), 2: (1 << 15, 3), 3: (1 << 16, 4), 4: (1 << 17, 4), 5: (1 << 18, 4), 6: (1 << 19, 5), 7: (1 << 20, 5), 8: (1 << 21, 5), 9: (1 << 26, 5)}


def color_bins(pixels: DataFrame, bits: int = 4, step: int = 1) -> DataFrame:
    """image_id, bin, n and mean channels of every step-th opaque pixel, by its channels' upper bits."""
    i = F.col("y") * 65536 + F.col("x")
    cut = lambda c: F.shiftright(F.col(c), 8 - bits)
    key = (cut("r") * (1 << 2 * bits) + cut("g") * (1 << bits) + cut("b")).alias("bin")
    kept = pixels.where("a > 127").where(F.pmod(i, F.lit(step)) == 0) if step > 1 else pixels.where("a > 127")
    return kept.groupBy("image_id", key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"sum_{c}") for c in "rgb"))


# Weights of the channels, and rows that turn them into brightness and chroma.
CHANNELS = np.array([0.299, 0.587, 0.114])
CHROMA = np.array([[0.299, 0.587, 0.114], [-0.14713, -0.28886, 0.436], [0.615, -0.51499, -0.10001]])


def weighing(n_bins: int, wanted: int) -> tuple[np.ndarray, int]:
    """What a squared difference counts for in each channel, and how counts are flattened: 0 not at
    all, 1 by the square root, 2 the same cut to whole numbers, -1 by the cube root so cut.

    Half of the weight is the channel's, half its squared shares of brightness and chroma.
    With very many bins a colour the channels count alike.
    """
    flat = min(0.9, wanted / max(n_bins, 1)) < 0.03
    root = -1 if wanted < 16 else 0 if flat and wanted >= 64 else 2 if wanted < 64 else 1
    return 0.5 * ((np.ones(3) if flat else CHANNELS) + (CHROMA**2).sum(axis=0)), root


def merged(mean: np.ndarray, count: np.ndarray, wanted: int) -> np.ndarray:
    """Colours left after pairs with the least weighted error n1 n2 / (n1 + n2) d^2 are merged greedily.

    Each entry keeps its nearest later neighbour in a heap and looks again when either side
    has changed.
    """
    weight, root = weighing(len(mean), wanted)
    mean, count = mean.astype(np.float64).copy(), count.astype(np.float64).copy()
    count = {0: count, 1: np.sqrt(count), 2: np.floor(np.sqrt(count)), -1: np.floor(np.cbrt(count))}[root]
    alive, version, left = np.ones(len(mean), bool), np.zeros(len(mean), np.int64), len(mean)

    def nearest(k: int) -> tuple[float, int]:
        later = np.flatnonzero(alive[k + 1 :]) + k + 1
        if not len(later):
            return np.inf, -1
        err = ((mean[later] - mean[k]) ** 2) @ weight
        err *= count[later] * count[k] / (count[later] + count[k])
        j = int(err.argmin())
        return float(err[j]), int(later[j])

    heap = []
    for k in range(len(mean)):
        e, j = nearest(k)
        if j >= 0:
            heap.append((e, k, j, 0, 0))
    heapq.heapify(heap)
    while left > wanted and heap:
        e, k, j, vk, vj = heapq.heappop(heap)
        if not alive[k]:
            continue
        if not alive[j] or version[k] != vk or version[j] != vj:
            e, j = nearest(k)
            if j >= 0:
                heapq.heappush(heap, (e, k, j, version[k], version[j]))
            continue
        n = count[k] + count[j]
        mean[k] = np.rint(mean[k] * count[k] + mean[j] * count[j]) / n
        count[k], alive[j] = n, False
        version[k] += 1
        left -= 1
        e, j = nearest(k)
        if j >= 0:
            heapq.heappush(heap, (e, k, j, version[k], version[j]))
    return mean[alive]


def cleaned(colors: np.ndarray, transparent: int | None = None) -> np.ndarray:
    """Colours without neighbours that are the same on a scale of 0 to 100.

    transparent: the pen kept for transparency; its colour moves to the end, or, where all
    256 are taken, replaces the first of the pair that is most alike.
    """
    kept, pair, least = colors[:1].tolist(), 0, None
    for c in colors[1:].tolist():
        differ = sum((a * 100 // 256 - b * 100 // 256) ** 2 for a, b in zip(kept[-1], c, strict=True))
        if not differ:
            continue
        if least is None or differ < least:
            pair, least = len(kept) - 1, differ
        kept.append(c)
    if transparent is not None and transparent < len(kept):
        if len(kept) < 256:
            kept.append(kept[transparent])
        else:
            kept[pair] = kept[transparent]
    return np.array(kept, np.int64).reshape(-1, 3)


def sample_step(n_pixels: int, quality: int) -> int:
    """Every how many pixels one is sampled; small steps aren't worth it."""
    step = n_pixels // QUALITY[quality][0]
    return step if step > 4 else 1


def generated_palette(pixels: DataFrame, colors: int = 255, quality: int = 5, n_pixels: int = 4096, transparent: int | None = None) -> DataFrame:
    """image_id, pen, r, g, b: a palette for each image of about n_pixels; bins are summed before they meet in a task."""
    bins = color_bins(pixels, QUALITY[quality][1], sample_step(n_pixels, quality))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        mean = pdf[["sum_r", "sum_g", "sum_b"]].to_numpy() / pdf[["n"]].to_numpy()
        out = cleaned(merged(mean, pdf["n"].to_numpy(), colors).astype(np.int64), transparent)
        return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "pen": np.arange(len(out)), "r": out[:, 0], "g": out[:, 1], "b": out[:, 2]})

    return bins.groupBy("image_id").applyInPandas(one, "image_id long, pen long, r long, g long, b long")


def with_own_palette(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels with the nearest pen of their image's palette (image_id, pen, r, g, b), the last of equals.

    A palette is an array of at most 256 colours on one row an image.
    """
    entry = F.struct("pen", "r", "g", "b")
    tables = palette.groupBy(F.col("image_id").alias("t_image")).agg(F.array_sort(F.collect_list(entry)).alias("t_pens"))
    rgb = tuple(map(F.col, "rgb"))
    best = F.array_min(F.transform("t_pens", lambda p: C.squared_error(rgb, (p["r"], p["g"], p["b"])) * 4096 + (4095 - p["pen"])))
    return pixels.join(tables, F.col("image_id") == F.col("t_image")).withColumn("pen", 4095 - best % 4096).drop("t_image", "t_pens")


def principal_axes(points: np.ndarray, axes: int = 2, steps: int = 1000, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Main directions of centred points by power iteration, and the mean."""
    mean = points.mean(axis=0)
    rest, out = points - mean, []
    for _ in range(axes):
        v = np.ones(points.shape[1]) / np.sqrt(points.shape[1])
        for _ in range(steps):
            new = rest.T @ (rest @ v)
            size = np.linalg.norm(new)
            if size == 0:
                break
            new /= size
            done = np.abs(new - v).max() < tolerance
            v = new
            if done:
                break
        out.append(v)
        rest = rest - np.outer(rest @ v, v)
    return np.array(out), mean


def axes_of(palette: DataFrame) -> DataFrame:
    """image_id and the two main directions and the mean of each image's palette."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        axes, mean = principal_axes(pdf.sort_values("pen")[["r", "g", "b"]].to_numpy(np.float64))
        row = {"image_id": pdf["image_id"].iloc[0], **{f"e{k}{c}": axes[k][i] for k in (0, 1) for i, c in enumerate("rgb")}, **{f"m{c}": mean[i] for i, c in enumerate("rgb")}}
        return pd.DataFrame([row])

    names = [f"e{k}{c}" for k in (0, 1) for c in "rgb"] + [f"m{c}" for c in "rgb"]
    return palette.groupBy("image_id").applyInPandas(one, "image_id long, " + ", ".join(f"{n} double" for n in names))


def pens_by_axis(palette: DataFrame) -> DataFrame:
    """palette with place, a pen's number along its image's first direction, ties by pen."""
    axes = axes_of(palette).select(F.col("image_id").alias("x_image"), "e0r", "e0g", "e0b")
    along = sum((F.col(c) * F.col(f"e0{c}") for c in "gb"), F.col("r") * F.col("e0r"))
    order = Window.partitionBy("image_id").orderBy("v0", "pen")
    joined = palette.join(axes, F.col("image_id") == F.col("x_image")).withColumn("v0", along).drop("x_image", "e0r", "e0g", "e0b")
    return joined.withColumn("place", F.row_number().over(order))
