"""Canvas settings, fixed before a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, replace

MODES = ("truecolor", "256", "240", "16", "16/8", "8", "fgbg_bgfg", "fgbg")
PIXEL_MODES = ("symbols", "sixels", "kitty", "iterm2")
DITHERS = ("none", "ordered", "diffusion", "noise")
#: Base dither intensity by colour mode.
DITHER_BASE = {"truecolor": 1.0, "256": 0.1, "240": 0.1, "16": 0.25, "16/8": 0.25, "8": 0.5, "fgbg_bgfg": 1.0, "fgbg": 1.0}
#: Share of pixels, in percent, trimmed at either end of the histogram.
CROP_PERCENT = {"16": 5, "16/8": 5, "8": 10, "fgbg_bgfg": 20, "fgbg": 20}


@dataclass(frozen=True)
class CanvasConfig:
    width: int = 80
    height: int = 24
    cell_width: int = 8
    cell_height: int = 8
    mode: str = "truecolor"
    pixel_mode: str = "symbols"
    color_space: str = "rgb"
    extractor: str = "average"
    dither: str = "none"
    dither_grain: tuple[int, int] = (4, 4)
    dither_intensity: float = 1.0
    fg: int = 0xFFFFFF
    bg: int = 0x000000
    fg_only: bool = False
    alpha_threshold: int = 127
    work: int = 5
    preprocess: bool = True
    symbols: str = "block+border+space-wide"
    fill: str = ""

    def __post_init__(self):
        for value, known, what in ((self.mode, MODES, "mode"), (self.pixel_mode, PIXEL_MODES, "pixel_mode"), (self.dither, DITHERS, "dither")):
            if value not in known:
                raise ValueError(f"unknown {what}: {value}")
        if self.width < 0 or self.height < 0 or not 1 <= self.work <= 9:
            raise ValueError("size or work out of range")
        if self.mode == "truecolor" and self.pixel_mode != "sixels":  # colours are exact: nothing to dither
            object.__setattr__(self, "dither", "none")
            object.__setattr__(self, "color_space", "rgb")

    def similar(self, **changes) -> CanvasConfig:
        return replace(self, **changes)

    @property
    def work_factor(self) -> int:
        """0 to 10; from 8 on every symbol is tried, below 3 pixels are sampled."""
        return int(10 * (self.work - 1) / 8 + 0.5)

    @property
    def candidates(self) -> int | None:
        """How many symbols go from the bitmap ranking to the colour error; None: all."""
        return None if self.work_factor >= 8 else max(1, self.work_factor)
