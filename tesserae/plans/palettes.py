"""Fixed palettes, by formula."""

from __future__ import annotations

FG, BG, TRANSPARENT = 257, 258, 256


def palette16() -> list[tuple[int, int, int, int]]:
    """pen, r, g, b: dark colours by the bits of the pen, then bright ones."""
    out = []
    for pen in range(16):
        on, off = (255, 64) if pen >= 8 else (160, 0)
        out.append((pen, *(on if pen >> k & 1 else off for k in range(3))))
    return out


def cube_level(level: int) -> int:
    return 55 + 40 * level if level else 0


def palette256() -> list[tuple[int, int, int, int]]:
    cube = [(16 + 36 * r + 6 * g + b, cube_level(r), cube_level(g), cube_level(b)) for r in range(6) for g in range(6) for b in range(6)]
    grays = [(232 + k, *(8 + 10 * k,) * 3) for k in range(24)]
    return palette16() + cube + grays


def in_tie_order(palette: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Cube, grays, then the first 16: the first of equals wins."""
    return sorted(palette, key=lambda p: (p[0] < 16, p[0]))
