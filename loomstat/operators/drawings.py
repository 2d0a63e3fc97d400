"""Line drawings as masks: strokes of one width, and what may happen to a drawing on its way to a plan."""

from __future__ import annotations

import numpy as np

from . import grids, projection

#: What :func:`perturbed` does to a drawing.
KINDS = ("broken", "thick", "thin", "jitter")


def gapped(ink: np.ndarray, n: int, r: float, draw: np.random.Generator) -> np.ndarray:
    """Without the disks of radius ``r`` around ``n`` drawn pixels of the lines, or all if there are fewer."""
    y, x = np.nonzero(ink)
    if not len(y):
        return ink
    at = draw.choice(len(y), min(n, len(y)), replace=False)
    centre = np.zeros(ink.shape, bool)
    centre[y[at], x[at]] = True
    return ink & ~grids.disk_grown(centre, r)


def blurred(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean to four ``sigma``, the picture mirrored beyond its edges."""
    r = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    weight /= weight.sum()

    def along(a: np.ndarray) -> np.ndarray:
        framed = np.pad(a, ((r, r), (0, 0)), mode="symmetric")
        sums = np.zeros_like(a)
        for i, k in enumerate(weight):
            sums += k * framed[i : i + len(a)]
        return sums

    return along(along(v).T).T


def displaced(ink: np.ndarray, amplitude: float, sigma: float, draw: np.random.Generator) -> np.ndarray:
    """Lines moved by a smooth random field of up to ``amplitude`` pixels: each pixel looks up where it came from, between the four pixels
    around that place; beyond the picture is none."""
    h, w = ink.shape
    field = []
    for _ in range(2):
        f = blurred(draw.normal(size=(h, w)), sigma)
        field.append(f * (amplitude / (np.abs(f).max() + 1e-8)))
    y, x = np.arange(h)[:, None] + field[0], np.arange(w) + field[1]
    inside = (y >= 0) & (y <= h - 1) & (x >= 0) & (x <= w - 1)
    top, left = np.clip(np.floor(y).astype(int), 0, h - 1), np.clip(np.floor(x).astype(int), 0, w - 1)
    down, right = np.minimum(top + 1, h - 1), np.minimum(left + 1, w - 1)
    dy, dx, v = y - top, x - left, ink.astype(float)
    between = (1 - dy) * ((1 - dx) * v[top, left] + dx * v[top, right]) + dy * ((1 - dx) * v[down, left] + dx * v[down, right])
    return inside & (between > 0.5)


def perturbed(ink: np.ndarray, kind: str, seed: int, gaps: int = 80, gap: float = 12, grow: float = 3, amplitude: float = 6, sigma: float = 40, few: int = 15) -> np.ndarray:
    """``broken``: with gaps; ``thick``: grown; ``thin``: one pixel wide; ``jitter``: displaced, with a few smaller gaps. Sizes are for 1,024 pixels."""
    draw = np.random.default_rng(seed)
    if kind == "broken":
        return gapped(ink, gaps, gap, draw)
    if kind == "thick":
        return grids.disk_grown(ink, grow)
    if kind == "thin":
        return projection.skeleton(ink)
    return gapped(displaced(ink, amplitude, sigma, draw), few, gap / 2, draw)


def fragments(ink: np.ndarray) -> tuple[np.ndarray, int]:
    """Thinned lines without their junctions (three neighbours or more): the number of each pixel's fragment, from 1, or 0; corners connect."""
    thin = projection.skeleton(ink)
    n = sum(projection._shifted(thin, dy, dx, False).astype(int) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    apart = thin & (n < 3)
    p = grids.labelled(apart, eight=True)
    ids, number = np.unique(p[apart], return_inverse=True)
    out = np.zeros(ink.shape, np.int64)
    out[apart] = number + 1
    return out, len(ids)


def fragmented(ink: np.ndarray, seed: int, drop: float = 0.25, gaps: int = 60, gap: float = 10) -> tuple[np.ndarray, int, int]:
    """Lines near what is left when a share of the fragments is dropped and gaps are made; also the fragments, and those kept."""
    draw = np.random.default_rng(seed)
    number, n = fragments(ink)
    keep = np.r_[False, draw.random(n) >= drop]
    left = gapped(keep[number], gaps, gap, draw)
    grown = left
    for _ in range(2):
        grown = projection.dilated(grown, 1)
    return ink & grown, n, int(keep.sum())


def strokes(grey: np.ndarray, width: int = 3, least: int = 16, most: int = 216) -> tuple[np.ndarray, int]:
    """Lines of one ``width`` from a grey picture (whole numbers from 0): its darker class by Otsu's threshold, ``most`` at most, without pieces
    under ``least`` pixels, thinned and grown again; and the threshold."""
    level, n = np.unique(grey, return_counts=True)
    w0, s0 = np.cumsum(n)[:-1], np.cumsum(n * level)[:-1]
    w, s = n.sum(), (n * level).sum()
    if not len(w0):
        return np.zeros(grey.shape, bool), int(level[0])
    spread = w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) ** 2
    t = min(int(level[:-1][spread.round(6).argmax()]), most)
    dark = grey <= t
    p = grids.labelled(dark)
    dark &= np.bincount(p.ravel())[p] >= least
    return projection.dilated(projection.skeleton(dark), width // 2), t
