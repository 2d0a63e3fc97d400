"""Plans as closed outlines: traced from masks, simplified, checked for crossings, written as SVG and filled again.

Points are whole numbers in half pixels, (2 y, 2 x) at the centre of a pixel, so all tests are exact. An outline runs at half height
between pixels in the mask and others; the mask lies to its left. Pixels of the mask that touch at corners only are apart.
"""

from __future__ import annotations

import re

import numpy as np

from . import grids

#: Of a square of pixels a b / c d, by a + 2 b + 4 c + 8 d: from which of its sides (top, left, right, bottom) to which an outline runs.
SEGMENTS = {
    1: ["LT"], 2: ["TR"], 4: ["BL"], 8: ["RB"], 14: ["TL"], 13: ["RT"], 11: ["LB"], 7: ["BR"],
    3: ["LR"], 12: ["RL"], 5: ["BT"], 10: ["TB"], 9: ["LT", "RB"], 6: ["TR", "BL"],
}
#: Where a square's sides are, in half pixels from the centre of a.
SIDES = {"T": (0, 1), "L": (1, 0), "R": (1, 2), "B": (2, 1)}
#: The same by square, first or second outline, and place: where it starts and ends; -1 where a square has none.
ENDS = np.array([[SIDES[way[0]] + SIDES[way[1]] if way else (-1,) * 4 for way in (SEGMENTS.get(k, []) + ["", ""])[:2]] for k in range(16)])


def rings(mask: np.ndarray) -> list[np.ndarray]:
    """The outlines of a mask as arrays of points (2 y, 2 x), each from its first point in reading order on, without points on straight lines."""
    m = np.pad(mask.astype(bool), 1).astype(np.int64)
    code = m[:-1, :-1] + 2 * m[:-1, 1:] + 4 * m[1:, :-1] + 8 * m[1:, 1:]
    width = 2 * m.shape[1]
    after = np.full(2 * m.shape[0] * width, -1, np.int64)
    y, x = np.nonzero((code > 0) & (code < 15))
    ends = ENDS[code[y, x]] + 2 * np.stack([y, x, y, x], axis=1)[:, None]
    y1, x1, y2, x2 = ends[ENDS[code[y, x], :, 0] >= 0].T
    after[y1 * width + x1] = y2 * width + x2
    points = np.flatnonzero(after >= 0)
    follow, seen, out = dict(zip(points.tolist(), after[points].tolist(), strict=True)), set(), []
    for p in points.tolist():
        if p in seen:
            continue
        ring = [p]
        while (p := follow[p]) != ring[0]:
            ring.append(p)
        seen.update(ring)
        found = np.stack(np.divmod(np.array(ring), width), axis=1) - 2  # the frame is one pixel wide
        back, ahead = found - np.roll(found, 1, axis=0), np.roll(found, -1, axis=0) - found
        out.append(found[(back != ahead).any(axis=1)])
    return out


def simplified(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Points of a ring so that no dropped one is more than ``tolerance`` pixels off the line between its neighbours: the first stays,
    and of each stretch the point that deviates most (ties: the first), while that is too much."""
    if tolerance <= 0 or len(ring) < 3:
        return ring
    line = np.concatenate([ring, ring[:1]]).astype(np.float64) / 2
    kept, todo = np.zeros(len(line), bool), [(0, len(line) - 1)]
    kept[[0, -1]] = True
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, step, p = line[i], line[j] - line[i], line[i + 1 : j]
        t = np.clip((p - a) @ step / max(step @ step, 1e-300), 0, 1)
        off = np.hypot(*(p - a - t[:, None] * step).T)
        k = int(off.argmax())
        if off[k] > tolerance:
            kept[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return ring[kept[:-1]]


def _turn(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sign((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0]))


def _between(a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((np.minimum(a, b) <= p) & (p <= np.maximum(a, b))).all(axis=1)


def is_simple(ring: np.ndarray) -> bool:
    """:func:`are_simple` of one ring."""
    return bool(are_simple([ring])[0])


def are_simple(rings_: list[np.ndarray]) -> np.ndarray:
    """Whether each ring is the outline of an area: three points or more, and no two of its sides meet but neighbours at their common point.

    Rings lie side by side. Sides are sorted by their left ends, and each is compared with those that begin before it ends.
    """
    size = np.array([len(r) for r in rings_], np.int64)
    good = size >= 3
    if not good.any():
        return good
    held = [r for r in rings_ if len(r) >= 3]
    own, size = np.repeat(np.flatnonzero(good), size[good]), size[good]
    a, end = np.concatenate(held), np.cumsum(size)
    after = np.arange(1, len(a) + 1)
    after[end - 1] = end - size
    a = a + np.stack([np.zeros(len(a), np.int64), own * (np.ptp(a[:, 1]) + 1)], axis=1)  # no two rings share a column
    b = a[after]
    number = np.arange(len(a))
    low, high = np.minimum(a[:, 1], b[:, 1]), np.maximum(a[:, 1], b[:, 1])
    order = np.argsort(low, kind="stable")
    ahead = np.searchsorted(low[order], high[order], "right") - number - 1
    good[own[(a == b).all(axis=1)]] = False
    for at in range(0, len(a), 4096):
        part = number[at : at + 4096]
        i = np.repeat(part, ahead[part])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(ahead[part]) - ahead[part], ahead[part])
        i, j = order[i], order[j]
        near = (np.maximum(np.minimum(a[i, 0], b[i, 0]), np.minimum(a[j, 0], b[j, 0])) <= np.minimum(np.maximum(a[i, 0], b[i, 0]), np.maximum(a[j, 0], b[j, 0])))
        i, j = i[near], j[near]
        p, q, s, t = a[i], b[i], a[j], b[j]
        next_, last = after[i] == j, after[j] == i
        # neighbours may share a point only: neither's far end lies on the other
        spike = np.where(next_, ((_turn(p, q, t) == 0) & _between(p, q, t)) | ((_turn(s, t, p) == 0) & _between(s, t, p)), False)
        spike |= np.where(last, ((_turn(p, q, s) == 0) & _between(p, q, s)) | ((_turn(s, t, q) == 0) & _between(s, t, q)), False)
        d1, d2, d3, d4 = _turn(p, q, s), _turn(p, q, t), _turn(s, t, p), _turn(s, t, q)
        meet = (d1 * d2 < 0) & (d3 * d4 < 0)
        for d, x, y, z in ((d1, p, q, s), (d2, p, q, t), (d3, s, t, p), (d4, s, t, q)):
            meet |= (d == 0) & _between(x, y, z)
        good[own[i[spike | (meet & ~next_ & ~last)]]] = False
    return good


def filled(outlines: list[np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The pixels whose centres lie inside by the even-odd rule: an odd number of sides cross their row at or left of them."""
    h, w = shape
    turns = np.zeros((h, w + 1), np.int64)
    sides = [np.stack([r, np.roll(r, -1, axis=0)], axis=1) for r in outlines if len(r)]
    if not sides:
        return turns[:, :w] > 0
    (y1, x1), (y2, x2) = np.concatenate(sides).transpose(1, 2, 0)
    up = y2 < y1
    y1, y2, x1, x2 = np.where(up, y2, y1), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, x1, x2)
    first, end = np.clip(-(-y1 // 2), 0, h), np.clip(-(-y2 // 2), 0, h)  # rows y with y1 <= 2 y < y2
    n = np.maximum(end - first, 0)
    k = np.repeat(np.arange(len(n)), n)
    row = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
    over = x1[k] * (y2 - y1)[k] + (2 * row - y1[k]) * (x2 - x1)[k]  # where the side crosses, times its height
    np.add.at(turns, (row, np.clip(-(-over // (2 * (y2 - y1)[k])), 0, w)), 1)
    return turns.cumsum(axis=1)[:, :w] % 2 == 1


def svg(m: np.ndarray, colours: list[str], ground: int, tolerance: float = 1.0, mm: float = 200.0, backing: int = 0, backing_colour: str = "#1a1a1a") -> str:
    """A plan: one group of closed paths for each label but ``ground``, in the order of ``colours`` (by label). With ``backing``, below them a
    sheet of the figure grown by so many pixels."""
    h, w = m.shape
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{mm:g}mm" height="{mm * h / max(w, 1):g}mm" viewBox="0 0 {w} {h}">', f'<rect width="{w}" height="{h}" fill="#ffffff"/>']
    sheets = [("backing", backing_colour, grids.disk_grown(m != ground, backing))] if backing and (m != ground).any() else []
    sheets += [(f"sheet{k}", colours[k], m == k) for k in range(len(colours)) if k != ground]
    for name, colour, mask in sheets:
        lines = [simplified(r, tolerance) for r in rings(mask)]
        d = " ".join("M" + " L".join(f"{x / 2:.1f},{y / 2:.1f}" for y, x in r.tolist()) + " Z" for r in lines if len(r) >= 3)
        if d:
            out.append(f'<g id="{name}" fill="{colour}" fill-rule="evenodd"><path d="{d}"/></g>')
    return "".join(out) + "</svg>"


def paths(text: str) -> list[tuple[str, list[np.ndarray]]]:
    """Colour and rings, in half pixels, of each path of a plan."""
    out = []
    for colour, d in re.findall(r'fill="(#[0-9a-f]{6})" fill-rule="evenodd"><path d="([^"]*)"', text):
        rings_ = [np.array([[round(2 * float(v)) for v in p.split(",")][::-1] for p in sub.split(" L")]) for sub in re.findall(r"M([^Z]+?) Z", d)]
        out.append((colour, rings_))
    return out


def painted(text: str, colours: list[str], ground: int, found: list[tuple[str, list[np.ndarray]]] | None = None) -> np.ndarray:
    """The label map that a plan shows: paths in their order over the ground; colours that are no label's (a backing sheet) show ground. ``found``: its
    :func:`paths`, where they are read already."""
    w, h = map(int, re.search(r'viewBox="0 0 (\d+) (\d+)"', text).groups())
    m = np.full((h, w), ground, np.int64)
    for colour, outlines in paths(text) if found is None else found:
        m[filled(outlines, (h, w))] = colours.index(colour) if colour in colours else ground
    return m


def checks(text: str, found: list[tuple[str, list[np.ndarray]]] | None = None) -> dict[str, int]:
    """The number of closed paths of a plan, and of those that aren't the outline of an area."""
    every = [r for _, own in (paths(text) if found is None else found) for r in own]
    return {"paths": len(every), "invalid_paths": int((~are_simple(every)).sum())}
