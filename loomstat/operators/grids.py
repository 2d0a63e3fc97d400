"""Label maps and masks as arrays of one picture: labelling, nearest pixels and edges, in time linear in the pixels.

``raster`` and ``projection`` apply these to pictures as groups of pixel rows.
"""

from __future__ import annotations

import numpy as np


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the set of each of ``n`` numbers, where pairs of ``a`` and ``b`` are in one set: union by least member, with
    paths halved on the way."""
    root = list(range(n))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x < y:
            root[y] = x
        else:
            root[x] = y
    top = np.array(root, np.int64)
    while True:
        over = top[top]
        if (over == top).all():
            return top
        top = over


def labelled(m: np.ndarray, eight: bool = False) -> np.ndarray:
    """Connected pieces of equal value, numbered from 0 in reading order of their first pixels; ``eight``: corners connect too. Pictures of a stack are
    numbered one after another.

    Rows are cut into runs of one value, and runs that touch in neighbouring rows are united, once for each place where they meet.
    """
    if not m.size:
        return np.zeros(m.shape, np.int64)
    shape, m = m.shape, m.reshape(-1, m.shape[-1])
    joins = np.ones((len(m) - 1, 1), bool)  # whether a row and the next are of one picture
    joins[shape[-2] - 1 :: shape[-2]] = False
    starts = np.ones(m.shape, bool)
    starts[:, 1:] = m[:, 1:] != m[:, :-1]
    run = starts.ravel().cumsum().reshape(m.shape) - 1
    same = (m[1:] == m[:-1]) & joins
    meet = same.copy()
    meet[:, 1:] &= starts[1:, 1:] | starts[:-1, 1:] | ~same[:, :-1]
    a, b = [run[:-1][meet]], [run[1:][meet]]
    if eight:
        for here, there in ((np.s_[:-1, :-1], np.s_[1:, 1:]), (np.s_[:-1, 1:], np.s_[1:, :-1])):
            corner = (m[here] == m[there]) & joins & starts[1:, 1:] & starts[:-1, 1:]
            a.append(run[here][corner])
            b.append(run[there][corner])
    top = joined(int(run[-1, -1]) + 1, np.concatenate(a), np.concatenate(b))
    return (np.cumsum(top == np.arange(len(top))) - 1)[top][run].reshape(shape)


def nearest(kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the kept pixel that is nearest to each pixel, the first in reading order of equally near ones; -1 without any.

    First along rows, then down columns, where of the parabolas over the rows' distances the lower envelope is kept, in whole numbers: a
    later row takes over from the first place where it is strictly nearer.
    """
    if kept.ndim == 2:
        y, x = nearest(kept[None])
        return y[0], x[0]
    some = kept.any(axis=(1, 2))
    if not some.all():
        y, x = np.full(kept.shape, -1), np.full(kept.shape, -1)
        if some.any():
            y[some], x[some] = nearest(kept[some])
        return y, x
    n, h, wide = kept.shape
    x = np.arange(wide)
    left = np.maximum.accumulate(np.where(kept, x, -1), axis=2)
    right = np.minimum.accumulate(np.where(kept, x, 3 * wide)[..., ::-1], axis=2)[..., ::-1]
    near = np.where((left >= 0) & (x - left <= right - x), left, right)
    beside = lambda a: a.transpose(1, 0, 2).reshape(h, -1)  # noqa: E731  the pictures of a stack beside each other
    far, near = beside((near - x) ** 2), beside(near)  # read only in rows with a kept pixel
    full, w = np.repeat(kept.any(axis=2).T, wide, axis=1), n * wide
    x = np.arange(w)
    site, start, top = np.zeros((h, w), np.int64), np.zeros((h, w), np.int64), np.full(w, -1)
    for v in range(h):
        own = far[v]
        cols = np.flatnonzero((top >= 0) & full[v])
        while len(cols):  # drop what the new row beats from where it begins
            t = top[cols]
            u, s = site[t, cols], start[t, cols]
            cols = cols[far[u, cols] + (s - u) ** 2 > own[cols] + (s - v) ** 2]
            top[cols] -= 1
            cols = cols[top[cols] >= 0]
        begin = np.zeros(w, np.int64)
        cols = np.flatnonzero((top >= 0) & full[v])
        u = site[top[cols], cols]
        begin[cols] = (own[cols] + v * v - far[u, cols] - u * u) // (2 * (v - u)) + 1
        cols = np.flatnonzero((begin < h) & full[v])
        top[cols] += 1
        site[top[cols], cols] = v
        start[top[cols], cols] = begin[cols]
    rows = np.empty((h, w), np.int64)
    for y in range(h - 1, -1, -1):
        rows[y] = site[top, x]
        top -= start[top, x] == y
    apart = lambda a: a.reshape(h, n, wide).transpose(1, 0, 2)
    return apart(rows), apart(near[rows, x[None]])


def gaps(kept: np.ndarray) -> np.ndarray:
    """The squared distance of each pixel from the nearest kept one; beyond any picture's without one."""
    y, x = nearest(kept)
    far = (y - np.arange(kept.shape[-2])[:, None]) ** 2 + (x - np.arange(kept.shape[-1])) ** 2
    return np.where(y < 0, np.iinfo(np.int64).max, far)


def smoothed(v: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian mean over what lies in the picture, to four ``sigma``."""
    r = int(4 * sigma + 0.5)
    weight = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)

    def along(a: np.ndarray) -> np.ndarray:
        framed = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (0, 0)])
        return sum(k * framed[..., i : i + a.shape[-2], :] for i, k in enumerate(weight))

    def both(a: np.ndarray) -> np.ndarray:
        return along(along(a).swapaxes(-1, -2)).swapaxes(-1, -2)

    return both(v.astype(np.float64)) / both(np.ones(v.shape[-2:]))


def slopes(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel sums down and to the right; edges of the picture repeat."""
    p = np.pad(v, [(0, 0)] * (v.ndim - 2) + [(1, 1), (1, 1)], mode="edge")
    down, right = p[..., 2:, :] - p[..., :-2, :], p[..., 2:] - p[..., :-2]
    return down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:], right[..., :-2, :] + 2 * right[..., 1:-1, :] + right[..., 2:, :]


def ridges(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    """The size of the slope where it is the largest along its direction, 0 elsewhere and at the picture's edge: as large as on both
    sides, whose values lie between that of the neighbour along the steeper axis and of the one at the corner."""
    size = np.hypot(dy, dx)
    out = np.zeros_like(size)
    if min(size.shape[-2:]) < 3:
        return out
    inner = np.s_[..., 1:-1, 1:-1]
    *stack, y, x = np.indices(size.shape, sparse=True)
    y, x, sy, sx = y[..., 1:-1, :], x[..., 1:-1], np.sign(dy[inner]).astype(int), np.sign(dx[inner]).astype(int)
    ay, ax = np.abs(dy[inner]), np.abs(dx[inner])
    steep = ay > ax
    weight = np.minimum(ay, ax) / np.maximum(np.maximum(ay, ax), 1e-300)

    def side(way: int) -> np.ndarray:
        straight = size[*stack, y + way * np.where(steep, sy, 0), x + way * np.where(steep, 0, sx)]
        return (1 - weight) * straight + weight * size[*stack, y + way * sy, x + way * sx]

    top = (side(1) <= size[inner]) & (side(-1) <= size[inner])
    out[inner] = np.where(top, size[inner], 0)
    return out


def edges(v: np.ndarray, sigma: float = 2.0, low: float = 4.0, high: float = 10.0) -> np.ndarray:
    """Edge pixels of one channel: ridges of the smoothed channel's slope of ``low`` or more that hang together, corners too, with
    one of ``high`` or more."""
    ridge = ridges(*slopes(smoothed(v, sigma)))
    weak = ridge >= low
    piece = labelled(weak, eight=True)
    strong = np.zeros(piece.max() + 1 if piece.size else 0, bool)
    strong[piece[ridge >= high]] = True
    return weak & strong[piece]


def edge_map(l: np.ndarray, a: np.ndarray, b: np.ndarray, sigma: float = 2.0) -> np.ndarray:  # noqa: E741
    """Edges of any of the three channels, the colours at six tenths."""
    return edges(l, sigma) | edges(0.6 * a, sigma) | edges(0.6 * b, sigma)


def scores(found: np.ndarray, wanted: np.ndarray, r: float, known: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, float, float]:
    """Share of ``found`` within ``r`` of ``wanted``, of ``wanted`` within ``r`` of ``found``, and F1; all 0 where one has no pixel. ``known``: the
    :func:`gaps` of both. Of stacks: three arrays, with a value for each picture."""
    if found.ndim == 3:
        from_found, from_wanted = known or (gaps(found), gaps(wanted))
        n, m = found.sum((1, 2)), wanted.sum((1, 2))
        some = (n > 0) & (m > 0)
        p = np.where(some, (found & (from_wanted <= r * r)).sum((1, 2)) / np.maximum(n, 1), 0.0)
        q = np.where(some, (wanted & (from_found <= r * r)).sum((1, 2)) / np.maximum(m, 1), 0.0)
        return p, q, np.where(p + q > 0, 2 * p * q / np.where(p + q > 0, p + q, 1), 0.0)
    if not found.any() or not wanted.any():
        return 0.0, 0.0, 0.0
    from_found, from_wanted = known or (gaps(found), gaps(wanted))
    p, q = float((from_wanted[found] <= r * r).mean()), float((from_found[wanted] <= r * r).mean())
    return p, q, 2 * p * q / (p + q) if p + q else 0.0


def disk_grown(m: np.ndarray, r: float) -> np.ndarray:
    """Pixels within ``r`` of the mask."""
    return disks(m, int(r)) if r == int(r) and r <= 16 else gaps(m) <= r * r


def offsets(r: int, disk: bool = True) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if not disk or dy * dy + dx * dx <= r * r]


def voted(m: np.ndarray, r: int, disk: bool = True) -> np.ndarray:
    """The most frequent label around each pixel of a picture or of a stack, ties to the lowest: in a disk with the edge repeated, or in the part of a
    square inside."""
    h, w = m.shape[-2:]
    known = np.unique(m)
    place, frame = np.searchsorted(known, m), [(0, 0)] * (m.ndim - 2) + [(r, r), (r, r)]
    framed = np.pad(place, frame, mode="edge") if disk else np.pad(place, frame, constant_values=-1)
    best, most = np.zeros(m.shape, np.int64), np.full(m.shape, -1, np.int16)
    for k in range(len(known)):
        mine, n = (framed == k).astype(np.int16), np.zeros(m.shape, np.int16)
        for dy, dx in offsets(r, disk):
            n += mine[..., r + dy : r + dy + h, r + dx : r + dx + w]
        more = n > most
        best[more], most[more] = k, n[more]
    return known[best]


def disks(m: np.ndarray, r: int) -> np.ndarray:
    """As :func:`disk_grown` with a small whole radius, of a picture or a stack of them: of each row of the disk, sums along the picture's rows."""
    h, w = m.shape[-2:]
    sums = np.pad(m.astype(np.int32), [(0, 0)] * (m.ndim - 2) + [(r, r), (r + 1, r)]).cumsum(axis=-1)
    out = np.zeros(m.shape, bool)
    for dy in range(-r, r + 1):
        k = int((r * r - dy * dy) ** 0.5)
        rows = sums[..., r + dy : r + dy + h, :]
        out |= rows[..., r + k + 1 : r + k + 1 + w] > rows[..., r - k : r - k + w]
    return out


def disk_shrunk(m: np.ndarray, r: float) -> np.ndarray:
    """Pixels whose whole disk is set; beyond the picture nothing is."""
    k = int(r) + 1
    return ~disk_grown(~np.pad(m, k), r)[k:-k, k:-k]


def delta_e(one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...]) -> np.ndarray:
    """The CIEDE2000 difference of Lab pictures, by its published formula with unit weights."""
    (l1, a1, b1), (l2, a2, b2) = (tuple(np.asarray(c, np.float64) for c in x) for x in (one, two))
    seventh = lambda c: np.sqrt(c**7 / (c**7 + 25.0**7))
    stretch = 1.5 - 0.5 * seventh((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2)
    a1, a2 = a1 * stretch, a2 * stretch
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = (np.degrees(np.arctan2(b, a)) % 360 for a, b in ((a1, b1), (a2, b2)))
    grey, gap, both = c1 * c2 == 0, h2 - h1, h1 + h2
    turn = np.where(grey, 0, np.where(abs(gap) <= 180, gap, gap - 360 * np.sign(gap)))
    hue = np.where(grey, both, np.where(abs(gap) <= 180, both / 2, (both + np.where(both < 360, 360, -360)) / 2))
    light, chroma = (l1 + l2) / 2 - 50, (c1 + c2) / 2
    t = 1 + sum(k * np.cos(np.radians(n * hue + off)) for k, n, off in ((-0.17, 1, -30), (0.24, 2, 0), (0.32, 3, 6), (-0.20, 4, -63)))
    dl = (l2 - l1) / (1 + 0.015 * light**2 / np.sqrt(20 + light**2))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dh = 2 * np.sqrt(c1 * c2) * np.sin(np.radians(turn) / 2) / (1 + 0.015 * chroma * t)
    turned = -2 * seventh(chroma) * np.sin(np.radians(60 * np.exp(-(((hue - 275) / 25) ** 2))))
    return np.sqrt(np.maximum(dl**2 + dc**2 + dh**2 + turned * dc * dh, 0))


def matched(l: np.ndarray, a: np.ndarray, b: np.ndarray, palette: np.ndarray, first: int = 3) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """The palette colour of each pixel, and its CIEDE2000 difference: of the ``first`` closest by distance the one with the least difference, ties to
    the closer one, and of equally close ones to the lower number."""
    far = np.stack([np.sqrt((l - p) ** 2 + (a - q) ** 2 + (b - r) ** 2) for p, q, r in palette])
    far[np.isnan(far)] = np.inf
    best, least = None, None
    for i in range(min(first, len(palette))):
        k = far.argmin(axis=0)[None]
        np.put_along_axis(far, k, np.inf, axis=0)
        de = delta_e((l, a, b), tuple(np.moveaxis(palette[k[0]], -1, 0)))
        best, least = (k[0], de) if not i else (np.where(de < least, k[0], best), np.where(de < least, de, least))
    return best, least
