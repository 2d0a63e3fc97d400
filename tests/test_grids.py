"""Labelling, nearest pixels, edges and traced plans against plain loops over pixels."""


import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomstat.operators import grids, tracing
from test_pictures import EIGHT, FOUR, brute_edges, comps

SIZES = [(1, 1), (1, 9), (9, 1), (7, 12), (24, 24), (64, 64)]


def noise(shape, labels, seed, block=1):
    draw = np.random.default_rng(seed)
    small = draw.integers(0, labels, (-(-shape[0] // block), -(-shape[1] // block)))
    return np.kron(small, np.ones((block, block), int))[: shape[0], : shape[1]]


@pytest.mark.parametrize("shape", SIZES)
@pytest.mark.parametrize("eight", [False, True])
def test_labelled_brute(shape, eight):
    for seed in range(4):
        m = noise(shape, 2 + seed, seed, 1 + seed % 3)
        got = grids.labelled(m, eight)
        every = sorted(c for k in np.unique(m) for c in comps([tuple(p) for p in np.argwhere(m == k).tolist()], EIGHT if eight else FOUR))
        want = np.zeros(shape, int)
        for i, c in enumerate(every):  # sorted by first pixel
            for y, x in c:
                want[y, x] = i
        assert (got == want).all()


def spiral(n):
    """One piece that winds inwards, so that labels must travel far."""
    m, y, x, dy, dx = np.zeros((n, n), int), 0, 0, 0, 1
    m[0, 0] = 1
    while True:
        for _ in range(2):
            a, b = y + dy, x + dx
            c, d = y + 2 * dy, x + 2 * dx
            if 0 <= a < n and 0 <= b < n and m[a, b] == 0 and not (0 <= c < n and 0 <= d < n and m[c, d]):
                break
            dy, dx = dx, -dy
        else:
            return m
        y, x = y + dy, x + dx
        m[y, x] = 1


def test_labelled_spiral():
    m = spiral(65)
    assert len(np.unique(grids.labelled(m)[m == 1])) == 1


@pytest.mark.parametrize("shape", SIZES)
@pytest.mark.parametrize("share", [0.003, 0.05, 0.5, 0.97])
def test_nearest_brute(shape, share):
    kept = np.random.default_rng(shape[0]).random(shape) < share
    y, x = grids.nearest(kept)
    ky, kx = np.nonzero(kept)
    if not len(ky):
        assert (y == -1).all() and (x == -1).all() and (grids.gaps(kept) > 1 << 60).all()
        return
    far = (np.arange(shape[0])[:, None, None] - ky) ** 2 + (np.arange(shape[1])[None, :, None] - kx) ** 2
    best = far.argmin(axis=-1)  # kept pixels are in reading order
    assert (y == ky[best]).all() and (x == kx[best]).all() and (grids.gaps(kept) == far.min(axis=-1)).all()


def test_disks_brute():
    for seed in range(3):
        m = np.random.default_rng(seed).random((20, 17)) < 0.6
        for r in (1, 2, 3):
            near = [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= r * r]
            at = lambda y, x: 0 <= y < 20 and 0 <= x < 17 and m[y, x]  # noqa: B023, E731
            assert (grids.disk_grown(m, r) == [[any(at(y + a, x + b) for a, b in near) for x in range(17)] for y in range(20)]).all()
            assert (grids.disk_shrunk(m, r) == [[all(at(y + a, x + b) for a, b in near) for x in range(17)] for y in range(20)]).all()


@pytest.mark.parametrize(("low", "high"), [(4.0, 10.0), (20.0, 60.0)])
def test_edges_brute(low, high):
    for seed in range(3):
        draw = np.random.default_rng(seed)
        v = noise((26, 31), 4, seed, 7) * 17.0 + draw.normal(0, 2, (26, 31))
        got = grids.edges(v, 1.5, low, high)
        assert (got == brute_edges(v, 1.5, low, high)).all() and got.any()


def test_edges_of_flat_and_tiny_pictures():
    for shape in ((1, 1), (2, 5), (9, 9)):
        flat = np.full(shape, 7.0)
        assert not grids.edge_map(flat, flat, flat).any()


def test_scores_are_zero_where_a_side_is_empty():
    some, none = np.eye(5, dtype=bool), np.zeros((5, 5), bool)
    assert grids.scores(some, none, 2) == grids.scores(none, some, 2) == grids.scores(none, none, 2) == (0.0, 0.0, 0.0)
    assert grids.scores(some, some, 0) == (1.0, 1.0, 1.0)


# traced plans
def even_odd(rings, y, x):
    """Whether a pixel's centre is inside, by a ray to the left."""
    n = 0
    for r in rings:
        for (y1, x1), (y2, x2) in zip(r.tolist(), np.roll(r, -1, axis=0).tolist(), strict=True):
            if (y1 <= 2 * y) != (y2 <= 2 * y):
                n += x1 + (2 * y - y1) * (x2 - x1) / (y2 - y1) <= 2 * x
    return n % 2 == 1


@pytest.mark.parametrize("shape", SIZES[:5])
def test_rings_hold_the_mask(shape):
    for seed in range(5):
        m = noise(shape, 2, seed, 1 + seed % 3) == 1
        found = tracing.rings(m)
        assert (tracing.filled(found, shape) == m).all()
        assert all(tracing.is_simple(r) for r in found)
        outer = len(comps([tuple(p) for p in np.argwhere(m).tolist()], FOUR))
        holes = len(comps([tuple(p) for p in np.argwhere(~np.pad(m, 1)).tolist()], EIGHT)) - 1
        assert len(found) == outer + holes
        if m.size <= 600:
            assert [[even_odd(found, y, x) for x in range(shape[1])] for y in range(shape[0])] == m.tolist()


def brute_simple(ring):
    """By exact tests of all pairs of sides."""
    n = len(ring)
    if n < 3:
        return False
    p = [tuple(q) for q in ring.tolist()]
    if any(p[i] == p[(i + 1) % n] for i in range(n)):
        return False
    turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    on = lambda a, b, c: turn(a, b, c) == 0 and min(a[0], b[0]) <= c[0] <= max(a[0], b[0]) and min(a[1], b[1]) <= c[1] <= max(a[1], b[1])
    for i in range(n):
        for j in range(i + 1, n):
            a, b, c, d = p[i], p[(i + 1) % n], p[j], p[(j + 1) % n]
            if j == i + 1 or (i == 0 and j == n - 1):
                common, far1, far2 = (b, a, d) if j == i + 1 else (a, b, c)
                if n == 3:
                    if turn(a, b, d if j == i + 1 else c) == 0:
                        return False
                elif on(common, far1, far2) or on(common, far2, far1):
                    return False
                continue
            if on(a, b, c) or on(a, b, d) or on(c, d, a) or on(c, d, b):
                return False
            if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                return False
    return True


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), min_size=1, max_size=9))
def test_simple_rings_brute(points):
    ring = np.array(points)
    assert tracing.is_simple(ring) == brute_simple(ring)


def test_simplified_stays_near():
    for seed in range(4):
        m = noise((40, 40), 2, seed, 5) == 1
        for ring in tracing.rings(m):
            few = tracing.simplified(ring, 1.0)
            assert len(few) <= len(ring) and (few[0] == ring[0]).all()
            a, b = few / 2, np.roll(few, -1, axis=0) / 2
            for q in ring / 2:
                t = np.clip(((q - a) * (b - a)).sum(1) / np.maximum(((b - a) ** 2).sum(1), 1e-300), 0, 1)
                assert np.hypot(*(q - a - t[:, None] * (b - a)).T).min() <= 1 + 1e-9
        assert (tracing.simplified(ring, 0) == ring).all()
    line = np.array([(0, 2 * k) for k in range(9)] + [(4, 8)])
    assert tracing.simplified(line, 0.4).tolist() == [[0, 0], [0, 16], [4, 8]]


COLOURS = ["#ffffff", "#aa0000", "#00bb00", "#0000cc"]


def test_plans_read_back():
    for seed in range(4):
        m = noise((30, 22), 4, seed, 1 + seed)
        text = tracing.svg(m, COLOURS, 0, tolerance=0)
        assert (tracing.painted(text, COLOURS, 0) == m).all()
        assert tracing.checks(text)["invalid_paths"] == 0
        rough = tracing.svg(m, COLOURS, 0, tolerance=1.0)
        assert (tracing.painted(rough, COLOURS, 0) == m).mean() > (0.2 if seed < 2 else 0.8)
    sheet = tracing.svg(m, COLOURS, 0, tolerance=0, backing=2)
    assert (tracing.painted(sheet, COLOURS, 0) == m).all() and 'id="backing"' in sheet
    assert tracing.paths(sheet)[0][0] == "#1a1a1a" and (tracing.filled(tracing.paths(sheet)[0][1], m.shape) == grids.disk_grown(m != 0, 2)).all()
    assert tracing.svg(np.zeros((3, 4), int), COLOURS, 0, backing=2).count("<g") == 0


def test_crossed_paths_are_counted():
    bow = '<svg viewBox="0 0 9 9"><g fill="#aa0000" fill-rule="evenodd"><path d="M0.0,0.0 L4.0,4.0 L4.0,0.0 L0.0,4.0 Z M5.0,5.0 L8.0,5.0 L8.0,8.0 Z"/></g></svg>'
    assert tracing.checks(bow) == {"paths": 2, "invalid_paths": 1}


def test_rings_of_a_plan_are_checked_together(monkeypatch):
    draw = np.random.default_rng(12)
    every = [draw.integers(-9, 9, (n, 2)) for n in (3, 4, 4, 5, 6, 2, 1, 0) for _ in range(12)]
    every += [r for seed in range(4) for r in tracing.rings(np.random.default_rng(seed).random((9, 9)) < 0.6)]
    told = tracing.are_simple(every)
    assert told.tolist() == [len(r) >= 3 and brute_simple(r) for r in every] and 0 < told.sum() < len(told)
    assert tracing.are_simple([]).tolist() == []
    calls, turn = [], tracing._turn
    monkeypatch.setattr(tracing, "_turn", lambda *x: calls.append(1) or turn(*x))
    tracing.are_simple(every)
    assert len(calls) <= 16  # not so many for each ring
