"""Perturbed drawings, fragments, strokes, pictures files and sweeps against plain loops."""

import math
import zlib

import numpy as np
import pytest

from loomstat.operators import drawings, projection
from loomstat.sources import png, readers
from test_pictures import EIGHT, FOUR, brute_disk, comps, maps


def ink(seed, shape=(20, 26), share=0.15):
    return np.random.default_rng(seed).random(shape) < share


def test_gaps_brute():
    for seed in range(4):
        m = ink(seed)
        got = drawings.gapped(m, 5, 2.5, np.random.default_rng(seed))
        y, x = np.nonzero(m)
        at = np.random.default_rng(seed).choice(len(y), 5, replace=False)
        want = [[bool(m[v, u]) and all((v - y[i]) ** 2 + (u - x[i]) ** 2 > 6.25 for i in at) for u in range(26)] for v in range(20)]
        assert (got == want).all()
    assert not drawings.gapped(m, 10**6, 1, np.random.default_rng(0)).any()
    none = np.zeros((4, 4), bool)
    assert not any(drawings.perturbed(none, k, 1).any() for k in drawings.KINDS)


def test_displacement_brute():
    """Field, look-up and threshold pixel by pixel."""
    m, amplitude, sigma = ink(1, (14, 17), 0.3), 2.0, 1.5
    got = drawings.displaced(m, amplitude, sigma, np.random.default_rng(9))
    draw, fields = np.random.default_rng(9), []
    r = int(4 * sigma + 0.5)
    g = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    mirror = lambda i, n: (i % (2 * n)) if (i % (2 * n)) < n else 2 * n - 1 - i % (2 * n)
    for _ in range(2):
        v = draw.normal(size=(14, 17))
        s = np.array([[sum(a * b * v[mirror(y + i - r, 14), mirror(x + j - r, 17)] for i, a in enumerate(g) for j, b in enumerate(g)) / sum(g) ** 2 for x in range(17)] for y in range(14)])
        fields.append(s * amplitude / (abs(s).max() + 1e-8))
    for y in range(14):
        for x in range(17):
            v, u = y + fields[0][y, x], x + fields[1][y, x]
            if not (0 <= v <= 13 and 0 <= u <= 16):
                assert not got[y, x]
                continue
            a, b = math.floor(v), math.floor(u)
            at = lambda p, q: float(m[min(p, 13), min(q, 16)])
            mean = sum(at(a + i, b + j) * abs(1 - i - (v - a)) * abs(1 - j - (u - b)) for i in (0, 1) for j in (0, 1))
            assert got[y, x] == (mean > 0.5)
    assert (drawings.displaced(m, 0.0, sigma, np.random.default_rng(1)) == m).all()


def test_kinds():
    m = ink(3)
    assert (drawings.perturbed(m, "thick", 1, grow=2) == brute_disk(m, 2, any)).all()
    assert (drawings.perturbed(m, "thin", 1) == projection.skeleton(m)).all()
    again = [drawings.perturbed(m, k, 5, gaps=3, gap=2, sigma=2) for k in drawings.KINDS]
    assert all((a == drawings.perturbed(m, k, 5, gaps=3, gap=2, sigma=2)).all() for k, a in zip(drawings.KINDS, again, strict=True))


def test_fragments_brute():
    for seed in range(4):
        m = ink(seed, share=0.5)
        thin = projection.skeleton(m)
        beside = lambda y, x: sum(0 <= y + a < 20 and 0 <= x + b < 26 and thin[y + a, x + b] for a, b in EIGHT)  # noqa: B023, E731
        cells = [(y, x) for y, x in np.argwhere(thin).tolist() if beside(y, x) < 3]
        want = comps(cells, EIGHT)
        number, n = drawings.fragments(m)
        assert n == len(want) and sorted(sorted(map(tuple, np.argwhere(number == k).tolist())) for k in range(1, n + 1)) == want
        left, every, kept = drawings.fragmented(m, seed, gaps=3, gap=2)
        keep = np.random.default_rng(seed).random(n) >= 0.25
        assert every == n and kept == keep.sum() and not (left & ~m).any()
        all_left, _, _ = drawings.fragmented(m, seed, drop=0.0, gaps=0)
        near = np.zeros(m.shape, bool)
        for y, x in cells:
            for v, u in np.argwhere(m).tolist():
                near[v, u] |= abs(v - y) + abs(u - x) <= 2
        assert (all_left == near).all()


def test_strokes_brute():
    for seed in range(3):
        grey = np.where(ink(seed, share=0.3), 40, 200) + np.random.default_rng(seed).integers(0, 30, (20, 26))
        lines, t = drawings.strokes(grey, 3, 4)
        levels = sorted(set(grey.ravel().tolist()))

        def spread(k):
            a, b = grey[grey <= k], grey[grey > k]  # noqa: B023
            return len(a) * len(b) * (a.mean() - b.mean()) ** 2

        assert t == max(levels[:-1], key=lambda k: (round(spread(k), 6), -k))
        dark = np.zeros(grey.shape, bool)
        for c in comps([tuple(p) for p in np.argwhere(grey <= t).tolist()], FOUR):
            for p in c if len(c) >= 4 else ():
                dark[p] = True
        assert (lines == brute_disk(projection.skeleton(dark), 1, any)).all()
    assert drawings.strokes(np.full((4, 4), 7))[1] == 7


# picture files
@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_png_round_trip(channels):
    for shape in ((1, 1), (7, 5), (33, 20)):
        v = np.random.default_rng(channels).integers(0, 256, (*shape, channels))
        got = np.rint(png.decode(png.encode(v)) * 255).astype(int)
        want = v if channels >= 3 else v[..., [0, 0, 0] + [1] * (channels == 2)]
        assert (got[..., : want.shape[2]] == want).all() and (channels % 2 == 0 or (got[..., 3] == 255).all())


def made_png(width, height, depth, colour, rows, extra=b""):
    import struct

    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return png.MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in rows))) + chunk(b"IEND", b""), chunk


def test_png_palettes_depths_and_clear_colours():
    _, chunk = made_png(1, 1, 8, 0, [b"\0"])
    two_bits, _ = made_png(5, 1, 2, 3, [bytes([0b00011011, 0b01000000])], chunk(b"PLTE", bytes(range(12))) + chunk(b"tRNS", b"\xff\x00"))
    got = png.decode(two_bits)
    assert np.rint(got[0, :, 0] * 255).tolist() == [0, 3, 6, 9, 3] and got[0, :, 3].tolist() == [1, 0, 1, 1, 0]
    wide, _ = made_png(2, 1, 16, 0, [b"\xff\xff\x00\x80"], chunk(b"tRNS", b"\x00\x80"))
    got = png.decode(wide)
    assert got[0, :, 1].tolist() == [1.0, 128 / 65535] and got[0, :, 3].tolist() == [1, 0]
    assert png.on_white(got)[0, 1].tolist() == [1, 1, 1]
    assert png.squared(np.zeros((2, 5, 3)))[:, 0, 0].tolist() == [1, 0, 0, 1, 1]


def test_resampling_brute():
    rgb = np.random.default_rng(1).random((11, 11, 3))
    for size in (4, 11, 17):
        got, scale = png.resized(rgb, size), 11 / size
        stretch = max(scale, 1)
        sinc = lambda t: 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t)
        kernel = lambda t: sinc(t) * sinc(t / 3) if abs(t) < 3 else 0.0
        for i, j in ((0, 0), (1, size - 1), (size // 2, 2)):
            wy, wx = ([kernel((k + 0.5 - (p + 0.5) * scale) / stretch) for k in range(11)] for p in (i, j))
            want = sum(a * b * rgb[y, x] for y, a in enumerate(wy) for x, b in enumerate(wx)) / sum(wy) / sum(wx)
            assert got[i, j] == pytest.approx(np.clip(want, 0, 1))
    assert png.resized(np.ones((5, 5, 3)), 9) == pytest.approx(np.ones((9, 9, 3)))


def test_broken_pictures_are_null(spark):
    good = png.encode(np.full((2, 3, 3), 255))
    rows = [("good", good), ("cut", good[:40]), ("text", b"hello"), ("none", None), ("flipped", good[:45] + bytes([good[45] ^ 1]) + good[46:])]
    got = {x["path"]: x for x in readers.pictures(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert (got["good"]["height"], got["good"]["width"], got["good"]["rgb"]) == (2, 3, [1.0] * 18)
    assert all(got[k]["rgb"] is None for k in ("cut", "text", "none", "flipped"))
    small = readers.pictures(spark.createDataFrame(rows[:1], "path string, content binary"), 4).first()
    assert (small["height"], small["width"]) == (4, 4) and small["rgb"] == pytest.approx([1.0] * 48)


def test_sweep_is_the_projection(spark):
    shares = [0.02, 0.1, 0.3]
    rows = [(i, 14, m.ravel().tolist()) for i, m in enumerate(maps(4))]
    spark.udtf.register("swept_test", projection.swept)
    spark.createDataFrame(rows, "img int, width int, labels array<int>").createOrReplaceTempView("sweep_test_maps")
    got = spark.sql("SELECT img, s.* FROM sweep_test_maps, LATERAL swept_test(labels, width, array(0.02D, 0.1D, 0.3D)) s").collect()
    assert len(got) == 12
    for x in got:
        m = maps(4)[x["img"]]
        cut = projection.projected(m, 0, x["alpha"])[0]
        assert x["alpha"] in shares and x["change"] == (cut != m).mean()
        assert x["pieces"] == sum(len(comps([tuple(p) for p in np.argwhere(cut == k).tolist()], FOUR)) for k in np.unique(cut) if k)
