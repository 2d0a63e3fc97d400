"""Label maps and masks as pixel rows (``img``, ``y``, ``x``, ``label``), and grouped functions where an algorithm is sequential.

A picture is the unit of distribution: windows and neighbour joins are keyed by ``img``.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import distance
from . import grids
from .similarity import components

PIXEL = ["img", "y", "x"]
offsets = grids.offsets


def foreground(l: Column, a: Column, b: Column) -> Column:  # noqa: E741
    return ~((l > 90) & (F.hypot(a, b) < 10))


def nearest_palette(pixels: DataFrame, palette: list[tuple[float, float, float]], first: int = 3) -> DataFrame:
    """Add ``k``, the palette colour of a pixel's ``l``, ``a``, ``b``, and ``de``, its CIEDE2000 difference: of the ``first`` closest by
    distance the one with the least difference, ties to the closer one. The palette is a literal of a few dozen colours.
    Row by row: nothing is shuffled, and repeated pixels stay."""
    colours = np.array(palette, np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            made = grids.matched(*(g[c].to_numpy(np.float64) for c in "lab"), colours, first)
            yield g.assign(k=made[0], de=made[1])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pixels.dtypes)
    return pixels.mapInPandas(run, f"{kinds}, k int, de double")


def _neighbours() -> dict[str, Column]:
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    return {"left": F.lag("label").over(row), "right": F.lead("label").over(row), "up": F.lag("label").over(col), "down": F.lead("label").over(col)}


def boundaries(labels: DataFrame) -> DataFrame:
    """Add ``edge``: whether the pixel to the right or below has another label."""
    n = _neighbours()
    differs = lambda c: F.coalesce(c != F.col("label"), F.lit(False))
    return labels.withColumns({"_r": n["right"], "_d": n["down"]}).select(*labels.columns, (differs(F.col("_r")) | differs(F.col("_d"))).alias("edge"))


def labels_beside(labels: DataFrame) -> DataFrame:
    """Add ``sides``: how many of the four neighbours of a pixel have another label."""
    n = _neighbours()
    made = labels.withColumns({f"_{k}": c for k, c in n.items()})
    differs = [F.coalesce((F.col(f"_{k}") != F.col("label")).cast("int"), F.lit(0)) for k in n]
    return made.select(*labels.columns, sum(differs[1:], differs[0]).alias("sides"))


def adjacency(labels: DataFrame, of: str = "label") -> DataFrame:
    """(``img``, ``i``, ``j``, ``n``): pixel sides between values of ``of`` (labels, or regions), both directions."""
    labels = labels.select(*PIXEL, F.col(of).alias("label"))
    n = _neighbours()
    sides = labels.withColumns({"_r": n["right"], "_d": n["down"]}).select("img", "label", F.explode(F.array("_r", "_d")).alias("other")).where("other is not null and other <> label")
    both = sides.select("img", F.col("label").alias("i"), F.col("other").alias("j")).unionByName(sides.select("img", F.col("other").alias("i"), F.col("label").alias("j")))
    return both.groupBy("img", "i", "j").agg(F.count("*").alias("n"))


def outlines(pixels: DataFrame, by: str) -> DataFrame:
    """(``img``, ``by``, ``area``, ``sides``, ``holes``, ``contour``) of each connected set of pixels (``img``, ``y``, ``x``, ``by``).

    From the 2 by 2 squares that a set meets: those with one, two adjacent or three of its pixels count one side, those with
    two opposite ones two; ones less threes plus twice the opposites are four times the pieces (4-connected: one) less the holes
    (8-connected). ``contour`` is the number of points of the outlines at
    half height: a point for each side, and one more for each outline, which ends where it began.
    """
    corner = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(1 << (2 * dy + dx)).alias("bit")) for dy in (0, 1) for dx in (0, 1)])).alias("c")
    seen = pixels.select("img", by, "y", "x", corner)
    square = seen.groupBy("img", by, (F.col("y") - F.col("c.dy")).alias("y"), (F.col("x") - F.col("c.dx")).alias("x")).agg(F.sum("c.bit").alias("m"), F.sum((F.col("c.bit") == 1).cast("long")).alias("own"))
    n = lambda *m: F.sum(F.col("m").isin(*m).cast("long"))
    one, three, opposite, beside = n(1, 2, 4, 8), n(7, 11, 13, 14), n(6, 9), n(3, 5, 10, 12)
    made = square.groupBy("img", by).agg(F.sum("own").alias("area"), (one + beside + three + 2 * opposite).alias("sides"), ((one - three + 2 * opposite) / 4).cast("long").alias("euler"))
    return made.select("img", by, "area", "sides", (1 - F.col("euler")).alias("holes"), (F.col("sides") + 2 - F.col("euler")).alias("contour"))


#: Pixels that a task holds as arrays at once, unless one picture has more.
STACK = 1 << 16


def stacked(pixels: DataFrame, columns: list[str], f: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """The rows of ``f`` of pictures of pixel rows, many at once: it takes their ``img``, the places of their pixels as three arrays (number of the
    picture, ``y``, ``x``), and for each of ``columns`` an array of pictures of one size, 0 where a pixel is missing.

    Rows come by picture, so that a task holds ``STACK`` pixels, or one picture; a picture isn't parted."""
    names = [c.split()[0] for c in schema.split(", ")]

    def done(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        starts = np.flatnonzero(g["_k"].to_numpy() == 1)
        img, y, x = (g[c].to_numpy() for c in PIXEL)
        number = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
        sizes, kind = np.unique(np.stack([np.maximum.reduceat(y, starts), np.maximum.reduceat(x, starts)]), axis=1, return_inverse=True)
        kind = kind.ravel()
        for i, (bottom, right) in enumerate(sizes.T):
            here = kind == i
            rows = here[number]
            at = (np.cumsum(here) - 1)[number[rows]], y[rows], x[rows]
            arrays = []
            for c in columns:
                v = g[c].to_numpy()[rows]
                arrays.append(np.zeros((here.sum(), bottom + 1, right + 1), v.dtype))
                arrays[-1][at] = v
            made = f(img[starts[here]], at, *arrays)
            if len(made):
                yield made[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, most = [], 0, STACK
        for b in batches:
            held.append(b)
            n += len(b)
            if n >= most:
                g = pd.concat(held)
                last = int(np.flatnonzero(g["_k"].to_numpy() == 1)[-1])
                if last:
                    yield from done(g.iloc[:last])
                held, n = [g.iloc[last:]], len(g) - last
                most = max(STACK, 2 * n)
        if n:
            yield from done(pd.concat(held))

    own = Window.partitionBy("img").orderBy("y", "x")
    return pixels.select(*PIXEL, *columns).withColumn("_k", F.row_number().over(own)).sortWithinPartitions(*PIXEL).mapInPandas(run, schema)


def with_near(pixels: DataFrame, masks: list[str], r: int, also: list[str] = ()) -> DataFrame:
    """Pixel rows with boolean ``masks``, the columns ``also``, and for each mask ``near_`` it: whether a pixel of the mask is within ``r``."""
    kinds = dict(pixels.dtypes)

    def run(img: np.ndarray, at: tuple, *m: np.ndarray) -> pd.DataFrame:
        made = {c: v[at] for c, v in zip([*masks, *also], m, strict=True)} | {f"near_{c}": grids.disks(v, r)[at] for c, v in zip(masks, m, strict=False)}
        return pd.DataFrame({"img": img[at[0]], "y": at[1], "x": at[2]} | made)

    schema = ", ".join([f"img {kinds['img']}, y int, x int", *[f"{c} {kinds[c]}" for c in (*masks, *also)], *[f"near_{c} boolean" for c in masks]])
    return stacked(pixels, [*masks, *also], run, schema)


def mode_filter(labels: DataFrame, r: int, disk: bool = True) -> DataFrame:
    """The most frequent label in a disk, edges replicated, or in the part of a square inside; ties to the lowest label."""
    def run(img: np.ndarray, at: tuple, m: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"img": img[at[0]], "y": at[1], "x": at[2], "label": grids.voted(m, r, disk)[at]})

    kinds = dict(labels.dtypes)
    return stacked(labels, ["label"], run, f"img {kinds['img']}, y int, x int, label {kinds['label']}")


def eroded(pixels: DataFrame, r: int) -> DataFrame:
    """Pixels of the boolean ``mask`` whose whole disk lies in it or outside of the picture."""
    return with_near(pixels.withColumn("out", ~F.col("mask")), ["out"], r).where("not out and not near_out").select(*PIXEL)


def tolerance_scores(masks: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """(``img``, ``tol``, ``precision``, ``recall``, ``f1``) of each picture of pixel rows with ``found`` and ``wanted``: shares of one within a radius
    of the other, and F1; all 0 where one is empty. One distance transform a mask serves all radii."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        found, wanted = (_grid(g, c) > 0 for c in ("found", "wanted"))
        far = grids.gaps(found), grids.gaps(wanted)
        rows = [(tol, *grids.scores(found, wanted, tol, far)) for tol in radii]
        return pd.DataFrame(rows, columns=["tol", "precision", "recall", "f1"]).assign(img=g["img"].iloc[0])[["img", "tol", "precision", "recall", "f1"]]

    rows = masks.select(*PIXEL, F.col("found").cast("int").alias("found"), F.col("wanted").cast("int").alias("wanted"))
    return rows.groupBy("img").applyInPandas(run, f"img {dict(masks.dtypes)['img']}, tol int, precision double, recall double, f1 double")


def iou(masks: DataFrame) -> DataFrame:
    """By picture of rows with ``m1`` and ``m2``: pixels in both over pixels in either (1 at least)."""
    both, any_ = F.sum((F.col("m1") & F.col("m2")).cast("long")), F.sum((F.col("m1") | F.col("m2")).cast("long"))
    return masks.groupBy("img").agg((both / F.greatest(any_, F.lit(1))).alias("iou"))


def decoration(pixels: DataFrame, r: int) -> DataFrame:
    """(``img``, ``density``) of pixel rows with booleans ``edge``, ``line`` and ``inside``: edge pixels inside the figure and more than ``r`` from a line, for
    1,000 pixels inside."""
    near = with_near(pixels, ["line"], r, ["edge", "inside"])
    n = lambda c: F.sum(c.cast("long"))
    return near.groupBy("img").agg((1000.0 * n(F.col("edge") & F.col("inside") & ~F.col("near_line")) / F.greatest(n(F.col("inside")), F.lit(1))).alias("density"))


def _grid(g: pd.DataFrame, column: str = "label") -> np.ndarray:
    out = np.zeros((g["y"].max() + 1, g["x"].max() + 1), np.int64)
    out[g["y"], g["x"]] = g[column]
    return out


def flood(labels: np.ndarray) -> np.ndarray:
    """4-connected pieces of equal label, numbered from 0 in reading order of their first pixels."""
    return grids.labelled(labels)


def by_picture(labels: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]], columns: str, pixels: bool = True) -> DataFrame:
    """Apply ``f`` to each picture's label map. With ``pixels``, its arrays have the map's shape and become pixel columns."""
    schema = f"img {dict(labels.dtypes)['img']}, {'y int, x int, ' if pixels else ''}{columns}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(img: np.ndarray, at: tuple, m: np.ndarray) -> pd.DataFrame:
        made = [f(one) for one in m.astype(np.int64)]
        if pixels:
            return pd.DataFrame({"img": img[at[0]], "y": at[1], "x": at[2]} | {c: np.stack([x[c] for x in made])[at] for c in names[3:]})
        rows = [pd.DataFrame(x).assign(img=i) for i, x in zip(img, made, strict=True)]
        rows = [x for x in rows if len(x)]  # no rows have no type
        return pd.concat(rows) if rows else pd.DataFrame()

    return stacked(labels, ["label"], run, schema)


def pieces(labels: DataFrame, *also: str) -> DataFrame:
    """Pixel rows with ``label``, ``piece`` and the columns ``also``."""
    def run(img: np.ndarray, at: tuple, m: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
        p = grids.labelled(m)
        made = {"label": m[at], "piece": (p - p[:, :1, :1])[at]} | {c: v[at] for c, v in zip(also, more, strict=True)}
        return pd.DataFrame({"img": img[at[0]], "y": at[1], "x": at[2]} | made)

    kinds = dict(labels.dtypes)
    return stacked(labels, ["label", *also], run, ", ".join([f"img {kinds['img']}, y int, x int, label int, piece long", *[f"{c} {kinds[c]}" for c in also]]))


def region_borders(labels: DataFrame, ground: int) -> DataFrame:
    """(``img``, ``region``, ``area``, ``sides``) of the :func:`regions` of each picture but the ground: pixels, and pixel sides on other regions or on the
    picture's edge. Pictures are counted where they are held; a pixel is no row of its own."""
    def run(m: np.ndarray) -> dict[str, np.ndarray]:
        p = regions(m, ground)
        n, q, sides = int(p.max()) + 1, np.pad(p, 1, constant_values=-1), 0
        for other in (q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, :-2], q[1:-1, 2:]):
            sides = sides + np.bincount(p[other != p], minlength=n)
        return {"region": np.arange(1, n), "area": np.bincount(p.ravel(), minlength=n)[1:], "sides": sides[1:]}

    return by_picture(labels, run, "region long, area long, sides long", pixels=False)


def tiled_pieces(labels: DataFrame, side: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pixel rows with ``label`` and ``piece``, the (``img``, ``y``, ``x``) of the first pixel of their 4-connected piece, of pictures of any size.

    Squares of ``side`` pixels are labelled alone, and no task holds more than one; pieces that meet over the border of two squares
    are joined as components of a graph, which ``cut`` materialises. Only border pixels and pieces of squares are in it.
    """
    square = {"ty": F.floor(F.col("y") / side).cast("int"), "tx": F.floor(F.col("x") / side).cast("int")}
    rows = labels.select(*PIXEL, "label").withColumns(square)

    def alone(g: pd.DataFrame) -> pd.DataFrame:
        y, x = g["y"].min(), g["x"].min()
        m = np.full((g["y"].max() - y + 1, g["x"].max() - x + 1), np.iinfo(np.int64).min)
        m[g["y"] - y, g["x"] - x] = g["label"]
        p = flood(m)
        first = np.unique(p, return_index=True)[1]
        own = first[p[g["y"] - y, g["x"] - x]]
        return g.assign(py=y + own // m.shape[1], px=x + own % m.shape[1])

    kinds = dict(labels.dtypes)
    pixel = ", ".join(f"{c} {kinds[c]}" for c in (*PIXEL, "label"))
    done = cut(rows.groupBy("img", "ty", "tx").applyInPandas(alone, f"{pixel}, ty int, tx int, py int, px int"))
    node = F.struct("img", F.col("py").alias("y"), F.col("px").alias("x"))
    meets = []
    for along, across in (("x", "y"), ("y", "x")):
        near = done.where(F.col(along) % side == side - 1).select("img", across, (F.col(along) + 1).alias(along), "label", node.alias("a"))
        meets.append(near.join(done.where(F.col(along) % side == 0).select(*PIXEL, "label", node.alias("b")), [*PIXEL, "label"]).select("a", "b"))
    pieces_ = components(meets[0].unionByName(meets[1]).distinct(), cut)
    facts = done.select("img", "ty", "tx", "py", "px").distinct().withColumn("id", node).join(pieces_, "id", "left")
    facts = facts.select("img", "ty", "tx", "py", "px", F.coalesce("comp", "id").alias("piece"))
    return done.join(facts, ["img", "ty", "tx", "py", "px"]).select(*PIXEL, "label", "piece")


def nearest_kept(m: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """``m`` with each pixel that is ``gone`` given the value of the nearest other one (ties: first in reading order)."""
    if m.ndim == 3:  # a stack, each picture of which has pixels of both kinds
        return m[np.arange(len(m))[:, None, None], *grids.nearest(~gone)]
    if not gone.any() or gone.all():
        return m
    y, x = grids.nearest(~gone)
    return m[y, x]


def merge_small(m: np.ndarray, least: int, rounds: int = 3) -> np.ndarray:
    """Pixels of pieces under ``least`` take the label of the nearest kept pixel (ties: first in reading order), up to ``rounds`` times."""
    for _ in range(rounds):
        small = sized(m) < least
        if not small.any() or small.all():
            break
        m = nearest_kept(m, small)
    return m


def sized(m: np.ndarray) -> np.ndarray:
    """The number of pixels of each pixel's piece."""
    p = flood(m)
    return np.bincount(p.ravel())[p]


def regions(m: np.ndarray, ground: int) -> np.ndarray:
    """0 for the ground colour, which is one board wherever it shows, and 1, 2, ... for the pieces of all others, by label, then in reading order."""
    p = flood(m)
    label = np.zeros(p.max() + 1, np.int64)
    label[p] = m
    held = np.flatnonzero(label != ground)
    number = np.zeros(len(label), np.int64)
    number[held[np.argsort(label[held], kind="stable")]] = np.arange(1, len(held) + 1)
    return number[p]


def containment(m: np.ndarray, ground: int = 0, base: float = 0.25) -> dict[str, np.ndarray]:
    """The tree of regions on the board (region 0, the ground colour): ``parent``, ``depth`` and ``ancestors`` (itself first) of each.

    One region after another is laid: always the one with the largest share of its border on what lies already (ties: the
    lower number). With ``base`` of its border or more on the board, or none on anything, it lies on the board; else on the
    laid region that it shares most border with (ties: the higher number). The picture's edge is no border. Regions wait in a heap, and
    again whenever their share grows.
    """
    p = regions(m, ground)
    n = int(p.max()) + 1
    sides = []
    for a, b in ((p[:, 1:], p[:, :-1]), (p[1:], p[:-1])):
        cut = a != b
        sides += [a[cut] * n + b[cut], b[cut] * n + a[cut]]
    pair, length = np.unique(np.concatenate(sides), return_counts=True)
    border: list[dict[int, int]] = [{} for _ in range(n)]  # in proportion to the borders that there are
    for a, b, k in zip((pair // n).tolist(), (pair % n).tolist(), length.tolist(), strict=True):
        border[a][b] = k
    label = np.full(n, ground, np.int64)
    label[p] = m
    total = [sum(x.values()) for x in border]
    parent, depth, laid = np.zeros(n, np.int64), np.zeros(n, np.int64), [True] + [False] * (n - 1)
    touching = [x.get(0, 0) for x in border]
    share = lambda k: touching[k] / total[k] if total[k] else 2.0
    heap = [(-share(k), k) for k in range(1, n)]
    heapq.heapify(heap)
    while heap:
        s, k = heapq.heappop(heap)
        if laid[k] or -s != share(k):  # laid meanwhile, or in the heap again with more
            continue
        if total[k] and touching[k] and border[k].get(0, 0) / total[k] < base:
            parent[k] = max((size, j) for j, size in border[k].items() if laid[j])[1]
        depth[k] = depth[parent[k]] + 1
        laid[k] = True
        for j, size in border[k].items():
            if not laid[j]:
                touching[j] += size
                heapq.heappush(heap, (-share(j), j))
    lines = []
    for k in range(1, n):
        line = [k]
        while parent[line[-1]]:
            line.append(int(parent[line[-1]]))
        lines.append(line)
    own = np.arange(1, n)
    return {"region": own, "label": label[1:], "area": np.bincount(p.ravel(), minlength=n)[1:], "parent": parent[1:], "depth": depth[1:], "ancestors": lines}


TREE = "region long, label long, area long, parent long, depth long, ancestors array<long>"


def outline(mask: np.ndarray) -> tuple[int, int]:
    """Holes, and points of the outlines, of one connected mask, as :func:`outlines` counts them."""
    f = np.pad(mask, 1).astype(np.int64)
    n = np.bincount((f[:-1, :-1] + 2 * f[:-1, 1:] + 4 * f[1:, :-1] + 8 * f[1:, 1:]).ravel(), minlength=16)
    one, three, opposite, beside = (int(n[list(k)].sum()) for k in ((1, 2, 4, 8), (7, 11, 13, 14), (6, 9), (3, 5, 10, 12)))
    euler = (one - three + 2 * opposite) // 4
    return 1 - euler, one + beside + three + 2 * opposite + 2 - euler


def layered(m: np.ndarray, ground: int) -> dict[str, np.ndarray]:
    """The :func:`containment` of a picture with, for each region, ``flat_cut`` and ``holes`` of itself, and ``whole`` (the area) and ``whole_cut`` of its shape
    with all that lies on it. Shapes are cut out by their extent, children before parents."""
    tree = containment(m, ground)
    p, n = regions(m, ground), len(tree["region"]) + 1
    y, x = np.indices(p.shape)
    ends = [np.full(n, big) for big in (p.size, p.size, -1, -1)]
    for end, f, v in ((0, np.minimum, y), (1, np.minimum, x), (2, np.maximum, y), (3, np.maximum, x)):
        f.at(ends[end], p.ravel(), v.ravel())
    on: list[list[int]] = [[k] for k in range(n)]
    for k in sorted(range(1, n), key=lambda k: -tree["depth"][k - 1]):
        if parent := tree["parent"][k - 1]:
            on[parent] += on[k]
    held, out = np.zeros(n, bool), {"flat_cut": [], "holes": [], "whole": [], "whole_cut": []}
    for k in range(1, n):
        cut = lambda ids: p[min(ends[0][ids]) : max(ends[2][ids]) + 1, min(ends[1][ids]) : max(ends[3][ids]) + 1]
        holes, flat = outline(cut([k]) == k)
        held[on[k]] = True
        shape = held[cut(on[k])]
        held[on[k]] = False
        for name, v in zip(out, (flat, holes, int(shape.sum()), outline(shape)[1]), strict=True):
            out[name].append(v)
    return tree | {name: np.array(v, np.int64) for name, v in out.items()}


def layer_statistics(labels: DataFrame, ground: int = 0, mm: float = 1.0) -> DataFrame:
    """The fifteen figures of each picture as cut paper in layers, ``mm`` to a pixel: a piece's shape is its region with all that
    lies on it. Pictures of bare ground have no row. ``medians`` are of the pieces' shapes."""
    rows = by_picture(labels, lambda m: layered(m, ground), TREE + ", flat_cut long, holes long, whole long, whole_cut long", pixels=False)
    at = lambda p: F.sum(p.cast("long"))
    d = F.col("depth")
    return rows.groupBy("img").agg(
        F.count("*").alias("pieces"), F.max("depth").alias("layers"), at(d == 1).alias("base_pieces"), at(d == 2).alias("depth2"), at(d == 3).alias("depth3"),
        at((d == 4) | (d == 5)).alias("depth4plus"), F.avg((d >= 2).cast("int")).alias("decoration_share"), F.count_distinct("label").alias("colours"),
        F.count_distinct(F.when(d == 1, F.col("label"))).alias("base_colours"), (F.sum(F.when(d == 1, F.col("area")).otherwise(0)) / F.sum("area")).alias("base_area_share"),
        (F.max("whole") * mm**2).alias("largest_piece_mm2"), (F.median("whole") * mm**2).alias("median_piece_mm2"), (F.sum("flat_cut") * mm).alias("cut_length_flat_mm"),
        (F.sum("whole_cut") * mm).alias("cut_length_layered_mm"), F.sum("holes").alias("holes_flat"),
    )


def symmetry(pixels: DataFrame) -> DataFrame:
    """1 - clip(mean Lab distance of mirrored pixels / 100) over pixels that are foreground on either side."""
    def run(img: np.ndarray, at: tuple, l: np.ndarray, a: np.ndarray, b: np.ndarray, fg: np.ndarray) -> pd.DataFrame:  # noqa: E741
        there = np.zeros(fg.shape, bool)
        there[at] = True
        both = there & there[..., ::-1] & (fg | fg[..., ::-1])
        far = np.sqrt(sum((c - c[..., ::-1]) ** 2 for c in (l, a, b)))
        n = both.sum((1, 2))
        mean = np.where(both, far, 0).sum((1, 2)) / np.maximum(n, 1)
        return pd.DataFrame({"img": img, "symmetry": 1 - np.clip(mean / 100, 0, 1)})[n > 0]

    return stacked(pixels, ["l", "a", "b", "fg"], run, f"img {dict(pixels.dtypes)['img']}, symmetry double")


def energy_terms(pixels: DataFrame, palette: list[tuple[float, float, float]], tau: float = 4.0, sigma: float = 8.0, edge: float = 12.0, weights: tuple[float, float, float, float] = (1.0, 1.0, 0.0, 0.0)) -> DataFrame:
    """By picture of ``l``, ``a``, ``b``, ``line`` (0 to 1) and ``ground`` (0 to 1): the terms of the cutting energy.

    ``palette``: mean soft-min distance -tau*log(sum exp(-d/tau)), 0 at least. ``flat``: mean of 1-exp(-g^2/sigma^2) over the
    steps to the right plus that over the steps down, g^2 over all of Lab. ``edge``: the mean over line pixels of exp(-(g/edge)^2),
    which is 0 where a cut supports the line, with g the largest gradient within two pixels. ``on_ground``: mean distance to the last palette colour
    where ground is. ``total``: weighted, palette and ground by a tenth.
    """
    own = F.array("l", "a", "b")
    far = lambda p: distance(own, F.array(*map(F.lit, map(float, p))))
    soft = sum((F.exp(-far(p) / tau) for p in palette), F.lit(0.0))
    row, col = Window.partitionBy("img", "y").orderBy("x"), Window.partitionBy("img", "x").orderBy("y")
    square = lambda w: sum((F.pow(F.lead(c).over(w) - F.col(c), F.lit(2.0)) for c in ("l", "a", "b")), F.lit(0.0))
    made = pixels.withColumns({"_gx": square(row), "_gy": square(col)})
    made = made.withColumn("_g", F.sqrt(F.coalesce("_gx", F.lit(0.0)) + F.coalesce("_gy", F.lit(0.0)) + 1e-6))
    made = made.withColumn("_g", F.max("_g").over(row.rowsBetween(-2, 2))).withColumn("_g", F.max("_g").over(col.rowsBetween(-2, 2)))
    welsch = lambda c: F.avg(1 - F.exp(-F.col(c) / sigma**2))
    ground = F.sqrt(F.pow(far(palette[-1]), F.lit(2.0)) + 1e-6)
    made = made.groupBy("img").agg(
        F.avg(F.greatest(-tau * F.log(soft), F.lit(0.0))).alias("palette"), (welsch("_gx") + welsch("_gy")).alias("flat"),
        (F.sum(F.col("line") * F.exp(-F.pow("_g", F.lit(2.0)) / edge**2)) / F.greatest(F.sum("line"), F.lit(1.0))).alias("edge"),
        (F.sum(F.col("ground") * ground) / F.greatest(F.sum("ground"), F.lit(1.0))).alias("on_ground"),
    )
    p, f, e, g = weights
    return made.withColumn("total", p * F.col("palette") / 10 + f * F.col("flat") + e * F.col("edge") + g * F.col("on_ground") / 10)


def otsu(values: DataFrame) -> DataFrame:
    """By picture: the threshold on ``v`` (int) that parts it with the largest between-class variance; ties to the least."""
    n = values.groupBy("img", "v").agg(F.count("*").alias("n"))
    w = Window.partitionBy("img").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = Window.partitionBy("img")
    n = n.withColumns({"w0": F.sum("n").over(w), "s0": F.sum(F.col("v") * F.col("n")).over(w), "w": F.sum("n").over(all_), "s": F.sum(F.col("v") * F.col("n")).over(all_)})
    part = n.where("w0 < w").withColumn("b", F.col("w0") * (F.col("w") - F.col("w0")) * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0")), F.lit(2.0)))
    return part.groupBy("img").agg(F.min_by("v", F.struct((-F.round("b", 6)).alias("b"), "v")).alias("threshold"))
