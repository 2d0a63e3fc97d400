"""Projection of pictures onto cuttable label maps, and line geometry: grouped functions of one picture, as arrays.

A picture is the unit of distribution (:func:`raster.by_picture`); what joins and windows can say is in ``raster``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grids, raster, tracing


def _shifted(m: np.ndarray, dy: int, dx: int, outside) -> np.ndarray:
    """``m`` moved so that each pixel holds its neighbour at (dy, dx); ``outside`` beyond the picture, or None to repeat the edge."""
    if outside is None:
        y = np.clip(np.arange(m.shape[0]) + dy, 0, m.shape[0] - 1)
        x = np.clip(np.arange(m.shape[1]) + dx, 0, m.shape[1] - 1)
        return m[y[:, None], x[None]]
    r = max(abs(dy), abs(dx))
    framed = np.pad(m, r, constant_values=outside)
    return framed[r + dy : r + dy + m.shape[0], r + dx : r + dx + m.shape[1]]


voted = grids.voted


def _framed(m: np.ndarray, r: int) -> np.ndarray:
    """With ``r`` unset pixels around each picture."""
    return np.pad(m, [(0, 0)] * (m.ndim - 2) + [(r, r), (r, r)])


def dilated(m: np.ndarray, r: int) -> np.ndarray:
    return grids.disks(m, r)


def eroded(m: np.ndarray, r: int) -> np.ndarray:
    """Pixels whose whole disk is set; beyond the picture nothing is."""
    return ~grids.disks(~_framed(m.astype(bool), r), r)[..., r : r + m.shape[-2], r : r + m.shape[-1]]


def opened(m: np.ndarray, r: int) -> np.ndarray:
    return dilated(eroded(m, r), r)


def closed(m: np.ndarray, r: int) -> np.ndarray:
    return eroded(dilated(m, r), r)


def filled(m: np.ndarray) -> np.ndarray:
    """Holes set: what is unset and not connected (4 ways) with the picture's edge."""
    p = raster.flood(_framed(m.astype(np.int64), 1))
    return (p != p[..., :1, :1])[..., 1:-1, 1:-1]


def silhouette(lines: np.ndarray, r: int = 3) -> np.ndarray:
    """The filled outer shape of a drawing whose gaps are under 2 ``r``."""
    return eroded(filled(dilated(lines, r)), r)


def skeleton(m: np.ndarray) -> np.ndarray:
    """Lines one pixel wide, by the two-step thinning of Zhang and Suen."""
    h, w = m.shape[-2:]
    m = m.astype(bool)
    around = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = m
        for first in (True, False):
            framed = _framed(m, 1)
            n = [framed[..., 1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in around]
            count = sum(x.astype(np.int8) for x in n)
            turns = sum((~a & b).astype(np.int8) for a, b in zip(n, n[1:] + n[:1], strict=True))
            up, right, down, left = n[0], n[2], n[4], n[6]
            free = ~(up & right & down) & ~(right & down & left) if first else ~(up & right & left) & ~(up & down & left)
            m = m & ~((count >= 2) & (count <= 6) & (turns == 1) & free)
        if (m == before).all():
            return m


def contour(m: np.ndarray) -> np.ndarray:
    return m & ~eroded(m, 1)


def constrained(m: np.ndarray, ground: int, least: int, width: int, rounds: int = 10) -> np.ndarray:
    """``m`` (a picture, or a stack) without parts narrower than ``width`` pixels (what an opening takes away, ground aside) and pieces under ``least``: they
    take the nearest other pixel's label, until none is left or ``rounds`` times."""
    if m.ndim == 2:
        return constrained(m[None], ground, least, width, rounds)[0]
    m, live = m.copy(), np.arange(len(m))
    for _ in range(rounds):
        part = m[live]
        bad = raster.sized(part) < least
        if width > 1:
            for k in np.unique(part[part != ground]):
                bad |= (part == k) & ~opened(part == k, max(1, width // 2))
        live, part, bad = _mixed(live, part, bad)
        if not len(live):
            break
        m[live] = raster.nearest_kept(part, bad)
    return m


def _mixed(live: np.ndarray, part: np.ndarray, gone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pictures of a stack of which some pixels are gone, but not all."""
    some = gone.any(axis=(1, 2)) & ~gone.all(axis=(1, 2))
    return live[some], part[some], gone[some]


def projected(m: np.ndarray, ground: int, share: float, smooth: int = 2, bare: np.ndarray | None = None, width: int = 0) -> tuple[np.ndarray, int, int]:
    """A cuttable label map of nearest colours ``m``: bare pixels are ground, labels are voted, pieces under ``share`` of the picture
    merged (three times at most), and with ``width`` the hard constraints applied. Also the number of small pieces at
    first, and in all rounds. Of a stack: a stack, and arrays of numbers."""
    if m.ndim == 2:
        cut, first, merged = projected(m[None], ground, share, smooth, None if bare is None else bare[None], width)
        return cut[0], int(first[0]), int(merged[0])
    if bare is not None:
        m = np.where(bare, ground, m)
    m = voted(m, smooth) if smooth else m.copy()
    least, live = max(1, int(share * m[0].size)), np.arange(len(m))
    first, merged = None, np.zeros(len(m), np.int64)
    for _ in range(3):
        part = m[live]
        p = raster.flood(part)
        small = np.bincount(p.ravel()) < least
        ends = p.reshape(len(p), -1).max(axis=1) + 1
        n = np.diff(np.concatenate([[0], np.cumsum(small)])[np.concatenate([[0], ends])])
        first = n if first is None else first
        merged[live] += n
        live, part, gone = _mixed(live, part, small[p])
        if not len(live):
            break
        m[live] = raster.nearest_kept(part, gone)
    if width:
        m = constrained(m, ground, least, width)
    return m, first, merged


def pieces_below(m: np.ndarray, ground: int, share: float) -> int:
    p = raster.flood(m)
    label = np.zeros(p.max() + 1, np.int64)
    label[p] = m
    return int(((np.bincount(p.ravel()) < share * m.size) & (label != ground)).sum())


def slivers(m: np.ndarray, ground: int, share: float) -> int:
    """Pieces under ``share`` of which nothing is left when the small pieces of their label are eroded by one pixel. Maps are voted before."""
    p = raster.flood(m)
    label = np.zeros(p.max() + 1, np.int64)
    label[p] = m
    small = (np.bincount(p.ravel()) < share * m.size) & (label != ground)
    left = [np.unique(p[eroded(small[p] & (m == k), 1)]) for k in np.unique(label[small])]
    return int(small.sum()) - sum(map(len, left))


def plan_checks(m: np.ndarray, ground: int, least: int, r: int, thin: int) -> dict:
    """What a cutter would object to in a plan: pieces under ``least`` pixels, pieces with over ``thin`` pixels that no disk of radius ``r``
    inside them covers, the share of such pixels, and holes: parts beyond the first that a piece leaves of the picture.

    ``smallest`` is null without pieces.
    """
    p = raster.flood(m)
    count = p.max() + 1
    label = np.zeros(count, np.int64)
    label[p] = m
    mine = label != ground
    area = np.bincount(p.ravel())
    strip = np.zeros(m.shape, bool)
    for k in np.unique(label[mine]):
        strip |= (m == k) & ~opened(m == k, r)  # a disk lies in one piece, so a label's pieces can be opened together
    rest = np.bincount(p[strip], minlength=count)
    holes = 0
    for i in np.flatnonzero(mine):
        y, x = np.nonzero(p == i)
        part = p[max(y.min() - 1, 0) : y.max() + 2, max(x.min() - 1, 0) : x.max() + 2] != i  # what lies further out hangs together
        holes += max(0, len(np.unique(raster.flood(part.astype(np.int64))[part])) - 1)
    some = bool(mine.any())
    return {"pieces": int(mine.sum()), "below": int((area[mine] < least).sum()), "thin_pieces": int((rest[mine] > thin).sum()), "thin_share": float(rest[mine].sum() / max(area[mine].sum(), 1)), "holes": int(holes), "smallest": int(area[mine].min()) if some else None}


def figure(l: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:  # noqa: E741
    """The foreground of a Lab picture, closed by a disk of radius 2 (what lies beyond the picture bears on nothing) and filled."""
    m = ~((l > 90) & (np.hypot(a, b) < 10))
    return filled(~grids.disk_grown(~grids.disk_grown(m, 2), 2))


def bare_ground(lines: np.ndarray, margin: float, r: int = 3) -> np.ndarray:
    """What lies more than ``margin`` pixels outside of a drawing's silhouette."""
    return ~grids.disk_grown(silhouette(lines, r), margin)


def evaluation(l: np.ndarray, a: np.ndarray, b: np.ndarray, lines: np.ndarray, shape: np.ndarray, sigma: float = 2.0) -> dict[str, float]:  # noqa: E741
    """A Lab picture against its drawing: its edges and the thinned lines within 2, 3 and 5 pixels, the contours of its figure and of the
    drawing's ``shape`` within 3, the areas of both over each other, and edges inside the shape that are more than 3 from a line for
    1,000 of its pixels. Scores are 0 where a side is empty."""
    edges, thin, own = grids.edge_map(l, a, b, sigma), skeleton(lines), figure(l, a, b)
    far = grids.gaps(edges), grids.gaps(thin)
    out = {}
    for tol in (2, 3, 5):
        precision, recall, f1 = grids.scores(edges, thin, tol, far)
        out |= {f"line_recall_t{tol}": recall, f"edge_prec_t{tol}": precision, f"edge_f1_t{tol}": f1}
    out["contour_f"] = grids.scores(contour(own), contour(shape), 3)[2]
    n = lambda m: m.sum(axis=(-2, -1))
    out["sil_iou"] = n(own & shape) / np.maximum(n(own | shape), 1)
    out["decoration_density"] = 1000 * n(edges & (far[1] > 9) & shape) / np.maximum(n(shape), 1)
    return out if edges.ndim == 3 else {k: float(v) for k, v in out.items()}


EVALUATION = ", ".join(f"{k} double" for t in (2, 3, 5) for k in (f"line_recall_t{t}", f"edge_prec_t{t}", f"edge_f1_t{t}")) + ", contour_f double, sil_iou double, decoration_density double"


def of_colours(m: np.ndarray, palette: np.ndarray) -> tuple[np.ndarray, ...]:
    """A plan as a Lab picture."""
    return tuple(np.moveaxis(palette[m], -1, 0))


def variants(lab: tuple[np.ndarray, ...], m: np.ndarray, palette: np.ndarray, ground: int, share: float, bare: np.ndarray) -> dict[str, tuple[np.ndarray, ...]]:
    """The Lab picture with parts of the projection left out: as it is, and on bare ground; the plans of :func:`ablated`."""
    plans = ablated(m, ground, share, bare)
    made = {"raw": lab, "ground only": tuple(np.where(bare, palette[ground][i], c) for i, c in enumerate(lab))}
    return made | {k: of_colours(v, palette) for k, v in plans.items() if k != "ground only"}


def protocol(lab: tuple[np.ndarray, ...], m: np.ndarray, palette: np.ndarray, ground: int, lines: np.ndarray, shape: np.ndarray, bare: np.ndarray, settings: list[tuple[str, float, bool]], mm2: float, sigma: float = 2.0) -> list[dict]:
    """For each setting (name, share below which pieces are merged or 0 for none, whether on bare ground) the plan's sheets (of over a
    thousandth of the picture), pieces, the smallest one where the picture has ``mm2``, how it keeps the lines and the figure, and
    the mean difference from the picture."""
    if m.ndim == 2:
        rows = protocol(tuple(c[None] for c in lab), m[None], palette, ground, *(x[None] for x in (lines, shape, bare)), settings, mm2, sigma)
        return [{k: v if isinstance(v, str) else None if v[0] != v[0] else v[0].item() for k, v in r.items()} for r in rows]
    rows, thin = [], skeleton(lines)
    far, size = grids.gaps(thin), m[0].size
    n = lambda x: x.sum(axis=(1, 2))
    for name, share, on_ground in settings:
        cut = projected(m, ground, share, bare=bare if on_ground else None)[0] if share else m
        p = raster.flood(cut)
        area = np.where(cut == ground, size + 1, np.bincount(p.ravel())[p]).min(axis=(1, 2))
        head = np.zeros(p.max() + 1, bool)
        head[p] = cut != ground
        ends = np.concatenate([[0], p.reshape(len(p), -1).max(axis=1) + 1])
        plan = of_colours(cut, palette)
        edges, own = grids.edge_map(*plan, sigma), figure(*plan)
        precision, recall, f1 = grids.scores(edges, thin, 3, (grids.gaps(edges), far))
        rows.append({
            "setting": name, "sheets": sum((n(cut == k) / size > 1e-3).astype(np.int64) for k in np.unique(cut) if k != ground) + np.zeros(len(m), np.int64),
            "pieces": np.diff(np.concatenate([[0], np.cumsum(head)])[ends]), "smallest_mm2": np.where(area <= size, area / size * mm2, np.nan),
            "edge_f1": f1, "recall": recall, "prec": precision, "sil_iou": n(own & shape) / np.maximum(n(own | shape), 1), "change_de": grids.delta_e(lab, plan).mean(axis=(1, 2)),
        })
    return rows


def cut_lines(m: np.ndarray, lab: tuple[np.ndarray, ...], ground: int, plans: dict[str, tuple[float, int]], mm: float, sigma: float = 2.0) -> dict:
    """Boundaries of plans (share of merged pieces and radius of the vote for each), thinned, with their lengths at ``mm`` a pixel and pieces, and
    the picture's thinned edges: their length, and the share of each more than 3 pixels from the first plan's boundaries and back."""
    out, thin = {}, {}
    for name, (share, smooth) in plans.items():
        cut = projected(m, ground, share, smooth)[0]
        edge = np.zeros(cut.shape, bool)
        edge[:, :-1] |= cut[:, :-1] != cut[:, 1:]
        edge[:-1] |= cut[:-1] != cut[1:]
        thin[name] = skeleton(edge)
        out |= {f"{name}_len_mm": float(thin[name].sum() * mm), f"{name}_pieces": len(np.unique(raster.flood(cut)[cut != ground]))}
    edges, first = skeleton(grids.edge_map(*lab, sigma)), next(iter(thin.values()))
    apart = lambda a, b: float((a & (grids.gaps(b) > 9)).sum() / max(a.sum(), 1))
    return out | {"edge_len_mm": float(edges.sum() * mm), "edge_spurious": apart(edges, first), "cut_missed": apart(first, edges)}


CUT_LINES = "dense_len_mm double, dense_pieces long, coarse_len_mm double, coarse_pieces long, edge_len_mm double, edge_spurious double, cut_missed double"
PROTOCOL = "setting string, sheets long, pieces long, smallest_mm2 double, edge_f1 double, recall double, prec double, sil_iou double, change_de double"


def delivered(cut: np.ndarray, colours: list[str], ground: int, least: int, r: int, thin: int, palette: np.ndarray, lines: np.ndarray, tolerance: float, sigma: float = 2.0) -> dict:
    """:func:`plan_checks` of a plan as it is read back from its traced file, with the file's paths, those that aren't the outline of an area, the
    share of pixels that it shows as planned, and the recall of the drawing's lines. Of stacks: with a list or an array for each figure."""
    if cut.ndim == 2:
        return {k: v[0] for k, v in delivered(cut[None], colours, ground, least, r, thin, palette, lines[None], tolerance, sigma).items()}
    rows = []
    for m in cut:
        text = tracing.svg(m, colours, ground, tolerance)
        found = tracing.paths(text)
        shown = tracing.painted(text, colours, ground, found)
        rows.append(plan_checks(shown, ground, least, r, thin) | tracing.checks(text, found) | {"agreement": float((shown == m).mean())})
    recall = grids.scores(grids.edge_map(*of_colours(cut, palette), sigma), skeleton(lines), 3)[1]
    return {k: [row[k] for row in rows] for k in rows[0]} | {"line_recall": recall}


DELIVERED = "pieces long, below long, thin_pieces long, thin_share double, holes long, smallest long, paths long, invalid_paths long, agreement double, line_recall double"


def ablated(m: np.ndarray, ground: int, share: float, bare: np.ndarray) -> dict[str, np.ndarray]:
    """The plan with parts of the projection left out."""
    return {
        "colour only": m,
        "ground only": np.where(bare, ground, m),
        "colour + merge (no ground)": projected(m, ground, share)[0],
        "full projection": projected(m, ground, share, bare=bare)[0],
    }


def disturbed(pixels: DataFrame, noise: float = 4.0) -> DataFrame:
    """Pixels (``img``, ``y``, ``x``, ``l``, ``a``, ``b``) in four ``condition``s: original, blurred (mean of 3 by 3), noisy (by hash, evenly
    within ``noise``), shaded (lightness from 0.65 at the top to 1.25 at the bottom on the figure only)."""
    from pyspark.sql import Window

    row, col = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy("img", "x").orderBy("y").rowsBetween(-1, 1)
    px = pixels.select(*raster.PIXEL, *[F.col(c).cast("double").alias(c) for c in "lab"])
    px = px.withColumns({f"r{c}": F.sum(c).over(row) for c in "lab"} | {"rn": F.count("*").over(row)})
    px = px.withColumns({f"s{c}": F.sum(f"r{c}").over(col) / F.sum("rn").over(col) for c in "lab"})
    px = px.withColumn("down", F.col("y") / F.greatest(F.max("y").over(Window.partitionBy("img")), F.lit(1)))
    even = lambda i: (F.pmod(F.xxhash64("img", "y", "x", F.lit(i)), F.lit(20_001)) / 10_000.0 - 1) * noise
    light = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    shaded = F.when(raster.foreground(F.col("l"), F.col("a"), F.col("b")), light(F.col("l") * (0.65 + 0.6 * F.col("down")))).otherwise(F.col("l"))
    made = {
        "original": [F.col(c) for c in "lab"], "blurred": [F.col(f"s{c}") for c in "lab"],
        "noisy": [light(F.col("l") + even(0)), F.col("a") + even(1), F.col("b") + even(2)], "shaded": [shaded, F.col("a"), F.col("b")],
    }
    each = F.array(*[F.struct(F.lit(n).alias("condition"), *[c.alias(k) for k, c in zip("lab", v, strict=True)]) for n, v in made.items()])
    return px.select(*raster.PIXEL, F.inline(each))


def window_of_most(mask: np.ndarray, size: int) -> tuple[int, int, int]:
    """Top, left and number of set pixels of the ``size`` by ``size`` window with most of them; ties to the first in reading order."""
    size = min(size, *mask.shape)
    s = np.pad(mask.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    n = s[size:, size:] - s[:-size, size:] - s[size:, :-size] + s[:-size, :-size]
    y, x = np.unravel_index(n.argmax(), n.shape)
    return int(y), int(x), int(n[y, x])


def pictures(pixels: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """``f`` of the arrays of ``columns`` of each picture of pixel rows, a dict or list of dicts of ``schema``, with ``img``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(img: np.ndarray, at: tuple, *arrays: np.ndarray) -> pd.DataFrame:
        rows = []
        for i, *own in zip(img, *(v.astype(np.int64) for v in arrays), strict=True):
            made = f(*own)
            rows += [(i, *(r[c] for c in names)) for r in (made if isinstance(made, list) else [made])]
        return pd.DataFrame(rows, columns=["img", *names])

    return raster.stacked(pixels, columns, run, f"img {dict(pixels.dtypes)['img']}, {schema}")


def piles(pixels: DataFrame, columns: list[str], f, schema: str) -> DataFrame:
    """As :func:`pictures`, with an ``f`` that takes stacks of pictures and gives arrays with a value for each."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(img: np.ndarray, at: tuple, *arrays: np.ndarray) -> pd.DataFrame:
        made = f(*(v.astype(np.int64) for v in arrays))
        return pd.concat([pd.DataFrame({"img": img} | {c: r[c] for c in names}) for r in (made if isinstance(made, list) else [made])])

    return raster.stacked(pixels, columns, run, f"img {dict(pixels.dtypes)['img']}, {schema}")


def own_centres(x: np.ndarray, known: np.ndarray, k: int, starts: int) -> np.ndarray:
    """The mean colour of each of the ``known`` points of stacked sets (3 channels by sets by points, known ones first) by the best of ``starts`` k-means
    fits; a set's draws depend on its size only."""
    n, size = known.shape
    count = known.sum(axis=1)
    drawn = {}
    for c in np.unique(count).tolist():
        draw = np.random.default_rng(0)
        drawn[c] = [draw.choice(c, min(k, c), replace=False) for _ in range(starts)]
    best, own = np.full(n, np.inf), np.zeros_like(x)
    for start in range(starts):
        c = np.full((n, k, 3), np.inf)
        for i, m in enumerate(count.tolist()):
            c[i, : min(k, m)] = x[:, i, drawn[m][start]].T
        at, live = np.zeros((n, size), np.int64), np.arange(n)
        for _ in range(50):
            p, old = x[:, live], c[live]
            near, least = np.zeros(p.shape[1:], np.int64), np.full(p.shape[1:], np.inf)
            for i in range(k):
                far = sum((p[j] - old[:, i, j, None]) ** 2 for j in range(3))
                closer = far < least
                near[closer], least[closer] = i, far[closer]
            at[live] = near
            slot = np.where(known[live], np.arange(len(live))[:, None] * k + near, len(live) * k).ravel()
            hits = np.bincount(slot, minlength=len(live) * k + 1)[:-1]
            means = [np.bincount(slot, p[j].ravel(), minlength=len(live) * k + 1)[:-1] / np.maximum(hits, 1) for j in range(3)]
            new = np.where((hits > 0)[:, None], np.stack(means, axis=1), old.reshape(-1, 3)).reshape(old.shape)
            moved = ~np.isclose(new, old).all(axis=(1, 2))
            live = live[moved]
            if not len(live):
                break
            c[live] = new[moved]
        mine = np.stack([np.take_along_axis(c[..., j], at, axis=1) for j in range(3)])
        loss = np.where(known, ((x - mine) ** 2).sum(axis=0), 0).sum(axis=1)
        better = loss < best
        best[better], own[:, better] = loss[better], mine[:, better]
    return own


def _purity(l: np.ndarray, a: np.ndarray, b: np.ndarray, fg: np.ndarray, draw: np.ndarray, k: int = 8, within: float = 6.0, most: int = 20_000, starts: int = 3) -> np.ndarray:  # noqa: E741
    """:func:`purity` of a stack; NaN without foreground."""
    n = len(fg)
    flat = fg.reshape(n, -1)
    order = np.argsort(np.where(flat, draw.reshape(n, -1), np.iinfo(np.int64).max), axis=1, kind="stable")  # ties in reading order
    size = min(most, max(int(flat.sum(axis=1).max()), 1))
    known = np.arange(size) < flat.sum(axis=1)[:, None]
    x = np.stack([np.take_along_axis(c.reshape(n, -1), order[:, :size], axis=1) for c in (l, a, b)])
    own = np.concatenate([own_centres(x[:, i : i + 32], known[i : i + 32], k, starts) for i in range(0, n, 32)], axis=1)  # few at a time stay in the cache
    close = known & (grids.delta_e(tuple(x), tuple(own)) < within)
    return np.where(known.any(axis=1), close.sum(axis=1) / np.maximum(known.sum(axis=1), 1), np.nan)


def purity(pixels: DataFrame, k: int = 8, within: float = 6.0, most: int = 20_000, starts: int = 3) -> DataFrame:
    """(``img``, ``purity``): the share of a picture's foreground pixels whose colour is within ``within`` (CIEDE2000) of the nearest of its own
    ``k`` mean colours, over ``most`` pixels drawn by hash (the definition's sample)."""
    def run(img: np.ndarray, at: tuple, *arrays: np.ndarray) -> pd.DataFrame:
        made = pd.DataFrame({"img": img, "purity": _purity(*arrays, k, within, most, starts)})
        return made[made["purity"].notna()]

    rows = pixels.select(*raster.PIXEL, *[F.col(c).cast("double").alias(c) for c in "lab"], "fg", F.xxhash64("y", "x").alias("draw"))
    return raster.stacked(rows, ["l", "a", "b", "fg", "draw"], run, f"img {dict(pixels.dtypes)['img']}, purity double")


CRAFT = "fg_frac double, palette_de double, flatness double, interior_de double, cut_residual double, fragments long, chroma double, conformance double, purity double"


def craft(pixels: DataFrame, palette: list[tuple[float, float, float]], share: float, flat: float = 6.0) -> DataFrame:
    """The craft figures of each picture of pixels (``img``, ``y``, ``x``, ``l``, ``a``, ``b``); the last palette colour is the ground. All but
    ``fg_frac`` are null where fewer than 50 pixels are foreground."""
    ground, colours = len(palette) - 1, np.array(palette, np.float64)

    def run(img: np.ndarray, at: tuple, *arrays: np.ndarray) -> pd.DataFrame:
        lab, there = arrays[:3], np.zeros(arrays[0].shape, bool)
        there[at] = True
        fg = there & ~((lab[0] > 90) & (np.hypot(lab[1], lab[2]) < 10))
        k, de = grids.matched(*lab, colours)
        cut, region, inner, islands = _fit(np.where(there, k, 0), ground, share)
        area = np.maximum(np.bincount(region[at], minlength=region.max() + 1), 1)
        mean = tuple((np.bincount(region[at], c[at], minlength=len(area)) / area)[region] for c in lab)
        steps = [s / 8 for c in lab for s in grids.slopes(c)]
        slope = np.sqrt(sum(s**2 for s in steps))

        def over(v: np.ndarray, where: np.ndarray = fg) -> np.ndarray:
            n = where.sum(axis=(1, 2))
            return np.where(n > 0, np.where(where, v, 0).sum(axis=(1, 2)) / np.maximum(n, 1), np.nan)

        made = pd.DataFrame({
            "palette_de": over(de), "flatness": over(slope < flat), "interior_de": over(grids.delta_e(lab, mean), fg & inner), "cut_residual": over(grids.delta_e(lab, of_colours(cut, colours))),
            "fragments": pd.array(islands, "Int64"), "chroma": over(np.hypot(lab[1], lab[2])), "conformance": over(de < 5), "purity": _purity(*lab, fg, arrays[3]),
        })
        made.loc[fg.sum(axis=(1, 2)) < 50] = np.nan
        return made.assign(img=img, fg_frac=fg.sum(axis=(1, 2)) / there.sum(axis=(1, 2)))

    rows = pixels.select(*raster.PIXEL, *[F.col(c).cast("double").alias(c) for c in "lab"], F.xxhash64("y", "x").alias("draw"))
    return raster.stacked(rows, ["l", "a", "b", "draw"], run, f"img {dict(pixels.dtypes)['img']}, {CRAFT}")


def _fit(m: np.ndarray, ground: int, share: float) -> tuple[np.ndarray, ...]:
    cut, islands, _ = projected(m, ground, share)
    edge = np.zeros(cut.shape, bool)
    for a, b in ((np.s_[:, 1:], np.s_[:, :-1]), (np.s_[:, :, 1:], np.s_[:, :, :-1])):
        differs = cut[a] != cut[b]
        edge[a] |= differs
        edge[b] |= differs
    return cut, raster.flood(cut), ~dilated(edge, 1), islands


@F.udtf(returnType="alpha double, pieces long, change double")
class swept:  # noqa: N801
    """A row for each share: the pieces of the plan of a label map (``labels`` in reading order, ``width``; the ground is 0) whose pieces under this
    share are merged, and the part of its pixels that changed. The voted map and its first labelling serve all shares."""

    def eval(self, labels: list[int], width: int, shares: list[float]):
        m = np.array(labels, np.int64).reshape(-1, width)
        base = grids.voted(m, 2)
        area = raster.sized(base)
        for share in sorted(shares):
            least = max(1, int(share * m.size))
            cut, small = base, area < least
            for _ in range(3):
                if not small.any() or small.all():
                    break
                cut = raster.nearest_kept(cut, small)
                small = raster.sized(cut) < least
            p = raster.flood(cut)
            yield float(share), int(len(np.unique(p[cut != 0]))), float((cut != m).mean())
