"""Projection, line geometry and layering against plain loops over pixels, and other operators without SQL."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import scalars as S
from loomstat.operators import inference, projection, raster, similarity, tracing
from loomstat.sources import readers, sinks
from loomstat.streaming import runs


def maps(n=12, size=14, labels=3):
    draw = np.random.default_rng(5)
    return [np.kron(draw.integers(0, labels, (size // 2, size // 2)), np.ones((2, 2), int)) ^ (draw.random((size, size)) < 0.08) for _ in range(n)]


def pixels(spark, m, img=1):
    return spark.createDataFrame([(img, y, x, int(m[y, x])) for y in range(m.shape[0]) for x in range(m.shape[1])], "img int, y int, x int, label int")


def comps(cells, ways):
    left, out = set(cells), []
    while left:
        todo, seen = [left.pop()], []
        while todo:
            y, x = todo.pop()
            seen.append((y, x))
            for dy, dx in ways:
                if (q := (y + dy, x + dx)) in left:
                    left.remove(q)
                    todo.append(q)
        out.append(sorted(seen))
    return sorted(out)


def brute_edges(v, sigma, low, high):
    """The published steps, pixel by pixel."""
    h, w = v.shape
    r = int(4 * sigma + 0.5)
    g = {k: math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)}
    s = np.zeros((h, w))
    for y in range(h):
        for x in range(w):
            inside = [(g[a] * g[b], v[y + a, x + b]) for a in g for b in g if 0 <= y + a < h and 0 <= x + b < w]
            s[y, x] = sum(k * z for k, z in inside) / sum(k for k, _ in inside)
    at = lambda y, x: s[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    dy = np.array([[sum(k * (at(y + 1, x + b) - at(y - 1, x + b)) for b, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)])
    dx = np.array([[sum(k * (at(y + a, x + 1) - at(y + a, x - 1)) for a, k in ((-1, 1), (0, 2), (1, 1))) for x in range(w)] for y in range(h)])
    size = np.sqrt(dy**2 + dx**2)
    ridge = {}
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gy, gx = float(dy[y, x]), float(dx[y, x])
            if size[y, x] < low:
                continue
            sy, sx = (gy > 0) - (gy < 0), (gx > 0) - (gx < 0)
            if abs(gy) > abs(gx):
                t, one, two = abs(gx) / abs(gy), size[y + sy, x], size[y - sy, x]
            else:
                t, one, two = abs(gy) / abs(gx), size[y, x + sx], size[y, x - sx]
            if (1 - t) * one + t * size[y + sy, x + sx] <= size[y, x] and (1 - t) * two + t * size[y - sy, x - sx] <= size[y, x]:
                ridge[y, x] = size[y, x]
    out = np.zeros((h, w), bool)
    for c in comps(list(ridge), EIGHT):
        if any(ridge[p] >= high for p in c):
            for p in c:
                out[p] = True
    return out


FOUR = [(0, 1), (0, -1), (1, 0), (-1, 0)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]


def regions(m, ground=0):
    out = {0: [(y, x) for y, x in np.argwhere(m == ground).tolist()]}
    for k in sorted(set(m.ravel().tolist()) - {ground}):
        for c in comps([tuple(p) for p in np.argwhere(m == k).tolist()], FOUR):
            out[len(out)] = c
    return out


def tree(m):
    """Parents and depths by the definition, one region at a time."""
    r = regions(m)
    of = {p: k for k, c in r.items() for p in c}
    border = {k: Counter() for k in r}
    for (y, x), k in of.items():
        for dy, dx in FOUR:
            if (j := of.get((y + dy, x + dx))) is not None and j != k:
                border[k][j] += 1
    laid, parent, depth = {0}, {0: 0}, {0: 0}
    while len(laid) < len(r):
        share = lambda k: sum(n for j, n in border[k].items() if j in laid) / sum(border[k].values()) if border[k] else 2.0
        k = max((k for k in r if k not in laid), key=lambda k: (share(k), -k))
        on_board = not border[k] or share(k) == 0 or border[k][0] / sum(border[k].values()) >= 0.25
        parent[k] = 0 if on_board else max((n, j) for j, n in border[k].items() if j in laid)[1]
        depth[k] = depth[parent[k]] + 1
        laid.add(k)
    return r, parent, depth


def outline(cells, m):
    s = set(cells)
    sides = sum((y + dy, x + dx) not in s for y, x in s for dy, dx in FOUR)
    away = [(y, x) for y in range(-1, m.shape[0] + 1) for x in range(-1, m.shape[1] + 1) if (y, x) not in s]
    holes = len(comps(away, EIGHT)) - 1
    return sides, holes, sides + 1 + holes


def test_containment_and_statistics_brute(spark):
    for m in maps(4, 12):
        r, parent, depth = tree(m)
        t = raster.containment(m)
        ids = range(1, len(r))
        assert t["parent"].tolist() == [parent[k] for k in ids] and t["depth"].tolist() == [depth[k] for k in ids]
        assert t["area"].tolist() == [len(r[k]) for k in ids] and t["label"].tolist() == [m[r[k][0]] for k in ids]
        whole = {k: [p for j in ids if k in (lambda j: [j, *iter_up(j, parent)])(j) for p in r[j]] for k in ids}
        got = raster.layer_statistics(pixels(spark, m), mm=0.5).first()
        d = [depth[k] for k in ids]
        lines = {k: outline(r[k], m) for k in ids}
        assert (got["pieces"], got["layers"], got["base_pieces"], got["depth2"], got["holes_flat"]) == (len(d), max(d), d.count(1), d.count(2), sum(x[1] for x in lines.values()))
        assert got["decoration_share"] == pytest.approx(np.mean(np.array(d) >= 2))
        assert got["cut_length_flat_mm"] == 0.5 * sum(x[2] for x in lines.values())
        assert got["cut_length_layered_mm"] == 0.5 * sum(outline(whole[k], m)[2] for k in ids)
        assert got["largest_piece_mm2"] == 0.25 * max(map(len, whole.values())) and got["median_piece_mm2"] == 0.25 * np.median([len(x) for x in whole.values()])
    bare = raster.containment(np.zeros((3, 3), int))
    assert len(bare["region"]) == 0 and raster.layer_statistics(pixels(spark, np.zeros((3, 3), int))).count() == 0
    full = raster.containment(np.ones((3, 3), int))
    assert full["parent"].tolist() == [0] and full["depth"].tolist() == [1]


def iter_up(k, parent):
    while parent[k]:
        k = parent[k]
        yield k


def brute_disk(mask, r, want, disk=True):
    out = np.zeros_like(mask)
    for y, x in np.ndindex(mask.shape):
        seen = [mask[y + a, x + b] if 0 <= y + a < mask.shape[0] and 0 <= x + b < mask.shape[1] else False for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
        out[y, x] = want(seen)
    return out


def test_morphology_brute():
    for m in maps(5):
        mask = m > 0
        for r in (1, 2):
            assert (projection.dilated(mask, r) == brute_disk(mask, r, any)).all() and (projection.eroded(mask, r) == brute_disk(mask, r, all)).all()
            assert (projection.opened(mask, r) == brute_disk(brute_disk(mask, r, all), r, any)).all() and not (projection.opened(mask, r) & ~mask).any()
        outside = [c for c in comps([(y, x) for y in range(-1, 15) for x in range(-1, 15) if not (0 <= y < 14 and 0 <= x < 14 and mask[y, x])], FOUR) if (-1, -1) in c][0]
        assert projection.filled(mask).sum() == 14 * 14 - len([p for p in outside if min(p) >= 0 and max(p) < 14])
        thin = projection.skeleton(mask)
        assert not (thin & ~mask).any() and (projection.skeleton(thin) == thin).all()
        pieces = lambda a: len(comps([tuple(p) for p in np.argwhere(a).tolist()], EIGHT))
        assert pieces(thin) == pieces(mask)
        y, x, n = projection.window_of_most(mask, 5)
        counts = {(a, b): mask[a : a + 5, b : b + 5].sum() for a in range(10) for b in range(10)}
        assert (y, x) == min(counts, key=lambda k: (-counts[k], k)) and n == counts[y, x]


def brute_constrained(m, least):
    for _ in range(10):
        bad = {p for k in np.unique(m) for c in comps([tuple(p) for p in np.argwhere(m == k).tolist()], FOUR) if len(c) < least for p in c}
        for k in np.unique(m[m > 0]):
            bad |= {tuple(p) for p in np.argwhere((m == k) & ~brute_disk(brute_disk(m == k, 1, all), 1, any)).tolist()}
        kept = [p for p in np.ndindex(m.shape) if p not in bad]
        if not bad or not kept:
            break
        m = np.array([[m[min(kept, key=lambda q: ((q[0] - y) ** 2 + (q[1] - x) ** 2, q))] if (y, x) in bad else m[y, x] for x in range(m.shape[1])] for y in range(m.shape[0])])
    return m


def test_projection_brute():
    for m in maps(6):
        voted = np.zeros_like(m)
        for y, x in np.ndindex(m.shape):
            seen = Counter(m[min(max(y + a, 0), 13), min(max(x + b, 0), 13)] for a, b in raster.offsets(2))
            voted[y, x] = min(seen, key=lambda k: (-seen[k], k))
        assert (projection.voted(m, 2) == voted).all()
        cut, first, merged = projection.projected(m, 0, 10 / 196)
        small = [c for k in (0, 1, 2, 3) for c in comps([tuple(p) for p in np.argwhere(voted == k).tolist()], FOUR) if len(c) < 10]
        assert first == len(small) <= merged
        gone = {p for c in small for p in c}
        want = voted.copy()
        for y, x in gone:
            want[y, x] = voted[min(((b, a) for b in range(14) for a in range(14) if (b, a) not in gone), key=lambda q: ((q[0] - y) ** 2 + (q[1] - x) ** 2, q))]
        assert (raster.nearest_kept(voted, raster.sized(voted) < 10) == want).all()
        assert (projection.constrained(m, 0, 12, 3) == brute_constrained(m, 12)).all()
        assert projection.pieces_below(cut, 0, 10 / 196) <= merged
        below = [c for k in (1, 2, 3) for c in comps([tuple(p) for p in np.argwhere(m == k).tolist()], FOUR) if len(c) < 10]
        at = lambda cells: np.isin(np.arange(196).reshape(14, 14), [y * 14 + x for y, x in cells])
        left = {k: brute_disk(at([p for c in below for p in c if m[p] == k]), 1, all) for k in (1, 2, 3)}
        assert projection.slivers(m, 0, 10 / 196) == sum(not any(left[m[c[0]]][p] for p in c) for c in below)


def test_craft_of_flat_and_of_bare_pictures(spark):
    two = np.zeros((12, 12), int)
    two[3:9, 3:9] = 1
    colour = {0: (95.0, 0.0, 2.0), 1: (50.0, 60.0, 40.0)}
    rows = [(i, y, x, *colour[int(two[y, x]) * (i == 1)]) for i in (1, 2) for y in range(12) for x in range(12)]
    px = spark.createDataFrame(rows, "img int, y int, x int, l double, a double, b double")
    got = {r["img"]: r for r in projection.craft(px, [colour[1], colour[0]], 4 / 144).collect()}
    assert got[2]["fg_frac"] == 0 and got[2]["palette_de"] is None and got[1]["fg_frac"] == pytest.approx(36 / 144)
    assert got[1]["palette_de"] is None  # 36 pixels are too few
    big = px.where("img = 1").unionByName(px.where("img = 1").withColumn("y", F.col("y") + 12))
    one = projection.craft(big, [colour[1], colour[0]], 4 / 288).first()
    assert one["palette_de"] == pytest.approx(0) and one["conformance"] == 1 and one["purity"] == 1 and one["interior_de"] == pytest.approx(0)
    assert 0 < one["flatness"] < 1 and one["chroma"] == pytest.approx(math.hypot(60, 40)) and one["fragments"] == 0


def test_picture_hash_and_bits(spark):
    draw = np.random.default_rng(2)
    grey = [draw.random((32, 32)) * 255 for _ in range(3)]
    df = spark.createDataFrame([(i, [float(v) for v in g.ravel()]) for i, g in enumerate(grey)], "id int, g array<double>")
    got = {r["id"]: r["h"] for r in df.select("id", similarity.phash("g").alias("h")).collect()}
    for i, g in enumerate(grey):
        low = [[sum(g[y, x] * math.cos(math.pi * u * (2 * y + 1) / 64) * math.cos(math.pi * v * (2 * x + 1) / 64) for y in range(32) for x in range(32)) * math.sqrt((1 if u else 0.5) * (1 if v else 0.5)) / 16 for v in range(8)] for u in range(8)]
        bits = (np.array(low) > np.median(low)).ravel()
        assert got[i] & ((1 << 64) - 1) == int("".join("01"[int(b)] for b in bits), 2)
    v = [float(x) for x in draw.random(64)]
    told = spark.createDataFrame([(v,)], "v array<double>").select(S.bits_over_median(F.col("v")).alias("b")).first()["b"]
    assert told & ((1 << 64) - 1) == int("".join("01"[int(x > np.median(v))] for x in v), 2)


def test_shared_and_mean_bootstrap(spark):
    r = random.Random(1)
    rows = [(t, u, r.gauss(0.2, 1)) for t in ("x", "y") for u in range(9)] + [("alone", 1, 0.5)]
    got = {g["test"]: g for g in inference.bootstrap_shared(spark.createDataFrame(rows, "test string, unit int, d double"), ["test"], "unit", rounds=200).collect()}
    draw = np.random.default_rng(0)
    for t in ("x", "y"):
        d = np.array([x for k, _, x in rows if k == t])
        lo, hi = np.percentile([draw.choice(d, len(d)).mean() for _ in range(200)], [2.5, 97.5])
        assert (got[t]["ci_lo"], got[t]["ci_hi"], got[t]["n"]) == (pytest.approx(lo), pytest.approx(hi), 9)
    assert set(got) == {"x", "y"}
    one = inference.bootstrap_mean(spark.createDataFrame([*rows, ("x", 99, None)], "test string, unit int, d double").where("test = 'x'"), ["test"], "d", "unit").first()
    d = np.array([x for k, _, x in rows if k == "x"])
    m = np.random.default_rng(0).choice(d, (2000, 9)).mean(1)
    assert (one["n"], one["mean"], one["ci_lo"]) == (9, pytest.approx(d.mean()), pytest.approx(np.percentile(m, 2.5)))
    p = spark.createDataFrame([("m", u, d_) for u, d_ in enumerate([0.3, -0.1, 0.7, 0.2])], "metric string, unit int, d double")
    b = inference.bootstrap_pcg64(p, ["metric"], "unit", rounds=500).first()
    d = np.array([0.3, -0.1, 0.7, 0.2])
    m = d[np.random.default_rng(0).integers(0, 4, (500, 4))].mean(1)
    assert (b["ci_lo"], b["ci_hi"]) == (pytest.approx(np.percentile(m, 2.5)), pytest.approx(np.percentile(m, 97.5)))


def test_values_equal_but_for_rounding_differ_by_nothing(spark):
    rows = [(m, u, 1.0 + u + (1e-12 * (u + 1) if m == "a" else 0.0)) for m in "ab" for u in range(8)]
    made = inference.compare(spark.createDataFrame(rows, "method string, unit int, v double"), "method", "unit", {"v": True}, [("a", "b")]).first()
    assert made["p"] == 1.0


def test_centres_are_means_of_their_rows(spark):
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(c, 0.1, (n, 5)) for c, n in ((0, 30), (4, 20), (9, 10))])
    rows = spark.createDataFrame([([float(v) for v in p],) for p in x], "v array<double>")
    got = similarity.kmeans_centres(rows, "v", 3, starts=4).orderBy("place").collect()
    assert [r["weight"] for r in got] == pytest.approx([0.5, 1 / 3, 1 / 6])
    for r, part in zip(got, (x[:30], x[30:50], x[50:]), strict=True):
        assert r["centre"] == pytest.approx(part.mean(0).tolist())


def test_centres_do_not_depend_on_parts_or_repeats(spark):
    x = np.random.default_rng(5).uniform(0, 1, (120, 3)).round(3)  # no groups, so that other draws would end elsewhere
    rows = spark.createDataFrame([([float(v) for v in p],) for p in x], "v array<double>")
    told = [similarity.kmeans_centres(r, "v", 6, starts=2).orderBy("place").collect() for r in (rows.coalesce(1), rows.repartition(7), rows.unionByName(rows))]
    for made in told[1:]:
        assert [r["weight"] for r in made] == pytest.approx([r["weight"] for r in told[0]])
        for r, w in zip(made, told[0], strict=True):
            assert r["centre"] == pytest.approx(w["centre"])


def test_jobs_and_watcher(spark, tmp_path):
    ran = []
    told = runs.jobs({"a": lambda: ran.append("a"), "b": lambda: ran.append("b"), "c": lambda: 1 / 0}, lambda n: n == "a")
    assert told == {"a": "skipped", "b": "ok", "c": "ZeroDivisionError: division by zero"} and ran == ["b"]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    stream = lambda: spark.readStream.schema("id long").parquet(source)
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).write.mode("append").parquet(source)
        assert runs.watch(stream(), out, state).count() == (k + 1) * 10
    assert runs.watch(stream(), out, state).count() == 30


def test_survey_holds_its_questions(spark):
    page = sinks.survey(spark.createDataFrame([(2, "b </script>"), (1, "a")], "id int, text string"), ["id"], "T").first()["html"]
    assert page.count("</script>") == 1 and page.index('"id":1') < page.index('"id":2')


def test_plan_checks_brute():
    for m in [*maps(6), np.zeros((5, 5), int), np.ones((5, 5), int)]:
        cells = [(y, x) for y, x in np.ndindex(m.shape)]
        pieces = [set(c) for k in (1, 2, 3) for c in comps([p for p in cells if m[p] == k], FOUR)]
        rest, holes = [], 0
        for c in pieces:
            own = np.array([[(y, x) in c for x in range(m.shape[1])] for y in range(m.shape[0])])
            rest.append(int((own & ~brute_disk(brute_disk(own, 1, all), 1, any)).sum()))
            holes += max(0, len(comps([p for p in cells if p not in c], FOUR)) - 1)
        got = projection.plan_checks(m, 0, 8, 1, 2)
        assert got["pieces"] == len(pieces) and got["below"] == sum(len(c) < 8 for c in pieces) and got["holes"] == holes
        assert got["thin_pieces"] == sum(r > 2 for r in rest) and got["smallest"] == min(map(len, pieces), default=None)
        assert got["thin_share"] == pytest.approx(sum(rest) / max(sum(map(len, pieces)), 1))


LABS = np.array([(95.0, 0.0, 2.0), (50.0, 60.0, 40.0), (60.0, -40.0, 30.0), (40.0, 20.0, -50.0)])


def near_scores(found, wanted, tol):
    near = lambda a, b: np.mean([min((y - v) ** 2 + (x - u) ** 2 for v, u in b) <= tol * tol for y, x in a])
    a, b = np.argwhere(found).tolist(), np.argwhere(wanted).tolist()
    if not a or not b:
        return 0.0, 0.0, 0.0
    p, r = near(a, b), near(b, a)
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def brute_figure(l, a, b):  # noqa: E741
    """Closed by a disk and filled; beyond the picture nothing keeps a pixel from being closed."""
    m = ~((l > 90) & (np.hypot(a, b) < 10))
    grown = brute_disk(m, 2, any)
    shut = ~brute_disk(~grown, 2, any)
    outside = [c for c in comps([(y, x) for y in range(-1, m.shape[0] + 1) for x in range(-1, m.shape[1] + 1) if not (0 <= y < m.shape[0] and 0 <= x < m.shape[1] and shut[y, x])], FOUR) if (-1, -1) in c][0]
    return ~np.isin(np.arange(m.size).reshape(m.shape), [y * m.shape[1] + x for y, x in outside if 0 <= y < m.shape[0] and 0 <= x < m.shape[1]])


def test_evaluation_brute():
    draw = np.random.default_rng(2)
    for m in maps(4, 24, 4):
        lab = [LABS[m][..., i] + draw.normal(0, 1, m.shape) for i in range(3)]
        lines = draw.random(m.shape) < 0.08
        shape = projection.silhouette(lines, 2)
        got = projection.evaluation(*lab, lines, shape, sigma=1.0)
        edges = brute_edges(lab[0], 1.0, 4, 10) | brute_edges(0.6 * lab[1], 1.0, 4, 10) | brute_edges(0.6 * lab[2], 1.0, 4, 10)
        thin, own = projection.skeleton(lines), brute_figure(*lab)
        for tol in (2, 3, 5):
            assert (got[f"edge_prec_t{tol}"], got[f"line_recall_t{tol}"], got[f"edge_f1_t{tol}"]) == pytest.approx(near_scores(edges, thin, tol))
        rim = lambda x: x & ~brute_disk(x, 1, all)
        assert got["contour_f"] == pytest.approx(near_scores(rim(own), rim(shape), 3)[2])
        assert got["sil_iou"] == (own & shape).sum() / max((own | shape).sum(), 1)
        far = [p for p in np.argwhere(edges & shape).tolist() if min((p[0] - v) ** 2 + (p[1] - u) ** 2 for v, u in np.argwhere(thin).tolist()) > 9]
        assert got["decoration_density"] == pytest.approx(1000 * len(far) / max(shape.sum(), 1))
        assert (projection.bare_ground(lines, 4, 2) == ~brute_disk(shape, 4, any)).all()


def test_protocol_and_variants_brute(spark):
    draw = np.random.default_rng(3)
    settings = [("none", 0.0, False), ("some", 0.02, True), ("most", 0.2, False)]
    for m in maps(3, 20, 4):
        lab = tuple(LABS[m][..., i] + draw.normal(0, 2, m.shape) for i in range(3))
        lines, bare = draw.random(m.shape) < 0.1, np.arange(20)[:, None] + 0 * m < 3
        shape = projection.silhouette(lines, 2)
        rows = projection.protocol(lab, m, LABS, 0, lines, shape, bare, settings, 100.0, 1.0)
        for row, (name, share, ground) in zip(rows, settings, strict=True):
            cut = projection.projected(m, 0, share, bare=bare if ground else None)[0] if share else m
            sizes = [len(c) for k in (1, 2, 3) for c in comps([tuple(p) for p in np.argwhere(cut == k).tolist()], FOUR)]
            plan = [np.array([[LABS[cut[y, x]][i] for x in range(20)] for y in range(20)]) for i in range(3)]
            e = projection.evaluation(*plan, lines, shape, 1.0)
            assert (row["setting"], row["pieces"], row["sheets"]) == (name, len(sizes), sum((cut == k).mean() > 1e-3 for k in (1, 2, 3)))
            assert row["smallest_mm2"] == (min(sizes) * 0.25 if sizes else None)
            assert [row["prec"], row["recall"], row["edge_f1"], row["sil_iou"]] == [e["edge_prec_t3"], e["line_recall_t3"], e["edge_f1_t3"], e["sil_iou"]]
            px = spark.createDataFrame([tuple(float(c[y, x]) for c in (*lab, *plan)) for y in range(20) for x in range(20)], "l double, a double, b double, l2 double, a2 double, b2 double")
            each = S.with_ciede2000(px, tuple(F.col(c) for c in "lab"), tuple(F.col(f"{c}2") for c in "lab"), "de").agg(F.avg("de")).first()[0]
            assert row["change_de"] == pytest.approx(each)
        made = projection.variants(lab, m, LABS, 0, 0.02, bare)
        assert list(made) == ["raw", "ground only", "colour only", "colour + merge (no ground)", "full projection"]
        assert all((x == y).all() for x, y in zip(made["raw"], lab, strict=True))
        assert all((x == np.where(bare, LABS[0][i], y)).all() for i, (x, y) in enumerate(zip(made["ground only"], lab, strict=True)))
        full = projection.projected(m, 0, 0.02, bare=bare)[0]
        assert all((x == LABS[full][..., i]).all() for i, x in enumerate(made["full projection"]))


def test_delivered_plans_brute():
    colours = ["#ffffff", "#aa0000", "#00bb00", "#0000cc"]
    for m in maps(3, 20, 4):
        lines = np.random.default_rng(1).random(m.shape) < 0.1
        exact = projection.delivered(m, colours, 0, 8, 1, 2, LABS, lines, 0.0, 1.0)
        assert exact["agreement"] == 1.0 and exact["invalid_paths"] == 0
        assert {k: exact[k] for k in ("pieces", "below", "holes", "smallest")} == {k: v for k, v in projection.plan_checks(m, 0, 8, 1, 2).items() if k in ("pieces", "below", "holes", "smallest")}
        assert exact["paths"] == sum(len(tracing.rings(m == k)) for k in (1, 2, 3))
        rough = projection.delivered(m, colours, 0, 8, 1, 2, LABS, lines, 1.5, 1.0)
        shown = tracing.painted(tracing.svg(m, colours, 0, 1.5), colours, 0)
        assert rough["agreement"] == (shown == m).mean() < 1 and rough["pieces"] == projection.plan_checks(shown, 0, 8, 1, 2)["pieces"]


def test_delivered_stacks_are_their_pictures():
    colours = ["#ffffff", "#aa0000", "#00bb00", "#0000cc"]
    m = np.stack([*maps(4, 20, 4), np.zeros((20, 20), int)])
    lines = np.random.default_rng(2).random(m.shape) < 0.1
    for tolerance in (0.0, 1.5):
        made = projection.delivered(m, colours, 0, 8, 1, 2, LABS, lines, tolerance, 1.0)
        for i in range(len(m)):
            alone = projection.delivered(m[i], colours, 0, 8, 1, 2, LABS, lines[i], tolerance, 1.0)
            assert {k: v[i] for k, v in made.items()} == alone
    assert made["smallest"][-1] is None


def test_disturbed_pictures(spark):
    draw = np.random.default_rng(4)
    v = draw.uniform(0, 80, (3, 6, 6))
    df = spark.createDataFrame([(1, y, x, *map(float, v[:, y, x])) for y in range(6) for x in range(6)], "img int, y int, x int, l double, a double, b double")
    got = {(r["condition"], r["y"], r["x"]): (r["l"], r["a"], r["b"]) for r in projection.disturbed(df, 4.0).collect()}
    assert len(got) == 4 * 36
    for y, x in np.ndindex(6, 6):
        assert got["original", y, x] == pytest.approx(tuple(v[:, y, x]))
        assert got["blurred", y, x] == pytest.approx(tuple(v[:, max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2].mean((1, 2))))
        assert max(abs(p - q) for p, q in zip(got["noisy", y, x], v[:, y, x], strict=True)) <= 4
        assert got["shaded", y, x][0] == pytest.approx(min(v[0, y, x] * (0.65 + 0.6 * y / 5), 100))


def test_pictures_drawn_are_read_again(spark):
    m = maps(1)[0]
    drawn = sinks.svg(pixels(spark, m), {2: "#c00", 1: "#06c"}, 0.5)
    got = {(r["y"], r["x"]): r["fill"] for r in readers.svg_pixels(drawn).collect()}
    assert got == {(y, x): {1: "#06c", 2: "#c00"}[m[y, x]] for y, x in np.ndindex(m.shape) if m[y, x] in (1, 2)}
    assert readers.svg_pixels(sinks.svg(pixels(spark, m * 0), {1: "#06c"}, 0.5)).count() == 0
