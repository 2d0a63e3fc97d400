"""Figures of pictures and comparisons that no SQL states, against plain loops and the rows that they are made of."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import scalars as S
from loomstat.operators import agg, grids, projection, similarity
from loomstat.plans import relational
from loomstat.sources import readers
from test_pictures import FOUR, comps

SF = "/root/testdata/sf0.001"
PALETTE = [(20.0, 0.0, 0.0), (50.0, 60.0, 40.0), (60.0, -40.0, 30.0), (95.0, 0.0, 2.0)]


def far(one, two):
    return float(grids.delta_e(*[tuple(np.array([float(c)]) for c in x) for x in (one, two)])[0])


def test_differences_are_the_expressions(spark):
    draw = np.random.default_rng(1)
    rows = [(*map(float, draw.uniform(-60, 60, 6)),) for _ in range(200)] + [(50.0, 0.0, 0.0, 60.0, 0.0, 0.0), (50.0, 2.5, 0.0, 50.0, 0.0, -2.5), (50.0, 2.5, 0.0, 50.0, 3.1736, 0.5854), (1.0, 0.0, 5.0, 1.0, 0.0, -5.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l double, a double, b double, l2 double, a2 double, b2 double")
    made = S.with_ciede2000(df, tuple(F.col(c) for c in "lab"), tuple(F.col(f"{c}2") for c in "lab"), "de").orderBy("i").collect()
    assert [r["de"] for r in made] == pytest.approx([far(r[:3], r[3:]) for r in rows], abs=1e-9)
    assert far(*[rows[-3][:3], rows[-3][3:]]) == pytest.approx(4.3065, abs=1e-4) and far(*[rows[-2][:3], rows[-2][3:]]) == pytest.approx(1.0, abs=1e-4)  # published pairs


def test_colours_there_and_back(spark):
    rows = [(r, g, b) for r in range(0, 256, 51) for g in range(0, 256, 51) for b in range(0, 256, 51)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    back = S.lab_rgb(*S.rgb_lab(*[F.col(c) / 255.0 for c in "rgb"]))
    assert all(tuple(x)[:3] == tuple(x)[3:] for x in df.select("r", "g", "b", *back).collect())


def test_craft_figures_brute(spark):
    """Every figure but purity, from loops over the pixels."""
    draw = np.random.default_rng(4)
    label = np.kron(draw.integers(0, 4, (5, 5)), np.ones((3, 3), int))
    lab = np.array(PALETTE)[label] + draw.normal(0, 3, (15, 15, 3))
    rows = [(1, y, x, *map(float, lab[y, x])) for y in range(15) for x in range(15)]
    share = 6 / 225
    got = projection.craft(spark.createDataFrame(rows, "img int, y int, x int, l double, a double, b double"), PALETTE, share).first()
    cells = [(y, x) for y in range(15) for x in range(15)]
    fg = [p for p in cells if not (lab[p][0] > 90 and math.hypot(lab[p][1], lab[p][2]) < 10)]
    k, de = np.zeros((15, 15), int), {}
    for p in cells:
        first = sorted(range(4), key=lambda j: (math.dist(lab[p], PALETTE[j]), j))[:3]
        k[p] = min(first, key=lambda j: (far(lab[p], PALETTE[j]), first.index(j)))
        de[p] = far(lab[p], PALETTE[k[p]])
    cut, islands, _ = projection.projected(k, 3, share)
    at = lambda y, x: lab[min(max(y, 0), 14), min(max(x, 0), 14)]
    slope = {}
    for y, x in cells:
        gy = sum(w * (at(y + 1, x + d) - at(y - 1, x + d)) for d, w in ((-1, 1), (0, 2), (1, 1))) / 8
        gx = sum(w * (at(y + d, x + 1) - at(y + d, x - 1)) for d, w in ((-1, 1), (0, 2), (1, 1))) / 8
        slope[y, x] = math.sqrt((gy**2).sum() + (gx**2).sum())
    edge = {(y, x) for y, x in cells for a, b in FOUR if (y + a, x + b) in de and cut[y + a, x + b] != cut[y, x]}
    inner = [(y, x) for y, x in fg if not any((y + a, x + b) in edge for a, b in [(0, 0), *FOUR])]
    mean = {p: lab[tuple(zip(*c, strict=True))].mean(axis=0) for j in range(4) for c in comps([q for q in cells if cut[q] == j], FOUR) for p in c}
    avg = lambda v: float(np.mean(v))
    want = {
        "fg_frac": len(fg) / 225, "palette_de": avg([de[p] for p in fg]), "flatness": avg([slope[p] < 6 for p in fg]), "interior_de": avg([far(lab[p], mean[p]) for p in inner]),
        "cut_residual": avg([far(lab[p], PALETTE[cut[p]]) for p in fg]), "fragments": islands, "chroma": avg([math.hypot(lab[p][1], lab[p][2]) for p in fg]), "conformance": avg([de[p] < 5 for p in fg]),
    }
    assert {c: got[c] for c in want} == pytest.approx(want) and 0 < got["purity"] <= 1 and len(inner) > 5


def test_purity_of_own_colours(spark):
    """Eight flat colours are their own centres; even noise has pixels far from any."""
    draw = np.random.default_rng(2)
    flat = draw.uniform(-40, 40, (8, 3)) + [50, 0, 0]
    rows = [(1, i // 20, i % 20, *map(float, flat[i % 8]), True) for i in range(400)] + [(2, i // 20, i % 20, *map(float, draw.uniform(-60, 60, 3)), True) for i in range(400)]
    got = {r["img"]: r["purity"] for r in projection.purity(spark.createDataFrame(rows, "img int, y int, x int, l double, a double, b double, fg boolean"), starts=8).collect()}
    assert got[1] == 1.0 and got[2] < 0.3


def test_record_is_the_comparison(spark):
    wide = {(r["a"], r["b"]): r for r in relational.comparison_record(spark, SF).collect()}
    rows = relational.compared(spark, SF).collect()
    assert len(wide) == len({(r["a"], r["b"]) for r in rows}) > 1
    for r in rows:
        w = wide[r["a"], r["b"]]
        assert w[f"{r['metric']}_improved"] == (r["better"] == "a")
        assert [w[f"{r['metric']}_{n}"] for n in ("before", "after", "diff", "lo", "hi", "p")] == pytest.approx([r["mean_b"], r["mean_a"], r["diff"], r["ci_lo"], r["ci_hi"], r["p_holm"]])


def test_palette_sweep_is_the_nearest_centres(spark):
    v = [(r["vec_id"], np.array(r["embedding"], float)) for r in readers.table(spark, SF, "embeddings").collect()]
    train = readers.table(spark, SF, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v")).where("vec_id % 5 < 4")  # the draw of starts is by partition
    got = {r["k"]: r for r in relational.palette_sweep(spark, SF).collect()}
    assert sorted(got) == [8, 12, 16, 24]
    made = similarity.kmeans_centres(train, "v", 8).collect()
    c = np.array([r["centre"] for r in made])
    rest = np.array([x for i, x in v if i % 5 == 4])
    assert got[8]["distance"] == pytest.approx(np.sqrt(((rest[:, None] - c) ** 2).sum(-1)).min(1).mean(), abs=1e-5)
    assert got[8]["smallest_weight"] == pytest.approx(min(r["weight"] for r in made), abs=1e-5)
    near = ((np.array([x for i, x in v if i % 5 < 4])[:, None] - c) ** 2).sum(-1).argmin(1)
    assert [r["weight"] for r in made] == pytest.approx(np.bincount(near, minlength=8) / len(near)) and [r["weight"] for r in made] == sorted((r["weight"] for r in made), reverse=True)


def test_sheets_brute(spark):
    m = np.array([[0, 0, 1, 1], [2, 2, 2, 1], [0, 0, 3, 1]])
    light = {0: 95.0, 1: 50.0, 2: 60.0, 3: 40.0}
    px = spark.createDataFrame([(1, y, x, int(m[y, x]), light[int(m[y, x])]) for y in range(3) for x in range(4)], "img int, y int, x int, label int, light double")
    got = sorted(tuple(r) for r in agg.sheets(px, 0, 0.1).collect())
    assert got == [(1, 1, 4, 0.5, 1), (1, 2, 3, 0.375, 2)]  # label 3 covers a twelfth


def test_nearest_by_shares_brute(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "CHUNK", 3)
    p = np.random.default_rng(5).dirichlet([0.5] * 4, 40)
    p[3] = p[9]
    p[5] = [1, 0, 0, 0]
    p[6] = [0, 1, 0, 0]
    kl = lambda a, m: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
    js = lambda a, b: math.sqrt(max((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2, 0))
    got = {r["query"]: (r["id"], r["js"]) for r in similarity.js_nearest(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(p)], "id long, v array<double>")).collect()}
    for i in range(40):
        d, j = min((round(js(p[i], p[j]), 9), j) for j in range(40) if j != i)
        assert got[i][0] == j and got[i][1] == pytest.approx(d, abs=1e-8)
