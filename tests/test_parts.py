"""Queries whose rows are expanded are dealt first, and join no pixels: Spark would take them for as few bytes as the file has."""

import numpy as np
import pytest

import __spark_entry__
from loomstat.operators import grids, projection, raster
from test_pictures import maps

SF = "/root/testdata/sf0.001"
PIXELS = ["cutline_against_edge", "decoration_density", "edge_difference", "energy_terms", "erosion", "line_classes", "line_gaps", "mode_filter", "morphology", "nearest_palette", "png_round_trip", "regional_means", "symmetry", "craft_figures", "perturbation_check"]


@pytest.mark.parametrize("name", PIXELS)
def test_no_pixels_are_broadcast(spark, name):
    plan = __spark_entry__.queries()[name](spark, SF)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "Broadcast" not in plan and "REPARTITION_BY_NUM" in plan


@pytest.mark.parametrize("stack", [1, 300, 1 << 16])
def test_stacks_are_whole_pictures(spark, monkeypatch, stack):
    monkeypatch.setattr(raster, "STACK", stack)
    draw = np.random.default_rng(3)
    pics = {i: draw.integers(0, 4, (12 + i % 2, 12)) for i in range(9)}
    rows = [(i, y, x, int(m[y, x])) for i, m in pics.items() for y in range(len(m)) for x in range(12)]
    px = spark.createDataFrame(rows, "img int, y int, x int, label int").repartition(5)
    got = {(r["img"], r["y"], r["x"]): r["piece"] for r in raster.pieces(px).collect()}
    assert len(got) == len(rows) and all(got[i, y, x] == p[y, x] for i, m in pics.items() for p in [grids.labelled(m)] for y in range(len(m)) for x in range(12))


def test_stacks_are_their_pictures():
    draw = np.random.default_rng(5)
    m = np.stack([x for x in maps(6) if x.shape == maps(1)[0].shape])
    m = np.concatenate([m, np.zeros_like(m[:1]), draw.integers(0, 3, m[:1].shape)])
    kept = m == 1
    assert all((a == b).all() for a, b in zip(grids.nearest(kept), np.stack([grids.nearest(k) for k in kept], axis=1), strict=True))
    for width in (0, 3):
        made = projection.projected(m, 0, 0.05, width=width)
        for i, one in enumerate(m):
            cut, first, merged = projection.projected(one, 0, 0.05, width=width)
            assert (made[0][i] == cut).all() and (made[1][i], made[2][i]) == (first, merged)
    lab = tuple(draw.uniform(-60, 60, m.shape) for _ in range(3))
    for f in (projection.silhouette, projection.skeleton, projection.contour):
        assert (f(kept) == np.stack([f(k) for k in kept])).all()
    assert (grids.edge_map(*lab, 1.0) == np.stack([grids.edge_map(*[c[i] for c in lab], 1.0) for i in range(len(m))])).all()
    made = projection.evaluation(*lab, kept, projection.silhouette(kept, 2), 1.0)
    for i in range(len(m)):
        one = projection.evaluation(*[c[i] for c in lab], kept[i], projection.silhouette(kept[i], 2), 1.0)
        assert {k: v[i] for k, v in made.items()} == pytest.approx(one)
