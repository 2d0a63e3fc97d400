"""What holds at any size: pictures in squares, Hamming pairs by bands, pruned cosine pairs, ranks beside an outlier, streams that restart."""

import random
from collections import defaultdict
from statistics import fmean

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.operators import grids, inference, raster, similarity
from loomstat.streaming import runs
from test_pictures import maps


@pytest.mark.parametrize("side", [7, 16, 64])
def test_squares_give_the_pieces_of_whole_pictures(spark, side):
    draw = np.random.default_rng(side)
    big = np.kron(draw.integers(0, 2, (67, 67)), np.ones((3, 3), int))[:200, :200] ^ (draw.random((200, 200)) < 0.05)
    small = maps(1)[0]
    rows = [(img, y, x, int(m[y, x])) for img, m in ((1, big), (2, small)) for y in range(m.shape[0]) for x in range(m.shape[1])]
    px = spark.createDataFrame(rows, "img int, y int, x int, label int").repartition(4)
    made = raster.tiled_pieces(px, side, runs.written)
    got = {(r["img"], r["y"], r["x"]): (r["label"], tuple(r["piece"])) for r in made.collect()}
    assert len(got) == len(rows)
    for img, m in ((1, big), (2, small)):
        p = grids.labelled(m)
        first = {k: tuple(int(v) for v in np.unravel_index(i, m.shape)) for k, i in zip(*np.unique(p, return_index=True), strict=True)}
        assert all(got[img, y, x] == (m[y, x], (img, *first[p[y, x]])) for y in range(m.shape[0]) for x in range(m.shape[1]))


def test_pieces_with_holes_in_the_table(spark):
    """Pixels that a picture lacks part pieces."""
    px = spark.createDataFrame([(1, 0, x, 5) for x in range(20) if x != 9], "img int, y int, x int, label int")
    got = raster.tiled_pieces(px, 4, runs.written).groupBy("piece").count().collect()
    assert sorted((tuple(r["piece"]), r["count"]) for r in got) == [((1, 0, 0), 9), ((1, 0, 10), 10)]
    assert raster.tiled_pieces(px.limit(0), 4, runs.written).count() == 0


@pytest.mark.parametrize(("most", "block"), [(0, 8192), (3, 8192), (8, 8192), (8, 5), (20, 8192)])
def test_alike_pairs_brute(spark, monkeypatch, most, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    r = random.Random(most)
    seeds = [r.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    h = [s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 12))) for s in seeds for _ in range(8)] + seeds[:2] * 6
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in h]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    got = [tuple(x) for x in similarity.alike_pairs(df, most).select("a", "b", "bits").collect()]
    want = [(i, j, bin(h[i] ^ h[j]).count("1")) for i in range(len(h)) for j in range(i + 1, len(h)) if bin(h[i] ^ h[j]).count("1") <= most]
    assert sorted(got) == want and len(want) > 20
    plan = similarity.alike_pairs(df, most)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "ArrowPython" not in plan


def test_principal_directions_rule_out_rows_and_cells(monkeypatch):
    draw = np.random.default_rng(1)
    centres = draw.normal(size=(6, 32))
    m = np.repeat(centres, 50, axis=0) + 0.4 * draw.normal(size=(300, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    turn = np.linalg.eigh(m.T @ m)[1][:, ::-1]
    sim = m @ m.T
    for least in (0.97, 0.93, 0.4):
        i, j, s = similarity.close(m, m, turn, least)
        assert {*zip(i.tolist(), j.tolist(), strict=True)} == {*map(tuple, np.argwhere(sim > least).tolist())} and np.allclose(s, sim[i, j])
    turned = m @ turn
    low, high = (np.array([f(turned[50 * k : 50 * k + 50, :12], axis=0) for k in range(6)]) for f in (np.min, np.max))
    rest = np.array([np.linalg.norm(turned[50 * k : 50 * k + 50, 12:], axis=1).max() for k in range(6)])
    live = similarity.boxed_pairs(low, high, rest, 0.8)
    assert live.diagonal().all() and not live.all()
    for a in range(6):
        for b in range(6):
            assert live[a, b] or sim[50 * a : 50 * a + 50, 50 * b : 50 * b + 50].max() <= 0.8


def test_ranks_beside_an_outlier(spark):
    r = random.Random(4)
    values = [1e12, -1e12, 0.5, 0.5, None] + [r.random() for _ in range(20_000)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double")
    made = inference.ranked(df, "v", "rk", 64)
    known = sorted(v for v in values if v is not None)
    at = defaultdict(list)
    for i, v in enumerate(known, 1):
        at[v].append(i)
    assert all(x["rk"] == (None if x["v"] is None else fmean(at[x["v"]])) for x in made.collect())
    n = df.where("v is not null").groupBy(F.col("v").alias("_v")).count()
    bounds = n.agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(i / 64) for i in range(1, 64)]), F.lit(20 * 64)))).first()[0]
    sizes = np.bincount(np.searchsorted(bounds, [x["_v"] for x in n.collect()]))
    assert sizes.max() < 2 * sizes.mean()
    same = spark.createDataFrame([(i, 7.0) for i in range(9)], "id int, v double")
    assert {x["rk"] for x in inference.ranked(same, "v", "rk").collect()} == {5.0}
    assert inference.ranked(same.limit(0), "v", "rk").count() == 0


def log(spark, rows):
    return spark.createDataFrame(rows, "user int, kind string, value double, ts timestamp, id long")


def made_log(n=300):
    import datetime as dt

    r, at, out = random.Random(6), dt.datetime(2024, 1, 1), []
    for i in range(n):
        at += dt.timedelta(minutes=r.randrange(0, 90))
        out.append((r.randrange(5), "ab"[r.randrange(2)], round(r.random(), 3), at, i))
    return out


@pytest.mark.parametrize("cuts", [[300], [120, 300], [1, 50, 51, 300]])
def test_keyed_state_over_restarts(spark, cuts):
    rows = made_log()
    parts = [log(spark, rows[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
    got = runs.stepwise(parts, "ts", lambda e: runs.dwell_state(e, ["user", "kind"], "value", "value", "ts", "id", 4 * 3600)).collect()
    want, at = [], {}
    for user, kind, value, ts, _ in rows:
        k = (user, kind)
        if k in at and (ts - at[k][3]).total_seconds() > 4 * 3600:
            want.append((*k, *at.pop(k)))
        total, _, n, _ = at.get(k, (0.0, None, 0, None))
        at[k] = (total + value, value, n + 1, ts)
    want += [(*k, *v) for k, v in at.items()]
    near = lambda xs: sorted((u, k, round(d, 6), s, n, str(t)) for u, k, d, s, n, t in xs)
    by_key = lambda xs: sorted((u, k, round(sum(x[2] for x in xs if x[:2] == (u, k)), 6), sum(x[4] for x in xs if x[:2] == (u, k))) for u, k in {x[:2] for x in xs})
    got = [tuple(x) for x in got]
    assert by_key(got) == by_key(want)
    # a timer ends where a later batch's watermark has passed it, so one batch doesn't part what several do
    assert len(got) <= len(want) and {x[5] for x in near(got)} <= {x[5] for x in near(want)}


def test_keyed_state_needs_no_python_and_parts_at_gaps(spark):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, "a", None, at(0), 0), (1, "a", None, at(240), 1), (1, "a", 2.0, at(481), 2), (2, None, 1.0, at(5), 3), (2, None, 4.0, at(5), 4), (3, "a", None, at(9), 5)]
    state = lambda e: runs.dwell_state(e, ["user", "kind"], "value", "value", "ts", "id", 4 * 3600)
    got = [tuple(r) for r in runs.stepwise([log(spark, rows)], "ts", state).collect()]
    want = [(1, "a", None, None, 2, at(240)), (1, "a", 2.0, 2.0, 1, at(481)), (2, None, 5.0, 4.0, 2, at(5)), (3, "a", None, None, 1, at(9))]  # four hours are no gap of over four
    assert sorted(got, key=lambda r: (r[0], r[5])) == want
    assert "Pandas" not in state(log(spark, rows))._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("cuts", [[300], [7, 130, 300]])
def test_reports_over_an_appended_log(spark, cuts):
    rows = made_log()
    parts = [log(spark, rows[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)]
    got = runs.stepwise(parts, "ts", lambda e: runs.trailing_reports(e.where("kind is not null"), "kind", "value", "ts", "id", 10, 25)).collect()
    want = []
    for k in "ab":
        v = [x[2] for x in rows if x[1] == k]
        want += [(k, n, round(fmean(v[max(n - 25, 0) : n]), 9)) for n in range(10, len(v) + 1, 10)]
    assert sorted((x["kind"], x["step"], round(x["mean"], 9)) for x in got) == want


def test_windows_close_once(spark, tmp_path):
    rows = made_log()
    log(spark, rows).write.parquet(str(tmp_path / "log.parquet"))
    made = runs.closed(spark, str(tmp_path), "log", "ts", lambda e: runs.windowed(e, "ts", "6 hours", None, ["kind"], [F.count("*").alias("n")]))
    got = {(str(x["start"]), x["kind"]): x["n"] for x in made.collect()}
    want = defaultdict(int)
    for _, kind, _, ts, _ in rows:
        want[str(ts.replace(hour=ts.hour // 6 * 6, minute=0)), kind] += 1
    assert made.count() == len(got) and got == dict(want)
