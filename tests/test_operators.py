"""Operators on small fixtures with values known by formula or by brute force."""

import io
import json
import math
import random
import struct
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstat.functions import scalars as S
from loomstat.operators import agg, inference, manifest, raster, selection, similarity
from loomstat.sources import readers, sinks
from loomstat.streaming import runs


def one(spark, column):
    return spark.range(1).select(column).collect()[0][0]


# published test pairs of the CIEDE2000 formula: two Lab colours and their difference
PAIRS = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, -1.3802, -84.2814), (50.0, 0.0, -82.7485), 1.0),
    ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669),
    ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((2.0776, 0.0795, -1.135), (0.9033, -0.0636, -0.5514), 0.9082),
]


def test_ciede2000(spark):
    df = spark.createDataFrame([(i, *a, *b) for i, (a, b, _) in enumerate(PAIRS)], "i int, l1 double, a1 double, b1 double, l2 double, a2 double, b2 double")
    got = S.with_ciede2000(df, tuple(F.col(f"{c}1") for c in "lab"), tuple(F.col(f"{c}2") for c in "lab"), "de").orderBy("i").collect()
    assert [round(r["de"], 4) for r in got] == [x for _, _, x in PAIRS]
    assert got[0].asDict().keys() == {"i", "l1", "a1", "b1", "l2", "a2", "b2", "de"}


def test_colour_conversions(spark):
    r, g, b = S.hex_rgb(F.lit("#0a80ff"))
    assert one(spark, F.struct(r, g, b)) == (10, 128, 255)
    assert one(spark, S.rgb_hex(F.lit(10), F.lit(128), F.lit(255))) == "#0a80ff"
    white = one(spark, F.array(*S.rgb_lab(F.lit(1.0), F.lit(1.0), F.lit(1.0))))
    assert white == pytest.approx([100, 0, 0], abs=0.01)
    red = one(spark, F.array(*S.rgb_lab(F.lit(1.0), F.lit(0.0), F.lit(0.0))))
    assert red == pytest.approx([53.24, 80.09, 67.20], abs=0.02)
    assert one(spark, F.array(*S.rgb_hsv(F.lit(0.0), F.lit(1.0), F.lit(1.0)))) == [0.5, 1.0, 1.0]


def test_text_helpers(spark):
    assert one(spark, S.number_text(F.lit(0.125), 2)) == "0.12" and one(spark, S.number_text(F.lit(None).cast("double"), 2)) == "--"
    assert one(spark, S.number_text(F.lit(1.5), 1, signed=True)) == "+1.5"
    assert one(spark, S.p_text(F.lit(0.0004))) == "$<$0.001" and one(spark, S.stars(F.lit(0.02))) == "*"
    assert one(spark, S.spaced_lower(F.lit("RedPaperCut"))) == "red paper cut"
    for path, ok in [("a/b", True), ("a/../b", True), ("../b", False), ("a/../../b", False), ("/etc", False), ("C:\\x", False), ("", False)]:
        assert one(spark, S.under_root(F.lit(path))) is ok, path


def test_two_stage_mean_and_blank_rule(spark):
    df = spark.createDataFrame([("m", "u", 1.0), ("m", "u", 3.0), ("m", "v", 10.0), ("m", "w", None), (None, "u", 9.0)], "m string, u string, x double")
    assert tuple(agg.two_stage_mean(df, "m", "u", ["x"]).collect()[0]) == ("m", 3, 6.0)
    assert [r["x"] for r in agg.null_out(df, F.col("x") > 2, ["x"]).where("u = 'u'").orderBy("x").collect()] == [None, None, 1.0]
    assert df.agg(agg.covered(F.col("x"), 0.9)).collect()[0][0] is None


@pytest.mark.parametrize(("groups", "counted"), [(10_000, 200_000), (10_000, 40), (0, 0)])
def test_quantiles_brute(spark, monkeypatch, groups, counted):
    """All groups counted, those with few values only, and none."""
    monkeypatch.setattr(agg, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(agg, "COUNTED", counted)
    draw = np.random.default_rng(5)
    held = {"one": [3.0], "tied": [2.0] * 50, "hot": list(np.round(draw.exponential(100.0, 3000), 1)), "two": [1.0, -4.0], "none": [None]}
    rows = [(g, None if v is None else float(v)) for g, vs in held.items() for v in vs] + [(None, 1.0), ("hot", None)]
    at = {"lo": 0.0, "a": 0.25, "b": 0.5, "c": 0.975, "hi": 1.0}
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in agg.quantiles(df, ["g"], "v", at, runs.written).collect()}
    assert set(got) == {"one", "tied", "hot", "two"}
    for g, r in got.items():
        assert [r[n] for n in at] == pytest.approx([np.quantile(held[g], q) for q in at.values()])
    assert agg.quantiles(df.where("false"), ["g"], "v", at, runs.written).count() == 0


def test_wilcoxon_by_enumeration():
    d = [3.1, -1.2, 0.4, 2.2, -0.9, 5.0, 1.7]
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = sum(r for r, x in zip(ranks, d) if x > 0)
    total = len(d) * (len(d) + 1) // 2
    low = min(w, total - w)
    ways = sum(sum(r for r, s in zip(ranks, signs) if s) <= low for signs in product((0, 1), repeat=len(d)))
    assert inference.wilcoxon_p(w, total - w, len(d), 0, 0) == pytest.approx(min(1, 2 * ways / 2 ** len(d)))
    assert inference.wilcoxon_p(21, 0, 6, 0, 0) == pytest.approx(2 / 2**6)
    assert inference.wilcoxon_p(0, 0, 0, 0, 3) == 1.0
    assert inference.wilcoxon_p(1275, 0, 50, 6, 0) < 1e-9


def test_signed_rank_ties_and_zeros(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, -1.0, 2.0, 0.0, 3.0)], "d double")
    r = inference.signed_rank(df, []).collect()[0]
    assert (r["n"], r["w_plus"], r["w_minus"], r["zeros"], r["ties"]) == (4, 8.5, 1.5, 1, 6.0)
    assert r["r_rb"] == pytest.approx(0.7)


def test_holm(spark):
    ps = [("a", 1, 0.01), ("a", 2, 0.04), ("a", 3, 0.03), ("b", 4, 0.2), ("b", 5, 0.2), ("b", 6, None)]
    got = {r["i"]: r["p_holm"] for r in inference.holm(spark.createDataFrame(ps, "f string, i int, p double"), "p", ["f"], ["i"]).collect()}
    assert got == {1: pytest.approx(0.03), 2: pytest.approx(0.06), 3: pytest.approx(0.06), 4: pytest.approx(0.4), 5: pytest.approx(0.4), 6: None}


def test_icc_of_the_shrout_fleiss_ratings(spark):
    x = [[9, 2, 5, 8], [6, 1, 3, 2], [8, 4, 6, 8], [7, 1, 2, 6], [10, 5, 6, 9], [6, 2, 4, 7]]
    rows = [(1, u, r, float(v)) for u, line in enumerate(x) for r, v in enumerate(line)] + [(1, 99, 0, 5.0)]
    got = inference.icc2(spark.createDataFrame(rows, "g int, u int, r int, x double"), ["g"], "u", "r", "x").collect()[0]
    assert (got["n_units"], round(got["icc_1"], 2), round(got["icc_k"], 2)) == (6, 0.29, 0.62)


def test_js_distance_and_entropy(spark):
    d = lambda p, q: one(spark, similarity.js_distance(F.array(*map(F.lit, p)), F.array(*map(F.lit, q))))
    assert d([1.0, 0.0], [0.0, 1.0]) == pytest.approx(1.0) and d([0.5, 0.5], [0.5, 0.5]) == 0.0
    assert d([0.2, 0.8], [0.7, 0.3]) == pytest.approx(d([0.7, 0.3], [0.2, 0.8]))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(30)] + [(i, i + 1) for i in range(100, 120)]
    label = {v: v for e in edges for v in e}
    for _ in range(50):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(r.sample(edges, len(edges)), "a long, b long")
    got = {x["id"]: x["comp"] for x in similarity.components(df, runs.written).collect()}
    assert got == {v: c for v, c in label.items() if any(a != b and v in (a, b) for a, b in edges)}


def test_block_search_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    v = np.random.default_rng(0).normal(size=(70, 5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    sim = v @ v.T
    pairs = {(r["a"], r["b"]) for r in similarity.near_pairs(df, 3.0).collect()}
    assert pairs == {(i, j) for i in range(70) for j in range(i + 1, 70) if sim[i, j] > 3.0}
    np.fill_diagonal(sim, -np.inf)
    got = similarity.nearest(df.where("id % 20 = 0"), df, 3).collect()
    assert {(r["query"], r["rank"]): r["id"] for r in got} == {(i, k + 1): int(j) for i in range(0, 70, 20) for k, j in enumerate(np.argsort(-sim[i])[:3])}


@pytest.mark.parametrize(("block", "side", "values"), [(8192, 4, 1 << 21), (7, 4, 1 << 21), (7, 2, 60), (7, 1, 1)])
def test_nearest_of_all_rows_with_equal_ones(spark, monkeypatch, block, side, values):
    """Equal rows tie wherever they lie, and the least id comes first; more rows wanted than there are is no fault."""
    for name, x in (("BLOCK", block), ("SIDE", side), ("VALUES", values)):
        monkeypatch.setattr(similarity, name, x)
    draw = np.random.default_rng(4)
    v = draw.normal(size=(12, 6))[draw.integers(0, 12, 60)]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)
    sim = np.round([[sum(p * q for p, q in zip(x, y, strict=True)) for y in v.tolist()] for x in v.tolist()], 12)
    for k in (4, 100):
        want = {(i, r + 1): j for i in range(60) for r, j in enumerate(sorted((j for j in range(60) if j != i), key=lambda j: (-sim[i, j], j))[:k])}
        got = similarity.nearest(df, df, k).collect()
        assert {(r["query"], r["rank"]): r["id"] for r in got} == want and len(got) == len(want)


def test_best_without_numbers():
    x = np.array([[1.0, 0.0], [np.nan, 0.0]])
    y = np.array([[0.5, 0.5], [np.nan, 1.0], [0.6, 0.1], [0.5, 0.2]])
    i, j, sim = similarity.best(x, y, x @ y.T, 2)
    assert i.tolist() == [0, 0] and j.tolist() == [2, 0] and sim.tolist() == [0.6, 0.5]


@pytest.mark.parametrize("least", [-1.0, 0.5, 0.9])
def test_near_links_connect_as_pairs_do(spark, monkeypatch, least):
    monkeypatch.setattr(similarity, "BLOCK", 60)
    monkeypatch.setattr(similarity, "VALUES", 480)
    draw = np.random.default_rng(8)
    v = draw.normal(size=(200, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i * 3, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    pairs, links = ([(r["a"], r["b"]) for r in f(df, least).collect()] for f in (lambda *x: similarity.near_pairs(*x).select("a", "b"), similarity.near_links))

    def groups(edges):
        top = {3 * i: 3 * i for i in range(200)}
        for _ in range(200):
            before = dict(top)
            for a, b in edges:
                top[a] = top[b] = min(top[a], top[b])
            if before == top:
                return top

    assert groups(links) == groups(pairs)
    blocks = 4
    assert len(links) <= blocks * (blocks + 1) / 2 * 120 and (least > 0 or len(links) < len(pairs) / 5)


@pytest.mark.parametrize(("block", "pivots"), [(1024, 1024), (16, 40), (7, 1)])
@pytest.mark.parametrize("least", [0.95, 0.4, -0.2])
def test_near_pairs_brute(spark, monkeypatch, block, pivots, least):
    """Groups, copies, a zero vector, vectors of other lengths, and none at all."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(similarity, "PIVOTS", pivots)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 8))
    m = np.concatenate([np.repeat(centres, 10, axis=0) + 0.1 * r.normal(size=(300, 8)), np.repeat(centres[:1], 40, axis=0)])
    m = np.concatenate([m / np.linalg.norm(m, axis=1, keepdims=True), np.zeros((1, 8)), 1.5 * centres[:2]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, v array<double>")
    got = {(x["a"], x["b"]): x["sim"] for x in similarity.near_pairs(df, least).collect()}
    sim = m @ m.T
    want = {(i, j) for i in range(len(m)) for j in range(i + 1, len(m)) if sim[i, j] > least}
    assert set(got) == want and all(abs(s - sim[k]) < 1e-9 for k, s in got.items())
    assert similarity.near_pairs(df.limit(0), least).count() == 0


def test_far_pivots_are_not_compared():
    p = np.eye(4)
    live = similarity.live_pairs(p, np.full(4, 0.2), np.ones(4), 0.95)
    assert (live == np.eye(4, dtype=bool)).all()
    assert similarity.live_pairs(p, np.full(4, 0.8), np.ones(4), 0.95).all()


def test_flood_merge_and_tree():
    m = np.zeros((8, 8), int)
    m[2:6, 2:6] = 1
    m[3:5, 3:5] = 2
    m[0, 7] = 3
    p = raster.flood(m)
    assert p.max() == 3 and (p == p[0, 0]).sum() == 47
    assert raster.merge_small(m, 2)[0, 7] == 0 and (raster.merge_small(m, 2) == np.where(m == 3, 0, m)).all()
    t = raster.containment(m)
    depth = dict(zip(t["label"].tolist(), t["depth"].tolist()))
    assert depth == {3: 1, 1: 1, 2: 2}  # label 0 is the board
    assert t["parent"][t["label"] == 2] == t["region"][t["label"] == 1]


def test_selection(spark):
    df = spark.createDataFrame([("g", i, float(i), float(-i)) for i in range(11)], "g string, i int, x double, y double")
    assert [r["i"] for r in selection.quantile_picks(df, ["g"], ["x"], 6).orderBy("i").collect()] == [0, 2, 4, 6, 8, 10]
    best = selection.constrained_best(df, ["g"], F.col("x") > 20, "x", "y", "i").collect()[0]
    assert (best["i"], best["eligible"]) == (0, False)
    above = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 3, 0.1), (2, 4, 0.2)], "q int, i int, s double")
    assert sorted(r["i"] for r in selection.above_or_best(above, "q", "i", "s", 0.5).collect()) == [1, 2, 4]


def test_manifest_round_trip_and_corruption(spark):
    files = spark.createDataFrame([("a/x", bytes(range(256)) * 9), ("b", b""), ("../up", b"no")], "path string, content binary")
    parts = manifest.split(files, 1000)
    got = {r["path"]: (r["status"], r["content"]) for r in manifest.restore(parts, files.where("path = 'b'").withColumn("content", F.lit(b"other"))).collect()}
    assert got["a/x"] == ("ok", bytes(range(256)) * 9) and got["b"][0] == "refused" and got["../up"] == ("refused", None)
    bad = parts.withColumn("data", F.when(F.col("part") == 1, F.lit(b"?")).otherwise(F.col("data")))
    assert {r["path"]: r["status"] for r in manifest.restore(bad).collect()}["a/x"] == "corrupt"
    status = {r["path"]: r["status"] for r in manifest.verify(manifest.build(files), manifest.build(files.where("path <> 'b'"))).collect()}
    assert status == {"a/x": "ok", "b": "missing", "../up": "unsafe"}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿seed,content,style\n3,a,\n4,b,2\n", encoding="utf-8")
    rows = readers.csv(spark, str(tmp_path / "m.csv"), "content string, style int, seed int, extra double").orderBy("seed").collect()
    assert [tuple(r) for r in rows] == [("a", None, 3, None), ("b", 2, 4, None)]
    assert readers.optional(spark, str(tmp_path / "none.csv"), "a int").count() == 0
    docs = tmp_path / "docs"
    docs.mkdir()
    for i in range(2):
        (docs / f"r{i}.json").write_text(json.dumps({"version": "1", "rater": {"id": str(i)}, "ratings": [{"code": "S1", "style": i}]}, indent=1))
    got = readers.json_folder(spark, str(docs), readers.SURVEY).select("file_name", F.explode("ratings").alias("r")).select("file_name", "r.style").orderBy("file_name").collect()
    assert [tuple(r) for r in got] == [("r0.json", 0), ("r1.json", 1)]
    pics = tmp_path / "pics" / "in"
    pics.mkdir(parents=True)
    (pics / "ind_人物-16_s_seed7.png").write_bytes(b"x")
    (pics / ".DS_Store").write_bytes(b"y")
    (pics / "._a.png").write_bytes(b"y")
    found = readers.keyed_files(spark, f"file:{tmp_path}/pics").collect()
    assert [(r["content"], r["style"], r["seed"]) for r in found] == [("ind_人物-16", None, 7)]
    raw = io.BytesIO()
    np.save(raw, np.array([[0, 1], [2, 3]], np.uint8))
    maps = readers.label_maps(spark.createDataFrame([("p", raw.getvalue())], "path string, content binary"))
    assert [tuple(r)[1:] for r in maps.orderBy("y", "x").collect()] == [(0, 0, 0), (0, 1, 1), (1, 0, 2), (1, 1, 3)]
    head = json.dumps({"__metadata__": {}, "m.0.lora_A.w": {"shape": [4, 32]}, "m.1.lora_B.w": {"shape": [32, 4]}}).encode()
    files = spark.createDataFrame([(struct.pack("<Q", len(head)) + head,), (b"bad",)], "content binary")
    assert [r["h"]["tensors"] for r in files.select(readers.tensor_header("content").alias("h")).collect()] == [2, None]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "method string, x int")
    sinks.partitions(df, str(tmp_path / "t"), "method")
    sinks.partitions(spark.createDataFrame([("b", 5)], "method string, x int"), str(tmp_path / "t"), "method")
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert sorted((r["method"], r["x"]) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [("a", 1), ("b", 5)]
    sinks.append_json(df, str(tmp_path / "j"))
    sinks.append_json(df, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "method string, x int").count() == 4
    sinks.lines(df, selection.markdown_row([F.col("method"), F.col("x").cast("string")]), ["x"], str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).collect()[0][0] == "| a | 1 |"
    made = [0]

    def make():
        made[0] += 1
        return df

    for _ in range(2):
        readers.stage(spark, str(tmp_path / "stage"), make)
    assert made == [1]


def test_unit_vectors_and_left_out_centroid(spark):
    df = spark.createDataFrame([(1, 0, [3.0, 4.0]), (2, 1, [0.0, 2.0]), (3, 1, [2.0, 0.0])], "id long, g int, v array<double>")
    assert one(spark, S.norm(S.unit(F.array(F.lit(3.0), F.lit(4.0))))) == pytest.approx(1.0)
    got = {r["id"]: r["score"] for r in similarity.left_out_score(df, "g", 2).collect()}
    assert got[1] == pytest.approx((3 * 2 + 4 * 2) / math.sqrt(8)) and got[2] == pytest.approx(2 * 4 / 5)


def vector_rows(spark, n, d=6):
    x = np.random.default_rng(1).normal(size=(n, d))
    return x, spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(n)], "id long, label int, v array<double>")


def test_gram_cosine_is_over_all_places(spark):
    x, rows = vector_rows(spark, 40, 64)
    g, h = (x[k::2].T @ x[k::2] for k in (0, 1))
    got = similarity.gram_cosine(rows, "label", 64).collect()
    assert [r["gram_cosine"] for r in got] == pytest.approx([(g * h).sum() / np.sqrt((g * g).sum() * (h * h).sum())])


def test_kernel_distance_draws_fifty_subsamples(spark):
    x, rows = vector_rows(spark, 31)
    got = similarity.kernel_distance(rows.where("id < 28"), "label", 0, 1, 6).collect()
    a, b = x[:28:2], x[1:28:2]  # 14 of each: all are drawn
    k = lambda p, q: (p @ q.T / 6 + 1) ** 3
    off = lambda p: (k(p, p).sum() - np.trace(k(p, p))) / (len(p) * (len(p) - 1))
    assert len(got) == 50 and [r["d"] for r in got] == pytest.approx([off(a) + off(b) - 2 * k(a, b).mean()] * 50)
    few = rows.where("label = 0 or id < 10")
    assert len({round(r["d"], 9) for r in similarity.kernel_distance(few, "label", 0, 1, 6).collect()}) > 25  # 5 of 16 drawn


def test_compare_takes_ten_thousand_resamples(spark):
    d = np.random.default_rng(3).normal(size=400)
    rows = spark.createDataFrame([(m, i, float(d[i]) if m == "A" else 0.0) for i in range(400) for m in "AN"], "method string, unit int, x double")
    got = inference.compare(rows, "method", "unit", {"x": True}, [("A", "N")]).collect()[0]
    whole = d[np.random.default_rng(0).integers(0, 400, (10_000, 400))].mean(axis=1)
    assert (got["ci_lo"], got["ci_hi"]) == pytest.approx(tuple(np.percentile(whole, [2.5, 97.5])))
    assert got["n"] == 400


def test_region_borders_are_those_of_outlines_without_pixel_rows(spark):
    from loomstat.operators import raster

    draw = np.random.default_rng(3)
    maps = [draw.integers(0, 3, (7, 9)), np.zeros((7, 9), int), np.ones((4, 4), int)]
    px = spark.createDataFrame([(i, y, x, int(m[y, x])) for i, m in enumerate(maps) for y in range(m.shape[0]) for x in range(m.shape[1])], "img int, y int, x int, label int")
    made = raster.region_borders(px, 0)
    regions = raster.by_picture(px, lambda m: {"region": raster.regions(m, 0)}, "region long")
    want = raster.outlines(regions.where("region > 0"), "region").select("img", "region", "area", "sides")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect()))
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()


def test_region_sides_has_no_row_for_each_pixel_and_region(spark):
    from loomstat.plans import extended

    plan = extended.region_sides(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Generate") == 1  # suppliers become pixels, which are not multiplied again
