"""Queries over the driver's tables, each with the SQL that checks it: stage columns, keys, gates, audits, series, orders, sinks and sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agg, inference, raster, selection, similarity
from ..sources import readers, sinks
from ..streaming import runs
from .core import CMP, PS, compared, differences, hash_sql, measures, p_values, pairs, r, rounded
from .extended import COMP, PIECE, SIM, V, G, grid, grouped, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark, d, name):
    return readers.table(spark, d, name)


# ---- columns and keys
@query("SELECT p_partkey, p_name, p_brand, p_size, p_retailprice, n AS lay_n, round(q, 6) AS lay_qty FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, avg(l_quantity) AS q FROM lineitem GROUP BY 1) ON l_partkey = p_partkey")
def stage_columns(spark, d):
    """A later stage's columns, prefixed, in place of a column that the table had."""
    stage = t(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"), r(F.avg("l_quantity")).alias("qty"))
    part = t(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice", F.lit("old").alias("lay_n"))
    return agg.with_stage(part, agg.prefixed(stage, "lay_", ["p_partkey"]), "p_partkey")


@query("SELECT p_brand, median(p_partkey) AS p_partkey, median(p_size) AS p_size, round(median(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_brand")
def medians_by_brand(spark, d):
    return rounded(agg.medians(t(spark, d, "part"), "p_brand"), "p_retailprice")


@query("WITH s AS (SELECT event_id, event_type, user_id, CASE WHEN user_id % 3 = 0 AND event_id % 4 = 0 THEN event_id % 5 END AS style, event_id % 7 AS seed FROM events) SELECT event_id, CASE WHEN max((style IS NOT NULL)::INT) OVER (PARTITION BY user_id) = 1 THEN style::VARCHAR ELSE seed::VARCHAR END AS pair FROM s")
def pair_keys(spark, d):
    e = F.col("event_id")
    rows = t(spark, d, "events").select("event_id", "user_id", F.when((F.col("user_id") % 3 == 0) & (e % 4 == 0), e % 5).alias("style"), (e % 7).alias("seed"))
    return agg.pair_key(rows, ["user_id"], "style", "seed").select("event_id", "pair")


@query("SELECT p_partkey, 'a part called ' || p_name || ' of size ' || p_size || '.' AS prompt FROM part")
def text_template(spark, d):
    return t(spark, d, "part").select("p_partkey", S.template("a part called {name} of size {size}.", name=F.col("p_name"), size=F.col("p_size")).alias("prompt"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE p_brand IN ('Brand#1', 'Brand#3', 'Brand#11') GROUP BY p_brand")
def only_named(spark, d):
    return agg.only(t(spark, d, "part"), "p_brand", "Brand#1+Brand#3+Brand#11").groupBy("p_brand").agg(F.count("*").alias("n"))


@query(f"WITH {PS} SELECT id, CASE WHEN p < 0.001 THEN '$<$0.001' ELSE printf('%.3f', round_even(p, 3)) END AS p_text, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM ps")
def p_strings(spark, d):
    return p_values(spark, d).select("id", S.p_text(F.col("p")).alias("p_text"), S.stars(F.col("p")).alias("stars"))


RGB = "c AS (SELECT p_partkey, (p_partkey * 7 % 256) / 255e0 AS r, (p_partkey * 13 % 256) / 255e0 AS g, (p_partkey * 29 % 256) / 255e0 AS b, '#' || lpad(lower(hex((p_partkey * 7 % 256)::INT)), 2, '0') || lpad(lower(hex((p_partkey * 13 % 256)::INT)), 2, '0') || lpad(lower(hex((p_partkey * 29 % 256)::INT)), 2, '0') AS code FROM part)"


def coloured(spark, d):
    k = F.col("p_partkey")
    rows = t(spark, d, "part").select("p_partkey", *[(k * m % 256).cast("int").alias(c) for m, c in ((7, "r"), (13, "g"), (29, "b"))])
    rows = rows.withColumn("code", S.rgb_hex(F.col("r"), F.col("g"), F.col("b")))
    back = S.hex_rgb(F.col("code"))
    return rows.select("p_partkey", "code", *[(x / 255.0).alias(c) for x, c in zip(back, "rgb", strict=True)])


@query(f"""WITH {RGB}, m AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS s FROM c), h AS (SELECT *, CASE WHEN s = 0 THEN 0 WHEN r = v THEN (g - b) / s WHEN g = v THEN 2 + (b - r) / s ELSE 4 + (r - g) / s END / 6 AS k FROM m), z AS (SELECT *, k - floor(k) AS hue, CASE WHEN v = 0 THEN 0 ELSE s / v END AS sat FROM h)
SELECT p_partkey, code, round(hue, 6) AS hue, round(sat, 6) AS saturation, round(v, 6) AS value, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY sat < 0.15, round(hue, 9), round(v, 9), p_partkey) - 1 AS place FROM z""")
def palette_order(spark, d):
    """Colours in the order of a palette: greys first by what is not grey, then by hue and value."""
    rows = coloured(spark, d)
    h, s, v = S.rgb_hsv(F.col("r"), F.col("g"), F.col("b"))
    rows = rows.select("p_partkey", "code", h.alias("hue"), s.alias("saturation"), v.alias("value"))
    w = Window.partitionBy(F.col("p_partkey") % 50).orderBy(F.col("saturation") < 0.15, F.round("hue", 9), F.round("value", 9), "p_partkey")
    return rounded(rows.withColumn("place", (F.row_number().over(w) - 1).cast("long")), "hue", "saturation", "value")


XYZ = f"{RGB}, n AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END AS {c}" for c in "rgb") + " FROM c), x AS (SELECT p_partkey, " + ", ".join(f"({' + '.join(f'{k} * {c}' for k, c in zip(row, 'rgb', strict=True))}) / {w} AS {n}" for row, w, n in zip(S.XYZ, S.WHITE, "xyz", strict=True)) + " FROM n), f AS (SELECT p_partkey, " + ", ".join(f"CASE WHEN {c} > 0.008856 THEN cbrt({c}) ELSE 7.787 * {c} + 16 / 116e0 END AS {c}" for c in "xyz") + " FROM x)"


@query(f"WITH {XYZ} SELECT p_partkey, round(116 * y - 16, 6) AS l, round(500 * (x - y), 6) AS a, round(200 * (y - z), 6) AS b, round(sqrt((500 * (x - y)) ** 2 + (200 * (y - z)) ** 2), 6) AS chroma, NOT (116 * y - 16 > 90 AND sqrt((500 * (x - y)) ** 2 + (200 * (y - z)) ** 2) < 10) AS fg FROM f")
def lab_colours(spark, d):
    l, a, b = S.rgb_lab(F.col("r"), F.col("g"), F.col("b"))  # noqa: E741
    rows = coloured(spark, d).select("p_partkey", l.alias("l"), a.alias("a"), b.alias("b"))
    rows = rows.withColumns({"chroma": F.hypot("a", "b"), "fg": raster.foreground(F.col("l"), F.col("a"), F.col("b"))})
    return rounded(rows, "l", "a", "b", "chroma")


# ---- aggregates and inference
@query("WITH p AS (SELECT p_partkey, 'm.' || replace(lower(p_type), ' ', '.') || '.' || (p_partkey % 3) AS path FROM part) SELECT array_to_string(string_split(path, '.')[1:2], '.') AS block, count(*) AS n FROM p GROUP BY 1")
def dotted_counts(spark, d):
    path = F.concat(F.lit("m."), F.replace(F.lower("p_type"), F.lit(" "), F.lit(".")), F.lit("."), (F.col("p_partkey") % 3).cast("string"))
    return t(spark, d, "part").groupBy(S.before_dot(path, 2).alias("block")).agg(F.count("*").alias("n"))


@query(f"WITH {COMP} SELECT comp, string_agg(id::VARCHAR, ',' ORDER BY id) AS members FROM h WHERE size > 1 GROUP BY comp")
def group_members(spark, d):
    g = grouped(spark, d).where("size > 1").groupBy("comp").agg(F.array_sort(F.collect_list("id")).alias("m"))
    return g.select("comp", F.array_join("m", ",").alias("members"))


@query(f"WITH {PIECE}, c AS (SELECT img, y, x, (h % 101)::DOUBLE AS l FROM l), m AS (SELECT k.img, piece, avg(l) AS m FROM k JOIN c USING (img, y, x) GROUP BY ALL), z AS (SELECT k.img, piece, l - m AS off FROM k JOIN c USING (img, y, x) JOIN m USING (img, piece)) SELECT img, round(avg(abs(off)), 6) AS interior FROM z GROUP BY img")
def regional_means(spark, d):
    """How far pixels are from the mean of their piece."""
    px = raster.pieces(grid(spark, d).withColumn("l", (F.col("h") % 101).cast("double")), "l")
    off = F.abs(F.col("l") - F.avg("l").over(Window.partitionBy("img", "piece")))
    return px.select("img", off.alias("off")).groupBy("img").agg(r(F.avg("off")).alias("interior"))


@query()
def bootstrap_mean(spark, d):
    return inference.bootstrap_mean(agg.unit_means(measures(spark, d), ["method", "unit"], ["qty"]), ["method"], "qty", "unit")


@query()
def bootstrap_shared(spark, d):
    rows = None
    for m in ("qty", "price"):
        p = pairs(spark, d, m).withColumn("metric", F.lit(m))
        rows = p if rows is None else rows.unionByName(p)
    return inference.bootstrap_shared(rows, ["metric"], "unit")


@query(f"WITH {CMP}, g AS (SELECT a, b, metric, avg(d) AS diff FROM q GROUP BY ALL) SELECT a, b, metric, round(diff, 6) AS diff, abs(diff) < CASE metric WHEN 'price' THEN 50 WHEN 'qty' THEN 0.05 ELSE 0.0005 END AS negligible FROM g")
def negligible_gate(spark, d):
    made = differences(spark, d)
    return made.select("a", "b", "metric", r("diff").alias("diff"), inference.negligible(F.col("diff"), F.col("metric"), {"price": 50.0, "qty": 0.05}, 0.0005).alias("negligible"))


@query()
def comparison_record(spark, d):
    """A row for each comparison, with _before, _after, _diff, _lo, _hi, _p and _improved of each measure."""
    names = {"before": "mean_b", "after": "mean_a", "diff": "diff", "lo": "ci_lo", "hi": "ci_hi", "p": "p_holm"}
    wide = compared(spark, d).withColumn("improved", F.col("better") == "a").groupBy("a", "b").pivot("metric", ["qty", "price", "disc", "tax"])
    return wide.agg(*[F.first(c).alias(n) for n, c in names.items()], F.first("improved").alias("improved"))


@query("WITH e AS (SELECT event_id, 'S' || lpad((event_id % 97)::VARCHAR, 3, '0') AS code, value FROM events), k AS (SELECT 'S' || lpad(i::VARCHAR, 3, '0') AS code, CASE i % 3 WHEN 0 THEN 'ours' WHEN 1 THEN 'other' ELSE 'third' END AS method, i % 10 AS drawing FROM range(90) t(i)) SELECT method, drawing, count(*) AS n, round(avg(value), 6) AS score FROM e JOIN k USING (code) GROUP BY ALL")
def unblinded(spark, d):
    """Ratings by code, joined with the key of codes; codes without a key (anchors) fall out."""
    i = F.col("id")
    code = lambda c: F.concat(F.lit("S"), F.lpad(c.cast("string"), 3, "0"))
    key = spark.range(90).select(code(i).alias("code"), F.when(i % 3 == 0, "ours").when(i % 3 == 1, "other").otherwise("third").alias("method"), (i % 10).alias("drawing"))
    rows = t(spark, d, "events").select(code(F.col("event_id") % 97).alias("code"), "value")
    return rows.join(F.broadcast(key), "code").groupBy("method", "drawing").agg(F.count("*").alias("n"), r(F.avg("value")).alias("score"))  # 90 rows


@query("WITH s(pos, setting, brand) AS (VALUES (0, 'first', 'Brand#2'), (1, 'absent', 'Brand#99'), (2, 'last', 'Brand#1')) SELECT pos, setting, round(avg(p_size), 6) AS size, CASE WHEN avg(p_retailprice) IS NULL THEN '--' ELSE printf('%.1f', round_even(avg(p_retailprice), 1)) END AS price FROM s LEFT JOIN part ON p_brand = brand GROUP BY pos, setting")
def dev_table(spark, d):
    found = t(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(r(F.avg("p_size")).alias("size"), S.number_text(F.avg("p_retailprice"), 1).alias("price"))
    names = spark.createDataFrame([("Brand#2", "first"), ("Brand#99", "absent"), ("Brand#1", "last")], "brand string, setting string")
    made = readers.expected(found, "brand", ["Brand#2", "Brand#99", "Brand#1"]).join(F.broadcast(names), "brand")
    return made.select("pos", "setting", "size", F.coalesce("price", F.lit("--")).alias("price"))


# ---- vectors and audits
BITS = V + ", s AS (SELECT id, v, list_sort(v) AS s FROM n), h AS (SELECT id, v, list_transform(v, lambda x: (x > (s[32] + s[33]) / 2)::INT) AS h FROM s), p AS (SELECT a.id AS a, b.id AS b, list_dot_product(a.v, b.v) AS sim, 64 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: (z[1] = z[2])::INT)) AS bits FROM h a JOIN h b ON a.id < b.id)"


@query(f"WITH {BITS} SELECT a, b, round(sim, 6) AS sim, bits::BIGINT AS bits FROM p WHERE sim > {SIM} OR bits <= 20")
def audit_pairs(spark, d):
    """Pairs that are near by vector or alike by hash."""
    v = vectors(spark, d).select("id", "v")
    return rounded(similarity.near_or_alike(v.withColumn("h", S.bits_over_median(F.col("v"))), SIM, 20), "sim")


@query(f"WITH {BITS} SELECT a, b, bits::BIGINT AS bits FROM p WHERE bits <= 20")
def hash_pairs(spark, d):
    v = vectors(spark, d).select("id", "v")
    return similarity.near_or_alike(v.withColumn("h", S.bits_over_median(F.col("v"))), 2.0, 20).select("a", "b", "bits")


FLIPPED = BITS[: BITS.index(", p AS (")] + ", u AS (SELECT id, h FROM h UNION ALL SELECT id + 1000000, list_transform(h, lambda x, i: CASE WHEN i > 64 - id % 12 THEN 1 - x ELSE x END) FROM h), p AS (SELECT a.id AS a, b.id AS b, 64 - list_sum(list_transform(list_zip(a.h, b.h), lambda z: (z[1] = z[2])::INT)) AS bits FROM u a JOIN u b ON a.id < b.id)"


@query(f"WITH {FLIPPED} SELECT a, b, bits::BIGINT AS bits FROM p WHERE bits <= 8")
def alike_hashes(spark, d):
    """Hashes, and copies of which up to eleven bits are flipped, that differ in eight bits at most."""
    own = vectors(spark, d).select("id", S.bits_over_median(F.col("v")).alias("h"))
    flipped = own.select((F.col("id") + 1000000).alias("id"), F.col("h").bitwiseXOR(F.expr("shiftleft(1L, cast(id % 12 as int)) - 1")).alias("h"))
    return similarity.alike_pairs(own.unionByName(flipped), 8)


GREY = f"g AS (SELECT s_suppkey::INT AS img, id // 32 AS y, id % 32 AS x FROM supplier, range(1024) t(id)), l AS (SELECT img, y, x, ({hash_sql('img', 'y', 'x')}) % 256 AS g FROM g)"


@query(f"""WITH {GREY}, w AS (SELECT k, n, cos(pi() * k * (2 * n + 1) / 64) * sqrt((CASE k WHEN 0 THEN 1 ELSE 2 END) / 32e0) AS w FROM range(8) i(k), range(32) j(n)), a AS (SELECT img, y, k, sum(g * w) AS s FROM l JOIN w ON n = x GROUP BY ALL),
b AS (SELECT img, w.k * 8 + a.k AS place, sum(s * w) AS s FROM a JOIN w ON n = y GROUP BY ALL), m AS (SELECT img, median(s) AS m FROM b GROUP BY img), h AS (SELECT img, sum(CASE WHEN s > m THEN 1::HUGEINT << (63 - place)::HUGEINT ELSE 0 END)::HUGEINT AS h FROM (SELECT img, place, s, m FROM b JOIN m USING (img)) GROUP BY img)
SELECT img, (CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT AS phash FROM h""")
def picture_hashes(spark, d):
    grey = grid(spark, d, 32).groupBy("img").agg(F.array_sort(F.collect_list(F.struct("y", "x", (F.col("h") % 256).cast("double").alias("g")))).alias("p"))
    return grey.select("img", similarity.phash(F.transform("p", lambda p: p["g"])).alias("phash"))


@query(f"WITH {V}, o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM n), f AS (SELECT * FROM o WHERE k <= 2) SELECT n.id, round(max(list_dot_product(n.v, f.v)) FILTER (f.label = n.label), 6) AS best_own, round(avg(list_dot_product(n.v, f.v)) FILTER (f.label <> n.label), 6) AS mean_other FROM n, f GROUP BY n.id")
def reference_scores(spark, d):
    """The best of the first two references of one's own label, and the mean over those of other labels."""
    v = vectors(spark, d)
    refs = v.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("k <= 2").select(F.col("id").alias("ref"), "label", "v")
    return rounded(similarity.ref_scores(v, refs, "label", refs.select("label", "ref")), "best_own", "mean_other")


AUDIT = V + ", q AS (SELECT a.id AS test, b.id, list_dot_product(a.v, b.v) AS sim FROM n a JOIN n b ON a.id % 20 = 0 AND b.id % 20 <> 0), m AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY round(sim, 12) DESC, id) AS k FROM q), w AS (SELECT *, row_number() OVER (PARTITION BY test ORDER BY round(sim, 12) DESC, id) AS k FROM q WHERE id % 3 > 0)"


@query(f"WITH {AUDIT}, t AS (SELECT test, string_agg(id::VARCHAR, ',' ORDER BY k) AS nearest, max(round(sim, 6)) AS nearest_sim FROM w WHERE k <= 3 GROUP BY test) SELECT m.test, id AS matched, round(sim, 6) AS sim, nearest, nearest_sim FROM m JOIN t USING (test) WHERE k = 1")
def split_audit(spark, d):
    """Each test's best match in the catalogue, and its three nearest among the training rows."""
    v = vectors(spark, d)
    tests, catalogue = v.where("id % 20 = 0"), v.where("id % 20 <> 0")
    match = similarity.nearest(tests, catalogue, 1).select(F.col("query").alias("test"), F.col("id").alias("matched"), r("sim").alias("sim"))
    train = similarity.nearest(tests, catalogue.where("id % 3 > 0"), 3).groupBy(F.col("query").alias("test"))
    train = train.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("nearest"), r(F.max("sim")).alias("nearest_sim"))
    return match.join(train, "test")


@query(f"WITH {V}, s AS (SELECT a.id AS query, b.id AS id, list_dot_product(a.v, b.v) AS sim FROM n a JOIN n b ON a.id <> b.id WHERE a.id % 20 = 0), k AS (SELECT *, max(sim) OVER (PARTITION BY query) AS m, row_number() OVER (PARTITION BY query ORDER BY round(sim, 12) DESC, id) AS rank FROM s) SELECT id FROM n WHERE id NOT IN (SELECT id FROM k WHERE sim > 0.3 OR (m <= 0.3 AND rank = 1))")
def held_out(spark, d):
    """What is left for training when all that is near a test, or the nearest to it, is taken out."""
    v = vectors(spark, d)
    found = similarity.above_or_nearest(v.where("id % 20 = 0"), v, 0.3)
    return v.select("id").join(selection.above_or_best(found, "query", "id", "sim", 0.3).select("id").distinct(), "id", "left_anti")


@query()
def palette_sweep(spark, d):
    """How far held-out vectors are from the nearest of K centres fitted on the others, for four K."""
    v = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    train, rest = v.where("vec_id % 5 < 4"), v.where("vec_id % 5 = 4")
    rows = None
    for k in (8, 12, 16, 24):
        c = similarity.kmeans_centres(train, "v", k).agg(F.collect_list("centre").alias("c"), F.min("weight").alias("w"))
        far = F.array_min(F.transform("c", lambda x: S.distance(F.col("v"), x)))
        one = rest.crossJoin(F.broadcast(c)).agg(F.lit(k).alias("k"), r(F.avg(far)).alias("distance"), r(F.max("w")).alias("smallest_weight"))  # one row of k centres
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query("SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS json FROM events GROUP BY event_type")
def summary_documents(spark, d):
    """A JSON document for each kind of event."""
    return sinks.document(t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")))


@query("SELECT c AS \"column\", n, n > 0 AS present FROM (SELECT count(p_partkey) AS p_partkey, count(p_size) AS p_size, 0::BIGINT AS never FROM part) UNPIVOT (n FOR c IN (p_partkey, p_size, never))")
def column_presence(spark, d):
    """Which columns of a table hold a value at all; what rests on the others is left out of a report."""
    return agg.presence(t(spark, d, "part").select("p_partkey", "p_size", F.lit(None).cast("double").alias("never")))


@query(f"WITH {PIECE}, t AS (SELECT img, piece, max(label) AS label, count(*) AS area, round(avg(x) * 0.5, 6) AS cx_mm, round(avg(y) * 0.5, 6) AS cy_mm FROM k GROUP BY img, piece) SELECT img, row_number() OVER (PARTITION BY img ORDER BY label, cy_mm, cx_mm, piece) AS number, label, area * 0.25 AS area_mm2, cx_mm, cy_mm FROM t")
def pieces_file(spark, d):
    """The cutting list of each picture, written as a file and read by its header."""
    p = raster.pieces(grid(spark, d).drop("h")).groupBy("img", "piece").agg(F.max("label").alias("label"), (F.count("*") * 0.25).alias("area_mm2"), r(F.avg("x") * 0.5).alias("cx_mm"), r(F.avg("y") * 0.5).alias("cy_mm"))
    p = p.withColumn("number", F.row_number().over(Window.partitionBy("img").orderBy("label", "cy_mm", "cx_mm", "piece")))
    path = runs.scratch(spark)
    sinks.csv(p.select("img", "number", "label", "area_mm2", "cx_mm", "cy_mm"), path)
    return readers.csv(spark, path, "img int, number int, label int, area_mm2 double, cx_mm double, cy_mm double")


# ---- series, sets, orders
STEPS = "e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, count(*) OVER (PARTITION BY user_id) AS n, value FROM events)"


def steps(spark, d):
    w = Window.partitionBy("user_id")
    return t(spark, d, "events").select("user_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).alias("step"), F.count("*").over(w).alias("n"), "value")


@query(f"WITH {STEPS} SELECT step, count(*) AS n, round(avg(value), 6) AS mean FROM e WHERE step / n >= 0.15 AND step / n < 0.75 GROUP BY step")
def phase_window(spark, d):
    return selection.phase(steps(spark, d), "step", "n", 0.15, 0.75).groupBy(F.col("step").cast("long").alias("step")).agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"))


@query(f"WITH {STEPS}, w AS (SELECT user_id, step, avg(value) OVER (PARTITION BY user_id ORDER BY step ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM e) SELECT user_id, step, round(m, 6) AS trailing FROM w WHERE step % 5 = 0")
def trailing_report(spark, d):
    made = selection.trailing_mean(steps(spark, d), ["user_id"], ["step"], "value", 10).where("step % 5 = 0")
    return made.select("user_id", F.col("step").cast("long").alias("step"), r("trailing").alias("trailing"))


@query(f"WITH {STEPS}, p AS (SELECT user_id, step, value AS pal, value / 2 AS flat, value * value AS edge FROM e WHERE step < 20) SELECT run, step, round(avg(v), 4) AS mean, count(*) AS n FROM (UNPIVOT p ON pal, flat, edge INTO NAME run VALUE v) GROUP BY ALL")
def stacked_series(spark, d):
    """Traces kept as a map from run to an array of structs, stacked into rows and averaged by step."""
    s = steps(spark, d).where("step < 20").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct(F.col("step").cast("long").alias("step"), F.col("value").alias("v")))).alias("s"))
    of = lambda f: F.transform("s", lambda x: F.struct(x["step"].alias("step"), f(x["v"]).alias("v")))
    runs_ = F.create_map(F.lit("pal"), of(lambda v: v), F.lit("flat"), of(lambda v: v / 2), F.lit("edge"), of(lambda v: v * v))
    return selection.stacked(s.select("user_id", runs_.alias("runs")), ["user_id"], "runs", "run").groupBy("run", "step").agg(r(F.avg("v"), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%'")
def set_intersection(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderstatus", "o_orderpriority")
    return o.where("o_orderstatus = 'F'").select("custkey").intersect(o.where("o_orderpriority like '1%'").select("custkey"))


@query("SELECT 'n' AS \"column\", count(*) FILTER (l_returnflag = 'A')::DOUBLE AS A, count(*) FILTER (l_returnflag = 'N')::DOUBLE AS N, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS R FROM lineitem UNION ALL SELECT 'qty', round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6), round(avg(l_quantity) FILTER (l_returnflag = 'N'), 6), round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) FROM lineitem")
def transpose(spark, d):
    s = t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count("*").cast("double").alias("n"), r(F.avg("l_quantity")).alias("qty"))
    return agg.transposed(s, "method", ["n", "qty"], ["A", "N", "R"])


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def head_rows(spark, d):
    return t(spark, d, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(10)


@query("WITH w AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k FROM part), c AS (SELECT p_brand, unnest(range(0, ((max(k) // 7) + 1) * 7)) AS k FROM w GROUP BY p_brand) SELECT c.p_brand, (c.k // 7)::INT AS line, (c.k % 7)::INT AS place, p_partkey FROM c LEFT JOIN w ON w.p_brand = c.p_brand AND w.k = c.k")
def padded_display(spark, d):
    return selection.padded_rows(t(spark, d, "part"), ["p_brand"], ["p_partkey"], 7, "p_partkey")


@query(f"""WITH i AS (SELECT n_nationkey AS item, n_nationkey % 8 = 3 AS again FROM nation), x AS (SELECT s_suppkey AS rater, item, again, row_number() OVER (PARTITION BY s_suppkey ORDER BY {hash_sql('s_suppkey', 'item', '1')}, item) - 1 AS k, count(*) OVER (PARTITION BY s_suppkey) AS n FROM supplier, i),
y AS (SELECT rater, item, false AS repeat, k::DOUBLE AS p FROM x UNION ALL SELECT rater, item, true, (n * 2 // 3) + ({hash_sql('rater', 'item', '2')}) % (n - (n * 2 // 3) + 1) - 0.5 FROM x WHERE again) SELECT rater, item, repeat, row_number() OVER (PARTITION BY rater ORDER BY p, repeat, item) - 1 AS place FROM y""")
def rater_orders(spark, d):
    raters = t(spark, d, "supplier").select(F.col("s_suppkey").alias("rater"))
    items = t(spark, d, "nation").select(F.col("n_nationkey").alias("item"), (F.col("n_nationkey") % 8 == 3).alias("again"))
    made = selection.rater_order(raters, "rater", items, "item", "again", S.mixed_int)
    return made.withColumn("place", F.col("place").cast("long")).select("rater", "item", "repeat", "place")


# ---- sinks and sources
@query("WITH m AS (SELECT p_brand, count(*) AS n, avg(p_size) AS s FROM part GROUP BY 1) SELECT 0 AS place, '' AS k, '| brand | n | size |' AS line UNION ALL SELECT 1, '', '|---|---|---|' UNION ALL SELECT 2, p_brand, '| ' || p_brand || ' | ' || n || ' | ' || printf('%.2f', round_even(s, 2)) || ' |' FROM m")
def markdown_table(spark, d):
    m = t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.avg("p_size").alias("s"))
    head = spark.createDataFrame([(i, "", x) for i, x in enumerate(selection.markdown_head(["brand", "n", "size"]))], "place int, k string, line string")
    return head.unionByName(m.select(F.lit(2).alias("place"), F.col("p_brand").alias("k"), selection.markdown_row([F.col("p_brand"), F.col("n").cast("string"), S.number_text(F.col("s"), 2)]).alias("line")))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'a, \"b\"' END AS note, s_acctbal, NULL::INT AS missing FROM supplier")
def csv_round_trip(spark, d):
    """Written as CSV and read by header name, empty text kept."""
    rows = t(spark, d, "supplier").select("s_acctbal", "s_name", F.when(F.col("s_suppkey") % 3 == 0, "").otherwise('a, "b"').alias("note"), "s_suppkey")
    path = runs.scratch(spark)
    sinks.csv(rows, path)
    made = readers.csv(spark, path, "s_suppkey long, s_name string, note string, s_acctbal double", keep_empty=True)
    return made.withColumn("missing", F.lit(None).cast("int"))


@query("SELECT p_brand, p_partkey, p_size FROM part")
def json_round_trip(spark, d):
    """Appended JSON lines, twice, read with a declared schema."""
    rows, path = t(spark, d, "part").select("p_brand", "p_partkey", "p_size"), runs.scratch(spark)
    sinks.append_json(rows.where("p_size < 25"), path)
    sinks.append_json(rows.where("p_size >= 25"), path)
    return readers.json_lines(spark, path, "p_brand string, p_partkey long, p_size int")


@query("SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, count(*) AS n FROM orders GROUP BY o_orderstatus")
def partition_replace(spark, d):
    """Partitions of one key replaced, the others left as they were."""
    n, path = t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n")), runs.scratch(spark)
    sinks.partitions(n.withColumn("version", F.lit(1)), path, "o_orderstatus")
    sinks.partitions(n.where("o_orderstatus = 'F'").withColumn("version", F.lit(2)), path, "o_orderstatus")
    return spark.read.parquet(path).select(F.col("o_orderstatus").cast("string").alias("o_orderstatus"), "version", "n")


@query(f"WITH {G} SELECT img, 24 AS height, 24 AS width, sha256(string_agg(label::VARCHAR, ',' ORDER BY y, x)) AS digest FROM l GROUP BY img")
def map_spill(spark, d):
    path = runs.scratch(spark)
    sinks.maps(grid(spark, d)).write.parquet(path)
    made = spark.read.parquet(path)
    return made.select("img", "height", "width", F.sha2(F.array_join(F.transform("labels", lambda x: x.cast("string")), ","), 256).alias("digest"))


@query(f"WITH {G}, p AS (SELECT *, x - row_number() OVER (PARTITION BY img, y, label ORDER BY x) AS k FROM l WHERE label IN (1, 3)), b AS (SELECT img, label, y, k, min(x) AS x, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT img, label, string_agg(printf('M%d %dh%dv1h-%dz', x, y, n, n), '' ORDER BY y, x) AS d FROM b GROUP BY img, label), s AS (SELECT img, string_agg('<path fill=\"' || CASE label WHEN 3 THEN '#c00' ELSE '#06c' END || '\" d=\"' || d || '\"/>', '' ORDER BY label DESC) AS p FROM t GROUP BY img) SELECT img, sha256('<svg xmlns=\"http://www.w3.org/2000/svg\" width=\"12.00mm\" height=\"12.00mm\" viewBox=\"0 0 24 24\">' || p || '</svg>') AS digest FROM s")
def svg_layers(spark, d):
    return sinks.svg(grid(spark, d), {3: "#c00", 1: "#06c"}, 0.5).select("img", F.sha2("svg", 256).alias("digest"))


@query(f"WITH {G} SELECT img, count(*) FILTER (label = 3) AS reds, count(*) FILTER (label = 1) AS blues, 1e0 AS agreement FROM l WHERE label IN (1, 3) GROUP BY img")
def svg_pixels(spark, d):
    """Pixels read back from the layers of :func:`svg_layers`, against the label map."""
    colours = {3: "#c00", 1: "#06c"}
    drawn = readers.svg_pixels(sinks.svg(grid(spark, d), colours, 0.5))
    both = grid(spark, d).where("label in (1, 3)").join(drawn, raster.PIXEL, "full")
    same = F.coalesce(F.col("fill") == F.when(F.col("label") == 3, colours[3]).otherwise(colours[1]), F.lit(False))
    n = lambda c: F.count(F.when(F.col("fill") == c, 1))
    return both.groupBy("img").agg(n(colours[3]).alias("reds"), n(colours[1]).alias("blues"), F.avg(same.cast("int")).alias("agreement"))


@query("""SELECT '<!doctype html><meta charset="utf-8"><title>Survey</title><script type="application/json" id="data">' || replace('[' || string_agg('{"id":' || n_nationkey || ',"text":"' || n_name || ' </script>"}', ',' ORDER BY n_nationkey) || ']', '</', '<\\/') || '</script>' AS html FROM nation""")
def survey_page(spark, d):
    return sinks.survey(t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.col("n_name"), F.lit(" </script>")).alias("text")), ["id"], "Survey")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def watched_once(spark, d):
    """Two runs of a watcher over the same folder: what was scored once isn't again."""
    path = runs.scratch(spark)
    scored = lambda: runs.stream(spark, d, "events", "ts").select("event_id", "event_type", "value")
    runs.watch(scored(), f"{path}/out", f"{path}/state")
    return runs.watch(scored(), f"{path}/out", f"{path}/state").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, event_type FROM events")
def dedup_watermark(spark, d):
    """A stream in which every event comes twice, each left once."""
    events = runs.stream(spark, d, "events", "ts").select("event_id", "event_type", "ts")
    return runs.drain(runs.once(events.unionByName(events), "ts", ["event_id"], "40 days").select("event_id", "event_type"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def still_to_do(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return runs.missing(o, o.where("o_orderstatus = 'F'"), "o_orderkey").select("o_orderkey")

