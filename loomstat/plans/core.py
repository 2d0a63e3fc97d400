"""Queries over the driver's tables, each with the SQL that checks it: relational core and inference.

Roles: ``lineitem`` rows are measured outputs; the return flag is the method, the supplier's nation the unit (drawing), the
line number the seed; quantity, price, discount and tax are measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import agg, inference, selection
from ..sources import readers
from ..streaming import runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MEASURES = ["qty", "price", "disc", "tax"]
M = """m AS (SELECT l_returnflag AS method, n_name AS unit, r_name AS grp, l_linenumber AS seed, l_orderkey AS okey, l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax, l_linestatus AS status
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
U = M + ", u AS (SELECT method, unit, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc, avg(tax) AS tax FROM m GROUP BY ALL)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def measures(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: readers.table(spark, d, n)
    units = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    units = units.select("s_suppkey", F.col("n_name").alias("unit"), F.col("r_name").alias("grp"))
    rows = t("lineitem").join(units, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("l_returnflag").alias("method"), "unit", "grp", F.col("l_linenumber").alias("seed"), F.col("l_orderkey").alias("okey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_linestatus").alias("status"))


def r(c, n: int = 6):
    return F.round(c, n)


def rounded(df: DataFrame, *names: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in names})


@query(f"WITH {U} SELECT method, count(*) AS n_units, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price, round(avg(disc), 6) AS disc, round(avg(tax), 6) AS tax FROM u GROUP BY method")
def two_stage_mean(spark, d):
    return rounded(agg.two_stage_mean(measures(spark, d), "method", "unit", MEASURES), *MEASURES)


@query(f"WITH {M}, b AS (SELECT method, unit, qty, CASE WHEN disc < 0.02 THEN NULL ELSE price END AS price, CASE WHEN disc < 0.02 THEN NULL ELSE tax END AS tax FROM m) SELECT method, unit, round(avg(qty), 6) AS qty, round(avg(price), 6) AS price, round(avg(tax), 6) AS tax, count(price) AS n_price FROM b GROUP BY method, unit")
def blank_null_out(spark, d):
    rows = agg.null_out(measures(spark, d), F.col("disc") < 0.02, ["price", "tax"])
    return rows.groupBy("method", "unit").agg(r(F.avg("qty")).alias("qty"), r(F.avg("price")).alias("price"), r(F.avg("tax")).alias("tax"), F.count("price").alias("n_price"))


@query(f"WITH {M}, b AS (SELECT method, unit, CASE WHEN qty < 26 THEN price END AS half, CASE WHEN qty < 20 THEN price END AS few FROM m) SELECT method, unit, round(CASE WHEN count(half) >= 0.5 * count(*) THEN avg(half) END, 6) AS half, round(CASE WHEN count(few) >= 0.5 * count(*) THEN avg(few) END, 6) AS few FROM b GROUP BY method, unit")
def coverage_mean(spark, d):
    rows = measures(spark, d).select("method", "unit", F.when(F.col("qty") < 26, F.col("price")).alias("half"), F.when(F.col("qty") < 20, F.col("price")).alias("few"))
    return rows.groupBy("method", "unit").agg(r(agg.covered("half")).alias("half"), r(agg.covered("few")).alias("few"))


@query(r"""WITH f AS (SELECT 'run/' || s_name || '/c' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '_s' ELSE '_s' || (s_suppkey % 5) END || '_seed' || (s_suppkey * 7) || '.png' AS path FROM supplier),
g AS (SELECT path, regexp_extract(path, '([^/]+)\.png$', 1) AS stem FROM f)
SELECT path, string_split(path, '/')[-2] AS folder, regexp_extract(stem, '^(.+)_s(\d*)_seed(\d+)$', 1) AS content, nullif(regexp_extract(stem, '^(.+)_s(\d*)_seed(\d+)$', 2), '')::INT AS style, regexp_extract(stem, '^(.+)_s(\d*)_seed(\d+)$', 3)::INT AS seed, regexp_replace(stem, '(_s\d*)?_seed\d+(\.\w+)?$', '') AS by_replace FROM g""")
def key_parse(spark, d):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("run/"), "s_name", F.lit("/c"), k.cast("string"), F.when(k % 3 == 0, F.lit("_s")).otherwise(F.concat(F.lit("_s"), (k % 5).cast("string"))), F.lit("_seed"), (k * 7).cast("string"), F.lit(".png"))
    rows = readers.table(spark, d, "supplier").select(path.alias("path")).withColumn("stem", F.regexp_extract("path", r"([^/]+)\.png$", 1))
    p = S.key_parts(F.col("stem"))
    return rows.select("path", S.from_end(F.col("path"), 2).alias("folder"), p["content"].alias("content"), p["style"].alias("style"), p["seed"].alias("seed"), S.content_of(F.col("stem")).alias("by_replace"))


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_type LIKE 'A%' OR p_type LIKE '%B%' THEN 'typed' WHEN contains(p_name, '1') OR contains(p_name, '7') THEN 'numbered' ELSE 'other' END AS category, CASE p_brand WHEN 'Brand#1' THEN 'first' WHEN 'Brand#2' THEN 'second' ELSE p_brand END AS brand FROM part""")
def category_case(spark, d):
    c = F.when(F.col("p_size") > 40, "large").when(F.col("p_type").startswith("A") | F.col("p_type").contains("B"), "typed").when(S.contains_any(F.col("p_name"), ["1", "7"]), "numbered").otherwise("other")
    return readers.table(spark, d, "part").select("p_partkey", c.alias("category"), S.mapped(F.col("p_brand"), {"Brand#1": "first", "Brand#2": "second"}).alias("brand"))


@query("WITH e(pos, method) AS (VALUES (0, 'R'), (1, 'missing'), (2, 'A'), (3, 'N')) SELECT pos, e.method, n, q FROM e LEFT JOIN (SELECT l_returnflag AS method, count(*) AS n, round(sum(l_quantity), 6) AS q FROM lineitem GROUP BY 1) l ON e.method = l.method")
def ordered_expected_join(spark, d):
    found = readers.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("method")).agg(F.count("*").alias("n"), r(F.sum("l_quantity")).alias("q"))
    return readers.expected(found, "method", ["R", "missing", "A", "N"]).select("pos", "method", "n", "q")


@query("SELECT c_custkey, n AS plan_orders, round(t, 6) AS plan_total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS t FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON c_custkey = o_custkey")
def left_plan_join(spark, d):
    plan = readers.table(spark, d, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("plan_orders"), r(F.sum("o_totalprice")).alias("plan_total"))
    return readers.table(spark, d, "customer").join(plan, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "plan_orders", "plan_total")


@query("SELECT (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS without, (SELECT count(*) FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_some")
def anti_semi_repeats(spark, d):
    c, o = readers.table(spark, d, "customer"), readers.table(spark, d, "orders")
    on = F.col("c_custkey") == F.col("o_custkey")
    a = c.join(o, on, "left_anti").agg(F.count("*").alias("without"))
    return a.crossJoin(c.join(o, on, "left_semi").agg(F.count("*").alias("with_some")))


@query(f"WITH {M} SELECT method, unit, round(avg(qty), 6) AS mean, round(median(qty), 6) AS median, round(stddev_samp(price), 4) AS std, count(*) AS n, min(tax) AS tax_min, max(tax) AS tax_max, round(max(price) - min(price), 6) AS range FROM m GROUP BY method, unit HAVING count(*) > 5")
def mixed_aggs(spark, d):
    g = measures(spark, d).groupBy("method", "unit").agg(r(F.avg("qty")).alias("mean"), r(F.median("qty")).alias("median"), r(F.stddev_samp("price"), 4).alias("std"), F.count("*").alias("n"), F.min("tax").alias("tax_min"), F.max("tax").alias("tax_max"), r(F.max("price") - F.min("price")).alias("range"))
    return g.where("n > 5")


@query(f"""WITH {M}, l AS (UNPIVOT (SELECT method, qty, price, disc FROM m) ON qty, price, disc INTO NAME "column" VALUE value)
SELECT method, "column", count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS max FROM l GROUP BY ALL""")
def describe_long(spark, d):
    made = agg.describe_long(measures(spark, d).select("method", "qty", "price", "disc"), ["method"], ["qty", "price", "disc"], runs.written)
    return rounded(rounded(made, "mean", "q25", "median", "q75"), "std", n=4)


@query(f"WITH {M}, a(alpha) AS (VALUES (0.0), (0.01), (0.02), (0.03), (0.04), (0.05), (0.06), (0.08)) SELECT alpha::DOUBLE AS alpha, method, round(quantile_cont(price, 0.25), 6) AS low, round(median(price), 6) AS median, round(quantile_cont(price, 0.75), 6) AS high FROM m JOIN a ON disc > alpha GROUP BY ALL")
def quantile_band(spark, d):
    rows = measures(spark, d).withColumn("alpha", F.explode(F.array(*map(F.lit, (0.0, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08))))).where("disc > alpha")
    return rounded(agg.quantiles(rows, ["alpha", "method"], "price", {"low": 0.25, "median": 0.5, "high": 0.75}, runs.written), "low", "median", "high")


@query(f"WITH {M} SELECT method, round(avg((price < 20000)::INT), 9) AS cheap, round(avg((disc >= 0.05)::INT), 9) AS discounted, round(sum(price * disc) / sum(price), 9) AS ratio FROM m GROUP BY method")
def share_where(spark, d):
    return measures(spark, d).groupBy("method").agg(r(agg.share_where(F.col("price") < 20000), 9).alias("cheap"), r(agg.share_where(F.col("disc") >= 0.05), 9).alias("discounted"), r(F.sum(F.col("price") * F.col("disc")) / F.sum("price"), 9).alias("ratio"))


@query(f"WITH {M} SELECT method, count(DISTINCT unit) AS units, count(DISTINCT okey) AS orders, count(*) AS n FROM m GROUP BY method")
def distinct_units(spark, d):
    return measures(spark, d).groupBy("method").agg(F.count_distinct("unit").alias("units"), F.count_distinct("okey").alias("orders"), F.count("*").alias("n"))


@query("SELECT p_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type")
def value_counts(spark, d):
    from pyspark.sql import Window

    n = readers.table(spark, d, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "p_type")).cast("long"))


@query("WITH o AS (SELECT l_returnflag AS method, count(*) AS n, NULL::DOUBLE AS added FROM lineitem GROUP BY 1), w AS (SELECT l_returnflag AS method, count(*) AS n, round(sum(l_tax), 6) AS added FROM lineitem WHERE l_returnflag <> 'A' AND l_quantity > 10 GROUP BY 1) SELECT * FROM o WHERE method NOT IN (SELECT method FROM w) UNION ALL SELECT * FROM w")
def upsert_by_method(spark, d):
    rows = readers.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "method")
    old = rows.groupBy("method").agg(F.count("*").alias("n"))
    new = rows.where("method <> 'A' and l_quantity > 10").groupBy("method").agg(F.count("*").alias("n"), r(F.sum("l_tax")).alias("added"))
    return agg.upsert(old, new, "method")


@query("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal, NULL AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def union_by_name(spark, d):
    a = readers.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = readers.table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"WITH {U} SELECT method, unit, metric, round(value, 6) AS value FROM (UNPIVOT u ON qty, price, disc, tax INTO NAME metric VALUE value)")
def unpivot_long(spark, d):
    return rounded(agg.unit_means(measures(spark, d), ["method", "unit"], MEASURES).unpivot(["method", "unit"], MEASURES, "metric", "value").where("value is not null"), "value")


@query(f"WITH {M} SELECT unit, round(avg(qty) FILTER (method = 'A'), 6) AS a, round(avg(qty) FILTER (method = 'N'), 6) AS n, round(avg(qty) FILTER (method = 'R'), 6) AS r FROM m GROUP BY unit")
def pivot_methods(spark, d):
    p = measures(spark, d).groupBy("unit").pivot("method", ["A", "N", "R"]).agg(F.avg("qty"))
    return p.select("unit", *[r(F.col(c)).alias(c.lower()) for c in ("A", "N", "R")])


@query("SELECT p_partkey, flip, kind, p_partkey::VARCHAR || '_' || kind || CASE WHEN flip THEN '_f' ELSE '' END AS name FROM part CROSS JOIN (VALUES (true), (false)) f(flip) CROSS JOIN (VALUES ('dense'), ('coarse')) k(kind)")
def augment_cross(spark, d):
    rows = readers.table(spark, d, "part").select("p_partkey").withColumn("flip", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("kind", F.explode(F.array(F.lit("dense"), F.lit("coarse"))))
    return rows.withColumn("name", F.concat(F.col("p_partkey").cast("string"), F.lit("_"), "kind", F.when(F.col("flip"), "_f").otherwise("")))


@query("SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'excluded' WHEN l.quality = 1 AND d.doc_id % 5 = 0 THEN 'held_out' WHEN l.quality = 1 THEN 'train' WHEN l.doc_id IS NULL THEN 'unlabelled' ELSE 'rest' END AS role FROM documents d LEFT JOIN labels l USING (doc_id)")
def roles_split(spark, d):
    docs, labels = readers.table(spark, d, "documents").select("doc_id"), readers.table(spark, d, "labels").withColumn("seen", F.lit(True))
    role = F.when(F.col("toxic") == 1, "excluded").when((F.col("quality") == 1) & (F.col("doc_id") % 5 == 0), "held_out").when(F.col("quality") == 1, "train").when(F.col("seen").isNull(), "unlabelled").otherwise("rest")
    return docs.join(labels, "doc_id", "left").select("doc_id", role.alias("role"))


# ---- inference
PAIR = U + ", p AS (SELECT unit, max(qty) FILTER (method = 'A') AS a, max(qty) FILTER (method = 'R') AS b FROM u GROUP BY unit HAVING count(qty) FILTER (method = 'A') > 0 AND count(qty) FILTER (method = 'R') > 0), d AS (SELECT unit, a, b, a - b AS d FROM p)"
SIGNED = PAIR + ", k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2e0 AS rk FROM d WHERE d <> 0)"


def pairs(spark, d, metric="qty"):
    return inference.paired(measures(spark, d), "method", ["unit"], metric, "A", "R")


@query(f"WITH {PAIR} SELECT unit, round(a, 6) AS a, round(b, 6) AS b, round(d, 6) AS d FROM d")
def paired_diff(spark, d):
    return rounded(pairs(spark, d), "a", "b", "d")


@query("SELECT p_partkey, (rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0) AS rk FROM part")
def average_rank(spark, d):
    return inference.ranked(readers.table(spark, d, "part").select("p_partkey", "p_size"), "p_size", "rk").select("p_partkey", "rk")


@query(f"WITH {SIGNED} SELECT count(*) AS n, round(CASE WHEN count(*) = 0 THEN 0 ELSE (coalesce(sum(rk) FILTER (d > 0), 0) - coalesce(sum(rk) FILTER (d < 0), 0)) / sum(rk) END, 9) AS r_rb FROM k")
def rank_biserial(spark, d):
    return inference.signed_rank(pairs(spark, d), []).select("n", r("r_rb", 9).alias("r_rb"))


@query(f"WITH {SIGNED} SELECT count(*) AS n, coalesce(sum(rk) FILTER (d > 0), 0) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0) AS w_minus FROM k")
def wilcoxon_w(spark, d):
    return inference.signed_rank(pairs(spark, d), []).select("n", "w_plus", "w_minus")


@query(f"""WITH RECURSIVE {SIGNED}, w AS (SELECT count(*) AS n, least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w FROM k),
c(i, s, ways) AS (SELECT 0::BIGINT, 0::BIGINT, 1e0 UNION ALL SELECT i + 1, t, sum(ways) FROM (SELECT i, s AS t, ways FROM c WHERE i < (SELECT n FROM w) UNION ALL SELECT i, s + i + 1, ways FROM c WHERE i < (SELECT n FROM w)) GROUP BY i, t)
SELECT n, w, round(least(1, 2 * (SELECT sum(ways) FROM c WHERE i = n AND s <= w) / pow(2, n)), 9) AS p FROM w""")
def wilcoxon_exact_p(spark, d):
    s = inference.signed_rank(pairs(spark, d), [])
    return s.select("n", F.least("w_plus", "w_minus").alias("w"), r(inference.wilcoxon("w_plus", "w_minus", "n", "ties", "zeros"), 9).alias("p"))


def hash_sql(*keys: str) -> str:
    h = "12345::BIGINT"
    for k in keys:
        h = f"((((({h}) + ({k})::BIGINT % 2147483647 + 1) * 48271) % 2147483647) * 69621 + 7) % 2147483647"
    return h


@query(f"WITH {PAIR}, i AS (SELECT d, row_number() OVER (ORDER BY unit) - 1 AS i, count(*) OVER () AS n FROM d), w AS (SELECT b, ({hash_sql('b', 'i')}) % n AS j FROM i, range(1, 201) t(b)), s AS (SELECT b, avg(i.d) AS mean FROM w JOIN i ON w.j = i.i GROUP BY b) SELECT (SELECT count(*) FROM d) AS n, (SELECT round(avg(d), 6) FROM d) AS diff, round(quantile_cont(mean, 0.025), 6) AS ci_lo, round(quantile_cont(mean, 0.975), 6) AS ci_hi FROM s")
def bootstrap_ci_det(spark, d):
    made = inference.bootstrap_interval(pairs(spark, d).withColumn("metric", F.lit("qty")), ["metric"], "unit", rounds=200)  # as its SQL draws
    return rounded(made.select("n", "diff", "ci_lo", "ci_hi"), "diff", "ci_lo", "ci_hi")


@query()
def bootstrap_ci_pcg64(spark, d):
    return inference.bootstrap_pcg64(pairs(spark, d).withColumn("metric", F.lit("qty")), ["metric"], "unit")


PS = "ps AS (SELECT s_suppkey AS id, s_nationkey AS family, ((s_suppkey * 7919) % 1000 + 1) / 20000e0 AS p FROM supplier)"


def p_values(spark, d):
    k = F.col("s_suppkey")
    return readers.table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("family"), (((k * 7919) % 1000 + 1) / F.lit(20000.0)).alias("p"))


@query(f"WITH {PS}, s AS (SELECT id, p, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p) AS x FROM ps) SELECT id, p, round(max(x) OVER (ORDER BY p, id), 9) AS p_holm FROM s")
def holm_family(spark, d):
    return rounded(inference.holm(p_values(spark, d).withColumn("one", F.lit(1)), "p", ["one"], ["id"]).drop("one", "family"), "p_holm", n=9)


@query(f"WITH {PS}, s AS (SELECT id, family, p, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p) AS x FROM ps) SELECT id, family, p, round(max(x) OVER (PARTITION BY family ORDER BY p, id), 9) AS p_holm FROM s")
def holm_by_group(spark, d):
    return rounded(inference.holm(p_values(spark, d), "p", ["family"], ["id"]), "p_holm", n=9)


CMP = U + """, l AS (SELECT method, unit, metric, value FROM (UNPIVOT u ON qty, price, disc, tax INTO NAME metric VALUE value)),
q AS (SELECT x.method AS a, y.method AS b, x.metric, x.unit, x.value AS va, y.value AS vb, x.value - y.value AS d FROM l x JOIN l y USING (metric, unit) WHERE (x.method, y.method) IN (('A', 'N'), ('R', 'N'), ('A', 'R')))"""


@query(f"WITH {CMP} SELECT a, b, metric, count(*) AS n, round(avg(va), 6) AS mean_a, round(avg(vb), 6) AS mean_b, round(avg(d), 6) AS diff, CASE WHEN (avg(d) > 0) = (metric <> 'tax') THEN 'a' ELSE 'b' END AS better FROM q GROUP BY a, b, metric")
def comparison_table(spark, d):
    made = differences(spark, d)
    better = F.when((F.col("diff") > 0) == (F.col("metric") != "tax"), "a").otherwise("b")
    return rounded(made.withColumn("better", better), "mean_a", "mean_b", "diff")


def differences(spark, d):
    return inference.mean_differences(measures(spark, d), "method", "unit", MEASURES, [("A", "N"), ("R", "N"), ("A", "R")])


def compared(spark, d):
    return inference.compare(measures(spark, d), "method", "unit", {"qty": True, "price": True, "disc": True, "tax": False}, [("A", "N"), ("R", "N"), ("A", "R")])


@query()
def comparison_inference(spark, d):
    made = compared(spark, d)
    return made.withColumns({"p_text": S.p_text(F.col("p_holm")), "stars": S.stars(F.col("p_holm")), "clear": (F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)})


@query(f"WITH {CMP} SELECT a, b, round(avg(vb) FILTER (metric = 'qty'), 6) AS qty_before, round(avg(va) FILTER (metric = 'qty'), 6) AS qty_after, round(avg(d) FILTER (metric = 'qty'), 6) AS qty_diff, round(avg(vb) FILTER (metric = 'tax'), 6) AS tax_before, round(avg(va) FILTER (metric = 'tax'), 6) AS tax_after, round(avg(d) FILTER (metric = 'tax'), 6) AS tax_diff FROM q GROUP BY a, b")
def plugin_matrix(spark, d):
    made = differences(spark, d).groupBy("a", "b").pivot("metric", ["qty", "tax"]).agg(F.first("mean_b").alias("before"), F.first("mean_a").alias("after"), F.first("diff").alias("diff"))
    return rounded(made, *[c for c in made.columns if c not in ("a", "b")])


@query("""WITH r AS (SELECT p_retailprice AS x, p_size AS y, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2e0 AS rx, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2e0 AS ry FROM part)
SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, round(avg(x), 6) AS mean_x, round(avg(y), 6) AS mean_y, round(median(abs(x - y)), 6) AS median_abs FROM r""")
def pearson_spearman(spark, d):
    rows = readers.table(spark, d, "part").select(F.col("p_retailprice").alias("x"), F.col("p_size").cast("double").alias("y"))
    rows = inference.ranked(inference.ranked(rows, "x", "rx"), "y", "ry")
    return rows.agg(r(F.corr("x", "y")).alias("pearson"), r(F.corr("rx", "ry")).alias("spearman"), r(F.avg("x")).alias("mean_x"), r(F.avg("y")).alias("mean_y"), r(F.median(F.abs(F.col("x") - F.col("y")))).alias("median_abs"))


RATE = "e AS (SELECT event_type AS unit, user_id % 7 AS rater, user_id % 2 AS form, value AS x FROM events)"


def ratings(spark, d):
    return readers.table(spark, d, "events").select(F.col("event_type").alias("unit"), (F.col("user_id") % 7).alias("rater"), (F.col("user_id") % 2).alias("form"), F.col("value").alias("x"))


@query(f"""WITH {RATE}, c AS (SELECT form, unit, rater, avg(x) AS x FROM e GROUP BY ALL), k AS (SELECT form, count(DISTINCT rater) AS k FROM c GROUP BY form), f AS (SELECT c.form, unit FROM c JOIN k USING (form) GROUP BY c.form, unit, k HAVING count(*) = k),
g AS (SELECT c.*, k, avg(x) OVER (PARTITION BY c.form) AS g, avg(x) OVER (PARTITION BY c.form, unit) AS u, avg(x) OVER (PARTITION BY c.form, rater) AS r FROM c JOIN f USING (form, unit) JOIN k USING (form)),
s AS (SELECT form, max(k) AS k, count(DISTINCT unit) AS n, sum((u - g) ** 2) / (count(DISTINCT unit) - 1) AS msr, sum((r - g) ** 2) / (max(k) - 1) AS msc, sum((x - u - r + g) ** 2) / ((count(DISTINCT unit) - 1) * (max(k) - 1)) AS mse FROM g GROUP BY form)
SELECT form, n AS n_units, k AS n_raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc_1, round((msr - mse) / (msr + (msc - mse) / n), 6) AS icc_k FROM s""")
def icc2(spark, d):
    return rounded(inference.icc2(ratings(spark, d), ["form"], "unit", "rater", "x"), "icc_1", "icc_k")


@query("""WITH v AS (SELECT user_id, event_type, round(value / 20) AS score, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
SELECT a.event_type, count(*) AS n, round(avg(abs(a.score - b.score)), 6) AS mean_abs, round(avg((a.score = b.score)::INT), 6) AS agree FROM v a JOIN v b USING (user_id, event_type) WHERE a.k = 1 AND b.k = 2 GROUP BY a.event_type""")
def repeat_consistency(spark, d):
    from pyspark.sql import Window

    v = readers.table(spark, d, "events").select("user_id", "event_type", F.round(F.col("value") / 20).alias("score"), F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).alias("k"))
    return rounded(inference.repeat_consistency(v, ["event_type"], ["user_id"], F.col("k") == 1, F.col("k") == 2), "mean_abs", "agree")


@query("""SELECT p_brand, coalesce(arg_min(p_partkey, (p_retailprice, p_partkey)) FILTER (p_size >= 45), arg_min(p_partkey, (-p_size, p_partkey))) AS p_partkey, count(*) FILTER (p_size >= 45) > 0 AS eligible FROM part GROUP BY p_brand""")
def constrained_select(spark, d):
    return selection.constrained_best(readers.table(spark, d, "part"), ["p_brand"], F.col("p_size") >= 45, "p_retailprice", "p_size", "p_partkey")
