"""Paired inference: ranks, signed-rank test, bootstrap intervals, family-wise correction, rater reliability."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import mixed_int


def paired(df: DataFrame, method: str, unit: list[str], value: str, a: str, b: str) -> DataFrame:
    """One row per unit that both methods have a value for: ``a``, ``b`` and their difference ``d``. One shuffle, no join."""
    pick = lambda m: F.avg(F.when(F.col(method) == m, F.col(value)))
    both = df.where(F.col(method).isin(a, b)).dropna(subset=unit).groupBy(*unit).agg(pick(a).alias("a"), pick(b).alias("b"))
    return both.dropna(subset=["a", "b"]).withColumn("d", F.col("a") - F.col("b"))


def average_rank(order: Column | str, *by: str) -> Column:
    """Rank from 1 in the group; ties share their mean rank."""
    ties = Window.partitionBy(*by, order)
    return F.rank().over(Window.partitionBy(*by).orderBy(order)) + (F.count("*").over(ties) - 1) / F.lit(2.0)


def signed_rank(pairs: DataFrame, by: list[str]) -> DataFrame:
    """By group: ``n`` non-zero differences, ``w_plus``, ``w_minus``, rank-biserial ``r_rb`` (0 if none), ``ties`` (sum of t**3 - t), ``zeros``.

    ``by`` groups are comparisons; a window holds one comparison's units.
    """
    keys = by or [F.lit(0).alias("_one")]
    rows = pairs.select(*keys, "d", F.abs("d").alias("m"))
    names = by or ["_one"]
    ranked = rows.where("d <> 0").withColumns({"rank": average_rank("m", *names), "t": F.count("*").over(Window.partitionBy(*names, "m"))})
    up, down = F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("rank"))), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("d") < 0, F.col("rank"))), F.lit(0.0))
    stats = ranked.groupBy(*names).agg(F.count("*").alias("n"), up.alias("w_plus"), down.alias("w_minus"), F.sum(F.col("t") * F.col("t") - 1).cast("double").alias("ties"))
    every = rows.groupBy(*names).agg(F.sum((F.col("d") == 0).cast("long")).alias("zeros"))
    made = every.join(stats, names, "left").fillna({"n": 0, "w_plus": 0.0, "w_minus": 0.0, "ties": 0.0})
    made = made.withColumn("r_rb", F.when(F.col("n") == 0, 0.0).otherwise((F.col("w_plus") - F.col("w_minus")) / (F.col("w_plus") + F.col("w_minus"))))
    return made if by else made.drop("_one")


@lru_cache(512)
def _null_counts(n: int) -> np.ndarray:
    """Numbers of sign patterns of ranks 1..n by their W+."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for k in range(1, n + 1):
        counts[k:] += counts[:-k].copy()
    return counts


def wilcoxon_p(w_plus: float, w_minus: float, n: int, ties: float, zeros: int, exact_to: int = 50) -> float:
    """Two-sided p: from the exact null distribution without ties and zeros and up to ``exact_to`` pairs, else the normal one with tie correction; 1 without a difference."""
    if n == 0:
        return 1.0
    w = min(w_plus, w_minus)
    if not ties and not zeros and n <= exact_to:
        return float(min(1.0, 2.0 * _null_counts(n)[: int(w) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return float(math.erfc(abs(w - n * (n + 1) / 4.0) / math.sqrt(2.0 * var)))


@F.pandas_udf(T.DoubleType())
def wilcoxon(w_plus: pd.Series, w_minus: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    return pd.Series([wilcoxon_p(a, b, int(c), d, int(e)) for a, b, c, d, e in zip(w_plus, w_minus, n, ties, zeros, strict=True)])


def bootstrap_interval(pairs: DataFrame, by: list[str], unit: str, rounds: int = 10_000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """By group: mean difference and its percentile interval over deterministic resamples (integer hash of round and draw).

    The draws of a comparison are its units times ``rounds``; both are small and bounded by the study.
    """
    w = Window.partitionBy(*by)
    rows = pairs.withColumns({"_i": F.row_number().over(w.orderBy(unit)) - 1, "_n": F.count("*").over(w)})
    draws = rows.select(*by, "_n", F.col("_i").alias("_k")).withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    draws = draws.withColumn("_i", F.pmod(mixed_int(F.col("_b"), F.col("_k")), F.col("_n")).cast("int"))
    means = draws.join(rows.select(*by, "_i", "d"), [*by, "_i"]).groupBy(*by, "_b").agg(F.avg("d").alias("_mean"))
    band = means.groupBy(*by).agg(F.percentile("_mean", F.lit(low)).alias("ci_lo"), F.percentile("_mean", F.lit(high)).alias("ci_hi"))
    return pairs.groupBy(*by).agg(F.avg("d").alias("diff"), F.count("*").alias("n")).join(band, by)


def bootstrap_pcg64(pairs: DataFrame, by: list[str], unit: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """As :func:`bootstrap_interval` with numpy's PCG64 and an index matrix of ``rounds`` by n, units in their order."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        d = g.sort_values(unit)["d"].to_numpy()
        draw, step = np.random.default_rng(seed), max(1, (1 << 21) // len(d))  # some rounds at once; the draws are those of one matrix
        means = [d[draw.integers(0, len(d), (min(step, rounds - k), len(d)))].mean(axis=1) for k in range(0, rounds, step)]
        lo, hi = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame([[*g[by].iloc[0], len(d), d.mean(), lo, hi]], columns=[*by, "n", "diff", "ci_lo", "ci_hi"])

    keys = ", ".join(f"{k} {t}" for k, t in pairs.dtypes if k in by)
    return pairs.select(*by, unit, "d").groupBy(*by).applyInPandas(run, f"{keys}, n long, diff double, ci_lo double, ci_hi double")


def bootstrap_mean(df: DataFrame, by: list[str], value: str, order: str, rounds: int = 2000, seed: int = 0) -> DataFrame:
    """By group: n, mean and 95 % interval of ``rounds`` PCG64 resamples of its values, nulls left out, in the order of ``order``."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values(order)[value].to_numpy(np.float64)
        draw, step = np.random.default_rng(seed), max(1, (1 << 21) // len(x))
        means = [x[draw.integers(0, len(x), (min(step, rounds - k), len(x)))].mean(axis=1) for k in range(0, rounds, step)]
        lo, hi = np.percentile(np.concatenate(means), [2.5, 97.5])
        return pd.DataFrame([[*g[by].iloc[0], len(x), x.mean(), lo, hi]], columns=[*by, "n", "mean", "ci_lo", "ci_hi"])

    keys = ", ".join(f"{k} {t}" for k, t in df.dtypes if k in by)
    return df.select(*by, order, value).dropna(subset=[*by, value]).groupBy(*by).applyInPandas(run, f"{keys}, n long, mean double, ci_lo double, ci_hi double")


def bootstrap_shared(pairs: DataFrame, tests: list[str], unit: str, rounds: int = 10_000, seed: int = 0) -> DataFrame:
    """As :func:`bootstrap_pcg64`, but one generator draws for all tests in their order, resample by resample. What is drawn depends
    on the tests before, so they share a task; a study's tests are few."""
    def run(g: pd.DataFrame) -> pd.DataFrame:
        draw, rows = np.random.default_rng(seed), []
        for key, part in g.sort_values([*tests, unit]).groupby(tests, sort=True):
            d = part["d"].to_numpy(np.float64)
            if len(d) >= 2:
                means = [draw.choice(d, len(d)).mean() for _ in range(rounds)]
                rows.append([*key, len(d), d.mean(), *np.percentile(means, [2.5, 97.5])])
        return pd.DataFrame(rows, columns=[*tests, "n", "diff", "ci_lo", "ci_hi"])

    keys = ", ".join(f"{k} {t}" for k, t in pairs.dtypes if k in tests)
    return pairs.select(*tests, unit, "d", F.lit(0).alias("_one")).groupBy("_one").applyInPandas(run, f"{keys}, n long, diff double, ci_lo double, ci_hi double")


def ranked(df: DataFrame, order: str, name: str, parts: int = 256) -> DataFrame:
    """Add ``name``, the average rank of ``order`` over the whole table, from counts by value: values are counted, dealt to ``parts`` by bounds that
    are approximate quantiles of the different values (ranks are exact whatever they are), counts summed by part (few rows in one
    window), and within a part by value. Nulls get no rank."""
    n = df.where(F.col(order).isNotNull()).groupBy(F.col(order).alias("_v")).agg(F.count("*").alias("_n"))
    bounds = n.agg(F.array_distinct(F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(20 * parts))).alias("_bounds"))
    n = n.crossJoin(F.broadcast(bounds))  # one row
    n = n.select("_v", "_n", F.size(F.filter("_bounds", lambda b: b < F.col("_v"))).alias("_b"))
    sums = n.groupBy("_b").agg(F.sum("_n").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_b", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_n").over(Window.partitionBy("_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1))
    ranks = n.join(sums, "_b").select("_v", (F.col("_before") + F.coalesce(inside, F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, F.col(order) == F.col("_v"), "left").drop("_v")


def negligible(diff: Column, metric: Column, least: dict[str, float], default: float) -> Column:
    """Whether a difference is under what its metric calls a change."""
    bound = F.coalesce(F.create_map(*[F.lit(x) for pair in least.items() for x in pair])[metric], F.lit(default)) if least else F.lit(default)
    return F.abs(diff) < bound


def holm(df: DataFrame, p: str, family: list[str], ids: list[str]) -> DataFrame:
    """Add ``p_holm``: step-down adjusted p within each family; nulls stay null and don't count."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*family, known).orderBy(p, *ids)
    m = F.count("*").over(Window.partitionBy(*family, known))
    ranked = df.withColumn("_step", (m - F.row_number().over(w) + 1) * F.col(p))
    made = ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    return made.withColumn("p_holm", F.when(known, F.col("p_holm"))).drop("_step")


def mean_differences(df: DataFrame, method: str, unit: str, metrics: list[str], comparisons: list[tuple[str, str]]) -> DataFrame:
    """(``a``, ``b``, ``metric``, ``n``, ``mean_a``, ``mean_b``, ``diff``) over the units that both methods have: what :func:`compare` states,
    without its tests and intervals. Methods meet in a row of the unit, so nothing is joined but the literal plan."""
    names = sorted({m for pair in comparisons for m in pair})
    units = df.where(F.col(method).isin(*names)).dropna(subset=[unit]).groupBy(unit).pivot(method, names).agg(*[F.avg(c).alias(c) for c in metrics])
    value = lambda m, c: F.col(f"`{m}_{c}`" if len(metrics) > 1 else f"`{m}`")
    each = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("metric"), value(a, c).alias("va"), value(b, c).alias("vb")) for a, b in comparisons for c in metrics]
    long = units.select(F.explode(F.array(*each)).alias("x")).select("x.*").dropna(subset=["va", "vb"])
    return long.groupBy("a", "b", "metric").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg(F.col("va") - F.col("vb")).alias("diff"))


def compare(df: DataFrame, method: str, unit: str, metrics: dict[str, bool], comparisons: list[tuple[str, str]]) -> DataFrame:
    """A row per comparison and metric: n, means, difference, interval, p, effect size, which is better, Holm-adjusted p.

    ``metrics``: name -> whether higher is better. All comparisons run in one plan. The interval is of 10,000
    resamples.
    """
    long = df.dropna(subset=[method, unit]).groupBy(method, unit).agg(*[F.avg(c).alias(c) for c in metrics]).unpivot([method, unit], list(metrics), "metric", "value").where("value is not null")
    plan = df.sparkSession.createDataFrame([(a, b, m, up) for a, b in comparisons for m, up in metrics.items()], "a string, b string, metric string, higher boolean")
    plan = F.broadcast(plan)
    left = long.select(F.col(method).alias("a"), F.col(unit).alias("unit"), "metric", F.col("value").alias("va"))
    right = long.select(F.col(method).alias("b"), F.col(unit).alias("unit"), "metric", F.col("value").alias("vb"))
    pairs = left.join(plan, ["a", "metric"]).join(right, ["b", "metric", "unit"]).withColumn("d", F.col("va") - F.col("vb"))
    by = ["a", "b", "metric"]
    means = pairs.groupBy(*by, "higher").agg(F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"))
    ranks = signed_rank(pairs, by).select(*by, wilcoxon("w_plus", "w_minus", "n", "ties", "zeros").alias("p"), "r_rb")
    # values that are all equal but for rounding are no difference
    close = pairs.groupBy(*by).agg(F.bool_and(F.abs("d") <= 1e-8 + 1e-5 * F.abs("vb")).alias("_same"))
    ranks = ranks.join(close, by).withColumn("p", F.when(F.col("_same"), 1.0).otherwise(F.col("p"))).drop("_same")
    made = means.join(bootstrap_pcg64(pairs, by, "unit"), by).join(ranks, by)
    made = made.withColumn("better", F.when((F.col("diff") > 0) == F.col("higher"), "a").otherwise("b")).drop("higher")
    return holm(made.withColumn("family", F.lit("primary")), "p", ["family"], by)


def icc2(df: DataFrame, by: list[str], unit: str, rater: str, score: str) -> DataFrame:
    """ICC(2,1) and ICC(2,k) of the units that every rater of the group has scored (repeated scores are averaged)."""
    cells = df.dropna(subset=[unit, rater, score]).groupBy(*by, unit, rater).agg(F.avg(score).alias("x"))
    size = cells.groupBy(*by).agg(F.count_distinct(rater).alias("k"))
    full = cells.groupBy(*by, unit).agg(F.count("*").alias("c")).join(size, by).where("c = k").select(*by, unit, "k")
    cells = cells.join(full, [*by, unit])
    mean = lambda *more: F.avg("x").over(Window.partitionBy(*by, *more))
    cells = cells.withColumns({"g": mean(), "u": mean(unit), "r": mean(rater)})
    sq = lambda e: F.sum(F.pow(e, F.lit(2.0)))
    sums = cells.groupBy(*by).agg(F.max("k").alias("k"), (F.count("*") / F.max("k")).alias("n"), sq(F.col("u") - F.col("g")).alias("ssr"), sq(F.col("r") - F.col("g")).alias("ssc"), sq(F.col("x") - F.col("u") - F.col("r") + F.col("g")).alias("sse"))
    n, k = F.col("n"), F.col("k")
    msr, msc, mse = F.col("ssr") / (n - 1), F.col("ssc") / (k - 1), F.col("sse") / ((n - 1) * (k - 1))
    made = sums.where("n >= 2 and k >= 2")
    return made.select(*by, n.cast("long").alias("n_units"), k.alias("n_raters"), ((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n)).alias("icc_1"), ((msr - mse) / (msr + (msc - mse) / n)).alias("icc_k"))


def repeat_consistency(df: DataFrame, by: list[str], keys: list[str], first: Column, again: Column) -> DataFrame:
    """Mean absolute difference and exact agreement of repeated ratings and the first ones."""
    a = df.where(first).select(*keys, *by, F.col("score").alias("s1"))
    b = df.where(again).select(*keys, *by, F.col("score").alias("s2"))
    both = a.join(b, [*keys, *by])
    return both.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("s1") - F.col("s2"))).alias("mean_abs"), F.avg((F.col("s1") == F.col("s2")).cast("int")).alias("agree"))
