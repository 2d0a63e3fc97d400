"""Selection, ordering and layout: picks, forms, codes, rolling values, control breaks, report text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def constrained_best(df: DataFrame, by: list[str], ok: Column, cost: str, gain: str, ident: str) -> DataFrame:
    """By group the row of least ``cost`` among those that are ``ok``; where none is, the one of most ``gain``. Ties to the least id."""
    first = F.min(F.when(ok, F.struct(F.col(cost), F.col(ident))))
    other = F.min(F.struct((-F.col(gain)), F.col(ident)))
    return df.groupBy(*by).agg(F.coalesce(first[ident], other[ident]).alias(ident), first.isNotNull().alias("eligible"))


def quantile_picks(df: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """Rows at ``k`` evenly spaced places of each sorted group, first and last included (places rounded half to even)."""
    w = Window.partitionBy(*by)
    rows = df.withColumns({"_at": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * (F.col("_n") - 1) / F.lit(float(max(k - 1, 1)))).cast("int"))
    return rows.where(F.array_contains(places, F.col("_at"))).drop("_at", "_n")


def hash_sample(df: DataFrame, by: list[str], key: Column, n: int, tie: list[str]) -> DataFrame:
    """At most ``n`` rows of each group, those whose key comes first."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(key, *tie))).where(F.col("_r") <= n).drop("_r")


def alternating(df: DataFrame, by: list[str], order: list[str], ways: int = 2) -> DataFrame:
    return df.withColumn("form", ((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) % ways).cast("int"))


def codes(df: DataFrame, by: list[str], key: Column, tie: list[str], prefix: str = "S", width: int = 3) -> DataFrame:
    return df.withColumn("code", F.concat(F.lit(prefix), F.lpad(F.row_number().over(Window.partitionBy(*by).orderBy(key, *tie)).cast("string"), width, "0")))


def trailing_mean(df: DataFrame, by: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    return df.withColumn("trailing", F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)))


def control_break(df: DataFrame, by: list[str], order: list[str], shown: str) -> DataFrame:
    """Add ``<shown>_shown``, blank where the row before has the same value, and ``rule``, whether a line goes above."""
    before = F.lag(shown).over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({f"{shown}_shown": F.when(before.eqNullSafe(F.col(shown)), "").otherwise(F.col(shown)), "rule": before.isNotNull() & ~before.eqNullSafe(F.col(shown))})


def offsets_of_shares(df: DataFrame, by: list[str], order: list[str], share: str) -> DataFrame:
    """Add ``start``: the sum of the shares before, for stacked bars."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(share).over(w), F.lit(0.0)))


def display_rows(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumns({"line": F.floor(at / n).cast("int"), "place": (at % n).cast("int")})


def padded_rows(df: DataFrame, by: list[str], order: list[str], n: int, value: str) -> DataFrame:
    """(``by``, ``line``, ``place``, ``value``): display rows of ``n`` places, the last filled up with nulls."""
    at = display_rows(df, by, order, n)
    lines = at.groupBy(*by).agg(F.max("line").alias("_last")).select(*by, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("line"))
    cells = lines.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return cells.join(at.select(*by, "line", "place", value), [*by, "line", "place"], "left")


def rater_order(raters: DataFrame, rater: str, items: DataFrame, item: str, again: str, key: Callable[..., Column]) -> DataFrame:
    """(rater, item, ``repeat``, ``place``): each rater's own order of the items, hash-drawn, with those that are asked ``again``
    repeated at hash-drawn places in the last third. ``items`` are a study's few dozens."""
    each = raters.select(rater).join(F.broadcast(items.select(item, again)))  # every rater sees every item
    w = Window.partitionBy(rater)
    drawn = each.withColumns({"_at": F.row_number().over(w.orderBy(key(F.col(rater), F.col(item), F.lit(1)), item)) - 1, "_n": F.count("*").over(w)})
    low = F.floor(F.col("_n") * 2 / 3)
    spot = low + F.pmod(key(F.col(rater), F.col(item), F.lit(2)), F.col("_n") - low + 1)
    first = drawn.select(rater, item, F.lit(False).alias("repeat"), F.col("_at").cast("double").alias("_p"))
    second = drawn.where(again).select(rater, item, F.lit(True).alias("repeat"), (spot - 0.5).cast("double").alias("_p"))
    place = F.row_number().over(w.orderBy("_p", "repeat", item)) - 1
    return first.unionByName(second).withColumn("place", place).drop("_p")


def phase(df: DataFrame, step: str, of: str, start: float, stop: float) -> DataFrame:
    """Rows whose step, as a share of all, is from ``start`` up to ``stop``."""
    share = F.col(step) / F.col(of)
    return df.where((share >= start) & (share < stop))


def stacked(df: DataFrame, keys: list[str], runs: str, name: str) -> DataFrame:
    """A row for each element of each series in a map from ``name`` to an array of structs."""
    return df.select(*keys, F.explode(runs).alias(name, "_s")).select(*keys, name, F.inline("_s"))


def above_or_best(df: DataFrame, by: str, ident: str, score: str, least: float) -> DataFrame:
    """All rows over ``least``; of a group without any, its best (ties to the least id)."""
    w = Window.partitionBy(by)
    rows = df.withColumns({"_top": F.max(score).over(w), "_r": F.row_number().over(w.orderBy(F.desc(score), ident))})
    return rows.where((F.col(score) > least) | ((F.col("_top") <= least) & (F.col("_r") == 1))).drop("_top", "_r")


def table_row(cells: list[Column], sep: str = " & ", end: str = r" \\") -> Column:
    return F.concat(F.concat_ws(sep, *cells), F.lit(end))


def markdown_head(names: list[str]) -> list[str]:
    return ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]


def markdown_row(cells: list[Column]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
