"""Aggregations over measurement tables: one row per measured output, keyed by method and unit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def two_stage_mean(df: DataFrame, method: str, unit: str, measures: list[str]) -> DataFrame:
    """Mean of the units' means, by method, and the number of units. Null keys are left out, null measures skipped."""
    units = df.where(F.col(method).isNotNull() & F.col(unit).isNotNull()).groupBy(method, unit).agg(*[F.avg(c).alias(c) for c in measures])
    return units.groupBy(method).agg(F.count("*").alias("n_units"), *[F.avg(c).alias(c) for c in measures])


def unit_means(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return df.dropna(subset=keys).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in measures])


def null_out(df: DataFrame, when: Column, columns: list[str]) -> DataFrame:
    """Null ``columns`` where ``when`` holds; a null condition leaves them."""
    return df.withColumns({c: F.when(F.coalesce(when, F.lit(False)), F.lit(None)).otherwise(F.col(c)) for c in columns})


def covered(c: Column, least: float = 0.5) -> Column:
    """The mean if at least this share of the group's rows has a value, else null."""
    return F.when(F.count(c) >= least * F.count(F.lit(1)), F.avg(c))


def share_where(p: Column) -> Column:
    return F.avg(p.cast("int"))


def describe_long(df: DataFrame, by: list[str], columns: list[str], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column, one row per group and column. Null groups are left out."""
    long = df.dropna(subset=by).unpivot(by, columns, "column", "value")
    made = long.groupBy(*by, "column").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    made = made.join(quantiles(long, [*by, "column"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, cut), [*by, "column"], "left")
    return made.select(*by, "column", "n", "mean", "std", "min", "q25", "median", "q75", "max")


#: Groups whose bounds are broadcast at most; more are joined by a shuffle.
BROADCAST_GROUPS = 10_000


#: Groups with more different values than this, estimated, are dealt by range; of others (some 20 MB each) a task counts each value, for up to 128
#: groups at a time.
COUNTED = 250_000


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], cut: Callable[[DataFrame], DataFrame], bins: int = 32) -> DataFrame:
    """By group, a column for each name in ``at``: that exact quantile of ``value``, by linear interpolation. Groups with many different values go by
    :func:`ranged_quantiles`, others by ``percentile``, which counts values before and behind one shuffle. Nulls are skipped; rows with a
    null key, and groups without a value, are left out."""
    rows = df.dropna(subset=[*by, value])
    large = cut(rows.groupBy(*by).agg(F.approx_count_distinct(value, 0.02).alias("_d")).where(F.col("_d") > COUNTED).select(*by))
    n = large.count()
    listed = F.broadcast(large) if n <= BROADCAST_GROUPS else large
    few = rows.join(listed, by, "left_anti") if n else rows
    made = few.groupBy(*by).agg(F.percentile(value, F.array(*[F.lit(float(q)) for q in at.values()])).alias("_q"))
    made = made.select(*by, *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(at)])
    return made.unionByName(ranged_quantiles(rows.join(listed, by, "left_semi"), by, value, at, cut, bins)) if n else made


def ranged_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], cut: Callable[[DataFrame], DataFrame], bins: int = 32) -> DataFrame:
    """As :func:`quantiles`, for groups of any size.

    No group is held in one task: values are counted, then dealt by bounds (approximate quantiles of the distinct values;
    the result is exact whatever they are) into ``bins`` ranges. Sums over ranges tell which of them hold a wanted rank,
    and only these are sorted. Nulls are skipped; rows with a null key, and groups without a value, are left out. ``cut``
    writes a table and reads it.
    """
    counts = cut(df.dropna(subset=[*by, value]).groupBy(*by, value).agg(F.count("*").alias("_n")))
    steps = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    bounds = cut(counts.groupBy(*by).agg(F.percentile_approx(value, steps, F.lit(1000)).alias("_b")))
    few = bounds.count() <= BROADCAST_GROUPS
    rows = counts.join(F.broadcast(bounds) if few else bounds, by)
    past = sum(((F.col(value) > F.get("_b", F.lit(i))).cast("int") for i in range(bins - 1)), F.lit(0))  # the approximation may give fewer bounds
    rows = rows.withColumn("_bin", F.coalesce(past, F.lit(0))).drop("_b")
    group = Window.partitionBy(*by)
    sums = rows.groupBy(*by, "_bin").agg(F.sum("_n").alias("_s"))
    before = F.coalesce(F.sum("_s").over(group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_bin", "_s", before.alias("_before"), F.sum("_s").over(group).alias("_all"))
    place = {n: (F.col("_all") - 1) * F.lit(float(q)) for n, q in at.items()}
    ranks = {f"_{end}_{n}": f(x) for n, x in place.items() for end, f in (("lo", F.floor), ("hi", F.ceil))}
    wanted = [(F.col("_before") <= r) & (r < F.col("_before") + F.col("_s")) for r in ranks.values()]
    sums = sums.where(F.greatest(*wanted)).drop("_s")
    rows = rows.join(F.broadcast(sums) if few else sums, [*by, "_bin"])
    inside = Window.partitionBy(*by, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_from", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    found = [F.max(F.when((F.col("_from") <= r) & (r < F.col("_from") + F.col("_n")), F.col(value))).alias(n) for n, r in ranks.items()]
    made = rows.groupBy(*by).agg(F.max("_all").alias("_all"), *found)
    return made.select(*by, *[(F.col(f"_lo_{n}") + (x - F.floor(x)) * (F.col(f"_hi_{n}") - F.col(f"_lo_{n}"))).alias(n) for n, x in place.items()])


def medians(df: DataFrame, by: str) -> DataFrame:
    """The median of every numeric column by group."""
    return df.groupBy(by).agg(*[F.median(c).alias(c) for c in numeric(df, [by])])


def only(df: DataFrame, column: str, names: str) -> DataFrame:
    """Rows whose ``column`` is in a list given as ``a+b+c``; all rows for an empty one."""
    return df.where(F.col(column).isin(names.split("+"))) if names else df


def prefixed(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    """All columns but ``keys`` renamed with ``prefix``."""
    return df.select(*[F.col(c) if c in keys else F.col(c).alias(prefix + c) for c in df.columns])


def with_stage(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the columns of a later stage, joined by ``key``; columns of that name that it had are replaced."""
    return old.drop(*[c for c in new.columns if c != key]).join(new, key, "left")


def pair_key(df: DataFrame, group: list[str], style: str, seed: str) -> DataFrame:
    """Add ``pair``: the style where any row of the group has one, else the seed."""
    any_style = F.max(F.col(style).isNotNull()).over(Window.partitionBy(*group))
    return df.withColumn("pair", F.when(any_style, F.col(style).cast("string")).otherwise(F.col(seed).cast("string")))


def numeric(df: DataFrame, but: list[str]) -> list[str]:
    """Names of numeric columns, but those given."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in but]


def transposed(df: DataFrame, key: str, columns: list[str], names: list[str]) -> DataFrame:
    """A row for each of ``columns``, a column for each of the known ``names`` of ``key``."""
    return df.unpivot([key], columns, "column", "value").groupBy("column").pivot(key, names).agg(F.first("value"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` whose key isn't in ``new``, and ``new``. Columns that one side lacks are null there."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def sheets(pixels: DataFrame, ground: int, least: float) -> DataFrame:
    """(``img``, ``label``, ``n``, ``share``, ``sheet``) of pixel rows with ``label`` and its ``light``: the labels but for ``ground`` that cover more than
    ``least`` of a picture, their share of all that isn't ground, and their number from the darkest on."""
    n = pixels.groupBy("img", "label").agg(F.count("*").alias("n"), F.min("light").alias("light"))  # a row for each colour of a picture
    all_ = Window.partitionBy("img")
    n = n.withColumns({"_all": F.sum("n").over(all_), "_figure": F.sum(F.when(F.col("label") != ground, F.col("n")).otherwise(0)).over(all_)})
    n = n.where((F.col("label") != ground) & (F.col("n") > least * F.col("_all")))
    return n.select("img", "label", "n", (F.col("n") / F.col("_figure")).alias("share"), F.row_number().over(all_.orderBy("light", "label")).alias("sheet"))


def presence(df: DataFrame) -> DataFrame:
    """(``column``, ``n``, ``present``): how many values each column has, and whether there are any."""
    n = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n"), (F.col(c) > 0).alias("present")) for c in df.columns])))
