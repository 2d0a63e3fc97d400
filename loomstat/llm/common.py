"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Salts that a join key is dealt over, so that a key with a third of all rows stays divisible.
SALTS = 64


#: Folders that :func:`cut` has written in this process.
_WRITTEN: list[str] = []


def folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, ``spark.checkpoint.dir``. Only a session on one machine may leave it out; tables are then in its
    warehouse. A cluster's executors couldn't read what is written there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared :func:`folder`, and read again.

    This cuts the lineage, survives lost executors, and gives later plans the true size (a checkpoint keeps estimates, whose
    products grow without bound over the rounds of a loop). :func:`sweep` deletes what was written.
    """
    path = f"{folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables :func:`cut` has written, for :func:`sweep`."""
    return len(_WRITTEN)


def sweep(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete what :func:`cut` wrote after the first ``since`` tables, but for the ``last`` ones: for results that are no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    upto = len(_WRITTEN) - last
    for path in _WRITTEN[since:upto]:
        path = jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(conf).delete(path, True)
    del _WRITTEN[since:upto]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most ``rows`` rows, so that very long texts don't gather in a Python worker.

    A batch is also held to 16 MB where the session has not set a lower bound.
    """
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    if not _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{16 << 20}b")


def _bytes(size: str) -> float:
    n, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", size.strip().lower()).groups()
    return int(n) * 1024 ** "bkmgtp".index((unit or "b")[0]) if int(n) > 0 else float("inf")


def salted(*cols: str | Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def group_lookup(rows: DataFrame, keys: list[str], salt: Column, aggs: dict[str, tuple[Column, Column]], having: str = "true") -> DataFrame:
    """Aggregate ``rows`` by ``keys`` and give each row its group's values, without gathering a group in one task.

    ``aggs``: name -> (aggregate over rows, the same over partial results, where ``_p_<name>`` is the partial).
    Partial results are kept by key and salt; each of those at most ``SALTS`` rows of a key gets the key's total, and
    rows join on key and salt. Keys must not be null. Rows of groups that fail ``having`` go.
    """
    rows = rows.withColumn("_salt", salt)
    part = rows.groupBy(*keys, "_salt").agg(*[a.alias(f"_p_{n}") for n, (a, _) in aggs.items()])
    total = part.groupBy(*keys).agg(*[b.alias(n) for n, (_, b) in aggs.items()]).where(having)
    told = part.select(*keys, "_salt").join(total, keys)
    return rows.join(told, [*keys, "_salt"]).drop("_salt")


def tell(rows: DataFrame, keys: list[str], salt: Column, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row for some of the keys; other rows go.

    As in :func:`group_lookup`, facts are given back over salted keys, so that no task gets a whole group. Keys must not be null.
    """
    rows = rows.withColumn("_salt", salt)
    told = rows.select(*keys, "_salt").distinct().join(facts, keys)
    return rows.join(told, [*keys, "_salt"]).drop("_salt")


def running(rows: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``, the sum of ``value`` over the rows of the same ``by`` that come before, and ``<name>_all`` over all.

    ``bucket``, of a bounded number of values, must not contradict ``order``. Sums by bucket are few; rows meet only
    within their bucket, so a group with a third of all rows is spread over many tasks. ``by`` must not be null.
    """
    rows = rows.withColumns({"_bucket": bucket, "_value": value})
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by, "_bucket").agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*by, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), F.sum("_sum").over(Window.partitionBy(*by)).alias(f"{name}_all"))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    made = rows.join(sums, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return made.drop("_bucket", "_value", "_before")


def bucket_bits(rows: int, each: int = 10_000) -> int:
    """For :func:`hash_bucket`, so that a bucket has about ``each`` of ``rows`` rows at most, whatever their number."""
    return min(max((rows // each).bit_length(), 4), 30)


def hash_bucket(h: str, bits: int = 10, width: int = 64) -> Column:
    """The upper bits of a hash of ``width`` bits: in its order, and even."""
    return F.shiftright(h, width - bits).cast("int")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of a drop list that are broadcast at most, about 100 MB in memory; more are joined by a shuffle.
BROADCAST_DROPS = 500_000


def keep_rows(docs: DataFrame, decisions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``decisions`` (``id``, ``t``, ``kept``) don't drop; ``t`` is xxhash64 of the text, null as empty.

    Rows that repeat both id and text and are kept are left once.
    """
    key = fresh(docs, "_t")
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    by = decisions.groupBy(F.col("id").alias("_id"), F.col("t").alias("_u")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    by = cut(by.where("n > 1 or not kept"))

    def match(other: DataFrame):
        return rows[id_col].eqNullSafe(other["_id"]) & (rows[key] == other["_u"])

    listed = by.select("_id", "_u")
    if listed.count() <= BROADCAST_DROPS:
        listed = F.broadcast(listed)
    out = rows.join(listed, match(listed), "left_anti")
    twins = by.where("kept").select("_id", "_u")
    if not twins.isEmpty():
        out = out.unionByName(rows.join(twins, match(twins), "left_semi").dropDuplicates([id_col, key]))
    return out.drop(key)


def let(value: Column, body) -> Column:
    """``body`` of a variable that holds ``value``: evaluated once, where a lambda would evaluate an inlined column for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
