"""Structured Streaming: file-source runs that drain what is there, windows, and keyed state."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


#: Folders that :func:`scratch` has named in this process.
_NAMED: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that the cluster shares, ``spark.checkpoint.dir``. Only a session on one machine may leave that out; the folder is
    then in its warehouse. :func:`sweep` deletes them."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if shared is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch")
    _NAMED.append(f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}")
    return _NAMED[-1]


def sweep(spark: SparkSession) -> None:
    """Delete the folders of results that are no longer read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _NAMED:
        path = jvm.org.apache.hadoop.fs.Path(_NAMED.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream(spark: SparkSession, folder: str, name: str, time: str) -> DataFrame:
    """The table as a stream of files, with ``time`` as a timestamp, so that watermarks apply."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*").withColumn(time, F.col(time).cast("timestamp"))


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all input that is there now, once, in a new folder, and read the result. :func:`watch` resumes."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out")
        query = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def watch(df: DataFrame, out: str, state: str) -> DataFrame:
    """Append what the stream makes of input that came since the last run to ``out``; ``state`` remembers which input was done, so
    each file is scored once, also after a stop in between."""
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def last_row(spark: SparkSession, schema: StructType, time: str) -> DataFrame:
    """A row far in the future (pandas holds no time after 2262), null but for its time: it moves the watermark past all others, and never closes itself."""
    return spark.range(1).select(*[(F.lit("2250-01-01 00:00:00") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def closed(spark: SparkSession, folder: str, name: str, time: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` appends for a table as a stream of files with a watermark, to the end: state goes as the watermark passes it, each result is
    written once, and a last row, in a run that resumes the first, closes what is open."""
    path, schema = scratch(spark), spark.read.parquet(f"{folder}/{name}.parquet").schema
    end = last_row(spark, schema, time)
    end.limit(0).write.parquet(f"{path}/last")

    def run() -> DataFrame:
        ends = spark.readStream.schema(schema).parquet(f"{path}/last").withColumn(time, F.col(time).cast("timestamp"))
        return watch(make(stream(spark, folder, name, time).unionByName(ends)), f"{path}/out", f"{path}/state")

    run()
    end.write.mode("append").parquet(f"{path}/last")
    return run()


def stepwise(parts: list[DataFrame], time: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` appends for a log that grows by ``parts``, with a restart after each, and is closed by a last row."""
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = scratch(spark)
    for part in [*parts, last_row(spark, schema, time)]:
        part.write.mode("append").parquet(f"{path}/log")
        log = spark.readStream.schema(schema).parquet(f"{path}/log").withColumn(time, F.col(time).cast("timestamp"))
        made = watch(make(log), f"{path}/out", f"{path}/state")
    return made


def missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do of a batch: the wanted rows whose key isn't among the done ones."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def jobs(work: dict[str, Callable[[], None]], done: Callable[[str], bool], workers: int = 2) -> dict[str, str]:
    """Run the jobs that aren't ``done``, ``workers`` at a time, and tell of each: skipped, ok, or its error. One that fails stops no other."""
    def run(name: str) -> str:
        if done(name):
            return "skipped"
        try:
            work[name]()
        except Exception as e:  # told, not raised: the others go on
            return f"{type(e).__name__}: {e}"
        return "ok"

    with ThreadPoolExecutor(workers) as pool:
        return dict(zip(work, pool.map(run, work), strict=True))


def once(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of events with equal ``keys`` that come within ``late`` of each other."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, time: str, size: str, slide: str | None, by: list[str], aggs: list, late: str = "1 hour") -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    made = events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(*aggs)
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in made.columns if c != "w"])


def sessions(events: DataFrame, time: str, gap: str, by: list[str], aggs: list, late: str = "1 hour") -> DataFrame:
    made = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(*aggs)
    return made.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in made.columns if c != "w"])


def dwell(visits: DataFrame, keys: list[str], seconds: str, score: str, time: str, tie: str) -> DataFrame:
    """By key: seconds summed over visits, the latest score, and the number of visits. Works on batches and on streams."""
    return visits.groupBy(*keys).agg(F.sum(seconds).alias("dwell"), F.max(F.struct(F.col(time), F.col(tie), F.col(score)))[score].alias("score"), F.count("*").alias("visits"))


def dwell_state(visits: DataFrame, keys: list[str], seconds: str, score: str, time: str, tie: str, idle: int, late: str = "1 hour") -> DataFrame:
    """As :func:`dwell`, on a stream: a row for each period of a key's visits without a gap of over ``idle`` seconds, with ``until``, its last visit.
    Periods are session windows, so that no group of rows goes through Python; their state goes when the watermark passes them."""
    period = F.session_window(time, f"{idle} seconds 1 microsecond").alias("_period")  # windows don't hold their end
    last = F.max(F.struct(F.col(time).alias("_at"), F.col(tie).alias("_tie"), F.col(score).cast("double").alias("_score")))
    made = visits.withWatermark(time, late).groupBy(*keys, period).agg(F.sum(F.col(seconds).cast("double")).alias("dwell"), last.alias("_last"), F.count("*").alias("visits"))
    return made.select(*keys, "dwell", F.col("_last._score").alias("score"), "visits", F.col("_last._at").alias("until"))


def trailing_reports(log: DataFrame, run: str, value: str, time: str, tie: str, every: int, over: int) -> DataFrame:
    """(``run``, ``step``, ``mean``): at each ``every``-th row of a run, in the order of ``time`` and ``tie``, the mean of its last ``over`` values, on a
    stream whose state is these values and the number of rows. Rows must not come before ones that an earlier batch has held."""
    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, held = state.get if state.exists else (0, [])
        rows = pd.concat(list(frames)).sort_values([time, tie])
        values, out = [*held, *rows[value].astype(float)], []
        for i in range(len(held), len(values)):
            n += 1
            if n % every == 0:
                last = values[max(i + 1 - over, 0) : i + 1]
                out.append((*key, n, sum(last) / len(last)))
        state.update((n, values[-over:]))
        if out:
            yield pd.DataFrame(out, columns=[run, "step", "mean"])

    return log.groupBy(run).applyInPandasWithState(each, f"{run} {dict(log.dtypes)[run]}, step long, mean double", "n long, held array<double>", "append", GroupStateTimeout.NoTimeout)
