"""File manifests: build, verify, summarise; chunk and restore contents with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import under_root


def build(files: DataFrame) -> DataFrame:
    """(``path``, ``bytes``, ``sha256``) of files (``path``, ``content``)."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(``path``, ``status``) of each listed file: unsafe, missing, mismatch or ok."""
    found = files.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_s"))
    same = F.col("bytes").eqNullSafe(F.col("_b")) & F.col("sha256").eqNullSafe(F.col("_s"))
    status = F.when(~under_root(F.col("path")), "unsafe").when(F.col("_s").isNull(), "missing").when(~same, "mismatch").otherwise("ok")
    return manifest.join(found, "path", "left").select("path", status.alias("status"))


def summary(manifest: DataFrame, category: Column) -> DataFrame:
    return manifest.groupBy(category.alias("category")).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def split(files: DataFrame, size: int) -> DataFrame:
    """Parts of at most ``size`` bytes: (``path``, ``part``, ``data``, ``part_sha256``, ``sha256``). An empty file has one empty part."""
    last = F.greatest(F.ceil(F.octet_length("content") / size), F.lit(1)).cast("int")
    parts = files.withColumn("sha256", F.sha2("content", 256)).withColumn("part", F.explode(F.sequence(F.lit(0), last - 1)))
    data = F.substring(F.col("content"), F.col("part") * size + 1, F.lit(size))
    return parts.select("path", "part", data.alias("data"), F.sha2(data, 256).alias("part_sha256"), "sha256")


def restore(parts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(``path``, ``content``, ``status``): refused (unsafe path, or another content in ``existing``), corrupt, present
    (there already, and equal), or ok; contents of ok files only."""
    good = F.bool_and(F.sha2("data", 256) == F.col("part_sha256")).alias("_good")
    whole = parts.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("part", "data"))).alias("_p"), good, F.min("sha256").alias("sha256"))
    content = F.unhex(F.array_join(F.transform("_p", lambda x: F.hex(x.data)), ""))
    whole = whole.withColumn("content", content)
    there = F.lit(False)
    if existing is not None:
        whole = whole.join(existing.select("path", F.sha2("content", 256).alias("_there")), "path", "left")
        there = F.col("_there").isNotNull()
    other = there & (F.col("_there") != F.col("sha256")) if existing is not None else F.lit(False)
    status = F.when(~under_root(F.col("path")) | other, "refused").when(~F.col("_good") | (F.sha2("content", 256) != F.col("sha256")), "corrupt").when(there, "present").otherwise("ok")
    return whole.withColumn("status", status).select("path", F.when(F.col("status") == "ok", F.col("content")).alias("content"), "status")
