"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; a row's fractional rank is its place in the source
from 0 to 1. In the order of fractional ranks every stretch holds the sources in proportion, so equal cuts of it are
shards that match the mixture. Ranks come from sums by bucket, so no source is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of the shuffle's hash, the first of an MD5, which SQL can repeat.
HASH_BITS = 60


def interleave(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> DataFrame:
    """One row per row: its id, ``source``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard``, ``slot``.

    Shards hold numbers of rows that differ by one at most; slots count from 0 in each. Null texts are empty, and a
    null source is a source of its own. Rows with equal texts are rows like others: each has its own place, so a group of
    copies is spread over the shards as its sources are. Rows alike in id, text and source may change places with each other only. An
    empty table gives an empty result; with fewer rows than shards, some shards are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"),
        (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    own = F.concat_ws("-", F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit("")), "text_crc32", "size")
    rows = common.cut(rows.withColumn("_h", F.conv(F.substring(F.md5(own.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")))
    tie = ["_h", "_id", "text_crc32", "size"]
    bits = common.bucket_bits(rows.count())
    ranked = common.running(rows, ["_none", "_source"], common.hash_bucket("_h", bits, HASH_BITS), tie, F.lit(1).cast("long"), "_rank")
    ranked = ranked.withColumn("_part", (F.col("_rank") + 0.5) / F.col("_rank_all"))
    # one sum for some 10,000 rows: their window is one small task
    placed = common.running(ranked.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_part") * (1 << bits)).cast("int"), ["_part", "_none", "_source", *tie], F.lit(1).cast("long"), "_at")
    n = F.col("_at_all")
    placed = placed.withColumn("shard", F.expr(f"cast(_at * {shards} div _at_all as int)"))
    first = F.expr(f"(shard * _at_all + {shards - 1}) div {shards}")
    return placed.select(F.col("_id").alias(id_col), F.when(~F.col("_none"), F.col("_source")).alias("source"), "size", "text_crc32", "shard", (F.col("_at") - first).cast("long").alias("slot")).where(n > 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = interleave(common.table(spark, sf_dir, "documents"), shards=24)
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The CRC is the common one of 32 bits, byte by byte, from a table made by its rule.
OP10_SQL = r"""
WITH RECURSIVE b AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM b WHERE k < 8),
c AS (SELECT list(v ORDER BY i) AS tab FROM b WHERE k = 8),
d AS (SELECT doc_id, source IS NULL AS none, coalesce(source, '') AS source, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS t FROM documents),
s AS (SELECT doc_id, none, source, len(t) + 8 AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, t), lambda a, x: xor(a >> 8, tab[xor(a & 255, x) + 1])), 4294967295) AS text_crc32 FROM d, c),
h AS (SELECT *, ('0x' || substr(md5(concat_ws('-', 1, coalesce(doc_id::VARCHAR, ''), text_crc32, size)), 1, 15))::BIGINT AS h FROM s),
f AS (SELECT *, (row_number() OVER (PARTITION BY none, source ORDER BY h, doc_id, text_crc32, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY none, source) AS part FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY part, none, source, h, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM f),
q AS (SELECT *, place * 24 // n AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INT AS grown_shard FROM q
"""
