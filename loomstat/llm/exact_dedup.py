"""Exact deduplication by progressive refinement, with DataFrame functions only.

Texts are grouped by length, lengths that repeat by a hash of the first characters, and only what still shares both has
its full content hashed and grouped. A group is never gathered: counts and least ids are combined before each shuffle
and given back over salted keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Keys of the second step that are broadcast at most, about 50 MB in memory; of more a table of bits is, and keys take the shuffled way.
BROADCAST_KEYS = 1_000_000
#: Bits of that table: 64 MB whatever the number of keys, in rows of 32,768.
BITS = 1 << 29


def normalised(text: str | Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hashed(rows: DataFrame, keys: DataFrame, with_hash: bool = False) -> DataFrame:
    """``_id``, ``_t``, ``_len``, ``_prefix`` and ``_sha`` of ``rows``, hashed where length and prefix are one of ``keys``, or share a bit with one:
    of keys n that is a part n / ``BITS`` of the others. The table of bits is all that is broadcast."""
    bit = 1 + F.pmod(F.xxhash64("_len", "_prefix"), F.lit(BITS))
    table = keys.select(bit.alias("_h")).groupBy(F.bitmap_bucket_number("_h").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_h")).alias("_bits"))
    rows = rows.withColumn("_h", bit)
    at = F.bitmap_bit_position("_h")
    rows = rows.join(F.broadcast(table), F.bitmap_bucket_number("_h") == F.col("_bucket"), "left")
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    sha = F.sha2("_text", 256)
    return rows.select("_id", "_t", "_len", "_prefix", F.unhex(sha if with_hash else F.when(may, sha)).alias("_sha"))


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128, with_hash: bool = False) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and ``text_xxhash64``.

    Of equal normalised texts the least id stays; null ids come last. Rows that repeat both id and text count in
    ``group_size``, and each of them is ``kept`` if its id is ``keep_id``. Null texts are empty texts, which are equal
    to each other. A group of rows with null ids only has a null ``keep_id`` and keeps none of them but where it has
    one row. ``text_sha256`` is null for rows that no other row shares a length and prefix with, unless ``with_hash``
    asks to report it for all; ``text_xxhash64`` is of the text as it is. An empty table gives an empty result; other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"), normalised(text_col).alias("_text"))
    prefix = F.xxhash64(F.substring("_text", 1, prefix_chars))
    seen = common.cut(text.select(F.octet_length("_text").alias("_len"), prefix.alias("_prefix")).groupBy("_len", "_prefix").agg(F.count("*").alias("_n")))
    lengths = seen.groupBy("_len").agg(F.sum("_n").alias("_m")).where("_m > 1").select("_len")
    keys = common.cut(seen.join(lengths, "_len", "left_semi").where("_n > 1").select("_len", "_prefix"))
    full = text.withColumns({"_len": F.octet_length("_text"), "_prefix": prefix})
    if keys.count() <= BROADCAST_KEYS:
        full = full.join(F.broadcast(keys.withColumn("_open", F.lit(True))), ["_len", "_prefix"], "left")
        full = full.withColumn("_open", F.coalesce("_open", F.lit(False)))
        sha = F.sha2("_text", 256) if with_hash else F.when(F.col("_open"), F.sha2("_text", 256))
        full = common.cut(full.select("_id", "_t", "_open", F.unhex(sha).alias("_sha")))
    else:  # texts stay where they are read; those that may be open are hashed, and ids, keys and hashes meet the keys over a shuffle
        full = common.cut(hashed(full, keys, with_hash).withColumn("_salt", common.salted("_id", "_t")))
        told = full.select("_len", "_prefix", "_salt").distinct().join(keys.withColumn("_open", F.lit(True)), ["_len", "_prefix"], "left")
        full = full.join(told, ["_len", "_prefix", "_salt"]).withColumn("_open", F.coalesce("_open", F.lit(False)))
        full = common.cut(full.select("_id", "_t", "_open", (F.col("_sha") if with_hash else F.when(F.col("_open"), F.col("_sha"))).alias("_sha")))
    size, least = F.count("*"), F.min("_id")
    groups = common.group_lookup(full.where("_open").select("_id", "_t", "_sha"), ["_sha"], common.salted("_id"), {"keep_id": (least, F.min("_p_keep_id")), "group_size": (size, F.sum("_p_group_size"))})
    alone = full.where("not _open").select("_id", "_t", "_sha", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    both = groups.select(*alone.columns).unionByName(alone)
    kept = F.coalesce(F.col("_id") == F.col("keep_id"), F.col("group_size") == 1)
    return both.select(F.col("_id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), F.col("_t").alias("text_xxhash64"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine(common.table(spark, sf_dir, "documents"), with_hash=True).drop("text_xxhash64")


OP3_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, coalesce(t.doc_id = g.keep_id, g.group_size = 1) AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
