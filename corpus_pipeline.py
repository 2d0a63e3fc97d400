"""From raw documents to token ids: language, exact copies, near copies, mixture, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import bpe, common, exact_dedup, lang_id, mixing, near_dedup

#: Documents whose best language has less of the likelihood than this are rejected, as those without letters are.
MIN_SCORE = 0.5


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in a learned language; null texts and texts without a letter go. Repeated rows go or stay alike; an empty
    table, or one without a language to learn, leaves no rows."""
    common.small_batches(spark)
    told = common.fresh(docs, "_told")
    made = docs.withColumn(told, lang_id.told(spark, lang_id.train(docs), "text"))
    return made.where((F.col(told)["lang_pred"] != lang_id.UNDETERMINED) & (F.col(told)["score"] >= MIN_SCORE)).drop(told)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with the same text, white space runs alike, the one with the least doc_id; of rows that repeat that too, one. Where no
    row of a text has an id, one with the least hash of its text stays."""
    made = exact_dedup.refine(docs)
    told = made.select(F.col("doc_id").alias("id"), F.col("text_xxhash64").alias("t"), "kept")
    nameless = made.where("keep_id is null and not kept").groupBy("text_sha256").agg(F.min("text_xxhash64").alias("t"))
    told = told.unionByName(nameless.select(F.lit(None).cast(told.schema["id"].dataType).alias("id"), "t", F.lit(True).alias("kept")))
    return common.keep_rows(docs, told, "doc_id", "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows connected by links of similarity 0.8 or more on five-word shingles, the one with the least doc_id. Null texts, and texts
    without words, have no links and stay. Rows that repeat id and text are left once; an empty table leaves no rows. Columns of any name
    are kept as they are."""
    made = near_dedup.near_duplicates(docs)
    return common.keep_rows(docs, made.select(F.col("doc_id").alias("id"), F.col("text_xxhash64").alias("t"), "kept"), "doc_id", "text")


#: Parts of one that chances of a further copy are summed in.
PARTS = 1 << 20


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mixture takes its words: the whole times, and once more for a rest. Rests are drawn systematically: in each
    source, in the order of classes of size, one row more is taken wherever the sum of the rests passes a whole number, so a source's
    words are off what the mixture takes by about one document. Null texts, and texts without words, have none to take and go; rows
    that repeat id, text and source are repeated alike."""
    account, _ = mixing.mix(docs)
    own = ["_none", "_source", "_id", "_u"]
    times = account.where("taken > 0").select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), F.col("doc_id").alias("_id"), F.col("text_xxhash64").alias("_u"), "size", "taken")
    times = times.groupBy(*own).agg(F.max("size").alias("size"), (F.sum("taken") / F.sum("size")).alias("x"))
    times = times.withColumns({"_h": F.xxhash64(F.lit("copies"), *own), "_class": F.floor(4 * F.log2("size")).cast("int"), "_rest": F.floor((F.col("x") - F.floor("x")) * PARTS).cast("long")})
    times = common.cut(times)
    bits = common.bucket_bits(times.count(), 100_000)
    place = F.col("_class").cast("long") * (1 << bits) + common.hash_bucket("_h", bits) + (1 << (bits - 1))  # in the order of class and hash
    times = common.running(times, ["_none", "_source"], place, ["_class", "_h", "_id", "_u"], F.col("_rest"), "_sum")
    passed = lambda upto: F.floor((upto + PARTS // 2) / PARTS)
    n = F.floor("x") + passed(F.col("_sum") + F.col("_rest")) - passed(F.col("_sum"))
    key, times_n, copy = (common.fresh(docs, c) for c in ("_t", "_times", "_copy"))
    times = times.select(*own, n.cast("int").alias(times_n)).where(F.col(times_n) > 0)
    rows = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    source = F.coalesce(rows["source"].cast("string"), F.lit(""))
    same = rows["doc_id"].eqNullSafe(times["_id"]) & (rows[key] == times["_u"]) & (rows["source"].isNull() == times["_none"]) & (source == times["_source"])
    made = rows.join(times, same).select(*[rows[c] for c in docs.columns], times[times_n])
    return made.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times_n)))).drop(copy, times_n)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding the ids gives the text back. A null text is empty and has no ids. Rows that repeat are encoded
    alike, each once; an empty table gives an empty result; other columns, of any name, aren't read."""
    return bpe.pack_texts(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage makes of the documents. Tables that a stage wrote on its way go when its result is written."""
    docs, before = common.table(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = common.cut(docs)
            common.sweep(spark, before, 1)
    return docs
