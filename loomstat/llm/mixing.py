"""Mixing sources to target weights by drawn blocks.

The words of a source, its documents in a seeded order, are one stream, packed into blocks of fixed length. Each output
shard draws how many of its slots go to each source; a source's slots, counted over all shards, are mapped through a
pseudorandom permutation of its block indices, a new one each time the blocks have all been used; slots and blocks
meet in a join by index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5.0, 2.0, 1.0)
ROUNDS = 12
#: Slots that are made from one row, and about so many by a task.
PIECE, TASK_SLOTS = 1 << 12, 1 << 16


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: list[int], weights: list[float], most: float) -> list[float]:
    """Shares by weight of the sum of ``sizes``, none over ``most`` times its size; what is over is dealt again by weight."""
    total, full = float(sum(sizes)), set()
    while True:
        rest, w = total - sum(most * sizes[i] for i in full), sum(x for i, x in enumerate(weights) if i not in full)
        out = [most * n if i in full else rest * weights[i] / w for i, n in enumerate(sizes)]
        over = {i for i, n in enumerate(sizes) if i not in full and out[i] > most * n}
        if not over:
            return out
        full |= over


def draw(slots: int, shares: np.ndarray, most: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Counts by shard and source: each shard's are a multinomial draw by what the sources' expected numbers lack after the
    shards before, so that a sum is off its target by the chance of about one shard. No source gets more than ``most`` slots."""
    out, lack = np.zeros((shards, len(shares)), np.int64), slots * shares
    for k in range(shards):
        n, left = slots * (k + 1) // shards - slots * k // shards, np.clip(lack, 0, None)
        if n and left.sum() > 0:
            out[k] = np.random.default_rng([seed, k]).multinomial(n, left / left.sum())
        lack = lack - out[k]
    used = np.minimum(np.cumsum(out, axis=0), most)
    return np.diff(used, axis=0, prepend=0)


def permuted(i: Column, n: Column, *keys: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 given by ``keys``: in each round, an index and its mirror about a keyed point change
    places or don't, as a hash of the pair says."""
    def turn(x: Column, r: Column) -> Column:
        y = F.pmod(F.pmod(F.xxhash64(*keys, r, F.lit("mirror")), n) - x, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(x, y)).bitwiseAND(F.lit(1)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), i, turn)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: float = 3.0, block: int = 32, shards: int = 64, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Two tables: the documents' account, and the mixture's slots.

    Account, one row per row of ``docs``: the id, ``source``, ``size`` (words), ``source_size``, ``target`` of the source
    ``taken``, the words of the document that the mixture holds, repeats counted, at most ``most`` times its size, and
    ``text_xxhash64``.
    Slots: ``shard``, ``source``, ``slot`` (counted within the source), ``block``, an index of ``block`` words of the
    source's stream (the last may have fewer), and ``spans``, what the block holds, in order: ``at``, the document's place in
    the stream, ``id``, ``text_xxhash64``, and its words ``from`` (0-based) up to, but not with, ``to``.

    Sources, by code point and null last, weigh ``weights`` in turn. Null texts have no words. Documents are ordered by
    a hash of id, source, size and text, so reruns agree; repeated rows are documents of their own. A source without words has a
    target of 0. One row for each source, and one for each source and shard, reaches the driver; documents never do.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).isNull().alias("_none"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"), word_count(text_col).alias("size"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t"))
    rows = common.cut(rows.withColumn("_h", F.xxhash64(F.lit(seed), "_id", "_source", "size", "_t")))
    found = sorted((r["_none"], r["_source"], r["n"]) for r in rows.groupBy("_none", "_source").agg(F.sum("size").alias("n")).collect())
    sizes = [n for _, _, n in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most) if sizes else []
    total = sum(sizes)
    limit = np.array([int(most * -(-n // block)) for n in sizes], np.int64)
    counts = draw(round(total / block), np.array(goal) / max(total, 1), limit, shards, seed) if sizes else np.zeros((shards, 0), np.int64)
    facts = spark.createDataFrame([(i, a, b, n, g, -(-n // block)) for i, ((a, b, n), g) in enumerate(zip(found, goal, strict=True))], "_s int, _none boolean, _source string, source_size long, target double, _blocks long")
    first = np.cumsum(counts, axis=0) - counts
    plan = spark.createDataFrame([(k, i, int(first[k, i]), int(counts[k, i])) for k in range(shards) for i in range(len(sizes)) if counts[k, i]], "shard int, _s int, _first long, _n long")
    # long runs of slots are dealt out in pieces before they are made, over a number of tasks that follows their number
    plan = plan.withColumn("_from", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_n") - 1, F.lit(PIECE).cast("long"))))
    plan = plan.repartition(max(1, int(counts.sum()) // TASK_SLOTS))
    plan = plan.withColumn("slot", F.explode(F.sequence("_from", F.least(F.col("_from") + PIECE, F.col("_first") + F.col("_n")) - 1)))
    slots = plan.join(F.broadcast(facts), "_s")
    index = permuted(F.pmod("slot", "_blocks"), F.col("_blocks"), F.lit(seed), F.col("_s"), F.floor(F.col("slot") / F.col("_blocks")))
    slots = slots.select("shard", "_s", "_none", "_source", "slot", index.alias("block"))

    rows = rows.join(F.broadcast(facts), ["_none", "_source"])
    placed = common.running(rows.where("size > 0"), ["_s"], common.hash_bucket("_h", common.bucket_bits(rows.count())), ["_h", "_id", "size", "_t"], F.col("size"), "_at")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))))
    start = F.greatest(F.col("_at"), F.col("block") * block) - F.col("_at")
    stop = F.least(F.col("_at") + F.col("size"), (F.col("block") + 1) * block) - F.col("_at")
    span = F.struct(F.col("_at").alias("at"), F.col("_id").alias("id"), F.col("_t").alias("text_xxhash64"), start.alias("from"), stop.alias("to"))
    # a document in a block has a word there, so a block has at most its length of spans
    blocks = pieces.groupBy("_s", "block").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    slots = slots.join(blocks, ["_s", "block"])
    taken = slots.select("_s", F.explode("spans").alias("_x")).groupBy("_s", F.col("_x.at").alias("_at")).agg(F.sum(F.col("_x.to") - F.col("_x.from")).alias("taken"))
    account = placed.select("_s", "_at", "_id", "_t", "size", "_none", "_source", "source_size", "target").join(taken, ["_s", "_at"], "left")
    empty = rows.where("size = 0").select("_id", "_t", "size", "_none", "_source", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    account = account.select(*empty.columns[:-1], F.coalesce("taken", F.lit(0)).alias("taken")).unionByName(empty)
    source = F.when(~F.col("_none"), F.col("_source")).alias("source")
    return account.select(F.col("_id").alias(id_col), source, "size", "source_size", "target", "taken", F.col("_t").alias("text_xxhash64")), slots.select("shard", source, "slot", "block", "spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    account, _ = mix(common.table(spark, sf_dir, "documents"))
    return account.select("doc_id", "size", "source_size", "target", "taken")


def op8_packed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, slots = mix(common.table(spark, sf_dir, "documents"))
    return slots
