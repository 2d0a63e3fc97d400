"""Vectors as short codes: each is cut into equal parts, and a part is replaced by the number of the nearest entry of its codebook.

Rows are packed once into blocks of whole numbers, one array a component, and written as a table. Each round of learning is a
``treeAggregate`` over the blocks: squared distances to all entries add up component by component, ``np.add.at`` sums and
counts the parts by entry as 64-bit integers, and a reduction tree merges these tensors, whose size no table changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Components are multiplied by this and rounded down.
SCALE = 1024
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors of a block, and those whose distances are held at once.
BLOCK, AT_ONCE = 4096, 1024
#: Components of larger size would let sums of squares pass 64 bits.
LARGEST = 1 << 27


def whole(vectors: np.ndarray) -> np.ndarray:
    """``vectors`` (rows of numbers) as whole numbers, a row for each component; an error where sums of squares may pass 64 bits."""
    scaled = np.floor(vectors.T.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // SCALE} in size can't be summed exactly")
    return np.ascontiguousarray(scaled.astype(np.int32))


def nearest(block: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a part of each vector (``block``: components by vectors) its entry of ``book`` (entries by components), the first of
    the nearest, and the squared distance."""
    width, n = block.shape
    code, error = np.empty(n, np.int64), np.empty(n, np.int64)
    most = max((int(np.abs(x).max()) for x in (block, book) if x.size), default=0)
    kind = np.int32 if width * (2 * most) ** 2 < 1 << 31 else np.int64  # squares of these rows fit
    block, book = block.astype(kind), book.astype(kind)
    for a in range(0, n, AT_ONCE):
        part = block[:, a : a + AT_ONCE]
        far = np.zeros((part.shape[1], len(book)), kind)
        for x, c in zip(part, book.T, strict=True):
            off = x[:, None] - c[None, :]
            off *= off
            far += off
        code[a : a + AT_ONCE] = far.argmin(1)
        error[a : a + AT_ONCE] = far.min(1)
    return code, error


def tally(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``total`` (sums of parts and their counts by part and entry) with the vectors of a block added."""
    sums, counts = total
    width = books.shape[2]
    for p, book in enumerate(books):
        part = block[p * width : (p + 1) * width]
        code, _ = nearest(part, book)
        np.add.at(sums[p], code, part.T)
        np.add.at(counts[p], code, 1)
    return sums, counts


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows of ``_id``, ``_label`` and ``_v`` (doubles), without null and empty vectors and those with a null or non-finite component."""
    rows = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vector_col).cast("array<double>").alias("_v"))
    return rows.where((F.size("_v") > 0) & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def packed(rows: DataFrame, dim: int) -> DataFrame:
    """Blocks of the vectors of ``rows``: ``n`` and ``cells``, the whole numbers of up to ``BLOCK`` vectors, component after component."""

    def block(held: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(held, 1)
        return pa.RecordBatch.from_pydict({"n": pa.array([cells.shape[1]], pa.int64()), "cells": pa.array([cells.tobytes()], pa.binary())})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            made = whole(np.asarray(b.column(0).flatten()).reshape(-1, dim))
            for a in range(0, made.shape[1], BLOCK):
                piece = made[:, a : a + BLOCK]
                if n + piece.shape[1] > BLOCK:
                    yield block(held)
                    held, n = [], 0
                held.append(piece)
                n += piece.shape[1]
        if n:
            yield block(held)

    return rows.select("_v").mapInArrow(pack, "n long, cells binary")


def learn(rows: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """``books`` (parts by entries by components) after some rounds over ``rows``, in each of which an entry becomes the mean, rounded down,
    of the parts that it is nearest to, the lower of equally near ones; entries without parts stay."""
    context, dim = rows.sparkSession.sparkContext, books.shape[0] * books.shape[2]
    blocks = common.cut(packed(rows, dim)).rdd.map(lambda r: np.frombuffer(r["cells"], np.int32).reshape(dim, r["n"]))
    for _ in range(rounds):
        sent = context.broadcast(books)  # its size depends on the parameters only

        def add(total, block, sent=sent):
            return tally(total or (np.zeros(sent.value.shape, np.int64), np.zeros(sent.value.shape[:2], np.int64)), block, sent.value)

        sums, counts = blocks.treeAggregate(None, add, lambda a, b: (a[0] + b[0], a[1] + b[1]) if a and b else a or b)
        books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def coded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` as ``_id``, ``_label``, ``code`` (entry numbers by part) and ``error``."""
    parts, _, width = books.shape
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = whole(np.asarray(b.column(2).flatten()).reshape(-1, parts * width))
            told = [nearest(cells[p * width : (p + 1) * width], book) for p, book in enumerate(sent.value)]
            codes = np.stack([c for c, _ in told], 1).astype(np.int32)
            code = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts), pa.int32()), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), code, pa.array(sum(e for _, e in told), pa.int64())], names=["_id", "_label", "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select("_id", "_label", "_v").mapInArrow(run, f"_id {kinds['_id']}, _label {kinds['_label']}, code array<int>, error long")


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """One row per usable row: its id, its label, ``code`` (entry numbers by part), ``error`` (the squared distance over all parts) and
    ``label_error``, the sum over equal labels, null ones together; and the codebooks (parts by entries by components).

    Codebooks start as the parts of the vectors of the least ids (null last, ties by vector). Rows whose vector is null or empty, or holds a
    null or non-finite component, go. So do those whose vector isn't as long as that of the least id, as they can't be cut alike; a
    length that ``parts`` doesn't divide, and components beyond 131,072 in size, are errors. Repeated rows are coded alike and count each
    time. With fewer rows than ``entries`` codebooks are as small. An empty table, or one without usable rows, gives an empty
    result and codebooks without entries; other columns aren't read.
    """
    common.small_batches(vectors.sparkSession, BLOCK)
    rows = usable(vectors, id_col, vector_col, label_col)
    least = [F.col("_id").asc_nulls_last(), F.col("_v")]
    first = rows.orderBy(*least).select("_v").limit(1).collect()
    if first:
        dim = len(first[0]["_v"])
        if dim % parts:
            raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
        rows = rows.where(F.size("_v") == dim)
        start = whole(np.array([r["_v"] for r in rows.orderBy(*least).select("_v").limit(entries).collect()]))
        books = learn(rows, np.ascontiguousarray(start.reshape(parts, dim // parts, -1).transpose(0, 2, 1)).astype(np.int64), rounds)
        made = common.cut(coded(rows, books))
    else:
        books = np.zeros((parts, 0, 0), np.int64)
        made = rows.select("_id", "_label", F.lit(None).cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
    made = made.withColumns({"_none": F.col("_label").isNull(), "_key": F.coalesce(F.col("_label").cast("string"), F.lit(""))})
    made = common.group_lookup(made, ["_none", "_key"], common.salted("_id", "error"), {"label_error": (F.sum("error"), F.sum("_p_label_error"))})
    return made.select(F.col("_id").alias(id_col), F.col("_label").alias(label_col), "code", "error", "label_error"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, books = compress(common.table(spark, sf_dir, "embeddings"))
    listed = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    code = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return made.select("vec_id", code.alias("code"), "error", "label_error", F.lit(listed).alias("codebooks_sha256"))


def _sql() -> str:
    near = "(SELECT r, k, min(list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 256 + e) AS m FROM s JOIN b{i} b USING (k) GROUP BY r, k)"
    rounds = "".join(
        f"""
a{i} AS MATERIALIZED {near.format(i=i)},
b{i + 1} AS MATERIALIZED (SELECT b.k, b.e, coalesce(c.x, b.x) AS x FROM b{i} b LEFT JOIN (SELECT k, e, list(m ORDER BY j) AS x FROM (SELECT k, m % 256 AS e, j, floor(sum(v) / count(*))::BIGINT AS m
  FROM (SELECT a.k, a.m, unnest(s.x) AS v, generate_subscripts(s.x, 1) AS j FROM a{i} a JOIN s USING (r, k)) GROUP BY ALL) GROUP BY ALL) c USING (k, e)),"""
        for i in range(ROUNDS)
    )
    return rf"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT r, k, x[k * len(x) // 4 + 1:(k + 1) * len(x) // 4] AS x FROM v, (SELECT unnest(range(4)) AS k)),
b0 AS MATERIALIZED (SELECT k, r - 1 AS e, x FROM s WHERE r <= 256),{rounds}
a AS MATERIALIZED {near.format(i=ROUNDS)},
c AS (SELECT r, string_agg(lpad(lower(to_hex(m % 256)), 2, '0'), '' ORDER BY k) AS code, sum(m // 256)::BIGINT AS error FROM a GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY k, e)) FROM b{ROUNDS}) AS codebooks_sha256 FROM c JOIN v USING (r)
"""


OP12_SQL = _sql()
