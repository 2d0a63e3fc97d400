"""Runs of words that repeat with a period, found by names of blocks whose lengths are powers of two.

After Karp, Miller and Rosenberg: equal words have equal names, and a block of 2k words is named by the names of its halves.
How far the text agrees with itself a period later is told by the names from the longest down. A run of four periods
or more agrees over three, so one place of a grid of that width lies in it; such places are extended both ways. Nothing is
hashed and no suffixes are sorted. Texts of a batch are named together in flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A run has this many periods, and this many words, or more.
PERIODS, LEAST = 4, 6
#: Words that are named together; a longer text is named alone.
WORDS_AT_ONCE = 1 << 18
#: Places of grids that are looked at together.
PLACES = 1 << 19


def names(words: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words that start at each place, up to the longest that occurs twice.

    Equal blocks have equal names above 0; a block that occurs once, or passes the end, is 0. So a level costs what still repeats.
    """
    count = np.bincount(words)
    levels, width = [np.where(count[words] > 1, words + 1, 0).astype(np.int32)], 1
    while True:
        last = levels[-1]
        at = np.flatnonzero(last[: max(len(last) - width, 0)])
        at = at[last[at + width] > 0]
        if not len(at):
            return levels
        pair = last[at].astype(np.int64) << 32 | last[at + width]
        _, name, n = np.unique(pair, return_inverse=True, return_counts=True)
        again = n[name] > 1
        if not again.any():
            return levels
        made = np.zeros(len(last), np.int32)
        made[at[again]] = name[again] + 1
        levels.append(made)
        width *= 2


def agreement(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on; with ``back``, of those before both."""
    n, far = len(levels[0]), np.zeros(len(a), np.int64)
    # no block of twice the longest occurs twice, so of each length one at most is left
    for k in range(len(levels) - 1, -1, -1):
        width, name = 1 << k, levels[k]
        x, y = (a - far - width, b - far - width) if back else (a + far, b + far)
        open_ = np.flatnonzero((x >= 0) & (y < n))
        x, y = name[x[open_]], name[y[open_]]
        far[open_[(x == y) & (x > 0)]] += width
    return far


def grid(first: np.ndarray, size: np.ndarray, period: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and periods to look at: for each text (its first word, its words) and period every so manyth word, if there is one a period later."""
    step = np.maximum((PERIODS - 1) * period, LEAST - period)
    n = -(-(size - period) // step)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        upto = max(np.searchsorted(ends, (ends[at - 1] if at else 0) + PLACES, "right"), at + 1)
        k = n[at:upto]
        i = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        yield np.repeat(first[at:upto], k) + i * np.repeat(step[at:upto], k), np.repeat(period[at:upto], k)
        at = upto


def runs(words: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of (start, length, period) of all runs, by start and period. ``words``: numbers of words, no number in two texts; a text has
    the ``size`` words from ``first`` on."""
    if not len(words):
        return np.zeros((0, 3), np.int64)
    levels, found = names(words), [np.zeros((0, 3), np.int64)]
    text = np.repeat(np.arange(len(size)), size // PERIODS)
    period = np.arange(len(text)) - np.repeat(np.cumsum(size // PERIODS) - size // PERIODS, size // PERIODS) + 1
    for at, q in grid(first[text], size[text], period):
        same = (levels[0][at] == levels[0][at + q]) & (levels[0][at] > 0)
        at, q = at[same], q[same]
        if len(at):
            ahead, behind = agreement(levels, at, at + q, False), agreement(levels, at, at + q, True)
            long = ahead + behind + q >= np.maximum(LEAST, PERIODS * q)
            found.append(np.unique(np.stack([at - behind, ahead + behind + q, q], 1)[long], axis=0))
    every = np.unique(np.concatenate(found), axis=0)  # a stretch found by multiples of its period too has the least
    return every[np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)]] if len(every) else every


def of_texts(texts: list[list[bytes]]) -> list[np.ndarray]:
    """The runs of each text, with starts counted in it."""
    parts, base = [], 0
    for t in texts:
        known: dict[bytes, int] = {}
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in t), np.int64, len(t)) + base)
        base += len(known)
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size) - size
    found = runs(np.concatenate(parts) if parts else np.zeros(0, np.int64), first, size)
    cuts = np.searchsorted(found[:, 0], first)
    return [own - [at, 0, 0] for own, at in zip(np.split(found, cuts[1:]), first, strict=True)]


def collapsed(words: list[bytes], own: np.ndarray) -> bytes:
    """The words, joined by one space, that no run holds beyond its first period."""
    if len(own):
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, own[:, 0] + own[:, 2], 1)
        np.add.at(edge, own[:, 0] + own[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``runs`` (start, length and period in words, by start, then period) and ``text``, in which of each run the
    first period stays; words ``[^\\x20\\x09-\\x0D]+``, joined by one space.

    A run is as long as words a period apart are identical, has four periods and six words or more, and its period is the least it has.
    Null texts are empty; texts without words have no runs and an empty ``text``. A text is handled whole, in one task, whatever its length.
    Rows are independent: repeats and null ids give rows alike. An empty table gives an empty result; other columns aren't read.
    """
    common.small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = of_texts(texts)
        flat = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        ends = np.cumsum([0, *(len(x) for x in found)])
        fields = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(kind.value_type))
        left = [collapsed(t, own).decode() for t, own in zip(texts, found, strict=True)]
        return pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields, type=kind), pa.array(left, pa.string())], names=["id", "runs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, n, at = [], 0, 0
            for i, text in enumerate(b.column(1)):
                words = text.as_py().split()  # bytes are split at the six ASCII white spaces only
                if part and n + len(words) > WORDS_AT_ONCE:
                    yield batch(b.column(0).slice(at, len(part)), part)
                    part, n, at = [], 0, i
                part.append(words)
                n += len(words)
            if part:
                yield batch(b.column(0).slice(at, len(part)), part)

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    made = texts.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, runs array<struct<start: long, length: long, period: long>>, text string")
    return made.withColumnRenamed("id", id_col)


def planted(text: Column, doc_id: Column) -> Column:
    """A tenth of the texts, by CRC-32 of the id, repeated with a period from a word of theirs on; the others as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeated(v: Column) -> Column:
        n = F.size(v["w"])
        a = F.pmod(v["g"], n)
        return common.let(F.struct(v["w"].alias("w"), a.alias("a"), (1 + F.floor((n - a) / (3 + v["g"] % 8))).alias("p")), again)

    def again(v: Column) -> Column:
        places = F.sequence(F.lit(0).cast("long"), F.size(v["w"]).cast("long") - 1)
        return F.array_join(F.transform(places, lambda i: F.get(v["w"], F.when(i < v["a"], i).otherwise(v["a"] + F.pmod(i - v["a"], v["p"])).cast("int"))), " ")

    return F.when((h % 10 == 0) & text.rlike(r"[^\x20\x09-\x0D]"), common.let(F.struct(words.alias("w"), g.alias("g")), repeated)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    made = periodic_runs(docs.withColumn("text", planted(F.col("text"), F.col("doc_id"))))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    figures = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("").alias("listed"), "text")
    length = -F.col("x.l")
    return figures.select("doc_id", "n_runs", F.col("x.start").alias("start"), length.alias("length"), F.col("x.period").alias("period"), F.floor(1000 * length / F.col("x.period")).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))


#: CRC-32 bit by bit, and equal words of a text joined by distance; neighbouring pairs of one distance are a run.
OP11_SQL = r"""
WITH c AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, CASE WHEN doc_id IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: CASE WHEN xor(a, x) % 2 = 1 THEN xor(xor(a, x) >> 1, 3988292384::BIGINT) ELSE xor(a, x) >> 1 END), 4294967295::BIGINT) ELSE 1 END AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g FROM c),
p AS (SELECT *, g % greatest(n, 1) AS a FROM g),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w, row_number() OVER () AS r FROM q),
u AS (SELECT r, n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM t),
e AS (SELECT a.r, b.i - a.i AS q, a.i FROM u a JOIN u b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e),
m AS (SELECT r, min(i) AS start, count(*) + q AS length, q FROM s GROUP BY r, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
f AS (SELECT r, start, length, min(q) AS period FROM m GROUP BY ALL),
d AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM f),
k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u ANTI JOIN d ON u.r = d.r AND u.i = d.i GROUP BY u.r),
o AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed, min({'l': -length, 's': start, 'p': period}) AS x FROM f GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, x.s AS start, -x.l AS length, x.p AS period, -1000 * x.l // x.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM t LEFT JOIN o USING (r) LEFT JOIN k USING (r)
"""
