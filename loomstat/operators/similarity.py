"""Similarity over vectors and shares, near-duplicate groups, audits.

Exact all-against-all searches run over pairs of blocks: each task multiplies two bounded matrices and returns only what
passes, so neither side is broadcast and no pair is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import dot, norm
from . import grids

#: Rows of a block that is shuffled, and of those whose products with another block are held at once at most.
BLOCK, CHUNK = 8192, 1024
#: Products that a task holds at once, values of a block of rows that are dealt by hash, and such blocks where there are rows enough for one task each.
PRODUCTS, VALUES, SPREAD = 1 << 21, 1 << 21, 12
#: Wide blocks that each side of a search has at least, where there are rows enough.
SIDE = 4
#: Pivots that rows are dealt to at most: a square of them is on the driver.
PIVOTS = 1024
#: Fits that run at once.
FITS = 4


def _blocks(left: DataFrame, right: DataFrame, run: Callable, schema: str, wide: bool = False) -> DataFrame:
    """``run(left ids, left rows, right ids, right rows)`` for all pairs of blocks of rows (``id`` long, ``v`` array), the right one by id, the left one in parts:
    a task holds up to ``PRODUCTS`` of their products. ``wide`` blocks have up to ``VALUES`` values, so that rows and what is found are copied less, but there
    are ``SIDE`` of a side from some thousands of rows on."""
    n = [df.count() for df in ((left,) if left is right else (left, right))]
    most, least = BLOCK, 1
    if wide:
        one = right.select(F.size("v")).first() if max(n) > SIDE * BLOCK else None
        most, least = max(BLOCK, VALUES // (one[0] or 1)) if one else BLOCK, SIDE
    nl, nr = (max(1, -(-c // most), min(-(-c * SIDE // BLOCK), least)) for c in (n[0], n[-1]))
    at = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = left.select("id", "v", at(nl).alias("i"), each(nr).alias("j"), F.lit(0).alias("side"))
    right = right.select("id", "v", each(nl).alias("i"), at(nr).alias("j"), F.lit(1).alias("side"))

    def both(g: pd.DataFrame) -> pd.DataFrame:
        x, y = g[g["side"] == 0], g[g["side"] == 1].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        a, one, b, two = x["id"].to_numpy(), _matrix(x), y["id"].to_numpy(), _matrix(y)
        step = max(1, min(CHUNK, PRODUCTS // len(y)))
        return pd.concat([run(a[at : at + step], one[at : at + step], b, two) for at in range(0, len(x), step)])

    return left.unionByName(right).groupBy("i", "j").applyInPandas(both, schema)


def _matrix(df: pd.DataFrame) -> np.ndarray:
    return np.array(df["v"].tolist(), np.float64).reshape(len(df), -1)


#: Rows that principal directions are taken from, and directions that bound a dot product.
DRAWN, PREFIX = 4096, 16


def _directions(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Pivots, up to ``PIVOTS`` of the ``n`` rows drawn by hash, as unit vectors; the principal directions of up to ``DRAWN`` rows as columns, the
    longest first; and the rows with the pivot ``c`` that is closest by angle, the ``angle``, their ``norm``, their parts in the first ``PREFIX``
    directions and the length of the ``rest``. The draws bear on the work only, not on results."""
    drawn = np.array([r["v"] for r in rows.orderBy(F.xxhash64("id"), "id").limit(DRAWN).collect()], np.float64)
    drawn = drawn.reshape(len(drawn), -1)
    turn = np.linalg.eigh(drawn.T @ drawn)[1][:, ::-1]
    p = drawn[: min(PIVOTS, -(-n // 256))]
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            m = _matrix(b)
            size = np.linalg.norm(m, axis=1)
            cos = (m / np.maximum(size, 1e-300)[:, None]) @ p.T
            c = cos.argmax(axis=1)
            turned = m @ turn
            yield b.assign(c=c, angle=np.arccos(np.clip(cos[np.arange(len(c)), c], -1, 1)), norm=size, prefix=list(turned[:, :PREFIX]), rest=np.linalg.norm(turned[:, PREFIX:], axis=1))

    return p, turn, rows.select("id", "v").mapInPandas(run, "id long, v array<double>, c int, angle double, norm double, prefix array<double>, rest double")


def boxed_pairs(low: np.ndarray, high: np.ndarray, rest: np.ndarray, least: float) -> np.ndarray:
    """Whether rows of cells i and j, whose parts in the first directions are from ``low`` to ``high`` and whose other parts are no longer than
    ``rest``, can have a dot product over ``least``."""
    bound = rest[:, None] * rest[None]
    for lo, hi in zip(low.T, high.T, strict=True):
        bound = bound + np.maximum(np.maximum(lo[:, None] * lo, lo[:, None] * hi), np.maximum(hi[:, None] * lo, hi[:, None] * hi))
    return bound > least - 1e-9


def over(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and dot products over ``least`` of rows of ``x`` and ``y``."""
    sim = x @ y.T
    i, j = np.nonzero(sim > least)
    return i, j, sim[i, j]


def close(x: np.ndarray, y: np.ndarray, turn: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and dot products over ``least`` of rows of ``x`` and ``y``: those whose parts in the first directions, and the lengths of the rest, allow it
    are multiplied whole."""
    one, two = x @ turn, y @ turn
    bound = one[:, :PREFIX] @ two[:, :PREFIX].T + np.outer(np.linalg.norm(one[:, PREFIX:], axis=1), np.linalg.norm(two[:, PREFIX:], axis=1))
    may = bound > least - 1e-9
    if np.count_nonzero(may) * 20 > may.size:  # few pairs are left out: all products at once are faster
        return over(x, y, least)
    i, j = np.nonzero(may)
    sim = np.einsum("ij,ij->i", x[i], y[j])
    return i[sim > least], j[sim > least], sim[sim > least]


def best(x: np.ndarray, y: np.ndarray, sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and dot products of the ``k`` rows of ``y`` that are largest in ``sim``, the products, for each row of ``x``; ties, to twelve places, by place.

    Only what reaches the k-th product of its row is sorted. Its products are taken again, pair by pair in one order, so that equal rows tie wherever they
    are in a block."""
    sim = np.where(np.isnan(sim), -np.inf, sim) if np.isnan(sim.sum()) else sim
    k = min(k, sim.shape[1])
    least = np.partition(sim, -k, axis=1)[:, -k]
    i, j = np.nonzero((sim >= (least - 2e-12 - 1e-15 * np.abs(least))[:, None]) & np.isfinite(sim))
    again = [np.einsum("ij,ij->i", x[i[at : at + BLOCK]], y[j[at : at + BLOCK]]) for at in range(0, len(i), BLOCK)]
    sim = np.concatenate([np.zeros(0), *again])
    order = np.lexsort((j, -np.round(sim, 12), i))
    i, j, sim = i[order], j[order], sim[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept], sim[kept]


def live_pairs(p: np.ndarray, angle: np.ndarray, norm: np.ndarray, least: float) -> np.ndarray:
    """Whether rows about pivots i and j, no further than ``angle`` from them and no longer than ``norm``, can have a dot product over
    ``least``: directions are no closer than those of the pivots less both angles. All can if ``least`` is negative."""
    apart = np.arccos(np.clip(p @ p.T, -1, 1)) - angle[:, None] - angle[None] - 1e-6
    return (norm[:, None] * norm[None] * np.cos(np.clip(apart, 0, np.pi)) > least - 1e-9) | (least < 0)


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(``a``, ``b``, ``sim``) of all rows (``id``, ``v``) with a < b and dot product over ``least``: see :func:`_near`."""
    def run(a: np.ndarray, b: np.ndarray, same: bool, found: Iterator[tuple]) -> pd.DataFrame:
        out = [pd.DataFrame({"a": [], "b": [], "sim": []})]
        for i, j, sim in found:
            once = (a[i] < b[j]) | ((a[i] > b[j]) & (not same))
            out.append(pd.DataFrame({"a": np.minimum(a[i], b[j])[once], "b": np.maximum(a[i], b[j])[once], "sim": sim[once]}))
        return pd.concat(out[1:] or out)

    return _near(rows, least, run, "a long, b long, sim double")


def near_links(rows: DataFrame, least: float) -> DataFrame:
    """(``a``, ``b``) that connect the same rows (``id``, ``v``) as the pairs of :func:`near_pairs` do: of the rows of two blocks, each that is in a set of
    pairs there with the least one in it. They are fewer than the rows of both blocks, however many pairs there are."""
    def run(a: np.ndarray, b: np.ndarray, same: bool, found: Iterator[tuple]) -> pd.DataFrame:
        ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        one, two, top = place[: len(a)], place[len(a) :], np.arange(len(ids))
        for i, j, _ in found:
            x, y = top[one[i]], top[two[j]]
            new = np.unique(np.stack([x, y])[:, x != y], axis=1)  # most pairs meet in a set that is known
            if new.shape[1]:
                top = grids.joined(len(ids), *new)[top]
        on = top != np.arange(len(ids))
        return pd.DataFrame({"a": ids[top[on]], "b": ids[on]})

    return _near(rows, least, run, "a long, b long")


def _near(rows: DataFrame, least: float, made: Callable, schema: str) -> DataFrame:
    """What ``made`` tells of all rows (``id``, ``v``) with a dot product over ``least``. It takes the ids of two blocks, whether they are one, and the places in
    them and the products of such pairs, part by part.

    Rows are dealt to the closest of a bounded number of pivots. Only pairs of pivots whose rows can be close enough are compared, by angle
    and by their extent in principal directions, in blocks of about ``BLOCK`` rows, each pair of blocks once; in these, pairs of rows that
    the principal directions rule out aren't multiplied. Few are left for a high ``least`` and rows in groups. Where most are, for a low one and
    rows in all directions, rows are dealt by hash into few large blocks. Pivots, directions and some numbers for each pivot are on the driver; rows never are but for the drawn ones.
    """
    n = rows.count()
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    p, turn, dealt = _directions(rows, n)
    k = min(PREFIX, len(turn))
    ends = [f(F.get("prefix", F.lit(i))).alias(f"{name}{i}") for i in range(k) for name, f in (("lo", F.min), ("hi", F.max))]
    facts = dealt.groupBy("c").agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("norm").alias("norm"), F.max("rest").alias("rest"), *ends).collect()
    blocks, size, angle, norms, rest = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64), np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    low, high = np.zeros((len(p), k)), np.zeros((len(p), k))
    for f in facts:
        blocks[f["c"]], size[f["c"]], angle[f["c"]], norms[f["c"]], rest[f["c"]] = -(-f["n"] // BLOCK), f["n"], f["angle"], f["norm"], f["rest"]
        low[f["c"]], high[f["c"]] = ([f[f"{end}{i}"] for i in range(k)] for end in ("lo", "hi"))
    live = live_pairs(p, angle, norms, least) & boxed_pairs(low, high, rest, least)
    one, two = np.nonzero(np.triu(live) & (blocks[:, None] > 0) & (blocks[None] > 0))
    whole = max(-(-n * len(turn) // max(VALUES, BLOCK * len(turn))), min(-(-n // BLOCK), SPREAD))
    few = (size[one] * blocks[two] + size[two] * blocks[one]).sum() <= 2 * n * (whole + 1)
    if not few:  # most pivots meet: their many small blocks would be shuffled once for each
        dealt, blocks = rows.select("id", "v", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(whole)).cast("int").alias("c")), np.ones(whole, np.int64)
        one, two = np.triu_indices(whole)
    met = rows.sparkSession.createDataFrame(pd.DataFrame({"c1": one, "n1": blocks[one], "c2": two, "n2": blocks[two]}) if len(one) else [], "c1 int, n1 long, c2 int, n2 long")
    own, alike = lambda m: F.pmod(F.xxhash64("id"), F.col(m)), F.col("c1") == F.col("c2")
    left = dealt.join(F.broadcast(met), F.col("c") == F.col("c1")).withColumn("i", own("n1"))
    left = left.select("id", "v", "c1", "i", "c2", F.explode(F.sequence(F.when(alike, F.col("i")).otherwise(0), F.col("n2") - 1)).alias("j"), F.lit(0).alias("side"))
    right = dealt.join(F.broadcast(met), F.col("c") == F.col("c2")).withColumn("j", own("n2"))
    right = right.withColumn("last", F.when(alike, F.col("j")).otherwise(F.col("n1")) - 1).where("last >= 0")
    right = right.select("id", "v", "c1", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"), "c2", "j", F.lit(1).alias("side"))

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        x = g[g["side"] == 0]
        same = key[0] == key[2] and key[1] == key[3]
        y = x if same else g[g["side"] == 1]
        if not len(x) or not len(y):
            return pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})
        one, two = _matrix(x), _matrix(y)
        step = max(1, min(CHUNK, PRODUCTS // len(y)))

        def found() -> Iterator[tuple]:
            for at in range(0, len(x), step):
                i, j, sim = close(one[at : at + step], two, turn, least) if few else over(one[at : at + step], two, least)
                yield i + at, j, sim

        return made(x["id"].to_numpy(), y["id"].to_numpy(), same, found())

    return left.unionByName(right).groupBy("c1", "i", "c2", "j").applyInPandas(run, schema)


def nearest(queries: DataFrame, rows: DataFrame, k: int, skip_self: bool = True) -> DataFrame:
    """(``query``, ``id``, ``sim``, ``rank``): the ``k`` rows with the largest dot product; ties, to twelve places, by least id."""
    def run(a: np.ndarray, one: np.ndarray, b: np.ndarray, two: np.ndarray) -> pd.DataFrame:
        sim = one @ two.T
        if skip_self:
            sim[a[:, None] == b[None]] = -np.inf
        i, j, sim = best(one, two, sim, k)
        return pd.DataFrame({"query": a[i], "id": b[j], "sim": sim})

    found = _blocks(queries, rows, run, "query long, id long, sim double", wide=True)
    w = Window.partitionBy("query").orderBy(F.desc(F.round("sim", 12)), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def js_nearest(rows: DataFrame) -> DataFrame:
    """(``query``, ``id``, ``js``): for each row (``id``, ``v``, shares that sum to 1) the other row with the least Jensen-Shannon distance; ties, to nine
    places, by least id. In blocks, of which no task holds more than two."""
    def run(a: np.ndarray, one: np.ndarray, b: np.ndarray, two: np.ndarray) -> pd.DataFrame:
        total = np.zeros((len(a), len(b)))
        for p, q in zip(one.T, two.T, strict=True):
            p, q = np.broadcast_arrays(p[:, None], q[None])
            m = (p + q) / 2
            for part in (p, q):
                total += np.where(part > 0, part * np.log2(np.where(part > 0, part, 1) / np.where(m > 0, m, 1)), 0)
        js = np.where(a[:, None] == b[None], np.inf, np.round(np.sqrt(np.maximum(total / 2, 0)), 9))
        at = js.argmin(axis=1)
        made = pd.DataFrame({"query": a, "id": b[at], "js": js[np.arange(len(a)), at]})
        return made[np.isfinite(made["js"])]

    found = _blocks(rows, rows, run, "query long, id long, js double")
    best = found.groupBy("query").agg(F.min(F.struct("js", "id")).alias("b"))
    return best.select("query", F.col("b.id").alias("id"), F.col("b.js").alias("js"))


def near_or_alike(rows: DataFrame, least: float, most: int) -> DataFrame:
    """(``a``, ``b``, ``sim``, ``bits``) of all rows (``id``, ``v``, ``h``) with a < b and a dot product over ``least`` or at most ``most`` of 64 bits
    of ``h`` different. The hash rides along as the last place of ``v``, in two halves that doubles hold."""
    halves = F.array(F.shiftrightunsigned("h", 32).cast("double"), F.col("h").bitwiseAND(F.lit((1 << 32) - 1)).cast("double"))
    packed = rows.select("id", F.concat(F.transform("v", lambda x: x.cast("double")), halves).alias("v"))

    def run(a: np.ndarray, one: np.ndarray, b: np.ndarray, two: np.ndarray) -> pd.DataFrame:
        sim = one[:, :-2] @ two[:, :-2].T
        signs = [np.unpackbits(m[:, -2:].astype("<u4").view(np.uint8).reshape(len(m), 8), axis=1).astype(np.float32) * 2 - 1 for m in (one, two)]
        bits = np.rint((64 - signs[0] @ signs[1].T) / 2).astype(np.int64)
        i, j = np.nonzero(((sim > least) | (bits <= most)) & (a[:, None] < b[None]))
        return pd.DataFrame({"a": a[i], "b": b[j], "sim": sim[i, j], "bits": bits[i, j]})

    return _blocks(packed, packed, run, "a long, b long, sim double, bits long")


def alike_pairs(rows: DataFrame, most: int) -> DataFrame:
    """(``a``, ``b``, ``bits``) of all rows (``id``, ``h``) with a < b and at most ``most`` of the 64 bits of ``h`` different.

    The bits are cut into ``most`` + 1 bands, of which such a pair shares one: different hashes are joined by band and value, a value
    with over ``BLOCK`` of them in as many parts as needed, and checked; a pair is told by the first band that it shares. Rows with one
    hash meet at the end. With many bits for ``most`` bands are short and most pairs are looked at: :func:`near_or_alike` is for these.
    """
    ends = [64 * i // (most + 1) for i in range(most + 2)]
    masks = [((1 << z) - 1) ^ ((1 << a) - 1) for a, z in zip(ends, ends[1:], strict=False)]
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    band = lambda h: F.array(*[F.struct(F.lit(i).alias("band"), h.bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)])
    each = rows.select("h").distinct().select("h", F.inline(band(F.col("h"))))
    parts = each.groupBy("band", "value").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n")
    each = each.join(parts, ["band", "value"])
    left = each.select("band", "value", F.col("h").alias("h1"), F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"))
    right = each.select("band", "value", F.col("h").alias("h2"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    differ = F.col("h1").bitwiseXOR(F.col("h2"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m)) == 0, i) for i, m in enumerate(masks)])
    met = left.join(right, ["band", "value", "part"]).where((F.col("h1") < F.col("h2")) & (F.bit_count(differ) <= most) & (first == F.col("band")))
    met = met.select("h1", "h2", F.bit_count(differ).cast("long").alias("bits"))
    one, two = rows.select(F.col("id").alias("i"), F.col("h").alias("h1")), rows.select(F.col("id").alias("j"), F.col("h").alias("h2"))
    apart = met.join(one, "h1").join(two, "h2").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "bits")
    equal = one.join(two, F.col("h1") == F.col("h2")).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(0).cast("long").alias("bits"))
    return apart.unionByName(equal)


@F.pandas_udf(T.LongType())
def phash(grey: pd.Series) -> pd.Series:
    """The perceptual hash of a 32 by 32 grey picture, given as 1,024 numbers: which of the 8 by 8 lowest cosine coefficients are over
    their median, the first in the highest bit."""
    k, n = np.arange(8)[:, None], np.arange(32)[None]
    basis = np.cos(np.pi * k * (2 * n + 1) / 64) * np.where(k == 0, np.sqrt(1 / 32), np.sqrt(2 / 32))
    out = []
    for g in grey:
        low = basis @ np.asarray(g, np.float64).reshape(32, 32) @ basis.T
        out.append(int.from_bytes(np.packbits((low > np.median(low)).ravel()).tobytes(), "big", signed=True))
    return pd.Series(out, dtype="int64")


def ref_scores(rows: DataFrame, refs: DataFrame, group: str, skip: DataFrame) -> DataFrame:
    """(``id``, ``best_own``, ``mean_other``): the largest dot product with the refs of the row's own group, and the mean over all refs but
    those that ``skip`` (group, ``ref``) lists for it. ``refs`` (``ref``, group, ``v``) are a few of each group; sums of vectors
    stand in for pairs where a mean is asked."""
    own = rows.join(refs.select(group, F.col("v").alias("_r")), group).groupBy("id").agg(F.max(dot(F.col("v"), F.col("_r"))).alias("best_own"))
    place = F.posexplode("v").alias("_i", "_x")
    total = refs.select(place).groupBy("_i").agg(F.sum(F.col("_x").cast("double")).alias("_t"), F.count("*").alias("_n"))
    out = skip.join(refs.select("ref", "v"), "ref").select(group, place).groupBy(group, "_i").agg(F.sum(F.col("_x").cast("double")).alias("_t2"), F.count("*").alias("_n2"))
    rest = rows.select(group).distinct().crossJoin(F.broadcast(total)).join(out, [group, "_i"], "left")  # groups by places
    rest = rest.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", ((F.col("_t") - F.coalesce("_t2", F.lit(0.0))) / (F.col("_n") - F.coalesce("_n2", F.lit(0)))).alias("m")))).alias("_m"))
    rest = rest.select(group, F.transform("_m", lambda x: x["m"]).alias("_m"))
    return rows.join(rest, group).select("id", dot(F.col("v"), F.col("_m")).alias("mean_other")).join(own, "id", "left")


def above_or_nearest(queries: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """(``query``, ``id``, ``sim``): all rows with a dot product over ``least``, and the best of each block of rows, itself left out."""
    def run(a: np.ndarray, one: np.ndarray, b: np.ndarray, two: np.ndarray) -> pd.DataFrame:
        sim = one @ two.T
        sim[a[:, None] == b[None]] = -np.inf
        hit = sim > least
        hit[np.arange(len(a)), np.round(sim, 12).argmax(axis=1)] = True
        i, j = np.nonzero(hit & np.isfinite(sim))
        return pd.DataFrame({"query": a[i], "id": b[j], "sim": sim[i, j]})

    return _blocks(queries, rows, run, "query long, id long, sim double")


def kmeans_centres(rows: DataFrame, vector: str, k: int, starts: int = 8, seed: int = 0) -> DataFrame:
    """(``place``, ``centre``, ``weight``): the best of ``starts`` k-means fits over all dimensions, the heaviest centre first. Ties by centre.

    Equal rows are one point with their number as its weight. Points are dealt by their values and sorted, so that the draws of starts, which are by
    partition, don't depend on files. Fits run side by side; each holds the points in memory of its own only while it runs.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    points = rows.groupBy(F.transform(vector, lambda x: x.cast("double")).alias("v")).agg(F.count("*").cast("double").alias("n"))
    points = points.repartition(spark.sparkContext.defaultParallelism, "v").sortWithinPartitions("v")
    points = points.persist()
    points.count()
    made = points.select(array_to_vector("v").alias("features"), "n")  # not persisted as such, so that a fit keeps its own blocks
    with ThreadPoolExecutor(FITS) as pool:
        fits = list(pool.map(inheritable_thread_target(spark)(lambda i: KMeans(k=k, seed=seed + i, maxIter=50, weightCol="n").fit(made)), range(starts)))
    best = min(fits, key=lambda m: m.summary.trainingCost)
    n = best.transform(made).groupBy("prediction").agg(F.sum("n").alias("n")).collect()  # k rows
    points.unpersist()
    centres, total = best.clusterCenters(), sum(r["n"] for r in n)
    made = spark.createDataFrame([([float(x) for x in centres[r["prediction"]]], r["n"] / total) for r in n], "centre array<double>, weight double")
    return made.select((F.row_number().over(Window.orderBy(F.desc("weight"), "centre")) - 1).alias("place"), "centre", "weight")


def components(edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(``id``, ``comp``): the least id that each end of ``edges`` (a, b) is connected with.

    Large-star and small-star steps in turn; ``cut`` materialises a step and ends its lineage.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = cut(small)
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("comp"))).distinct()


def centroids(rows: DataFrame, group: str, d: int) -> DataFrame:
    """(group, ``c``): the normalised mean vector of each group of rows (``id``, ``v``). Sums by place, combined before the shuffle."""
    sums = rows.groupBy(group).agg(*[F.avg(F.col("v")[i].cast("double")).alias(f"_{i}") for i in range(d)])
    mean = sums.select(group, F.array(*[f"_{i}" for i in range(d)]).alias("m"))
    length = F.sqrt(F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("len", length).select(group, F.transform("m", lambda x: x / F.col("len")).alias("c"))


def left_out_score(rows: DataFrame, group: str, d: int) -> DataFrame:
    """(``id``, ``score``): dot product of each row with the normalised mean of all rows outside its own group.

    Totals less the group's own sums, so no row meets another.
    """
    one = rows.groupBy(group).agg(*[F.sum(F.col("v")[i].cast("double")).alias(f"_{i}") for i in range(d)])
    one = one.select(group, F.array(*[f"_{i}" for i in range(d)]).alias("s"))
    total = one.agg(*[F.sum(F.col("s")[i]).alias(f"_{i}") for i in range(d)]).select(F.array(*[f"_{i}" for i in range(d)]).alias("t"))
    rest = one.join(F.broadcast(total)).select(group, F.zip_with("t", "s", lambda a, b: a - b).alias("r"))  # one row
    rest = rest.withColumn("len", F.sqrt(F.aggregate("r", F.lit(0.0), lambda s, x: s + x * x)))
    score = F.aggregate(F.zip_with("v", "r", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x) / F.col("len")
    return rows.join(rest, group).select("id", group, score.alias("score"))


def gram_cosine(rows: DataFrame, group: str, d: int) -> DataFrame:
    """(``a``, ``b``, ``gram_cosine``): cosine of the Gram matrices, summed outer products over the first ``d`` places, of each two groups."""
    one = rows.select(group, "v", F.explode(F.sequence(F.lit(0), F.lit(d - 1))).alias("_i")).withColumn("_x", F.get("v", F.col("_i")).cast("double"))
    one = one.groupBy(group, "_i").agg(F.array(*[F.sum(F.col("_x") * F.col("v")[j]) for j in range(d)]).alias("_g"))
    g = one.groupBy(group).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_g"))), lambda x: x["_g"])).alias("g"))
    a, b = (g.select(F.col(group).alias(x), F.col("g").alias(f"g{x}")) for x in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", (dot(F.col("ga"), F.col("gb")) / (norm(F.col("ga")) * norm(F.col("gb")))).alias("gram_cosine"))


def kernel_distance(rows: DataFrame, group: str, a, b, d: int, subsamples: int = 50, size: int = 64, order: Callable[[Column, Column], Column] = F.xxhash64) -> DataFrame:
    """(``s``, ``d``): by subsample the unbiased distance of groups ``a`` and ``b`` under the cubic kernel (x.y / ``d`` + 1)**3.

    A subsample has ``size`` rows of each group, or as many as the smaller one, drawn in the ``order`` of a hash of ``id`` and its number.
    (``scalars.mixed_int`` is linear in both, so that its subsamples are runs of one cyclic order; SQL can repeat it.)
    """
    rows = rows.where(F.col(group).isin(a, b)).select("id", F.col(group).alias("l"), "v")
    least = rows.agg(F.least(F.count(F.when(F.col("l") == a, 1)), F.count(F.when(F.col("l") == b, 1)), F.lit(size)).alias("m"))
    w = Window.partitionBy("l", "s").orderBy(order(F.col("id"), F.col("s")), "id")
    drawn = rows.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(subsamples)))).withColumn("k", F.row_number().over(w))
    drawn = drawn.where(F.col("k") <= size).join(F.broadcast(least), F.col("k") <= F.col("m"))  # one row
    x, y = (drawn.select("s", F.col("id").alias(f"i{n}"), F.col("l").alias(f"l{n}"), F.col("v").alias(f"v{n}")) for n in "xy")
    pairs = x.join(y, "s").where("ix <> iy or lx <> ly").withColumn("f", F.pow(dot(F.col("vx"), F.col("vy")) / d + 1, F.lit(3.0)))
    mean = lambda p, q: F.avg(F.when((F.col("lx") == p) & (F.col("ly") == q), F.col("f")))
    return pairs.groupBy("s").agg((mean(a, a) + mean(b, b) - 2 * mean(a, b)).alias("d"))


def shares(df: DataFrame, item: list[str], k: str) -> DataFrame:
    """(item, k, ``share``): the share of each k in the rows of an item."""
    n = df.groupBy(*item, k).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*item)))


def entropy(share: Column) -> Column:
    return F.sum(-share * F.log2(share + F.lit(1e-12)))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two share arrays of one length."""
    half = lambda a: F.when(a.p > 0, a.p * F.log2(a.p / ((a.p + a.q) / 2))).otherwise(0.0)
    swap = lambda a: F.when(a.q > 0, a.q * F.log2(a.q / ((a.p + a.q) / 2))).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: F.struct(x.alias("p"), y.alias("q")))
    total = F.aggregate(both, F.lit(0.0), lambda s, a: s + half(a) + swap(a))
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def cooccurrence(df: DataFrame, item: str, k: str, least: float, keep: float) -> DataFrame:
    """(``i``, ``j``, ``share``): in which share of items both have at least ``least``; pairs over ``keep``."""
    held = df.where(F.col("share") >= least).select(item, k)
    n = df.select(F.count_distinct(item).alias("n"))
    pairs = held.select(item, F.col(k).alias("i")).join(held.select(item, F.col(k).alias("j")), item).where("i < j")
    made = pairs.groupBy("i", "j").agg(F.count("*").alias("c")).join(F.broadcast(n))  # one row
    return made.select("i", "j", (F.col("c") / F.col("n")).alias("share")).where(F.col("share") >= keep)
