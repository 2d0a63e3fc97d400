"""Near-duplicate detection by a chosen-path set similarity join.

Each distinct shingle set gets a sketch of 64 minwise tokens. Independent trees branch the sets: a node chooses two of
the 64 places, and its sets go to a child for each place and token. A pair with similarity s agrees at a place with
probability s, so with two choices a node a similar pair survives in some child almost surely while unlike sets part.
Nodes of few sets are compared exhaustively by their sketches; larger ones are compared in parts and branch on. What
sketches suggest is confirmed on full sets. Nodes whose sets are all in one confirmed component already have no link to
add and end there; nodes that hold few sets outside of their largest component are finished by comparing those with
all, which keeps large groups of near copies linear. At the depth limit what is left is compared completely: that is
the product of a node's sets and of those outside of its largest component, by blocks of ``SMALL``. Sets that agree at
every place end in one component before that, as each level deals a node's parts anew.

Tables of nodes hold ids only. What belongs to a set (its sketch, its component) is joined once for each set, to the list
of its nodes, of which there are at most ``TREES * 2**depth``; a node's own facts are told to its rows over salted keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PLACES = 64
TREES = 4
DEPTH = 6
#: Sets, and shingles in all, of a node that is compared exhaustively, or of a part of one: what a task holds at once.
SMALL, SMALL_SHINGLES = 2000, 4_000_000
#: Equal tokens of 64 that make a pair a candidate. At similarity 0.8 fewer are seen once in some 10**6 pairs.
CANDIDATE = 34
#: Candidate components of so many sets and shingles at most are confirmed in one piece.
UNIT_SETS, UNIT_SHINGLES = 300, 2_000_000
#: Ids that are broadcast at most to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Edges that one task connects at most.
IN_ONE_TASK = 1_000_000
#: Words whose hashes a worker remembers at most.
CACHE_WORDS = 100_000
MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(5).integers(0, 1 << 63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, k: int, hashes: WordHash) -> np.ndarray:
    """The distinct 64-bit hashes of the ``k``-word shingles, sorted; of fewer words, of the whole sequence; else none.

    Words are runs without ASCII white space, with A-Z in lower case.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, len(words) if len(words) < k else k, np.uint64)
    for i in range(min(k, len(words))):
        out = (out ^ h[i : i + n]) * MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def least_values(s: np.ndarray) -> np.ndarray:
    """The least value of each of ``PLACES`` hashes over a set: its minwise tokens."""
    least = np.full(PLACES, ~np.uint64(0))
    for at in range(0, len(s), 4096):
        np.minimum(least, (s[None, at : at + 4096] * _FACTORS[:, None]).min(axis=1), out=least)
    return least


def sketch(least: np.ndarray) -> bytes:
    """16 bits of each token."""
    return ((least * MIX) >> np.uint64(48)).astype("<u2").tobytes()


def roots(seed: int) -> np.ndarray:
    """The two places that the root of each tree chooses."""
    draw = np.random.default_rng([seed, PLACES])
    return np.concatenate([draw.choice(PLACES, 2, replace=False) for _ in range(TREES)])


def features(docs: DataFrame, k: int, seed: int) -> DataFrame:
    """(``id``, ``n``, ``s0``, ``s1``, ``sketch``, ``roots``, ``t``) of each row of (``id``, ``text``); s0 and s1 are a 128-bit hash of the
    set, t one of the text. ``roots`` are the children of the trees' roots that the set goes to; they tell whole tokens
    apart, not 16 bits of them, so that sets meet there by a shared shingle only."""
    import xxhash

    places = roots(seed)
    names = (np.arange(len(places)).astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            sets = [shingles(x, k, hashes) for x in b["text"]]
            tokens = [least_values(s) if len(s) else None for s in sets]
            nodes = [None if x is None else ((x[places] ^ names) * MIX ^ (x[places] >> np.uint64(32))).astype(np.int64) for x in tokens]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": b["id"], "n": [len(s) for s in sets], "s0": keys[:, 0], "s1": keys[:, 1], "sketch": [None if x is None else sketch(x) for x in tokens], "roots": nodes, "t": b["t"]})

    docs = docs.withColumn("t", F.xxhash64(F.coalesce("text", F.lit(""))))
    return docs.mapInPandas(run, "id long, n long, s0 long, s1 long, sketch binary, roots array<long>, t long")


def whole_groups(batches: Iterator[pd.DataFrame], key: str, rows: int) -> Iterator[pd.DataFrame]:
    """Sorted batches again, in frames of ``rows`` rows or more that end where a group ends."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= rows:
            df = pd.concat(held, ignore_index=True)
            end = int(np.searchsorted(df[key].to_numpy(), df[key].iloc[-1]))
            if end:
                yield df.iloc[:end]
                df = df.iloc[end:]
            held, n = [df], len(df)
    if n:
        yield pd.concat(held, ignore_index=True)


def joined_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of 0..n-1 the least number that pairs (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def suggest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows (``node``, ``rep``, ``n``, ``sketch``) sorted by node and n: candidate groups, as rows (``gid``, ``rep``).

    All pairs of a node are compared whose sizes allow a similarity of 0.8. Groups are what candidate pairs connect; a group has the same gid wherever it
    is found.
    """
    for df in whole_groups(batches, "node", 8192):
        node, rep, n = (df[c].to_numpy() for c in ("node", "rep", "n"))
        tokens = np.frombuffer(b"".join(df["sketch"]), "<u2").reshape(-1, PLACES)
        left, right, d = [], [], 1
        at = np.flatnonzero(node[:-1] == node[1:])
        while len(at):
            at = at[n[at] * 100 >= 80 * n[at + d]]  # sizes only grow from here
            fit = at[rep[at] != rep[at + d]]
            fit = fit[(tokens[fit, :16] == tokens[fit + d, :16]).sum(axis=1) >= 3]
            hit = fit[(tokens[fit] == tokens[fit + d]).sum(axis=1) >= CANDIDATE]
            left.append(hit)
            right.append(hit + d)
            d += 1
            at = at[at + d < len(node)]
            at = at[node[at] == node[at + d]]
        if left:
            label = joined_labels(len(df), np.concatenate(left), np.concatenate(right))
            size = np.bincount(label, minlength=len(df))
            pick = size[label] > 1
            h = rep.astype(np.uint64) * MIX
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            gid = np.zeros(len(df), np.uint64)
            np.add.at(gid, label, h ^ (h >> np.uint64(29)))
            yield pd.DataFrame({"gid": gid[label][pick].astype(np.int64), "rep": rep[pick]})


def confirm(percent: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From rows (``unit``, ``rep``, ``sh``) sorted by unit: links (``a``, ``b``) that connect what exact similarity connects."""
        for df in whole_groups(batches, "unit", 256):
            for _, g in df.groupby("unit", sort=False):
                rep = g["rep"].to_numpy()
                label = linked_labels(list(g["sh"]), percent)
                own = label != np.arange(len(label))
                yield pd.DataFrame({"a": rep[label[own]], "b": rep[own]})

    return run


def linked_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set the least number of one that links of 100 * intersection >= percent * union connect it with.

    Sets are compared with all others one by one, through lists of the sets that hold a shingle, until every set outside
    of the largest component has been: then no two components can have a link between them.
    """
    k = len(sets)
    n = np.array([len(x) for x in sets], np.int64)
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), n)[np.argsort(column, kind="stable")]
    start, first = np.cumsum(count) - count, np.cumsum(n) - n
    label, done = np.arange(k), np.zeros(k, bool)
    while True:
        size = np.bincount(label, minlength=k)
        open_ = np.flatnonzero(~done & (label != size.argmax()))
        if not len(open_):
            return label
        i = int(open_[0])
        done[i] = True
        mine = column[first[i] : first[i] + n[i]]
        mine = mine[count[mine] > 1]
        if not len(mine):
            continue
        held, ends = count[mine], np.cumsum(count[mine])
        both = np.bincount(owner[np.arange(ends[-1]) + np.repeat(start[mine] - ends + held, held)], minlength=k)
        both[i] = n[i]
        near = np.flatnonzero(100 * both >= percent * (n + n[i] - both))
        low = label[near].min()
        label[np.isin(label, np.unique(label[near]))] = low


def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges (``a``, ``b``) of a table, at most ``IN_ONE_TASK``: (``id``, ``comp``) of their ends."""
    held = [b[["a", "b"]].to_numpy() for b in batches if len(b)]
    if held:
        ids, at = np.unique(np.concatenate(held), return_inverse=True)
        at = at.reshape(-1, 2)
        yield pd.DataFrame({"id": ids, "comp": ids[joined_labels(len(ids), at[:, 0], at[:, 1])]})


def components(edges: DataFrame) -> DataFrame:
    """(``id``, ``comp``) of each end of ``edges`` (a, b): ``comp`` is the least id that it is connected with.

    While there are more than ``IN_ONE_TASK`` edges, every vertex moves to the neighbour that comes first in a random order,
    or stays if it does itself, and edges are contracted; the order makes their number fall geometrically. The rest is
    connected in one task, whose memory the bound holds.
    """
    edges = common.cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    steps: list[DataFrame] = []
    while edges.count() > IN_ONE_TASK:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = ends.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("to"))
        step = common.cut(best.select(F.col("a").alias("id"), F.least("m", own)["to"].alias("to")))
        steps.append(step)
        first, second = step.select(F.col("id").alias("a"), F.col("to").alias("ta")), step.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(first, "a").join(second, "b")
        edges = common.cut(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    last = edges.coalesce(1).mapInPandas(connect, "id long, comp long")
    if not steps:
        return common.cut(last)
    label = steps[0]
    for step in [*steps[1:], last.withColumnRenamed("comp", "to")]:
        label = label.join(step.select(F.col("id").alias("to"), F.col("to").alias("next")), "to", "left").select("id", F.coalesce("next", "to").alias("to"))
    label = common.cut(label)
    least = label.groupBy("to").agg(F.min("id").alias("comp"))
    return common.cut(label.join(least, "to").select("id", "comp"))


def with_set(nodes: DataFrame, side: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (``node``, ``rep``, ...) with the columns of ``side`` (``rep``, ...): joined once for each rep, to the list of its rows."""
    held = F.collect_list(F.struct(*[c for c in nodes.columns if c != "rep"])).alias("_x")
    made = nodes.groupBy("rep").agg(held).join(side, "rep", how).withColumn("_x", F.explode("_x"))
    return made.select("rep", "_x.*", *[c for c in side.columns if c != "rep"])


class Join:
    """A near-duplicate join under way: the classes of equal sets, and the links confirmed so far."""

    def __init__(self, texts: DataFrame, k: int, percent: int, seed: int = 1):
        self.texts, self.k, self.percent, self.seed = texts, k, percent, seed
        self.rows = common.cut(features(texts, k, seed))
        first = [F.first(c).alias(c) for c in ("n", "sketch", "roots")]
        self.classes = common.cut(self.rows.where("n > 0 and id is not null").groupBy("s0", "s1").agg(F.min("id").alias("rep"), *first))
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None

    def run(self) -> None:
        nodes = self.classes.select("rep", "n", F.explode("roots").alias("node"))
        for depth in range(1, DEPTH + 1):
            nodes = common.cut(self.sized(nodes))
            part = F.pmod(F.xxhash64("rep", "node"), F.col("parts"))
            self.take(nodes.withColumn("node", F.when(F.col("parts") == 1, F.col("node")).otherwise(F.xxhash64("node", part))))
            large = nodes.where("parts > 1")
            if large.isEmpty():
                return
            large = common.cut(self.unsettled(large))
            now = F.lit(depth == DEPTH) | (F.col("outside") <= 2 * SMALL)
            if not (few := large.where(now)).isEmpty():
                self.take(self.completed(few))
            nodes = large.where(~now)
            if nodes.isEmpty():
                return
            nodes = self.branch(nodes.select("node", "rep", "n"), self.seed + 2 * depth)

    def branch(self, nodes: DataFrame, seed: int) -> DataFrame:
        """Each row once for each of the two places that its node chooses; ``node`` becomes the child's."""
        rows = with_set(nodes, self.classes.select("rep", "sketch"))
        first = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(PLACES)).cast("int")
        second = ((F.col("_c") + 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "node"), F.lit(PLACES - 1))) % PLACES).cast("int")
        rows = rows.withColumn("_c", first).withColumn("_c", F.explode(F.array("_c", second)))
        child = F.xxhash64("node", "_c", F.substring("sketch", 2 * F.col("_c") + 1, F.lit(2)))
        return rows.select("rep", "n", child.alias("node"))

    def sized(self, nodes: DataFrame) -> DataFrame:
        """The rows of nodes of more than one set, with ``parts``, in how many pieces a node is compared."""
        sums = {"size": (F.count("*"), F.sum("_p_size")), "total": (F.sum("n"), F.sum("_p_total"))}
        rows = common.group_lookup(nodes, ["node"], common.salted("rep"), sums, having="size > 1")
        parts = F.ceil(F.greatest(F.col("size") / SMALL, F.col("total") / SMALL_SHINGLES))
        return rows.select("node", "rep", "n", parts.alias("parts"))

    def labelled(self, rows: DataFrame) -> DataFrame:
        """Add ``comp``, the component that the set is in by now."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("rep"))
        return with_set(rows, self.comps.withColumnRenamed("id", "rep"), "left").withColumn("comp", F.coalesce("comp", "rep"))

    def unsettled(self, nodes: DataFrame) -> DataFrame:
        """The rows of nodes with more than one component, with ``comp``, the node's largest component ``main``, the number of sets
        ``outside`` of it, and the ``rests`` these are dealt into."""
        nodes = common.cut(self.labelled(nodes))
        by = nodes.groupBy("node", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
        top = by.groupBy("node").agg(F.max(F.struct("c", "comp", "m")).alias("top"), F.sum("c").alias("all"), F.sum("m").alias("total"))
        outside, left = F.col("all") - F.col("top.c"), F.col("total") - F.col("top.m")
        rests = F.ceil(F.greatest(outside / SMALL, left / SMALL_SHINGLES))
        top = top.select("node", F.col("top.comp").alias("main"), outside.alias("outside"), rests.alias("rests")).where("outside > 0")
        return common.tell(nodes, ["node"], common.salted("rep"), top)

    def completed(self, nodes: DataFrame) -> DataFrame:
        """Pieces of nodes in which every two sets of different components meet: all sets, in parts, with those outside of the largest component, in rests."""
        part, rest = F.pmod(F.xxhash64("rep", "node"), F.col("parts")), F.pmod(F.xxhash64("node", "rep"), F.col("rests"))
        every = nodes.withColumn("_p", part).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)))
        others = nodes.where("comp <> main").withColumn("_r", rest).withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        return every.unionByName(others.select(*every.columns)).select(F.xxhash64("node", "_p", "_r").alias("node"), "rep", "n")

    def take(self, nodes: DataFrame) -> None:
        """Compare the pairs of each node, confirm what they suggest, and add the links."""
        dealt = with_set(nodes.select("node", "rep", "n"), self.classes.select("rep", "sketch")).repartition("node").sortWithinPartitions("node", "n", "rep")
        found = common.cut(dealt.select("node", "rep", "n", "sketch").mapInPandas(suggest, "gid long, rep long").distinct())
        if found.isEmpty():
            return
        # groups that are in one component already add nothing
        found = common.cut(self.labelled(found)) if self.comps is not None else self.labelled(found)
        spans = {"a": (F.min("rep"), F.min("_p_a")), "lo": (F.min("comp"), F.min("_p_lo")), "hi": (F.max("comp"), F.max("_p_hi"))}
        found = common.cut(common.group_lookup(found, ["gid"], common.salted("rep"), spans, having="lo < hi").select("gid", "rep", "a"))
        if found.isEmpty():
            return
        like = components(found.select("a", F.col("rep").alias("b")))
        like = common.cut(self.classes.select(F.col("rep").alias("id"), "n").join(like, "id"))
        sums = like.groupBy("comp").agg(F.count("*").alias("c"), F.sum("n").alias("m"))
        sums = sums.select("comp", ((F.col("c") <= UNIT_SETS) & (F.col("m") <= UNIT_SHINGLES)).alias("small"))
        like = common.cut(common.tell(like, ["comp"], common.salted("id"), sums).select(F.col("id").alias("rep"), "comp", "small"))
        units = like.where("small").select("rep", F.array(F.xxhash64(F.lit("c"), "comp")).alias("units"))
        gids = found.groupBy("rep").agg(F.collect_list(F.xxhash64(F.lit("g"), "gid")).alias("units"))
        units = units.unionByName(gids.join(like.where("not small").select("rep"), "rep"))
        joined = units.join(self.sets(like.select(F.col("rep").alias("id"))), "rep").select("rep", F.explode("units").alias("unit"), "sh")
        joined = joined.repartition("unit").sortWithinPartitions("unit", "rep")
        links = common.cut(joined.select("unit", "rep", "sh").mapInPandas(confirm(self.percent), "a long, b long").distinct())
        self.links = links if self.links is None else self.links.unionByName(links)
        self.comps = components(self.links)

    def sets(self, ids: DataFrame) -> DataFrame:
        """(``rep``, ``sh``): the shingles of the texts with these ids."""
        k = self.k

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hashes = WordHash()
            for b in batches:
                yield pd.DataFrame({"rep": b["id"], "sh": [shingles(x, k, hashes).astype(np.int64) for x in b["text"]]})

        few = ids.count() <= BROADCAST_IDS
        return self.texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").mapInPandas(run, "rep long, sh array<long>")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """One row per row: its id, ``n_shingles``, ``component_id``, ``kept`` (the row with its component's least id) and
    ``text_xxhash64``.

    Rows are linked if the sets of distinct ``k``-word shingles of their whole texts have 100 * intersection >=
    ``percent`` * union; components are what links connect. ``percent`` is 80 or more: the number of trees is made for
    that. Texts without words, and null texts, have no shingles and are their own component; so are rows with a null id
    (a null ``component_id``, kept). Rows that repeat an id and text are alike, so both are kept or neither. The id is an
    integer. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    join = Join(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), k, percent, seed)
    join.run()
    classes = join.classes.select("s0", "s1", "rep")
    if join.comps is not None:
        classes = classes.join(join.comps.withColumnRenamed("id", "rep"), "rep", "left").select("s0", "s1", F.coalesce("comp", "rep").alias("rep"))
    linked = join.rows.where("n > 0 and id is not null").select("id", "n", "s0", "s1", "t")
    linked = common.tell(linked, ["s0", "s1"], common.salted("id"), classes).select("id", "n", "t", "rep")
    rest = join.rows.where("not (n > 0 and id is not null)").select("id", "n", "t", F.col("id").alias("rep"))
    return linked.unionByName(rest).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("rep").alias("component_id"), F.col("id").eqNullSafe(F.col("rep")).alias("kept"), F.col("t").alias("text_xxhash64"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=2).drop("text_xxhash64")
