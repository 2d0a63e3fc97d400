"""Secrets in texts: known forms by patterns, and what has the format of the credentials that these find.

Values that the patterns find are labelled credentials. Of each kind a bounded sample of different ones makes a prefix tree,
whose statistically compatible states are merged into a probabilistic automaton (after Carrasco and Oncina). Another
automaton is learnt from words that no pattern finds. Every other long word of the credentials' characters is scored by the
automata: it is a secret where one of a kind likes it about as well as that kind's own values, and far more than the words' own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds in the order of lists; the last is what the automata find.
KINDS = ["assign", "access", "hex", "format"]
#: Pattern of each kind, the group that is its value, and the least length of that.
BASE = [
    (re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 1, 6),
    (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    (re.compile(r"[0-9a-f]{24,}"), 0, 24),  # as all of [0-9a-f]+ with 24 characters or more
]
#: A text with an assignment has one of these, in either case.
KEYS = ("passw", "secret", "token", "api")
#: Words that are scored, and the fewest characters of them; marks at their ends don't count, and parts between marks are words too.
WORD_CHARS = 16
WORD = re.compile(rf"[A-Za-z0-9+/_.=-]{{{WORD_CHARS},}}")
PART = re.compile(rf"[A-Za-z0-9+_-]{{{WORD_CHARS},}}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
_CODES = bytes(max(ALPHABET.encode().find(c), 0) for c in range(256))
#: Different values of a kind, and different words, that automata are learnt from at most, drawn by hash, and the length of those.
SAMPLE, SAMPLE_CHARS = 2_000, 64
#: Fewer values of a kind than this have no automaton.
LEAST_SAMPLE = 8
#: States are compatible where shares differ by chance with this probability or more.
ALPHA = 0.01
#: A state's characters are smoothed by this share of even ones.
SMOOTH = 0.01
EVEN_BITS = math.log2(len(ALPHABET) + 1)
#: A word is a secret where a kind's automaton gives it so many bits more than the words' own does, and its characters' bits are at most so many
#: standard deviations below what as many characters of that kind's values have.
MARGIN_BITS, DEVIATIONS = 20.0, 3.0


class Automaton:
    """A probabilistic automaton: in each state the chance of each next character, and of the end."""

    def __init__(self, step: list[list[int]], bits: list[list[float]], end: list[float]):
        self.step, self.bits, self.end = step, bits, end

    def read(self, word: str) -> tuple[list[float], float]:
        """Log likelihoods in bits: of each character, and of the end. Behind a character that a state hasn't seen all are even."""
        at, bits = 0, []
        for c in word.encode().translate(_CODES):
            bits.append(self.bits[at][c] if at >= 0 else -EVEN_BITS)
            at = self.step[at][c] if at >= 0 else -1
        return bits, self.end[at] if at >= 0 else -EVEN_BITS


class _Tree:
    """Counts of a prefix tree, or of what merging made of it, by state: words that reach it, words that end, and by
    character the next state and how many go there."""

    def __init__(self, words: list[str]):
        self.seen, self.ends, self.next, self.went = [0], [0], [{}], [{}]
        for w in words:
            at = 0
            self.seen[0] += 1
            for c in w:
                self.went[at][c] = self.went[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.seen)
                    self.seen.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.went.append({})
                at = self.next[at][c]
                self.seen[at] += 1
            self.ends[at] += 1

    def alike(self, a: int, b: int) -> bool:
        """Whether what follows state b, still a tree, may be drawn as what follows a is: no share differs by more than Hoeffding's bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen[a], self.seen[b]
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[a] / n - self.ends[b] / m) > bound:
                return False
            x, y = self.went[a], self.went[b]
            if any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > bound for c in x.keys() | y.keys()):
                return False
            todo += [(self.next[a][c], t) for c, t in self.next[b].items() if c in self.next[a]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Adds b and what follows it, still a tree, to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.seen[a] += self.seen[b]
            self.ends[a] += self.ends[b]
            for c, t in self.next[b].items():
                self.went[a][c] = self.went[a].get(c, 0) + self.went[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t


def infer(words: list[str]) -> Automaton:
    """The automaton of ``words`` of the alphabet: of the states that settled ones lead to, the one seen most is merged with the first
    settled state that is compatible, or else settles itself, until all are done."""
    tree, settled = _Tree(words), {0: 0}
    while True:
        open_ = [(-tree.seen[t], number, c) for s, number in settled.items() for c, t in tree.next[s].items() if t not in settled]
        if not open_:
            break
        _, number, c = min(open_)
        s = list(settled)[number]
        t = tree.next[s][c]
        like = next((r for r in settled if tree.alike(r, t)), None)
        if like is None:
            settled[t] = len(settled)
        else:
            tree.next[s][c] = like
            tree.fold(like, t)

    def bits(k: int, n: int) -> float:
        return math.log2((1 - SMOOTH) * k / max(n, 1) + SMOOTH / (len(ALPHABET) + 1))

    step = [[settled[tree.next[s][c]] if c in tree.next[s] else -1 for c in ALPHABET] for s in settled]
    return Automaton(step, [[bits(tree.went[s].get(c, 0), tree.seen[s]) for c in ALPHABET] for s in settled], [bits(tree.ends[s], tree.seen[s]) for s in settled])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Kind (its number), start, end and value of what the patterns find, by start, then kind."""
    low, found = text.lower(), []
    for kind, (pattern, group, least) in enumerate(BASE):
        if kind or any(k in low for k in KEYS):
            found += [(m.start(), kind, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return [(k, a, b, v) for a, k, b, v in sorted(found)]


def words_apart(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """Start and word of each long word that no span touches."""
    out, taken, i, upto = [], sorted((a, b) for _, a, b, _ in spans), 0, 0
    for m in WORD.finditer(text):
        word = m[0].lstrip("+/_.=-")
        a = m.end() - len(word)
        word = word.rstrip("+/_.-")
        while i < len(taken) and taken[i][0] < a + len(word):  # upto: the farthest end of spans that start before the word ends
            upto = max(upto, taken[i][1])
            i += 1
        if len(word) >= WORD_CHARS and upto <= a:
            out.append((a, word))
    return out


FOUND = "_id {}, _base array<struct<kind: int, start: long, end: long, value: string>>, _words array<struct<start: long, word: string>>"


def found_in(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each row what the patterns find, and the long words beside it; texts stay behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, words = [], []
            for text in b.column(1):
                spans = base_spans(text := text.as_py())
                base.append([dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in spans])
                words.append([{"start": a, "word": w} for a, w in words_apart(text, spans)])
            kinds = [pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])), pa.list_(pa.struct([("start", pa.int64()), ("word", pa.string())]))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kinds[0]), pa.array(words, kinds[1])], names=["_id", "_base", "_words"])

    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return texts.mapInArrow(run, FOUND.format(dict(docs.dtypes)[id_col]))


def drawn(values: DataFrame, n: int) -> list[str]:
    """Up to ``n`` different values (of the column ``value``) by their hash, in that order."""
    short = values.where(F.length("value") <= SAMPLE_CHARS).distinct()
    return [r["value"] for r in short.orderBy(F.xxhash64("value"), "value").limit(n).collect()]


def usual(model: Automaton, values: list[str]) -> tuple[Automaton, float, float]:
    """With the mean and the standard deviation of the bits of the values' characters."""
    bits = [x for v in values for x in model.read(v)[0]]
    mean = sum(bits) / len(bits)
    return model, mean, math.sqrt(sum((x - mean) ** 2 for x in bits) / len(bits))


def learn(found: DataFrame, sample: int = SAMPLE) -> tuple[Automaton | None, list[tuple[Automaton, float, float]]]:
    """The words' automaton (none with too few words), and that of each kind with enough values, with what :func:`usual` adds."""
    words = drawn(found.select(F.explode("_words.word").alias("value")), sample)
    values, kinds = found.select(F.explode("_base").alias("x")).select("x.kind", "x.value"), []
    for k in range(len(BASE)):
        own = drawn(values.where(F.col("kind") == k).select("value"), sample)
        if len(own) >= LEAST_SAMPLE:
            kinds.append(usual(infer(own), own))
    return (infer(words) if len(words) >= LEAST_SAMPLE else None), kinds


def is_secret(word: str, words: Automaton | None, kinds: list[tuple[Automaton, float, float]]) -> bool:
    if words is None:
        return False
    bits, end = words.read(word)
    from_, n = sum(bits) + end + MARGIN_BITS, len(word)
    for model, mean, deviation in kinds:
        bits, end = model.read(word)
        if sum(bits) + end >= from_ and sum(bits) >= n * mean - DEVIATIONS * deviation * math.sqrt(n):
            return True
    return False


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per row: its id and ``spans`` (kind, start, end in code points, end exclusive), by start, then kind as ``KINDS`` lists them.

    ``assign``, ``access`` and ``hex`` are what the patterns find; ``format`` are other words of 16 characters or more, or parts of such
    between dots, slashes and equals signs, that the automata take for credentials. These are fitted on the driver, on up to ``sample`` different
    values of a kind and as many words, none longer than 64 characters; all words of whole texts are scored. A kind with fewer than 8
    values has no automaton, and with fewer than 8 words there is no ``format``. Null and empty texts have no spans. Repeated rows and null ids
    give rows alike. An empty table gives an empty result; other columns aren't read.
    """
    common.small_batches(docs.sparkSession)
    found = common.cut(found_in(docs, id_col, text_col))
    words, kinds = learn(found, sample)
    sent = docs.sparkSession.sparkContext.broadcast((words, kinds))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, others in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                spans = [(x["start"], x["kind"], x["end"]) for x in base]
                for w in others:
                    if is_secret(w["word"], *sent.value):
                        spans.append((w["start"], len(BASE), w["start"] + len(w["word"])))
                    else:
                        parts = [m for m in PART.finditer(w["word"]) if m[0] != w["word"] and is_secret(m[0], *sent.value)]
                        spans += [(w["start"] + m.start(), len(BASE), w["start"] + m.end()) for m in parts]
                out.append([{"kind": KINDS[k], "start": a, "end": z} for a, k, z in sorted(spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["_id", "spans"])

    made = found.mapInArrow(run, f"_id {dict(docs.dtypes)[id_col]}, spans array<struct<kind: string, start: long, end: long>>")
    return made.withColumnRenamed("_id", id_col)


def listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = scan(common.table(spark, sf_dir, "documents"))
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[: len(BASE)]]
    base = F.filter("spans", lambda s: s["kind"] != KINDS[-1])
    return made.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
