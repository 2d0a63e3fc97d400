"""Language identification by known words first, then shorter and shorter character n-grams.

A word that the training rows hold adds its log frequency in each language. An unseen word is scored by the longest of
its character n-grams (with word ends marked) that are known in some language: the mean of their log frequencies.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"
ORDERS = (5, 4, 3, 2, 1)
#: Unseen words whose scores a worker remembers at most.
CACHE_WORDS = 100_000


class Table:
    """Counts by name and language in one growing array."""

    def __init__(self, langs: int):
        self.index: dict[str, int] = {}
        self.n = np.zeros((1024, langs))

    def add(self, name: str, counts: np.ndarray) -> None:
        at = self.index.setdefault(name, len(self.index))
        if at == len(self.n):
            self.n = np.concatenate([self.n, np.zeros_like(self.n)])
        self.n[at] += counts

    def logs(self, smoothing: float) -> np.ndarray:
        n = self.n[: len(self.index)] + smoothing
        return np.log(n / n.sum(axis=0)) if len(n) else n


class Model:
    """Log frequencies of words and of character n-grams by language; plain data, sent to the workers once.

    ``counts``: (word, language, n), rows of a word together.
    """

    def __init__(self, langs: list[str], counts: Iterable[tuple[str, str, int]], smoothing: float = 0.5):
        self.langs = sorted(langs)
        at = {x: i for i, x in enumerate(self.langs)}
        words, *tables = (Table(len(at)) for _ in range(1 + len(ORDERS)))
        for word, rows in groupby(counts, lambda r: r[0]):
            n = np.zeros(len(at))
            for _, lang, k in rows:
                n[at[lang]] += k
            if n.sum() > 1:
                words.add(word, n)
            for t, k in zip(tables, ORDERS, strict=True):
                for g in grams(word, k):
                    t.add(g, n)
        self.words, *self.grams = (t.index for t in (words, *tables))
        self.word_scores, *self.gram_scores = (t.logs(smoothing) for t in (words, *tables))

    def unseen(self, word: str) -> np.ndarray:
        for k, index, scores in zip(ORDERS, self.grams, self.gram_scores, strict=True):
            if known := [i for g in grams(word, k) if (i := index.get(g)) is not None]:
                return scores[known].mean(axis=0)
        return np.zeros(len(self.langs))


def grams(word: str, k: int) -> list[str]:
    marked = f"^{word}$" if k > 1 else word
    return [marked[i : i + k] for i in range(len(marked) - k + 1)]


class Scorer(dict):
    """Of one worker: the row of each word in a table of scores; unseen words are added as they come."""

    def __init__(self, model: Model):
        super().__init__(model.words)
        self.model = model
        self.table = np.empty((2 * len(model.words) + 1024, len(model.langs)))
        if model.words:
            self.table[: len(model.words)] = model.word_scores

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[at] = self.model.unseen(word)
        self[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall(text.lower()) if text else []
        if not any(c.isalpha() for w in words for c in w) or not self.model.langs:
            return UNDETERMINED, 0.0
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        total = self.table[at].sum(axis=0)
        if len(self) > len(self.model.words) + CACHE_WORDS:
            self.clear()
            self.__init__(self.model)
        share = np.exp(total - total.max())
        share /= share.sum()
        best = int(share.argmax())
        return self.model.langs[best], float(share[best])


def remainder(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 1000, seed: int = 1) -> Model:
    """Fit on about ``rows_per_lang`` whole texts of each language, drawn by a hash of the id (the documented bound).

    Rows whose ``crc32(id as text) % 4`` is 2 are held out; rows with null id, text or language aren't learned from.
    Words seen once in the sample count as n-grams only. The sample bounds what reaches the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    rows = rows.where(remainder("id") != 2)
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], [])
    limit = F.create_map(*chain.from_iterable((F.lit(k), F.lit(min(1.0, rows_per_lang / n))) for k, n in sizes.items()))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < limit[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = Counter()
            for lang, text in zip(b["lang"], b["text"], strict=True):
                n.update((lang, w) for w in WORD.findall(text.lower()))
            yield pd.DataFrame([(lang, w, k) for (lang, w), k in n.items()], columns=["lang", "word", "n"])

    common.small_batches(docs.sparkSession)
    counts = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    told = counts.select("word", "lang", "n").orderBy("word", "lang").toArrow()
    return Model(list(sizes), (row for b in told.to_batches(max_chunksize=10_000) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)))


def told(spark: SparkSession, model: Model, text_col: str) -> Column:
    """A struct of ``lang_pred`` and ``score`` of the whole text, from nothing else."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for b in texts:
            yield pd.DataFrame([scorer.predict(x) for x in b], columns=["lang_pred", "score"])

    return run(F.col(text_col))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``lang_pred`` and ``score`` (the share of the best language's likelihood, 0 to 1).

    Null texts and texts without a letter are ``und`` with score 0; so are all texts if nothing could be learned. Ties go
    to the first language by code point. Repeated rows get the same; an empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    made = rows.withColumn("_told", told(docs.sparkSession, model, "_text"))
    return made.select(F.col("_id").alias(id_col), "_told.lang_pred", "_told.score")


def op1_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    made = predict(docs.select("doc_id", "text"), train(docs))
    return made.select("doc_id", F.coalesce(remainder("doc_id") == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
