"""Quality rules by n-gram perplexity.

Spark counts the character n-grams of all documents by language, over whole code points, and smooths them after modified
Kneser-Ney with aggregations and joins. Scored texts are among those counted, so each of their n-grams is in the model,
which needs no contexts to fall back on: it is a table of hash and log probability that grows with the corpus. While it
is small (its entries are counted) it is sent to the workers as sorted hash arrays; beyond that the documents' n-grams
are joined with it. A document whose perplexity is outside its language's band is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of an n-gram: three code points fill a 64-bit integer.
ORDER = 3
BITS = 21
#: The band: so many interquartile ranges of log perplexity below the lower and above the upper quartile, wider for texts shorter
#: than the language's median, whose means vary more: by the root of the ratio of lengths.
BELOW, ABOVE = 3.0, 3.0
#: An interquartile range below this counts as this, so that a band is 0.06 wide at least; the four of sf0.1 have 0.03 to 0.04.
LEAST_WIDTH = 0.01
#: Entries of a model that are broadcast at most, 16 bytes each; more are joined.
BROADCAST_ENTRIES = 4_000_000
#: Languages whose few numbers are broadcast at most.
BROADCAST_LANGUAGES = 100_000
#: Distinct n-grams that a counting task holds at most.
HELD = 2_000_000
WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"


def ngrams(text: str, order: int = ORDER) -> np.ndarray:
    """For each character its code point after those of the ``order`` - 1 characters before (spaces at the start), in one integer."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(points):
        return points
    c = np.concatenate([np.full(order - 1, 32), points])
    out = c[: len(points)]
    for k in range(1, order):
        out = (out << BITS) | c[k : k + len(points)]
    return out


def hashed(lang: int, gram: np.ndarray) -> np.ndarray:
    """A 64-bit hash of language and n-gram."""
    x = gram.astype(np.uint64) ^ np.uint64(lang & ((1 << 64) - 1))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x.view(np.int64)


def counted(rows: DataFrame, order: int) -> DataFrame:
    """(``lang``, ``gram``, ``h``, ``n``): how often the rows (``lang`` long, ``text``) of a language hold each n-gram, and its hash."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                grams, n = np.unique(np.concatenate([ngrams(x, order) for x in texts]), return_counts=True)
                if lang in sums:
                    both = np.concatenate([sums[lang][0], grams])
                    grams, at = np.unique(both, return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([sums[lang][1], n]), minlength=len(grams)).astype(np.int64)
                sums[lang] = grams, n
            if sum(len(g) for g, _ in sums.values()) > HELD:
                yield from told(sums)
                sums.clear()
        yield from told(sums)

    def told(sums: dict[int, tuple[np.ndarray, np.ndarray]]) -> Iterator[pd.DataFrame]:
        for lang, (grams, n) in sums.items():
            yield pd.DataFrame({"lang": np.full(len(grams), lang, np.int64), "gram": grams, "h": hashed(int(lang), grams), "n": n})

    made = rows.mapInPandas(run, "lang long, gram long, h long, n long")
    return made.groupBy("lang", "gram").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def distinct_texts(rows: DataFrame) -> DataFrame:
    """(``lang``, ``text``) of rows (``lang``, ``t``, ``text``), each text of a language once; only repeated texts are shuffled."""
    again = common.cut(rows.groupBy("lang", "t").agg(F.count("*").alias("n")).where("n > 1").select("lang", "t"))
    listed = F.broadcast(again) if again.count() <= common.BROADCAST_DROPS else again
    once = rows.join(listed, ["lang", "t"], "left_anti").select("lang", "text")
    return once.unionByName(rows.join(listed, ["lang", "t"], "left_semi").dropDuplicates(["lang", "t"]).select("lang", "text"))


def by_language(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, a row for each language."""
    facts = common.cut(facts)
    return rows.join(F.broadcast(facts), "lang") if facts.count() <= BROADCAST_LANGUAGES else common.tell(rows, ["lang"], common.salted(*[c for c in rows.columns if c != "lang"]), facts)


def discount(level: DataFrame) -> DataFrame:
    """Add ``d``, what a count gives up: by its size, 1, 2, 3 or more, from the numbers of n-grams that the language has once to four
    times; 0.5, 0.75 and 0.9 where one of these is 0."""
    seen = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    n = {k: F.col(f"n{k}") for k in (1, 2, 3, 4)}
    few = F.least(*n.values()) == 0
    y = n[1] / (n[1] + 2 * n[2])
    d = [F.when(few, fixed).otherwise(F.least(F.greatest(k - (k + 1) * y * n[k + 1] / n[k], F.lit(0.05)), F.lit(k - 0.05))).alias(f"d{k}") for k, fixed in ((1, 0.5), (2, 0.75), (3, 0.9))]
    found = by_language(level, seen.select("lang", *d))
    return found.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))).drop("d1", "d2", "d3")


def smoothed(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(``lang``, ``gram``, ``h``, ``p``): the probability of the last character of each of ``grams`` (``lang``, ``gram``, ``h``, ``n``) after the others.

    Modified Kneser-Ney, interpolated: lower orders count how many different characters come before; the lowest is
    interpolated with an even chance for each character of the language and one more.
    """
    levels = [grams]
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        levels.append(common.cut(levels[-1].groupBy("lang", suffix.alias("gram")).agg(F.count("*").alias("n"))))
    below: DataFrame | None = None
    for k, level in enumerate(reversed(levels), 1):
        level = discount(level)
        total, weight = F.sum("n").cast("double").alias("total"), F.sum("d").alias("weight")
        if below is None:
            level = by_language(level, level.groupBy("lang").agg(total, weight, F.count("*").alias("v")))
            low = 1 / (F.col("v") + 1)
        else:
            level = level.withColumns({"context": F.shiftright("gram", BITS), "gram_": F.col("gram").bitwiseAND(F.lit((1 << (BITS * (k - 1))) - 1))})
            level = level.join(level.groupBy("lang", "context").agg(total, weight), ["lang", "context"])
            level = level.join(below.select("lang", F.col("gram").alias("gram_"), F.col("p").alias("low")), ["lang", "gram_"])
            low = F.col("low")
        p = (F.col("n") - F.col("d") + F.col("weight") * low) / F.col("total")
        below = common.cut(level.select("lang", "gram", *(["h"] if k == order else []), p.alias("p")))
    return below


def rules(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    raw = text.encode()
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if len(words) > 3:
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        w = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)[1]
        _, back, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
        again = n[back] > 1
        if again.any():
            mark = np.zeros(len(words), bool)
            for k in range(3):
                mark[k : len(words) - 2 + k] |= again
            repeat = int(mark.sum())
    return len(words), len(text) - (len(raw) - len(raw.translate(None, WHITE))), len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """One row per row: its id, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``base_failed``, ``log_perplexity`` (natural log, a character), the band's ``lower`` and ``upper`` for its length, and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated 3-word windows. Model and bands come from all
    rows, for each language and for the rows without one, each distinct text once; ``order``, 1 to 3, is the n of the
    n-grams. Quartiles are taken over the texts of a language that pass the base rules (percentile_approx, error 1e-4 of the texts), and their
    distance is ``LEAST_WIDTH`` at least; the band's edges are in it. Null texts are empty, fail the base rules and have a
    null perplexity. Repeated rows are judged alike. An empty table gives an empty result. Builds tables while the plan is made.
    """
    common.small_batches(docs.sparkSession)
    lang = F.when(F.col(lang_col).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(lang_col).cast("string")))
    rows = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    model = smoothed(common.cut(counted(distinct_texts(rows), order)), order).select("h", F.log("p").alias("log"))
    entries = None
    if model.count() <= BROADCAST_ENTRIES:
        table = model.toArrow()
        keys, logs = (table.column(c).to_numpy() for c in ("h", "log"))
        at = np.argsort(keys)
        entries = docs.sparkSession.sparkContext.broadcast((keys[at], logs[at]))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = pd.DataFrame([rules(x) for x in b["text"]], columns=names)
            for i, c in enumerate(("id", "lang", "t")):
                out.insert(i, c, b[c].to_numpy())
            out.insert(3, "n_chars", [len(x) for x in b["text"]])
            out["log_perplexity"] = [mean_log(int(lang), x) for lang, x in zip(b["lang"], b["text"], strict=True)]
            yield out

    def mean_log(lang: int, text: str) -> float:
        if entries is None or not text:
            return np.nan
        keys, logs = entries.value
        return -float(logs[np.searchsorted(keys, hashed(lang, ngrams(text, order)))].mean())

    kind = dict(docs.dtypes)[id_col]
    scored = rows.mapInPandas(score, f"id {kind}, lang long, t long, n_chars long, {', '.join(f'{n} long' for n in names)}, log_perplexity double")
    scored = scored.withColumn("log_perplexity", F.nanvl("log_perplexity", F.lit(None).cast("double")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    scored = common.cut(scored.withColumn("base_failed", failed))
    if entries is None:
        scored = scored.drop("log_perplexity").withColumn("_salt", common.salted("id"))
        logs = joined_logs(rows.select("t", "lang", "text"), model, order).withColumnRenamed("lang", "_lang").withColumnRenamed("t", "_t")
        told = scored.select("t", "lang", "_salt").distinct().join(logs, (F.col("t") == F.col("_t")) & (F.col("lang") == F.col("_lang")), "left").drop("_t", "_lang")
        scored = common.cut(scored.join(told, ["t", "lang", "_salt"]).drop("_salt"))
    texts = scored.where("not base_failed").groupBy("lang", "t").agg(F.min("log_perplexity").alias("x"), F.min("n_chars").alias("c"))
    bands = texts.groupBy("lang").agg(F.percentile_approx("x", [0.25, 0.75], 10000).alias("q"), F.percentile_approx("c", 0.5, 10000).alias("usual"))
    bands = scored.select("lang").distinct().join(bands, "lang", "left")
    made = by_language(scored, bands)
    width = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_WIDTH)) * F.greatest(F.lit(1.0), F.sqrt(F.col("usual") / F.greatest("n_chars", F.lit(1))))
    made = made.withColumns({"lower": F.col("q")[0] - below * width, "upper": F.col("q")[1] + above * width})
    kept = ~F.col("base_failed") & F.coalesce(F.col("log_perplexity").between(F.col("lower"), F.col("upper")), F.lit(False))
    return made.select(F.col("id").alias(id_col), *names, "base_failed", "log_perplexity", "lower", "upper", kept.alias("kept"))


def joined_logs(rows: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """(``t``, ``lang``, ``log_perplexity``) of each distinct text of rows (``t``, ``lang``, ``text``), by a join of its n-grams with the model."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t, lang, text in zip(b["t"], b["lang"], b["text"], strict=True):
                grams, n = np.unique(ngrams(text, order), return_counts=True)
                yield pd.DataFrame({"t": np.full(len(grams), t, np.int64), "lang": np.full(len(grams), lang, np.int64), "h": hashed(int(lang), grams), "n": n})

    grams = common.cut(rows.mapInPandas(run, "t long, lang long, h long, n long"))
    found = common.tell(grams, ["h"], common.salted("t"), model)
    return found.groupBy("t", "lang").agg((-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("log_perplexity"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = judge(common.table(spark, sf_dir, "documents"))
    return made.withColumns({c: F.round(c, 3) for c in ("log_perplexity", "lower", "upper")})


def _level(k: int) -> str:
    """SQL of the order ``k``: ``s`` holds the numbers of n-grams seen once to four times, ``d`` what counts give up, ``p`` probabilities."""
    seen = ", ".join(f"count(*) FILTER (n = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
    give = " ".join(f"WHEN {when} THEN CASE WHEN least(n1, n2, n3, n4) = 0 THEN {fixed} ELSE least(greatest({i} - {i + 1} * n1 / (n1 + 2 * n2) * n{i + 1} / n{i}, 0.05), {i} - 0.05) END" for i, fixed, when in ((1, 0.5, "n = 1"), (2, 0.75, "n = 2"), (3, 0.9, "n > 2")))
    low = "1 / (v + 1)" if k == 1 else "b.p"
    below = "" if k == 1 else f" JOIN p{k - 1} b ON b.lang = a.lang AND b.g = substr(a.g, 2)"
    return f"""s{k} AS (SELECT lang, {seen} FROM g{k} GROUP BY lang),
d{k} AS (SELECT lang, g, n, CASE {give} END::DOUBLE AS d FROM g{k} JOIN s{k} USING (lang)),
t{k} AS (SELECT lang, left(g, {k - 1}) AS c, sum(n)::DOUBLE AS total, sum(d) AS weight, count(*) AS v FROM d{k} GROUP BY ALL),
p{k} AS (SELECT a.lang, a.g, (a.n - a.d + weight * {low}) / total AS p FROM d{k} a JOIN t{k} t ON t.lang = a.lang AND t.c = left(a.g, {k - 1}){below})"""


WORDS_SQL = r"'[^\x20\x09-\x0D]+'"
OP9_SQL = rf"""
WITH r AS (SELECT row_number() OVER () AS i, doc_id, coalesce('=' || lang, '') AS lang, coalesce(text, '') AS text FROM documents),
u AS (SELECT row_number() OVER () AS i, lang, text FROM (SELECT DISTINCT lang, text FROM r)),
w AS (SELECT i, lang, text, regexp_extract_all(text, {WORDS_SQL}) AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {WORDS_SQL})) AS l FROM u),
x AS (SELECT i, unnest(range(1, len(w) - 1)) AS j, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS t FROM w WHERE len(w) > 2),
m AS (SELECT i, unnest([j, j + 1, j + 2]) AS j FROM (SELECT i, j, count(*) OVER (PARTITION BY i, t) AS n FROM x) WHERE n > 1),
o AS (SELECT i, count(DISTINCT j) AS n_repeat_words FROM m GROUP BY i),
f AS (SELECT w.i, lang, text, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN o USING (i)),
c AS (SELECT i, lang, list_concat([' ', ' '], regexp_extract_all(text, '(?s).')) AS c FROM u),
e AS (SELECT i, lang, unnest(list_transform(range(1, len(c) - 1), lambda j: c[j] || c[j + 1] || c[j + 2])) AS g FROM c WHERE len(c) > 2),
g3 AS (SELECT lang, g, count(*) AS n FROM e GROUP BY ALL),
g2 AS (SELECT lang, substr(g, 2) AS g, count(*) AS n FROM g3 GROUP BY ALL),
g1 AS (SELECT lang, substr(g, 2) AS g, count(*) AS n FROM g2 GROUP BY ALL),
{_level(1)},
{_level(2)},
{_level(3)},
a AS (SELECT i, -avg(ln(p)) AS x FROM e JOIN p3 USING (lang, g) GROUP BY i),
z AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f LEFT JOIN a USING (i)),
q AS (SELECT lang, quantile_disc(x, 0.25) AS q1, quantile_disc(x, 0.75) AS q3, quantile_disc(length(text), 0.5) AS usual FROM z WHERE NOT base_failed GROUP BY lang),
b AS (SELECT z.*, q1 - {BELOW} * width AS lower, q3 + {ABOVE} * width AS upper FROM z LEFT JOIN (SELECT * FROM q) USING (lang), LATERAL (SELECT greatest(q3 - q1, {LEAST_WIDTH}) * greatest(1.0, sqrt(usual / greatest(length(text), 1))) AS width))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(x, 3) AS log_perplexity, round(lower, 3) AS lower, round(upper, 3) AS upper, NOT base_failed AND coalesce(x BETWEEN lower AND upper, false) AS kept
FROM r JOIN b USING (lang, text)
"""
