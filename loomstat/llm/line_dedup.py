"""Line deduplication by content-defined chunks of lines, with DataFrame functions only.

A rolling hash over the hashes of neighbouring lines chooses boundaries, so that a passage is cut at the same places wherever it
stands and whatever stands around it. Two ways. ``dedup_lines``: chunks end after one line in four; it loses what lies before the
first and behind the last boundary of a shared passage, and short passages altogether. ``dedup_passages``, which the
query uses: in each shortest run of lines with over ``PASSAGE_WORDS`` words the boundary with the least rolling hash is chosen. Chunks
are the shortest runs that chose it, so every shared passage is covered by chunks in it. Only chunks whose boundary occurs
more than once are read further; of equal ones the lines are compared byte for byte, and chunks that overlap grow into
the longest repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A chunk ends after a line whose rolling hash, the sum of the codes of the first digits of its hash and of the hash before,
#: is divisible by this: after one line in four.
EVERY = 4
#: Hashes of repeated chunks that are broadcast at most; more are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Documents that lose lines, and runs that they lose, that are broadcast at most; more are joined by a shuffle.
BROADCAST_GONE, BROADCAST_RUNS = 500_000, 2_000_000
#: A passage has more words than this.
PASSAGE_WORDS = 50


def with_chunks(rows: DataFrame, text: Column) -> DataFrame:
    """Add ``_lines``, their hashes ``_h``, and ``_ends``, the 1-based numbers of lines that end a chunk; null where ``text`` is.

    The rolling hash of a line is over its hash and the one before; the last line ends a chunk too.
    """
    rows = rows.withColumn("_lines", F.split(text, "\n", -1))
    rows = rows.withColumn("_h", F.transform("_lines", lambda x: F.substring(F.md5(x.cast("binary")), 1, 16)))

    first = F.filter(F.array(F.lit("")), lambda _: F.size("_h") > 0)
    pairs = F.arrays_zip(F.col("_h").alias("h"), F.slice(F.concat(first, "_h"), F.lit(1), F.size("_h")).alias("p"), F.sequence(F.lit(1), F.size("_h")).alias("i"))

    def ends(z: Column) -> Column:
        last = F.size(z)
        return F.transform(F.filter(z, lambda x: (x.i == last) | ((F.ascii(x.h) + F.ascii(x.p)) % EVERY == 0)), lambda x: x.i)

    return rows.withColumn("_ends", F.when(F.size("_h") > 0, common.let(pairs, ends)))


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return with_chunks(rows.withColumn("_t", F.xxhash64("_text")), F.col("_text")).drop("_text")


def exploded(rows: DataFrame, min_lines: int) -> DataFrame:
    """A row for each chunk of ``min_lines`` lines or more, with its number ``_j``, first line ``_from``, length ``_len`` and hash ``_c``."""
    rows = rows.select("_id", "_t", "_lines", "_h", "_ends", F.posexplode("_ends").alias("_j", "_end"))
    rows = rows.withColumn("_from", F.coalesce(F.get("_ends", F.col("_j") - 1), F.lit(0)) + 1)
    rows = rows.withColumn("_len", F.col("_end") - F.col("_from") + 1).where(F.col("_len") >= min_lines)
    return rows.withColumn("_c", F.xxhash64(F.slice("_h", F.col("_from"), F.col("_len"))))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2) -> DataFrame:
    """One row per row: its id, ``text`` without removed lines, ``n_lines`` and ``n_removed``.

    Removed are chunks of ``min_lines`` lines or more, with a word, whose bytes occur more than once in all documents;
    the occurrence in the least id (null last), then the earliest, stays. Null texts are empty; an empty text has no lines.
    Rows that repeat id and text are one document, cleaned alike. What is left of a text is joined by newlines; a text
    that loses nothing is unchanged, one that loses all is empty. An empty table gives an empty result.
    """
    once = exploded(chunked(docs, id_col, text_col), min_lines).select("_c")
    repeated = common.cut(once.groupBy("_c").agg(F.count("*").alias("n")).where("n > 1").select("_c"))
    few = repeated.count() <= BROADCAST_HASHES
    held = exploded(chunked(docs, id_col, text_col), min_lines).join(F.broadcast(repeated) if few else repeated, "_c", "left_semi")
    held = held.select("_c", "_id", "_t", "_j", "_len", F.array_join(F.slice("_lines", F.col("_from"), F.col("_len")), "\n").alias("_chunk"))
    held = held.where(F.col("_chunk").rlike(r"[^\x20\x09-\x0D]"))
    at = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_t").alias("t"), F.col("_j").alias("j"))
    held = common.cut(held.withColumn("_at", at))
    held = common.group_lookup(held, ["_c", "_chunk"], common.salted("_id", "_t", "_j"), {"_first": (F.min("_at"), F.min("_p__first"))})
    gone = held.where(F.col("_at") != F.col("_first")).select("_id", "_t", "_j", "_len").distinct()
    gone = gone.groupBy("_id", "_t").agg(F.collect_list("_j").alias("_gone"), F.sum("_len").cast("long").alias("n_removed"))
    gone = gone.withColumnsRenamed({"_id": "_gid", "_t": "_gt"})
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_t", F.xxhash64("text"))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_t") == F.col("_gt")), "left")
    rows = with_chunks(rows, F.when(F.col("_gone").isNotNull(), F.col("text")))
    starts = F.transform(F.slice(F.concat(F.array(F.lit(0)), "_ends"), F.lit(1), F.size("_ends")), lambda e: e + 1)
    numbered = F.arrays_zip(starts.alias("from"), F.col("_ends").alias("to"), F.sequence(F.lit(0), F.size("_ends") - 1).alias("j"))
    left = F.filter(numbered, lambda x: ~F.array_contains("_gone", x.j))
    cut_out = common.let(F.struct(F.col("_lines").alias("l"), left.alias("x")), lambda v: F.flatten(F.transform(v.x, lambda x: F.slice(v.l, x["from"], x.to - x["from"] + 1))))
    kept = F.array_join(cut_out, "\n")
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines.alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def line_hash(line: Column) -> Column:
    """Of a line's bytes. Lines with equal hashes are told apart by :func:`dedup_passages`, however many there are."""
    return F.xxhash64(line.cast("binary"))


def long_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Texts that can hold a passage, as ``_id``, ``_text`` and its hash ``_t``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = rows.where((F.length("_text") > 2 * PASSAGE_WORDS) & F.contains("_text", F.lit("\n")))  # shorter ones have no two lines with as many words
    return rows.withColumn("_t", F.xxhash64("_text"))


def chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """For each line with a word the shortest runs of two such lines or more with over ``PASSAGE_WORDS`` words that begin and that end with
    it: ``_from`` and ``_to`` (1-based line numbers), ``_r``, the least rolling hash of the boundaries between its lines, and ``_p``, a number for
    the place of that boundary.

    A shared run of over ``PASSAGE_WORDS`` words is covered by the shortest runs inside it, so nothing longer is needed.
    """
    told = F.transform(F.split("_text", "\n", -1), lambda x: F.struct(line_hash(x).alias("d"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("w")))
    rows = long_texts(docs, id_col, text_col).select("_id", "_t", told.alias("_l")).groupBy("_id", "_t").agg(F.first("_l").alias("_l"))
    rows = rows.select("_id", "_t", F.posexplode("_l").alias("_i", "_x")).where("_x.w > 0").select("_id", "_t", (F.col("_i") + 1).alias("_i"), F.col("_x.d").alias("_d"), F.col("_x.w").alias("_w"))
    of = Window.partitionBy("_id", "_t")
    rows = rows.withColumn("_e", F.sum("_w").over(of.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))  # words up to its end
    rows = rows.withColumn("_s", F.col("_e") - F.col("_w"))
    ahead, back = of.orderBy("_s"), of.orderBy("_e")
    rolling = F.xxhash64(F.lag("_d").over(ahead), F.col("_i") - F.lag("_i").over(ahead), "_d")
    rows = rows.withColumn("_rb", F.when(F.lag("_i").over(ahead).isNotNull(), F.struct(rolling.alias("r"), F.col("_i").alias("i"))))  # the boundary before it
    rows = rows.withColumn("_ra", F.lead("_rb").over(ahead))  # and the one behind it
    # lines have a word each, so a frame has at most PASSAGE_WORDS + 1 of them; a line that is long enough alone takes a neighbour
    in_ahead, in_back = ahead.rangeBetween(0, PASSAGE_WORDS), back.rangeBetween(-PASSAGE_WORDS, 0)
    rows = rows.select(
        "_id", "_t", "_i", "_s", "_e", F.max("_i").over(in_ahead).alias("_last"), F.max("_e").over(in_ahead).alias("_laste"), F.lead("_i").over(ahead).alias("_nexti"), F.lead("_e").over(ahead).alias("_nexte"),
        F.min("_i").over(in_back).alias("_first"), F.min("_s").over(in_back).alias("_firsts"), F.lag("_i").over(ahead).alias("_prei"), F.lag("_s").over(ahead).alias("_pres"),
        F.coalesce(F.min("_rb").over(ahead.rangeBetween(1, PASSAGE_WORDS)), "_ra").alias("_fr"), F.coalesce(F.min("_ra").over(back.rangeBetween(-PASSAGE_WORDS, -1)), "_rb").alias("_br"),
    )
    alone = F.col("_last") == F.col("_i"), F.col("_first") == F.col("_i")
    forth = F.struct(F.col("_i").alias("a"), F.when(alone[0], F.col("_nexti")).otherwise(F.col("_last")).alias("b"), (F.when(alone[0], F.col("_nexte")).otherwise(F.col("_laste")) - F.col("_s")).alias("n"), F.col("_fr").alias("r"))
    hence = F.struct(F.when(alone[1], F.col("_prei")).otherwise(F.col("_first")).alias("a"), F.col("_i").alias("b"), (F.col("_e") - F.when(alone[1], F.col("_pres")).otherwise(F.col("_firsts"))).alias("n"), F.col("_br").alias("r"))
    rows = rows.select("_id", "_t", F.explode(F.filter(F.array_distinct(F.array(forth, hence)), lambda r: r["n"] > PASSAGE_WORDS)).alias("_x"))
    return rows.select("_id", "_t", F.col("_x.a").alias("_from"), F.col("_x.b").alias("_to"), F.col("_x.r.r").alias("_r"), F.xxhash64("_id", "_t", "_x.r.i").alias("_p"))


def by_text(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (``_id``, ``_t``) with ``_spans``, the array of what ``spans`` has for a text; others go. The list is broadcast where it is small."""
    listed = common.cut(spans.groupBy(F.col("_id").alias("_gid"), F.col("_t").alias("_gt")).agg(F.collect_list(F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))).alias("_spans")))
    n, spans_n = listed.agg(F.count("*"), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    listed = F.broadcast(listed) if n <= BROADCAST_GONE and spans_n <= BROADCAST_RUNS else listed.hint("shuffle_hash")
    return rows.join(listed, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_t") == F.col("_gt")))


def keyed(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, exact: bool) -> DataFrame:
    """Chunks ``spans`` with their ``_key``: the hashes of their lines, null for those without a word, or with ``exact`` their bytes."""
    rows = by_text(long_texts(docs, id_col, text_col), spans).dropDuplicates(["_id", "_t"])
    blank = lambda x: ~x.rlike(r"[^\x20\x09-\x0D]")
    line = (lambda x: F.when(~blank(x), x)) if exact else (lambda x: F.when(~blank(x), line_hash(x)))
    told = common.let(F.struct(F.transform(F.split("_text", "\n", -1), line).alias("h"), F.col("_spans").alias("x")), lambda v: F.transform(v["x"], lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), F.slice(v["h"], x["a"], x["b"] - x["a"] + 1).alias("k"))))
    rows = rows.select("_id", "_t", F.explode(told).alias("_x"))
    return rows.select("_id", "_t", F.col("_x.a").alias("_from"), F.col("_x.b").alias("_to"), F.col("_x.k").alias("_key"))


def shared_hashes(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes ``_d`` of lines in ``spans`` that lines of different bytes have: all bytes of a hash are compared."""
    rows = by_text(long_texts(docs, id_col, text_col), spans)
    lines = F.array_distinct(F.flatten(common.let(F.struct(F.split("_text", "\n", -1).alias("l"), F.col("_spans").alias("x")), lambda v: F.transform(v["x"], lambda x: F.slice(v["l"], x["a"], x["b"] - x["a"] + 1)))))
    lines = rows.select(F.explode(lines).alias("_line")).where(F.col("_line").rlike(r"[^\x20\x09-\x0D]")).select(line_hash(F.col("_line")).alias("_d"), "_line")
    return lines.groupBy("_d", "_line").agg(F.count("*").alias("n")).groupBy("_d").agg(F.count("*").alias("n")).where("n > 1").select("_d")


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``text`` without removed lines, ``n_lines`` and ``n_removed``, as :func:`dedup_lines` gives them.

    Removed is each line of a run of two lines with words or more, with over ``PASSAGE_WORDS`` words in all, that also occurs at
    an earlier place: in a lesser id (null last), or further up without a line in common, so that the first occurrence stays whole.
    Lines are compared byte for byte, blank ones between them by their number. Null texts, repeated rows, empty tables and what
    is left of a text are as in :func:`dedup_lines`. Texts that lose nothing aren't shuffled while the list of what goes is small
    (``BROADCAST_GONE``).
    """
    place = ["_id", "_t", "_from", "_to"]
    salt = common.salted("_id", "_t", "_from")
    made = common.cut(chunks(docs, id_col, text_col))
    open_ = common.cut(made.groupBy("_r").agg(F.min("_p").alias("a"), F.max("_p").alias("b")).where("a <> b").select("_r"))
    few = open_.count() <= BROADCAST_HASHES
    held = made.join(F.broadcast(open_) if few else open_, "_r", "left_semi").select(*place)
    held = common.cut(keyed(docs, held, id_col, text_col, False))
    held = common.cut(common.group_lookup(held, ["_key"], salt, {"_n": (F.count("*"), F.sum("_p__n"))}, "_n > 1").drop("_n"))
    doubtful = common.cut(shared_hashes(docs, longest(held), id_col, text_col))
    held = held.withColumn("_bytes", F.lit(None).cast("array<string>"))
    if not doubtful.isEmpty():  # chunks with such a line are compared by all of their bytes
        lines = held.select(*place, F.explode("_key").alias("_d")).join(doubtful, "_d", "left_semi").select(*place).distinct()
        told = keyed(docs, lines, id_col, text_col, True).select(*[F.col(c).alias(f"_q{c}") for c in place], F.col("_key").alias("_exact"))
        same = F.col("_id").eqNullSafe(F.col("_q_id")) & (F.col("_t") == F.col("_q_t")) & (F.col("_from") == F.col("_q_from")) & (F.col("_to") == F.col("_q_to"))
        held = held.join(told, same, "left").select(*place, "_key", F.col("_exact").alias("_bytes"))
    none = F.col("_bytes").isNull()
    held = common.cut(held.select(*place, "_key", none.alias("_same"), F.coalesce("_bytes", F.array().cast("array<string>")).alias("_bytes")))
    at = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_t").alias("t"), F.col("_from").alias("i"), F.col("_to").alias("j"))
    held = common.group_lookup(held.withColumn("_at", at), ["_key", "_same", "_bytes"], salt, {"_first": (F.min("_at"), F.min("_p__first"))})
    elsewhere = ~F.col("_id").eqNullSafe(F.col("_first.id")) | (F.col("_t") != F.col("_first.t"))
    gone = longest(held.where(elsewhere | (F.col("_from") > F.col("_first.j"))))
    gone = gone.groupBy(F.col("_id").alias("_gid"), F.col("_t").alias("_gt")).agg(F.array_sort(F.collect_list(F.struct(F.col("_from").alias("a"), F.col("_to").alias("b")))).alias("_gone"), F.sum(F.col("_to") - F.col("_from") + 1).cast("long").alias("n_removed"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_t", F.xxhash64("text"))
    gone = common.cut(gone)
    n, runs = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("_gone")), F.lit(0))).first()
    gone = F.broadcast(gone) if n <= BROADCAST_GONE and runs <= BROADCAST_RUNS else gone.hint("shuffle_hash")
    rows = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_t") == F.col("_gt")), "left")
    n_lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    # what stays lies between the ends of one removed run and the start of the next
    starts = F.concat(F.array(F.lit(1)), F.transform("_gone", lambda g: g["b"] + 1))
    ends = F.concat(F.transform("_gone", lambda g: g["a"] - 1), F.array(n_lines.cast("int")))
    left = F.struct(F.split("text", "\n", -1).alias("l"), F.arrays_zip(starts.alias("a"), ends.alias("b")).alias("x"))
    kept = F.array_join(common.let(left, lambda v: F.flatten(F.transform(v["x"], lambda x: F.slice(v["l"], x["a"], x["b"] - x["a"] + 1)))), "\n")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept).alias("text"), n_lines.alias("n_lines"), F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"))


def longest(spans: DataFrame) -> DataFrame:
    """Spans of lines of a text that overlap, as one."""
    before = Window.partitionBy("_id", "_t").orderBy("_from", "_to")
    apart = F.coalesce(F.col("_from") > F.max("_to").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    spans = spans.withColumn("_new", apart.cast("int")).withColumn("_k", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("_id", "_t", "_k").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = dedup_passages(common.table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: CASE WHEN regexp_matches(x, '[^\x20\x09-\x0D]') THEN x ELSE '' END) AS same FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM t),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
p AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w),
v AS (SELECT doc_id, i, p, p - w AS s FROM p WHERE w > 0),
x AS (SELECT a.doc_id, a.i AS a, min(b.i) AS b FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i > a.i AND b.p - a.s > 50 GROUP BY a.doc_id, a.i
  UNION SELECT b.doc_id, max(a.i), b.i FROM v a JOIN v b ON a.doc_id = b.doc_id AND b.i > a.i AND b.p - a.s > 50 GROUP BY b.doc_id, b.i),
f AS (SELECT doc_id, a, b, first_value(doc_id) OVER w AS d, first_value(b) OVER w AS e FROM x JOIN t USING (doc_id) WINDOW w AS (PARTITION BY array_to_string(same[a:b], chr(10)) ORDER BY doc_id, a)),
r AS (SELECT doc_id, a, b, doc_id <> d OR a > e AS again FROM f),
g AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM r WHERE again),
k AS (SELECT l.doc_id, count(g.i) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE len(lines) END::BIGINT AS n_lines, n_removed, length(kept)::BIGINT AS n_chars, sha256(kept) AS text_sha256
FROM t JOIN k USING (doc_id)
"""
