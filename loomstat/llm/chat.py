"""Chat formatting as relational expressions.

Turn structs are collected by conversation and sorted; adjacent turns of one role are merged into a block with array
functions; blocks are concatenated. Everything is a Spark expression.

Template. A block is ``### <role>: <text></turn>`` and a newline; inside it ``<next>`` parts the texts of merged turns,
so that reading gives back each turn. In texts and roles a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``#``
becomes ``\\h`` (in roles ``:`` becomes ``\\c`` too), so no control string occurs in them, and the escapes have
one reading only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HEAD, COLON, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(c: Column, escapes=ESCAPES) -> Column:
    for plain, code in escapes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, escapes=ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, ``formatted`` and ``mask``.

    ``mask`` parts ``formatted`` into segments in order: structs of ``loss`` and ``chars`` (code points); those with
    ``loss`` are the escaped texts of ``loss_role`` and nothing else. Null texts and roles are empty; turns with a null
    number come first; turns with the same number are ordered by role, then text, and repeated rows are turns of their
    own. A null conversation id is a conversation. An empty table gives an empty result. Other columns aren't read.

    A conversation is one value of the result, so its turns meet in one task; an array holds it, and all steps
    take time in proportion to its turns.
    """
    rows = turns.select(F.col(conv).alias("_conv"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("_turn"))
    sorted_turns = rows.groupBy("_conv").agg(F.array_sort(F.collect_list("_turn")).alias("t"))
    blocks = sorted_turns.select("_conv", common.let(F.col("t"), _blocks).alias("b"))
    formatted = F.array_join(F.transform("b", lambda b: F.concat(F.lit(HEAD), escape(b.role, ROLE_ESCAPES), F.lit(COLON), F.array_join(b.texts, NEXT), F.lit(END))), "")
    mask = F.flatten(F.transform("b", lambda b: _segments(b, loss_role)))
    return blocks.select(F.col("_conv").alias(conv), formatted.alias("formatted"), mask.alias("mask"))


def _blocks(t: Column) -> Column:
    """Runs of turns of one role: the role and the escaped texts."""
    starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i).role != F.get(t, i - 1).role))
    spans = common.let(starts, lambda s: F.arrays_zip(s.alias("at"), F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(t))).alias("end")))
    return F.transform(spans, lambda x: F.struct(F.get(t, x["at"]).role.alias("role"), F.transform(F.slice(t, x["at"] + 1, x["end"] - x["at"]), lambda y: escape(y.text)).alias("texts")))


def _segments(b: Column, loss_role: str) -> Column:
    def seg(loss: bool, chars: Column) -> Column:
        return F.struct(F.lit(loss).alias("loss"), chars.cast("long").alias("chars"))

    head = F.length(escape(b.role, ROLE_ESCAPES)) + len(HEAD + COLON)
    inner = F.flatten(F.transform(b.texts, lambda x, i: F.array(seg(False, F.when(i == 0, head).otherwise(len(NEXT))), seg(True, F.length(x)))))
    plain = head + F.length(F.array_join(b.texts, NEXT)) + len(END)
    return F.when(b.role == loss_role, F.concat(inner, F.array(seg(False, F.lit(len(END)))))).otherwise(F.array(seg(False, plain)))


def read_turns(formatted: Column) -> Column:
    """The turns, structs of ``role`` and ``text``, that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    return F.flatten(F.transform(blocks, _read_block))


def _read_block(b: Column) -> Column:
    role = unescape(F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), COLON, 1), ROLE_ESCAPES)
    body = F.substr(b, F.locate(COLON, b) + len(COLON))
    return F.transform(F.split(body, NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped."""
    return common.let(F.struct(formatted.alias("f"), mask.alias("m")), lambda v: _under(v.f, v.m))


def _under(formatted: Column, mask: Column) -> Column:
    def step(acc: Column, seg: Column) -> Column:
        at = acc.at + seg.chars
        return F.struct(at.alias("at"), F.when(seg.loss, F.concat(acc.spans, F.array(F.struct(acc.at.alias("at"), seg.chars.alias("chars"))))).otherwise(acc.spans).alias("spans"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<at:bigint,chars:bigint>>").alias("spans"))
    spans = F.aggregate(mask, start, step, lambda acc: acc.spans)
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, (x.at + 1).cast("int"), x.chars.cast("int")))), "")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    own = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(probe).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("x")).select("x.*")
    made = format_chats(chats.unionByName(own))
    back = made.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("t"), loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    turns = F.array_join(F.transform("t", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP2_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (SELECT *, role IS DISTINCT FROM lag(role) OVER o AS starts FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS n,
  length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS r FROM w)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + CASE WHEN starts THEN r + 14 ELSE 6 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
