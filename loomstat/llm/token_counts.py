"""Token counts: Arrow batches go in, lengths come out.

Texts are split where no token can span: before a space between two letters or digits, and between a sentence mark and a letter.
The pattern that cuts texts into words starts a word there in any context, and no special string holds either. Parts that a
process hasn't met are encoded together, in batches that hold about ``BATCH_BYTES`` whatever the texts' lengths, and the lengths
of short ones are kept, so that each is encoded once.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BATCH_BYTES = 1 << 18
SPLIT_CHARS = 1 << 15
#: A safe boundary is after the match. The letters listed are letters in any version of Unicode.
SAFE = re.compile(r"[^\W_](?= [^\W_])|[.,;:!?。、，；：！？](?=[A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣])")


#: Every safe boundary, as a place between two characters.
BOUNDARY = re.compile(r"(?<=[^\W_])(?= [^\W_])|(?<=[.,;:!?。、，；：！？])(?=[A-Za-zА-яぁ-ゖァ-ヺ一-龥가-힣])")
#: Parts of up to so many characters are kept with their lengths, and so many of them at most.
KEPT_CHARS, KEPT = 48, 600_000


#: Lengths of parts by vocabulary, for the tasks of a process.
_KNOWN: dict[str, dict[str, int]] = {}


def pieces(text: str, chars: int = SPLIT_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``chars``, cut at safe boundaries only; without one, it stays whole."""
    at = 0
    while len(text) - at > chars:
        m = SAFE.search(text, at + chars)
        if not m:
            break
        yield text[at : m.start() + 1]
        at = m.start() + 1
    yield text[at:]


def encoder(path: str, made: dict = {}) -> Callable[[list[str]], list[int]]:  # noqa: B006  one for each process
    """Token counts of a batch of texts by the library of the vocabulary file."""
    if path not in made:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            made[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            made[path] = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
    return made[path]


def encoded(count: Callable[[list[str]], list[int]], texts: list[str]) -> list[int]:
    """Tokens of each text, encoded in batches balanced by bytes."""
    out, part, n = [], [], 0
    for x in texts:
        part.append(x)
        n += len(x) if x.isascii() else len(x.encode())
        if n >= BATCH_BYTES:
            out += count(part)
            part, n = [], 0
    return out + count(part) if part else out


def lengths(count: Callable[[list[str]], list[int]], texts: list[str], cut: bool = True, known: dict[str, int] | None = None) -> list[int]:
    """Tokens of each text. With ``cut``, texts are split at all safe boundaries and ``known`` holds the lengths of parts met before."""
    if not cut:
        return encoded(count, texts)
    known, out, held, owner, n = {} if known is None else known, [0] * len(texts), [], [], 0

    def flush() -> None:
        fresh = list({p for parts in held for p in parts}.difference(known))
        room = max(KEPT - len(known), 0)
        known.update(zip(fresh, encoded(count, fresh), strict=True))
        for i, parts in zip(owner, held, strict=True):
            out[i] += sum(map(known.__getitem__, parts))
        for p in fresh:  # once there is no room left, what came first, the frequent parts, stays
            if len(p) > KEPT_CHARS or room <= 0:
                del known[p]
            else:
                room -= 1
        held.clear()
        owner.clear()

    for i, x in enumerate(texts):
        for p in pieces(x):
            held.append(BOUNDARY.split(p))
            owner.append(i)
            n += len(p)
            if n >= 4 * BATCH_BYTES:
                flush()
                n = 0
    flush()
    return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``n_bytes`` (UTF-8) and ``n_tokens``. Only these leave the workers.

    ``path``: a tokenizers ``.json`` or a sentencepiece ``.model``, whose texts stay whole; special strings in texts are
    handled as the library does by default. Null texts are empty and have no tokens. Rows are independent: repeats and
    null ids give rows alike. An empty table gives an empty result.
    """
    common.small_batches(docs.sparkSession)
    cut = not path.endswith(".model")
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = encoder(path), _KNOWN.setdefault(path, {})
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(lengths(count, texts, cut, known), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)
