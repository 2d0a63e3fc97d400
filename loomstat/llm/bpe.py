"""Byte-level BPE in numpy: batched merge rounds.

The words that a batch of texts brings for the first time are encoded together. Their symbols stand in one flat array;
each round looks up the ranks of all adjacent pairs by binary search over the sorted pair keys, finds each
word's lowest rank, merges that pair wherever the word holds it, and drops words that have nothing left to merge. Texts
then get their ids, and their bytes back, by ragged gathers from tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
#: The published split pattern with its classes written out for code points under U+0250.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
PLAIN = re.compile(r"[\x00-ɏ]*\Z")
#: Words that a worker remembers at most; then it starts anew.
CACHE_WORDS = 300_000
CACHE_CHARS = 8_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)}
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[0], starts[0]+1, … of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Bpe:
    """Encoder and decoder of a ``tokenizers`` byte-level BPE file. ``merge`` and the tables are plain numpy."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_starts = {x[0] for x in self.special if x}
        self.pre = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        symbols = byte_symbols()
        self.of_symbol = {c: b for b, c in enumerate(symbols)}
        self.byte_id = np.array([vocab[c] for c in symbols], np.int32)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        keys = left << 32 | right
        order = np.argsort(keys)
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.token = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in vocab.items():
            self.token[i] = bytes(map(self.of_symbol.__getitem__, t))
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.token_len = np.array([len(t) for t in self.token], np.int64)
        self.none = np.int32(len(merges))
        self.first = self.ranks(*np.broadcast_arrays(self.byte_id[:, None], self.byte_id[None]))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size, self.chars = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64), 0

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], self.none)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and each word's number of ids."""
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym = self.byte_id[raw]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        own = np.arange(len(words))
        rank = self._byte_ranks(raw, sizes)
        while len(own):
            first = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, first) if len(rank) else rank
            open_ = low < self.none
            if not open_.all():
                keep = np.repeat(open_, sizes)
                done.append((own[~open_], sizes[~open_], sym[~keep]))
                own, sizes, low, sym, rank = own[open_], sizes[open_], low[open_], sym[keep], rank[keep]
                if not len(own):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            if len(hit) > 1:  # of a run of overlapping pairs, every other one from the left
                fresh = np.r_[True, np.diff(hit) != 1]
                at = np.arange(len(hit))
                hit = hit[(at - np.maximum.accumulate(np.where(fresh, at, 0))) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            gone = np.zeros(len(sym), bool)
            gone[hit + 1] = True
            word = np.searchsorted(np.cumsum(sizes), hit, "right")
            sizes = sizes - np.bincount(word, minlength=len(own))
            keep = ~gone
            at = hit - np.arange(len(hit))  # where the merged symbols stand once the others have gone
            sym, rank = sym[keep], rank[keep]
            ends = np.zeros(len(sym), bool)
            ends[np.cumsum(sizes) - 1] = True
            near = np.concatenate([at, at[at > 0] - 1])
            rank[near] = self.none
            near = near[~ends[near]]
            rank[near] = self.ranks(sym[near], sym[near + 1])
        ids, n = np.empty(sum(len(x[2]) for x in done), np.uint32), np.empty(len(words), np.int64)
        for o, s, _ in done:
            n[o] = s
        first = np.cumsum(n) - n
        for o, s, x in done:
            ids[ragged(first[o], s)] = x
        return ids, n

    def _byte_ranks(self, bytes_: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        rank = np.full(len(bytes_), self.none, np.int32)
        if len(bytes_) > 1:
            rank[:-1] = self.first[bytes_[:-1], bytes_[1:]]
            rank[np.cumsum(sizes) - 1] = self.none
        return rank

    def words(self, text: str) -> list[str | int]:
        """The words of ``text`` in order; special strings as their ids."""
        if not self.split_special or not any(c in text for c in self.special_starts):
            return self._plain_words(text)
        out: list[str | int] = []
        for i, part in enumerate(self.split_special.split(text)):
            out.extend([self.special[part]] if i % 2 else self._plain_words(part))
        return out

    def _plain_words(self, text: str) -> list[str]:
        if PLAIN.match(text):
            return WORDS.findall(text)
        return [bytes(map(self.of_symbol.__getitem__, w)).decode() for w, _ in self.pre(text)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, unsigned 32 bits."""
        if len(self.index) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self.clear()
        split = [self.words(x) for x in texts]
        fresh = list({w for ws in split for w in ws}.difference(self.index))
        if fresh:
            plain = [w for w in fresh if isinstance(w, str)]
            special = [w for w in fresh if not isinstance(w, str)]
            ids, n = self.merge([w.encode() for w in plain]) if plain else (np.empty(0, np.uint32), np.empty(0, np.int64))
            ids, n = np.r_[ids, np.array(special, np.uint32)].astype(np.uint32), np.r_[n, np.ones(len(special), np.int64)]
            self.start = np.r_[self.start, len(self.flat) + np.cumsum(n) - n]
            self.size = np.r_[self.size, n]
            self.flat = np.r_[self.flat, ids]
            self.index.update(zip([*plain, *special], range(len(self.index), len(self.index) + len(fresh)), strict=True))
            self.chars += sum(map(len, plain))
        out = []
        for ws in split:
            at = np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws))
            out.append(self.flat[ragged(self.start[at], self.size[at])] if len(at) else np.empty(0, np.uint32))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``, special ones included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.token.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _bpe(path: str, made: dict = {}) -> Bpe:  # noqa: B006  one for each process
    if path not in made:
        made[path] = Bpe(path)
    return made[path]


def _parts(texts: list[str], chars: int = 1 << 20) -> Iterator[list[int]]:
    part, n = [], 0
    for i, x in enumerate(texts):
        part.append(i)
        n += len(x)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}


def _map(docs: DataFrame, path: str, columns: list[tuple[str, str, object]], id_col: str, text_col: str) -> DataFrame:
    common.small_batches(docs.sparkSession)
    kinds = [TYPES[k] for _, k, _ in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            texts, made = b.column(1).to_pylist(), [[] for _ in columns]
            for part in _parts(texts):
                for i, ids in zip(part, bpe.encode([texts[i] for i in part]), strict=True):
                    for out, (_, _, f) in zip(made, columns, strict=True):
                        out.append(f(bpe, ids, texts[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, made, kinds)], names=["id", *(n for n, _, _ in columns)])

    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = ", ".join([f"id {dict(docs.dtypes)[id_col]}", *(f"{n} {k}" for n, k, _ in columns)])
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: its id, ``ids`` (array of int) and ``decoded``, the text read back from them.

    Ids are those of the tokenizers library without added special tokens; a special string in a text is its special
    id. Null texts are empty: no ids, an empty text. Rows are independent, so repeats and null ids give rows alike.
    """
    return _map(docs, path, [("ids", "array<int>", lambda bpe, ids, text: ids.astype(np.int32)), ("decoded", "string", lambda bpe, ids, text: bpe.decode(ids))], id_col, text_col)


def pack_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, with ``n_tokens``, ``ids`` and ``round_trip``, whether decoding gives the text back."""
    columns = [
        ("n_tokens", "long", lambda bpe, ids, text: len(ids)),
        ("ids", "array<int>", lambda bpe, ids, text: ids.astype(np.int32)),
        ("round_trip", "boolean", lambda bpe, ids, text: bpe.decode(ids) == text),
    ]
    return _map(docs, path, columns, id_col, text_col)


def digest_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As :func:`encode_texts`, with ``n_tokens`` and SHA-256 digests of ids and decoded text in place of both."""
    columns = [
        ("n_tokens", "long", lambda bpe, ids, text: len(ids)),
        ("ids_sha256", "string", lambda bpe, ids, text: hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()),
        ("decoded_sha256", "string", lambda bpe, ids, text: hashlib.sha256(bpe.decode(ids).encode()).hexdigest()),
    ]
    return _map(docs, path, columns, id_col, text_col)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest_texts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
