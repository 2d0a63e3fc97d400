"""Small cases of each operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstat.llm import bpe, chat, common, exact_dedup, lang_id, line_dedup, mixing, near_dedup, quality, sharding, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _t long, size string, score string, `_id` string, n long"
JSON = public_tokenizers.path("byte_bpe_50k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) with further columns that operators use as names."""
    full = [(*r, *([None] * (4 - len(r))), None, True, 1, "x", "y", "z", 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed, n):
    r = random.Random(seed)
    return [r.choice(WORDS) + str(r.randrange(50)) for _ in range(n)]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (None, "no id"), (5, "a b"), (5, "a b"), (6, "x" * 300_000), (7, "é " * 40_000), (8, "#!?"), (9, "日本 ok")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_empty_tables(spark):
    none = docs(spark, [])
    assert exact_dedup.refine(none).count() == 0
    assert near_dedup.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0 and line_dedup.dedup_passages(none).count() == 0
    assert mixing.mix(none)[0].count() == 0
    assert sharding.interleave(none).count() == 0
    assert quality.judge(none).count() == 0
    assert token_counts.count_tokens(none, JSON).count() == 0
    assert bpe.encode_texts(none, JSON).count() == 0
    assert lang_id.predict(none, lang_id.train(none)).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 1
def test_language_accuracy_and_backoff(spark):
    a, b = ["the cat and the dog " * 3, "dogs run and cats walk to the house"], ["der hund und die katze " * 3, "katzen laufen und hunde gehen zum haus"]
    rows = [(i, (a if i % 2 else b)[i % 4 // 2], "en" if i % 2 else "de", "s") for i in range(60)]
    model = lang_id.train(docs(spark, rows))
    assert model.langs == ["de", "en"]
    got = by_id(lang_id.predict(docs(spark, [(1, "the dog"), (2, "die katze"), (3, "12 !?"), (4, None), (5, "doghouse"), (6, "hundehaus"), (7, "")]), model))
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["en", "de", "und", "und", "en", "de", "und"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[3]["score"] == 0


def test_language_ignores_held_out_rows(spark):
    df = docs(spark, [(i, "aa bb", "x") for i in range(40)])
    held = df.where(lang_id.remainder("doc_id") == 2)
    assert 0 < held.count() < 40
    assert lang_id.train(held).langs == []
    assert lang_id.predict(held, lang_id.train(held)).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_odd_rows(spark):
    df = docs(spark, [(*r, "en") for r in ODD])
    assert lang_id.predict(df, lang_id.train(df)).count() == len(ODD)


def test_language_scores_brute(spark):
    """Scores by plain counting: known words by log frequency, unseen ones by the longest known n-grams."""
    r = random.Random(11)
    make = {"aa": "lo mi ra su ten".split(), "bb": "grok strum lo blik".split(), "cc": "éta ñu mi öl".split()}
    rows = [(i, " ".join("".join(r.choice(make[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 30))), k) for i, k in enumerate(r.choices(list(make), k=90))]
    rows += [(500, "", "aa"), (501, None, "bb"), (502, "lo", None), (503, "lo mi", "aa"), (504, "123 !?", "cc"), (505, "zzqx grokten", "bb"), (506, " ".join(["strumblik"] * 30_000), "bb"), (503, "lo mi", "aa")]
    df = docs(spark, rows)
    held = {x["doc_id"]: x["m"] == 2 for x in df.select("doc_id", lang_id.remainder("doc_id").alias("m")).collect()}
    word, gram = defaultdict(Counter), {k: defaultdict(Counter) for k in (5, 4, 3, 2, 1)}
    cut = lambda w, k: [(f"^{w}$" if k > 1 else w)[i : i + k] for i in range(len(w) + (2 if k > 1 else 0) - k + 1)]
    for i, x, k in rows:
        if x is not None and k is not None and not held[i]:
            word[k].update(w for w in re.findall(r"[^\W\d_]+", x.lower()))
    seen = Counter(w for n in word.values() for w in n.elements())
    for k, n in word.items():
        for w, c in n.items():
            for m in gram:
                for g in cut(w, m):
                    gram[m][k][g] += c
    langs, known = sorted(make), {w for w, n in seen.items() if n > 1}

    def logs(table, names, what):
        return np.array([math.log((table[k][what] + 0.5) / sum(table[k][x] + 0.5 for x in names)) for k in langs])

    def score(w):
        if w in known:
            return logs(word, known, w)
        for m, table in gram.items():
            names = set().union(*(set(table[k]) for k in langs))
            if found := [g for g in cut(w, m) if g in names]:
                return np.mean([logs(table, names, g) for g in found], axis=0)
        return np.zeros(3)

    got, cache = by_id(lang_id.predict(df, lang_id.train(df))), {}
    for i, x, _ in rows:
        found = re.findall(r"[^\W\d_]+", (x or "").lower())
        if not found:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        total = sum(cache.setdefault(w, score(w)) for w in found)
        share = np.exp(total - total.max())
        assert got[i]["score"] == pytest.approx(share.max() / share.sum(), abs=1e-6)
        assert total[langs.index(got[i]["lang_pred"])] == pytest.approx(total.max())


# 2
def test_chat_round_trip(spark):
    rows = [(1, 1, "assistant", "b</turn>\n### x: <next>"), (1, 0, "user", "\\l \\b# <"), (1, 2, "assistant", "c"), (1, 2, "assistant", None), (2, None, None, None), (None, 0, "a:b#", "x"), (3, 0, "assistant", ""), (4, 0, "user", "y" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(df)
    got = {r["conv_id"]: r for r in made.select("conv_id", "formatted", "mask", chat.read_turns(made["formatted"]).alias("t"), chat.loss_text(made["formatted"], made["mask"]).alias("loss")).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want[conv].append((role or "", text or ""))
    assert {k: [tuple(t) for t in r["t"]] for k, r in got.items()} == dict(want)
    for k, r in got.items():
        assert r["loss"] == "".join(t for role, t in want[k] if role == "assistant")
        assert sum(s["chars"] for s in r["mask"]) == len(r["formatted"])
    assert got[1]["formatted"].count("### ") == 2  # three turns of one role make one block


# 3
def norm(x):
    return re.sub("[\x20\x09-\x0d]+", " ", x or "")


@pytest.mark.parametrize("limit", [0, 10**6])
def test_exact_dedup_brute(spark, monkeypatch, limit):
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", limit)
    rows = [*ODD, (20, "same  text"), (19, "same\ttext"), (21, "same text "), (30, None), *((100 + i, "hot copy") for i in range(300))]
    got = exact_dedup.refine(docs(spark, rows), with_hash=True).collect()
    groups = defaultdict(list)
    for i, x in rows:
        groups[norm(x)].append(i)
    want = []
    for i, x in rows:
        g = groups[norm(x)]
        keep = min((j for j in g if j is not None), default=None)
        want.append((i, keep, len(g), i == keep if i is not None and keep is not None else len(g) == 1, hashlib.sha256(norm(x).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))


def test_exact_dedup_hashes_open_rows_only(spark):
    """Beyond the broadcast bound too: rows that share a length and prefix, out of 3,000."""
    rows = [(i, f"{i:05d} " + "x" * (i % 700)) for i in range(3000)] + [(5000 + i, f"{i:05d} " + "x" * (i % 700)) for i in range(40)]
    text = docs(spark, rows).selectExpr("doc_id as _id", "xxhash64(text) as _t", "text as _text", "octet_length(text) as _len", "xxhash64(text) as _prefix")
    keys = text.groupBy("_len", "_prefix").count().where("count > 1").select("_len", "_prefix")
    got = {r["_id"]: r["_sha"] for r in exact_dedup.hashed(text, keys).collect()}
    open_ = {*range(40), *range(5000, 5040)}
    assert open_ <= {i for i, h in got.items() if h is not None} and sum(h is not None for h in got.values()) <= len(open_) + 2
    assert all(bytes(got[i]).hex() == hashlib.sha256(dict(rows)[i].encode()).hexdigest() for i in open_)


# 4 and 6
def odd_texts():
    r = random.Random(3)
    pick = [lambda: r.randrange(0x80), lambda: r.randrange(0x250), lambda: r.randrange(0x250, 0xD7FF), lambda: r.randrange(0x10000, 0x1FFFF)]
    out = ["", " ", "  a", "a \n b", "aaaa" * 99, "don't we'll", "<|endoftext|>", "a<|endoftext|> b<|endoftext", "\x1c \x85\xa0x", "q" * 1500]
    out += ["".join(chr(r.choice(pick)()) for _ in range(200)) for _ in range(40)]
    return out + ["".join(r.choice("ab cd'\n\t é<|>") for _ in range(3000)), " ".join(words(1, 30_000))]


def test_bpe_is_the_librarys(spark):
    lib = Tokenizer.from_file(JSON)
    texts = odd_texts()
    got = by_id(bpe.encode_texts(docs(spark, [*enumerate(texts), (None, "x"), (900, None)]), JSON))
    for i, x in enumerate(texts):
        ids = lib.encode(x, add_special_tokens=False).ids
        assert got[i]["ids"] == ids, x[:80]
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
    assert got[900]["ids"] == [] and got[900]["decoded"] == ""


def test_bpe_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 20)
    lib, own = Tokenizer.from_file(JSON), bpe.Bpe(JSON)
    for k in range(5):
        x = " ".join(words(k, 200))
        assert own.encode([x])[0].tolist() == lib.encode(x, add_special_tokens=False).ids


def test_token_counts_are_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SPLIT_CHARS", 50)
    lib = Tokenizer.from_file(JSON)
    texts = odd_texts()
    texts += ["日本語の、文章です。漢字 かな 123 4.5 abc" * 9, "l'été; dit-il. Ça va? 12.5a.b <|endoftext|> x,y " * 9, "Привет, мир!Как дела?да " * 9, "a  b   c .d e .f\u00a0g\x1ch i" * 9]
    twice = token_counts.count_tokens(docs(spark, [(1, texts[-2]), (1, texts[-2]), (None, texts[-2])]), JSON).collect()
    assert {r["n_tokens"] for r in twice} == {len(lib.encode(texts[-2], add_special_tokens=False).ids)} and len(twice) == 3
    got = by_id(token_counts.count_tokens(docs(spark, [*enumerate(texts), (900, None)]), JSON))
    assert [got[i]["n_tokens"] for i in range(len(texts))] == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]
    assert (got[900]["n_bytes"], got[900]["n_tokens"]) == (0, 0) and got[2]["n_bytes"] == 3
    for x in texts[-5:]:
        assert "".join(token_counts.pieces(x, 50)) == x
    assert all(len(list(token_counts.pieces(x, 50))) > 3 for x in texts[-4:])


@pytest.mark.parametrize(("kept", "chars"), [(30, 48), (600_000, 5), (600_000, 48)])
def test_token_counts_with_few_kept_parts(monkeypatch, kept, chars):
    monkeypatch.setattr(token_counts, "KEPT", kept)
    monkeypatch.setattr(token_counts, "KEPT_CHARS", chars)
    monkeypatch.setattr(token_counts, "BATCH_BYTES", 300)
    lib, count, known = Tokenizer.from_file(JSON), token_counts.encoder(JSON), {}
    for k in range(4):
        texts = [*odd_texts()[k::4], " ".join(words(k, 300)), "One.Two, three;four!" * 20, "", " ", "x" * 3000]
        assert token_counts.lengths(count, texts, True, known) == [len(lib.encode(x, add_special_tokens=False).ids) for x in texts]
        assert all(len(p) <= chars for p in known) and len(known) <= kept


def test_token_counts_of_a_sentencepiece_model(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    got = by_id(token_counts.count_tokens(docs(spark, [(1, "Hello  world"), (2, None)]), path))
    assert got[1]["n_tokens"] == len(lib.encode("Hello  world")) and got[2]["n_tokens"] == 0


# 5
def brute_components(rows, k, percent):
    sets = {}
    for i, x in rows:
        w = (x or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    comp = {i: i for i in sets}

    def find(i):
        return i if comp[i] == i else find(comp[i])

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                comp[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(families=25, each=6, chain=30):
    r, rows = random.Random(7), []
    for f in range(families):
        base = words(f, r.choice([12, 40, 150]))
        for _ in range(each):
            w = list(base)
            for _ in range(r.randrange(0, max(2, len(w) // 12))):
                w[r.randrange(len(w))] = "edit" + str(r.randrange(999))
            rows.append(" ".join(w))
    w = words(99, 60)
    for i in range(chain):  # each is near the one before only
        w[i * 2 % 60] = f"step{i}"
        rows.append(" ".join(w))
    return [*enumerate(r.sample(rows, len(rows)), 10)]


@pytest.mark.parametrize("small", [400, 8])
@pytest.mark.parametrize("k", [2, 5])
def test_near_dedup_brute(spark, monkeypatch, k, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "UNIT_SETS", small)
    monkeypatch.setattr(near_dedup, "DEPTH", 2)
    monkeypatch.setattr(near_dedup, "IN_ONE_TASK", 10 * small)
    rows = [*near_rows(), (1, None), (2, ""), (3, "One"), (4, "oNE"), (5, "one two"), (6, "One\tTWO"), (7, "É x"), (8, "é x")]
    got = near_dedup.near_duplicates(docs(spark, [*rows, (None, "one")]), k=k).collect()
    want = brute_components(rows, k, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_dedup_repeated_rows_and_large_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    base = words(5, 200)
    rows = [(i, " ".join([*base[:100], f"own{i}", *base[101:]])) for i in range(900)]
    rows += [(7000, "x y z"), (7000, "x y z")]
    got = near_dedup.near_duplicates(docs(spark, rows), k=2).collect()
    assert len(got) == 902 and {r["component_id"] for r in got if r["doc_id"] < 900} == {0}
    assert [r["kept"] for r in got if r["doc_id"] == 7000] == [True, True]


@pytest.mark.parametrize("percent", [30, 50, 60])
def test_linked_labels(percent):
    r = np.random.default_rng(percent)
    sets = [np.unique(r.integers(0, 40, 30)).astype(np.int64) for _ in range(60)] + [np.array([99], np.int64)] * 2 + [np.array([5000], np.int64)]
    pairs = [(i, j) for i in range(63) for j in range(i + 1, 63) if 100 * len(x := np.intersect1d(sets[i], sets[j])) >= percent * (len(sets[i]) + len(sets[j]) - len(x))]
    want = near_dedup.joined_labels(63, *np.array(pairs).T)
    assert near_dedup.linked_labels(sets, percent).tolist() == want.tolist()
    assert near_dedup.joined_labels(6, np.array([5, 4, 1]), np.array([4, 2, 0])).tolist() == [0, 0, 2, 3, 2, 2]


@pytest.mark.parametrize("bound", [0, 20, 10**6])
def test_components_of_a_path(spark, monkeypatch, bound):
    monkeypatch.setattr(near_dedup, "IN_ONE_TASK", bound)
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["id"]: r["comp"] for r in near_dedup.components(edges).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}


# 7
def brute_lines(rows, min_lines=2):
    def chunks(text):
        out, now, last = [], [], ""
        lines = text.split("\n")
        for i, x in enumerate(lines):
            h = hashlib.md5(x.encode()).hexdigest()[:16]
            now.append(x)
            if i == len(lines) - 1 or (ord(h[0]) + ord((last or "\0")[0])) % 4 == 0:
                out.append(now)
                now = []
            last = h
        return out

    seen, out = set(), {}
    for i, x in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        left, gone = [], 0
        for c in chunks(x or ""):
            key = "\n".join(c)
            if len(c) >= min_lines and key.split():
                if key in seen:
                    gone += len(c)
                    continue
                seen.add(key)
            left += c
        out[i] = ("\n".join(left), gone)
    return out


@pytest.mark.parametrize("limit", [0, 10**6])
def test_line_dedup_brute(spark, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", limit)
    r = random.Random(2)
    passage = [f"passage line {i} of some words" for i in range(12)]
    rows = []
    for i in range(60):
        own = [" ".join(words(i * 100 + j, 4)) for j in range(r.randrange(1, 9))]
        rows.append((i, "\n".join([*own, *passage, "end " + str(i)] if i % 3 else own)))
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (103, "\n\n\n"), (104, rows[1][1]), (105, "x\n" * 5000), (None, rows[2][1])]
    rows.append(rows[4])
    got = line_dedup.dedup_lines(docs(spark, rows)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g["text"], g["n_removed"]) == want[g["doc_id"]], g["doc_id"]
    assert sum(g["n_removed"] for g in got) > 200 and {g["n_lines"] for g in got if g["doc_id"] in (100, 101)} == {0}


def brute_passages(rows):
    """By all runs of all documents: the lines of those with over 50 words that occur at an earlier place, in a document before or further
    up without a line in common; blank lines at no end and all alike."""
    seen, out = {}, {}
    for i, x in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = (x or "").split("\n")
        gone = set()
        for a in range(len(lines)):
            run, n, with_words = [], 0, 0
            for b in range(a, len(lines)):
                run.append(lines[b] if lines[b].split() else "")
                n, with_words = n + len(lines[b].split()), with_words + bool(lines[b].split())
                if lines[a].split() and lines[b].split() and with_words > 1 and n > 50:
                    where, end = seen.setdefault("\n".join(run), (i, b))
                    if where != i or a > end:
                        gone |= set(range(a, b + 1))
        out[i] = ("\n".join(y for k, y in enumerate(lines) if k not in gone), len(gone))
    return out


@pytest.mark.parametrize(("limit", "digits"), [(0, 16), (10**6, 16), (10**6, 1)])
def test_passages_brute(spark, monkeypatch, limit, digits):
    """With hashes of one digit lines are told apart by their bytes only."""
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", limit)
    monkeypatch.setattr(line_dedup, "BROADCAST_GONE", limit)
    if digits == 1:
        monkeypatch.setattr(line_dedup, "line_hash", lambda x: F.pmod(F.xxhash64(x.cast("binary")), F.lit(7)))
    r = random.Random(5)
    pool = [[" ".join(words(900 + k * 10 + j, r.choice([3, 9, 20, 60]))) for j in range(r.choice([2, 2, 3, 5, 8]))] for k in range(12)]
    pool[0].insert(1, "")
    rows = []
    for i in range(50):
        lines = [" ".join(words(i * 100 + j, 7)) for j in range(r.randrange(0, 3))]
        for _ in range(r.randrange(3)):
            p = r.choice(pool)
            a = r.randrange(len(p))
            lines += p[a : a + r.randrange(2, 9)] + [""] * r.randrange(2)
        rows.append((i, "\n".join([*lines, " ".join(words(i * 100 + 50, 4))])))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "\n".join(pool[3] * 3)), (104, "x\n" * 120), (105, "a b c d e f\nb\nc d\n" * 30), (106, "\n \n".join(pool[0])), (None, rows[2][1])]
    rows.append(rows[4])
    got, want = line_dedup.dedup_passages(docs(spark, rows)).collect(), brute_passages(rows)
    assert len(got) == len(rows)
    for g in got:
        assert (g["text"], g["n_removed"]) == want[g["doc_id"]], g["doc_id"]
    assert sum(g["n_removed"] for g in got) > 100


def test_first_occurrence_stays_whole(spark):
    """Repeats inside of one text, of some megabytes too."""
    line = " ".join(words(3, 6))
    three = [" ".join(words(k, 20)) for k in range(3)]
    six = [" ".join(words(k, 6)) for k in range(3)]
    rows = [(1, "\n".join([line] * 200_000)), (2, "\n".join(three * 6)), (3, "\n".join(six * 6)), (4, "\n".join(f"{k} {line}" for k in range(50_000)))]
    got = by_id(line_dedup.dedup_passages(docs(spark, rows)))
    assert got[1]["text"] == "\n".join([line] * 9) and got[1]["n_removed"] == 199_991  # nine lines are the first with over 50 words
    assert got[2]["text"] == "\n".join(three) and got[3]["text"] == "\n".join(six * 3)
    assert got[4]["n_removed"] == 0


def test_passage_of_two_lines_goes_whole(spark):
    """Wherever the chunk rule would cut, as it cuts after one line in four only."""
    rows = []
    for k in range(20):
        passage = [" ".join(words(k * 10 + j, 30)) for j in range(2)]
        rows += [(2 * k + n, "\n".join([f"before {k} {n}", *passage, f"after {k} {n}"])) for n in range(2)]
    got = by_id(line_dedup.dedup_passages(docs(spark, rows)))
    assert all(got[2 * k]["n_removed"] == 0 and got[2 * k + 1]["text"] == f"before {k} 1\nafter {k} 1" for k in range(20))


# 8
def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 3) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 500, 490], [5, 2, 1], 3) == pytest.approx([30, 970 * 2 / 3, 970 / 3])
    assert mixing.targets([0, 0], [5, 2], 3) == [0, 0]


def test_permutation_is_one_to_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(100))


def test_mix_account(spark):
    r = random.Random(4)
    rows = [(i, " ".join(words(i, r.choice([0, 1, 5, 40, 300]))), None, r.choice(["a", "b", "b", "b", "ü", None])) for i in range(500)]
    rows += [(1000, None, None, "empty"), (1001, "w " * 20_000, None, "b"), (7, "twin text", None, "a"), (7, "twin text", None, "a")]
    account, slots = mixing.mix(docs(spark, rows))
    got, slots = account.toPandas(), slots.toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    by = got.assign(source=got["source"].fillna("~null")).groupby("source").agg(size=("size", "sum"), all=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["all"]).all() and by["target"].sum() == pytest.approx(by["size"].sum())
    assert ((by["taken"] - by["target"]).abs() <= 0.05 * by["target"] + 100).all(), by
    names = ["a", "b", "empty", "ü", "~null"]
    assert by.loc[names, "target"].tolist() == pytest.approx(mixing.targets(by.loc[names, "size"].tolist(), [5, 2, 1, 5, 2], 3))
    n = slots.assign(source=slots["source"].fillna("~null")).groupby(["source", "block"]).size()
    assert n.max() <= 3
    again = mixing.mix(docs(spark, rows[::-1]).repartition(3))[0].toPandas()
    cols = ["doc_id", "size", "taken"]
    assert sorted(map(tuple, got[cols].to_numpy().tolist())) == sorted(map(tuple, again[cols].to_numpy().tolist()))


def test_mix_blocks_hold_the_words(spark):
    r = random.Random(6)
    rows = [(i, " ".join(words(i, r.choice([1, 5, 40, 300]))), None, r.choice(["a", "b", None])) for i in range(200)]
    account, slots = mixing.mix(docs(spark, rows))
    taken, held = Counter(), defaultdict(set)
    for s in slots.collect():
        text = [(x["id"], k) for x in s["spans"] for k in range(x["from"], x["to"])]
        assert 0 < len(text) <= 32 and all(rows[i][3] == s["source"] and k < len(rows[i][1].split()) for i, k in text)
        held[s["source"], s["block"]].add(tuple(text))
        taken.update(i for i, _ in text)
    assert all(len(x) == 1 for x in held.values())
    once = [w for x in held.values() for w in next(iter(x))]
    assert len(once) == len(set(once)) and {r["doc_id"]: r["taken"] for r in account.collect() if r["taken"]} == taken


def test_mix_brute(spark):
    """Blocks, slots and counts by plain loops; only the order of documents and the permutation come from Spark's hash."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    rows = [(i, " ".join(words(i, r.choice([0, 1, 5, 40, 200]))), None, r.choice(["a", "b", "b", None])) for i in range(120)]
    df = docs(spark, rows)
    account, slots = mixing.mix(df, block=16, shards=5, seed=3)
    size = {i: len(x.split()) for i, x, *_ in rows}
    h = F.xxhash64(F.lit(3), "doc_id", F.coalesce("source", F.lit("")), mixing.word_count("text"), F.xxhash64("text"))
    order = [x["doc_id"] for x in df.select("doc_id", h.alias("h")).orderBy("h").collect()]
    names = ["a", "b", None]
    streams = [[(i, k) for i in order if rows[i][3] == s for k in range(size[i])] for s in names]
    goal = np.array(mixing.targets([len(s) for s in streams], [5, 2, 1], 3))
    total = sum(size.values())
    n = round(total / 16)
    lack, taken, used, first, want = goal / total * n, Counter(), [0, 0, 0], [0, 0, 0], {}
    for k in range(5):
        m = n * (k + 1) // 5 - n * k // 5
        left = np.maximum(lack, 0)
        got = np.random.default_rng([3, k]).multinomial(m, left / left.sum())
        lack = lack - got
        for s in range(3):
            blocks = -(-len(streams[s]) // 16)
            for _ in range(min(int(got[s]), 3 * blocks - used[s])):
                want[names[s], used[s]] = k, blocks
                used[s] += 1
    back = {(x["source"], x["slot"]): x for x in slots.collect()}
    assert set(back) == set(want)
    for (s, slot), (k, blocks) in want.items():
        x, held = back[s, slot], streams[names.index(s)]
        assert x["shard"] == k and 0 <= x["block"] < blocks
        words_ = [(p["id"], w) for p in x["spans"] for w in range(p["from"], p["to"])]
        assert words_ == held[16 * x["block"] : 16 * x["block"] + 16]
        taken.update(i for i, _ in words_)
    for s in names:  # each pass over a source takes each of its blocks once
        blocks = -(-len(streams[names.index(s)]) // 16)
        for p in range(3):
            seen = [x["block"] for (t, slot), x in back.items() if t == s and slot // max(blocks, 1) == p]
            assert len(seen) == len(set(seen))
    assert {x["doc_id"]: x["taken"] for x in account.collect()} == {i: taken[i] for i, *_ in rows}


# 9
def brute_rules(text):
    w = (text or "").encode().split()
    w = [x.decode() for x in w]
    windows = Counter(zip(w, w[1:], w[2:]))
    mark = set()
    for i, t in enumerate(zip(w, w[1:], w[2:])):
        if windows[t] > 1:
            mark |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(mark)


def test_quality_rules_and_bands(spark):
    r = random.Random(9)
    rows = [(1000 + i, " ".join(words(i, 80)), "en") for i in range(300)]
    rows += [(500, " ".join("".join(r.choice("QZXJKVWqzxjkvw#$%&") for _ in range(9)) for _ in range(90)), "en"), (501, "a b c " * 50, "en"), (502, "dup\ndup\n \n \nx\n", "en"), (503, "日本 語 |" * 60, None)]
    rows += [(*r, "en") for r in ODD if r[0] != 5]
    got = by_id(quality.judge(docs(spark, rows)))
    for i, x, _ in rows:
        g = got[i]
        want = brute_rules(x)
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want, i
        assert g["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (g["base_failed"] and g["kept"])
    assert all(got[i]["kept"] for i in range(1000, 1300)) and not got[500]["kept"] and not got[500]["base_failed"]


@pytest.mark.parametrize("others", [40, 1])
def test_quality_band_of_many_copies(spark, others):
    """Copies of one text, over half of a language, don't set its band; nor does a language with one other text."""
    rows = [(i, " ".join(words(7, 80)), "en") for i in range(120)] + [(1000 + i, " ".join(words(100 + i, 80)), "en") for i in range(others)]
    got = by_id(quality.judge(docs(spark, rows)))
    assert all(g["kept"] for g in got.values()) and all(g["upper"] - g["lower"] >= 6 * quality.LEAST_WIDTH - 1e-9 for g in got.values())


def brute_perplexity(texts):
    """Mean negative log probability of each text's characters by an interpolated modified Kneser-Ney trigram model of the distinct ones."""
    grams = {x: [("  " + x)[i : i + 3] for i in range(len(x))] for x in set(texts) if x}
    counts = [Counter(g for x in grams.values() for g in x)]
    for _ in range(2):
        counts.append(Counter(g[1:] for g in counts[-1]))

    def given_up(level):
        n = [0, *(sum(v == k for v in level.values()) for k in (1, 2, 3, 4))]
        if min(n[1:]) == 0:
            return [0, 0.5, 0.75, 0.9]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3))]

    low = {"": 1 / (len(counts[-1]) + 1)}
    for level in reversed(counts):
        d, total, weight = given_up(level), Counter(), Counter()
        for g, n in level.items():
            total[g[:-1]] += n
            weight[g[:-1]] += d[min(n, 3)]
        low = {g: (n - d[min(n, 3)] + weight[g[:-1]] * low[g[1:]]) / total[g[:-1]] for g, n in level.items()}
    return {x: -sum(math.log(low[g]) for g in found) / len(found) for x, found in grams.items()}


@pytest.mark.parametrize("entries", [10**6, 0])
def test_quality_perplexity_and_verdict_brute(spark, monkeypatch, entries):
    monkeypatch.setattr(quality, "BROADCAST_ENTRIES", entries)
    monkeypatch.setattr(quality, "HELD", 200)
    r = random.Random(3)
    rows = [(i, " ".join(words(i % 30, r.randrange(40, 120) if i < 30 else 60)), "en") for i in range(45)]
    rows += [(100 + i, " ".join(r.choice(["日本", "語の", "文章", "です", "é"]) for _ in range(60 + i)), "ja") for i in range(12)]
    rows += [(200, " ".join(f"w{i}#{i}" for i in range(70)), "en"), (201, "😀 ok " * 20, "ja"), (202, None, "en"), (203, "", None), (204, "alone", None), (205, "word " * 70, "one"), (None, rows[0][1], "en"), (1, rows[1][1], "en")]
    got = quality.judge(docs(spark, rows)).collect()
    told = {}
    for lang in {x[2] for x in rows}:
        mine = {x[1] or "" for x in rows if x[2] == lang}
        logs = brute_perplexity(mine)
        passing = sorted(x for x in mine if not ((w := brute_rules(x))[0] < 50 or 100 * w[4] > 50 * w[0]))
        at = lambda v, q: sorted(v)[max(math.ceil(q * len(v)) - 1, 0)]
        for x in mine:
            low = up = None
            if passing:
                a, b = (at([logs[p] for p in passing], q) for q in (0.25, 0.75))
                wide = max(b - a, quality.LEAST_WIDTH) * max(1.0, math.sqrt(at([len(p) for p in passing], 0.5) / max(len(x), 1)))
                low, up = a - quality.BELOW * wide, b + quality.ABOVE * wide
            told[lang, x] = logs.get(x), low, up, x in passing and low <= logs[x] <= up
    langs = {(i, x or ""): lang for i, x, lang in rows}
    assert len(got) == len(rows)
    texts = {i: x or "" for i, x, _ in rows}
    for g in got:
        want = told[langs[g["doc_id"], texts[g["doc_id"]]], texts[g["doc_id"]]]
        assert g["log_perplexity"] == (None if want[0] is None else pytest.approx(want[0], abs=1e-5)), g
        assert g["lower"] == (None if want[1] is None else pytest.approx(want[1], abs=1e-4)) and g["kept"] == want[3], g
    assert not all(g["kept"] or g["base_failed"] for g in got)


# 10
def test_sharding_brute(spark):
    """Fractional ranks and cuts by plain sorting."""
    r = random.Random(7)
    rows = [(i, "t" * r.randrange(9), None, r.choice(["a"] * 8 + ["b", "c", None])) for i in range(403)]
    df = docs(spark, rows)
    by = defaultdict(list)
    for i, t, _, source in rows:
        own = f"1-{i}-{zlib.crc32(t.encode())}-{len(t) + 8}"
        by[source or ""].append((int(hashlib.md5(own.encode()).hexdigest()[:15], 16), i))
    placed = sorted(((k + 0.5) / len(v), s == "", s, h, i) for s, v in by.items() for k, (h, i) in enumerate(sorted(v)))
    want, count = {}, Counter()
    for at, (*_, i) in enumerate(placed):
        shard = at * 24 // len(placed)
        want[i] = shard, count[shard]
        count[shard] += 1
    assert {x["doc_id"]: (x["shard"], x["slot"]) for x in sharding.interleave(df, shards=24).collect()} == want


def test_sharding_matches_the_mixture(spark):
    r = random.Random(6)
    rows = [(i, "t" * r.randrange(50), None, r.choice(["a"] * 8 + ["b", None])) for i in range(1007)] + [(5, None, None, "a"), (5, None, None, "a"), (None, "x", None, "b")]
    got = sharding.interleave(docs(spark, rows), shards=24).toPandas()
    assert len(got) == len(rows)
    n = got.groupby("shard").size()
    assert len(n) == 24 and n.max() - n.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    share = pd.crosstab(got["shard"], got["source"].fillna("~"))
    assert (share.max() - share.min() <= 2).all()
    again = sharding.interleave(docs(spark, rows[::-1]).repartition(5), shards=24).toPandas()
    assert sorted(map(repr, got.to_numpy().tolist())) == sorted(map(repr, again.to_numpy().tolist()))
    few = sharding.interleave(docs(spark, rows[:3]), shards=24).toPandas()
    assert few["shard"].nunique() == 3 and (few["slot"] == 0).all()


# what all share
def test_running_sums(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).withColumn("g", F.col("id") % 3).withColumn("h", F.xxhash64("id"))
    got = common.running(df, ["g"], common.hash_bucket("h", 4), ["h"], F.col("id"), "s").toPandas()
    for _, g in got.groupby("g"):
        g = g.sort_values("h")
        assert (g["s"] == g["id"].cumsum() - g["id"]).all() and (g["s_all"] == g["id"].sum()).all()


def test_keep_rows_leaves_twins_once(spark):
    from pyspark.sql import functions as F

    df = docs(spark, [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (3, "a"), (None, None)])
    decisions = exact_dedup.refine(df).select(F.col("doc_id").alias("id"), F.col("text_xxhash64").alias("t"), "kept")
    left = common.keep_rows(df, decisions, "doc_id", "text")
    assert left.columns == df.columns
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == [("1", "a"), ("2", "b"), ("None", "None"), ("None", "c")]
