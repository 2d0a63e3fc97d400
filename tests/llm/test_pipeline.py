"""The stages against brute force, each on what the one before it left."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from tokenizers import Tokenizer

from loomstat.llm import lang_id, mixing

from test_llm import JSON, brute_components, docs, norm, words


@pytest.fixture(scope="module")
def steps(spark):
    r, rows = random.Random(8), []
    for i in range(80):
        rows.append((i, " ".join(words(i, r.choice([30, 60]))), "xx" if i % 2 else "yy", r.choice(["a", "b", None])))
    rows += [(200 + i, rows[i][1] + " ", "xx", "a") for i in range(10)]
    rows += [(300 + i, rows[i][1] + " tail", "xx", "b") for i in range(10, 25)]
    rows += [(400, None, "xx", "a"), (401, "12 34", "xx", "a"), (402, "", None, None), (403, "Long " * 20_000, "xx", "a"), (5, rows[5][1], "xx", "a")]
    made = [docs(spark, rows)]
    for _, f in corpus_pipeline.STAGES:
        made.append(f(spark, made[-1], "").cache())
    return made


def pairs(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language(steps):
    assert pairs(steps[1]) == Counter({k: n for k, n in pairs(steps[0]).items() if any(c.isalpha() for c in k[1] or "")})


def test_exact(steps):
    best = {}
    for i, x in pairs(steps[1]):
        best[norm(x)] = min(best.get(norm(x), (i, x)), (i, x))
    got = pairs(steps[2])
    assert set(got.values()) == {1} and {(i, norm(x)) for i, x in got} == {(i, k) for k, (i, _) in best.items()}


def test_exact_leaves_one_of_texts_without_ids(spark):
    rows = [(None, "same text"), (None, "same  text"), (None, "same text"), (None, "alone"), (1, "other"), (None, "other")]
    got = pairs(corpus_pipeline.drop_copies(spark, docs(spark, rows), ""))
    assert len(got) == 3 and set(got.values()) == {1} and {(i, norm(x)) for i, x in got} == {(None, "same text"), (None, "alone"), (1, "other")}


def test_near(steps):
    rows = list(pairs(steps[2]))
    comp = brute_components(rows, 5, 80)
    assert pairs(steps[3]) == Counter((i, x) for i, x in rows if comp[i][1] == i)
    assert len(rows) > steps[3].count()


def test_mixing(steps):
    before, after = pairs(steps[3]), pairs(steps[4])
    assert set(after) <= set(before) and max(after.values()) <= 3
    taken = {r["doc_id"]: r["taken"] / r["size"] for r in mixing.mix(steps[3])[0].collect() if r["size"]}
    assert all(int(taken[i]) <= after[i, x] <= int(taken[i]) + 1 for i, x in before)
    source = {r["doc_id"]: r["source"] for r in steps[3].collect()}
    for s in ("a", "b", None):  # a source's words are off by less than its largest document
        mine = {(i, x): len(x.split()) for i, x in before if source[i] == s}
        assert abs(sum(after[k] * n for k, n in mine.items()) - sum(taken[k[0]] * n for k, n in mine.items())) <= max(mine.values())


def test_encoding(steps):
    lib, got = Tokenizer.from_file(JSON), steps[5].collect()
    want = Counter({(i, tuple(lib.encode(x, add_special_tokens=False).ids)): n for (i, x), n in pairs(steps[4]).items()})
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_nothing_left(spark):
    out = docs(spark, [])
    for _, f in corpus_pipeline.STAGES:
        out = f(spark, out, "")
    assert out.count() == 0 and lang_id.UNDETERMINED == "und"
