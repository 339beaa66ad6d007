"""Token ids, leaks and quality statistics against brute force."""

import math
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelode.llm import leaks, quality, tokens

DOCS = "doc_id long, text string, lang string, ids string, item_id string, score string"
have = pytest.mark.skipif(not os.path.exists(tokens.RANKS), reason="no vocabulary")


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "clash", "clash", "clash") for i, t in texts], DOCS)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = tokens.read_ranks(tokens.RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


@have
@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_ids_equal_reference(reference, text):
    ranks, enc = reference
    assert tokens.encoder(ranks)(text) == enc.encode_ordinary(text)


@have
def test_long_pieces_and_round_trip(reference):
    ranks, enc = reference
    encode = tokens.encoder(ranks)
    r = random.Random(1)
    for t in ("a" * 30_000, " " * 9_999 + "x", "=-" * 5_000, "é́" * 2_000, "".join(chr(r.randrange(32, 0x2FFF)) for _ in range(4_000)), "<|endoftext|>"):
        ids = encode(t)
        assert ids == enc.encode_ordinary(t) and enc.decode(ids) == t


@have
def test_documents(spark):
    got = {r.doc_id: r.ids for r in tokens.token_ids(docs(spark, [(1, None), (2, ""), (3, " "), (4, "hello hello")])).collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) == 1 and len(got[4]) == 2
    assert tokens.token_ids(docs(spark, [])).collect() == []


def brute_leaks(texts, items):
    out = set()
    for d, t in texts:
        w = leaks.words(t or "")
        runs = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        for k, s in items:
            v = leaks.words(s or "")
            if any(tuple(v[i : i + 12]) in runs for i in range(len(v) - 11)):
                out.add((d, k))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(r.randrange(5, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, " ".join(["same"] * 30))]
    items.append((93, items[3][1]))
    texts = []
    for d in range(200):
        w = text(r.randrange(0, 120))
        if d % 2:
            s = leaks.words(items[r.randrange(30)][1])
            n = r.choice([8, 11, 12, 13, 30])
            at = r.randrange(0, max(1, len(s) - n + 1))
            k = r.randrange(0, len(w) + 1)
            w[k:k] = s[at : at + n]
        texts.append((d, r.choice([" ", "_", " - ", "\n> "]).join(x.upper() if r.random() < 0.3 else x for x in w)))
    texts += [(900, None), (901, ""), (902, "Same, " * 12), (903, "same " * 11)]
    want = brute_leaks(texts, items)
    bench = spark.createDataFrame([(k, t, 0) for k, t in items] * 2, "item_id long, text string, doc_id int")
    got = {tuple(x) for x in leaks.leaks(docs(spark, texts), bench).select("doc_id", "item_id").collect()}
    assert got == want and len(want) > 20 and (902, 92) in got and (903, 92) not in got
    assert leaks.leaks(docs(spark, []), bench).collect() == []
    assert leaks.leaks(docs(spark, texts), bench.limit(0)).collect() == []


def test_words():
    assert leaks.words("Ｆｕｌｌ ﬁne_Stra­ße É é x​y") == ["full", "fine", "strasse", "e", "e", "xy"]


def test_search_is_lossless():
    r = random.Random(2)
    items = [(i, " ".join(f"w{r.randrange(25)}" for _ in range(40))) for i in range(120)]
    index = leaks.Index(items)
    for _ in range(200):
        terms = r.sample(range(len(index.vocabulary)), 9)
        score = {}
        for t in terms:
            p = index.postings[t]
            for i, w in zip(p.items, p.weights):
                score[i] = score.get(i, 0) + w
        top = r.choice([0.3, 0.6, 0.9])
        assert sorted(index.search(terms, top)) == sorted(i for i, s in score.items() if s >= top)


PROSE = "The parser reads the file before the cache is written, and it is not slow when the tests are run."


def test_quality_kinds(spark):
    texts = [
        (1, PROSE * 3), (2, "\n".join("> " + x for x in (PROSE + " " + PROSE).split(". "))), (3, "# Title\n\n" + PROSE + "\n\n- one\n"), (4, PROSE.lower().replace(",", "").replace(".", "")),
        (5, "- item one\n- item two\n" * 20), (6, "a | b | c\n1 | 2 | 3\n" * 20), (7, "def f(x):\n    return x\n" * 20), (8, "#$%^ &*() {}[] " * 30), (9, None), (10, ""), (11, " \n\t"), (12, "/**\n * " + PROSE + "\n */"),
    ]
    got = {r.doc_id for r in quality.not_prose(docs(spark, texts + texts)).collect()}
    assert got == {5, 6, 7, 8}
    assert quality.not_prose(docs(spark, [])).collect() == []


def test_quality_does_not_depend_on_the_mix(spark):
    log = "[INFO] worker=3 status=0 {} ;;\n" * 20
    copies = [(i, log) for i in range(2, 60)]
    assert {r.doc_id for r in quality.not_prose(docs(spark, [(1, PROSE * 3), *copies])).collect()} == {i for i, _ in copies}
    assert [r.doc_id for r in quality.not_prose(docs(spark, [(7, log)], None)).collect()] == [7]


def test_ranks_equal_brute_force(spark):
    r = random.Random(4)
    words = "the a of is parser cache x1 {} ; zebra layer and".split()
    texts = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 30)))) for i in range(120)]
    rows = quality.scored(docs(spark, texts + [(i, texts[3][1]) for i in range(200, 290)])).collect()
    alone = [x for x in rows if x.doc_id < 200]
    n = len(alone)
    m = quality.REFERENCE_TEXTS + quality.REFERENCE_SHARE * n
    for row in rows:
        want = -quality.CUT
        for (s, tail), weight in zip(quality.TAILS.items(), quality.WEIGHTS):
            v, vals, ref = row[s], [x[s] for x in alone], quality.REFERENCE[s]
            left, right = ((sum(f(x) for x in vals) + m * sum(f(x) for x in ref) / 20) / (n + m) for f in (lambda x: x <= v, lambda x: x >= v))
            want -= weight * math.log({"left": left, "right": right, "both": min(1.0, 2 * min(left, right))}[tail])
        assert row.score == pytest.approx(want, abs=1e-5)


def test_languages_without_word_list(spark):
    """Prose of a language with ranks of its own is no case for want of common words."""
    polish = "Ten moduł odczytuje kolejne wiersze z pliku {} i zapisuje je do tabeli, którą potem sprawdza drugi proces. Nikt nie musi zmieniać ustawień numer {}, chyba że dysk jest pełny."
    texts = [(i, " ".join([polish.format(i, i + 1)] * (1 + i % 3))) for i in range(80)]
    assert quality.not_prose(docs(spark, texts, "pl")).collect() == []


def test_labels_move_the_cut():
    terms = np.abs(np.random.default_rng(1).normal(size=(4000, len(quality.TAILS)))) * 3
    w = quality.fitted(terms, (terms.sum(axis=1) > 16).astype(float))
    got = terms @ w[:-1] + w[-1] > 0
    assert np.mean(got == (terms.sum(axis=1) > 16)) > 0.97
    assert quality.fitted(np.zeros((0, 6)), np.zeros(0)).tolist() == [*quality.WEIGHTS, -quality.CUT]


def test_labels_null_and_contradicting(spark):
    labels = spark.createDataFrame([(1, "prose", "x"), (1, "list", "y"), (2, None, "x"), (None, "code", "x"), (3, "code", "x"), (3, "code", "x"), (99, "junk", "x")], "doc_id long, kind string, labeller string")
    texts = [(1, PROSE * 3), (2, PROSE), (3, "def f(x):\n    return x\n" * 20), (4, None)]
    assert [r.doc_id for r in quality.not_prose(docs(spark, texts), labels).collect()] == [3]
    assert quality.not_prose(docs(spark, []), labels.limit(0)).collect() == []
