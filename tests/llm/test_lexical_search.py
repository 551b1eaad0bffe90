"""Ranked search, against scores of all documents by the formula."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillon.llm import lexical_search as ls
from quillon.llm import queries
from quillon.llm.terms import terms
from tests.oracle import check

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    own = [(i, Counter(words(t))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(c.total() for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scored = []
        for i, c in own:
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in words(text) if w in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("aZ09_-.,\n\t \x00\x1fÉé日\x80\xa0 İß{~\x7f") for _ in range(rng.randint(0, 40)))
        assert [t.decode() for t in terms(text)] == words(text)
    assert terms(None) == terms("") == []


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünï", "日本"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 60))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "... !"), (None, text(20)), (5, docs[5][1]), (1003, docs[5][1]), (1004, text(6000))] + [(2000 + i, docs[7][1]) for i in range(40)]
    items = [(i, text(rng.randint(1, 12))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, docs[7][1]), (93, docs[7][1]), (94, "w0 w0 W0, w3")]
    return docs, items


@pytest.mark.parametrize("parts", [1, 5])
def test_best_documents(spark, corpus, monkeypatch, parts):
    docs, items = corpus
    monkeypatch.setattr(ls, "DOCUMENTS", 8)
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, term string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in ls.ranked_search(d, q).collect()) == brute(docs, [x for x in items if x[1]])


def test_turns_give_the_same(spark, corpus, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(ls, "TERMS", 12)
    monkeypatch.setattr(ls, "QUERIES", 7)
    d, q = spark.createDataFrame(docs[:80], "doc_id long, text string").repartition(2), spark.createDataFrame(items[:9], "item_id long, text string")
    assert sorted(tuple(r) for r in ls.ranked_search(d, q).collect()) == brute(docs[:80], items[:9])
    rows = [(i, words(t)) for i, t in items if t]
    assert [x for turn in ls.turns_of(rows) for x in turn] == rows and len(ls.turns_of(rows)) > 3


def test_blocks_below_the_threshold_are_not_scored():
    rng = np.random.default_rng(4)
    blocks, n, total = [], 640, 6400
    for b in range(20):
        found = [np.unique(rng.integers(5 * (b % 4), 5 * (b % 4) + 10, 6)) for _ in range(32)]
        sizes = np.array([len(x) for x in found])
        blocks.append(ls.Block(np.arange(32 * b, 32 * b + 32), rng.integers(6, 20, 32), sizes, np.concatenate(found), rng.integers(1, 4, sizes.sum()), n, total))
    terms_of, weights = [np.array([1, 3]), np.array([16, 18, 99])], [np.array([2000, 900]), np.array([1500, 1500, 7])]
    best = [ls.Best(5) for _ in terms_of]
    scored = ls.search_blocks(blocks, best, terms_of, weights)
    assert scored < 2 * len(blocks) * 0.7
    for own, t, w in zip(best, terms_of, weights, strict=True):
        every = sorted((-s, i) for b in blocks for i, s in zip(b.ids.tolist(), b.scores(t, w).tolist(), strict=True) if s > 0)[:5]
        assert [(-s, i) for s, i in zip(own.scores.tolist(), own.ids.tolist(), strict=True)] == every
        assert all((b.bounds(t, w, np.array([0]))[0] >= b.scores(t, w)).all() for b in blocks)


def test_empty_tables(spark, corpus):
    docs, items = corpus
    none, q = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert ls.ranked_search(none, q).collect() == []
    assert ls.ranked_search(spark.createDataFrame(docs[:5], "doc_id long, text string"), q.limit(0)).collect() == []


def test_query_is_its_sql(spark, sf):
    check(spark, queries.QUERIES["op12_block_max_search"], queries.ORACLE["op12_block_max_search"], sf)
