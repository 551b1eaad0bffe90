"""Whole given tables against plain versions: exact joins of sets, articles of pages, scores by loops."""

import html
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("sentencepiece")

from quillon.llm import html_text, line_dedup, near_dedup, quality  # noqa: E402


def linked(sets, percent):
    """All pairs of sets with 100 * intersection >= percent * union, by an index of the rarest elements of each."""
    frequency = Counter(e for s in sets for e in s)
    index, links = defaultdict(list), []
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        own = sorted(sets[i], key=lambda e: (frequency[e], e))
        first = own[: len(own) - math.ceil(percent * len(own) / 100) + 1]
        for j in {j for e in first for j in index[e]}:
            if 100 * len(sets[j]) >= percent * len(own) and 100 * (both := len(sets[i] & sets[j])) >= percent * (len(own) + len(sets[j]) - both):
                links.append((i, j))
        for e in first:
            index[e].append(i)
    return links


def least_of(n, links, rank):
    """The smallest rank that links reach from each of n things."""
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)), key=rank)
        root[y] = x
    return [find(i) for i in range(n)]


def test_documents_by_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    first, size = {}, {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").toLocalIterator():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        own = frozenset(hash(tuple(w[k : k + 5])) for k in range(max(1, len(w) - 4))) if w else None
        size[r.doc_id] = (own, 0 if own is None else len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
        if own is not None:
            first.setdefault(own, r.doc_id)
    sets = list(first)
    ids = [first[s] for s in sets]
    links = linked(sets, 75)
    label = dict(zip(sets, (ids[k] for k in least_of(len(sets), links, lambda k: ids[k])), strict=True))
    want = {i: (n, i if own is None else label[own]) for i, (own, n) in size.items()}
    assert len(links) > 50
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()} == want


def test_lines_by_an_exact_join(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    places = defaultdict(list)
    for r in docs.select("doc_id", "text").where("text is not null").orderBy("doc_id").collect():
        for n, x in enumerate(map(line_dedup.normalised, r.text.split("\n"))):
            if x:
                places[x].append((r.doc_id, n))
    lines = list(places)
    links = linked([frozenset(x[i : i + 5] for i in range(max(1, len(x) - 4))) for x in lines], 80)
    low = [min(places[x]) for x in lines]
    drops = defaultdict(list)
    for x, k in zip(lines, least_of(len(lines), links, lambda k: low[k]), strict=True):
        for i, n in places[x]:
            if (i, n) != low[k]:
                drops[i].append(n)
    want = {(i, n) for i, own in drops.items() for n in own}
    assert len(links) > 50
    for slack in (line_dedup.SLACK, 1):
        got = {(r.doc_id, n) for r in line_dedup.dropped_lines(docs, slack=slack).collect() for n in r.drops}
        assert got <= want and len(got) >= 0.999 * len(want)


INLINE = re.compile(r"</?(?:a|abbr|b|big|cite|code|em|i|small|span|strong|sub|sup|u)\b[^>]*>")


def article(page):
    inner = re.search(r"(?s)<article[^>]*>(.*?)</article>", page)
    parts = re.split(r"<[^>]+>", INLINE.sub("", re.sub(r"<br\s*/?>", " ", inner[1]))) if inner else []
    return [t for x in parts if (t := " ".join(html.unescape(x).split()))]


def test_articles_of_the_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    truth = {r.page_id: article(r.html or "") for r in pages.collect()}
    got = {r.page_id: r.text.split("\n\n") if r.text else [] for r in html_text.main_text(pages).collect()}
    assert got.keys() == truth.keys()
    found = sum((Counter(got[i]) & Counter(truth[i])).total() for i in truth)
    wanted, given = sum(map(len, truth.values())), sum(map(len, got.values()))
    assert wanted > 1000 and found >= 0.995 * wanted and found >= 0.995 * given


def test_a_very_long_page_is_read_whole(spark):
    blocks = [f"This is block number {i} of the article, and it goes on for some words." for i in range(4000)]
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>On long pages, and more</h1>" + "".join(f"<p>{x}</p>" for x in blocks) + "</article><footer>&copy; x.example</footer></body></html>"
    got = html_text.main_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text.split("\n\n")
    assert sum((Counter(got) & Counter(blocks)).values()) >= 0.999 * len(blocks) and len(got) <= len(blocks) + 2


def test_scores_of_passages_by_a_loop():
    rng = np.random.default_rng(2)
    texts = ["", None, "Short.", "".join(map(chr, rng.integers(32, 900, 1500))), "a line\n" * 400]
    model = quality.AttentionModel.random(quality.DIMS, seed=5)
    W, V, U, w, c = (p.astype(float) for p in (model.W, model.V, model.U, model.w, model.c))

    def encoded(part):
        counts, n = np.zeros((16, 16)), max(1, len(part[1]))
        for a, b in part[1]:
            counts[a, b] += 1
        again = sorted((x / n for x in part[2]), reverse=True)
        return np.concatenate([np.sqrt(counts.ravel() / n), 3 * np.array(again), [min(n, 512) / 512, 1.0]])

    def cut(text):
        """The passages of a text: their number, pairs of classes within the text, and counts of bytes that come again."""
        data = (text or "").encode()
        kinds = [int(quality.BYTE_CLASS[b]) for b in data]
        for at in range(0, max(1, len(data)), 512):
            inside = range(at, min(at + 512, len(data)))
            yield at, [(kinds[i - 1], kinds[i]) for i in inside if i > 0], [sum(i >= k and data[i] == data[i - k] for i in inside) for k in quality.LAGS]

    want = []
    for text in texts:
        hs = [np.tanh(encoded(p) @ W) for p in cut(text)]
        es = [float((np.tanh(h @ V) / (1 + np.exp(-(h @ U)))) @ w[:, 0]) for h in hs]
        total = sum(map(math.exp, es))
        z = sum(math.exp(e) / total * h for e, h in zip(es, hs, strict=True))
        want.append(1 / (1 + math.exp(-(z @ c[:-1, 0] + c[-1, 0]))))
    x, owner = quality.passages(texts)
    assert model.scores(x, owner, len(texts)) == pytest.approx(want, abs=1e-5)
