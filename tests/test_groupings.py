"""Groupings in rounds, against loops that take one thing after the other; terms by automaton, against all products."""

import datetime as dt
import random

import numpy as np
import pytest
from test_operators import linkage, rows

from quillon.operators import entities, grouping


def greedy(docs, edges, hours=72.0):
    older = {}
    for a, b, d in edges:
        older.setdefault(max(a, b), []).append((d, min(a, b)))
    ids = {x for a, b, _ in edges for x in (a, b)}
    found = {}
    for i in sorted(ids, key=lambda i: (docs[i] is not None, docs[i] or dt.datetime.min, i)):
        for _, j in sorted(older.get(i, [])):
            late = docs[i] is not None and docs[j] is not None and abs((docs[i] - docs[j]).total_seconds()) > hours * 3600
            if j not in found and not late:
                found[i] = j
                break
    return {i: found.get(i) for i in ids}


@pytest.mark.parametrize("chain", [False, True])
def test_greedy_duplicates_against_a_loop(spark, chain):
    rng = random.Random(3)
    n = 60 if chain else 2000
    docs = {i: None if rng.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=i if chain else rng.randint(0, 400)) for i in range(n)}
    if chain:  # each row waits for the one before
        edges = [(i, i + 1, 0.1) for i in range(20)] + [(30, i, 0.2) for i in range(31, 60)]
    else:
        edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), round(rng.random(), 2)) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(6000)) if a != b}.values())
    df = spark.createDataFrame(list(docs.items()), "id long, published timestamp")
    got = grouping.greedy_duplicates(df, spark.createDataFrame(edges, "a long, b long, distance double"))
    assert {r.id: r.duplicate_of for r in got.collect()} == greedy(docs, edges)


def test_greedy_duplicates_of_no_edges(spark):
    docs = spark.createDataFrame([(1, None)], "id long, published timestamp")
    assert grouping.greedy_duplicates(docs, spark.createDataFrame([], "a long, b long, distance double")).collect() == []


def test_complete_linkage_of_many_vectors(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(16, 8))
    x = np.vstack([b + 0.3 * rng.normal(size=(6, 8)) for b in base])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v, order = dict(enumerate(x)), {i: int(o) for i, o in enumerate(rng.permutation(len(x)))}
    edges = {(i, j): float(np.linalg.norm(v[i] - v[j])) for i in v for j in v if i < j and np.linalg.norm(v[i] - v[j]) <= 0.7}
    df = spark.createDataFrame([(i, order[i], [float(t) for t in x]) for i, x in v.items()], "id long, ord long, v array<double>")
    e = spark.createDataFrame([(a, b, d) for (a, b), d in edges.items()], "a long, b long, distance double")
    got = {r.id: r.cluster for r in grouping.complete_linkage(df, e, 0.75, 0.6, 5).collect()}
    want = linkage(v, sorted(v, key=order.get), edges, 0.75, 0.6, 5)
    assert got == want and len(set(want.values())) < 0.8 * len(want)


def stories(events, shared, docs, window, similarity):
    spans, people = {e: (lo, hi) for e, lo, hi in events}, {}
    for e, p in shared:
        people.setdefault(p, set()).add(e)
    vec, count = {e: [] for e in spans}, {e: 0 for e in spans}
    for e, _, v in docs:
        count[e] += 1
        if v is not None:
            vec[e].append(v)
    least = lambda a, b: min((float(np.dot(x, y)) for x in vec[a] for y in vec[b]), default=None)
    pairs = {(a, b) for own in people.values() for a in own for b in own if a < b}
    pairs = [(max(0, max(spans[a][0], spans[b][0]) - min(spans[a][1], spans[b][1])), -(s if (s := least(a, b)) is not None else -1), a, b) for a, b in pairs]
    first, root, members = dict(spans), {e: e for e in spans}, {e: [e] for e in spans}
    for _, _, a, b in sorted(pairs):
        ra, rb = root[a], root[b]
        lo, hi = min(spans[ra][0], spans[rb][0]), max(spans[ra][1], spans[rb][1])
        s = least(ra, rb)
        if ra == rb or hi - lo > window or s is None or s < similarity:
            continue
        spans[ra], vec[ra] = (lo, hi), vec[ra] + vec[rb]
        for e in members[rb]:
            root[e] = ra
        members[ra] += members.pop(rb)
    return sorted((e, min(own, key=lambda x: (-count[x], first[x][0], x))) for own in members.values() if len(own) > 1 for e in own)


def test_stories_against_a_loop(spark):
    rng = np.random.default_rng(4)
    day = 86400.0
    base = rng.normal(size=(6, 5))
    events, shared, docs = [], [], []
    for e in range(120):
        lo = float(rng.integers(0, 40)) * day / 2
        events.append((e, lo, lo + float(rng.integers(0, 5)) * day / 2))
        shared += [(e, f"p{rng.integers(0, 6)}") for _ in range(2)] + [(e, "everyone")]
        for d in range(int(rng.integers(0, 4))):
            v = base[e % 6] + 0.25 * rng.normal(size=5)
            docs.append((e, 10 * e + d, None if rng.random() < 0.05 else [float(x) for x in v / np.linalg.norm(v)]))
    got = grouping.link_stories(spark.createDataFrame(events, "event long, lo double, hi double"), spark.createDataFrame(shared, "event long, person string"), spark.createDataFrame(docs, "event long, document long, v array<double>"), 6.0, 0.8)
    want = stories(events, shared, docs, 6 * day, 0.8)
    assert rows(got) == want and len(want) > 20


def test_events_of_a_person_meet_only_nearby(spark):
    events = spark.createDataFrame([(i, 86400.0 * 7 * i, 86400.0 * 7 * i) for i in range(300)], "event long, lo double, hi double")
    shared = events.selectExpr("event", "'everyone' as person")
    assert rows(grouping.shared_within(events, shared, 10 * 86400.0).select("a", "b")) == [(i, i + 1) for i in range(299)]


@pytest.mark.parametrize("chars", [25, 10**6])
def test_terms_by_automaton(spark, chars):
    rng = random.Random(7)
    syllables = ["an", "the", "ther", "re", "Über", "in", "日本語", "c++", "x"]
    text = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    indicators = [(i, text(rng.randint(1, 6))) for i in range(30)] + [(90, None), (91, "a b"), (92, ""), (93, "the the the zzz"), (94, "  the  ")]
    titles = [(i, text(rng.randint(1, 10))) for i in range(80)] + [(200, None), (201, "")]
    got = entities.triggered(spark.createDataFrame(indicators, "indicator_id long, label string"), spark.createDataFrame(titles, "event_id long, title string").repartition(3), chars)
    want = []
    for i, label in indicators:
        terms = [w for w in (label or "").lower().split() if len(w) > 2]
        for e, title in titles:
            n = sum(t in (title or "").lower() for t in terms)
            if terms and title is not None and n >= (len(terms) if len(terms) <= 2 else -(-len(terms) // 2)):
                want.append((i, e, n))
    assert rows(got) == sorted(want) and want
