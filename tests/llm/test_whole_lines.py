"""Line dedup over all lines, against brute force on stretches of five characters."""

from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("sentencepiece")

from quillon.llm import line_dedup, shingles  # noqa: E402


def stretches(x, k=5):
    return {x[i : i + k] for i in range(max(1, len(x) - k + 1))}


def dropped(rows, percent=80):
    occ = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate(map(line_dedup.normalised, t.split("\n"))) if x]
    sets = {x: stretches(x) for _, _, x in occ}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(sets)
    for k, a in enumerate(names):
        for b in names[:k]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    first, drops = {}, defaultdict(list)
    for i, n, x in occ:
        if first.setdefault(find(x), (i, n)) != (i, n):
            drops[i].append(n)
    return dict(drops)


def test_one_changed_character_in_a_line_of_sixty(spark):
    line = "Der schnelle Fuchs springt über den müden Hund am großen Fluß"
    cyrillic = "Быстрая лиса прыгает через ленивую собаку у большой тихой реки"
    rows = [(1, line), (2, line.replace("den", "dem", 1)), (3, cyrillic), (4, cyrillic.replace("через", "черес"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {2: [0], 4: [0]}
    assert dropped(rows) == want
    assert {r.doc_id: r.drops for r in line_dedup.dropped_lines(df).collect()} == want


def test_stretches_are_told_apart():
    lines = ["", "ab", "ab\0", "abcde", "abcdé", "日本語日本語", "x" * 9]
    elements, owner = shingles.char_shingles(lines)
    got = [set(elements[owner == i].tolist()) for i in range(len(lines))]
    assert [len(g) for g in got] == [1, 1, 1, 1, 1, 2, 1] and len(set.union(*got)) == 8


def test_short_lines_take_part(spark):
    rows = [(1, "Les.\nA line that is long enough to stand in every count\n}"), (2, "Les.\n\n  Les. \nLas.\n}"), (3, "\n\nErheed. Titionly.\nErheed. Titionly"), (4, "Erheed. Titionly.\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {2: [0, 2, 4], 3: [3], 4: [0]}
    assert dropped(rows) == want
    assert {r.doc_id: r.drops for r in line_dedup.dropped_lines(df).collect()} == want
    assert {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}[2] == "\nLas."


def test_blocks_hash_many_contents_at_once(spark, monkeypatch):
    """op1: a call for each member of a block, and a mean for each pair, were most of its time."""
    from quillon.llm import near
    from quillon.llm.shingles import char_shingles

    sigs, own = np.random.default_rng(3).integers(0, 2, (40, 300), dtype=np.uint8), np.ones(300, np.uint8)
    assert np.array_equal(near.agreement(sigs.T, own), (sigs == own).mean(1))
    texts = [f"a line that is told again {'x' * (k % 3)}{k // 20}" for k in range(40)] + ["", "abc", "zq" * 60]
    rows = [(1, 0, False, k, k, bytes([7] * 140), t) for k, t in enumerate(texts)]
    blocks = spark.createDataFrame(rows, "block long, side int, across boolean, id long, label long, sig binary, content string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def elements(lines):
        calls.add(1)
        return char_shingles(lines, 5)

    root = list(range(len(texts)))
    for r in near.alike(blocks, 80, 0.64, elements).collect():
        x, y = root[r.a], root[r.b]
        root = [min(x, y) if z in (x, y) else z for z in root]
    sets = [set(char_shingles([t], 5)[0].tolist()) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = want[i], want[j]
                want = [min(x, y) if z in (x, y) else z for z in want]
    assert root == want and len(set(want)) > 3
    assert 1 <= calls.value <= 2


def test_components_in_few_written_tables(spark, monkeypatch):
    """A path, a hub, and groups whose members hang on several smaller nodes, against one process."""
    from quillon.llm import near

    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 4000)] + [(int(x), int(x) + int(d)) for x, d in zip(rng.integers(5000, 6000, 900), rng.integers(1, 9, 900), strict=True)]
    nodes, least = near.roots(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
    written = []
    monkeypatch.setattr(near, "table", lambda df, name, keep=near.table: written.append(name) or keep(df, name))
    dealt = spark.createDataFrame([edges[i] for i in rng.permutation(len(edges))] + [(1, 1)], "a long, b long").repartition(16)
    got = {r.node: r.label for r in near.components(dealt).collect()}
    assert got == dict(zip(nodes.tolist(), least.tolist(), strict=True))
    assert {got[i] for i in range(100, 401)} == {100} and {got[i] for i in range(1000, 4000)} == {1000}
    assert len(written) <= 10  # it was four a round when each star was a grouped minimum and a join of its own


def test_the_bound_leaves_no_similar_set_out():
    from quillon.llm import near

    rng = np.random.default_rng(3)
    some = lambda n: np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    for _ in range(60):
        x = some(int(rng.integers(1, 300)))
        others = [np.sort(np.r_[x[rng.random(len(x)) < rng.random() ** 0.2], some(int(rng.integers(0, 40)))]) for _ in range(20)]
        may, are = near.may_be_similar(x, others, 80), np.array([near.similar(x, y, 80) for y in others])
        assert not (are & ~may).any() and (may & ~are).sum() <= 3


def test_short_hashes_tell_the_same_stretches_apart():
    lines = ["the first line of some length", "abc", "", "the last line: \U0001f600 of some length"]
    (x, own), (y, other) = shingles.char_shingles(lines, 5), shingles.char_shingles(lines, 5, short=True)
    assert y.dtype == np.uint32 and own.tolist() == other.tolist() and len(set(x.tolist())) == len(set(y.tolist()))
