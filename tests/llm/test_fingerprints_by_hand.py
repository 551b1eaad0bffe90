"""Fingerprints against the same draws in plain Python, over ids that lie far apart."""

import math
import struct
from collections import Counter

import pytest

pytest.importorskip("sentencepiece")
import xxhash  # noqa: E402

from quillon.llm import fingerprints  # noqa: E402


def sample(word, n, k):
    term = xxhash.xxh64(word.encode(), seed=42).intdigest()

    def drawn(i):
        return xxhash.xxh64(struct.pack("<i", i), seed=xxhash.xxh64(struct.pack("<Q", term), seed=42).intdigest()).intdigest()

    h, g = drawn(2 * k), drawn(2 * k + 1)
    part = lambda x, at, bits: ((x >> at & (1 << bits) - 1) + 0.5) * 2.0**-bits
    r = -math.log(part(h, 0, 32) * part(h, 32, 31))
    log_c, b = math.log(-math.log(part(g, 0, 21) * part(g, 21, 21))), part(g, 42, 21)
    level = math.floor(math.log(n) / r + b)
    rank = log_c - r * (level - b) - r
    return math.floor((min(max(rank, -96.0), 31.0) + 96) * 2.0**31) << 24 | (h ^ level) & 0xFFFFFF


def marks(text):
    words = Counter(w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w)
    return [min(sample(w, n, k) for w, n in words.items()) & 0xFFFFFF for k in range(fingerprints.COORDINATES)] if words else None


def likeness(a, b):
    return 1.0 if a is b is None else 0.0 if None in (a, b) else sum(x == y for x, y in zip(a, b)) / fingerprints.COORDINATES


@pytest.mark.parametrize("drawn", [1 << 15, 3, 1])
def test_every_row(spark, monkeypatch, drawn):
    monkeypatch.setattr(fingerprints, "DRAWN", drawn)
    monkeypatch.setattr(fingerprints, "SAMPLED", 2)
    base = "one two two three three three\tfour four\nfive six seven eight nine ten eleven twelve".split(" ")
    rows = [((-7) ** i * 8**i, " ".join(base[i % 5 :] + base[: i * 2 % 7] + ["w%d" % (i % 3)] * i)) for i in range(10)]
    rows += [(5, None), (6, ""), (7, "é one é"), (7, "é one é"), (9, "   "), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = {i: t or "" for i, t in rows if i is not None}
    order = sorted(texts, reverse=True)
    want = {}
    for i, j in zip(order, order[1:] + order[:1]):
        x, y = texts[i], texts[j]
        third = len(x) // 3
        edited = x[: len(x) - third] + y[:third]
        want[i] = (marks(x), marks(edited), likeness(marks(x), marks(edited)), likeness(marks(x), marks(y)))
    show = lambda m: "".join("%06x" % v for v in m or [])
    got = fingerprints.edited_fingerprints(df).collect()
    assert len(got) == len(want)
    for r in got:
        own, changed, near_edited, near_next = want[r.doc_id]
        assert (r.fingerprint, r.edited_fingerprint) == (show(own), show(changed))
        assert (r.near_edited, r.near_next) == (pytest.approx(near_edited), pytest.approx(near_next))


def test_few_samples_in_a_plan(spark, monkeypatch):
    """A plan that draws each coordinate in an expression of its own fills the driver's memory."""
    drawn, whole = [], fingerprints.sample
    monkeypatch.setattr(fingerprints, "sample", lambda *a: drawn.append(a) or whole(*a))
    rows = [(1, "a b c"), (2, "d e d f")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(drawn) <= 2 * fingerprints.COORDINATES // 6
    assert {r.doc_id: r.fingerprint for r in got} == {i: "".join("%06x" % v for v in marks(t)) for i, t in rows}
