"""Alignment of two tokenizers, against plain loops over all bytes and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("sentencepiece")
pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from quillon.llm import alignment, queries  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """doc_id -> figures, from whole texts: every pair of tokens is compared, every gap looked at."""
    own = alignment.Aligner(A, B)
    held = []
    for doc, text in rows:
        if not text:
            held.append((doc, [], [], []))
            continue
        a, b = own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)
        sides = []
        for ids, bytes_of in ((a, own.bytes_a), (b, own.bytes_b)):
            at, spans = 0, []
            for i in ids:
                spans.append((at, at + len(bytes_of[i]), i))
                at += len(bytes_of[i])
            sides.append((spans, b"".join(bytes_of[i] for i in ids)))
        (sa, wa), (sb, wb) = sides
        if not wa == wb == (" " + text).encode():
            sa, sb = [], []
        links = [(x[2], y[2]) for x in sa for y in sb if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups, begin = [], 0
        for end in ends:
            groups.append(tuple(",".join(str(x[2]) for x in side if begin <= x[0] < end) for side in (sa, sb)))
            begin = end
        held.append((doc, [len(sa), len(sb), len(groups), len(links)], links, groups))
    counts = Counter(p for *_, links, _ in held for p in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc, sizes, links, groups in held:
        sha = hashlib.sha256(";".join(f"{x}|{y}" for x, y in groups).encode()).hexdigest() if groups else ""
        out.append((doc, *(sizes or [0] * 4), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), sha))
    return sorted(out, key=repr)


ODD = [
    "", None, " ", "  ", " x", "x ", "a  b", "a \n b", "tab\there  and there", "▁mark", "a ▁ b", "ünïcödé – 日本語 текст 😀😀", "<s> </s> <unk> <|endoftext|> <0x0A> it's we'll 'tis",
    "\n\n\n", "x\n\n  y　 z", "1234567 890,00 -- !!! (a) [b]", "\x00\x01\x1c \x1d y", "é ​ z", "can't  don't   won't", "word " * 50, "q" * 300,
]


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_digests_are_those_of_all_pairs(spark):
    rows = list(enumerate(ODD)) + [(5, "a  b"), (None, "null id"), (3, "a  b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert as_rows(alignment.alignment_digests(df, A, B)) == brute(rows)


def test_random_texts_over_few_characters(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice(["a", "th", "e", " ", "  ", "\n", "'s", "é", "日", "1", ".", " "]) for _ in range(rng.randint(1, 40)))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert as_rows(alignment.alignment_digests(df, A, B)) == brute(rows)


def test_small_blocks_and_a_small_memo_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    words = ["the", "cat", "sat,", "naïve", "on", "x9", "mat."]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    monkeypatch.setattr(alignment, "BLOCK", 100)
    monkeypatch.setattr(alignment, "TOGETHER", 4)
    monkeypatch.setattr(alignment.Aligner, "MEMO", 5)
    own = alignment.Aligner(A, B)
    block = alignment.Block()
    own.learn({x for _, t in rows for x in own.stretches(t)})
    for i, t in rows:
        block.add(own, i, own.stretches(t), len(t))
    row = block.row(own, 0).to_pylist()[0]
    assert own.full() and list(zip(*(row[c] for c in ("n_a", "n_b", "n_groups", "n_links")), strict=True)) == [r[1:5] for r in sorted(brute(rows))]
    assert as_rows(alignment.alignment_digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), A, B)) == brute(rows)


def test_query_on_the_given_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in rows if len(r[1] or "") < 1200]
    whole = queries.QUERIES["op11_interval_alignment"](spark, sf)
    assert whole.count() == len(rows)
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert as_rows(alignment.alignment_digests(df, A, B)) == brute(short)
    by_id = {r.doc_id: r for r in whole.collect()}
    for doc, n_a, n_b, n_groups, n_links, *_, sha in brute(short):
        assert tuple(by_id[doc])[1:5] == (n_a, n_b, n_groups, n_links) and by_id[doc].groups_sha256 == sha


def test_whole_lists(spark):
    rows = [(1, "naïve cats"), (2, None), (3, "▁")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, links string")
    got = {r.doc_id: r for r in alignment.align_documents(df, A, B).collect()}
    own = alignment.Aligner(A, B)
    x = got[1]
    assert [list(v) for v in (x.a, x.b)] == [own.a.encode(" naïve cats", add_special_tokens=False).ids, own.b.encode("naïve cats")]
    assert x.groups[0].begin == 0 and x.groups[-1].end == len(" naïve cats".encode()) and x.groups[-1].a_to == len(x.a) and x.groups[-1].b_to == len(x.b)
    assert all(g.end == h.begin for g, h in zip(x.groups, x.groups[1:], strict=False))
    assert len(x.links) == len(x.a) + len(x.b) - len(x.groups)
    assert all(not got[i].a and not got[i].groups and not got[i].links for i in (2, 3))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment_digests(df, A, B).collect() == [] and alignment.align_documents(df, A, B).collect() == []


def test_index_of_intervals_that_overlap_each_other():
    rng = random.Random(1)
    spans = sorted((b := rng.randint(0, 50), b + rng.randint(1, 12)) for _ in range(40))
    index = alignment.IntervalIndex(*(np.array([x[k] for x in spans]) for k in (0, 1)))
    asked = [(begin, end) for begin in range(60) for end in range(begin + 1, 64)]
    found = index.overlapping(*(np.array([x[k] for x in asked]) for k in (0, 1)))
    want = [(k, i) for k, (begin, end) in enumerate(asked) for i, (b, e) in enumerate(spans) if b < end and e > begin]
    assert list(zip(*(x.tolist() for x in found), strict=True)) == want
