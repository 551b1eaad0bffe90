"""Each operator against brute force, on edge cases and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

sentencepiece = pytest.importorskip("sentencepiece")
import public_tokenizers as P  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quillon.llm import exact_dedup, fingerprints, html_text, line_dedup, near_dedup, packing, pii, quality, queries, scratch, sentencepiece_codec, shingles, toxicity  # noqa: E402

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions near old rivers and quiet hills".split()
LONG = " ".join(WORDS[i * 7 % len(WORDS)] + str(i % 97) for i in range(6000))
TEXTS = [None, "", "   \n\t ", "one", "a b", " ".join(WORDS), " ".join(WORDS), "  ".join(WORDS), " ".join(WORDS[:-1] + ["plains"]), " ".join(WORDS).upper(), LONG, LONG + " tail", "é ü 日本語 😀 x", "a\x0bb\x0cc", " ".join(WORDS[::-1])]


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases with a clashing extra column, shuffled ids and one repeated row."""
    rows = [(100 - 3 * i, t, "en", f"s{i % 3}", len(t or ""), i) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[5]], "doc_id long, text string, lang string, source string, n_chars long, label int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, r)
    return out


def texts_of(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_exact_duplicates(docs, none):
    got = exact_dedup.exact_duplicates(docs).collect()
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, got)) == want
    assert exact_dedup.exact_duplicates(none).count() == 0


def test_exact_duplicates_by_content(spark):
    """Nothing but whole contents decides: all texts share what orders them, and frequent ones are split by salts."""
    rows = [(i, "same text of many rows" if i % 3 else f"text {i % 40}") for i in range(3000)] + [(None, "same text of many rows"), (None, "alone"), (7, "text 1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    low = {t: min((i for i in v if i is not None), default=None) for t, v in groups.items()}
    want = sorted([(i, low[t], len(groups[t]), i == low[t]) for i, t in rows], key=repr)
    for out in (exact_dedup.exact_duplicates(df, spread=lambda x: F.lit(0), frequent=10**9), exact_dedup.exact_duplicates(df, spread=lambda x: F.lit(0), frequent=10), exact_dedup.exact_duplicates(df)):
        assert sorted([tuple(r)[:4] for r in out.collect()], key=repr) == want


def near_truth(docs):
    sets = {}
    for i, t in texts_of(docs).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates(docs, none):
    out = near_dedup.near_duplicates(docs)
    assert out.count() == docs.count()
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(out).items()} == near_truth(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.collect())
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.one_of_each(docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "label"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in near_truth(docs).values()})


def test_near_duplicates_in_a_large_group(spark, monkeypatch):
    """A hub with many copies, in buckets that are cut into blocks."""
    from quillon.llm import near

    monkeypatch.setattr(near, "BLOCK", 8)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(int(rng.integers(1, 5))):
            own[int(rng.integers(len(own)))] = f"x{rng.integers(10**6)}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(near_dedup.near_duplicates(df)).items()} == near_truth(df)


def test_circulant_signatures_estimate_jaccard():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sig = shingles.CirculantMinHash(1024).signatures([x[:2000], x[1000:]])
    assert (sig[0] == sig[1]).mean() == pytest.approx(1 / 3, abs=0.06)


def lines_truth(rows, percent=80):
    """By brute force on stretches of five characters, with white space normalised by the test's own rule."""
    plain = lambda x: re.sub(r"[\x20\x09\x0B-\x0D]+", " ", x).strip(" ")
    occ = [(i, n, x) for i, t in sorted(rows) for n, x in enumerate(map(plain, (t or "").split("\n"))) if x]
    sets = {x: {x[k : k + 5] for k in range(max(1, len(x) - 4))} for _, _, x in occ}
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
    first, drops = {}, defaultdict(set)
    for i, n, x in occ:
        r = find(x)
        if first.setdefault(r, (i, n)) != (i, n):
            drops[i].add(n)
    return drops


def test_lines(spark, docs, none):
    foot = "This is the footer line that every single page of the site carries around"
    rows = [(1, f"Alpha line that stands alone in the first document\n{foot}\nshort"), (2, f"{foot}!\nBeta line that stands alone in the second document\nshort"), (3, f"  {foot} \n{foot}"), (4, None), (5, ""), (6, foot.replace("single", "only")), (7, "x" * 30000 + "\n" + "y" * 25)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = by_id(line_dedup.dedup_lines(df))
    drops = lines_truth(rows)
    for i, t in rows:
        want = t if i not in drops else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drops[i])
        assert got[i].text == want and got[i].n_dropped == len(drops.get(i, ()))
    assert line_dedup.dedup_lines(none).count() == 0
    out = line_dedup.dedup_lines(docs)
    assert out.count() == docs.count()
    held = [(r.doc_id, r.text) for r in docs.distinct().collect()]
    drops = lines_truth(held)
    assert {i: r.n_dropped for i, r in by_id(out).items()} == {i: len(drops.get(i, ())) for i, _ in held}


def check_packing(pieces, ids, size):
    own, windows = defaultdict(list), defaultdict(list)
    for r in pieces:
        own[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, x in ids.items():
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(x) and zlib.crc32(x[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(x)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size
    return len(windows)


def word_ids(texts):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x in texts.items()}


def test_packing(spark, docs, none):
    one = docs.distinct().coalesce(1)
    ids = word_ids(texts_of(one))
    n = check_packing(packing.pack_documents(one, P.path("word_bpe_49k.json"), 256).collect(), ids, 256)
    # Open windows may leave 2 % of the ids as padding, and there is one padded window beside them.
    assert n * 256 <= 1.02 * sum(map(len, ids.values())) + 256
    assert packing.pack_documents(none, P.path("word_bpe_49k.json")).count() == 0
    assert packing.pack_documents(docs, P.path("word_bpe_49k.json")).select("doc_id").where(F.col("doc_id") == 85).count() == 2


def test_levels_place_most_items(spark):
    """Items that leave whole in the window that the level array gave them, over the smallest table in one task."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    t = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    out = list(packing.pack(zip([r.doc_id for r in rows], t.ids([r.text for r in rows], 1), strict=True), 2048))
    parts = Counter((doc, start // 2048) for doc, start, *_ in out)
    assert sum(n == 1 for n in parts.values()) >= 0.95 * len(parts)
    assert len({r[4] for r in out}) * 2048 <= 1.021 * sum(len(r[2]) for r in out) + 2048


def test_many_open_windows(monkeypatch):
    """Sizes that never fit together: memory stays bounded, nothing is lost, little is padded."""
    monkeypatch.setattr(packing.LevelPacker, "MOST_OPEN", 50)
    docs = [(i, np.full(60 + i % 3, i, "<u4")) for i in range(1000)]
    out = list(packing.pack(iter(docs), 100))
    got = defaultdict(list)
    for doc, start, ids, total, _, _ in out:
        got[doc].append((start, len(ids)))
        assert total == 60 + doc % 3 and (ids == doc).all()
    assert all(sum(n for _, n in v) == 60 + i % 3 for i, v in got.items()) and len(got) == 1000
    total = sum(len(x) for _, x in docs)
    assert len({r[4] for r in out}) * 100 <= 1.1 * total


def test_another_tokenizer_is_refused():
    with pytest.raises(ValueError):
        packing.WordTokenizer(P.path("byte_bpe_50k.json"))


def test_levels_minimise_squares():
    rng = np.random.default_rng(2)
    packer = packing.LevelPacker(20)
    for _ in range(400):
        n = int(rng.integers(1, 20))
        before = packer.counts.copy()

        def total(h):
            c = before.copy()
            if h:
                c[h] -= 1
            if h + n < 20:
                c[h + n] += 1
            return int((c**2).sum())

        level = packer.level(n)
        assert total(level) == min(total(h) for h in range(20 - n + 1) if h == 0 or before[h])
        packer.place((0, 0, np.zeros(n, "<u4"), n))


def test_word_tokenizer_is_exact():
    t = packing.WordTokenizer(P.path("word_bpe_49k.json"))
    assert t.check([x or "" for x in TEXTS] + ["don't IT'S ''s '''s we'll'd", "İ ÀÉß × é", "<|endoftext|>a a<|startoftext|>", "a b", "½² 12a3", "Å're"])


def test_codec_is_exact(docs, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    codec = sentencepiece_codec.load(P.path("piece_bpe_32k.model"))
    for t in [*(x or "" for x in TEXTS), "▁", "a▁b", "\n\n a", "<s>", "a" * 3000, " " * 90, "😀\n😀  ", "x." * 9]:
        ids = sp.encode(t)
        assert codec.encode(t) == ids and codec.decode(ids) == sp.decode(ids)
        spans, raw = codec.spans(t), t.encode()
        assert [s[0] for s in spans] == ids
        assert codec.digests(t)[3] == hashlib.sha256(np.array([s[2] for s in spans], "<u8").tobytes()).hexdigest()
        assert all(a[2] == b[1] for a, b in zip(spans, spans[1:])) and (not spans or (spans[0][1], spans[-1][2]) == (0, len(raw)))
    got = by_id(sentencepiece_codec.encode_documents(docs, P.path("piece_bpe_32k.model"), digests=True))
    for i, t in texts_of(docs).items():
        ids = sp.encode(t)
        assert tuple(got[i])[1:4] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest())
        assert got[i].ends_sha256 == hashlib.sha256(np.array([s[2] for s in codec.spans(t)], "<u8").tobytes()).hexdigest()
    full = by_id(sentencepiece_codec.encode_documents(docs, P.path("piece_bpe_32k.model")))
    assert all(r.ids == sp.encode(texts_of(docs)[i]) for i, r in full.items())
    assert sentencepiece_codec.encode_documents(none, P.path("piece_bpe_32k.model")).count() == 0


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array: 'a' -> 'x', 'ab' -> 'yz'."""
    import struct

    units = [0] * 1024
    root = 256
    units[0] = root << 10
    a = root ^ ord("a")
    units[a] = 512 << 10 | 1 << 8 | ord("a")
    units[a ^ 512] = 1 << 31 | 0  # a place and an offset are combined by exclusive or
    b = a ^ 512 ^ ord("b")
    units[b] = 700 << 10 | 1 << 8 | ord("b")
    units[b ^ 700] = 1 << 31 | 2
    m = sentencepiece_codec.CharacterMap(struct.pack("<I", 4096) + struct.pack("<1024I", *units) + b"x\0yz\0")
    assert m.longest(b"abc", 0) == (2, b"yz") and m.longest(b"aac", 0) == (1, b"x") and m.longest(b"c", 0) is None


def test_pseudonyms(spark, docs, none):
    card, mail = "4111 1111 1111 1111", "die.55@mail4.example.com"
    rows = [(1, f"{card} x {mail} +1 (017) 555-7713 97.51.17.173"), (2, f"{mail}, {card}. 1984-02-29 31/12/1999"), (3, "4111111111111112 300.1.1.1 2023-02-30 000-12-3456 v2.0"), (4, None), (5, ""), (6, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" 123-45-6789 GB82 WEST 1234 5698 7654 32')]
    got = by_id(pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k"))
    assert got[3].text == rows[2][1] and got[3].n_changed == 0 and got[4].text is None and got[5].text == ""
    new_card = re.match(r"\d{4} \d{4} \d{4} \d{4}", got[1].text)[0]
    assert new_card in got[2].text and new_card != card and luhn(new_card.replace(" ", ""))
    new_mail = re.search(r"[a-z]{3}\.\d\d@mail4\.example\.com", got[1].text)[0]
    assert new_mail in got[2].text and new_mail != mail
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4} x \S+ \+1 \(\d{3}\) \d{3}-\d{4} (\d{1,3}\.){3}\d{1,3}", got[1].text)
    assert not any(x in got[6].text for x in ("04dbebab", "123-45-6789", "WEST")) and got[6].n_changed == 3
    iban = re.search(r"GB[\w ]+$", got[6].text)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.pseudonymise(none, "k").count() == 0 and pii.pseudonymise(docs, "k").count() == docs.count()


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(7 * 5 * 3).select(F.array((F.col("id") % 7), (F.floor(F.col("id") / 7) % 5), F.floor(F.col("id") / 35)).alias("v"))
    out = df.select(pii.feistel(F.col("v"), F.array(*(F.lit(x).cast("long") for x in (7, 5, 3))), "k", "t").alias("w")).collect()
    assert len({tuple(r.w) for r in out}) == 105 and all(a < 7 and b < 5 and c < 3 for a, b, c in (r.w for r in out))
    mine = pii_feistel([3, 2, 1], [7, 5, 3], "k", "t")
    assert mine in {tuple(r.w) for r in out}
    assert tuple(df.where("v = array(3L, 2L, 1L)").select(pii.feistel(F.col("v"), F.array(*(F.lit(x).cast("long") for x in (7, 5, 3))), "k", "t")).first()[0]) == mine


def pii_feistel(v, m, key, kind):
    half = len(v) // 2
    (a, b), (ma, mb) = (v[:half], v[half:]), (m[:half], m[half:])

    def shifted(own, mods, other, i):
        base = f"{key}|{kind}|{i}|{','.join(map(str, other))}"
        return [(x + int(hashlib.sha256(f"{base}|{j}".encode()).hexdigest()[:12], 16)) % mods[j] for j, x in enumerate(own)]

    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = shifted(a, ma, b, i)
        else:
            b = shifted(b, mb, a, i)
    return tuple(a + b)


def test_fingerprints(spark, docs, none):
    got = by_id(fingerprints.edited_fingerprints(docs))
    order = sorted(texts_of(docs).items(), reverse=True)
    for (i, x), (_, y) in zip(order, order[1:] + order[:1]):
        n = len(x)
        edited = x[: n - n // 3] + y[: n // 3]
        assert got[i].n_chars == n and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if not x.strip():
            assert got[i].fingerprint == ""
    same = defaultdict(set)
    for i, x in order:
        same[x].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert fingerprints.edited_fingerprints(none).count() == 0


def test_collision_rate_is_generalised_jaccard(spark):
    rng = np.random.default_rng(1)
    rows, want = [], []
    for k in range(40):
        a, b = (" ".join(rng.choice(WORDS, 60)) for _ in range(2))
        x, y = Counter(a.split()), Counter(b.split())
        rows += [(2 * k, a), (2 * k + 1, b)]
        want.append(sum((x & y).values()) / sum((x | y).values()))
    marks = {r.k: r.fingerprint for r in fingerprints.fingerprints(spark.createDataFrame(rows, "k long, text string"), ["k"]).collect()}
    rate = [np.mean(np.array(marks[2 * k]) == np.array(marks[2 * k + 1])) for k in range(40)]
    assert np.mean(rate) == pytest.approx(np.mean(want), abs=0.03)


def test_main_text(spark):
    model = html_text.train(pages=400, epochs=6)
    page = "<html><body><nav><ul><li><a href='/a'>Home</a><li><a href='/b'>News</a></ul></nav><div class='ad'>Buy now.</div><article><h1>A title &amp; more</h1><p><b>First block  of\n text that goes on, with a comma.<br><p>Second block of the article, which is &eacute;crit.</p></article><footer>&copy; x.example.com &middot; All rights.</footer><script>var a='<p>no</p>'</script></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, "v", None), (3, "w", ""), (4, None, "<p"), (1, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_text.main_text(df, model).collect()}
    assert got[1].text == "A title & more\n\nFirst block of text that goes on, with a comma.\n\nSecond block of the article, which is écrit."
    assert got[1].n_chars == len(got[1].text) and got[2].text == got[3].text == "" and html_text.main_text(df, model).count() == 5
    assert html_text.main_text(df.where("false"), model).count() == 0
    right = total = 0
    for p in html_text.sample_pages(60, seed=77):
        blocks = html_text.blocks_of(p)
        y = [b.text.startswith("") for b in blocks]
        for b in blocks:
            b.text = b.text.replace("", "").strip() or "."
        z = model.logits(*html_text.padded([html_text.vectors(blocks)]))[0] > 0
        right += sum(a == b for a, b in zip(y, z, strict=True))
        total += len(y)
    assert right / total > 0.95


def test_lstm_gradients():
    model = html_text.BiLSTM(hidden=3)
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(2, 4, html_text.DIMS)).astype(np.float32), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], np.float32), np.array([[1, 0, 1, 0], [0, 1, 0, 0]], np.float32)

    def loss():
        z = model.logits(x.astype(np.float64), mask).astype(np.float64)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    for p, g in zip(model.params(), model.gradients(x, mask, y), strict=True):
        at = tuple(int(rng.integers(n)) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def auc(y, s):
    rank = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    y = np.array(y)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_quality(spark, docs, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = by_id(queries.op8_attention_mil(spark, d))
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([y for _, y in held], [r.score for r, _ in held]) > 0.9
    assert np.mean([r.predicted == y for r, y in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert quality.quality_scores(docs, labels.where("false")).count() == docs.count() and quality.quality_scores(none, labels).count() == 0


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, bag, y = rng.normal(size=(7, quality.DIMS)).astype(np.float32), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1, 0, 1], np.float32)
    model = quality.AttentionModel.random(quality.DIMS, 4, 3)
    params = [model.W, model.V, model.U, model.w, model.c]

    def loss():
        f = model.forward(x, bag, 3)["f"].astype(np.float64)
        return (np.logaddexp(0, f) - y * f).mean()

    for p, g in zip(params, model.gradients(x, bag, y), strict=True):
        at = tuple(int(rng.integers(n)) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_toxicity(spark, docs, none):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = by_id(queries.op3_nonnegative_pu(spark, d))
    held = [(got[r.doc_id], r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    assert auc([y for _, y in held], [r.score for r, _ in held]) > 0.8
    assert np.mean([y for r, y in held if r.predicted]) > 0.8
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert toxicity.toxicity_scores(docs, labels.where("false")).count() == docs.count() and toxicity.toxicity_scores(none, labels).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    from oracle import check

    check(spark, queries.QUERIES[name], queries.ORACLE[name], sf)


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.dtypes
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, scratch.table(stage(spark, docs, sf), "test")
        if name != "packing":
            assert docs.dtypes == columns
        if name == "quality classifier":
            kept = {r.doc_id for r in docs.collect()}
            assert np.mean([(i in kept) == bool(y) for i, y in labels.items()]) > 0.9
        elif name == "line dedup":
            drops = lines_truth([(r.doc_id, r.text) for r in before.collect()])
            old = texts_of(before)
            assert all(r.text == (old[r.doc_id] if r.doc_id not in drops else "\n".join(x for n, x in enumerate(old[r.doc_id].split("\n")) if n not in drops[r.doc_id])) for r in docs.collect())
        elif name == "MinHash near-dedup":
            assert {r.doc_id for r in docs.collect()} == {c for _, c in near_truth(before).values()}
        elif name == "packing":
            check_packing(docs.collect(), word_ids(texts_of(before)), 2048)
