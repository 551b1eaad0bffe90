"""License scans, against all blocks of all templates."""

import random
import re

import pytest

from quillon.llm import license_scan as lic
from quillon.llm import queries
from quillon.llm.terms import terms
from tests.oracle import check

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, text):
    own = words(text)
    base = [(i, label) for phrase, label in lic.PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
    found, best = {label for _, label in base}, 0.0
    for template, label in lic.TEMPLATES:
        t = words(template)
        for begin in range(0, len(own), len(t)):
            n = len(set(t) & set(own[begin : begin + 2 * len(t)]))
            if 100 * n >= lic.PERCENT * len(set(t)):
                found.add(label)
                best = max(best, n / len(set(t)))
    places = [i for i, _ in base]
    return (doc, len(own), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(found)), 1.0 if base else best)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    pool = sorted({w for t, _ in lic.TEMPLATES for w in words(t)}) + ["lorem", "ipsum", "Ünder", "日本"]
    out = []
    for i in range(250):
        own = rng.choices(pool, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            phrase = rng.choice([t for t, _ in lic.TEMPLATES] + [p for p, _ in lic.PHRASES]).split()
            if rng.random() < 0.5:
                phrase = [w for w in phrase if rng.random() > 0.08]
            if rng.random() < 0.2:
                rng.shuffle(phrase)
            at = rng.randint(0, len(own))
            own[at:at] = phrase
        out.append((i, rng.choice([" ", "\n", " -- "]).join(own)))
    return out + [(900, None), (901, ""), (902, "..."), (903, "cc by nc cc by nc CC-BY-NC"), (904, "word " * 5000 + "Released under the MIT License."), (5, out[5][1]), (5, "another text"), (None, "cc by nc")]


def test_every_block_is_found(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, matches string").repartition(3)
    got = lic.license_scan(df)
    want = sorted((brute(*r) for r in rows), key=repr)
    assert sorted((tuple(r)[:-1] for r in got.collect()), key=repr) == want
    assert sum(bool(x[6]) for x in want) > 60 and sum(not x[6] for x in want) > 30


def test_matches_are_spans_of_words(spark):
    text = "one two three " * 20 + "This work is licensed under the GNU General Public License, version 3." + " four" * 40
    (row,) = lic.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    at = words(text).index("gnu")
    assert row.labels == "gpl-3" and row.base_labels == "" and row.score == 1.0
    assert all(m.begin <= at < m.end and m.label == "gpl-3" for m in row.matches)


def test_filters_lose_nothing():
    rng = random.Random(9)
    names = [f"w{i}" for i in range(14)]
    for percent in (50, 75, 90, 100):
        templates = [(" ".join(rng.choices(names, k=rng.randint(1, 9))), str(i)) for i in range(12)]
        own = lic.Templates(templates, percent, {w.encode(): rng.randint(0, 5) for w in names})
        for _ in range(60):
            text = terms(" ".join(rng.choices([*names, "x", "y"], k=rng.randint(0, 40))))
            want = []
            for t, (template, _) in enumerate(templates):
                one = terms(template)
                for b in range(-(-len(text) // len(one))):
                    n = len(set(one) & set(text[b * len(one) : (b + 2) * len(one)]))
                    if 100 * n >= percent * len(set(one)):
                        want.append((t, b, n))
            assert own.matches(text) == want


def test_clean_documents_stay_without_labels(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    wrong = lic.license_scan(docs).where("labels <> ''").join(docs, "doc_id").where("not text rlike '(?i)licen[sc]e'")
    assert wrong.count() == 0


def test_empty_table(spark):
    assert lic.license_scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_is_its_sql(spark, sf):
    check(spark, queries.QUERIES["op13_set_similarity_licenses"], queries.ORACLE["op13_set_similarity_licenses"], sf)
