"""Edge cases of the training-text operators that earlier versions left out."""

import re
from datetime import date

import pytest

pytest.importorskip("sentencepiece")

from quillon.llm import html_text, near_dedup, pii  # noqa: E402


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def with_check(digits):
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def test_card_groupings_and_long_secrets(spark):
    short, long, card = with_check("3056930902590"), with_check("411111111111111112"), "4111 1111 1111 1111"
    a, b = f"{short[:4]} {short[4:10]} {short[10:]}", "-".join(long[i : i + 4] for i in range(0, 19, 4))
    token = "a1b2_" * 3000
    beside = next(f"{i:03}" for i in range(1000) if not luhn(card.replace(" ", "") + f"{i:03}"))
    texts = [a, b, f"{card} {beside}", f"{card} 123-45-6789", f"{card} 12@mail.example.com", f"token = {token}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    for i, t in ((0, short), (1, long)):
        new = got[i].text.replace(" ", "").replace("-", "")
        assert new != t and len(new) == len(t) and luhn(new) and got[i].n_changed == 1
    assert got[2].text[19:] == f" {beside}" and got[2].text[:19] != card and luhn(got[2].text[:19].replace(" ", ""))
    assert got[3].n_changed == 2 and "123-45-6789" not in got[3].text and card not in got[3].text
    assert got[4].n_changed == 2 and card not in got[4].text
    assert len(got[5].text) == len(texts[5]) and "a1b2_a1b2_" not in got[5].text


def test_null_ids_stay_alone(spark):
    words = [f"w{i}" for i in range(60)]
    same, near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = [(None, same), (None, same), (7, same), (5, same), (3, near), (9, "something else")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(3, 3, True), (5, 3, False), (7, 3, False), (9, 9, True), (None, None, True), (None, None, True)], key=repr)
    assert sorted((r.doc_id for r in near_dedup.one_of_each(df).collect()), key=repr) == [3, 9, None, None]


def test_all_words_of_a_block_count():
    head = " ".join(["word"] * 40)
    a, b = (html_text.vectors([html_text.Block(("p",), f"{head} {end * 30}")]) for end in ("alpha ", "gamma "))
    assert (a != b).any()


@pytest.mark.parametrize("tag", sorted(html_text.CLOSED))
def test_elements_without_content(tag):
    texts = lambda page: [b.text for b in html_text.blocks_of(page)]
    assert texts(f"<p>one</p><{tag} class='x'/><p>two</p>") == ["one", "two"]
    assert texts(f"<p>one</p><{tag}><p>two</p>") == ["one", "two"]
    assert texts(f"<p>one</p><{tag}><p>two</p><{tag}>no</{tag}><p>three</p>") == ["one", "two", "three"]
    assert texts(f"<p>one</p><{tag}>no<{tag}>no</{tag}>no</{tag}><p>two</p>") == ["one", "two"]
    assert texts(f"<p>one</p><{tag}/><script>'<{tag}>'</script><p>two</p><script>'</{tag}>'") == ["one", "two"]


@pytest.mark.parametrize("parts", [1, 4])
def test_texts_of_one_id_are_decided_apart(spark, parts):
    a, c = "one two three four five six seven eight nine ten", "red orange yellow green blue indigo violet white black"
    b, near_b = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(59))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (5, near_b, 4), (5, b, 5), (7, c, 6), (8, near_b, 7), (9, None, 8), (9, "", 9), (9, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, mark int").repartition(parts)
    got = near_dedup.one_of_each(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert (5, b) in kept or (5, near_b) in kept
    kept = sorted((i, "b" if t in (b, near_b) else t) for i, t in kept if t is not None)
    assert kept == [(3, a), (5, "b"), (7, c), (9, "")] and got.where("text is null").count() == 1


def test_gaps_of_any_length_and_dates_of_all_years(spark):
    gap = " " * 70
    values = ["31/12/1799", "2201-01-05", "0001-01-01", "9999-12-31", "2024-02-29", "0199/12/31", "01.01.0200", "555 123 4567", "123 45 6789", "10.1.2.3"]
    rows = [(1, f"token:{gap}abcdef1234567890abcd end"), (2, "a@example.com b@example.com"), (3, "v1.2.3.4 stays, 0000-05-05 and 31/02/2020 too")] + [(10 + i, f"x {v} y") for i, v in enumerate(values)]
    rows += [(100 + i, f"on {y:04d}-{m:02d}-28.") for i, (y, m) in enumerate((y, m) for y in range(1, 10000, 371) for m in (2, 12))]
    got = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert re.fullmatch(rf"token:{gap}[0-9a-f]{{20}} end", got[1].text) and got[1].text != rows[0][1]
    assert got[3].text == rows[2][1]
    a, b = re.fullmatch(r"([a-z])@example.com ([a-z])@example.com", got[2].text).groups()
    assert a != b
    for i, v in enumerate(values):
        new = got[10 + i].text[2:-2]
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", v) or v == "10.1.2.3", (v, new)
        assert got[10 + i].n_found == 1 and new != v, v
    dates = [got[100 + i].text[3:-1] for i in range(len(rows) - 13)]
    assert len(set(dates)) == len(dates)
    for text, (_, old) in zip(dates, rows[13:], strict=True):
        date.fromisoformat(text)
        assert (int(text[:4]) + 200) // 400 == (int(old[3:7]) + 200) // 400  # within the same 400 years


def test_one_letter_names_are_permuted_not_shifted(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    df = spark.createDataFrame([(i, f"{c}@example.com") for i, c in enumerate(letters)], "doc_id long, text string")
    new = [r.text[0] for r in sorted(pii.pseudonymise(df, "k").collect())]
    assert sorted(new) == list(letters)
    assert len({(ord(n) - ord(c)) % 26 for n, c in zip(new, letters, strict=True)}) > 1
