"""Format-preserving pseudonyms of personal data, with DataFrame functions only.

A value that its own rule accepts (check digits, ranges, the calendar) is permuted by a keyed Feistel network over the
positions of its format, so equal values get equal pseudonyms in every document, different ones of one format different
pseudonyms, and a pseudonym is again valid for its format. What fails its rule stays as it is. Whoever has the key can
undo it all: it belongs to the session's settings, not to code.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import unused

ROUNDS = 8
#: The setting that holds the key.
KEY = "spark.quillon.pseudonym.key"
#: Days are counted from here. 400 years of the calendar have 189 * 773 days; a date stays within its 400 years.
EPOCH, DAYS_HIGH, DAYS_LOW = "1800-01-01", 189, 773
#: What is left at the ends of the calendar of four digits, as days and two factors of their number: 1-199 and 9800-9999.
FIRST_DAYS, LAST_DAYS = (-657071, -584388, 13, 5591), (2921940, 2994988, 184, 397)

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
LABEL = r"(?i:token|secret|password|api.?key)\s*+[=:]\s*+[\"']?"
SECRET = rf"{LABEL}(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{{16,}}+(?![\p{{L}}\p{{N}}._%+-]*+@)"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![0-9+])(?:\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\+[2-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5})(?![0-9])"
#: A version number is no address.
IP = r"(?<![0-9.vV])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
SSN = r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![0-9-])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-])"
#: A last group of one to three digits is not the start of a date, a phone number, an address or the like.
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}(?![\p{L}\p{N}]|[./-][0-9]|[\p{L}\p{N}._%+-]*+@)|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![0-9])"
ANY = f"{EMAIL}|{SECRET}|(?=[A-Z]){IBAN}|(?=[0-9+(])(?:{PHONE}|{IP}|{SSN}|{DATE}|{CARD})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")


def feistel(values: Column, moduli: Column, key: str, kind: str) -> Column:
    """Permute an array of numbers, element i staying below moduli[i]; both arrays of long, of the same size."""

    def shifted(own: Column, mods: Column, other: Column, i: Column) -> Column:
        base = F.concat_ws("|", F.lit(key), F.lit(kind), i, F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
        # Of a long value a digest stands for the other half, so the work grows with the length only.
        base = let(base, lambda b: F.when(F.length(b) > 2048, F.sha2(b, 256)).otherwise(b))
        return let(base, lambda b: F.transform(own, lambda x, j: F.pmod(x + _number(F.sha2(F.concat_ws("|", b, j), 256)), F.get(mods, j))))

    def halves(pair: Column, half: Column) -> Column:
        cut = lambda a: (F.slice(a, F.lit(1), half), F.slice(a, half + 1, F.size(a) - half))
        (a, b), (ma, mb) = cut(pair["v"]), cut(pair["m"])

        def turn(s: Column, i: Column) -> Column:
            even = F.struct(shifted(s["a"], s["ma"], s["b"], i).alias("a"), s["b"].alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"))
            odd = F.struct(s["a"].alias("a"), shifted(s["b"], s["mb"], s["a"], i).alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"))
            return F.when(i % 2 == 0, even).otherwise(odd)

        start = F.struct(a.alias("a"), b.alias("b"), ma.alias("ma"), mb.alias("mb"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return let(F.struct(values.alias("v"), moduli.alias("m")), lambda p: let(F.floor(F.size(p["v"]) / 2).cast("int"), lambda half: halves(p, half)))


def _chars(s: Column) -> Column:
    """Characters of a string; an empty array for an empty one."""
    return F.filter(F.split(s, ""), lambda c: c != "")


ALNUM = "[0-9A-Za-z]"


def _alphabet(c: Column) -> Column:
    """Code of the first character of the class of an ASCII letter or digit."""
    return F.when(c <= "9", F.lit(48)).when(c <= "Z", F.lit(65)).otherwise(F.lit(97)).cast("long")


def permuted(s: Column, key: str, kind: str) -> Column:
    """Permute the ASCII letters and digits of a string; each stays in its class, everything else in its place."""

    def of(text: Column, chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.ascii(c).cast("long") - _alphabet(c))
        moduli = F.transform(chars, lambda c: F.when(c <= "9", F.lit(10)).otherwise(F.lit(26)).cast("long"))
        # Halves of nothing and one character would only shift its alphabet: it is cut in two numbers.
        whole = lambda c, m: let(feistel(F.array(F.floor(c / m).cast("long"), c % m), F.array(F.lit(2).cast("long"), m), key, kind), lambda v: F.get(v, F.lit(0)) * m + F.get(v, F.lit(1)))
        one = F.array(whole(F.get(codes, F.lit(0)), F.floor(F.get(moduli, F.lit(0)) / 2).cast("long")))
        new = F.zip_with(F.when(F.size(chars) == 1, one).otherwise(feistel(codes, moduli, key, kind)), chars, lambda x, c: F.char(x + _alphabet(c)))
        # What stands between the letters and digits, and then those, in turn.
        return F.concat(F.array_join(F.zip_with(F.slice(F.split(text, ALNUM, -1), F.lit(1), F.size(chars)), new, lambda gap, c: F.concat(gap, c)), ""), F.element_at(F.split(text, ALNUM, -1), -1))

    return let(s, lambda t: let(_chars(F.regexp_replace(t, "[^0-9A-Za-z]", "")), lambda chars: of(t, chars)))


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(total: Column, x: Column) -> Column:
        return total + x["d"] - F.when(x["d"] > 9, 9).otherwise(0)

    weighed = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct((c.cast("int") * (1 + i % 2)).alias("d")))
    return F.aggregate(weighed, F.lit(0), add) % 10


def mod97(s: Column) -> Column:
    """A string of digits and capitals as the IBAN's number, modulo 97."""
    return F.aggregate(
        _chars(s), F.lit(0), lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97).cast("int")
    )


def _email(m: Column, key: str) -> Column:
    # Letters outside ASCII have no class of their own to be permuted in: keyed letters stand for each, as many as it
    # takes to tell all characters apart.
    letter = lambda n, i: F.char(97 + (F.floor(n / 26**i) % 26).cast("int"))
    code = lambda c: let(F.get(feistel(F.array(F.floor(F.ascii(c) / 1056).cast("long"), F.ascii(c).cast("long") % 1056), F.array(F.lit(1056).cast("long"), F.lit(1056).cast("long")), key, "letter"), F.lit(0)) * 1056 + F.get(feistel(F.array(F.floor(F.ascii(c) / 1056).cast("long"), F.ascii(c).cast("long") % 1056), F.array(F.lit(1056).cast("long"), F.lit(1056).cast("long")), key, "letter"), F.lit(1)), lambda n: F.concat(*(letter(n, i) for i in range(5))))
    plain = F.array_join(F.transform(_chars(F.substring_index(m, "@", 1)), lambda c: F.when(c.rlike("^[\\x00-\\x7F]$"), c).otherwise(code(c))), "")
    return F.concat(permuted(plain, key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    """The label and the gap stay."""

    def as_hex(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: F.conv(c, 16, 10).cast("long"))
        new = feistel(codes, F.transform(chars, lambda c: F.lit(16).cast("long")), key, "hex")
        return F.array_join(F.transform(new, lambda x: F.lower(F.hex(x))), "")

    value = lambda v: F.when(v.rlike("^[0-9a-f]+$"), let(_chars(v), as_hex)).otherwise(permuted(v, key, "secret"))
    return let(F.regexp_extract(m, f"^{LABEL}", 0), lambda label: F.concat(label, let(F.substring(m, F.length(label) + 1, F.length(m)), value)))


def _iban(m: Column, key: str) -> Column:
    def whole(country: Column, body: Column) -> Column:
        check = F.lpad((98 - mod97(F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
        return F.concat(country, check, body)

    valid = mod97(F.concat(F.regexp_replace(F.substring(m, 5, 64), " ", ""), F.substring(m, 1, 4))) == 1
    return F.when(valid, let(permuted(F.substring(m, 5, 64), key, "iban"), lambda body: whole(F.substring(m, 1, 2), body))).otherwise(m)


def _phone(m: Column, key: str) -> Column:
    """The country code stays; a code's digits count as two where it is not 1."""
    return let(F.regexp_extract(m, r"^(?:\+1|\+[0-9]{2})?", 0), lambda kept: F.concat(kept, permuted(F.substring(m, F.length(kept) + 1, F.lit(64)), key, "phone")))


def _ip(m: Column, key: str) -> Column:
    def of(parts: Column) -> Column:
        new = feistel(parts, F.transform(parts, lambda p: F.lit(256).cast("long")), key, "ip")
        return F.when(F.forall(parts, lambda p: p <= 255), F.array_join(F.transform(new, lambda x: x.cast("string")), ".")).otherwise(m)

    return let(F.transform(F.split(m, r"\."), lambda p: p.cast("long")), of)


def _ssn(m: Column, key: str) -> Column:
    moduli = F.array(*(F.lit(x).cast("long") for x in (898, 99, 9999)))

    def shown(new: Column) -> Column:
        area = F.get(new, F.lit(0)) + 1 + F.when(F.get(new, F.lit(0)) >= 665, 1).otherwise(0)
        mark = F.substring(m, 4, 1)
        return F.concat(F.lpad(area.cast("string"), 3, "0"), mark, F.lpad((F.get(new, F.lit(1)) + 1).cast("string"), 2, "0"), mark, F.lpad((F.get(new, F.lit(2)) + 1).cast("string"), 4, "0"))

    def of(parts: Column) -> Column:
        area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
        rank = area - 1 - F.when(area > 666, 1).otherwise(0)
        valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, let(feistel(F.array(rank, group - 1, serial - 1), moduli, key, "ssn"), shown)).otherwise(m)

    return let(F.transform(F.split(m, "[ -]"), lambda p: p.cast("long")), of)


def _date(m: Column, key: str) -> Column:
    # Day first where both readings are dates, so that a form is read in one way.
    forms = (("^....-", "yyyy-MM-dd"), ("^..../", "yyyy/MM/dd"), ("^../", "dd/MM/yyyy"), ("^../", "MM/dd/yyyy"), (r"^..\.", "dd.MM.yyyy"))
    reads = F.array(*(F.struct(F.when(m.rlike(shape), F.date_diff(F.try_to_date(m, form), F.to_date(F.lit(EPOCH)))).cast("long").alias("n"), F.lit(k).alias("form")) for k, (shape, form) in enumerate(forms)))

    era = lambda start, high, low: F.struct(start.cast("long").alias("start"), F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low"))

    def shown(new: Column, of: Column, form: Column) -> Column:
        day = F.date_add(F.to_date(F.lit(EPOCH)), (of["start"] + F.get(new, F.lit(0)) * of["low"] + F.get(new, F.lit(1))).cast("int"))
        texts = [F.date_format(day, f) for _, f in forms]
        return F.element_at(F.array(*texts), form + 1)

    def within(read: Column, of: Column) -> Column:
        n = read["n"] - of["start"]
        new = feistel(F.array(F.floor(n / of["low"]).cast("long"), n % of["low"]), F.array(of["high"], of["low"]), key, "date")
        return F.when(read.isNotNull(), let(new, lambda x: shown(x, of, read["form"]))).otherwise(m)

    def of(read: Column) -> Column:
        n = read["n"]
        regular = era(F.floor(n / (DAYS_HIGH * DAYS_LOW)) * (DAYS_HIGH * DAYS_LOW), DAYS_HIGH, DAYS_LOW)
        ends = [era(F.lit(x[0]), *x[2:]) for x in (FIRST_DAYS, LAST_DAYS)]
        return let(F.when(n < FIRST_DAYS[1], ends[0]).when(n >= LAST_DAYS[0], ends[1]).otherwise(regular), lambda e: within(read, e))

    return let(F.get(F.filter(reads, lambda r: (r["n"] >= FIRST_DAYS[0]) & (r["n"] < LAST_DAYS[1])), F.lit(0)), of)


def _card(m: Column, key: str) -> Column:
    def whole(new: Column) -> Column:
        return F.concat(new, ((10 - luhn(F.concat(F.regexp_replace(new, "[ -]", ""), F.lit("0")))) % 10).cast("string"))

    def card(s: Column, otherwise: Column) -> Column:
        valid = luhn(F.regexp_replace(s, "[ -]", "")) == 0
        return F.when(valid, let(permuted(F.substring(s, F.lit(1), F.length(s) - 1), key, "card"), whole)).otherwise(otherwise)

    # Four groups of four and one to three digits more may also be a card number and another one beside it.
    beside = m.rlike("^[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}$")
    first = card(F.substring(m, 1, 19), F.substring(m, 1, 19))
    return card(m, F.when(beside, F.concat(first, F.substring(m, 20, 64))).otherwise(m))


#: In the order in which the pattern tries them.
RULES: tuple[tuple[str, Callable[[Column, str], Column]], ...] = (("@", _email), (f"^(?:{IBAN})$", _iban), (f"^(?:{PHONE})$", _phone), (f"^(?:{IP})$", _ip), (f"^(?:{SSN})$", _ssn), (f"^(?:{DATE})$", _date), (f"^(?:{CARD})$", _card))


def pseudonym(value: Column, key: str) -> Column:
    """Of one matched value. A value that no rule's shape fits is a secret."""
    out = _secret(value, key)
    for shape, rule in reversed(RULES):
        out = F.when(value.rlike(shape), rule(value, key)).otherwise(out)
    return out


def session_key(spark: SparkSession) -> str:
    """The key in the session's setting KEY. A session without one gets a random key, and keeps it: values are then
    linked within what it writes, and to nothing else."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its text pseudonymised, and with ``counts`` n_found and n_changed, the values of a known shape and
    those replaced.

    All other columns stay, whatever their names, but n_found and n_changed are replaced where they are asked for. Texts
    of any length are read whole; null texts stay null, with counts 0, empty ones empty; the rest of a text is not
    touched. Rows are independent: repeated rows give equal results, null ids count like others, there is no shuffle,
    and an empty table gives an empty result.
    """
    text = F.col(text_col)
    found_col, new_col = unused(docs.columns, "found"), unused(docs.columns, "replaced")
    # Every shape has a digit or an at sign; most texts have neither and need no closer look.
    near = F.contains(text, F.lit("@")) | text.rlike("[0-9]")
    found = F.when(near, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = docs.withColumn(found_col, found)
    held = held.withColumn(new_col, F.transform(found_col, lambda m: pseudonym(m, key)))
    whole = F.array_join(F.zip_with(F.split(text, ANY, -1), F.array_append(F.col(new_col), F.lit("")), lambda gap, value: F.concat(gap, value)), "")
    changed = F.size(F.filter(F.zip_with(found_col, new_col, lambda a, b: a != b), lambda x: x))
    if counts:
        held = held.withColumn("n_found", F.coalesce(F.size(found_col), F.lit(0)).cast("long")).withColumn("n_changed", F.coalesce(changed, F.lit(0)).cast("long"))
    return held.withColumn(text_col, F.when(F.size(found_col) > 0, whole).otherwise(text)).drop(found_col, new_col)
