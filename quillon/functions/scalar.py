"""Column functions: lenient parsing, dates, text, severities, vectors. All stay inside the JVM."""

from __future__ import annotations

import json
import string
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_int(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.try_cast("int"), F.lit(default))


def safe_float(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def number(x: Column) -> Column:
    """A double, NaN as null."""
    d = x.try_cast("double")
    return F.when(F.isnan(d), None).otherwise(d)


def parse_time(text: Column) -> Column:
    """Timestamp of ISO text in several forms; without a zone it is UTC. Bad text is null."""
    t = F.regexp_replace(F.trim(text), "Z$", "+00:00")
    iso = F.try_to_timestamp(t)
    rfc = F.try_to_timestamp(F.regexp_replace(t, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(iso, rfc)


def compact_date(added: Column, occurred: Column) -> Column:
    """ISO date of a YYYYMMDD... text: the time of observation if it starts with eight digits, else the event's own."""
    def of(x: Column) -> Column:
        head = F.substring(x, 1, 8)
        return F.when(head.rlike("^[0-9]{8}$"), F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)))

    return F.coalesce(of(added), of(occurred))


def observed_at(added: Column, occurred: Column) -> Column:
    """ISO date and time of a YYYYMMDD... text: the time of observation if it starts with eight digits, else the event's
    own date if it has eight characters, else that as it is."""
    def of(x: Column) -> Column:
        return F.concat(F.concat_ws("-", F.substring(x, 1, 4), F.substring(x, 5, 2), F.substring(x, 7, 2)), F.lit("T00:00:00"))

    return F.when(F.substring(added, 1, 8).rlike("^[0-9]{8}$"), of(added)).when(F.length(occurred) == 8, of(occurred)).otherwise(occurred)


def epoch_ms(x: Column) -> Column:
    return F.timestamp_millis(x.try_cast("long"))


def joined_key(*parts: Column) -> Column:
    """Parts joined by a bar; null parts are empty, so that the number of parts is fixed."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def key_part(key: Column, i: int, n: int) -> Column:
    """Part i of a joined key that has n parts; null if empty or if the key has another number."""
    parts = F.split(key, r"\|")
    return F.when(F.size(parts) == n, F.nullif(F.get(parts, F.lit(i)), F.lit("")))


def content_hash(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def contains_ci(x: Column, needle: Column | str) -> Column:
    """LIKE '%needle%' with ASCII case folding."""
    return F.contains(ascii_lower(x), ascii_lower(needle if isinstance(needle, Column) else F.lit(needle)))


#: Characters of the named references of HTML by name, with the semicolon and, where it may be missing, without.
_NAMED = json.dumps(html5)
_BARE = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=len, reverse=True))
#: Numbers that stand for the characters which Windows has at them.
_WINDOWS = json.dumps({str(n): bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)})


def _numbered(n: Column) -> Column:
    """The character of a numeric reference: the replacement mark for what is none, nothing for controls and non-characters."""
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    nothing = ((n < 32) & ~n.isin(9, 10, 12, 13)) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n % 0x10000 >= 0xFFFE)
    windows = F.from_json(F.lit(_WINDOWS), "map<string,string>")[n.cast("string")]
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(n.between(0x80, 0x9F), windows).when(nothing, "").otherwise(char)


def unescape(x: Column, closed: bool = False) -> Column:
    """Replace the character references of HTML, named and numeric, once each, as browsers do: a known name without its
    semicolon counts as well, also before other letters where the standard says so. Unknown names stay. With ``closed``
    only references that end in a semicolon count."""

    def plain(t: Column) -> Column:
        # Numbers of more digits than characters have are cut to one that is too large as well.
        tens, hexed = F.regexp_extract(t, "^&#0*([0-9]*)", 1), F.regexp_extract(t, "^&#[xX]0*([0-9a-fA-F]*)", 1)
        code = F.when(t.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), F.substring(hexed, 1, 7)), 16, 10)).otherwise(F.concat(F.lit("0"), F.substring(tens, 1, 8)))
        named = F.from_json(F.lit(_NAMED), "map<string,string>")
        bare = F.regexp_extract(t, f"^&({_BARE})", 1)
        cut = F.lit(None) if closed else F.when(bare != "", F.concat(named[bare], F.substr(t, F.length(bare) + 2)))
        known = F.coalesce(named[F.substring(t, 2, 99)], cut, t)
        return F.when(~F.startswith(t, F.lit("&")) | (t == "&"), t).when(F.startswith(t, F.lit("&#")), _numbered(code.try_cast("long"))).otherwise(known)

    end = ";" if closed else ";?"
    pieces = F.regexp_extract_all(x, F.lit(f"&#[0-9]+{end}|&#[xX][0-9a-fA-F]+{end}|&[A-Za-z][A-Za-z0-9]*{end}|[^&]+|&"), 0)
    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(pieces, plain), "")).otherwise(x)


def strip_tags(html: Column, spaced: bool = False, closed: bool = False) -> Column:
    """Text without tags, references (``closed``: as in ``unescape``) replaced, white space collapsed. ``spaced`` puts a
    blank where a tag was."""
    bare = F.regexp_replace(html, "<[^>]+>", " " if spaced else "")
    return F.trim(F.regexp_replace(unescape(bare, closed), r"\s+", " "))


def passage(title: Column, body: Column, most: int = 1024, prefix: str = "passage: ") -> Column:
    """Title and stripped body, cut to a length, with the prefix of embedding models; null if there is no text."""
    text = F.trim(F.concat_ws(" ", F.nullif(F.trim(title), F.lit("")), F.nullif(strip_tags(body), F.lit(""))))
    return F.when(text != "", F.concat(F.lit(prefix), F.substring(text, 1, most)))


def clean_name(x: Column) -> Column:
    """White space collapsed; null if shorter than two characters or all digits."""
    t = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.when((F.length(t) >= 2) & ~t.rlike("^[0-9]+$"), t)


def all_caps(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x) & (F.length(x) > 2)


#: Titles before names.
HONORIFICS = ["grand ayatollah", "ayatollah", "prime minister", "field marshal", "grand mufti", "sheikh", "sheikha", "imam", "president", "general", "governor", "chancellor", "cardinal", "archbishop", "bishop", "colonel", "major", "captain", "admiral", "king", "queen", "prince", "princess", "sultan", "emir", "senator", "pope", "dr.", "dr", "mr.", "mr", "mrs.", "mrs", "ms.", "ms"]


def person_key(name: Column) -> Column:
    """Lower-case name without leading titles, however many."""
    titles = "|".join(t.replace(".", r"\.") for t in sorted(HONORIFICS, key=len, reverse=True))
    return F.trim(F.regexp_replace(F.lower(F.trim(F.regexp_replace(name, r"\s+", " "))), f"^(?:(?:{titles}) )+", ""))


def last_token(x: Column) -> Column:
    return F.element_at(F.split(x, r"\s+"), -1)


def wkt_point(x: Column) -> tuple[Column, Column]:
    """Latitude and longitude of Point(lon lat)."""
    pattern = r"(?i)point\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)\s*\)"
    return F.regexp_extract(x, pattern, 2).try_cast("double"), F.regexp_extract(x, pattern, 1).try_cast("double")


def title_country(title: Column) -> Column:
    """What follows the last en dash of a title, unless it starts with a digit."""
    tail = F.trim(F.substring_index(title, "–", -1))
    return F.when(F.contains(title, F.lit("–")) & ~tail.rlike("^[0-9]") & (tail != ""), tail)


def fenced_json(text: Column) -> Column:
    """The content of the first fenced block, or the text itself."""
    inside = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.trim(F.when(inside != "", inside).otherwise(text))


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def bounding_box(lat: Column, lon: Column, margin: float) -> Column:
    """west,south,east,north with two decimals."""
    return F.format_string("%.2f,%.2f,%.2f,%.2f", lon - margin, lat - margin, lon + margin, lat + margin)


def clamp(x: Column, low: int = 1, high: int = 5) -> Column:
    return F.least(F.greatest(x.cast("int"), F.lit(low)), F.lit(high))


def severity_goldstein(g: Column) -> Column:
    """1 for 0 or null, else int(|g| / 2) + 1 within 1 to 5."""
    return F.when(F.coalesce(g, F.lit(0.0)) == 0, 1).otherwise(clamp(F.floor(F.abs(g) / 2) + 1))


def severity_magnitude(m: Column) -> Column:
    return clamp(F.when(m >= 0, F.floor(m)).otherwise(F.ceil(m)) - 2)


def severity_z(z: Column, threshold: float = 1.0) -> Column:
    """|z| over a threshold, half to even, within 1 to 5."""
    return clamp(F.bround(F.abs(z) / threshold))


def severity_deaths(n: Column) -> Column:
    return F.when(n >= 1000, 5).when(n >= 250, 4).when(n >= 100, 3).when(n >= 25, 2).otherwise(1)


def age_label(hours: Column) -> Column:
    h = F.greatest(hours, F.lit(0.0))
    return F.when(h < 1, F.concat(F.floor(h * 60).cast("string"), F.lit("min"))).when(h < 48, F.concat(F.floor(h).cast("string"), F.lit("h"))).otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_of_cosine(c: float) -> float:
    """Distance of unit vectors with this cosine."""
    return (2 * (1 - c)) ** 0.5
