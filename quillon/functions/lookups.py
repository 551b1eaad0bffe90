"""Tables of names: event classes, countries, other words for places, organisations; and what they make of a name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The four classes of events.
QUADS = {1: "verbal cooperation", 2: "material cooperation", 3: "verbal conflict", 4: "material conflict"}

#: Two-letter country codes of the event export (not ISO), with name and ISO code.
COUNTRIES = {
    "AE": ("United Arab Emirates", "AE"), "AF": ("Afghanistan", "AF"), "AG": ("Algeria", "DZ"), "AL": ("Albania", "AL"),
    "AR": ("Argentina", "AR"), "BA": ("Bahrain", "BH"), "BK": ("Bosnia and Herzegovina", "BA"), "AM": ("Armenia", "AM"),
    "AJ": ("Azerbaijan", "AZ"), "AS": ("Australia", "AU"), "BG": ("Bangladesh", "BD"), "BM": ("Myanmar", "MM"),
    "BR": ("Brazil", "BR"), "CA": ("Canada", "CA"), "CD": ("Chad", "TD"), "CG": ("DR Congo", "CD"), "CH": ("China", "CN"),
    "CM": ("Cameroon", "CM"), "CO": ("Colombia", "CO"), "CT": ("Central African Republic", "CF"), "EG": ("Egypt", "EG"),
    "EI": ("Ireland", "IE"), "ET": ("Ethiopia", "ET"), "FR": ("France", "FR"), "GG": ("Georgia", "GE"), "GH": ("Ghana", "GH"),
    "GM": ("Germany", "DE"), "GR": ("Greece", "GR"), "HA": ("Haiti", "HT"), "IN": ("India", "IN"), "IR": ("Iran", "IR"),
    "IS": ("Israel", "IL"), "ID": ("Indonesia", "ID"), "IT": ("Italy", "IT"), "IZ": ("Iraq", "IQ"), "JA": ("Japan", "JP"),
    "JO": ("Jordan", "JO"), "KE": ("Kenya", "KE"), "KU": ("Kuwait", "KW"), "KN": ("North Korea", "KP"), "KS": ("South Korea", "KR"),
    "LE": ("Lebanon", "LB"), "LY": ("Libya", "LY"), "ML": ("Mali", "ML"), "MO": ("Morocco", "MA"), "MU": ("Oman", "OM"),
    "MX": ("Mexico", "MX"), "MY": ("Malaysia", "MY"), "NG": ("Niger", "NE"), "NI": ("Nigeria", "NG"), "NZ": ("New Zealand", "NZ"),
    "PK": ("Pakistan", "PK"), "PL": ("Poland", "PL"), "QA": ("Qatar", "QA"), "RP": ("Philippines", "PH"), "RS": ("Russia", "RU"),
    "SA": ("Saudi Arabia", "SA"), "SF": ("South Africa", "ZA"), "SO": ("Somalia", "SO"), "SP": ("Spain", "ES"), "SU": ("Sudan", "SD"),
    "SY": ("Syria", "SY"), "TH": ("Thailand", "TH"), "TS": ("Tunisia", "TN"), "TU": ("Turkey", "TR"), "TW": ("Taiwan", "TW"),
    "TX": ("Turkmenistan", "TM"), "UK": ("United Kingdom", "GB"), "UP": ("Ukraine", "UA"), "US": ("United States", "US"),
    "VE": ("Venezuela", "VE"), "VM": ("Vietnam", "VN"), "WZ": ("Eswatini", "SZ"), "YM": ("Yemen", "YE"),
}

#: Adjectives of countries.
DEMONYMS = {
    "israeli": "Israel", "russian": "Russia", "chinese": "China", "american": "United States", "british": "United Kingdom",
    "french": "France", "german": "Germany", "italian": "Italy", "spanish": "Spain", "japanese": "Japan", "korean": "South Korea",
    "indian": "India", "pakistani": "Pakistan", "iranian": "Iran", "iraqi": "Iraq", "syrian": "Syria", "turkish": "Turkey",
    "ukrainian": "Ukraine", "polish": "Poland", "canadian": "Canada", "mexican": "Mexico", "brazilian": "Brazil",
    "australian": "Australia", "egyptian": "Egypt", "saudi": "Saudi Arabia", "emirati": "United Arab Emirates",
    "lebanese": "Lebanon", "jordanian": "Jordan", "afghan": "Afghanistan", "vietnamese": "Vietnam", "taiwanese": "Taiwan",
    "thai": "Thailand", "indonesian": "Indonesia", "nigerian": "Nigeria", "kenyan": "Kenya", "ethiopian": "Ethiopia",
    "south african": "South Africa", "colombian": "Colombia", "argentine": "Argentina", "venezuelan": "Venezuela",
    "dutch": "Netherlands", "swedish": "Sweden", "norwegian": "Norway", "finnish": "Finland", "danish": "Denmark",
    "swiss": "Switzerland", "greek": "Greece", "portuguese": "Portugal", "irish": "Ireland", "scottish": "United Kingdom",
    "welsh": "United Kingdom", "yemeni": "Yemen", "qatari": "Qatar", "kuwaiti": "Kuwait", "libyan": "Libya",
    "algerian": "Algeria", "moroccan": "Morocco", "sudanese": "Sudan", "somali": "Somalia", "north korean": "North Korea",
}

#: Other names of countries and continents.
PLACE_ALIASES = {
    "uk": "United Kingdom", "britain": "United Kingdom", "england": "United Kingdom", "great britain": "United Kingdom",
    "us": "United States", "usa": "United States", "u.s.": "United States", "u.s.a.": "United States", "america": "United States",
    "uae": "United Arab Emirates", "prc": "China", "mainland china": "China", "rok": "South Korea", "dprk": "North Korea",
    "roc": "Taiwan", "europe": "Europe", "european": "Europe", "asia": "Asia", "asian": "Asia", "africa": "Africa", "african": "Africa",
}

#: Bodies of several states.
ORGANISATIONS = {
    "eu": "European Union", "european union": "European Union", "nato": "NATO", "un": "United Nations", "united nations": "United Nations",
    "who": "World Health Organization", "world health organization": "World Health Organization", "imf": "International Monetary Fund",
    "international monetary fund": "International Monetary Fund", "world bank": "World Bank", "wto": "World Trade Organization",
    "world trade organization": "World Trade Organization", "opec": "OPEC", "g7": "G7", "g20": "G20", "asean": "ASEAN",
    "african union": "African Union", "au": "African Union", "arab league": "Arab League", "brics": "BRICS",
}

#: Words that name a country and something else.
AMBIGUOUS = ["turkey", "georgia", "jordan", "chad", "guinea", "niger", "congo", "mali", "jersey"]


def lookup(values: dict, key: Column, default: Column | None = None) -> Column:
    """The value of a key in a small fixed table, as a literal map beside every row; else the default."""
    found = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key]
    return found if default is None else F.coalesce(found, default)


def quad_label(quad: Column) -> Column:
    return lookup(QUADS, quad.cast("int"), F.concat(F.lit("quad"), quad.cast("string")))


def country_name(code: Column) -> Column:
    """The name of a country code of the export; an unknown code stays."""
    return lookup({k: v[0] for k, v in COUNTRIES.items()}, code, code)


def country_iso2(code: Column) -> Column:
    return lookup({k: v[1] for k, v in COUNTRIES.items()}, code)


def place_label(name: Column) -> Column:
    """The country that a name is another word for: an adjective of it first, then an alias; null for other names."""
    low = F.lower(name)
    return F.coalesce(lookup(DEMONYMS, low), lookup(PLACE_ALIASES, low))


def classified(name: Column, kind: Column) -> tuple[Column, Column]:
    """Type and canonical name: words for places are locations, bodies of states organisations, others as extracted."""
    place, body = place_label(name), lookup(ORGANISATIONS, F.lower(name))
    return F.when(place.isNotNull(), "location").when(body.isNotNull(), "organization").otherwise(kind), F.coalesce(place, body)
